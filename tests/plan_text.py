"""Reading physical plans in tests."""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
