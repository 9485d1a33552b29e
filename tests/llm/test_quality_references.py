"""Quality verdicts of documents whose language has no reference, against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lakejobs.llm import quality
from lakejobs.llm.oracle import ORACLE
from lakejobs.llm.queries import op1_quality_rules


def sql_rows(folder, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE['op1_quality_rules']})").fetchall(), key=repr)


@pytest.mark.parametrize("langs", ["some rare", "all null"])
def test_rare_and_null_languages(spark, tiny, tmp_path, monkeypatch, langs):
    k = F.pmod("doc_id", F.lit(25))
    lang = F.when(k == 0, None).when(k == 1, "xx").otherwise(F.col("lang")) if langs == "some rare" else F.lit(None)
    docs = spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/documents.parquet").withColumn("lang", lang.cast("string"))
    # A language of one document, and one whose name nothing else has, below both limits.
    docs.withColumn("lang", F.when(F.col("doc_id") == 7, "zz").otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for block in (128, 1):
        monkeypatch.setattr(quality, "BLOCK", block)
        df = op1_quality_rules(spark, str(tmp_path))
        assert "NestedLoop" not in df._jdf.queryExecution().toString()
        columns = sorted(df.columns)
        results.append(sorted((tuple(r) for r in df.select(*columns).collect()), key=repr))
    assert results[0] == results[1] == sql_rows(tmp_path, columns)
    kept = columns.index("kept")
    assert {r[kept] for r in results[0]} == {True, False}
