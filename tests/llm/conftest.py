"""Small frames for the operators' tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, lang, source), with clashing extra columns if asked."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("kept", "n_words", "row", "id", "node", "label", "size", "h", "keys", "w", "likely", "hits", "covers"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
