import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of (doc_id, text), with columns whose names clash with the operators' own."""

    def make(rows, columns="doc_id long, text string"):
        df = spark.createDataFrame([tuple(r) for r in rows], columns)
        from pyspark.sql import functions as F

        for name in ("id", "fp", "sha", "rid", "n", "leaf", "block", "shard", "value", "line"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(name))
        return df

    return make


#: Null ids and texts, empty and blank texts, repeated rows, other scripts, control characters.
ODD = [
    (None, "a null id"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (4, "one"),
    (4, "one"),
    (5, "ONE"),
    (6, "日本語の文章 \U0001f600 ünïcode ▁ \\ <|end|>"),
    (7, "x" * 50_000),
    (8, "word " * 20_000),
    (-(2**63), "the smallest id"),
    (2**63 - 1, "the largest id"),
]
