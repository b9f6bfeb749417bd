import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_as_sql():
    """Asserts that a query's rows equal its SQL's, whatever their order."""
    import duckdb

    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else repr(bytes(v)) if isinstance(v, (bytes, bytearray)) else repr(v)

    def check(df, sql, sf="sf0.001"):
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
        found = c.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(found.columns)
        at = [found.columns.index(x) for x in columns]
        want = sorted([plain(r[i]) for i in at] for r in found.fetchall())
        got = sorted([plain(r[x]) for x in columns] for r in df.collect())
        assert got == want
        return len(got)

    return check
