import pytest

from voxlog import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, same_as_sql, name):
    same_as_sql(queries.QUERIES[name](spark, DATA), queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_range_filters_reach_the_scan(spark, tmp_path):
    """A chunk range must prune partitions, so its region bounds have to be in the plan."""
    from pyspark.sql import functions as F

    from voxlog.functions.keys import matches
    from voxlog.plans.log import log_of_events

    log = log_of_events(spark.read.parquet(f"{DATA}/events.parquet"))
    log.write.partitionBy("dimension", "region_x", "region_z").parquet(str(tmp_path / "log"))
    plan = spark.read.parquet(str(tmp_path / "log")).where(matches(None, -40, 31, -33, 5) & (F.col("dimension") == 0))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "region_x" in plan.split("PartitionFilters: [")[1].split("]")[0]
