"""Log records of large tables: their times are past the nanoseconds that a bigint holds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.plans.oracles import ORACLES
from tracewell.plans.registry import QUERIES

LAST_BIGINT = ((2**63 - 1) // 1_000_000_000 - 1_704_067_200) // 180


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("late"))
    key = F.col("id") + LAST_BIGINT - 40  # both sides of the last key that fits
    spark.range(400).select(
        key.alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"),
        F.element_at(F.array(*map(F.lit, "OFP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        (F.col("id") * 1250.25).alias("o_totalprice"),
        F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-ANY")).alias("o_orderpriority"),
    ).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["otlp_logs", "stream_otlp_logs"])
def test_times_past_a_bigint_of_nanoseconds(spark, orders, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet/*.parquet'")
    cursor = connection.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, orders).select(*names).collect()]
    assert len(got) >= 300
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    late = [r[names.index("ts_us")] for r in got if (r[names.index("ts_us")] or 0) > 2**63 // 1000]
    assert len(late) > 150
