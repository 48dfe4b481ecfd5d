"""One order, seller, product and customer each hold a third of the rows."""

import duckdb
import pytest

from harness.catalogue import registered
from harness.check import TABLES, compare, connect
from harness.oracle import statements

SOURCE = "/root/testdata/sf0.01"
HOT = {
    "lineitem": {"l_orderkey": 1, "l_suppkey": 2, "l_partkey": 3},
    "orders": {"o_custkey": 5},
    "events": {"event_id": 40},
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for t in TABLES.split():
        hot = ", ".join(
            f"CASE WHEN hash(n, '{c}') % 3 = 0 THEN {v} ELSE {c} END AS {c}"
            for c, v in HOT.get(t, {}).items()
        )
        con.execute(
            f"COPY (SELECT * EXCLUDE (n) {f'REPLACE ({hot})' if hot else ''}"
            f" FROM (SELECT *, row_number() OVER () AS n FROM '{SOURCE}/{t}.parquet'))"
            f" TO '{root}/{t}.parquet' (ROW_GROUP_SIZE 5000)"
        )
    return str(root)


@pytest.fixture
def small_thresholds(settings):
    """Cluster behaviour at test size: no broadcasts, many splits, low skew limits."""
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.files.maxPartitionBytes": "100KB",
        "spark.sql.files.openCostInBytes": "1KB",
        "spark.sql.shuffle.partitions": "16",
    }.items():
        settings(key, value)


def final_joins(df):
    """The joins of the plan as it was finally run."""
    plan = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    return [line.strip(" :+-*") for line in plan.splitlines() if "SortMergeJoin" in line]


# Joins that carry the hot key of the items: each must have been split.
ITEM_JOINS = {
    "fct_order_items": ["order_id"],
    "fct_order_payments": ["order_id"],
    "customer_reviews": ["order_id", "customer_sk", "order_id"],
    "logistics_network": ["customer_sk", "seller_sk", "order_id"],
    "obt_orders": ["order_id", "order_id", "product_sk", "seller_sk", "order_id"],
    "obt_sellers": ["order_id", "order_id"],
    "payment_profiles": ["order_id", "order_id"],
    "product_performance": ["order_id", "order_id"],
    "seller_sales": ["order_id", "order_id"],
}


@pytest.mark.parametrize("name", list(ITEM_JOINS))
def test_hot_keys_are_split(spark, skewed, small_thresholds, name):
    df = registered()[name](spark, skewed)
    df.collect()
    split = [j for j in final_joins(df) if "skew=true" in j]
    keys = [j.split("[")[1].split("#")[0] for j in split]
    assert sorted(keys) == sorted(ITEM_JOINS[name]), final_joins(df)


@pytest.mark.parametrize(
    "name",
    [
        *ITEM_JOINS,
        "fct_orders",
        "obt_customers",
        "lineage_reconcile",
        "duplicates",
        "orphans",
        "join_cardinality",
        "retention",
        "reconcile_measure",
    ],
)
def test_results_hold_under_skew(spark, skewed, small_thresholds, name):
    con = connect(skewed)
    verdict, n = compare(spark, con, skewed, name, registered()[name], statements()[name])
    assert verdict == "ok" and n > 0


def test_retention_splits_a_key_of_many_segments(spark, small_thresholds):
    from pyspark.sql import functions as F

    from tallyline.operators import retention

    n = 300_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000)
    up = spark.range(0, n, 1, 8).select(
        hot.alias("key"), F.md5(F.col("id").cast("string")).alias("segment")
    )
    down = spark.range(0, 500, 1, 4).withColumnRenamed("id", "key")
    df = retention(up, down, ["key"], "segment")
    kept = sum(r.kept_rows for r in df.collect())
    assert kept == sum(1 for i in range(n) if (7 if i % 3 == 0 else i % 1000) < 500)
    assert any("skew=true" in j for j in final_joins(df))
