import pytest

from tallyline import session


def test_tasks_follow_the_input(spark, settings, monkeypatch):
    for key in (
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        "spark.sql.files.maxPartitionBytes",
    ):
        settings(key, spark.conf.get(key, "8"))
    monkeypatch.setattr(session, "input_bytes", lambda spark, path: 100 << 40)
    session.tune(spark, "anything")
    assert (
        spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "32000"
    )
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == (100 << 40) // 100_000
    monkeypatch.setattr(session, "input_bytes", lambda spark, path: 1 << 20)
    session.tune(spark, "anything")
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "8"


@pytest.mark.parametrize("text, want", [("128MB", 1 << 27), ("134217728b", 1 << 27), ("7", 7), ("1g", 1 << 30)])
def test_sizes(text, want):
    assert session._size(text) == want


def test_input_bytes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    assert session.input_bytes(spark, str(tmp_path)) == 5
    assert session.input_bytes(spark, str(tmp_path / "none")) == 0


def test_scratch_dir_is_the_sessions(spark):
    assert session.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_reducer_gets_a_bounded_part_of_the_input(spark, settings, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    settings(key, spark.conf.get(key, "8"))
    monkeypatch.setattr(session, "input_bytes", lambda spark, path: 6 << 30)
    session.tune(spark, "anything")
    assert int(spark.conf.get(key)) >= 6 * 64


def test_sellers_by_the_hundred_thousand_are_broadcast(spark, settings, tmp_path):
    """Their estimate is over Spark's 10 MB and under ours; a session's own limit stays."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    settings(key, "10485760b")
    session.tune(spark)
    ids = spark.range(100_000).selectExpr("md5(cast(id AS string)) AS seller_id")
    ids.write.parquet(f"{tmp_path}/sellers")
    spark.range(3_000_000).selectExpr(
        "md5(md5(cast(id % 100000 AS string))) AS seller_sk", "md5(cast(-id AS string)) AS item_sk"
    ).write.parquet(f"{tmp_path}/items")
    sellers = spark.read.parquet(f"{tmp_path}/sellers").selectExpr(
        "seller_id", "md5(seller_id) AS seller_sk"
    )
    estimate = int(str(sellers._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert 10 << 20 < estimate < 32 << 20, estimate
    joined = spark.read.parquet(f"{tmp_path}/items").join(sellers, "seller_sk")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan
    for own in ("-1", "5MB"):
        settings(key, own)
        session.tune(spark)
        assert spark.conf.get(key) == own
