import pytest

from tallyline import operators as ops
from tallyline.plans import LAYER_DATABASES, PUBLISHED, TABLES, build, edges
from tallyline.sources import export_schema, feed_path


@pytest.fixture(scope="module")
def built(spark, feeds, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    for name, df in feeds.items():
        df.write.parquet(feed_path(f"{root}/feeds", name))
    tables = build(spark, f"{root}/feeds", f"{root}/out", databases=LAYER_DATABASES)
    return root, tables


def same(a, b):
    def plain(df):
        return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)

    return plain(a) == plain(b)


def test_layers():
    layers = [TABLES[n].layer for n in PUBLISHED]
    assert [layers.count(x) for x in ("staging", "intermediate", "marts")] == [9, 7, 8]


def test_work_tables_do_not_show_in_the_lineage():
    known = edges()
    assert not any("review_totals" in e for e in known)
    assert ("stg_olist_order_reviews", "mart_seller_sales") in known
    assert len(known) == len(set(known)) == 9 + 12 + 26


def test_stored_tables_equal_lazy_ones(built, tables):
    _, stored = built
    for name in PUBLISHED:
        assert same(stored[name], tables[name]), name


def test_catalog(spark, built, tables):
    for name in PUBLISHED:
        found = spark.table(f"{LAYER_DATABASES[TABLES[name].layer]}.{name}")
        assert same(found, tables[name]), name
    got = ops.answer(
        spark, "SELECT seller_id FROM marts.mart_obt_sellers WHERE total_orders > 0 ORDER BY 1"
    )
    assert [r.seller_id for r in got.rows] == ["s1", "s2"]


def test_rebuild_replaces(spark, built):
    root, tables = built
    again = build(spark, f"{root}/feeds", f"{root}/out", databases=LAYER_DATABASES, threads=1)
    assert again["fct_orders"].count() == 5
    assert spark.table("intermediate.fct_orders").count() == 5


def test_unlisted_layers_go_to_the_current_database(spark, built):
    root, _ = built
    build(spark, f"{root}/feeds", f"{root}/out2", databases={"marts": "other_marts"})
    assert spark.catalog.tableExists("default.dim_sellers")
    assert spark.catalog.tableExists("other_marts.mart_seller_sales")


def test_export_of_the_built_marts(spark, built, tmp_path):
    status = export_schema(spark, "marts", str(tmp_path)).collect()
    assert len(status) == 8 and all(r.status == "ok" for r in status)


def test_raw_file_query(spark, built):
    from tallyline.plans import customers_per_state

    root, _ = built
    got = customers_per_state(spark, feed_path(f"{root}/feeds", "olist_customers"), top=1)
    assert [tuple(r) for r in got.collect()] == [("SP", 2)]


def test_feeds_with_inferred_number_types(spark, feeds, tmp_path):
    """Feeds written elsewhere may hold numbers where ours hold text."""
    from pyspark.sql import functions as F

    from tallyline.plans import Lazy

    typed = dict(feeds)
    typed["olist_order_items"] = feeds["olist_order_items"].withColumns(
        {
            "order_item_id": F.expr("try_cast(order_item_id AS bigint)"),
            "price": F.expr("try_cast(price AS double)"),
        }
    )
    typed["olist_order_reviews"] = feeds["olist_order_reviews"].withColumn(
        "review_score", F.expr("try_cast(review_score AS double)")
    )
    got = {r.seller_id: r.total_revenue_usd for r in Lazy(typed)["mart_obt_sellers"].collect()}
    assert got == {"s1": 30.5, "s2": 80.0, "s3": 0.0}


def test_command_line(spark, feeds, tmp_path, capsys):
    from tallyline.__main__ import main
    from tallyline.sources import FEEDS

    for name, df in feeds.items():
        df.write.option("header", True).option("escape", '"').csv(
            f"{tmp_path}/csv/{FEEDS[name].csv_name}"
        )
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/warehouse"
    assert main(["ingest", "--input-dir", f"{tmp_path}/csv", "--output-dir", raw]) == 0
    assert "olist_orders: 5 rows" in capsys.readouterr().out
    assert main(["build", "--raw-dir", raw, "--warehouse-dir", out]) == 0
    assert main(["export", "--warehouse-dir", out, "--output-dir", f"{tmp_path}/out"]) == 0
    assert "mart_payment_profiles: ok 3" in capsys.readouterr().out


def test_relative_paths_reach_the_catalog(spark, built, tmp_path):
    import os

    root, _ = built
    relative = os.path.relpath(f"{tmp_path}/out")
    build(spark, os.path.relpath(f"{root}/feeds"), relative, databases={"marts": "relative_marts"})
    assert spark.table("relative_marts.mart_seller_sales").count() == 2


def test_shuffle_files_go_with_their_query(spark, built, tmp_path):
    import time

    root, _ = built
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    build(spark, f"{root}/feeds", f"{tmp_path}/out")
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def test_stored_tables_are_zstd(spark, feeds, tmp_path):
    feeds["olist_orders"].write.parquet(f"{tmp_path}/orders")
    assert list(tmp_path.glob("orders/*.zstd.parquet"))


def _writes(monkeypatch):
    """Paths written as Parquet from now on, and how many were at the same time."""
    from pyspark.sql.readwriter import DataFrameWriter

    plain, paths, now, most = DataFrameWriter.parquet, [], [], []

    def parquet(self, path, *args, **options):
        paths.append(path)
        now.append(path)
        most.append(len(now))
        try:
            return plain(self, path, *args, **options)
        finally:
            now.remove(path)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return paths, most


def test_tables_share_no_time_on_disk(spark, built, tmp_path, monkeypatch):
    """Shuffle files of two tables and work tables that nothing reads any more."""
    root, _ = built
    _, most = _writes(monkeypatch)
    build(spark, f"{root}/feeds", f"{tmp_path}/out")
    assert max(most) == 1
    assert not list(tmp_path.glob("out/work/*"))


def test_wide_tables_are_written_in_slices(spark, built, tables, tmp_path, monkeypatch):
    from tallyline.plans import pipeline

    root, _ = built
    monkeypatch.setattr(pipeline, "_BYTES_PER_SLICE", 1, raising=False)
    monkeypatch.setattr(pipeline, "_MOST_SLICES", 3, raising=False)
    paths, _ = _writes(monkeypatch)
    for threads in (1, 3):
        stored = build(spark, f"{root}/feeds", f"{tmp_path}/out", threads=threads)
        for name in PUBLISHED:
            assert same(stored[name], tables[name]), name
    for name in ("reviewed_items", "mart_customer_reviews", "mart_obt_orders"):
        assert sum(p.endswith(f"/{name}") for p in paths) == 2 * 3


def test_slices_hold_every_row_once(spark):
    from tallyline.plans.pipeline import _slice

    rows = [(k, v) for k in ("a", "b", "c", "d", None) for v in (1, 1, None)]
    df = spark.createDataFrame(rows, "k string, v int")
    slices = [_slice(df, "k", i, 3).collect() for i in range(3)]
    assert sorted([tuple(r) for s in slices for r in s], key=repr) == sorted(rows, key=repr)
    assert sum(any(r.k == "a" for r in s) for s in slices) == 1
    assert _slice(df, "other", 1, 3).count() == len(rows)


def test_a_build_joins_small_sides_by_hash(spark, built, tmp_path, monkeypatch, settings):
    """The marts and work tables, that is; the session's own settings are back afterwards."""
    from pyspark.sql.readwriter import DataFrameWriter

    root, _ = built
    merged, hashed = (
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold",
    )
    settings(merged, "1m")
    plain, seen = DataFrameWriter.parquet, {}

    def parquet(self, path, *args, **options):
        seen[path.rsplit("/", 2)[1], path.rsplit("/", 1)[1]] = spark.conf.get(merged), spark.conf.get(hashed)
        return plain(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    build(spark, f"{root}/feeds", f"{tmp_path}/out")
    assert {layer for layer, _ in seen} == {"intermediate", "work", "marts"}
    for (layer, name), found in seen.items():
        assert found == (("1m", "0b") if layer == "intermediate" else ("1048576", "4194304")), name
    assert (spark.conf.get(merged), spark.conf.get(hashed)) == ("1m", "0b")


def test_slices_stay_few(spark, built, tmp_path, monkeypatch):
    """Each reads all parents again, so that their number must not grow with the feeds."""
    from tallyline.plans import pipeline

    root, _ = built
    monkeypatch.setattr(pipeline, "_BYTES_PER_SLICE", 1)
    paths, _ = _writes(monkeypatch)
    build(spark, f"{root}/feeds", f"{tmp_path}/out")
    assert sum(p.endswith("/mart_obt_orders") for p in paths) == 2


def test_work_rows_hold_keys_packed(spark, tables):
    """An item's own key is not carried to marts that only count it, others go as bytes."""
    work = dict(tables["reviewed_items"].dtypes)
    assert (work["seller_sk"], work["product_sk"], work["has_key"]) == ("binary", "binary", "boolean")
    assert "order_item_sk" not in work
    for name in ("mart_obt_sellers", "mart_seller_sales", "mart_product_performance"):
        assert dict(tables[name].dtypes)[f"{'product' if 'product' in name else 'seller'}_sk"] == "string"
    paid = tables["mart_payment_profiles"]._jdf.queryExecution().optimizedPlan().toString()
    assert "payment_sk" not in paid.split("Join")[0]
