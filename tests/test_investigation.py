"""Files in FROM, ways upstream, sets of segments, stored profiles, schema versions, shared checks."""

import pytest
from pyspark.sql import functions as F

from tallyline import operators as ops
from tallyline.operators.explore import files_in
from tallyline.sources import USUAL_NULLS, ingest, nulls_for, read_feed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_files_in_from(spark, tmp_path):
    csv = tmp_path / "it's a `file`.csv"
    csv.write_text('id,txt\n1,"line\nbreak ""q"", x"\n2,\n')
    (tmp_path / "more.json").write_text('{"id": 1, "tags": [{"t": "a"}, {"t": "b"}]}\n{"id": 3, "tags": []}\n')
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    found = ops.explore(spark, f"SELECT id, txt FROM {ops.relation(str(csv))}")
    assert rows(found) == [(1, 'line\nbreak "q", x'), (2, None)]
    found = ops.explore(spark, f"SELECT * FROM {ops.relation(str(csv), inferSchema='false')} WHERE txt IS NULL")
    assert rows(found) == [("2", None)]
    query = f"""
        WITH m AS (SELECT id, explode_outer(tags) AS tag FROM '{tmp_path}/more.json') -- from 'x.csv'
        SELECT p.id, m.tag.t, "from 'y.csv'" AS a FROM '{tmp_path}/p.parquet' AS p LEFT join '{tmp_path}/more.json' j USING (id)
        LEFT JOIN m USING (id)"""
    text = "from 'y.csv'"
    assert rows(ops.explore(spark, query)) == [(0, None, text), (1, "a", text), (1, "b", text), (2, None, text)]
    assert files_in("SELECT 'from ''a.csv''', x FROM t") == "SELECT 'from ''a.csv''', x FROM t"
    with pytest.raises(ValueError):
        ops.relation("a.xlsx")
    with pytest.raises(Exception):
        ops.explore(spark, f"INSERT OVERWRITE DIRECTORY '{tmp_path}/out' SELECT * FROM '{csv}'")


def test_upstream(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("c", "b"), ("d", "d")]
    found = {(r.depth, r.parent, r.child, "<".join(r.path)) for r in ops.upstream(spark, "d", edges).collect()}
    assert found == {
        (1, "c", "d", "d<c"), (2, "b", "c", "d<c<b"), (2, "a", "c", "d<c<a"), (3, "a", "b", "d<c<b<a"),
    }
    assert ops.upstream(spark, "x", edges).collect() == []
    with pytest.raises(Exception):
        ops.upstream(spark, "t9", [(f"t{i}", f"t{i + 1}") for i in range(9)], most_steps=5).collect()


def test_first_loss(spark):
    def table(*keys):
        return spark.createDataFrame([(k,) for k in keys], "k int")

    tables = {"feed": table(1, 2, 3, 4), "stage": table(1, 2, 3), "fact": table(1, 2, 3), "mart": table(1, 2), "dim": table(1, 2, 9)}
    pairs = [("feed", "stage"), ("stage", "fact"), ("fact", "mart"), ("dim", "mart"), ("feed", "dim")]
    edges = [ops.Edge(p, c, (("k", "k"),)) for p, c in pairs]
    found = {(r.path, r.keys_lost, r.keys_gained, r.first_loss) for r in ops.lineage_upstream(tables, "mart", edges).collect()}
    assert found == {
        ("mart < fact", 1, 0, True),
        ("mart < fact < stage", 0, 0, False),
        ("mart < fact < stage < feed", 1, 0, False),
        ("mart < dim", 1, 0, True),
        ("mart < dim < feed", 2, 1, False),
    }
    assert {r.path for r in ops.lineage_upstream(tables, "stage", edges).collect() if r.first_loss} == {"stage < feed"}
    with pytest.raises(ValueError):
        ops.lineage_upstream(tables, "feed", edges)


def test_kpi_change_sets(spark):
    df = spark.createDataFrame(
        [("a", 1, "2024-01-01", 10.0), ("a", 1, "2024-01-03", 4.0), (None, 2, "2024-01-03", 5.0), ("a", 2, "2024-01-02", 1.0), ("b", 1, "2023-01-01", 99.0)],
        "s string, t int, day string, v double",
    ).withColumn("day", F.col("day").cast("date"))
    periods = {"current": ("2024-01-03", "2024-01-04"), "previous": ("2024-01-01", "2024-01-02")}
    got = ops.kpi_change_sets(df, "v", "day", segments=["s", "t"], **periods)
    by = {(r.grouped_by, r.s, r.t): (r.previous, r.current, r.change, r.share_of_change_pct, r.weight_pct) for r in got.collect()}
    assert by[("", None, None)] == (11.0, 9.0, -2.0, 100.0, 100.0)
    assert by[("s", "a", None)][:3] == (11.0, 4.0, -7.0) and by[("s", "a", None)][3] == 350.0
    assert by[("s", None, None)][:3] == (0.0, 5.0, 5.0)  # NULL is a value of s here
    assert by[("s,t", "a", 2)][:3] == (1.0, 0.0, -1.0)
    assert len(by) == 1 + 2 + 2 + 3
    for c in ("s", "t"):  # each column's parts add up to the total
        assert sum(v[2] for k, v in by.items() if k[0] == c) == -2.0
    with pytest.raises(ValueError):
        ops.kpi_change_sets(df, "v", "day", segments=[], **periods)


def test_merged_profile(spark, tmp_path):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 != 0, F.col("id") % 7_000).alias("v"),
        F.concat(F.lit("x"), F.col("id") % 3).alias("s"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("day"),
    )
    for part in (df.where("day < '2024-01-05'"), df.where("day >= '2024-01-05'")):  # added day by day
        ops.day_sketches(part, "day", ["v", "s"]).write.mode("append").parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 9
    exact = {r.column_name: r for r in ops.column_profile(df.select("v", "s"), distinct="exact").collect()}
    for r in ops.merged_profile(days).collect():
        e = exact[r.column_name]
        assert (r.row_count, r.null_count, r.min_value, r.max_value, r.data_type) == (e.row_count, e.null_count, e.min_value, e.max_value, e.data_type)
        assert abs(r.distinct_count - e.distinct_count) <= 4 * ops.SKETCH_ERROR * e.distinct_count
    some = {r.column_name: r for r in ops.merged_profile(days.where("_day = '2024-01-02'")).collect()}
    assert some["s"].row_count == df.where("day = '2024-01-02'").count()
    none = ops.merged_profile(days.limit(0)).collect()
    assert [(r.row_count, r.distinct_count) for r in none] == [(0, 0), (0, 0)]


def test_schema_changes(spark, tmp_path):
    def stored(name, ddl):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    versions = {
        "a": stored("a", "k int, gone string, s struct<x: int, y: string>, l array<struct<z: int>>"),
        "b": stored("b", "l array<struct<z: bigint>>, k bigint, s struct<x: int, y: string, n: date>"),
        "c": stored("c", "k bigint, l array<struct<z: bigint>>, s struct<x: int, y: string, n: date>"),
    }
    assert rows(ops.schema_changes(spark, versions)) == [
        ("b", "gone", "missing", "string", None),
        ("b", "k", "type", "int", "bigint"),
        ("b", "l[].z", "type", "int", "bigint"),
        ("b", "s.n", "added", None, "date"),
    ]
    assert ops.schema_changes(spark, {"a": versions["a"]}).collect() == []


def test_key_outcomes_agree_with_single_checks(spark):
    items = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (None, 5), (None, 5), (7, 1)], "k int, line int")
    orders = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (None, "b")], "k int, status string")
    reviews = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    tables = {"items": ops.Keyed(items, part=("line",)), "orders": ops.Keyed(orders, segment="status"), "reviews": ops.Keyed(reviews)}
    checks = [
        ops.KeyCheck("duplicates", "items", 1),
        ops.KeyCheck("duplicates", "reviews", 9),
        ops.KeyCheck("orphans", "items", 0, "orders"),
        ops.KeyCheck("many_to_many", "items", 0, "reviews"),
        ops.KeyCheck("retention", "orders", 60, "reviews"),
    ]
    got = {(r.check, r.table): (r.column, r.observed, r.failed) for r in ops.key_outcomes(tables, ["k"], checks).collect()}
    kept = {r.status: r.retained_pct for r in ops.retention(orders, reviews, ["k"], "status").collect()}
    assert got == {
        ("duplicates", "items"): ("k,line", float(ops.duplicates(items, ["k", "line"]).count()), True),
        ("duplicates", "reviews"): ("k", float(ops.duplicates(reviews, ["k"]).count()), False),
        ("orphans", "items"): ("k", ops.orphans(items, orders, ["k"]).first().orphan_rate, True),
        ("many_to_many", "items"): ("k", float(ops.join_cardinality(items, reviews, ["k"]).first().many_to_many_keys), True),
        ("retention", "orders"): ("k", 100 - min(kept.values()), True),
    }
    with pytest.raises(ValueError):
        ops.key_outcomes(tables, ["k"], [ops.KeyCheck("other", "items", 0)])


def test_row_outcomes_agree_with_null_drift(spark):
    days = spark.range(200).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day"),
        F.when(F.col("id") % 20 != 12, F.col("id")).alias("v"),
    )
    days = days.unionAll(spark.createDataFrame([(None, None), (None, 5)], days.schema))
    flags = {"odd": F.col("v") % 2 == 1, "all": F.lit(True)}
    got = ops.row_outcomes(
        days, "t", F.col("day"), flags, {"share": ("odd", "all", "v", 0.4)}, {"total": ("odd", "v", 999)}, {"v": F.col("v").isNull()}
    )
    drifted = ops.null_drift(days, ["v"], "day").where("drifted").count()
    odd = days.where("v % 2 = 1").count()
    assert {(r.check, r.observed, r.failed) for r in got.collect()} == {
        ("null_drift", float(drifted), drifted > 0), ("share", odd / 202, odd / 202 > 0.4), ("total", float(odd), False),
    }
    assert drifted == 1


def test_null_spellings(spark, tmp_path):
    header = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    (tmp_path / "s.csv").write_text(header + 's1,NA,"n/a",none\ns2, NA,Na,NULL\nnull,01037,-,SP\n')
    feeds, out = {"olist_sellers": str(tmp_path / "s.csv")}, str(tmp_path / "out")
    ingest(spark, feeds, out)
    assert ("s1", "NA", "n/a", "none") in rows(read_feed(spark, out, "olist_sellers"))
    ingest(spark, feeds, out, {"olist_sellers": {"*": USUAL_NULLS, "seller_city": ["-", "Na"]}})
    assert rows(read_feed(spark, out, "olist_sellers")) == sorted(
        [("s1", None, None, "none"), ("s2", " NA", None, None), (None, "01037", None, "SP")], key=repr
    )
    with pytest.raises(KeyError):
        ingest(spark, feeds, out, {"olist_sellers": {"no_such": ["x"]}})
    with pytest.raises(KeyError):
        ingest(spark, feeds, out, {"no_such": {}})
    numbers = spark.createDataFrame([(1.0, "x")], "NaN double, t string")
    assert rows(nulls_for(numbers, {"*": ["x", "1.0"]})) == [(1.0, None)]
    assert nulls_for(numbers.limit(0), {"t": ["x"]}).collect() == []


def test_catalog_inventory(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS inv_a")
    spark.sql("CREATE DATABASE IF NOT EXISTS inv_none")
    spark.sql("CREATE OR REPLACE VIEW inv_a.v AS SELECT 1 AS x, 2 AS y")
    spark.sql("DROP TABLE IF EXISTS inv_a.t")
    spark.range(5).write.saveAsTable("inv_a.t")
    spark.range(1).createOrReplaceTempView("passing")
    found = ops.catalog_inventory(spark, {"first": "inv_a", "second": "inv_none"})
    assert rows(found) == [("first", "t", "table", 5, 1), ("first", "v", "view", 1, 2)]
    assert ops.catalog_inventory(spark, {"second": "inv_none"}).collect() == []
