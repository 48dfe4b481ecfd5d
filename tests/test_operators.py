"""Each check finds a planted defect and leaves the rest alone."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyline import operators as ops


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def daily(spark):
    """Twenty days of two segments, ten rows a day; day 15 of 'b' has a hundred,
    day 12 of 'a' is missing, and NULLs appear on day 18."""
    start = datetime(2024, 1, 1, 12)
    data = []
    for d in range(20):
        for segment in "ab":
            if (segment, d) == ("a", 12):
                continue
            n = 100 if (segment, d) == ("b", 15) else 10 + d % 2
            data += [
                (start + timedelta(days=d), segment, None if d == 18 and i < 8 else 1.0)
                for i in range(n)
            ]
    return spark.createDataFrame(data, "ts timestamp_ntz, segment string, value double")


# --- history -----------------------------------------------------------------------


def test_metric_history(spark, daily):
    got = ops.metric_history(daily, "value", "ts", as_of="2024-01-20", days=3).collect()
    assert [r.metric_date for r in got] == [date(2024, 1, d) for d in (17, 18, 19, 20)]
    assert (got[0].row_count, got[0].metric_value, got[0].metric_average) == (20, 20.0, 1.0)
    assert (got[2].row_count, got[2].metric_value) == (20, 4.0)


def test_metric_history_by_raw_value(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(at, 1), (at, 3), (at + timedelta(hours=1), 5), (None, 9)], "t timestamp_ntz, v int"
    )
    got = ops.metric_history(df, "v", "t", as_of="2024-01-01", days=1, grain=None).collect()
    assert [tuple(r)[1:] for r in got] == [(2, 4, 2.0, 1, 3), (1, 5, 5.0, 5, 5)]
    monthly = ops.metric_history(df, "v", "t", as_of="2024-01-01", days=1, grain="month")
    assert [r.row_count for r in monthly.collect()] == [3]


def test_metric_history_defaults_to_today(spark):
    df = spark.sql("SELECT current_date() AS d, 1 AS v UNION ALL SELECT date'2000-01-01', 2")
    assert [r.metric_value for r in ops.metric_history(df, "v", "d").collect()] == [1]


@pytest.mark.parametrize(
    "arguments",
    [
        {"days": 0},
        {"days": 366},
        {"metric": "value; drop"},
        {"date_col": ""},
    ],
)
def test_metric_history_rejects(daily, arguments):
    with pytest.raises(ValueError):
        ops.metric_history(daily, **{"metric": "value", "date_col": "ts", **arguments})


def test_table_metric_history(spark, daily):
    daily.createOrReplaceTempView("daily_values")
    got = ops.table_metric_history(spark, "daily_values", "value", "ts", days=1, as_of="2024-01-20")
    assert got.count() == 2
    with pytest.raises(ValueError):
        ops.table_metric_history(spark, "daily_values v", "value", "ts")


# --- exploration -----------------------------------------------------------------


def test_explore_caps_and_keeps_order(spark):
    got = ops.explore(spark, "SELECT id FROM range(1000) ORDER BY id DESC;").collect()
    assert [r.id for r in got] == list(range(999, 899, -1))


@pytest.mark.parametrize(
    "query",
    [
        "DROP TABLE t",
        "drop\ntable t",
        "CREATE TABLE t AS SELECT 1",
        "INSERT INTO t VALUES (1)",
        "SELECT 1; DROP TABLE t",
        "SET spark.sql.ansi.enabled = false",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "SELECT java_method('java.lang.System', 'nanoTime')",
        "SELECT `reflect` /* so */ ('java.lang.System', 'nanoTime')",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')",
        "",
    ],
)
def test_explore_only_reads(spark, query):
    with pytest.raises(Exception):
        ops.explore(spark, query)
    assert ops.answer(spark, query).status == "error"


def test_explore_allows_harmless_words(spark):
    got = ops.answer(spark, "SELECT 'please update and drop this' AS note -- delete nothing")
    assert got.status == "ok" and got.rows[0].note.startswith("please")


def test_explore_lists(spark):
    spark.range(1).createOrReplaceTempView("listed")
    assert "listed" in [r.tableName for r in ops.explore(spark, "SHOW TABLES").collect()]
    assert ops.explore(spark, "DESCRIBE listed").first().col_name == "id"


def test_answer_reports_no_rows(spark):
    assert ops.answer(spark, "SELECT 1 WHERE false").status == "empty"
    assert ops.answer(spark, "SELECT nothing").status == "error"


# --- profile ---------------------------------------------------------------------


@pytest.mark.parametrize("distinct", ["approx", "exact"])
def test_column_profile(spark, distinct):
    df = spark.createDataFrame(
        [(1, "a"), (2, None), (2, "b"), (None, "b")], "`odd name` int, s string"
    )
    got = ops.column_profile(df, distinct).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [
        (1, "odd name", "int", True, 4, 1, 25.0, 2, "1", "2"),
        (2, "s", "string", True, 4, 1, 25.0, 2, "a", "b"),
    ]


def test_column_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "a int")
    got = ops.column_profile(empty, "exact").first()
    assert (got.row_count, got.null_pct, got.distinct_count) == (0, None, 0)
    assert "distinct_count" not in ops.column_profile(empty, None).columns


def test_schema_diff(spark):
    was = spark.createDataFrame([], "a int, b string, c double")
    now = spark.createDataFrame([], "a bigint, c double, d date")
    assert ops.schema_diff(was, now) == [
        ("a", "type", "int", "bigint"),
        ("b", "missing", "string", None),
        ("d", "added", None, "date"),
    ]


def test_table_inventory(tables):
    from tallyline.plans import TABLES

    picked = {n: tables[n] for n in ("stg_olist_orders", "fct_orders", "mart_seller_sales")}
    got = ops.table_inventory(picked, {n: TABLES[n].layer for n in picked})
    assert rows(got) == [
        ("intermediate", "fct_orders", "table", 5, 14),
        ("marts", "mart_seller_sales", "table", 2, 13),
        ("staging", "stg_olist_orders", "view", 5, 8),
    ]


# --- keys and joins --------------------------------------------------------------


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5), (None, 6)], "k string, v int"
    )
    right = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("d",), (None,)], "k string")
    return left, right


def test_duplicates(sides):
    assert rows(ops.duplicates(sides[0], ["k"])) == [("a", 2), (None, 2)]


def test_orphans(sides):
    left, right = sides
    assert rows(ops.orphans(left, right, ["k"])) == [(6, 2, 1, 1, 1 / 6)]
    assert rows(ops.orphan_keys(left, right, ["k"])) == [("c", 1)]


def test_orphans_of_nothing(sides):
    left, right = sides
    assert rows(ops.orphans(left.limit(0), right, ["k"])) == [(0, 0, 0, 0, None)]


def test_join_cardinality_equals_the_join(sides):
    left, right = sides
    got = ops.join_cardinality(left, right, ["k"]).first()
    assert (got.left_rows, got.right_rows, got.left_keys, got.right_keys) == (6, 6, 3, 3)
    assert (got.matched_keys, got.many_to_many_keys) == (2, 1)
    assert got.inner_join_rows == left.join(right, "k").count() == 7
    assert got.left_join_rows == left.join(right, "k", "left").count() == 10
    assert got.fan_out == pytest.approx(7 / 3)


def test_join_cardinality_beyond_64_bits(spark):
    from tallyline.operators.keys import cardinality

    n = 4_000_000_000
    counts = spark.createDataFrame([("x", n, n), ("y", 3, 0), (None, 2, n)], "k string, _l long, _r long")
    found = cardinality(counts, ["k"]).first()
    assert (found.left_rows, found.right_rows, found.matched_keys) == (n + 5, 2 * n, 1)
    assert int(found.inner_join_rows) == n * n and int(found.left_join_rows) == n * n + 5
    assert found.fan_out == n


def test_retention(spark):
    up = spark.createDataFrame(
        [(1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, None)], "id int, s string"
    )
    down = spark.createDataFrame([(2,), (2,), (4,)], "id int")
    assert rows(ops.retention(up, down, ["id"], "s")) == [
        ("x", 2, 1, 1, 50.0),
        ("y", 2, 1, 1, 50.0),
        (None, 1, 1, 0, 100.0),
    ]


def test_reconcile_measure(spark):
    fact = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", None), (None, 4.0)], "k string, v double"
    )
    mart = spark.createDataFrame(
        [("a", 3.0), ("b", 6.0), ("c", None), ("d", 1.0), (None, 4.0)], "k string, total double"
    )
    checked = ops.reconcile_measure(fact, mart, ["k"], {"total": "v"}, tolerance=0.5)
    assert {r.k: r.status for r in checked.collect()} == {
        "a": "ok",
        "b": "mismatch",
        "c": "ok",
        "d": "not_in_fact",
        None: "ok",
    }
    failures = ops.reconcile_measure(fact, mart, ["k"], {"total": "v"}, 1.0, only_failures=True)
    assert rows(failures) == [("d", "total", None, 1.0, None, "not_in_fact")]
    gone = ops.reconcile_measure(fact, mart.filter("k = 'a'"), ["k"], {"total": "v"})
    assert {r.k for r in gone.collect() if r.status == "missing_in_mart"} == {"b", "c", None}


def test_reconcile_finds_the_fan_out(tables):
    checked = ops.reconcile_measure(
        tables["fct_order_items"],
        tables["mart_seller_sales"],
        ["seller_sk"],
        {"total_revenue_usd": "item_price_usd"},
    ).join(tables["dim_sellers"].select("seller_sk", "seller_id"), "seller_sk")
    assert {r.seller_id: r.status for r in checked.collect()} == {"s1": "mismatch", "s2": "ok"}


def test_domain_violations(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 5), ("z", 9), (None, None)], "s string, n int")
    assert rows(ops.domain_violations(df, "s", allowed=["y", "z"])) == [("x", 2)]
    assert rows(ops.domain_violations(df, "n", minimum=2, maximum=8)) == [(1, 2), (9, 1)]
    got = ops.domain_violations(df, "s", allowed=["x", "y", "z"], nullable=False)
    assert rows(got) == [(None, 1)]


def test_cast_loss(feeds):
    got = ops.cast_loss(
        feeds["olist_orders"],
        {"order_approved_at": "timestamp", "order_id": "int", "order_purchase_timestamp": "timestamp"},
    )
    assert rows(got) == [
        ("order_approved_at", "timestamp", 5, 3, 0.6),
        ("order_id", "int", 5, 5, 1.0),
        ("order_purchase_timestamp", "timestamp", 5, 0, 0.0),
    ]


# --- trends ----------------------------------------------------------------------


def test_null_drift(daily):
    drifted = ops.null_drift(daily, ["value", "segment"], "ts", n=5).filter("drifted")
    assert [(r.column, r.day) for r in drifted.collect()] == [("value", date(2024, 1, 19))]


def test_calendar_gaps(daily):
    assert rows(ops.calendar_gaps(daily, "ts")) == []
    assert rows(ops.calendar_gaps(daily, "ts", "segment")) == [("a", date(2024, 1, 13))]
    around = ops.calendar_gaps(daily, "ts", start="2023-12-30", end="2024-01-22")
    assert [d.day for (d,) in rows(around)] == [30, 31, 21, 22]


def test_calendar_gaps_without_rows(daily):
    none = daily.limit(0)
    assert rows(ops.calendar_gaps(none, "ts")) == []
    assert len(rows(ops.calendar_gaps(none, "ts", start="2024-01-01", end="2024-01-03"))) == 3


def test_calendar_gaps_within_bounds(spark):
    days = [("a", "2024-01-02"), ("a", "2024-01-05"), ("b", "9999-01-01"), (None, "2024-01-03")]
    df = spark.createDataFrame(days, "s string, d string").selectExpr("s", "cast(d as date) as d")
    got = rows(ops.calendar_gaps(df, "d", "s", start="2024-01-01", end="2024-01-04"))
    want = {"a": (1, 3, 4), "b": (1, 2, 3, 4), None: (1, 2, 4)}
    assert got == sorted(((s, date(2024, 1, d)) for s, ds in want.items() for d in ds), key=repr)
    assert len(rows(ops.calendar_gaps(df, "d", end="2024-01-06"))) == 2


def test_volume_anomalies(daily):
    got = ops.volume_anomalies(daily, "ts", "segment").filter("anomalous").collect()
    assert {(r.segment, r.day, r.row_count) for r in got} == {
        ("a", date(2024, 1, 13), 0),
        ("b", date(2024, 1, 16), 100),
    }


def test_volume_anomalies_after_steady_days(spark):
    """A steady feed that jumps, one that stops, and days counted by the calendar."""
    start = datetime(2024, 1, 1)
    data = [(start + timedelta(days=d), "jumps") for d in range(10) for _ in range(500 if d == 9 else 5)]
    data += [(start + timedelta(days=d), "stops") for d in range(8) for _ in range(5)]
    data += [(start, "once"), (None, "once")]
    df = spark.createDataFrame(data, "t timestamp_ntz, s string")
    got = ops.volume_anomalies(df, "t", "s", z=2.0)
    assert rows(got.filter("anomalous").select("s", "day", "row_count")) == [
        ("jumps", date(2024, 1, 10), 500),
        ("stops", date(2024, 1, 10), 0),
        ("stops", date(2024, 1, 9), 0),
    ]
    assert got.filter("s = 'once'").count() == 10 and got.filter("day IS NULL").count() == 0


def test_kpi_change(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [
            (at, "x", 100.0),
            (at + timedelta(days=7, hours=23), "x", 40.0),
            (at + timedelta(days=7), "y", 30.0),
            (at + timedelta(days=3), "z", 99.0),
        ],
        "t timestamp_ntz, s string, v double",
    )
    got = ops.kpi_change(
        df, "v", "t", ("2024-01-08", "2024-01-08"), ("2024-01-01", "2024-01-01"), "s"
    )
    assert rows(got) == [
        ("x", 100.0, 40.0, -60.0, -60.0, 200.0),
        ("y", 0.0, 30.0, 30.0, None, -100.0),
    ]


# --- lineage and report ----------------------------------------------------------


def test_neighbours(spark):
    assert rows(ops.neighbours(spark, "fct_orders")) == [
        ("downstream", "mart_obt_customers"),
        ("downstream", "mart_obt_orders"),
        ("downstream", "mart_payment_profiles"),
        ("upstream", "stg_olist_order_items"),
        ("upstream", "stg_olist_order_payments"),
        ("upstream", "stg_olist_orders"),
    ]
    assert rows(ops.neighbours(spark, "stg_olist_orders"))[-1] == ("upstream", "olist_orders")


def test_reconcile_lineage(tables):
    got = {
        (r.parent, r.child): r
        for r in ops.reconcile_lineage(tables, around="fct_order_items").collect()
    }
    kept = got["stg_olist_order_items", "fct_order_items"]
    assert (kept.parent_rows, kept.child_rows, kept.keys_lost, kept.keys_gained) == (7, 6, 1, 0)
    assert kept.measure_drift == -99.0  # the price of the item without an order
    orders = got["stg_olist_orders", "fct_order_items"]
    assert (orders.keys_lost, orders.measure_drift) == (1, None)
    sales = got["fct_order_items", "mart_seller_sales"]
    assert (sales.keys_lost, sales.measure_drift) == (1, 30.5 - 40.0)
    assert ("stg_olist_sellers", "dim_sellers") not in got


def test_every_edge_of_the_pipeline_is_reconciled(tables):
    from tallyline.plans import edges

    known = set(edges())
    assert known == {(e.parent, e.child) for e in (*ops.MODEL_EDGES, *ops.FEED_EDGES)}
    for e in (*ops.MODEL_EDGES, *ops.FEED_EDGES):
        for p, c in e.keys:
            assert p in tables[e.parent].columns and c in tables[e.child].columns


def test_quality_report(sides):
    left, right = sides
    report = ops.quality_report(
        [
            ops.outcome(
                ops.duplicates(left, ["k"]), "duplicates", "left", "k", F.count(F.lit(1)), 0
            ),
            ops.outcome(
                ops.orphans(left, right, ["k"]), "orphans", "left", "k", F.max("orphan_rate"), 0.5
            ),
            ops.outcome(
                ops.duplicates(left.limit(0), ["k"]), "duplicates", "empty", "k", F.sum("n_rows"), 0
            ),
        ]
    )
    assert rows(report) == [
        ("duplicates", "empty", "k", 0.0, 0.0, False),
        ("duplicates", "left", "k", 2.0, 0.0, True),
        ("orphans", "left", "k", 1 / 6, 0.5, False),
    ]


def test_reconcile_lineage_of_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v double")
    edge = ops.Edge("a", "b", (("k", "k"),), ("v", "v"))
    assert rows(ops.reconcile_lineage({"a": none, "b": none}, [edge])) == [
        ("a", "b", 0, 0, 0, 0, 0, 0, None, None, None)
    ]
    with pytest.raises(ValueError):
        ops.reconcile_lineage({"a": none, "b": none}, [edge], around="c")


def test_reconcile_lineage_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("x", 3)], "k string, n int")
    b = spark.createDataFrame([(None,), ("y",)], "k string")
    got = ops.reconcile_lineage({"a": a, "b": b}, [ops.Edge("a", "b", (("k", "k"),))]).first()
    assert tuple(got)[2:8] == (3, 2, 2, 2, 1, 1)


def test_reconcile_lineage_without_keys_compares_totals(spark):
    a = spark.createDataFrame([(1.0,), (2.5,)], "v double")
    b = spark.createDataFrame([(3.0,)], "w double")
    got = ops.reconcile_lineage({"a": a, "b": b}, [ops.Edge("a", "b", (), ("v", "w"))]).first()
    assert tuple(got)[2:] == (2, 1, 1, 1, 0, 0, 3.5, 3.0, -0.5)


def test_domain_violations_with_an_allowed_list(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    assert rows(ops.domain_violations(df, "s", allowed=["a"])) == [("b", 2)]
    assert len(rows(ops.domain_violations(df, "s", allowed=["a"], nullable=False))) == 2


def test_reconcile_lineage_emits_a_row_once_for_its_edges(spark):
    """Three edges on one key: a row of ``a`` is counted once for it, not once per edge."""
    digest = "0123456789abcdef" * 2
    a = spark.createDataFrame([(digest, 1.0), (digest.upper(), 2.0), (None, 4.0), ("x", 8.0)], "k string, v double")
    b = a.where("k != 'x'")
    edges = [ops.Edge("a", n, (("k", "k"),), m) for n, m in (("b", ("v", "v")), ("c", None), ("d", ("v", "v")))]
    got = ops.reconcile_lineage({"a": a, "b": b, "c": a, "d": a.limit(0)}, edges)
    plan = got._jdf.queryExecution().analyzed().toString()
    generated = [line for line in plan.splitlines() if "Generate inline" in line and "domain" in line]
    assert sum(line.count("struct(domain") for line in generated) == 4
    rows = {r.child: (r.parent_rows, r.child_rows, r.keys_lost, r.keys_gained, r.parent_measure, r.child_measure) for r in got.collect()}
    assert rows == {
        "b": (4, 2, 2, 0, 15.0, 3.0),
        "c": (4, 4, 0, 0, None, None),
        "d": (4, 0, 4, 0, 15.0, None),
    }


def test_reconcile_lineage_keeps_bits_of_a_key(spark, monkeypatch):
    """What goes through the shuffle with a key are bits for its sides, in as many words as
    they need; rows and measures are totalled by table."""
    from tallyline.operators import lineage

    monkeypatch.setattr(lineage, "_BITS", 2, raising=False)
    keys = ["a", "b", None, "x" * 16, "x" * 16 + "\0" * 17]
    whole = spark.createDataFrame([(k, 1.5) for k in keys * 2], "k string, v double")
    tables = {f"t{i}": whole.where(f"k IS NULL OR length(k) > {i}") for i in range(5)}
    edges = [ops.Edge(f"t{i}", f"t{i + 1}", (("k", "k"),), ("v", "v")) for i in range(4)]
    got = ops.reconcile_lineage(tables, edges)
    text = got._jdf.queryExecution().executedPlan().toString()
    (by_key,) = {x for x in re.findall(r"keys=\[domain#\d+, k0#\d+\], functions=\[(.*?)\]", text) if "partial" in x}
    assert by_key.count("bit_or(") == 3 and "sum(" not in by_key and "count(" not in by_key
    found = {r.parent: tuple(r)[2:] for r in got.collect()}
    assert found["t0"] == (10, 6, 5, 3, 2, 0, 15.0, 9.0, -6.0)
    assert all(found[f"t{i}"] == (6, 6, 3, 3, 0, 0, 9.0, 9.0, 0.0) for i in (1, 2, 3))
