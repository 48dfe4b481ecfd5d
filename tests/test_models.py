"""Every table over the hand-made feeds, with outputs worked out by hand."""

import re
from datetime import datetime
from hashlib import md5

import pytest


def sk(text):
    return md5(text.encode()).hexdigest()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_staging_keeps_every_row(tables, feeds):
    from tallyline.plans import STAGING

    for name, spec in STAGING.items():
        assert tables[name].count() == feeds[spec.feed].count(), name


def test_staged_orders(tables):
    rows = by(tables["stg_olist_orders"], "order_id")
    assert rows["o1"].order_purchase_timestamp == datetime(2018, 1, 1, 10)
    assert rows["o2"].order_approved_at is None  # empty
    assert rows["o2"].order_estimated_delivery_date == datetime(2018, 2, 15)  # bare date
    assert rows["o3"].order_approved_at is None  # a year only
    assert rows["o3"].order_delivered_carrier_date is None  # no such day
    assert rows["o4"].order_approved_at is None  # day first


def test_staged_products(tables):
    rows = by(tables["stg_olist_products"], "product_id")
    assert rows["p1"][2:5] == (4, 3, 1000)
    assert rows["p2"][2:] == (None, None, None, 200.5, None, None, None)
    assert tables["stg_olist_products"].columns[2:4] == [
        "product_name_length",
        "product_description_length",
    ]


def test_dimensions(tables):
    customer = by(tables["dim_customers"], "customer_id")["c1"]
    assert customer.customer_sk == sk("c1")
    assert (customer.zip_code_prefix, customer.city, customer.state) == ("01037", "sao paulo", "SP")
    assert by(tables["dim_sellers"], "seller_id")["s3"].seller_sk == sk("s3")
    products = by(tables["dim_products"], "product_id")
    assert {k: r.product_category_english for k, r in products.items()} == {
        "p1": "furniture",
        "p2": "livros",
        "p3": "unknown",
        "p4": "furniture",
    }


def test_locations_take_maxima_independently(tables):
    rows = by(tables["dim_locations"], "zip_code_prefix")
    assert tuple(rows["01037"]) == ("01037", "sao paulo", "SP", -24.0, -47.0)
    assert len(rows) == 2


def test_order_items(tables):
    rows = by(tables["fct_order_items"], "order_id", "order_item_id")
    assert set(rows) == {
        ("o1", 1), ("o1", 2), ("o3", 1), ("o4", 1), ("o5", 4), ("o5", None),
    }
    late = rows["o1", 1]
    assert late.order_item_sk == sk("o1-1")
    assert (late.customer_sk, late.product_sk, late.seller_sk) == (sk("c1"), sk("p1"), sk("s1"))
    assert late.total_item_cost_usd == 12.0
    assert late.is_delivery_delayed is True
    assert late.delivery_delay_days == 5
    assert late.actual_delivery_duration_days == 19
    assert late.estimated_delivery_duration_days == 14
    on_time = rows["o3", 1]
    assert on_time.is_delivery_delayed is False  # on the estimate is not late
    assert on_time.actual_delivery_duration_days == 2  # two midnights, 26 hours
    undelivered = rows["o4", 1]
    assert undelivered.is_delivery_delayed is False
    assert undelivered.actual_delivery_duration_days is None
    assert rows["o5", None].order_item_sk is None
    assert rows["o5", 4].total_item_cost_usd is None


def test_order_payments(tables):
    rows = by(tables["fct_order_payments"], "order_id", "payment_sequential")
    assert set(rows) == {("o1", 1), ("o1", 2), ("o3", 1), ("o4", 1), ("o4", 2)}
    assert rows["o1", 2].payment_sk == sk("o1-2")
    assert rows["o4", 1].payment_installments == 1


def test_orders(tables):
    rows = by(tables["fct_orders"], "order_id")
    totals = {k: tuple(r)[3:7] for k, r in rows.items()}
    assert totals == {
        "o1": (2, 30.5, 3.5, 34.0),
        "o2": (0, 0.0, 0.0, 0.0),
        "o3": (1, 30.0, 3.0, 33.0),
        "o4": (1, 40.0, 4.0, 45.0),
        "o5": (1, 50.0, 5.0, 0.0),  # one of the two item numbers is unreadable
    }


def test_customer_reviews(tables):
    rows = tables["mart_customer_reviews"].collect()
    pairs = sorted((r.order_id, r.order_item_id or 0, r.review_id, r.review_score) for r in rows)
    assert pairs == [
        ("o1", 1, "r1", 1),
        ("o1", 1, "r2", 5),
        ("o1", 2, "r1", 1),
        ("o1", 2, "r2", 5),
        ("o3", 1, "r3", 0),  # an unreadable score counts as 0
        ("o5", 0, "r5", 4),
        ("o5", 4, "r5", 4),
    ]


def test_logistics_network(tables):
    rows = by(tables["mart_logistics_network"], "origin_state", "destination_state")
    assert set(rows) == {("SP", "SP"), ("MG", "RJ")}
    home = rows["SP", "SP"]
    assert home.total_orders_routed == 1
    assert home.total_delayed_orders == 2  # items, not orders
    assert home.delay_rate_pct == 200.0
    assert home.avg_freight_per_item_usd == 1.75
    away = rows["MG", "RJ"]
    assert (away.total_orders_routed, away.total_route_freight_usd) == (2, 8.0)
    assert away.avg_freight_per_item_usd == 4.0  # the missing freight is left out
    assert away.avg_delivery_duration_days == pytest.approx(10 / 3)


def test_customers(tables):
    rows = by(tables["mart_obt_customers"], "customer_id")
    busy = rows["c1"]
    assert (busy.total_orders, busy.total_items_value_usd, busy.total_payment_value_usd) == (
        2, 30.5, 34.0,
    )
    assert (busy.first_order_date, busy.last_order_date) == (
        datetime(2018, 1, 1, 10),
        datetime(2018, 2, 1, 10),
    )
    assert (busy.avg_review_score, busy.total_reviews) == (3.0, 2)
    assert (rows["c2"].avg_review_score, rows["c2"].total_reviews) == (4.0, 2)
    idle = rows["c3"]
    assert (idle.total_orders, idle.total_payment_value_usd, idle.total_reviews) == (0, 0.0, 0)
    assert idle.first_order_date is None and idle.avg_review_score is None


def test_order_lines(tables):
    rows = by(tables["mart_obt_orders"], "order_id", "order_item_id")
    # o4 has no known seller or product
    assert set(rows) == {("o1", 1), ("o1", 2), ("o3", 1), ("o5", 4), ("o5", None)}
    line = rows["o1", 1]
    assert line.review_score == 5 and line.review_creation_date == datetime(2018, 1, 25)
    assert line.order_total_payment_usd == 34.0
    assert line.product_category == "furniture"
    assert rows["o3", 1].review_score is None


def test_sellers(tables):
    rows = by(tables["mart_obt_sellers"], "seller_id")
    s1, s2, s3 = rows["s1"], rows["s2"], rows["s3"]
    assert (s1.total_orders, s1.total_items_sold, s1.total_revenue_usd) == (1, 2, 30.5)
    assert (s1.total_delayed_orders, s1.delay_rate_pct) == (2, 200.0)
    assert (s1.avg_review_score, s1.total_negative_reviews) == (3.0, 2)
    assert (s2.total_orders, s2.total_items_sold) == (2, 2)
    assert (s2.total_delayed_orders, s2.delay_rate_pct, s2.total_negative_reviews) == (0, 0.0, 0)
    assert (s3.total_orders, s3.total_revenue_usd, s3.delay_rate_pct) == (0, 0.0, 0.0)
    assert s3.total_delayed_orders is None and s3.avg_delivery_duration_days is None
    assert s3.total_negative_reviews == 0


def test_payment_profiles(tables):
    rows = by(tables["mart_payment_profiles"], "payment_type", "payment_installments")
    assert {k: tuple(r)[2:] for k, r in rows.items()} == {
        ("credit_card", 2): (2, 2, 63.0, 31.5, 0),
        ("voucher", 1): (1, 1, 4.0, 4.0, 0),
        ("credit_card", 1): (2, 1, 45.0, 22.5, 2),  # payments, not orders
    }


def test_product_performance_counts_an_item_per_review(tables):
    rows = by(tables["mart_product_performance"], "product_id")
    assert set(rows) == {"p1", "p2", "p3"}  # p4 never sold
    p1 = rows["p1"]
    # o1 twice (two reviews), o3 once
    assert (p1.total_units_sold, p1.total_revenue_usd) == (3, 51.0)
    assert (p1.avg_product_review_score, p1.total_negative_reviews) == (3.0, 1)
    assert rows["p2"].total_revenue_usd == 40.0
    assert rows["p3"].total_units_sold == 1  # an item without a key is not counted


def test_seller_sales_count_an_item_per_review(tables):
    rows = by(tables["mart_seller_sales"], "seller_id")
    assert set(rows) == {"s1", "s2"}
    s1 = rows["s1"]
    assert (s1.total_orders, s1.total_items_sold, s1.total_revenue_usd) == (1, 4, 61.0)
    assert (s1.total_delayed_orders, s1.delay_rate_pct) == (4, 4.0)  # a fraction
    assert (s1.avg_review_score, s1.total_1_star_reviews) == (3.0, 2)
    assert rows["s2"].avg_delivery_duration_days == pytest.approx(10 / 3)
    assert rows["s2"].total_1_star_reviews == 0


def test_repeated_dimension_rows_multiply_as_a_join_would(spark, feeds):
    from tallyline.plans import Lazy

    sellers = feeds["olist_sellers"]
    twice = Lazy({**feeds, "olist_sellers": sellers.unionByName(sellers)})
    s1 = by(twice["mart_seller_sales"], "seller_id")["s1"]
    assert (s1.total_orders, s1.total_items_sold, s1.total_revenue_usd) == (1, 8, 122.0)
    assert s1.delay_rate_pct == 8.0


def test_seller_classification(spark):
    from tallyline.plans import seller_classification

    sellers = spark.createDataFrame(
        [
            ("a", "SP", 60, 100.0, 4.0, 4.8, 0),
            ("b", "SP", 60, 300.0, 30.0, 4.8, 0),
            ("c", "SP", 60, 200.0, 10.0, 2.5, 0),
            ("d", "SP", 60, 200.0, 10.0, 2.5, 0),
            ("e", "SP", 60, 50.0, 10.0, None, 0),
            ("f", "SP", 60, 40.0, 26.0, None, 0),
            ("g", "SP", 49, 900.0, 0.0, 5.0, 0),
        ],
        "seller_id string, state string, total_orders long, total_revenue_usd double,"
        " delay_rate_pct double, avg_review_score double, total_negative_reviews long",
    )
    got = [(r.seller_id, r.seller_classification.split()[0]) for r in seller_classification(sellers).collect()]
    assert got == [
        ("b", "High"), ("c", "High"), ("d", "High"), ("a", "Super"), ("e", "Standard"), ("f", "High"),
    ]
    assert len(seller_classification(sellers, top=2).collect()) == 2


def test_packed_keys_come_back(spark):
    from tallyline.functions import packed, unpacked

    digest = "0123456789abcdef" * 2
    keys = [digest, digest.upper(), digest + "\n", digest[:-1], "", "a", "ü" * 16, None]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(packed("k"))
    assert df.distinct().count() == len(keys)
    assert {r.k for r in df.select(unpacked("k")).collect()} == set(keys)


def test_packed_text_is_no_longer_than_need_be(spark):
    from pyspark.sql import functions as F

    from tallyline.functions import packed, unpacked

    mark = "\0" * 17
    sizes = {"17": 2, "x" * 16: 33, "0123456789abcdef" * 2: 16, "a" + mark: 35, mark: 34, "y" * 33: 33}
    df = spark.createDataFrame([(k,) for k in sizes], "k string")
    assert {r.k: len(r.p) for r in df.select("k", packed(F.col("k")).alias("p")).collect()} == sizes
    assert {r.k for r in df.select(packed("k")).select(unpacked("k")).collect()} == set(sizes)


def _odd_star(tables):
    """The star schema with a line, customer, seller and product key that is no digest."""
    from pyspark.sql import functions as F

    def odd(df, *keys):
        return df.withColumns({k: F.concat(F.lit("odd "), k) for k in keys})

    items = odd(tables["fct_order_items"], "order_item_sk", "customer_sk", "seller_sk", "product_sk")
    items = items.withColumn("total_item_cost_usd", F.col("total_item_cost_usd") + 1)
    return {
        "fct_order_items": items,
        "fct_orders": odd(tables["fct_orders"], "customer_sk"),
        **{n: odd(tables[n], f"{n[4:-1]}_sk") for n in ("dim_customers", "dim_sellers", "dim_products")},
    }


def test_marts_keep_keys_that_are_no_digests(tables):
    from tallyline.plans import TABLES

    odd = _odd_star(tables)
    for name, keys in (
        ("mart_obt_orders", ("order_item_sk", "customer_sk", "seller_sk", "product_sk")),
        ("mart_customer_reviews", ("customer_sk", "product_sk", "seller_sk")),
    ):
        usual = tables[name].collect()
        got = TABLES[name].build(*[odd.get(p) or tables[p] for p in TABLES[name].parents]).collect()
        want = [{**r.asDict(), **{k: r[k] and f"odd {r[k]}" for k in keys}} for r in usual]
        if name == "mart_obt_orders":
            cost = "total_item_cost_usd"
            want = [{**r, cost: r[cost] and r[cost] + 1} for r in want]
        assert sorted((r.asDict() for r in got), key=repr) == sorted(want, key=repr) and want, name


def test_item_rows_are_shuffled_without_hex_keys(tables, settings):
    settings("spark.sql.autoBroadcastJoinThreshold", "-1")

    def shuffled(name):
        text = tables[name]._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        return text, [lines[i + 1] for i, line in enumerate(lines) if "Exchange hash" in line]

    _, rows = shuffled("mart_obt_orders")
    whole = re.compile(r"(\[|, )(order_item_sk|total_item_cost_usd)#\d+(,|\])")
    assert rows and not any(whole.search(r) for r in rows)
    text, _ = shuffled("mart_customer_reviews")
    assert text.count("unhex(") >= 4  # three keys of an item, one of a customer
