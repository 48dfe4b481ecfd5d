"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, StringType

from tallyline import operators as ops
from tallyline.functions import as_double, as_int, as_timestamp, cast_expr
from tallyline.plans import (
    LAYER_DATABASES,
    PUBLISHED,
    TABLES,
    Lazy,
    build,
    customers_per_state,
    seller_classification,
)
from tallyline.session import scratch_dir, tune
from tallyline.sources import FEEDS, USUAL_NULLS, export_csv, feed_path, ingest, read_feed

from .standins import feeds, table

Query = Callable[[SparkSession, str], DataFrame]

# The last day of the events table; its history is in the past.
AS_OF = "2024-01-31"
PERIODS = {"current": ("2024-01-16", "2024-01-30"), "previous": ("2024-01-01", "2024-01-15")}

# registered name -> table
MODELS = {
    "stg_orders": "stg_olist_orders",
    "stg_order_items": "stg_olist_order_items",
    "stg_reviews": "stg_olist_order_reviews",
    "stg_products": "stg_olist_products",
    "stg_payments": "stg_olist_order_payments",
    "stg_customers": "stg_olist_customers",
    "stg_sellers": "stg_olist_sellers",
    "stg_geolocation": "stg_olist_geolocation",
    "stg_translation": "stg_olist_category_translation",
    "dim_customers": "dim_customers",
    "dim_sellers": "dim_sellers",
    "dim_products": "dim_products",
    "dim_locations": "dim_locations",
    "fct_order_items": "fct_order_items",
    "fct_order_payments": "fct_order_payments",
    "fct_orders": "fct_orders",
    "customer_reviews": "mart_customer_reviews",
    "logistics_network": "mart_logistics_network",
    "obt_customers": "mart_obt_customers",
    "obt_orders": "mart_obt_orders",
    "obt_sellers": "mart_obt_sellers",
    "payment_profiles": "mart_payment_profiles",
    "product_performance": "mart_product_performance",
    "seller_sales": "mart_seller_sales",
}


def comparable(df: DataFrame) -> DataFrame:
    """Round doubles past the data's own two decimals (engines add in different
    orders) and bring exact decimals back to integers."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, 4) + F.lit(0.0)  # no negative zero
        elif isinstance(f.dataType, DecimalType):
            c = c.cast("long")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _model(name: str) -> Query:
    return lambda spark, sf_dir: feeds(spark, sf_dir)[name]


_built: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _work_dir(spark: SparkSession, sf_dir: str) -> str:
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    return f"{scratch_dir(spark)}/tallyline/{spark.sparkContext.applicationId}/{tag}"


def _databases(sf_dir: str) -> dict[str, str]:
    """A database per layer, apart from those of other inputs."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    return {layer: f"{database}_{tag}" for layer, database in LAYER_DATABASES.items()}


def warehouse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The whole pipeline built from stored feeds, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        root = _work_dir(spark, sf_dir)
        lazy = feeds(spark, sf_dir)
        for name in FEEDS:
            lazy.feed(name).write.mode("overwrite").parquet(feed_path(f"{root}/feeds", name))
        _built[key] = build(
            spark, f"{root}/feeds", f"{root}/warehouse", databases=_databases(sf_dir)
        )
    return _built[key]


# --- reports -------------------------------------------------------------------


def seller_classes(spark, sf_dir):
    return seller_classification(feeds(spark, sf_dir)["mart_obt_sellers"])


def customers_topk(spark, sf_dir):
    tune(spark, sf_dir)
    return customers_per_state(spark, f"{sf_dir}/customer.parquet", "c_nationkey")


def explore_capped(spark, sf_dir):
    tune(spark, sf_dir)
    return ops.explore(
        spark,
        f"""
        SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order
        FROM parquet.`{sf_dir}/orders.parquet`
        GROUP BY o_custkey
        ORDER BY n_orders DESC, o_custkey
        """,
    )


def try_cast_mix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.substring("o_orderpriority", 1, 1).alias("digit"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".5")).alias("half"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 7).alias("month"),
    )
    return orders.selectExpr(
        "o_orderkey",
        f"{as_int('o_orderpriority', 'string')} AS label_int",
        f"{as_int('digit', 'string')} AS digit_int",
        f"{as_int('half', 'string')} AS half_int",
        f"{as_int('price', 'string')} AS price_int",
        f"{as_double('price', 'string')} AS price_double",
        f"{as_double('o_orderpriority', 'string')} AS label_double",
        f"{as_timestamp('day', 'string')} AS day_ts",
        f"{as_timestamp('month', 'string')} AS month_ts",
    )


# --- operators -----------------------------------------------------------------


def metric_history(spark, sf_dir):
    tune(spark, sf_dir)
    return ops.metric_history(table(spark, sf_dir, "events"), "value", "ts", as_of=AS_OF)


def metric_history_raw(spark, sf_dir):
    tune(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    return ops.metric_history(
        items, "l_extendedprice", "l_shipdate", as_of="2001-06-30", days=365, grain=None
    )


def table_inventory(spark, sf_dir):
    return ops.table_inventory(
        warehouse(spark, sf_dir), {name: TABLES[name].layer for name in PUBLISHED}
    )


def column_profile(spark, sf_dir):
    return ops.column_profile(feeds(spark, sf_dir)["stg_olist_orders"], distinct="exact")


def lineage_reconcile(spark, sf_dir):
    # Totals of whole tables are large enough for the order of addition to show.
    measures = ("parent_measure", "child_measure", "measure_drift")
    built = warehouse(spark, sf_dir)
    stored = {name: read_feed(spark, f"{_work_dir(spark, sf_dir)}/feeds", name) for name in FEEDS}
    edges = (*ops.MODEL_EDGES, *ops.FEED_EDGES)
    return ops.reconcile_lineage({**stored, **built}, edges).withColumns(
        {m: F.round(m, 2) for m in measures}
    )


def duplicates(lazy: Lazy) -> DataFrame:
    return ops.duplicates(
        lazy["stg_olist_order_items"], ["order_id", "order_item_id"]
    )


def null_drift(lazy: Lazy) -> DataFrame:
    return ops.null_drift(
        lazy["stg_olist_order_reviews"],
        ["review_score", "review_answer_timestamp"],
        "review_creation_date",
        threshold=0.02,
    )


def _over_feeds(check: Callable[[Lazy], DataFrame]) -> Query:
    return lambda spark, sf_dir: check(feeds(spark, sf_dir))


def _delivered(lazy: Lazy) -> DataFrame:
    return lazy["stg_olist_orders"].filter(F.col("order_status") == "delivered")


def orphans(lazy: Lazy) -> DataFrame:
    return ops.orphans(lazy["stg_olist_order_items"], _delivered(lazy), ["order_id"])


def orphan_keys(lazy: Lazy) -> DataFrame:
    return ops.orphan_keys(lazy["stg_olist_order_reviews"], _delivered(lazy), ["order_id"])


def join_cardinality(lazy: Lazy) -> DataFrame:
    return ops.join_cardinality(
        lazy["stg_olist_order_items"], lazy["stg_olist_order_reviews"], ["order_id"]
    )


def retention(lazy: Lazy) -> DataFrame:
    return ops.retention(
        lazy["stg_olist_orders"], lazy["stg_olist_order_reviews"], ["order_id"], "order_status"
    )


def calendar_gaps(lazy: Lazy) -> DataFrame:
    return ops.calendar_gaps(
        lazy["stg_olist_orders"], "order_purchase_timestamp", "order_status"
    )


def volume_anomalies(spark, sf_dir):
    tune(spark, sf_dir)
    return ops.volume_anomalies(table(spark, sf_dir, "events"), "ts", "event_type", z=2.0)


def reconcile_measure(lazy: Lazy) -> DataFrame:
    return ops.reconcile_measure(
        lazy["fct_order_items"],
        lazy["mart_seller_sales"],
        ["seller_sk"],
        {
            "total_revenue_usd": "item_price_usd",
            "total_freight_charged_usd": "freight_value_usd",
        },
        tolerance=0.01,
    )


def cast_loss(lazy: Lazy) -> DataFrame:
    return ops.cast_loss(
        lazy.feed("olist_order_reviews"),
        {
            "review_id": "int",
            "review_score": "int",
            "review_comment_message": "double",
            "review_creation_date": "timestamp",
            "review_comment_title": "timestamp",
        },
    )


def domain_violations(lazy: Lazy) -> DataFrame:
    return ops.domain_violations(
        lazy["stg_olist_order_reviews"],
        "review_score",
        minimum=2,
        maximum=4,
        nullable=False,
    )


def domain_allowed(lazy: Lazy) -> DataFrame:
    return ops.domain_violations(
        lazy["stg_olist_orders"], "order_status", allowed=["delivered", "shipped"]
    )


def kpi_change(spark, sf_dir):
    tune(spark, sf_dir)
    return ops.kpi_change(
        table(spark, sf_dir, "events"), "value", "ts", segment="event_type", **PERIODS
    )


def quality_report(spark, sf_dir):
    """Ten checks; those on order_id share one aggregation, those on review rows one pass."""
    lazy = feeds(spark, sf_dir)
    built = warehouse(spark, sf_dir)
    n_rows = F.count(F.lit(1))

    def flagged(column):
        return F.count(F.when(F.col(column), 1))

    items, orders, reviews = "stg_olist_order_items", "stg_olist_orders", "stg_olist_order_reviews"
    by_order = ops.key_outcomes(
        {
            items: ops.Keyed(lazy[items], part=("order_item_id",)),
            orders: ops.Keyed(lazy[orders], segment="order_status"),
            "delivered": ops.Keyed(_delivered(lazy)),
            reviews: ops.Keyed(lazy[reviews]),
        },
        ["order_id"],
        [
            ops.KeyCheck("duplicates", items, 0),
            ops.KeyCheck("orphans", items, 0.5, "delivered"),
            ops.KeyCheck("many_to_many", items, 0, reviews),
            ops.KeyCheck("retention", orders, 50, reviews),
        ],
    )
    raw = lazy.feed("olist_order_reviews")
    read = {"review_score": "int", "review_creation_date": "timestamp", "review_answer_timestamp": "timestamp"}
    both = raw.select(
        F.col("review_score").alias("given"),
        *[F.expr(cast_expr(raw, c, kind)).alias(c) for c, kind in read.items()],
    )
    score = F.col("review_score")
    by_review = ops.row_outcomes(
        both,
        reviews,
        F.col("review_creation_date"),
        flags={
            "given": F.col("given").isNotNull(),
            "lost": F.col("given").isNotNull() & score.isNull(),
            "outside": score.isNull() | (score < 2) | (score > 4),
        },
        shares={"cast_loss": ("lost", "given", "review_score", 0.05)},
        totals={"domain_violations": ("outside", "review_score", 0)},
        drift={c: F.col(c).isNull() for c in ("review_score", "review_answer_timestamp")},
        drift_by=0.02,
        drift_label="review_score",
    )
    # what the cast loses was in the feed, not in the staged table
    fed = F.when(F.col("check") == "cast_loss", "olist_order_reviews").otherwise(F.col("table"))
    return ops.quality_report(
        [
            by_order,
            by_review.withColumn("table", fed),
            ops.outcome(
                volume_anomalies(spark, sf_dir),
                "volume_anomalies",
                "events",
                "ts",
                flagged("anomalous"),
                5,
            ),
            ops.outcome(
                calendar_gaps(lazy),
                "calendar_gaps",
                orders,
                "order_purchase_timestamp",
                n_rows,
                0,
            ),
            ops.outcome(
                reconcile_measure(built).filter(F.col("status") != "ok"),
                "reconcile_measure",
                "mart_seller_sales",
                "total_revenue_usd,total_freight_charged_usd",
                n_rows,
                0,
            ),
        ]
    )


def lineage_upstream(spark, sf_dir):
    """From a mart back to the feeds: where its keys were lost."""
    built = warehouse(spark, sf_dir)
    stored = {name: read_feed(spark, f"{_work_dir(spark, sf_dir)}/feeds", name) for name in FEEDS}
    return ops.lineage_upstream({**built, **stored}, "mart_seller_sales")


def kpi_change_sets(spark, sf_dir):
    tune(spark, sf_dir)
    events = table(spark, sf_dir, "events").withColumns(
        {
            "user_group": (F.col("user_id") % 3).cast("int"),
            "half": F.when(F.hour("ts") < 12, "am").otherwise("pm"),
        }
    )
    return ops.kpi_change_sets(
        events, "value", "ts", segments=["event_type", "user_group", "half"], **PERIODS
    )


def profile_merged(spark, sf_dir):
    """A profile from stored daily sketches, and whether it is as near the exact one as
    four standard errors."""
    tune(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    columns = ["event_id", "user_id", "event_type", "value", "ts"]
    path = f"{_work_dir(spark, sf_dir)}/sketches"
    ops.day_sketches(events, "ts", columns).write.mode("overwrite").parquet(path)
    merged = ops.merged_profile(spark.read.parquet(path))
    exact = ops.column_profile(events.select(*columns), distinct="exact")
    off = F.abs(F.col("distinct_count") - F.col("distinct_exact"))
    return (
        merged.join(exact.select("column_name", F.col("distinct_count").alias("distinct_exact")), "column_name")
        .withColumn("within_error", off <= 4 * ops.SKETCH_ERROR * F.col("distinct_exact"))
        .drop("distinct_count", "distinct_error")
    )


def catalog_inventory(spark, sf_dir):
    """The tables of a build as the catalog lists them, one database per layer."""
    warehouse(spark, sf_dir)
    return ops.catalog_inventory(spark, _databases(sf_dir))


def schema_changes(spark, sf_dir):
    """Reviews as fed, as staged, and as a later version with other columns."""
    lazy = feeds(spark, sf_dir)
    staged = lazy["stg_olist_order_reviews"]
    later = staged.drop("review_comment_title").withColumns(
        {
            "review_score": F.col("review_score").cast("double"),
            "review_dates": F.struct("review_creation_date", "review_answer_timestamp"),
        }
    )
    root = f"{_work_dir(spark, sf_dir)}/versions"
    versions = {"v1": lazy.feed("olist_order_reviews"), "v2": staged, "v3": later}
    for name, df in versions.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    return ops.schema_changes(spark, {name: f"{root}/{name}" for name in versions})


# --- sources and sinks -----------------------------------------------------------


def csv_ingest_roundtrip(spark, sf_dir):
    """Reviews out to CSV, with a line break and quotes in the message, and back in
    through ingest."""
    root = _work_dir(spark, sf_dir)
    message = F.concat_ws("\n", "review_comment_message", "review_comment_title")
    (
        feeds(spark, sf_dir)
        .feed("olist_order_reviews")
        .withColumn("review_comment_message", message)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(f"{root}/csv/olist_order_reviews.csv")
    )
    ingest(
        spark,
        {"olist_order_reviews": f"{root}/csv/olist_order_reviews.csv"},
        f"{root}/ingested",
    )
    return read_feed(spark, f"{root}/ingested", "olist_order_reviews")


def adhoc_csv(spark, sf_dir):
    """A CSV file by its path in FROM, with quoted line breaks, commas and quotes."""
    root = f"{_work_dir(spark, sf_dir)}/adhoc/reviews.csv"
    text = F.concat_ws("\n", "review_comment_message", F.concat(F.lit('said "'), "review_comment_title", F.lit('", twice')))
    (
        feeds(spark, sf_dir)
        .feed("olist_order_reviews")
        .select("review_id", "order_id", "review_score", text.alias("message"), "review_creation_date")
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(root)
    )
    return ops.explore(
        spark,
        f"""
        SELECT review_score, count(*) AS n_reviews, count(DISTINCT order_id) AS n_orders,
               max(review_id) AS last_review,
               CAST(max(review_creation_date) AS timestamp_ntz) AS last_created,
               sum(length(message)) AS n_chars,
               count_if(contains(message, '\\n') AND contains(message, '", twice')) AS n_broken
        FROM '{root}'  -- not FROM 'comments.csv'
        GROUP BY review_score
        """,
    )


def adhoc_json(spark, sf_dir):
    """JSON by its path in FROM and JOIN: nested objects, and lists that are unnested."""
    root = f"{_work_dir(spark, sf_dir)}/adhoc"
    events = table(spark, sf_dir, "events")
    tune(spark, sf_dir)
    events.select(
        "event_id",
        F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 7).alias("team")).alias("user"),
        F.array(F.struct(F.col("event_type").alias("kind"), "value")).alias("marks"),
    ).write.mode("overwrite").json(f"{root}/events.json")
    teams = events.select((F.col("user_id") % 7).alias("team")).where("team != 3").distinct()
    teams.select("team", F.concat(F.lit("team "), "team").alias("name")).write.mode(
        "overwrite"
    ).json(f"{root}/teams.json")
    return ops.explore(
        spark,
        f"""
        SELECT t.name, m.kind, count(*) AS n_events, sum(m.value) AS total
        FROM {ops.relation(f"{root}/events.json", multiLine="false")} e
        LEFT JOIN '{root}/teams.json' t ON t.team = e.user.team
        LATERAL VIEW explode(e.marks) AS m
        GROUP BY t.name, m.kind
        """,
    )


def ingest_null_spellings(spark, sf_dir):
    """Reviews and orders through ingest, with texts that stand for NULL in their feeds."""
    root, lazy = _work_dir(spark, sf_dir), feeds(spark, sf_dir)
    for name in ("olist_order_reviews", "olist_orders"):
        lazy.feed(name).write.mode("overwrite").option("header", True).option("escape", '"').csv(
            f"{root}/spelled/{name}.csv"
        )
    ingest(
        spark,
        {name: f"{root}/spelled/{name}.csv" for name in ("olist_order_reviews", "olist_orders")},
        f"{root}/unspelled",
        {
            "olist_order_reviews": {"*": USUAL_NULLS, "review_comment_title": ["view"]},
            "olist_orders": {"order_status": ["shipped", "lost"]},
        },
    )
    orders = read_feed(spark, f"{root}/unspelled", "olist_orders")
    reviews = read_feed(spark, f"{root}/unspelled", "olist_order_reviews")

    def counts(df: DataFrame, name: str) -> DataFrame:
        profile = ops.column_profile(df, distinct="exact")
        return profile.select(F.lit(name).alias("feed"), "column_name", "row_count", "null_count", "distinct_count")

    return counts(orders, "olist_orders").unionByName(counts(reviews, "olist_order_reviews"))


def _contents(df: DataFrame) -> DataFrame:
    """Number of rows and a sum of their hashes; CSV has no empty texts but nulls."""
    columns = [
        F.when(F.col(f.name) != "", F.col(f.name)) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema
    ]
    marks = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(marks).alias("marks"))


def marts_export(spark, sf_dir):
    """Every mart out to CSV, in gzip, as plain text is 20 times the input; rows and
    contents found when reading each file set back."""
    root = _work_dir(spark, sf_dir)
    marts = {n: df for n, df in warehouse(spark, sf_dir).items() if TABLES[n].layer == "marts"}
    status = export_csv(spark, marts, f"{root}/export", compression="gzip")
    compared = []
    for name, mart in marts.items():
        written = (
            spark.read.schema(mart.schema)
            .option("header", True)
            .option("escape", '"')
            .option("multiLine", True)
            .csv(f"{root}/export/{name}.csv")
        )
        sides = _contents(mart).withColumn("side", F.lit("mart")).unionByName(
            _contents(written).withColumn("side", F.lit("csv"))
        )
        compared.append(
            sides.agg(
                F.max(F.when(F.col("side") == "csv", F.col("n"))).alias("csv_rows"),
                (F.count_distinct(F.struct("n", "marks")) == 1).alias("same_contents"),
            ).select(F.lit(name).alias("table"), "csv_rows", "same_contents")
        )
    return ops.profile.union_all(compared).join(status.select("table", "rows", "status"), "table")


QUERIES: dict[str, Query] = {
    **{name: _model(model) for name, model in MODELS.items()},
    "try_cast_mix": try_cast_mix,
    "seller_classification": seller_classes,
    "customers_per_state_topk": customers_topk,
    "explore_capped": explore_capped,
    "metric_history": metric_history,
    "metric_history_raw": metric_history_raw,
    "table_inventory": table_inventory,
    "column_profile": column_profile,
    "lineage_reconcile": lineage_reconcile,
    "duplicates": _over_feeds(duplicates),
    "null_drift": _over_feeds(null_drift),
    "orphans": _over_feeds(orphans),
    "orphan_keys": _over_feeds(orphan_keys),
    "join_cardinality": _over_feeds(join_cardinality),
    "retention": _over_feeds(retention),
    "calendar_gaps": _over_feeds(calendar_gaps),
    "volume_anomalies": volume_anomalies,
    "reconcile_measure": _over_feeds(reconcile_measure),
    "cast_loss": _over_feeds(cast_loss),
    "domain_violations": _over_feeds(domain_violations),
    "domain_allowed": _over_feeds(domain_allowed),
    "kpi_change": kpi_change,
    "quality_report": quality_report,
    "lineage_upstream": lineage_upstream,
    "kpi_change_sets": kpi_change_sets,
    "profile_merged": profile_merged,
    "schema_changes": schema_changes,
    "catalog_inventory": catalog_inventory,
    "adhoc_csv": adhoc_csv,
    "adhoc_json": adhoc_json,
    "ingest_null_spellings": ingest_null_spellings,
    "csv_ingest_roundtrip": csv_ingest_roundtrip,
    "marts_export": marts_export,
}


def registered() -> dict[str, Query]:
    def run(query: Query) -> Query:
        return lambda spark, sf_dir: comparable(query(spark, sf_dir))

    return {name: run(query) for name, query in QUERIES.items()}
