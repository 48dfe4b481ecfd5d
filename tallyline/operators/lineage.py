"""Following data from table to table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed
from ..plans import edges as pipeline_edges
from ..plans.staging import STAGING
from .profile import union_all


def neighbours(spark: SparkSession, table: str, edges=None) -> DataFrame:
    """Tables one step up- and downstream of ``table``."""
    known = spark.createDataFrame(list(edges or pipeline_edges()), "parent string, child string")
    up = known.filter(F.col("child") == table).select(
        F.lit("upstream").alias("direction"), F.col("parent").alias("table")
    )
    down = known.filter(F.col("parent") == table).select(
        F.lit("downstream").alias("direction"), F.col("child").alias("table")
    )
    return up.unionByName(down)


def upstream(spark: SparkSession, table: str, edges=None, most_steps: int = 50) -> DataFrame:
    """Every way from ``table`` back to its sources: (depth, parent, child, path), a row per step.

    Depth counts steps up from ``table``, whose own parents have depth 1; ``path`` lists
    the tables from ``table`` to ``parent``. A table that several ways lead to has a row
    for each of them. A way ends at a table without parents, and before one that it has
    been at already, so steps in a circle end, too. Ways of more than ``most_steps`` steps
    raise an error.
    """
    known = spark.createDataFrame(list(edges or pipeline_edges()), "parent string, child string")
    walk = """
        WITH RECURSIVE ways (depth, parent, child, path) MAX RECURSION LEVEL {limit} AS (
            SELECT 1, parent, child, array(child, parent) FROM {edges}
            WHERE child = :start AND parent != child
            UNION ALL
            SELECT depth + 1, e.parent, e.child, array_append(path, e.parent)
            FROM ways w JOIN {edges} e ON e.child = w.parent
            WHERE NOT array_contains(path, e.parent))
        SELECT depth, parent, child, path FROM ways
        """
    return spark.sql(walk, {"start": table}, edges=known.distinct(), limit=most_steps + 1)


@dataclass(frozen=True)
class Edge:
    """A step of the pipeline and how its two tables correspond.

    ``keys`` pairs a parent column with the child column of the same value; without
    any, a table with rows counts as one key;
    ``measure`` pairs columns whose totals should agree.
    """

    parent: str
    child: str
    keys: tuple[tuple[str, str], ...]
    measure: tuple[str, str] | None = None


# The steps whose key survives from parent to child.
KEYED_EDGES = (
    Edge("stg_olist_customers", "dim_customers", (("customer_id", "customer_id"),)),
    Edge("stg_olist_sellers", "dim_sellers", (("seller_id", "seller_id"),)),
    Edge("stg_olist_products", "dim_products", (("product_id", "product_id"),)),
    Edge(
        "stg_olist_geolocation",
        "dim_locations",
        (("geolocation_zip_code_prefix", "zip_code_prefix"),),
    ),
    Edge(
        "stg_olist_order_items",
        "fct_order_items",
        (("order_id", "order_id"), ("order_item_id", "order_item_id")),
        ("price", "item_price_usd"),
    ),
    Edge("stg_olist_orders", "fct_order_items", (("order_id", "order_id"),)),
    Edge(
        "stg_olist_order_payments",
        "fct_order_payments",
        (("order_id", "order_id"), ("payment_sequential", "payment_sequential")),
        ("payment_value", "payment_value_usd"),
    ),
    Edge("stg_olist_orders", "fct_order_payments", (("order_id", "order_id"),)),
    Edge("stg_olist_orders", "fct_orders", (("order_id", "order_id"),)),
    Edge(
        "stg_olist_order_items",
        "fct_orders",
        (("order_id", "order_id"),),
        ("price", "total_items_value_usd"),
    ),
    Edge(
        "stg_olist_order_payments",
        "fct_orders",
        (("order_id", "order_id"),),
        ("payment_value", "total_payment_value_usd"),
    ),
    Edge(
        "fct_order_items",
        "mart_customer_reviews",
        (("order_id", "order_id"), ("order_item_id", "order_item_id")),
        ("item_price_usd", "item_price_usd"),
    ),
    Edge("stg_olist_order_reviews", "mart_customer_reviews", (("review_id", "review_id"),)),
    Edge("dim_customers", "mart_customer_reviews", (("customer_sk", "customer_sk"),)),
    Edge("dim_sellers", "mart_logistics_network", (("state", "origin_state"),)),
    Edge("dim_customers", "mart_logistics_network", (("state", "destination_state"),)),
    Edge("dim_customers", "mart_obt_customers", (("customer_sk", "customer_sk"),)),
    Edge(
        "fct_orders",
        "mart_obt_customers",
        (("customer_sk", "customer_sk"),),
        ("total_payment_value_usd", "total_payment_value_usd"),
    ),
    Edge(
        "fct_order_items",
        "mart_obt_orders",
        (("order_item_sk", "order_item_sk"),),
        ("item_price_usd", "item_price_usd"),
    ),
    Edge("fct_orders", "mart_obt_orders", (("order_id", "order_id"),)),
    Edge("dim_customers", "mart_obt_orders", (("customer_sk", "customer_sk"),)),
    Edge("dim_sellers", "mart_obt_orders", (("seller_sk", "seller_sk"),)),
    Edge("dim_products", "mart_obt_orders", (("product_sk", "product_sk"),)),
    Edge("stg_olist_order_reviews", "mart_obt_orders", (("order_id", "order_id"),)),
    Edge("dim_sellers", "mart_obt_sellers", (("seller_sk", "seller_sk"),)),
    Edge(
        "fct_order_items",
        "mart_obt_sellers",
        (("seller_sk", "seller_sk"),),
        ("item_price_usd", "total_revenue_usd"),
    ),
    Edge(
        "fct_order_payments",
        "mart_payment_profiles",
        (
            ("payment_type", "payment_type"),
            ("payment_installments", "payment_installments"),
        ),
        ("payment_value_usd", "total_revenue_usd"),
    ),
    Edge("dim_products", "mart_product_performance", (("product_sk", "product_sk"),)),
    Edge(
        "fct_order_items",
        "mart_product_performance",
        (("product_sk", "product_sk"),),
        ("item_price_usd", "total_revenue_usd"),
    ),
    Edge("dim_sellers", "mart_seller_sales", (("seller_sk", "seller_sk"),)),
    Edge(
        "fct_order_items",
        "mart_seller_sales",
        (("seller_sk", "seller_sk"),),
        ("item_price_usd", "total_revenue_usd"),
    ),
)


# The steps between models after which no column identifies a row any more: only rows and
# totals can be compared.
TOTALLED_EDGES = (
    Edge(
        "fct_order_items",
        "mart_logistics_network",
        (),
        ("freight_value_usd", "total_route_freight_usd"),
    ),
    Edge(
        "fct_orders",
        "mart_payment_profiles",
        (),
        ("total_payment_value_usd", "total_revenue_usd"),
    ),
    *[
        Edge("stg_olist_order_reviews", mart, ())
        for mart in (
            "mart_obt_customers",
            "mart_obt_sellers",
            "mart_product_performance",
            "mart_seller_sales",
        )
    ],
)

MODEL_EDGES = (
    *KEYED_EDGES,
    Edge(
        "stg_olist_category_translation",
        "dim_products",
        (("product_category_name_english", "product_category_english"),),
    ),
    *TOTALLED_EDGES,
)

# From feed to staging: every row, and the key as it is.
FEED_EDGES = tuple(
    Edge(staged.feed, name, ((staged.columns[0], staged.columns[0]),))
    for name, staged in STAGING.items()
)


# Sides in one word of bits, its sign left out.
_BITS = 63


def _domains(sides: list[tuple[str, tuple[str, ...]]], chosen: list[Edge]) -> list[int]:
    """For each side, the first side that edges lead to from it: those share their keys."""
    first = list(range(len(sides)))
    for e in chosen:
        a, b = (
            first[sides.index((name, tuple(pair[j] for pair in e.keys)))]
            for j, name in enumerate((e.parent, e.child))
        )
        first = [min(a, b) if f in (a, b) else f for f in first]
    return first


def reconcile_lineage(
    tables: Mapping[str, DataFrame],
    edges: Iterable[Edge] = MODEL_EDGES,
    around: str | None = None,
) -> DataFrame:
    """One row per edge, or per edge touching table ``around``: rows and keys on
    either side, keys lost and gained, measure totals and their drift.

    A table and the columns that identify a row of it are a side; sides that edges connect
    hold the same keys and are looked at together: a row is emitted once for each side it
    has, not for each edge, with a bit for the side and no counts, and one aggregation by
    key, made up in the map tasks, says which sides a key is in. The keys are then counted
    by those bits, and the edges from these few rows. Rows and measures have nothing to do
    with keys: they are totalled per table, in a second, narrow pass over it. Keys go
    through the shuffle packed. Give it stored tables (``plans.build``), or each pass
    recomputes its table. For ``FEED_EDGES``, ``tables`` must hold the feeds, too.
    """
    chosen = [e for e in edges if around in (None, e.parent, e.child)]
    if not chosen:
        raise ValueError(f"no edge touches {around!r}")
    width = max(len(e.keys) for e in chosen)
    ends = [
        ((e.parent, tuple(k for k, _ in e.keys)), (e.child, tuple(k for _, k in e.keys)))
        for e in chosen
    ]
    sides = list(dict.fromkeys(side for pair in ends for side in pair))
    domain = _domains(sides, chosen)
    # Sides are numbered within their domain; a side is bit ``slot % _BITS`` of a word.
    slot = [domain[:i].count(d) for i, d in enumerate(domain)]
    words = [f"in{w}" for w in range(max(slot) // _BITS + 1)]

    def entry(i: int):
        """A row's part in one side: its domain and key, and the side's bit."""
        key = [packed(F.col(c).cast("string")) for c in sides[i][1]]
        key += [F.lit(None).cast("binary")] * (width - len(key))
        word, bit = divmod(slot[i], _BITS)
        return F.struct(
            F.lit(domain[i]).alias("domain"),
            *[k.alias(f"k{n}") for n, k in enumerate(key)],
            *[F.lit((w == word) << bit).cast("long").alias(c) for w, c in enumerate(words)],
        )

    parts: dict[str, list] = {}
    for i, (name, _) in enumerate(sides):
        parts.setdefault(name, []).append(entry(i))
    per_key = (
        union_all([tables[n].select(F.inline(F.array(*p))) for n, p in parts.items()])
        .groupBy("domain", *[f"k{n}" for n in range(width)])
        .agg(*[F.bit_or(c).alias(c) for c in words])
    )
    by_sides = per_key.groupBy("domain", *words).agg(F.count(F.lit(1)).alias("keys"))

    # An edge has a part from the keys of its domain and one from either table's totals.
    counts = ("parent_rows", "child_rows", "parent_keys", "child_keys", "keys_lost", "keys_gained")
    sums = ("parent_measure", "child_measure")

    def part(index: int, **values):
        return F.struct(
            F.lit(index).alias("edge"),
            *[values.get(c, F.lit(None)).cast("long").alias(c) for c in counts],
            *[values.get(c, F.lit(None)).cast("double").alias(c) for c in sums],
        )

    def key_facts(index: int):
        def within(side) -> Column:
            word, bit = divmod(slot[sides.index(side)], _BITS)
            return F.col(words[word]).bitwiseAND(F.lit(1 << bit).cast("long")) != 0

        def keys(condition: Column) -> Column:
            return F.when(condition, F.col("keys"))

        above, below = map(within, ends[index])
        return part(
            index,
            parent_keys=keys(above),
            child_keys=keys(below),
            keys_lost=keys(above & ~below),
            keys_gained=keys(below & ~above),
        )

    def by(choice: str, found: Mapping) -> Column:
        """Of the arrays in ``found`` that of the row's ``choice``."""
        return F.coalesce(*[F.when(F.col(choice) == at, F.array(*a)) for at, a in found.items()])

    facts: dict[int, list] = {}
    for i, pair in enumerate(ends):
        facts.setdefault(domain[sides.index(pair[0])], []).append(key_facts(i))

    measures: dict[str, list[str]] = {name: [] for name in parts}
    for e in chosen:
        for name, column in zip((e.parent, e.child), e.measure or ()):
            if column not in measures[name]:
                measures[name].append(column)
    names = list(measures)
    places = range(max(map(len, measures.values())))

    def numbers(name: str) -> DataFrame:
        own = [F.col(c).cast("double") for c in measures[name]]
        own += [F.lit(None).cast("double")] * (len(places) - len(own))
        return tables[name].select(
            F.lit(names.index(name)).alias("table"), *[m.alias(f"m{n}") for n, m in zip(places, own)]
        )

    per_table = (
        union_all([numbers(name) for name in names])
        .groupBy("table")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"m{n}").alias(f"m{n}") for n in places])
    )
    shares: dict[int, list] = {}
    for i, e in enumerate(chosen):
        for j, (side, name) in enumerate(zip(("parent", "child"), (e.parent, e.child))):
            values = {f"{side}_rows": F.col("rows")}
            if e.measure:
                values[f"{side}_measure"] = F.col(f"m{measures[name].index(e.measure[j])}")
            shares.setdefault(names.index(name), []).append(part(i, **values))

    per_edge = (
        by_sides.select(F.inline(by("domain", facts)))
        .unionByName(per_table.select(F.inline(by("table", shares))))
        .groupBy("edge")
        .agg(*[F.sum(c).alias(c) for c in (*counts, *sums)])
    )
    steps = per_edge.sparkSession.createDataFrame(
        [(i, e.parent, e.child) for i, e in enumerate(chosen)],
        "edge int, parent string, child string",
    )
    return steps.join(per_edge, "edge", "left").select(
        "parent",
        "child",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        *sums,
        (F.col("child_measure") - F.col("parent_measure")).alias("measure_drift"),
    )


def lineage_upstream(
    tables: Mapping[str, DataFrame], table: str, edges: Iterable[Edge] = (*MODEL_EDGES, *FEED_EDGES)
) -> DataFrame:
    """The ways from ``table`` to its feeds, with the keys and rows lost on each step.

    One row per step and way (``path`` as text, from ``table`` to the step's parent), with
    the columns of ``reconcile_lineage``. ``first_loss`` marks the step where a way meets
    lost keys first, coming from ``table``: no step of that way nearer to it loses any.
    Only the edges on some way are reconciled.
    """
    known = list(edges)
    above, reached = {table}, {table}
    while reached := {e.parent for e in known if e.child in reached} - above:
        above |= reached
    chosen = [e for e in known if e.child in above]
    if not chosen:
        raise ValueError(f"no edge leads to {table!r}")
    spark = next(iter(tables.values())).sparkSession
    ways = upstream(spark, table, [(e.parent, e.child) for e in chosen])
    counts = reconcile_lineage(tables, chosen).drop("parent_measure", "child_measure")
    steps = ways.join(counts, ["parent", "child"])
    # a way's steps nearer to the table are those that its path starts with
    lossy = steps.where("keys_lost > 0").select(F.col("path").alias("start"))
    starts = F.transform(
        F.sequence(F.lit(2), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n)
    )
    nearer = (
        steps.where(F.size("path") > 2)
        .select("path", F.explode(starts).alias("start"))
        .join(lossy, "start", "left_semi")
        .select("path", F.lit(True).alias("nearer"))
        .distinct()
    )
    return steps.join(nearer, "path", "left").select(
        "depth",
        "parent",
        "child",
        F.array_join("path", " < ").alias("path"),
        "parent_rows",
        "child_rows",
        "parent_keys",
        "child_keys",
        "keys_lost",
        "keys_gained",
        ((F.col("keys_lost") > 0) & F.col("nearer").isNull()).alias("first_loss"),
    )
