"""From feeds to marts: which table is built from which, and building them all."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import absolute, input_bytes, remove, small_sides_by_hash, tune
from ..sources import FEEDS, feed_path, read_feed
from . import marts, staging, star


_BYTES_PER_SLICE = 1 << 28
_MOST_SLICES = 2


@dataclass(frozen=True)
class Table:
    """``key``: a row comes only from rows of its own key, or from parents without that
    column, so that the table can be written in slices of the key."""

    layer: str
    parents: tuple[str, ...]
    build: Callable[..., DataFrame]
    key: str | None = None


def _from_parents(layer: str, build: Callable[..., DataFrame], key: str | None = None) -> Table:
    return Table(layer, tuple(inspect.signature(build).parameters), build, key)


def _staged(name: str) -> Table:
    return Table("staging", (staging.STAGING[name].feed,), lambda raw: staging.stage(name, raw))


TABLES: dict[str, Table] = {
    **{name: _staged(name) for name in staging.STAGING},
    **{
        f.__name__: _from_parents("intermediate", f)
        for f in (
            star.dim_customers,
            star.dim_sellers,
            star.dim_products,
            star.dim_locations,
            star.fct_order_items,
            star.fct_order_payments,
            star.fct_orders,
        )
    },
    # Shared inputs of marts; there for as long as the build needs them, not published.
    "review_totals": _from_parents("work", star.review_totals),
    "reviewed_items": _from_parents("work", star.reviewed_items, "order_id"),
    # In the order of a build: what reads the widest work table first, the widest marts last.
    **{
        f.__name__: _from_parents("marts", f)
        for f in (
            marts.mart_obt_sellers,
            marts.mart_product_performance,
            marts.mart_seller_sales,
            marts.mart_logistics_network,
            marts.mart_payment_profiles,
            marts.mart_obt_customers,
        )
    },
    **{
        f.__name__: _from_parents("marts", f, "order_id")
        for f in (marts.mart_customer_reviews, marts.mart_obt_orders)
    },
}

PUBLISHED = tuple(name for name, t in TABLES.items() if t.layer != "work")


def edges() -> list[tuple[str, str]]:
    """(parent, child) between published tables; a work table hands its parents on."""

    def parents(name: str) -> Iterator[str]:
        for p in TABLES[name].parents:
            if p in TABLES and TABLES[p].layer == "work":
                yield from parents(p)
            else:
                yield p

    return [(p, name) for name in PUBLISHED for p in parents(name)]


class Lazy(Mapping):
    """Tables by name, each defined on first use over the given feeds.

    Nothing is stored: a query on one mart is a single plan down to the feeds, and
    Catalyst prunes what that mart does not use. A feed may be given as a function
    that opens it, called only if some table needs the feed.
    """

    def __init__(self, feeds: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._feeds = dict(feeds)
        self._known: dict[str, DataFrame] = {}

    def feed(self, name: str) -> DataFrame:
        if name not in self._known:
            source = self._feeds[name]
            self._known[name] = source() if callable(source) else source
        return self._known[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._feeds:
            return self.feed(name)
        if name not in self._known:
            table = TABLES[name]
            self._known[name] = table.build(*[self[p] for p in table.parents])
        return self._known[name]

    def __iter__(self):
        return iter(PUBLISHED)

    def __len__(self) -> int:
        return len(PUBLISHED)


def open_feeds(spark: SparkSession, root: str) -> Lazy:
    """All tables over the Parquet feeds under ``root``, unmaterialized."""
    return Lazy({name: partial(read_feed, spark, root, name) for name in FEEDS})


def _slice(df: DataFrame, key: str | None, i: int, n: int) -> DataFrame:
    """Slice ``i`` of ``n`` by a hash of the key; all rows if the table lacks it."""
    if n == 1 or key not in df.columns:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == i)


def build(
    spark: SparkSession,
    raw_root: str,
    out_root: str,
    *,
    databases: Mapping[str, str] | None = None,
    threads: int = 1,
) -> dict[str, DataFrame]:
    """Rebuild every table from the feeds under ``raw_root``.

    Staging stays a view; intermediate tables and marts are rewritten as Parquet
    under ``out_root/<layer>/<table>`` and later tables read them back from there,
    so each is computed once and a lost executor costs at most one table's work.
    Tables whose parents are all there are written by ``threads`` concurrent jobs, one
    unless asked for: a job uses all cores, and its shuffle files stay until it ends.

    The disk is mostly that of the tables themselves: a work table goes as soon as the
    last table that reads it is written, and a table with a ``key`` is written in slices
    of the key, one for every 256 MB of feeds and 2 at most, each with its own shuffles.
    Each slice reads the parents again, so that more of them would cost more time than
    they save on disk. Work tables and marts join small sides by hash
    (``session.small_sides_by_hash``).

    With ``databases`` (layer -> database, e.g. ``{"marts": "marts"}``) the layers
    are registered in the catalog too; a layer left out goes to the current
    database. Returns the published tables.
    """
    tune(spark, raw_root)
    lazy = open_feeds(spark, raw_root)
    tables: dict[str, DataFrame] = {
        name: lazy[name] for name, t in TABLES.items() if t.layer == "staging"
    }
    raw_root, out_root = absolute(spark, raw_root), absolute(spark, out_root)

    slices = max(1, min(-(-input_bytes(spark, raw_root) // _BYTES_PER_SLICE), _MOST_SLICES))

    def path(name: str) -> str:
        return f"{out_root}/{TABLES[name].layer}/{name}"

    def write(name: str) -> tuple[str, DataFrame]:
        table = TABLES[name]
        parents = [tables[p] for p in table.parents]
        n = slices if table.key else 1
        for i in range(n):
            rows = table.build(*[_slice(p, table.key, i, n) for p in parents])
            rows.write.mode("append" if i else "overwrite").parquet(path(name))
        return name, spark.read.parquet(path(name))

    work = [n for n, t in TABLES.items() if t.layer == "work"]
    with ThreadPoolExecutor(threads) as pool:
        while waiting := [n for n in TABLES if n not in tables]:
            ready = [n for n in waiting if all(p in tables for p in TABLES[n].parents)]
            now = ready[:threads]
            # Facts come out of their joins sorted by order, which Parquet stores in less.
            with small_sides_by_hash(spark, all(TABLES[n].layer != "intermediate" for n in now)):
                tables.update(pool.map(write, now))
            needed = {p for n, t in TABLES.items() if n not in tables for p in t.parents}
            for name in [n for n in work if n in tables and n not in needed]:
                work.remove(name)
                remove(spark, path(name))

    if databases is not None:
        _register(spark, lazy, raw_root, out_root, databases)
    return {name: tables[name] for name in PUBLISHED}


def _register(spark, lazy, raw_root, out_root, databases) -> None:
    target = spark.catalog.currentDatabase()
    for name in PUBLISHED:
        table = TABLES[name]
        database = databases.get(table.layer, target)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        if table.layer == "staging":
            feed = staging.STAGING[name].feed
            spark.sql(
                staging.view_sql(name, lazy.feed(feed), database, feed_path(raw_root, feed))
            )
        else:
            spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
            spark.sql(
                f"CREATE TABLE `{database}`.`{name}` USING parquet"
                f" LOCATION '{out_root}/{table.layer}/{name}'"
            )


LAYER_DATABASES = {"staging": "staging", "intermediate": "intermediate", "marts": "marts"}
