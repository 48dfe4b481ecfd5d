"""Mixing sources to target weights by weighted fair queueing.

Every source has a target in words. Its documents queue in a shuffled order, the whole
queue once per allowed repeat; a place in the queue has the virtual finish time
*words of its source up to and with it / target*. Served in order of finish time, all
sources fill at the pace of their targets. The mix is the prefix of that order that fits
the budget.

Only functions of Spark are used. The running words of a source are summed in two steps,
so that no task sees a whole source: the shuffle key's leading bits put documents into
buckets, totals per bucket are summed up, and a window sums within each bucket. The cut
is found the same way: takes are counted in ranges of finish time, then sorted within
the one range where the budget ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import written

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights in order of source, repeating.
WEIGHTS = (5, 2, 1)
#: Documents in a bucket of the shuffle key, about; at least so many buckets.
ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 512
#: The per-source table is broadcast up to this many sources.
MAX_BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """What to mix: budget as ``numerator / denominator`` of all words, and repeats."""

    weights: tuple[int, ...] = WEIGHTS
    numerator: int = 3
    denominator: int = 2
    repeats: int = 2
    seed: str = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(__nul, __src, source_size, target) from rows of (__nul, __src, __size).

    Sources are ordered by code point, null last. A target stops at ``repeats`` times
    the source's words; what is above goes to the others by weight. In order of
    *most words / weight* the stopped sources come first, so one pass finds them.
    This table has one row per source and is ordered in one task.
    """
    totals = sizes.groupBy("__nul", "__src").agg(F.sum("__size").alias("source_size"))
    by_name = Window.orderBy("__nul", "__src")
    weights = F.array(*map(F.lit, mix.weights))
    place = (F.row_number().over(by_name) - 1) % len(mix.weights)
    ranked = totals.withColumn("__w", F.get(weights, place).cast("long")).withColumn(
        "__most", F.col("source_size") * mix.repeats
    )
    fill = Window.orderBy(F.col("__most") / F.col("__w"), "__nul", "__src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    num, den = mix.numerator, mix.denominator
    # words left for this source and the later ones, times the denominator; their weights
    left = F.sum("source_size").over(everything) * num - den * F.coalesce(
        F.sum("__most").over(before), F.lit(0)
    )
    shared = ranked.withColumn("__left", left).withColumn("__ws", F.sum("__w").over(onwards))
    full = F.col("__most") * F.col("__ws") * den <= F.col("__w") * F.col("__left")
    # the first source that isn't full has the level of all that aren't
    open_ = shared.withColumn("__full", full).withColumn(
        "__level",
        F.min(F.when(~full, F.struct(F.row_number().over(fill), "__left", "__ws"))).over(everything),
    )
    level = F.col("__w").cast("double") * F.col("__level.__left").cast("double")
    target = F.when(F.col("__full"), F.col("__most").cast("double")).otherwise(
        level / (F.col("__level.__ws") * den).cast("double")
    )
    return open_.select("__nul", "__src", "source_size", target.alias("target"))


def _queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, mix: Mix) -> DataFrame:
    """``docs`` with each row's size, source key and shuffle key."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "__size": words(F.col(text_col)),
            "__nul": F.col(source_col).isNull(),
            "__src": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "__key": F.md5(F.concat(F.lit(mix.seed + ":"), name)),
        }
    )


def _range(finish: Column, ranges: int) -> Column:
    """Number of the range of finish times: equal widths below 1, growing ones beyond."""
    late = ranges + F.floor(F.log2(finish) * ranges)
    return F.when(finish < 1, F.floor(finish * ranges)).otherwise(late).cast("long")


def _takes(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per place in the queues: size, source, key, round and finish time."""
    every = F.explode(F.array(*(F.lit(i) for i in range(mix.repeats)))).alias("__round")
    finish = (F.col("__round") * F.col("source_size") + F.col("__sum")).cast("double") / F.col("target")
    taken = rows.where("__size > 0 and target > 0")
    columns = ["__size", "__nul", "__src", "__key", "__sum", "source_size", "target"]
    return taken.select(*columns, every).withColumn("__finish", finish)


#: Serving order; the running words tell documents of one source and round apart.
_ORDER = ("__finish", "__nul", "__src", "__round", "__sum")


def _mixed(
    docs: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    mix: Mix = Mix(),
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with __size, source_size, target, __sum, __cut.

    ``__cut`` says for each round whether the row's place is within the budget.
    """
    queue = _queue(docs, id_col, text_col, source_col, mix)
    narrow_columns = list(dict.fromkeys([id_col, "__size", "__nul", "__src", "__key"]))
    narrow = written(queue.select(*narrow_columns), "mix-sizes")
    rows = narrow.count()
    buckets = max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))
    lead = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    bucket = F.shiftright(lead * buckets, 32).alias("__bucket")

    targets = written(source_targets(narrow, mix), "mix-targets")
    if targets.count() <= MAX_BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    totals = narrow.groupBy("__nul", "__src", bucket).agg(F.sum("__size").alias("__total"))
    earlier = Window.partitionBy("__nul", "__src").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.join(targets, ["__nul", "__src"]).withColumn(
        "__start", F.coalesce(F.sum("__total").over(earlier), F.lit(0))
    )
    starts = written(starts.drop("__total"), "mix-starts")

    def placed(wide: DataFrame) -> DataFrame:
        within = Window.partitionBy("__nul", "__src", "__bucket").orderBy("__key", "__size")
        running = F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0))
        joined = wide.withColumn("__bucket", bucket).join(starts, ["__nul", "__src", "__bucket"])
        return joined.withColumn("__sum", F.col("__start") + running)

    # where the budget ends
    queued = written(placed(narrow).select(*narrow_columns, "source_size", "target", "__sum"), "mix-queue")
    takes = _takes(queued, mix)
    ranges = max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))
    in_range = _range(F.col("__finish"), ranges)
    so_far = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    served = (
        takes.groupBy(in_range.alias("__range"))
        .agg(F.sum("__size").alias("__words"))
        .withColumn("__served", F.sum("__words").over(so_far))
    )
    den = mix.denominator
    budget = mix.numerator * (narrow.agg(F.sum("__size")).first()[0] or 0)
    last = served.where(F.col("__served") * den > budget).orderBy("__range").first()
    if last is None:
        fits = F.lit(True)
    else:
        room = Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
        over = (
            takes.where(in_range == last["__range"])
            .withColumn("__run", F.sum("__size").over(room) + (last["__served"] - last["__words"]))
            .where(F.col("__run") * den > budget)
        )
        cut = over.orderBy(*_ORDER).select(*_ORDER).first()
        fits = F.struct(*_ORDER) < F.struct(
            *(F.lit(cut[c]).cast(takes.schema[c].dataType).alias(c) for c in _ORDER)
        )

    # `fits` compares the columns of _ORDER, so each round is put under those names
    wide = queued if set(keep) <= set(narrow_columns) else placed(queue)
    flags = wide
    for i in range(mix.repeats):
        finish = (F.lit(i) * F.col("source_size") + F.col("__sum")).cast("double") / F.col("target")
        flags = flags.withColumns({"__round": F.lit(i), "__finish": finish}).withColumn(
            f"__take{i}", F.coalesce((F.col("__size") > 0) & (F.col("target") > 0) & fits, F.lit(False))
        )
    takes_made = F.array(*(F.col(f"__take{i}") for i in range(mix.repeats)))
    return flags.select(*keep, "__size", "source_size", "target", "__sum", takes_made.alias("__cut"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", mix: Mix = Mix(), **columns: str) -> DataFrame:
    """What the mix takes of every row: (id, size, source_size, target, taken), in words.

    Null, empty and blank texts have size 0 and are never taken; sources without words
    have target 0; null is a source of its own, after all others. Rows with equal ids are
    separate documents that queue by size; equal rows are interchangeable, so reruns
    agree. An empty table gives an empty result; other columns are ignored.
    """
    planned = _mixed(docs, [id_col], id_col=id_col, mix=mix, **columns)
    times = F.aggregate("__cut", F.lit(0), lambda n, x: n + x.cast("int"))
    return planned.select(
        id_col,
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * times).alias("taken"),
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", mix: Mix = Mix(), **columns: str) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, in serving order.

    Handles odd rows as ``mix_plan`` does; all columns of ``docs`` come out unchanged.
    The result is range-partitioned by virtual finish time and sorted within.
    """
    planned = _mixed(docs, docs.columns, id_col=id_col, mix=mix, **columns)
    served = planned.select("*", F.posexplode("__cut").alias("__round", "__in")).where("__in")
    finish = (F.col("__round") * F.col("source_size") + F.col("__sum")).cast("double") / F.col("target")
    return served.withColumn("__finish", finish).orderBy("__finish", "__sum").select(*docs.columns)
