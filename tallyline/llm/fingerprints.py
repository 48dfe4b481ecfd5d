"""Document fingerprints by one-permutation MinHash, in Spark's own functions.

Every shingle is hashed once. The hash's top bits name its bin, the smallest of a bin
represents it: after sorting the hashes, that is the first of each bin (a largest
possible value per bin stands in for empty ones). An empty bin copies a filled one chosen
by the bin's own random order of all bins, the same order for every document (optimal
densification): some draws first, then, if all were empty, the filled bin that hashes
lowest with it. A fingerprint keeps the low eight bits of each bin, eight bins to a long.

Two fingerprints agree in a bin with probability J + (1 - J) / 256 for texts of Jaccard
likeness J, so the share of equal bins is corrected for that.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import SHINGLE_WORDS, written

#: Two to this power are the bins; each keeps BITS bits.
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
#: Bins drawn for an empty one before all filled ones are compared.
DRAWS = 8
#: Rows whose order one task works out.
ROWS_PER_RANGE = 100_000
#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

_SHIFT = 64 - BIN_BITS
_LOW = (1 << _SHIFT) - 1
#: One bit per byte.
_BYTES = 0x0101010101010101


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _bin(value: Column) -> Column:
    return F.shiftright(value, _SHIFT)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all five-word shingles (the whole sequence if it is shorter)."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE_WORDS, F.lit(0)))
        return F.transform(
            starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE_WORDS)))
        )

    return _let(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)), hashes)


def _filled(hashes: Column) -> Column:
    """The smallest hash of each bin in order of bins; the largest value if there is none."""
    half = BINS // 2
    largest = F.array(*(F.lit(((b + 1) << _SHIFT) - 1) for b in range(-half, half)))
    return _let(
        F.sort_array(F.concat(hashes, largest)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))),
    )


def _densified(bins: Column) -> Column:
    def is_empty(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_LOW)) == _LOW

    def copied(x: Column, i: Column) -> Column:
        drawn = [F.get(bins, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(DRAWS)]
        tries = [F.when(~is_empty(d), d) for d in drawn]
        lowest = F.array_min(
            F.transform(
                F.filter(bins, lambda y: ~is_empty(y)),
                lambda y: F.struct(F.xxhash64(i, _bin(y)).alias("place"), y.alias("value")),
            )
        )
        # hashed with the bin, else all copies of one value would agree or differ together
        return F.when(~is_empty(x), x).otherwise(F.xxhash64(i, F.coalesce(*tries, lowest["value"])))

    return F.transform(bins, copied)


def _packed(bins: Column) -> Column:
    """The low eight bits of each bin, eight bins to a long."""

    def word(q: Column) -> Column:
        parts = [
            F.shiftleft(F.get(bins, q * 8 + k).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * k)
            for k in range(8)
        ]
        packed = parts[0]
        for p in parts[1:]:
            packed = packed.bitwiseOR(p)
        return packed

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), word)


def fingerprint(text: Column) -> Column:
    """Packed fingerprint as an array of longs; empty for null texts or ones without words."""
    text = F.coalesce(text, F.lit(""))
    made = _let(_let(shingle_hashes(text), _filled), lambda b: _let(_densified(b), _packed))
    return F.when(text.rlike(WORD), made).otherwise(F.array().cast("array<bigint>"))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1; of two empty ones 1."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for by in (4, 2, 1):  # a byte's lowest bit gathers its others
            z = z.bitwiseOR(F.shiftrightunsigned(z, by))
        return F.bit_count(z.bitwiseAND(F.lit(_BYTES)))

    differing = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    corrected = ((1 - differing / BINS) - chance) / (1 - chance)
    both, none = (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both, F.greatest(corrected, F.lit(0.0))).when(none, 1.0).otherwise(0.0)


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, key, next, prev, prev_n) for distinct rows (id, key, n), in descending order of id.

    Null ids are last, equal ids in order of key; after the last comes the first. Rows
    are dealt into ranges, which are written with their numbers; each range is ordered
    by itself and the ranges' ends are joined.
    """
    order = (F.desc_nulls_last("id"), F.asc("key"))
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    dealt = rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    here = F.struct("key", "n")
    at = F.struct(F.col("id").isNull(), -F.col("id"), F.col("key"))
    ends = dealt.groupBy("range").agg(F.min_by(here, at).alias("first"), F.max_by(here, at).alias("last"))
    by_range, everything = Window.orderBy("range"), Window.partitionBy()
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("first").over(by_range), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(by_range), F.last("last").over(whole)).alias("before"),
    )
    within = Window.partitionBy("range").orderBy(*order)
    joined = dealt.select("id", "key", "range", F.lead(here).over(within).alias("up"), F.lag(here).over(within).alias("down"))
    joined = joined.join(ends, "range")
    prev = F.coalesce("down", "before")
    return joined.select(
        "id", "key", F.coalesce("up", "after")["key"].alias("next"), prev["key"].alias("prev"), prev["n"].alias("prev_n")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) as hexadecimal text, one row per input row.

    Null and empty texts, and texts of white space, have the empty fingerprint; an empty
    table gives an empty result; other columns are ignored.
    """
    return docs.select(id_col, as_text(fingerprint(F.col(text_col).cast("string"))).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the same text edited, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document, in descending order of the numeric id; after the
    last comes the first. Returns (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    Null texts are empty. Rows equal in id and text are one document in that order and
    each gets its result; rows of equal ids are ordered by a digest of their texts; null
    ids come last; an empty table gives an empty result; other columns are ignored. The
    texts are shuffled once, and the needed beginnings of the next ones once more.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    key = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))
    narrow = named.select("id", key.alias("key"), F.length("text").alias("n"))
    unique = narrow.groupBy("id", "key", "n").agg(F.count("*").alias("copies"))
    unique = written(unique, "documents")
    repeated = bool(unique.where("copies > 1").limit(1).count())
    places = written(neighbours(unique.select("id", "key", "n")), "neighbours")

    # both uses below need the same columns of the texts, so they share one shuffle
    full = named.select(key.alias("key"), "text", fingerprint(F.col("text")).alias("print"))
    placed = full.join(places, "key")
    heads = placed.select(
        F.col("prev").alias("key"),
        F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("head"),
        F.col("print").alias("next_print"),
    )
    if repeated:
        heads = heads.dropDuplicates(["key"])
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("head"))
    both = placed.join(heads, "key").select("id", n.alias("n"), edited.alias("edited"), "print", "next_print")
    both = both.withColumn("edited_print", fingerprint(F.col("edited")))
    return both.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
