"""Components of documents whose shingle sets have a high Jaccard similarity.

A grouped prefix join. Documents with equal sets are one member. Shingles are put into
one order for all documents, frequent ones last; two similar sets must then share a
shingle among the first *size - ceil(t * size) + 1* of each, their prefixes. Members
with equal prefix and size form a group. Groups meet in the lists of their prefix
shingles; pairs of groups are filtered by size, by how many shingles can still be common
behind the place where they first meet, and by sketches; what remains is expanded to
members, whose sets are compared exactly, from their texts.

A sketch has a bit for each remainder of a shingle's hash, set if an odd number of the
set's shingles has it. Where two sketches differ, a shingle is in one of the sets only; sets
that differ in too many places can't be similar. Halves added up give a sketch of half the
bits: rows of lists have short ones, and the pairs that are left are compared by long ones.

Only links between different components matter for the result, so the lists are read
in rounds. In long lists, first neighbours in a few random orders are compared, then
everybody with the members that got most links, what the others are copies of: that
connects most of what is alike with a number of pairs in proportion to the list. Lists in
which everybody is connected by then are done; the others compare all pairs that aren't
connected yet.
Lists of very frequent shingles are cut into blocks that meet pairwise, by the number of
their own entries, so no task holds a list however long.

Any order of the shingles gives the same links, so their frequencies, counted over all
documents, may be lower bounds: each task keeps a bounded summary of frequent shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallyline.llm.common import discard, trimmed, written
from tallyline.llm.components import connected_components
from tallyline.llm.shingles import shingle_sets

#: Shingles a task's summary holds, how often one must occur to be reported, and how many are.
SUMMARY_SHINGLES = 500_000
REPORTED_COUNT = 3
REPORTED_SHINGLES = 20_000
#: Shingles that are ordered by frequency, at most: 16 bytes each are sent to every executor.
FREQUENT_SHINGLES = 1 << 20
FREQUENT_COUNT = 8
#: Lists longer than this connect neighbours first, in so many random orders.
LONG_LIST = 32
ORDERS = 8
#: Long lists, its rarest ones, that a group takes part in for that, and hubs of a list, each
#: the best of the groups with one remainder of their number.
LISTS_PER_GROUP = 2
HUBS = 4
#: Hubs that a group is compared with: those with most links.
HUBS_PER_GROUP = 2
#: Bits of the sketches that go with the lists, and pairs of a list looked at together.
SKETCH_BITS = 1_024
PAIRS_AT_ONCE = 1 << 17
#: Rounds of contraction in between: parts of components are enough there.
ROUNDS_BETWEEN = 2
#: Groups of a list that meet in one task; longer lists are cut into blocks.
BLOCK = 4_096
#: Members whose texts are picked by a broadcast, at most; beyond, by a shuffle.
MAX_BROADCAST_MEMBERS = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """Sets are similar if ``den * common >= num * united``."""

    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def common(self, total: np.ndarray) -> np.ndarray:
        """Least common shingles of two sets with ``total`` together."""
        return -(-self.num * total // (self.num + self.den))


def _each_text(
    docs: DataFrame,
    schema: StructType,
    compute: Callable[[Iterator[tuple[list, list[np.ndarray]]]], Iterator[list]],
) -> DataFrame:
    """Rows that ``compute`` makes of (ids, shingle sets) of some documents at a time."""
    names, types = schema.names, {"LongType": pa.int64(), "BinaryType": pa.binary()}
    arrow = [types[type(f.dataType).__name__] for f in schema]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                yield batch.column(0), list(shingle_sets(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in compute(sets(batches)):
            arrays = [pa.array(c, t) for c, t in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("id", "text").mapInArrow(trimmed(run), schema)


def _digest(members: np.ndarray) -> bytes:
    return md5(members.tobytes()).digest()


def _sketch(members: np.ndarray) -> bytes:
    """Bits of the remainders that an odd number of members has: two to four per member."""
    bits = max(SKETCH_BITS, 2 << (len(members) - 1).bit_length())
    counts = np.bincount(members & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set, as 64-bit words."""
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0)


def _narrow(members: DataFrame) -> DataFrame:
    """(gid, sketch): each member's sketch with SKETCH_BITS bits."""
    schema = StructType([StructField("gid", LongType()), StructField("sketch", BinaryType())])

    def run(batches):
        for batch in batches:
            folded = [_folded(x, SKETCH_BITS // 8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.binary())], names=schema.names)

    return members.select("rep", "sketch").mapInArrow(trimmed(run), schema)


def _merged(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed counts by key; of more than ``most`` keys, the most frequent, less the rest's highest count."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1) != 0) if len(keys) else np.zeros(0, int)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most - 1 : len(counts) - most].max()
        above = counts > floor
        keys, counts = keys[above], counts[above] - floor
    return keys, counts


def _scan(docs: DataFrame) -> DataFrame:
    """Per document (id, n, sig); per task also (shingle, count) of its frequent ones."""
    schema = StructType(
        [
            StructField("id", LongType()),
            StructField("n", LongType()),
            StructField("sig", BinaryType()),
            StructField("shingle", LongType()),
            StructField("count", LongType()),
        ]
    )

    def compute(parts):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, held = [], 0

        def summed():
            fresh, times = np.unique(np.concatenate(waiting), return_counts=True)
            return _merged(np.concatenate([keys, fresh]), np.concatenate([counts, times]), SUMMARY_SHINGLES)

        for ids, sets in parts:
            none = [None] * len(sets)
            yield [ids, [len(s) for s in sets], [_digest(s) for s in sets], none, none]
            waiting += sets
            held += sum(map(len, sets))
            if held > SUMMARY_SHINGLES:
                keys, counts = summed()
                waiting, held = [], 0
        if waiting:
            keys, counts = summed()
        often = np.flatnonzero(counts >= REPORTED_COUNT)
        often = often[np.lexsort((keys[often], -counts[often]))][:REPORTED_SHINGLES]
        none = [None] * len(often)
        yield [none, none, none, keys[often], counts[often]]

    return _each_text(docs, schema, compute)


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their counts."""
    summed = scan.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count"))
    top = summed.where(F.col("count") >= FREQUENT_COUNT).orderBy(F.desc("count"), "shingle").limit(FREQUENT_SHINGLES)
    found = top.toArrow()
    keys, counts = found.column("shingle").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _looked_up(shingles: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of the shingles, 0 for those not among ``keys``."""
    if not len(keys):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    return np.where(keys[at] == shingles, counts[at], 0)


def _members(docs: DataFrame, frequent, rule: Similarity) -> DataFrame:
    """One row per distinct set: (n, sig, rep, prefix, sketch); prefix is its shingles in order."""
    schema = StructType(
        [
            StructField("id", LongType()),
            StructField("n", LongType()),
            StructField("sig", BinaryType()),
            StructField("prefix", BinaryType()),
            StructField("sketch", BinaryType()),
        ]
    )

    def prefix(shingles: np.ndarray) -> bytes:
        counts = _looked_up(shingles, *frequent.value)
        return shingles[np.argsort(counts, kind="stable")][: rule.prefix(len(shingles))]

    def compute(parts):
        for ids, sets in parts:
            keep = [i for i, s in enumerate(sets) if len(s)]
            kept = [sets[i] for i in keep]
            yield [
                ids.take(pa.array(keep, pa.int64())),
                [len(s) for s in kept],
                [_digest(s) for s in kept],
                [prefix(s).tobytes() for s in kept],
                [_sketch(s) for s in kept],
            ]

    found = _each_text(docs, schema, compute)
    return found.groupBy("n", "sig").agg(
        F.min("id").alias("rep"), F.max("prefix").alias("prefix"), F.max("sketch").alias("sketch")
    )


def _postings(groups: DataFrame) -> DataFrame:
    """(shingle, gid, place) per group and prefix shingle; ``place`` is n << 32 | position."""
    schema = StructType([StructField(c, LongType()) for c in ("shingle", "gid", "place")])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                parts = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
                lengths = np.array([len(p) for p in parts])
                gid = np.repeat(batch.column("gid").to_numpy(), lengths)
                n = np.repeat(batch.column("n").to_numpy(), lengths)
                pos = np.arange(len(gid)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                columns = [np.concatenate(parts), gid, n << 32 | pos]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    return groups.select("prefix", "gid", "n").mapInArrow(trimmed(run), schema)


def _lists(postings: DataFrame) -> DataFrame:
    """The postings of shingles with more than one, and how many each shingle has."""
    length = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    return postings.withColumn("length", length).where("length > 1")


def _blocks(length: Column) -> Column:
    """Blocks of a list, each of about BLOCK groups."""
    return F.ceil(length / F.lit(BLOCK)).cast("int")


def _block() -> Column:
    return F.pmod(F.xxhash64("gid"), _blocks(F.col("length"))).cast("int")


def _same_unit(columns: dict[str, np.ndarray], unit: list[str], a, b) -> np.ndarray:
    same = columns[unit[0]][a] == columns[unit[0]][b]
    for c in unit[1:]:
        same = same & (columns[c][a] == columns[c][b])
    return same


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of sketches as rows of 64-bit words."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.reshape(len(column), SKETCH_BITS // 8).view(np.uint64)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], unit: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole units of rows sorted by unit, many at a time; a unit is bounded by its blocks."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: _numbers(batch.column(c)) for c in names}
        n = batch.num_rows
        changes = np.flatnonzero(~_same_unit(columns, unit, slice(0, n - 1), slice(1, n)))
        if held and not _same_unit({c: np.append(held[-1][c][-1:], columns[c][:1]) for c in unit}, unit, 0, 1):
            yield {c: np.concatenate([h[c] for h in held]) for c in names}
            held = []
        if not len(changes):
            held.append(columns)
            continue
        cut = changes[-1] + 1
        head = [*held, {c: v[:cut] for c, v in columns.items()}]
        yield {c: np.concatenate([h[c] for h in head]) for c in names}
        held = [{c: v[cut:] for c, v in columns.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in names}


_PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _in_units(rows: DataFrame, unit: list[str], order: list[str], make, schema: StructType) -> DataFrame:
    """What ``make`` finds in whole units, many of them at a time."""
    names = rows.columns

    def run(batches):
        for found in _runs(batches, names, unit):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in make(found)], names=schema.names)

    ordered = rows.repartition(*unit).sortWithinPartitions(*unit, *order)
    return ordered.mapInArrow(trimmed(run), schema)


def _near_in_size(rule: Similarity, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return rule.den * np.minimum(n, m) >= rule.num * np.maximum(n, m)


def _long_lists(lists: DataFrame) -> DataFrame:
    """(shingle, block, gid, n): each group's place in the rarest of its long lists."""
    own = Window.partitionBy("gid").orderBy(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), "shingle")
    long = lists.where(F.col("length") > LONG_LIST).withColumn("rank", F.row_number().over(own))
    n = F.shiftright("place", 32).alias("n")
    return long.where(F.col("rank") <= LISTS_PER_GROUP).select("shingle", _block().alias("block"), "gid", n)


def _neighbour_pairs(long: DataFrame, rule: Similarity) -> DataFrame:
    """Neighbours in long lists, ordered by one of a few hashes of the group."""
    unit = ["shingle", "block"]
    order = F.xxhash64("gid", F.pmod("shingle", F.lit(ORDERS)))

    def make(rows):
        n = len(rows["gid"])
        ok = _same_unit(rows, unit, slice(0, n - 1), slice(1, n))
        ok &= _near_in_size(rule, rows["n"][:-1].astype(np.int64), rows["n"][1:].astype(np.int64))
        a, b = rows["gid"][:-1][ok], rows["gid"][1:][ok]
        return np.minimum(a, b), np.maximum(a, b)

    return _in_units(long.withColumn("order", order), unit, ["order"], make, _PAIR).distinct()


def _hub_pairs(long: DataFrame, links: DataFrame, rule: Similarity) -> DataFrame:
    """Each group of a long list with the list's hubs.

    Hubs are groups with most links so far: what many are copies of. They connect the
    blocks of a list, too.
    """
    ends = links.select(F.col("a").alias("gid")).unionAll(links.select("b"))
    degrees = ends.groupBy("gid").agg(F.count("*").alias("degree"))
    placed = long.select("shingle", "gid", "n")
    share = F.pmod(F.xxhash64("gid"), F.lit(HUBS)).alias("share")
    rank = F.struct("degree", "gid", "n")
    hubs = placed.join(degrees, "gid").groupBy("shingle", share).agg(F.max(rank).alias("hub")).drop("share")
    near = rule.den * F.least("n", "hub.n") >= rule.num * F.greatest("n", "hub.n")
    met = placed.join(hubs, "shingle").where(near & (F.col("gid") != F.col("hub.gid")))
    best = Window.partitionBy("gid").orderBy(F.desc("hub.degree"), "hub.gid")
    met = met.select("gid", "hub").distinct().withColumn("rank", F.row_number().over(best))
    met = met.where(F.col("rank") <= HUBS_PER_GROUP)
    return met.select(F.least("gid", "hub.gid").alias("a"), F.greatest("gid", "hub.gid").alias("b")).distinct()


def _unconnected_pairs(lists: DataFrame, ends: DataFrame, rule: Similarity) -> DataFrame:
    """All pairs of groups that pass the filters and aren't in one component already.

    ``ends`` has for each group (gid) the least and greatest component of its members and
    a sketch, null unless the group has one member. At the first common shingle of a
    similar pair, what follows must suffice. A list of several blocks is read by a unit
    (low, high) for each two of them, and for each by itself.
    """
    unit = ["shingle", "low", "high"]

    def make(rows):
        n, pos, gid = rows["place"] >> 32, rows["place"] & 0xFFFFFFFF, rows["gid"]
        low, high = rows["low_part"], rows["high_part"]
        count = len(gid)
        # rows of one unit and component stand together; a group of several is by itself
        same = _same_unit(rows, unit, slice(0, count - 1), slice(1, count))
        own = same & (low[1:] == low[:-1]) & (low[1:] == high[1:]) & (low[:-1] == high[:-1])
        unit_end = np.append(np.flatnonzero(~same) + 1, count)
        part_end = np.append(np.flatnonzero(~own) + 1, count)
        at = np.arange(count)
        last = unit_end[np.searchsorted(unit_end, at, side="right")]
        first = part_end[np.searchsorted(part_end, at, side="right")]
        others = last - first
        found = [np.zeros((2, 0), np.int64)]
        cuts = np.searchsorted(np.cumsum(others), np.arange(PAIRS_AT_ONCE, others.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        for start, end in zip([0, *cuts[:-1] + 1], cuts + 1):
            some = at[start:end]
            a = np.repeat(some, others[some])
            b = np.arange(len(a)) - np.repeat(np.cumsum(others[some]) - others[some], others[some]) + first[a]
            ok = (rows["low"][a] == rows["high"][a]) | (rows["block"][a] != rows["block"][b])
            ok &= _near_in_size(rule, n[a], n[b]) & (gid[a] != gid[b])
            ok &= np.minimum(n[a] - pos[a], n[b] - pos[b]) >= rule.common(n[a] + n[b])
            a, b = a[ok], b[ok]
            apart = np.bitwise_count(rows["sketch"][a] ^ rows["sketch"][b]).sum(axis=1, dtype=np.int64)
            apart[~(rows["single"][a] & rows["single"][b])] = 0
            total = n[a] + n[b]
            ok = total - apart >= 2 * rule.common(total)
            a, b = a[ok], b[ok]
            found.append(np.stack([np.minimum(gid[a], gid[b]), np.maximum(gid[a], gid[b])]))
        low_gid, high_gid = np.unique(np.concatenate(found, axis=1), axis=1)
        return low_gid, high_gid

    whole = Window.partitionBy("shingle")
    rows = lists.join(ends.drop("sketch"), "gid")
    rows = rows.withColumn("open", F.min("low_part").over(whole) != F.max("high_part").over(whole))
    rows = rows.where("open").drop("open").join(ends.select("gid", "sketch"), "gid")
    single = F.col("sketch").isNotNull()
    rows = rows.withColumns({"single": single, "sketch": F.coalesce("sketch", F.lit(bytes(SKETCH_BITS // 8)))})
    others = F.explode(F.sequence(F.lit(0), _blocks(F.col("length")) - 1))
    rows = rows.withColumn("block", _block()).withColumn("other", others)
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    rows = rows.select(*unit, "block", "gid", "place", "low_part", "high_part", "single", "sketch")
    return _in_units(rows, unit, ["low_part", "high_part"], make, _PAIR).distinct()


def _compared(pairs: DataFrame, values: DataFrame, fits) -> DataFrame:
    """The pairs that pass ``fits``, by their two rows of ``values`` (rep, n, value).

    ``fits`` takes columns x and y of values and n and m, and returns a flag for each pair.
    """
    both = pairs
    for side, value, size in (("a", "x", "n"), ("b", "y", "m")):
        own = values.select(F.col("rep").alias(side), F.col("value").alias(value), F.col("n").alias(size))
        both = both.join(own, side)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ok = fits(*(batch.column(c) for c in "xynm"))
                yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "x", "y", "n", "m").mapInArrow(trimmed(run), _PAIR)


def _only(rows: DataFrame, keys: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def _ends(pairs: DataFrame) -> tuple[DataFrame, bool]:
    """The members in some written pair, and whether they are few enough to be broadcast."""
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    few = 2 * pairs.count() <= MAX_BROADCAST_MEMBERS
    return (ends if few else ends.distinct()), few


def _verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, rule: Similarity) -> DataFrame:
    """Those of the pairs (a, b) of members whose sets are similar; they may repeat.

    Sketches are compared first, then the sets, made from the texts: these are smaller than
    their shingles.
    """

    def may_fit(x, y, n, m):
        apart = np.zeros(len(x), np.int64)
        for i, (p, q) in enumerate(zip(x.to_pylist(), y.to_pylist())):
            size = min(len(p), len(q))
            apart[i] = np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum(dtype=np.int64)
        total = n.to_numpy() + m.to_numpy()
        return total - apart >= 2 * rule.common(total)

    def fits(x, y, n, m):
        ok = []
        for p, q in zip(shingle_sets(x.to_pylist()), shingle_sets(y.to_pylist())):
            if len(p) > len(q):
                p, q = q, p
            spot = np.minimum(np.searchsorted(q, p), len(q) - 1)
            common = int((q[spot] == p).sum())
            ok.append(rule.den * common >= rule.num * (len(p) + len(q) - common))
        return ok

    pairs = written(pairs, "candidates")
    ends, few = _ends(pairs)
    sketches = _only(members.select("rep", "n", F.col("sketch").alias("value")), ends, ["rep"], few)
    likely = written(_compared(pairs, sketches, may_fit), "likely")

    ends, few = _ends(likely)
    wanted = _only(members, ends, ["rep"], few).select(F.col("rep").alias("id"), "sig")
    wanted = written(wanted, "wanted")
    schema = StructType([StructField("id", LongType()), StructField("sig", BinaryType()), StructField("text", StringType())])

    def run(batches):  # an id may have several texts
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), pa.array(map(_digest, shingle_sets(texts)), pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    texts = _only(docs.select("id", "text"), wanted.select("id").distinct(), ["id"], few).mapInArrow(trimmed(run), schema)
    texts = _only(texts, wanted, ["id", "sig"], few)
    texts = written(texts.select(F.col("id").alias("rep"), F.lit(0).cast("long").alias("n"), F.col("text").alias("value")), "texts")
    similar = written(_compared(likely, texts, fits), "similar")
    discard(pairs, likely, wanted, texts)
    return similar


def jaccard_components(
    docs: DataFrame,
    rule: Similarity = Similarity(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) per row: size of its set, smallest id it reaches.

    A set holds the distinct five-word shingles of the whole text in lower case (A-Z);
    of fewer words, their sequence. Null, empty and blank texts have an empty set and
    are linked with nothing. Ids are whole numbers. Rows that repeat an id are linked;
    rows with a null id are linked with nothing and have a null component. An empty
    table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scan = written(_scan(docs), "documents")
    rows = scan.where("n is not null").select("id", "n", "sig")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(scan))

    named = docs.where("id is not null")
    members = _members(named, frequent, rule).withColumn("same", F.md5("prefix"))
    members = written(members, "members")
    groups = members.groupBy("n", "same").agg(F.min("rep").alias("gid"))
    grouped = members.select("rep", "n", "same").join(groups, ["n", "same"]).select("rep", "gid")
    grouped = written(grouped, "grouped")
    others = grouped.where("rep != gid").select("rep")  # seldom any: their group's first stands for them
    if others.count() <= MAX_BROADCAST_MEMBERS:
        others = F.broadcast(others)
    groups = members.select(F.col("rep").alias("gid"), "rep", "n", "prefix").join(others, "rep", "left_anti")
    lists = written(_lists(_postings(groups)), "lists")

    # neighbours in long lists, and each member with its group's first; then hubs
    long = written(_long_lists(lists), "long-lists")
    first = _neighbour_pairs(long, rule).union(grouped.where("rep != gid").select("gid", "rep"))
    links = _verified(named, members, first, rule)
    hubs = _hub_pairs(long, links, rule).join(links, ["a", "b"], "left_anti")
    links = links.union(_verified(named, members, hubs, rule))

    # part: what a member is known to be connected to so far
    parts = connected_components(links, ROUNDS_BETWEEN)
    known = grouped.join(parts, F.col("rep") == F.col("node"), "left").select(
        "rep", "gid", F.coalesce("component", "rep").alias("part")
    )
    known = written(known, "known")
    ends = known.groupBy("gid").agg(
        F.min("part").alias("low_part"), F.max("part").alias("high_part"), F.count("*").alias("size")
    )
    alone = F.when(F.col("size") == 1, F.col("sketch")).alias("sketch")
    ends = ends.join(_narrow(members), "gid").select("gid", "low_part", "high_part", alone)
    ends = written(ends, "ends")

    # all pairs that aren't connected by these
    pairs = _unconnected_pairs(lists, ends, rule)
    mixed = ends.where("low_part != high_part").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    pairs = pairs.union(mixed)
    for side in ("a", "b"):
        own = known.select(F.col("gid").alias(side), F.col("rep").alias(f"{side}_rep"), F.col("part").alias(f"{side}_part"))
        pairs = pairs.join(own, side)
    expanded = pairs.where("a_part != b_part").select(
        F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")
    )
    links = links.union(_verified(named, members, expanded.distinct(), rule))

    # rows that share an id
    shared = rows.where("id is not null and n > 0").groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    repeats = rows.join(shared.select("id"), "id", "left_semi").join(members, ["n", "sig"])
    parts = connected_components(links.union(repeats.select("id", "rep")))
    placed = members.join(parts, F.col("rep") == F.col("node"), "left")
    placed = written(placed.select("n", "sig", F.coalesce("component", "rep").alias("component_id")), "placed")
    discard(members, grouped, lists, long, known, ends)
    out = rows.join(placed, ["n", "sig"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Similarity = Similarity()) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows with a null id or an empty set all stay; of rows that repeat a linked id, the
    one with the least text stays. All columns come out unchanged.
    """
    parts = written(jaccard_components(docs, rule, id_col, text_col), "components")
    some = parts.where(F.col("n_shingles") > 0)
    gone = some.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("__gone")).distinct()
    gone = written(gone, "duplicates")
    if gone.count() <= MAX_BROADCAST_MEMBERS:
        gone = F.broadcast(gone)
    same_id = F.col(id_col).cast("long") == F.col("__gone")
    kept = docs.join(gone, same_id & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), "left_anti")
    if some.groupBy(id_col).count().where(f"count > 1 and `{id_col}` is not null").limit(1).count():
        from pyspark.sql import Window

        own = Window.partitionBy(id_col, F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).orderBy(text_col)
        stays = F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        kept = kept.withColumn("__place", F.row_number().over(own)).where(stays | (F.col("__place") == 1))
        kept = kept.drop("__place")
    return kept
