"""Exact top-k inner products by the threshold algorithm on sorted per-dimension lists.

Vectors are cut into blocks of bounded size. A block's index has, for each dimension, its
vectors in the order of that component. A query reads the lists from the end that suits
the sign of its own component, a few entries of each at a time; vectors seen for the first
time are scored in full. What hasn't been seen can't score more than the sum over all
dimensions of the query's component times the last component read, so reading stops once
that bound is below the k-th score so far. It goes on while the two are equal, as an unseen
vector with a smaller id would win the tie.

Queries are cut into chunks, and each chunk meets each block in a task of its own. First
every query searches the block it is in; its k-th score there is where it starts from in
the other blocks, most of which then read a few entries only. Per query and block k rows
at most come out, and the best k of them are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tallyline.llm.common import written

#: Vectors of a block, at most, and queries of a chunk. A task holds one of each.
BLOCK_VECTORS = 8_192
CHUNK_QUERIES = 2_048
#: Tasks that blocks and chunks meet in, at most; each goes through several pairs if there are more.
MOST_TASKS = 100_000
#: Entries of each list that are read first; then twice as many each time.
FIRST_ENTRIES = 8
#: Sums of products below this are exact in double precision, in whatever order.
EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null where a component isn't finite."""

    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")), F.lit(False))

    def down(x: Column) -> Column:
        exact = x.cast("double") * scale
        return F.rint(exact) - F.when(F.rint(exact) > exact, 1.0).otherwise(0.0)

    return F.when(F.forall(vector, finite), F.transform(vector, down))


def products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows with a whole-numbered query, exactly.

    As doubles where those are exact, else as Python's numbers, kept within 64 bits.
    """
    with np.errstate(over="ignore"):
        exact = np.abs(matrix).max(initial=0) * np.abs(query).sum() < EXACT
    if exact:
        return matrix @ query
    whole = [int(x) for x in query.tolist()]
    out = np.empty(len(matrix), object)
    for i, row in enumerate(matrix.tolist()):
        out[i] = min(max(sum(int(x) * y for x, y in zip(row, whole)), _LONG[0]), _LONG[1])
    return out


class Block:
    """Vectors with their ids and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)

    def top(self, query: np.ndarray, row: int, k: int, floor=None, first: int = FIRST_ENTRIES) -> list[tuple]:
        """The best (score, id, row) for a query, itself in ``row``; without those below ``floor``."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weights = query[used]
        up = weights > 0
        seen = self.rows == row
        best: list[tuple] = []
        depth, step = 0, first
        while depth < n:
            end = min(n, depth + step) if len(used) else n
            if len(used):
                read = [self.order[d, n - end : n - depth] if u else self.order[d, depth:end] for d, u in zip(used, up)]
                fresh = np.zeros(n, bool)
                fresh[np.concatenate(read)] = True
                fresh &= ~seen
            else:  # no list says anything: all scores are 0
                fresh = ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            if len(at):
                scores = products(self.vectors[at], query)
                if len(at) > k:  # whoever is below the k-th of these isn't among the best
                    keep = scores >= (np.partition(scores, len(at) - k) if scores.dtype != object else np.sort(scores))[len(at) - k]
                    at, scores = at[keep], scores[keep]
                found = zip(scores.tolist(), self.ids[at].tolist(), self.rows[at].tolist())
                best = sorted([*best, *found], key=lambda x: (-x[0], x[1], x[2]))[:k]
            depth, step = end, 2 * step
            if depth < n:
                last = np.where(up, self.sorted[used, n - depth], self.sorted[used, depth - 1])
                bound = products(last[None, :], weights)[0]
                if (len(best) == k and best[-1][0] > bound) or (floor is not None and bound < floor):
                    break
        return [b for b in best if floor is None or b[0] >= floor]


_PACK = StructType(
    [
        StructField("slot", IntegerType()),
        StructField("dim", IntegerType()),
        StructField("ids", BinaryType()),
        StructField("rows", BinaryType()),
        StructField("marks", BinaryType()),
        StructField("vectors", BinaryType()),
    ]
)
_FOUND = StructType([StructField(c, LongType()) for c in ("row", "query_id", "vec_id", "score", "vec_row")])


def _packed(rows: DataFrame, slots: int, most: int) -> DataFrame:
    """Packs of up to ``most`` rows (id, row, mark, vector) of one length each.

    Rows are dealt out evenly over the slots, whatever their ids, so no pack is hot.
    """
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def pack(dim: int) -> pa.RecordBatch:
            *numbers, vectors = zip(*held.pop(dim))
            data = np.concatenate(vectors)
            small = np.abs(data).max(initial=0) < 1 << 15
            parts = [*(np.array(x, np.int64) for x in numbers), data.astype(np.int16 if small else np.float64)]
            columns = [[slot], [dim], *([p.tobytes()] for p in parts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_PACK.names)

        for batch in batches:
            numbers = zip(*(batch.column(c).to_pylist() for c in ("id", "row", "mark")))
            vectors = batch.column("vector")
            flat, ends = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            for i, own in enumerate(numbers):
                vector = flat[ends[i] : ends[i + 1]].astype(np.float64)
                held.setdefault(len(vector), []).append((*own, vector))
                if len(held[len(vector)]) == most:
                    yield pack(len(vector))
        for dim in list(held):
            yield pack(dim)

    return rows.select("id", "row", "mark", "vector").repartition(slots).mapInArrow(run, _PACK)


def _unpacked(batch: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, ...]:
    """(ids, rows, marks, vectors) of the i-th pack of a batch."""
    dim = batch.column("dim")[i].as_py()
    *numbers, data = (batch.column(prefix + c)[i].as_buffer() for c in _PACK.names[2:])
    ids, rows, marks = (np.frombuffer(n, np.int64) for n in numbers)
    flat = np.frombuffer(data, np.int16 if data.size == 2 * len(ids) * dim else np.float64)
    return ids, rows, marks, flat.astype(np.float64).reshape(len(ids), dim)


def _at_home(blocks: DataFrame, k: int) -> DataFrame:
    """Each query (id, row, mark, vector) with what it finds in its own block.

    ``mark`` is its k-th score there, or the least number of 64 bits if there are fewer.
    """
    found = ArrayType(StructType(_FOUND.fields[2:]))
    fields = [("id", LongType()), ("row", LongType()), ("mark", LongType()), ("vector", ArrayType(DoubleType()))]
    schema = StructType([*(StructField(c, t) for c, t in fields), StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, asks, vectors = _unpacked(batch, i)
                block = Block(ids, rows, vectors)
                columns: list[list] = [[] for _ in schema]
                for at in np.flatnonzero(asks).tolist():
                    best = block.top(vectors[at], rows[at], k)
                    mark = int(best[-1][0]) if len(best) == k else _LONG[0]
                    named = [{"vec_id": v, "score": int(s), "vec_row": r} for s, v, r in best]
                    for column, value in zip(columns, (int(ids[at]), int(rows[at]), mark, vectors[at], named)):
                        column.append(value)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return blocks.mapInArrow(run, schema)


def _elsewhere(met: DataFrame, k: int) -> DataFrame:
    """What the queries of chunks (q_*) find in the blocks that they meet, their own left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, _, vectors = _unpacked(batch, i)
                block = Block(ids, rows, vectors)
                q_ids, q_rows, floors, queries = _unpacked(batch, i, "q_")
                columns: list[list] = [[] for _ in _FOUND]
                for at in np.flatnonzero(~np.isin(q_rows, rows)).tolist():
                    floor = int(floors[at])
                    best = block.top(queries[at], q_rows[at], k, None if floor == _LONG[0] else floor)
                    for score, found, row in best:
                        values = (int(q_rows[at]), int(q_ids[at]), found, int(score), row)
                        for column, value in zip(columns, values):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FOUND.names)

    return met.mapInArrow(run, _FOUND)


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block_vectors: int = BLOCK_VECTORS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product.

    Components become floor(scale * x), so scores are whole numbers and exact; beyond 64
    bits they are the nearest number of 64 bits. ``queries`` says which rows are queries;
    each is compared with every row but itself, also with rows that repeat its id. Ties go
    to the smaller id. With fewer than k others, all of them come out.

    Vectors that are null or hold null or non-finite components (also once scaled) take no
    part, nor do rows with a null id, which couldn't be named. Vectors of different lengths
    aren't compared; empty vectors score 0 among themselves. Rows that repeat a query have
    a result each. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        scaled(F.col(vector_col), scale).alias("vector"),
        F.coalesce(queries, F.lit(False)).cast("long").alias("mark"),
    )
    rows = rows.where("vector is not null").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "vectors")
    n_rows, n_queries = rows.agg(F.count("*"), F.sum("mark")).first()
    slots = max(1, -(-n_rows // block_vectors))
    q_slots = max(1, -(-(n_queries or 0) // chunk_queries))

    blocks = written(_packed(rows, slots, block_vectors), "blocks")
    home = written(_at_home(blocks.repartition(slots), k), "home")
    chunks = _packed(home, q_slots, chunk_queries)
    chunks = written(chunks.select("dim", *(F.col(c).alias(f"q_{c}") for c in _PACK.names if c != "dim")), "chunks")

    # every chunk meets every block, spread evenly over the tasks
    unit = ["slot", "q_slot", "dim"]
    tasks = min(slots * q_slots, MOST_TASKS)
    some = blocks.withColumn("q_slot", F.explode(F.sequence(F.lit(0), F.lit(q_slots - 1)))).repartition(tasks, *unit)
    others = chunks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition(tasks, *unit)
    far = written(_elsewhere(some.join(others, unit), k), "elsewhere")

    near = home.select("row", F.col("id").alias("query_id"), F.explode("found").alias("found"))
    found = near.select("row", "query_id", "found.*").unionByName(far)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
