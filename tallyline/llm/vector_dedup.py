"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, components.

Equal vectors of a label are one vector with a number of copies. The others go to the
cell of their nearest centre. A link can cross cells, so a vector is also a guest of
every later cell where a partner could live: a partner ``y`` in cell ``c`` is nearer to
``c`` than to this vector's centre ``h``, so it lies beyond the bisecting plane of the
two; a vector farther from that plane than the longest chord of a link has no partner
there. Nor has one whose angle to ``c`` exceeds the widest angle in the cell by more than
that of a link, which on clustered vectors leaves few guests. Cells are cut into blocks; each pair of home blocks, and each home block with each
guest block, is one matrix product. A product returns no pairs but, for each of its
vectors with links, their number and the smallest vector it is connected to inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallyline.llm.common import written
from tallyline.llm.components import connected_components

#: Vectors that k-means is fitted on, about; every vector is indexed.
FIT_VECTORS = 20_000
#: Vectors per cell aimed at, and the most cells; larger cells have more blocks.
VECTORS_PER_CELL = 1_000
MAX_CELLS = 4_096
FIT_ROUNDS = 12
#: Vectors in a block: a product holds two blocks and a matrix of their cosines.
BLOCK_VECTORS = 1_024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, safe against overflow and underflow of their squares."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def spherical_kmeans(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres; each is the direction of the mean of the vectors nearest to it."""
    vectors = unit(vectors)
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = np.concatenate(
            [(vectors[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(vectors), 4096)]
        )
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        full = np.abs(sums).max(1) > 0
        centres[full] = unit(sums[full])
    return np.unique(centres, axis=0)


def _usable(vector: Column) -> Column:
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _widest(distinct: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Per cell, the widest angle between its centre and a vector nearest to it; -1 without any."""
    sent = distinct.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        least = np.full(len(centres), 2.0)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                flat = whole.slice(at, 1024).column("vector").flatten().to_numpy()
                near = flat.reshape(-1, centres.shape[1]) @ centres.T
                np.minimum.at(least, near.argmax(1), near.max(1))
        cells = np.flatnonzero(least < 2)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(least[cells])], names=["cell", "cosine"])

    widest = np.full(len(centres), -1.0)
    if len(centres):
        own = distinct.where(F.size("vector") == centres.shape[1]).select("vector")
        found = own.mapInArrow(run, "cell long, cosine double").groupBy("cell").agg(F.min("cosine").alias("cosine"))
        for row in found.collect():  # a row per cell
            widest[row["cell"]] = np.arccos(np.clip(row["cosine"], -1, 1))
    return widest


def _cells(distinct: DataFrame, centres: np.ndarray, chord: float) -> DataFrame:
    """Adds home: each vector's cell; guest_of: later cells where it may have partners.

    Vectors of another length than the centres' are all in cell 0 of their length.
    """
    reach_of = _widest(distinct, centres) + 2 * np.arcsin(min(1.0, chord / 2)) + 1e-7
    reach_of = np.cos(np.minimum(reach_of, np.pi))
    sent = distinct.sparkSession.sparkContext.broadcast((centres, reach_of))
    cells = [StructField("home", IntegerType()), StructField("guest_of", ArrayType(IntegerType()))]
    schema = StructType([*distinct.schema.fields, *cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach_of = sent.value
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)) if len(centres) else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column("vector")
                homes, guests = np.zeros(len(vectors), np.int32), [[]] * len(vectors)
                lengths = np.diff(vectors.offsets.to_numpy())
                own = np.flatnonzero(lengths == centres.shape[1]) if len(centres) else []
                if len(own):
                    flat = vectors.filter(pa.array(lengths == centres.shape[1])).flatten().to_numpy()
                    near = flat.reshape(len(own), -1) @ centres.T
                    home = near.argmax(1)
                    homes[own] = home
                    # distance to the bisecting plane is (x.h - x.c) / |h - c|
                    margin = near[np.arange(len(own)), home][:, None] - near
                    reach = (margin <= chord * apart[home] + 1e-9) & (near >= reach_of)
                    reach &= np.arange(len(centres)) > home[:, None]
                    for i, row in zip(own, reach):
                        guests[i] = np.flatnonzero(row).tolist()
                columns = [*batch.columns, pa.array(homes), pa.array(guests, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return distinct.mapInArrow(run, schema)


def _linked(cosines: np.ndarray, threshold: float) -> np.ndarray:
    return cosines >= threshold


def _roots(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row it is connected to."""
    n = len(links)
    links = links | np.eye(n, dtype=bool)
    roots = links.argmax(1)
    while True:
        reached = np.where(links, roots[None, :], n).min(1)
        reached = reached[reached]
        if (reached == roots).all():
            return roots
        roots = reached


def _compare(threshold: float, names: list[str]):
    """Compares the two blocks (sides 0 and 1) of a unit, or one block with itself."""

    def run(unit_rows: pa.Table) -> pa.Table:
        side = unit_rows.column("side").to_numpy()
        length = len(unit_rows.column("vector")[0])
        flat = unit_rows.column("vector").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(-1, length)
        copies = unit_rows.column("copies").to_numpy()
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = len(side)
        links = np.zeros((n, n), bool)
        if len(second):
            links[np.ix_(first, second)] = _linked(vectors[first] @ vectors[second].T, threshold)
            links |= links.T
        else:
            links = _linked(vectors @ vectors.T, threshold)
            np.fill_diagonal(links, False)
        counts = links.astype(np.float64) @ copies.astype(np.float64)
        some = np.flatnonzero(links.any(1))
        nodes = unit_rows.column("node").combine_chunks()
        roots = _roots(links)[some] if len(some) else some
        columns = [nodes.take(pa.array(some)), nodes.take(pa.array(roots)), pa.array(counts[some].astype(np.int64))]
        return pa.Table.from_arrays(columns, names=names)

    return run


def _units(placed: DataFrame) -> DataFrame:
    """One row per vector and unit of work: (label, dim, cell, first, second, side, ...).

    Home blocks are numbered from 0, guest blocks from -1 downwards.
    """
    keep = ["node", "copies", "vector", "label", "dim"]
    homes = placed.select(*keep, F.col("home").alias("cell"), F.lit(True).alias("at_home"))
    guests = placed.select(*keep, F.explode("guest_of").alias("cell"), F.lit(False).alias("at_home"))
    rows = homes.unionAll(guests)
    place = ["label", "dim", "cell"]
    at_home = F.col("at_home").cast("long")
    sizes = rows.groupBy(*place).agg(F.sum(at_home).alias("h"), F.sum(1 - at_home).alias("g"))
    blocks = [F.ceil(F.col(c) / BLOCK_VECTORS).cast("int").alias(f"{c}_blocks") for c in "hg"]
    sizes = sizes.where("h > 0").select(*place, *blocks)
    cut = rows.join(sizes, place).withColumn(
        "own",
        F.pmod(F.xxhash64("node"), F.when(F.col("at_home"), F.col("h_blocks")).otherwise(F.col("g_blocks"))).cast("int"),
    )

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def unit(first: Column, second: Column, side: Column) -> Column:
        return F.struct(first.alias("first"), second.alias("second"), side.alias("side"))

    own = F.col("own")
    home_units = F.concat(
        F.transform(
            upto(F.col("h_blocks")),
            lambda b: unit(F.least(b, own), F.greatest(b, own), (b < own).cast("int")),
        ),
        F.transform(upto(F.col("g_blocks")), lambda b: unit(own, -1 - b, F.lit(0))),
    )
    guest_units = F.transform(upto(F.col("h_blocks")), lambda b: unit(b, -1 - own, F.lit(1)))
    units = F.explode(F.when(F.col("at_home"), home_units).otherwise(guest_units)).alias("unit")
    return cut.select(*place, units, "node", "copies", "vector").select(*place, "unit.*", "node", "copies", "vector")


def vector_dedup(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links between vectors of one label by cosine, and their components.

    Returns per row (id, n_links, component_id, kept): how many other rows are linked
    directly, the smallest id reachable, and whether that is the row's own. Every pair at
    or above ``threshold`` counts. Rows whose label or vector is null, whose vector is
    empty, zero, or holds nulls or non-finite numbers, and vectors of different lengths
    are linked with nothing. Equal rows are copies of one vector and linked; an empty
    table gives an empty result; other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")
    ).withColumn("usable", F.col("label").isNotNull() & _usable(F.col("vector")))
    keyed = rows.where("usable").withColumn(
        "key", F.md5(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))))
    )
    distinct = written(
        keyed.groupBy("label", F.size("vector").alias("dim"), "key").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")
        ),
        "vectors",
    )
    per_length = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    total, dim = (per_length["count"], per_length["dim"]) if per_length else (0, 0)
    share = min(1.0, FIT_VECTORS / max(total, 1))
    drawn = F.shiftrightunsigned(F.xxhash64("key"), 11) < int(share * (1 << 53))
    sample = distinct.where((F.col("dim") == dim) & drawn).select("key", "vector").toPandas().sort_values("key")
    cells = min(MAX_CELLS, max(1, total // VECTORS_PER_CELL))
    centres = spherical_kmeans(np.stack(sample["vector"]), cells) if len(sample) else np.zeros((0, 0))

    chord = float(np.sqrt(2 - 2 * threshold))
    scaled = F.transform("vector", lambda x: x / F.array_max(F.transform("vector", F.abs)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    node = F.struct(F.col("id"), F.concat_ws(":", "key", "label").alias("key")).alias("node")
    units_of = distinct.select("label", "dim", "copies", node, scaled.alias("vector")).withColumn(
        "vector", F.transform("vector", lambda x: x / norm)
    )
    units_of = written(units_of, "unit-vectors")
    units = _units(written(_cells(units_of, centres, chord), "cells"))
    node_type = units.schema["node"]
    schema = StructType(
        [StructField("a", node_type.dataType), StructField("b", node_type.dataType), StructField("n", LongType())]
    )
    work = ["label", "dim", "cell", "first", "second"]
    found = written(units.groupBy(*work).applyInArrow(_compare(threshold, schema.names), schema), "cosines")

    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("a", "b"))
    known = (
        distinct.select("label", "dim", "key", "copies", node)
        .join(degrees, "node", "left")
        .join(roots, "node", "left")
        .select(
            "label",
            "dim",
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component.id", "node.id").alias("component_id"),
        )
    )
    known = written(known, "vector-components")
    linked = keyed.withColumn("dim", F.size("vector")).join(known, ["label", "dim", "key"])
    alone = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long"), "id")
    out = linked.select("id", "n_links", "component_id").unionAll(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
