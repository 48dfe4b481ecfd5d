"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_BYTES_PER_REDUCER = 1 << 24
_MOST_REDUCERS = 32_000
_MOST_SCAN_TASKS = 100_000
_ROWS_PER_FILE_BYTE = 8.0
_HASHED_BYTES = 1 << 22
_SPARKS_BROADCAST = "10485760b"
_BROADCAST_BYTES = 1 << 25


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def absolute(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and working directory made explicit."""
    fs, hadoop_path = _file_system(spark, path)
    return fs.makeQualified(hadoop_path).toString()


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of everything under ``path``, from the file system's own summary."""
    fs, hadoop_path = _file_system(spark, path)
    return fs.getContentSummary(hadoop_path).getLength() if fs.exists(hadoop_path) else 0


def put_in_place(spark: SparkSession, beside: str, path: str) -> None:
    """Move the written folder ``beside`` to ``path``, replacing what is there."""
    fs, target = _file_system(spark, path)
    _, source = _file_system(spark, beside)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not move {beside} to {path}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path``, if it is there."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def _size(text: str) -> int:
    """Bytes of a Spark size setting such as '128MB' or '134217728b'."""
    digits = "".join(c for c in text if c.isdigit())
    unit = text[len(digits) :].strip().lower().rstrip("b")[:1]
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def tune(spark: SparkSession, *paths: str) -> SparkSession:
    """Turn on run-time re-planning and size tasks for the input under ``paths``.

    * Joins on a key that may be hot rely on adaptive skew splitting: the hot
      partition is cut by map output and its other side re-read per piece.
      ``forceOptimizeSkewedJoin`` lets that happen below an aggregation as well,
      at the price of one more exchange, paid only when skew was seen.
    * Adaptive execution merges small shuffle partitions but never adds any, so
      the starting number grows with the input. Scan splits grow with it too, to
      bound the number of map tasks. The session's own settings are lower bounds.
    * A scan is broadcast if its estimated size is under
      ``spark.sql.autoBroadcastJoinThreshold``. The estimate is the file size, but
      encoded columns take several times that as rows in memory, so the factor
      between the two is raised to what our feeds show. Where the session leaves the
      threshold at its default it becomes 32 MB: it spares the items, hundreds of times
      as many, a shuffle for a few hundred thousand sellers.
    * A query's shuffle files are removed when it ends; otherwise they stay until the
      driver happens to collect garbage, and a build holds those of all its tables.
    * Parquet is written with zstd where the session leaves the default: the surrogate
      keys are hex digits, which snappy does not shrink.
    """
    conf = spark.conf
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if conf.get("spark.sql.parquet.compression.codec") == "snappy":
        conf.set("spark.sql.parquet.compression.codec", "zstd")
    factor = float(conf.get("spark.sql.sources.fileCompressionFactor"))
    conf.set("spark.sql.sources.fileCompressionFactor", str(max(factor, _ROWS_PER_FILE_BYTE)))
    if conf.get("spark.sql.autoBroadcastJoinThreshold") == _SPARKS_BROADCAST:
        conf.set("spark.sql.autoBroadcastJoinThreshold", str(_BROADCAST_BYTES))
    total = sum(input_bytes(spark, path) for path in paths)
    reducers = min(-(-total // _BYTES_PER_REDUCER), _MOST_REDUCERS)
    configured = int(conf.get("spark.sql.shuffle.partitions"))
    conf.set(
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        str(max(reducers, configured)),
    )
    split = total // _MOST_SCAN_TASKS
    if split > _size(conf.get("spark.sql.files.maxPartitionBytes")):
        conf.set("spark.sql.files.maxPartitionBytes", str(split))
    return spark


@contextmanager
def small_sides_by_hash(spark: SparkSession, wanted: bool = True) -> Iterator[None]:
    """Meanwhile a shuffled join whose one side has no partition over 4 MB hashes that side
    instead of sorting both, as dimensions allow. Spark wants partitions to be merged up to
    no more than that, too; a larger or skewed side is sorted as before."""
    conf = spark.conf
    merged, most = (
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold",
    )
    before = {key: conf.get(key, None) for key in (merged, most)}
    try:
        if wanted:
            conf.set(merged, str(min(_size(conf.get(merged)), _HASHED_BYTES)))
            conf.set(most, str(max(_size(conf.get(most)), _HASHED_BYTES)))
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for tables written between jobs.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session falls
    back to a temporary folder: executors elsewhere could not see one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="tallyline-")
