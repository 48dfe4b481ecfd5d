"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyline.session import scratch_dir

#: Largest file a driver reads whole in order to send it to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: The five words of a shingle.
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{scratch_dir(spark)}/tallyline-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: later jobs read files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._scratch_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote, once no other plan reads it any more."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_scratch_path", None)
        if path:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def field(df: DataFrame, column: str, name: str | None = None) -> StructField:
    """The field of ``column``, for the schema of a Python operator's output."""
    return StructField(name or column, df.schema[column].dataType, True)


def read_vocabulary(path: str) -> bytes:
    """A tokenizer's file, which the driver sends along with the tasks."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def release_memory() -> None:
    """Hands memory that this process has freed back to the machine, where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for the batches of a task, after which its worker keeps no freed memory.

    Workers wait for further tasks, also of other operators; what one task needed would
    otherwise stay with them and add up over the stages of a pipeline.
    """

    def run_and_release(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return run_and_release


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[StructField],
    start: Callable[[], Callable[[list[str]], list[list]]],
    chunk: int = 256,
) -> DataFrame:
    """Columns computed in Python from each row's text, beside the row's id.

    ``start`` runs once per task and returns a function from a list of texts (null
    as empty) to one list per field. Texts go through it ``chunk`` rows at a time, so
    that what it holds doesn't grow with Arrow's batches.
    """
    schema = StructType([field(df, id_col), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute, arrow = start(), None
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                columns = compute([t or "" for t in part.column(1).to_pylist()])
                if arrow is None:
                    from pyspark.sql.pandas.types import to_arrow_schema

                    arrow = to_arrow_schema(schema)
                arrays = [part.column(0).cast(arrow.field(0).type)]
                arrays += [pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    texts = F.col(text_col).cast("string").alias("__text")
    return df.select(F.col(id_col).alias("__id"), texts).mapInArrow(trimmed(run), schema)
