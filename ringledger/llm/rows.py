"""What the operators share: Arrow tasks over bounded runs of text, and what of a document they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import ringledger.llm

# Tasks carry this package's functions with them: executors need no copy of it.
cloudpickle.register_pickle_by_value(ringledger.llm)

#: Text handled at once inside a task.
CHUNK_BYTES = 4 << 20


def batches(found: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts come to about ``limit`` characters, with the texts."""
    for batch in found:
        column = batch.column(text)
        at = 0
        while at < batch.num_rows:
            size, end = 0, at
            while end < batch.num_rows and (size < limit or end == at):
                size += _length(column, end)
                end += 1
            part = batch.slice(at, end - at)
            yield part, [x or "" for x in part.column(text).to_pylist()]
            at = end


def _length(column: pa.Array, at: int) -> int:
    value = column[at]
    return value.as_buffer().size if value.is_valid else 0


def map_arrow(df: DataFrame, build: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """``build()`` runs once in each task and gives the function over its batches.

    Python workers outlive their tasks, so a task gives back what its batches have taken.
    """

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from build()(found)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(docs: DataFrame) -> DataFrame:
    """Only the columns that operators on whole texts read; others may clash with theirs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]
