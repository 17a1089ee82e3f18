"""What the corpus operators share: document columns, scratch tables and size arithmetic."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import release as release_shuffles
from tidemark.sources.scratch import scratch_dir, stored

__all__ = ["SPACE", "documents", "id_and_text", "lean", "lean_batches", "pieces", "release", "release_shuffles", "scratch_dir", "stored", "text_bytes"]

#: White space between words: U+0020 and U+0009 to U+000D. bytes.split() uses the same six characters.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; other columns, whatever their names, stay behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one scan that returns one row."""
    return int(docs.select(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"])


def pieces(total: int, each: int, least: int = 1) -> int:
    """Number of pieces of about `each` bytes."""
    return max(least, math.ceil(total / each))


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's way to give freed memory back, where it has one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Gives back what a Python worker has freed: workers stay for later tasks, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """f for a group or two cogroups, with the memory released behind each."""
    if f.__code__.co_argcount == 2:  # Spark counts the arguments

        def two(a: pa.Table, b: pa.Table) -> pa.Table:
            try:
                return f(a, b)
            finally:
                release()

        return two

    def one(a: pa.Table) -> pa.Table:
        try:
            return f(a)
        finally:
            release()

    return one


def lean_batches(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for a partition's batches, with the memory released at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run
