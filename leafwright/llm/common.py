"""Helpers shared by the corpus operators: intermediate tables, prefix sums, counted broadcasts and column picking."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import forget, materialised, scope

__all__ = ["BROADCAST_IDS", "BROADCAST_ROWS", "exclusive_prefix", "forget", "release", "scope", "small", "text_of", "written"]

#: Rows up to which a *counted* table may be broadcast (about 25 MB of narrow rows).
BROADCAST_ROWS = 200_000
#: The same for tables of one or two numbers a row (about 40 MB as a hash table).
BROADCAST_IDS = 1_000_000

written = materialised


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows by count; otherwise as it is.

    ``df`` should be a written table, for it is counted.
    """
    return F.broadcast(df) if df.count() <= limit else df


def text_of(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def release() -> None:
    """Gives memory that a Python worker has freed back to the system, for the worker is used again by other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # no glibc


def exclusive_prefix(df: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows with a smaller ``key`` (dense whole numbers, no repeats).

    Two levels, so that no task holds all keys: sums inside blocks of ``block`` keys, then sums of
    the block totals (``1/block`` of the rows).
    """
    rows = df.withColumn("_block", F.floor(F.col(key) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_block").agg(F.sum(value).alias("_total")).select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "_block").withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_start")).drop("_block", "_start")
