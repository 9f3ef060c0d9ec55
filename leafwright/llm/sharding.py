"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scope, text_of, written

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def balanced_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """Gives every row of ``docs`` a contiguous shard of nearly equal bytes.

    Rows are ordered by (id, text CRC, size, place in the input), dealt by range, and written with their partition number;
    one small row per partition carries its totals, whose prefix sums place every row on the global
    byte line. A row goes to the shard in which its middle byte lies, so that two shards differ by
    less than about one row. Only id, size and CRC are shuffled, never the text.

    Returns ``(id, size, text_crc32, law, shard, slot, grown_shard)``. Null text counts as empty;
    null ids come first; repeated rows each get their own slot; an empty table gives no rows.
    Other columns of ``docs``, whatever their names, are not read.
    """
    with scope() as keep:
        text = text_of(text_col)
        rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + row_bytes).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.monotonically_increasing_id().alias("_row"))
        keys = ["_id", "_crc", "_size", "_row"]  # the last, where a row stands in the input, lets ranges divide repeated rows
        dealt = keep(written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "shards"))

        # One row per partition: bounded by the number of partitions, whatever the data.
        totals = dealt.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
            F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
        )
        inside = Window.partitionBy("_part").orderBy(*keys)
        placed = (
            dealt.withColumn("_upto", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_nth", F.row_number().over(inside))
            .join(F.broadcast(starts), "_part")
            .select(
                "_id", "_crc", "_size",
                (F.col("_row0") + F.col("_nth") - 1).alias("_index"),
                F.expr(f"cast(least({n_shards - 1}, ((2 * (_byte0 + _upto) - _size) * {n_shards}) div (2 * _all)) as int)").alias("_shard"),
            )
        )
        # At most n_shards rows.
        firsts = placed.groupBy("_shard").agg(F.min("_index").alias("_first"))
        return placed.join(F.broadcast(firsts), "_shard").select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.col("_shard").alias("shard"),
            (F.col("_index") - F.col("_first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
