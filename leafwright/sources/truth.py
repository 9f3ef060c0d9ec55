"""Ground truth as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABELS, TRUTH_COLUMNS


def load_ground_truth(spark: SparkSession, path: str, package_id: str = "package", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Truth rows with columns by name; empty fields are null. Raises ValueError that counts rows (the header is row 1).

    ``page_number`` and ``doc_type`` must be there, ``source_document`` and ``source_page`` may be; a file with ``package_id`` covers many packages.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    extra = {c: F.lit(None).cast("string") for c in TRUTH_COLUMNS[2:] if c not in raw.columns}
    if "package_id" not in raw.columns:
        extra["package_id"] = F.lit(package_id)
    if missing := [c for c in TRUTH_COLUMNS[:2] if c not in raw.columns]:
        raise ValueError(f"Ground truth has no column {missing[0]}")
    raw = raw.withColumns(extra)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = raw.select("package_id", F.col("page_number").try_cast("int").alias("page_number"), "doc_type", blank("source_document").alias("source_document"), blank("source_page").alias("_page"), F.col("page_number").alias("_raw"))
    rows = rows.withColumn("source_page", F.col("_page").try_cast("int"))
    good = (F.col("page_number") >= 1) & F.col("doc_type").isin(*labels) & (F.col("_page").isNull() | (F.col("source_page") >= 1))
    bad = rows.where(~F.coalesce(good, F.lit(False)))
    if not bad.isEmpty():
        # Only now, for the message, rows are numbered: those before the first bad one are counted.
        placed = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_ok", F.coalesce(good, F.lit(False)))
        row = placed.where("not _ok").orderBy("_at").first()
        number = placed.where(F.col("_at") < row["_at"]).count() + 2
        raise ValueError(f"Invalid ground truth row {number}: page_number={row['_raw']!r}, doc_type={row['doc_type']!r}")
    return rows.select("package_id", "page_number", "doc_type", "source_document", "source_page")
