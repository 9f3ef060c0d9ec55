"""Ground truth by content hash: shuffled pages joined to the pages they were taken from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.materialise import materialised, scope

#: Most offending rows that an error names; counts are always complete.
NAMED = 50


def hashed(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``hash`` and drops the text, so that it isn't shuffled."""
    return pages.withColumn("hash", t.text_hash(F.coalesce(text_col, F.lit("")))).drop(text_col)


def _by_hash(sources: DataFrame) -> DataFrame:
    """A row per package and hash: how many source pages have it, and the first and last of them."""
    page = F.struct("label", "source_page")
    return sources.groupBy("package_id", "hash").agg(F.count("*").alias("n"), F.min(page).alias("first"), F.max(page).alias("last"))


def source_collisions(sources: DataFrame) -> DataFrame:
    """Hashes that more than one source page of a package has: how many, and the first and last of them. ``sources``: ``(package_id, label, source_page, hash)``."""
    return _by_hash(sources).where("n > 1")


def matches(shuffled: DataFrame, sources: DataFrame) -> DataFrame:
    """``(package_id, page_number, label, source_page, candidates)`` of pages whose hash a source page has.

    One row per shuffled page: its first source page, and how many there are. Sources meet it as one row a hash, so that
    pages without text, which are all equal, aren't paired with each other.
    """
    found = shuffled.join(_by_hash(sources), ["package_id", "hash"])
    return found.select("package_id", "page_number", F.col("first.label").alias("label"), F.col("first.source_page").alias("source_page"), F.col("n").alias("candidates"))


def unmatched(shuffled: DataFrame, sources: DataFrame) -> DataFrame:
    """Shuffled pages that no source page equals."""
    return shuffled.join(sources, ["package_id", "hash"], "left_anti").select("package_id", "page_number")


def multiple_claims(matched: DataFrame) -> DataFrame:
    """Source pages that more than one shuffled page matched: how many, and the first and last of them."""
    return matched.groupBy("package_id", "label", "source_page").agg(F.count("*").alias("n"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page")).where("n > 1")


def unequal_counts(shuffled: DataFrame, sources: DataFrame) -> DataFrame:
    """Packages that haven't as many source pages as shuffled ones, with both counts."""
    counts = shuffled.groupBy("package_id").agg(F.count("*").alias("shuffled"))
    totals = sources.groupBy("package_id").agg(F.count("*").alias("source"))
    both = counts.join(totals, "package_id", "full").select("package_id", F.coalesce("shuffled", F.lit(0)).alias("shuffled"), F.coalesce("source", F.lit(0)).alias("source"))
    return both.where("shuffled != source")


def incomplete_numbers(matched: DataFrame, expected: DataFrame) -> DataFrame:
    """Packages whose matched pages aren't exactly 1 to the count in ``expected (package_id, n)``."""
    got = matched.groupBy("package_id").agg(F.min("page_number").alias("low"), F.max("page_number").alias("high"), F.count("*").alias("rows"), F.count_distinct("page_number").alias("pages"))
    exact = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("rows") == F.col("n")) & (F.col("pages") == F.col("n"))
    return expected.join(got, "package_id", "left").where(~F.coalesce(exact, F.col("n") == 0))


def _none(bad: DataFrame, message: str) -> None:
    rows = bad.limit(NAMED).collect()
    if rows:
        raise ValueError(f"{message} ({bad.count()}): {[tuple(r) for r in rows]}")


def ground_truth(shuffled: DataFrame, sources: DataFrame, documents: dict[str, str] | None = None) -> DataFrame:
    """Truth rows for every shuffled page, or a ValueError for what stands in the way.

    ``shuffled``: ``(package_id, page_number, text)``; ``sources``: ``(package_id, label, source_page, text)``; ``documents`` names the
    file of each label. Checked in order: equal counts, no equal source pages, no page without a source, no source page claimed twice,
    page numbers complete.
    """
    names = F.create_map(*(F.lit(x) for pair in documents.items() for x in pair)) if documents else None
    name = F.try_element_at(names, F.col("label")) if names is not None else F.lit(None).cast("string")
    with scope() as keep:
        left, right = materialised(hashed(shuffled), "shuffled"), materialised(hashed(sources), "sources")
        _none(unequal_counts(left, right), "Total source page count does not equal shuffled page count")
        _none(source_collisions(right), "Source page hash collisions")
        _none(unmatched(left, right), "Shuffled pages that match no source page")
        found = keep(materialised(matches(left, right), "matches"))
        _none(multiple_claims(found), "Source pages matched by more than one shuffled page")
        _none(incomplete_numbers(found, left.groupBy("package_id").agg(F.count("*").alias("n"))), "Matched page numbers are not complete")
    return found.select("package_id", "page_number", F.col("label").alias("doc_type"), name.alias("source_document"), "source_page")


def label_distribution(truth: DataFrame) -> DataFrame:
    return truth.groupBy("doc_type").agg(F.count("*").alias("n"))
