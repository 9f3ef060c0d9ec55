"""Physical runs, instance numbers and reconstructed documents. Every window and group starts from ``package_id``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.rulepack import RulePack


def numbered(prefix: str, number: Column) -> Column:
    """``PG001`` and so on; more digits where three don't do."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def physical_groups(results: DataFrame) -> DataFrame:
    """Runs of consecutive pages with the same label: gaps and islands, one shuffle by package."""
    order = Window.partitionBy("package_id").orderBy("page_number")
    new = ~((F.col("page_number") == F.lag("page_number").over(order) + 1) & (F.col("doc_type") == F.lag("doc_type").over(order)))
    runs = results.select("package_id", "page_number", "doc_type").withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(order))
    groups = runs.groupBy("package_id", "run").agg(
        F.first("doc_type").alias("doc_type"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"), F.count("*").cast("int").alias("page_count"), F.array_sort(F.collect_list("page_number")).alias("physical_pages")
    )
    return groups.select("package_id", numbered("PG", F.col("run")).alias("group_id"), "doc_type", "start_page", "end_page", "page_count", "physical_pages")


def _named(names: tuple[str, ...]) -> Column:
    return F.filter(F.map_entries("raw_identifiers"), lambda e: e["key"].isin(*names))


def scoped_values(rules: RulePack) -> Column:
    """The identifiers that count for the page's own label, sorted by name; null if there are none."""
    kept = None
    for label, names in rules.scopes().items():
        if names:
            own = _named(names)
            kept = F.when(F.col("doc_type") == label, own) if kept is None else kept.when(F.col("doc_type") == label, own)
    if kept is None:
        return F.lit(None).cast("array<struct<key:string,value:string>>")
    return F.when(F.size(kept) > 0, F.array_sort(kept))


def assign_instances(results: DataFrame, rules: RulePack, order_col: str = "emit_order") -> DataFrame:
    """Adds ``instance_id``: ``LABEL#n`` for equal labels and scoped identifiers, numbered by first appearance in ``order_col``."""
    same = Window.partitionBy("package_id", "doc_type", "_values")
    rows = results.withColumn("_values", scoped_values(rules)).withColumn("_first", F.when(F.col("_values").isNotNull(), F.min(order_col).over(same)))
    number = F.dense_rank().over(Window.partitionBy("package_id", "doc_type").orderBy(F.col("_first").asc_nulls_last()))
    return rows.withColumn("instance_id", F.when(F.col("_values").isNotNull(), F.concat("doc_type", F.lit("#"), number.cast("string")))).drop("_values", "_first")


def flag_orphans(results: DataFrame) -> DataFrame:
    """Adds ``tier`` (1 identifier and marker, 2 marker alone, null orphan) and ``is_orphan``; orphans get a warning."""
    tier = F.when(F.col("marker_page").isNotNull() & F.col("instance_id").isNotNull(), 1).when(F.col("marker_page").isNotNull() & (F.col("marker_style") != "NONE"), 2)
    rows = results.withColumn("tier", tier).withColumn("is_orphan", F.col("tier").isNull())
    return rows.withColumn("warnings", F.when(F.col("is_orphan"), F.array_append("warnings", F.lit("ORPHAN_PAGE"))).otherwise(F.col("warnings")))


KEY = ("doc_type", "instance_id", "marker_style", "marker_total")


def reconstruct(flagged: DataFrame) -> DataFrame:
    """Documents from pages that share label, instance, marker style and total; nulls are equal.

    Each document has its observed, missing and duplicate logical pages, links to physical pages, completeness and issues.
    Duplicates are kept and flagged; keys that differ in the total alone are flagged as conflicting.
    """
    pages = flagged.where(~F.col("is_orphan")).select("package_id", *KEY, "page_number", "marker_page", "tier")
    link = F.struct(F.col("page_number").alias("physical_page"), F.col("marker_page").alias("logical_page"))
    docs = pages.groupBy("package_id", *KEY).agg(
        F.array_sort(F.collect_list("marker_page")).alias("observed_logical_pages"),
        F.array_sort(F.collect_list(link)).alias("_links"),
        F.min("page_number").alias("_first"),
        F.min(F.when(F.col("marker_page") == 1, F.col("page_number"))).alias("first_page_at"),
        F.min_by("page_number", F.struct(-F.col("marker_page"), "page_number")).alias("last_page_at"),
        F.max("tier").alias("_tier"),
    )
    docs = docs.repartition("package_id")  # which serves both windows; documents are few beside pages
    triple = Window.partitionBy("package_id", "doc_type", "instance_id", "marker_style")
    observed = F.col("observed_logical_pages")
    twice = F.array_distinct(F.filter(observed, lambda p, i: (i > 0) & (F.get(observed, i - 1) == p)))
    expected = F.col("marker_total")
    docs = docs.withColumns({
        "_totals": F.size(F.collect_set(F.coalesce(expected, F.lit(-1))).over(triple)),
        "duplicate_logical_pages": twice,
        # sequence(1, 0) counts down, so a total below 1 has no pages.
        "missing_logical_pages": F.when(expected >= 1, F.array_except(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), observed)).otherwise(F.array().cast("array<int>")),
    })
    evidence = F.when(F.col("_tier") == 2, F.lit("marker_match_within_unique_instance")).otherwise(F.lit("identifier_and_marker_match"))
    docs = docs.withColumns({
        "completeness": F.when(expected.isNull(), F.lit("UNKNOWN_EXTENT")).when(F.size("missing_logical_pages") == 0, F.lit("COMPLETE")).otherwise(F.lit("INCOMPLETE")),
        "issues": F.array_compact(F.array(
            F.when(F.size("duplicate_logical_pages") > 0, F.lit("DUPLICATE_PAGE")), F.when(F.col("_tier") == 2, F.lit("AMBIGUOUS_ATTACHMENT")), F.when(F.col("_totals") > 1, F.lit("CONFLICTING_MARKER_TOTAL")),
        )),
        "page_links": F.transform("_links", lambda x: F.struct(x["physical_page"].alias("physical_page"), x["logical_page"].alias("logical_page"), F.array(evidence).alias("evidence"))),
        "_nr": F.row_number().over(Window.partitionBy("package_id").orderBy("_first")),
    })
    physical = F.transform("_links", lambda x: x["physical_page"])
    return docs.select(
        "package_id", numbered("RD", F.col("_nr")).alias("doc_id"), "doc_type", "instance_id", "marker_style", expected.alias("expected_pages"), "observed_logical_pages", "missing_logical_pages",
        "duplicate_logical_pages", "first_page_at", "last_page_at", t.span(physical).alias("physical_span"), t.contiguous(physical).alias("is_contiguous"), "completeness", "issues", "page_links",
    )


def orphans(flagged: DataFrame) -> DataFrame:
    """Orphaned pages and what evidence they lack."""
    reason = F.when(F.col("marker_page").isNull(), F.lit("no marker_page")).otherwise(F.lit("no instance_id, no marker style"))
    return flagged.where("is_orphan").select("package_id", "page_number", "doc_type", reason.alias("reason"))


def group_pages(results: DataFrame, rules: RulePack, order_col: str = "emit_order", keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(results with instances and orphans, physical groups, documents)``; ``keep`` may write the first, from which the others derive."""
    flagged = flag_orphans(assign_instances(results, rules, order_col))
    flagged = keep(flagged) if keep else flagged
    return flagged, physical_groups(flagged), reconstruct(flagged)
