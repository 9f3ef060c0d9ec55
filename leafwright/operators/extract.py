"""Per-page extraction: text length, page markers and identifiers, all native and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.regexes import Translated
from ..plans.rulepack import RulePack

_MARKER = "struct<style:string,page:int,total:int>"


def _hits(text: Column, rules: RulePack) -> dict[str, Column]:
    """What each marker and identifier pattern hits first, one scan of the text each."""
    found = [(f"_marker{i}", m.pattern) for i, m in enumerate(rules.markers)] + [(f"_identifier{i}", x.pattern) for i, x in enumerate(rules.identifiers)]
    return {name: F.regexp_substr(text, F.lit(pattern.pattern)) for name, pattern in found}


def _group(hit: str, text: Column, pattern: Translated, group: int) -> Column:
    """A group of the first hit, null without one; read out of the hit, unless the pattern looks beyond it."""
    column = F.col(hit)
    return F.when(column.isNotNull(), F.regexp_extract(text if pattern.looks_around else column, pattern.pattern, group))


def _marker(text: Column, rules: RulePack, strict: bool) -> Column:
    found = []
    for i, m in enumerate(rules.markers):
        page = _group(f"_marker{i}", text, m.pattern, m.page).try_cast("int")
        total = _group(f"_marker{i}", text, m.pattern, m.total).try_cast("int") if m.total else F.lit(None).cast("int")
        keeps = page.isNotNull()
        if m.total:
            keeps = keeps & total.isNotNull() & (total <= rules.max_total)
            if rules.reject_page_over_total:
                keeps = keeps & (page <= total)
        found.append(F.when(keeps, F.struct(F.lit(m.style).alias("style"), page.alias("page"), total.alias("total"))))
    none = F.struct(F.lit("NONE").alias("style"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("total"))
    hit = F.coalesce(*found, none)
    zero = F.raise_error(F.lit("a page marker has page number 0")).cast(_MARKER) if strict else none
    return F.when(hit["page"] < 1, zero).otherwise(hit)


def with_markers(rows: DataFrame, text_col: str, rules: RulePack, strict: bool = False) -> DataFrame:
    """Adds ``marker``, ``struct(style, page, total)`` of the first pattern, by priority, whose first hit keeps the limits, and ``raw_identifiers``, a
    map of identifier names to the first group of their first hits, from which names without a hit are absent.

    A page number of 0 is no marker; with ``strict`` it fails the query instead. Digits that aren't ASCII don't count.
    """
    text, hits = F.col(text_col), _hits(F.col(text_col), rules)
    pairs = [x for i, own in enumerate(rules.identifiers) for x in (F.lit(own.name), _group(f"_identifier{i}", text, own.pattern, 1))]
    named = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.withColumns(hits).withColumns({"marker": _marker(text, rules, strict), "raw_identifiers": named}).drop(*hits)


def extract_pages(raw: DataFrame, rules: RulePack, strict: bool = False) -> DataFrame:
    """Adds ``normalized_text_length``, ``marker_style``, ``marker_page``, ``marker_total`` and ``raw_identifiers`` to raw pages.

    Needs ``package_id, page_number, text``; ``rotation`` and ``image_count`` default to 0. Null text counts as empty.
    """
    extra = {c: F.lit(0) for c in ("rotation", "image_count") if c not in raw.columns}
    pages = raw.withColumns(extra | {"text": F.coalesce("text", F.lit(""))})
    pages = with_markers(pages, "text", rules, strict).withColumn("normalized_text_length", t.normalized_length("text"))
    return pages.withColumns({"marker_style": F.col("marker.style"), "marker_page": F.col("marker.page"), "marker_total": F.col("marker.total")}).drop("marker")


def summary(pages: DataFrame) -> DataFrame:
    """One row per page without its text, for listings."""
    return pages.select("package_id", "page_number", "normalized_text_length", "rotation", "image_count", "marker_style", "marker_page", "marker_total", F.array_sort(F.map_keys("raw_identifiers")).alias("identifier_names"))
