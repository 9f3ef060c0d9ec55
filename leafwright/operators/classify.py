"""Weighted keyword scoring, arg-max and the decision which pages to delegate: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rulepack import RulePack


def _total(parts: list[Column]) -> Column:
    """A balanced sum, so that packs of many signals don't nest deeply."""
    if not parts:
        return F.lit(0.0)
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def classify(pages: DataFrame, rules: RulePack, text_col: str = "text", length_col: str = "normalized_text_length") -> DataFrame:
    """Adds the rule decision of every page.

    ``rule_doc_type, rule_score, rule_margin, matched_class_count, matched_signals, rule_scores, strong_classes,
    strong_signature_matched, delegation_reasons, delegate`` and ``doc_type, decision_source, llm_*, warnings`` as they
    stand before anything is delegated. A class's share is its weight of hits over all classes' weight; the largest share wins,
    ties go to the class that the pack names first; the score is the share times the winner's weight up to saturation.
    """
    fold = (lambda s: s) if rules.case_sensitive else str.lower
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.withColumn("_text", text if rules.case_sensitive else F.lower(text))
    has = lambda signal: F.contains(F.col("_text"), F.lit(fold(signal)))
    scored = [c for c in rules.classes if c.strong or c.weak]

    raw, signals, strongs = {}, [], []
    for n, c in enumerate(scored):
        raw[f"_raw{n}"] = _total([F.when(has(s), rules.strong_weight).otherwise(0.0) for s in c.strong] + [F.when(has(s), rules.weak_weight).otherwise(0.0) for s in c.weak])
        signals += [F.when(has(s), F.lit(s)) for s in (*c.strong, *c.weak)]
        strongs.append(F.when(_any([has(s) for s in c.strong]), F.lit(c.label)))
    empty = F.array().cast("array<string>")
    rows = rows.withColumns(raw | {"matched_signals": F.array_compact(F.array(*signals)) if signals else empty, "strong_classes": F.array_compact(F.array(*strongs)) if strongs else empty})

    sums = _total([F.greatest(F.col(f"_raw{n}"), F.lit(0.0)) for n in range(len(scored))])
    every = F.array(*(F.struct(F.col(f"_raw{n}").alias("raw"), F.lit(n).alias("nr"), F.lit(c.label).alias("label")) for n, c in enumerate(scored))) if scored else F.array().cast("array<struct<raw:double,nr:int,label:string>>")
    rows = rows.withColumns({"_sum": sums, "_hits": F.filter(every, lambda x: x["raw"] > 0)})
    ranked = F.array_sort(F.transform("_hits", lambda x: F.struct((-(x["raw"] / F.col("_sum"))).alias("minus"), x["nr"].alias("nr"), x["label"].alias("label"), x["raw"].alias("raw"))))
    rows = rows.withColumn("_ranked", ranked).drop("_sum", "_hits", "_text", *raw)
    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    label = F.coalesce(first["label"], F.lit(rules.fallback))
    rows = rows.withColumns({
        "rule_doc_type": label,
        "rule_score": F.coalesce(-first["minus"] * F.least(F.lit(1.0), first["raw"] / rules.saturation), F.lit(0.0)),
        "rule_margin": F.coalesce(-first["minus"] + F.coalesce(second["minus"], F.lit(0.0)), F.lit(0.0)),
        "matched_class_count": F.size("_ranked"),
        "rule_scores": F.map_from_entries(F.transform("_ranked", lambda x: F.struct(x["label"], -x["minus"]))),
        "strong_signature_matched": F.array_contains("strong_classes", label),
        "warnings": F.when(F.size("_ranked") == 0, F.array(F.lit("NO_SIGNATURE"))).otherwise(empty),
    }).drop("_ranked")
    reasons = delegation_reasons(rules, length_col)
    rows = rows.withColumn("delegation_reasons", reasons)
    return rows.withColumns({
        "delegate": F.size("delegation_reasons") > 0,
        "doc_type": F.col("rule_doc_type"),
        "decision_source": F.lit("RULE"),
        "llm_called": F.lit(False),
        "llm_failed": F.lit(False),
        "llm_doc_type": F.lit(None).cast("string"),
        "llm_confidence": F.lit(None).cast("double"),
    })


def _any(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(False)
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def delegation_reasons(rules: RulePack, length_col: str = "normalized_text_length") -> Column:
    """Why a page is delegated, in order; empty if it isn't.

    Strong signals of two classes delegate at once, of one class keep the page; otherwise short text, a low score and a narrow
    margin are all reported. Every limit is a strict ``<``.
    """
    count = F.size("strong_classes")
    narrow = F.col("rule_margin") < rules.least_margin
    if rules.margin_needs_two:
        narrow = narrow & (F.col("matched_class_count") >= 2)
    checks = F.array_compact(F.array(
        F.when(F.col(length_col) < rules.short_text, F.lit("SHORT_TEXT")),
        F.when(F.col("rule_score") < rules.least_score, F.lit("LOW_RULE_SCORE")),
        F.when(narrow, F.lit("NARROW_RULE_MARGIN")),
    ))
    return (
        F.when(F.lit(rules.delegate_conflicts) & (count >= 2), F.array(F.lit("CONFLICTING_SIGNALS")))
        .when(F.lit(rules.short_circuit) & (count == 1), F.array().cast("array<string>"))
        .otherwise(checks)
    )


def candidates(classified: DataFrame) -> DataFrame:
    """One row per page as decided by rules: what it would be, whether it is delegated and why; warnings stay apart."""
    return classified.select(
        "package_id", "page_number", F.col("rule_doc_type").alias("doc_type"), "rule_score", "rule_margin", "matched_class_count", "strong_signature_matched", "delegate",
        F.get("delegation_reasons", F.lit(0)).alias("primary_reason"), F.col("delegation_reasons").alias("all_reasons"), "warnings",
    )
