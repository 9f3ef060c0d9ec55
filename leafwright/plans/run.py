"""The three modes of a run over page packages."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import classify, delegate, extract, group, report
from .materialise import forget, materialised
from .rulepack import RulePack


@dataclass(frozen=True)
class RunResult:
    """Tables of a run: per page, per run of pages, per document, per call; and what it was run with."""

    page_results: DataFrame
    physical_groups: DataFrame
    documents: DataFrame
    call_records: DataFrame | None
    mode: str
    settings: delegate.Settings
    rules_version: str | None
    warnings: tuple[str, ...] = ()

    def report(self, source_name: str = "", package_id: str | None = None) -> dict[str, Any]:
        """Counters of one package, or of all pages, as a dictionary; names are cut to the last part of a path. Lists of pages are those of one package; of several only counts are given."""
        rows = self.page_results if package_id is None else self.page_results.where(F.col("package_id") == package_id)
        counts = report.run_totals(rows).first().asDict()
        if package_id is not None or rows.agg(F.min("package_id") == F.max("package_id")).first()[0]:
            counts |= report.run_counters(rows).drop("package_id").first().asDict()
        calls = []
        if self.call_records is not None:
            own = self.call_records if package_id is None else self.call_records.where(F.col("package_id") == package_id)
            calls = [r.asDict() for r in own.orderBy("package_id", "batch_index").drop(*(["package_id"] if package_id is not None else [])).collect()]
        if counts["llm_resolved"] + counts["rule_fallback_count"] > counts["llm_called"]:
            raise ValueError("llm_resolved + rule_fallback_count exceeds llm_called")
        if "LLM_DISABLED" in self.warnings and counts["llm_called"]:
            raise ValueError("LLM_DISABLED recorded but calls were made")
        head = {"schema_version": schema.SCHEMA_VERSION, "mode": self.mode, "source_pdf_name": Path(source_name).name}
        return head | counts | {"llm_call_records": calls, "llm_config": self.settings.as_dict(), "rules_version": self.rules_version, "warnings": list(self.warnings)}


def decided(raw: DataFrame, rules: RulePack, strict: bool = False) -> DataFrame:
    """Pages with what was extracted and what rules decide, and their texts."""
    return classify.classify(extract.extract_pages(raw, rules, strict), rules)


def sendable(pages: DataFrame, rules: RulePack, mode: str, settings: delegate.Settings) -> DataFrame:
    """Decided pages, written once, with excerpts of those that ``mode`` may send in the place of texts.

    Each branch of a run selects by the rules' decision. Over a plan, such a filter would read the texts and compute all rules anew.
    """
    rows = pages if mode == "llm-only" else pages.withColumn("text", F.when(F.col("delegate"), F.col("text")))
    return materialised(delegate.with_excerpts(rows, rules, settings), "decided")


def run(raw: DataFrame, rules: RulePack, mode: str = "rule-only", settings: delegate.Settings | None = None, client: delegate.Client | None = None, strict: bool = False) -> RunResult:
    """Extracts, classifies, delegates as ``mode`` says, and groups.

    ``rule-only`` decides all pages by rules and only records which it would delegate. ``hybrid`` sends those to ``client``; without
    enabled settings it ends like ``rule-only`` with a warning. ``llm-only`` sends every page, and needs enabled settings. Text goes no
    further than classification and masking: results hold none.
    """
    settings = checked(rules, mode, settings)
    pages = decided(raw, rules, strict)
    if mode == "rule-only" or not settings.enabled:
        return resolve(pages.drop("text"), rules, mode, settings, client)
    pages = sendable(pages, rules, mode, settings)
    try:
        return resolve(pages, rules, mode, settings, client)
    finally:
        forget(pages)


def checked(rules: RulePack, mode: str, settings: delegate.Settings | None) -> delegate.Settings:
    """The settings that hold; ValueError for a mode that isn't one, or can't be."""
    settings = settings or delegate.Settings(max_excerpt_chars=rules.excerpt_chars)
    if mode not in schema.MODES:
        raise ValueError(f"Unsupported pipeline mode: {mode!r}")
    if mode == "llm-only" and not settings.enabled:
        raise ValueError("llm-only mode requires an enabled LLM configuration; set LLM_API_KEY, or run rule-only or hybrid")
    return settings


def resolve(pages: DataFrame, rules: RulePack, mode: str, settings: delegate.Settings | None = None, client: delegate.Client | None = None) -> RunResult:
    """What :func:`run` does after rules have decided: ``pages`` are decided ones without text, those of :func:`sendable` where pages are sent. Nothing that it returns reads them again."""
    settings = checked(rules, mode, settings)
    labels = tuple(dict.fromkeys((*rules.labels, rules.fallback)))
    targeted = F.lit(True) if mode == "llm-only" else F.col("delegate")
    pages = pages.withColumn("targeted", targeted)
    plain = pages.drop("excerpt")
    calls, warnings = None, ()
    if mode == "rule-only":
        results = delegate.emit_order(plain, routed=False)
    elif not settings.enabled:
        warnings = ("LLM_DISABLED",)
        results = delegate.emit_order(delegate.disabled(plain), routed=True)
    else:
        asked = delegate.batches(delegate.requested(pages.where("targeted")), settings.batch_size)
        answered = delegate.answers(asked, client or delegate.openai_client, settings, labels)
        calls = delegate.call_records(answered)
        results = plain.where("not targeted").unionByName(delegate.resolved(plain.where("targeted"), answered))
        results = delegate.emit_order(results, routed=mode == "hybrid")
    # Four outputs derive from these rows; a row that breaks an invariant fails the job that would give it out.
    flagged, groups, documents = group.group_pages(results, rules, keep=lambda rows: materialised(schema.guarded(rows.drop("raw_identifiers"), schema.page_invariants(labels)), "pages"))
    return RunResult(
        flagged, schema.guarded(groups, schema.group_invariants()), schema.guarded(documents, schema.document_invariants()), calls, mode, settings, rules.version, warnings
    )
