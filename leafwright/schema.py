"""Closed label sets, table schemas and row invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0.0"

# The closed sets of labels, in report order.
LABELS = ("URLA_1003", "INCOME_DOC", "CREDIT_REPORT", "TITLE_REPORT", "OTHER")
MARKER_STYLES = ("PAGE_N_OF_M", "N_OF_M", "CLTA_PAGE_N", "NONE")
DECISION_SOURCES = ("RULE", "LLM", "RULE_FALLBACK", "CONTEXT")
COMPLETENESS = ("COMPLETE", "INCOMPLETE", "UNKNOWN_EXTENT")
ISSUES = ("DUPLICATE_PAGE", "AMBIGUOUS_ATTACHMENT", "CONFLICTING_MARKER_TOTAL")
MODES = ("rule-only", "llm-only", "hybrid")
WARNINGS = (
    "EMPTY_TEXT", "SHORT_TEXT", "NO_SIGNATURE", "LOW_RULE_SCORE", "NARROW_RULE_MARGIN", "CONFLICTING_SIGNALS", "LLM_DISABLED",
    "LLM_CALL_FAILED", "LLM_PARSE_FAILED", "LLM_LABEL_INVALID", "LLM_COUNT_MISMATCH", "ORPHAN_PAGE", "MARKER_TOTAL_CONFLICT",
)
EVIDENCE_CHARS = 200

RAW_PAGES = "package_id string, page_number int, text string, rotation int, image_count int"
TRUTH = "package_id string, page_number int, doc_type string, source_document string, source_page int"

# Columns of the files that a run saves, in order.
PAGE_RESULT_COLUMNS = (
    "page_number", "doc_type", "decision_source", "rule_doc_type", "rule_score", "rule_margin", "matched_class_count", "strong_signature_matched",
    "llm_called", "llm_failed", "llm_doc_type", "llm_confidence", "marker_style", "marker_page", "marker_total", "instance_id", "is_orphan",
    "rotation", "normalized_text_length", "warnings",
)
PHYSICAL_GROUP_COLUMNS = ("group_id", "doc_type", "start_page", "end_page", "page_count", "physical_pages")
DOCUMENT_COLUMNS = (
    "doc_id", "doc_type", "instance_id", "marker_style", "expected_pages", "observed_logical_pages", "missing_logical_pages", "duplicate_logical_pages",
    "first_page_at", "last_page_at", "physical_span", "is_contiguous", "completeness", "issues", "logical_to_physical",
)
TRUTH_COLUMNS = ("page_number", "doc_type", "source_document", "source_page")

#: Columns that may hold personal data and never leave a run.
PRIVATE = ("text", "raw_identifiers")


def page_invariants(labels: tuple[str, ...] = LABELS) -> dict[str, Column]:
    """What must hold for every page result."""
    c = F.col
    unit = lambda name: c(name).isNull() | c(name).between(0.0, 1.0)
    return {
        "page_number is at least 1": c("page_number") >= 1,
        "doc_type is a label": c("doc_type").isin(*labels),
        "marker_style is known": c("marker_style").isin(*MARKER_STYLES),
        "decision_source is known": c("decision_source").isin(*DECISION_SOURCES),
        "a style of NONE has no marker page": (c("marker_style") != "NONE") | c("marker_page").isNull(),
        "marker page does not pass the total": c("marker_page").isNull() | c("marker_total").isNull() | (c("marker_page") <= c("marker_total")),
        "an LLM decision was called for": (c("decision_source") != "LLM") | c("llm_called"),
        "a fallback has failed": (c("decision_source") != "RULE_FALLBACK") | c("llm_failed"),
        "what failed was called": ~c("llm_failed") | c("llm_called"),
        "scores lie in 0 to 1": unit("rule_score") & unit("rule_margin") & unit("llm_confidence"),
    }


def group_invariants() -> dict[str, Column]:
    """What must hold for every physical run."""
    c = F.col
    return {
        "a run does not end before it starts": c("end_page") >= c("start_page"),
        "a run has all pages from start to end": c("physical_pages") == F.sequence("start_page", "end_page"),
        "page_count counts them": c("page_count") == F.size("physical_pages"),
    }


def document_invariants() -> dict[str, Column]:
    """What must hold for every reconstructed document."""
    c = F.col
    return {
        "no expected total, no judgement": c("expected_pages").isNotNull() | (c("completeness") == "UNKNOWN_EXTENT"),
        "complete exactly if nothing is missing": c("expected_pages").isNull() | ((c("completeness") == "COMPLETE") == (F.size("missing_logical_pages") == 0)),
        "duplicates are flagged": (F.size("duplicate_logical_pages") == 0) | F.array_contains("issues", "DUPLICATE_PAGE"),
        "completeness and issues are known": c("completeness").isin(*COMPLETENESS) & (F.size(F.array_except("issues", F.array(*map(F.lit, ISSUES)))) == 0),
        "evidence is short": F.forall("page_links", lambda x: F.forall(x["evidence"], lambda e: F.char_length(e) <= EVIDENCE_CHARS)),
    }


def violations(df: DataFrame, invariants: dict[str, Column]) -> dict[str, int]:
    """How many rows break each invariant (null counts as broken): one aggregate, whatever their number."""
    names = list(invariants)
    row = df.agg(*(F.count_if(~F.coalesce(invariants[n], F.lit(False))).alias(f"r{i}") for i, n in enumerate(names))).first()
    return {n: row[f"r{i}"] for i, n in enumerate(names) if row[f"r{i}"]}


def validate(df: DataFrame, invariants: dict[str, Column], what: str = "rows") -> DataFrame:
    """``df`` itself; raises ValueError if any row breaks an invariant."""
    if broken := violations(df, invariants):
        raise ValueError(f"Invalid {what}: " + "; ".join(f"{name} ({n})" for name, n in broken.items()))
    return df


def guarded(df: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """``df`` that fails at run time, without a job of its own, on the first row that breaks an invariant."""
    checks = [F.assert_true(F.coalesce(rule, F.lit(False)), F.lit(name)).isNull() for name, rule in invariants.items()]
    held = checks[0]
    for check in checks[1:]:
        held = held & check
    return df.where(held)
