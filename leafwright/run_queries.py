"""Registered queries over whole runs: shipped rules, masking, conflicts, delegation with failures, saved columns and checks."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import masking, text as t
from .operators import classify, delegate, evaluate, extract, group, report
from .plans.materialise import forget, shared_dir
from .plans.rulepack import compile_rules, load_rules
from .plans.run import decided, resolve, sendable
from .queries import _CUT, _DELEGATE_SQL, _LABELS, _LAST, _METRICS_SQL, _ORDER_PAGES_SQL, _PAGES_SQL, _RANKED_SQL, _RUNS_SQL, _WINDOW_SQL, _NUMBERED, LANGS, REGISTERED as _BASE, RULES, _documents, _order_pages, _pages, _pairs, _table, rules
from .sources import truth


def shipped_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of the shipped rules: over lines, by priority, and by the first hit alone."""
    n, key = F.col("l_linenumber").cast("string"), F.col("l_orderkey") % 6
    body = (
        F.when(key == 0, F.concat(F.lit("CLTA Preliminary Report Form\nrev 2006\nPage "), n))
        .when(key == 1, F.concat(F.lit("Page 9 of 3, then Page "), n, F.lit(" of 7")))
        .when(key == 2, F.concat(n, F.lit(" of 7 clta preliminary report form, page 600")))
        .when(key == 3, F.concat(F.lit("no. "), n, F.lit("  OF\n7")))
        .when(key == 4, F.lit("Page 0 of 5"))
        .otherwise(F.concat(F.lit("page "), n, F.lit(" of 900 and "), n, F.lit(" of 8")))
    )
    rows = _table(spark, sf_dir, "lineitem").select(key.alias("kind"), "l_linenumber", body.alias("text"))
    rows = extract.with_markers(rows, "text", load_rules()).select("kind", "l_linenumber", "marker.*")
    return rows.groupBy("kind", "l_linenumber", "style", "page", "total").agg(F.count("*").alias("n")).withColumn("hint", t.marker_hint("page", "total"))


#: A pack whose strong signals often meet in one text, without weak ones.
STRONG = {"en": "the", "fr": "ai", "de": "ie", "es": "os"}
CONFLICTING = RULES | {"doc_types": {label: {"strong": [word], "weak": []} for label, word in STRONG.items()}, "never_strong": []}
_FLAGS = ("strong_signature_short_circuit", "delegate_on_conflicting_strong_signals", "require_multiple_classes_for_margin_check")


def _scored(spark: SparkSession, sf_dir: str, pack: dict[str, Any]) -> DataFrame:
    docs = _documents(spark, sf_dir, "text").withColumn("normalized_text_length", t.normalized_length("text"))
    return classify.candidates(classify.classify(docs.withColumns({"package_id": F.lit("all"), "page_number": F.col("doc_id")}), compile_rules(pack)))


def conflicting_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate table: conflicts of strong signals delegate at once."""
    rows = _scored(spark, sf_dir, CONFLICTING)
    return rows.select(
        F.col("page_number").alias("doc_id"), "doc_type", F.col("matched_class_count").cast("long").alias("classes"), t.truth_value("strong_signature_matched").alias("strong"), t.truth_value("delegate").alias("delegate"),
        "primary_reason", t.joined("all_reasons").alias("all_reasons"), t.joined("warnings").alias("warnings"),
    )


def default_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that a pack doesn't state are off: strong signals neither keep nor delegate, and one class is enough for a narrow margin."""
    pack = CONFLICTING | {"delegation": {k: v for k, v in RULES["delegation"].items() if k not in _FLAGS}}
    return _scored(spark, sf_dir, pack).select(F.col("page_number").alias("doc_id"), t.joined("all_reasons").alias("all_reasons"))


_STRONG_SQL = "WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS len, list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{word}') THEN '{label}' END" for label, word in STRONG.items()) + "], lambda x: x IS NOT NULL) AS hits FROM documents), k AS (SELECT *, len(hits) AS k FROM c)"

_PERSON = {0: ("Ann Lee", "[NAME]"), 1: ("Mary Ann Smith Jones", "[NAME] Jones"), 2: ("Realtor Bob Ray", "Realtor Bob Ray"), 3: ("Bob", "Bob"), 4: ("Bob Attn: Ed Poe", "Bob Attn: [NAME]")}


def _person(which: int) -> Column:
    key, value = F.col("c_custkey") % len(_PERSON), None
    for k, pair in _PERSON.items():
        value = F.when(key == k, F.lit(pair[which])) if value is None else value.when(key == k, F.lit(pair[which]))
    return value


def masked_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped masks: all seven patterns, amounts that they must spare, a kept group, and names beside labels."""
    digits = F.lpad(F.col("c_custkey").cast("string"), 9, "7")
    text = F.concat(
        F.lit("Borrower: "), _person(0), F.lit(". Paid $1,234.56 and 12,345,678 and $"), digits, F.lit(" to CTEC # A12345, 12 Main Street, CA 90210-1234 then; SSN 123-45-6789; (555) 123-4567 or $123-456-7890; a.b@c-d.org - Ref "), digits, F.lit(" end")
    )
    # A file of few row groups would be masked in as few tasks, however many cores there are; only keys are dealt out.
    keys = _table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = keys.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, text).otherwise(F.concat(F.lit("Ref "), digits, F.lit(" alone"))).alias("text"))
    return rows.select("c_custkey", masking.masked("text", load_rules().mask).alias("masked"))


_MASKED_SQL = (
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Ref [ID] alone' ELSE 'Borrower: ' || CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN '{pair[1]}'" for k, pair in _PERSON.items()) + " END || '. Paid $1,234.56 and 12,345,678 and $' || lpad(CAST(c_custkey AS VARCHAR), 9, '7') || "
    "' to CTEC # [ID], [ADDRESS], [CITY_STATE_ZIP] then; SSN [SSN]; ([PHONE] or $123-456-7890; [EMAIL] - Ref [ID] end' END AS masked FROM customer"
)


def delegated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent for each page: masked, cut, with a hint of the marker."""
    pages = _pages(spark, sf_dir).select("package_id", "page_number", "text", F.when(F.col("page_number") % 3 != 0, F.col("page_number")).alias("marker_page"), F.when(F.col("page_number") % 2 == 0, F.lit(9)).alias("marker_total"), F.lit("N_OF_M").alias("marker_style"))
    return delegate.requests(pages, rules(), delegate.Settings(max_excerpt_chars=300)).select("package_id", "page_number", "excerpt", "marker_hint")


def _client():
    """A classifier that, by batch, answers, needs a second try, always fails, or answers with no JSON; it knows how often it was asked."""
    asked: dict[str, int] = {}

    def call(prompt: str, user: str, settings: delegate.Settings) -> Any:
        ids = [int(line.split(": ")[1]) for line in user.splitlines() if line.startswith("page_id: ")]
        asked[user] = asked.get(user, 0) + 1
        kind = (ids[0] - 1) // settings.batch_size % 4
        if kind == 2 or (kind == 1 and asked[user] == 1):
            raise TimeoutError
        if kind == 3:
            return "no json"
        return {"decisions": [{"page_id": i, "doc_type": LANGS[i % 4], "confidence": 0.25, "evidence": ""} for i in (*ids, 999_999)]}

    return call


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    settings = delegate.Settings(enabled=True, batch_size=10, max_retries=2)
    pages = _pages(spark, sf_dir).select("package_id", "page_number", F.substring("text", 1, 400).alias("text"), F.lit(None).cast("int").alias("marker_page"), F.lit(None).cast("int").alias("marker_total"), F.lit("NONE").alias("marker_style"))
    return pages, delegate.answers(delegate.batches(delegate.requests(pages, rules(), settings), settings.batch_size), _client(), settings, _LABELS)


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delegate.call_records(_answered(spark, sf_dir)[1])
    return rows.select("package_id", "batch_index", t.joined("requested_page_ids").alias("requested"), t.joined("returned_page_ids").alias("returned"), "attempt_count", t.truth_value("succeeded").alias("succeeded"), t.joined("warnings").alias("warnings"))


def failed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of batches that failed or were answered badly fall back to their rule decision."""
    pages, answered = _answered(spark, sf_dir)
    plain = pages.select("package_id", "page_number", F.lit("OTHER").alias("doc_type"), F.array(F.lit("NO_SIGNATURE")).alias("warnings"))
    return delegate.resolved(plain, answered).select("package_id", "page_number", "doc_type", "decision_source", F.col("llm_confidence").alias("confidence"), t.joined("warnings").alias("warnings"))


_KIND_SQL = f"WITH p AS (SELECT package_id, page_number, (page_number - 1) // 10 AS b, (page_number - 1) // 10 % 4 AS kind FROM ({_PAGES_SQL}))"


def _decide(prompt: str, user: str, settings: delegate.Settings) -> dict:
    ids = [int(line.split(": ")[1]) for line in user.splitlines() if line.startswith("page_id: ")]
    return {"decisions": [{"page_id": i, "doc_type": LANGS[i % 4], "confidence": 0.5, "evidence": ""} for i in ids]}


def run_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run in its three modes, and in hybrid mode without a classifier."""
    raw = _pages(spark, sf_dir).select("package_id", "page_number", "text", F.lit(0).alias("rotation"), F.lit(0).alias("image_count"))
    on = delegate.Settings(enabled=True, batch_size=10, max_retries=0, max_excerpt_chars=300)
    pages, out = sendable(decided(raw, rules()), rules(), "llm-only", on), None  # whose excerpts serve all modes
    try:
        for name, mode, settings in (("rule-only", "rule-only", None), ("hybrid", "hybrid", on), ("llm-only", "llm-only", on), ("disabled", "hybrid", None)):
            rows = resolve(pages, rules(), mode, settings, _decide).page_results
            rows = rows.select(F.lit(name).alias("mode"), "package_id", "page_number", "emit_order", "doc_type", "decision_source", t.truth_value("llm_called").alias("llm_called"), t.truth_value(F.array_contains("warnings", "LLM_DISABLED")).alias("unsent"))
            out = rows if out is None else out.unionByName(rows)
    finally:
        forget(pages)
    return out


_MODES_SQL = f"""{_RANKED_SQL}, p AS (SELECT package_id, page_number, q.doc_id, label, {_DELEGATE_SQL} <> '' AS sent FROM ({_PAGES_SQL}) q JOIN scored ON q.doc_id = scored.doc_id),
 m AS (SELECT *, unnest(['rule-only', 'hybrid', 'llm-only', 'disabled']) AS mode FROM p), d AS (SELECT *, mode = 'llm-only' OR (mode = 'hybrid' AND sent) AS called FROM m)
 SELECT mode, package_id, page_number, CAST(row_number() OVER (PARTITION BY mode, package_id ORDER BY CASE WHEN mode IN ('hybrid', 'disabled') AND sent THEN 1 ELSE 0 END, page_number) AS INTEGER) AS emit_order,
  CASE WHEN called THEN ['en','fr','de','es'][page_number % 4 + 1] ELSE label END AS doc_type, CASE WHEN called THEN 'LLM' ELSE 'RULE' END AS decision_source, CASE WHEN called THEN 'True' ELSE 'False' END AS llm_called, CASE WHEN mode = 'disabled' AND sent THEN 'True' ELSE 'False' END AS unsent FROM d"""


def _order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as page results with every column that is saved."""
    flagged = group.flag_orphans(_order_pages(spark, sf_dir))
    return flagged.withColumns({
        "decision_source": F.when(F.col("page_number") % 5 == 0, "LLM").otherwise("RULE"), "rule_doc_type": F.col("doc_type"), "rule_score": F.lit(0.5), "rule_margin": F.lit(0.25), "matched_class_count": F.lit(2),
        "strong_signature_matched": F.col("page_number") % 2 == 0, "llm_called": F.col("page_number") % 5 == 0, "llm_failed": F.lit(False), "llm_doc_type": F.when(F.col("page_number") % 5 == 0, F.col("doc_type")),
        "llm_confidence": F.when(F.col("page_number") % 5 == 0, F.lit(0.75)), "rotation": F.lit(90), "normalized_text_length": F.col("page_number") * 10,
    })


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_rows(_order_results(spark, sf_dir)).select("package_id", *schema.PAGE_RESULT_COLUMNS)


def saved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.group_rows(group.physical_groups(_order_results(spark, sf_dir))).select("package_id", *schema.PHYSICAL_GROUP_COLUMNS)


def saved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved columns of documents, grouped by the whole grouping step: instances come from identifiers here."""
    pages = _order_results(spark, sf_dir).withColumn("raw_identifiers", F.map_from_entries(F.array_compact(F.array(F.when(F.col("instance_id").isNotNull(), F.struct(F.lit("order"), F.col("instance_id")))))))
    pack = RULES | {"instance_identifiers": [{"name": "order", "regex": "(O#.*)", "scope": ["A", "N", "R"]}], "doc_types": {label: {"strong": [], "weak": []} for label in "ANR"}}
    _, _, documents = group.group_pages(pages.drop("instance_id", "tier", "is_orphan").withColumn("warnings", F.array().cast("array<string>")), compile_rules(pack), "page_number")
    return report.document_rows(documents).select("package_id", *schema.DOCUMENT_COLUMNS)


def page_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.flag_orphans(_order_pages(spark, sf_dir)).select("package_id", "page_number", "tier", t.truth_value("is_orphan").alias("is_orphan"), t.joined("warnings").alias("warnings"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's place in its document, and why it stands there."""
    docs = group.reconstruct(group.flag_orphans(_order_pages(spark, sf_dir)))
    return docs.select("package_id", F.explode("page_links").alias("link")).select("package_id", "link.physical_page", "link.logical_page", t.joined("link.evidence").alias("evidence"))


#: Markers of whole numbers: the patterns of the pack take "001 of 90" out of "1001 of 90".
WHOLE = RULES | {"markers": [m | {"regex": m["regex"].replace("(?P<page>", r"(?<!\d)(?P<page>") + r"(?!\d)"} for m in RULES["markers"]]}


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pages(spark, sf_dir).select("package_id", "page_number", F.concat(F.col("page_number").cast("string"), F.lit(" of 90 mailto://"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(" ")).alias("text"))
    rows = extract.summary(extract.extract_pages(raw, compile_rules(WHOLE)))
    return rows.select("package_id", "page_number", "normalized_text_length", "rotation", "image_count", "marker_style", "marker_page", "marker_total", t.joined("identifier_names").alias("identifier_names"))


def truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth written as CSV by the executors and read again with its checks."""
    label = F.element_at(F.array(*map(F.lit, schema.LABELS)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _pages(spark, sf_dir).select("package_id", "page_number", label.alias("doc_type"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a, \"b\" "), F.col("lang"))).alias("source_document"), F.when(F.col("doc_id") % 3 == 0, F.col("page_number")).alias("source_page"))
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/truth-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return truth.load_ground_truth(spark, path)


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the text report, line by line."""
    pairs = _pairs(spark, sf_dir)
    known, found = (pairs.select("package_id", "page_number", F.col(c).alias("doc_type")) for c in ("actual", "predicted"))
    text = evaluate.report_text(evaluate.evaluate(known, found, "rule-only", "documents", _LABELS, listed=3))
    lines = [line for line in text.splitlines() if line.startswith(("mode", "dataset", "total_pages", "accuracy", "macro", "Note", "misclassified", "  and "))]
    return spark.createDataFrame(list(enumerate(lines)), "nr int, line string")


def broken_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as page results: how many break which invariant."""
    rows = _order_results(spark, sf_dir).withColumns({"llm_failed": F.col("page_number") % 9 == 0, "marker_total": F.col("marker_total") - 4})
    return spark.createDataFrame(list(schema.violations(rows, schema.page_invariants(("A", "N"))).items()), "rule string, n long")


_ORDER_FLAGS_SQL = f"{_ORDER_PAGES_SQL}, fl AS (SELECT *, CASE WHEN marker_page IS NOT NULL AND instance_id IS NOT NULL THEN 1 WHEN marker_page IS NOT NULL AND marker_style <> 'NONE' THEN 2 END AS tr FROM pages)"
_BOOL = lambda x: f"CASE WHEN {x} THEN 'True' ELSE 'False' END"
_DOCUMENTS_SQL = _BASE["reconstructed_orders"][1] or ""
_MASK_TEXT_SQL = "regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+', '[EMAIL]', 'g'), '\\(?\\d{3}\\)?[-. ]\\d{3}[-.]\\d{4}', '[PHONE]', 'g')"
_EXCERPT_SQL = f"CASE WHEN length(text) <= 300 THEN text WHEN {_LAST(chr(39) + '. ' + chr(39), 2)} > 150 THEN {_CUT('(' + _LAST(chr(39) + '. ' + chr(39), 2) + ') + 2')} WHEN {_LAST('chr(10)', 1)} > 150 THEN {_CUT('(' + _LAST('chr(10)', 1) + ') + 1')} WHEN {_LAST(chr(39) + ' ' + chr(39), 1)} > 0 THEN {_CUT(_LAST(chr(39) + ' ' + chr(39), 1))} ELSE {_WINDOW_SQL} END"

#: Each query with its SQL.
REGISTERED = {
    "shipped_markers": (shipped_markers, """WITH m AS (SELECT l_orderkey % 6 AS kind, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN 'CLTA_PAGE_N' WHEN 2 THEN 'CLTA_PAGE_N' WHEN 3 THEN CASE WHEN l_linenumber <= 7 THEN 'N_OF_M' ELSE 'NONE' END ELSE 'NONE' END AS style,
  CASE l_orderkey % 6 WHEN 0 THEN l_linenumber WHEN 2 THEN 600 WHEN 3 THEN CASE WHEN l_linenumber <= 7 THEN l_linenumber END END AS page, CASE WHEN l_orderkey % 6 = 3 AND l_linenumber <= 7 THEN 7 END AS total FROM lineitem)
 SELECT kind, l_linenumber, style, CAST(page AS INTEGER) AS page, CAST(total AS INTEGER) AS total, count(*) AS n, CASE WHEN page IS NOT NULL THEN 'page ' || CAST(page AS VARCHAR) || coalesce(' of ' || CAST(total AS VARCHAR), '') END AS hint FROM m GROUP BY ALL"""),
    "conflicting_signals": (conflicting_signals, f"""{_STRONG_SQL}, r AS (SELECT *, CASE WHEN k >= 2 THEN 'CONFLICTING_SIGNALS' WHEN k = 1 THEN '' ELSE concat_ws(';', CASE WHEN len < 200 THEN 'SHORT_TEXT' END, 'LOW_RULE_SCORE') END AS reasons FROM k)
 SELECT doc_id, CASE WHEN k = 0 THEN 'OTHER' ELSE hits[1] END AS doc_type, CAST(k AS BIGINT) AS classes, {_BOOL('k > 0')} AS strong, {_BOOL("reasons <> ''")} AS delegate, CASE WHEN reasons <> '' THEN split_part(reasons, ';', 1) END AS primary_reason, reasons AS all_reasons, CASE WHEN k = 0 THEN 'NO_SIGNATURE' ELSE '' END AS warnings FROM r"""),
    "default_flags": (default_flags, f"{_STRONG_SQL} SELECT doc_id, concat_ws(';', CASE WHEN len < 200 THEN 'SHORT_TEXT' END, CASE WHEN k <> 1 THEN 'LOW_RULE_SCORE' END, CASE WHEN k <> 1 THEN 'NARROW_RULE_MARGIN' END) AS all_reasons FROM k"),
    "masked_personal": (masked_personal, _MASKED_SQL),
    "delegated_requests": (delegated_requests, f"""SELECT package_id, page_number, {_EXCERPT_SQL} AS excerpt, CASE WHEN page_number % 3 <> 0 THEN 'page ' || CAST(page_number AS VARCHAR) || CASE WHEN page_number % 2 = 0 THEN ' of 9' ELSE '' END END AS marker_hint
 FROM (SELECT package_id, page_number, {_MASK_TEXT_SQL} AS text FROM ({_PAGES_SQL}))"""),
    "call_records": (call_records, f"""{_KIND_SQL} SELECT package_id, CAST(b AS INTEGER) AS batch_index, string_agg(CAST(page_number AS VARCHAR), ';' ORDER BY page_number) AS requested, CASE WHEN kind < 2 THEN string_agg(CAST(page_number AS VARCHAR), ';' ORDER BY page_number) ELSE '' END AS returned,
 CAST(CASE kind WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INTEGER) AS attempt_count, {_BOOL('kind <> 2')} AS succeeded, CASE kind WHEN 2 THEN 'LLM_CALL_FAILED' WHEN 3 THEN 'LLM_PARSE_FAILED' ELSE '' END AS warnings FROM p GROUP BY package_id, b, kind"""),
    "failed_batches": (failed_batches, f"""{_KIND_SQL} SELECT package_id, page_number, CASE WHEN kind < 2 THEN ['en','fr','de','es'][page_number % 4 + 1] ELSE 'OTHER' END AS doc_type, CASE WHEN kind < 2 THEN 'LLM' ELSE 'RULE_FALLBACK' END AS decision_source, CASE WHEN kind < 2 THEN 0.25::DOUBLE END AS confidence,
 'NO_SIGNATURE' || CASE kind WHEN 2 THEN ';LLM_CALL_FAILED' WHEN 3 THEN ';LLM_PARSE_FAILED' ELSE '' END AS warnings FROM p"""),
    "run_modes": (run_modes, _MODES_SQL),
    "saved_pages": (saved_pages, f"""{_ORDER_FLAGS_SQL} SELECT package_id, page_number, doc_type, CASE WHEN page_number % 5 = 0 THEN 'LLM' ELSE 'RULE' END AS decision_source, doc_type AS rule_doc_type, 0.5::DOUBLE AS rule_score, 0.25::DOUBLE AS rule_margin, 2 AS matched_class_count, {_BOOL('page_number % 2 = 0')} AS strong_signature_matched,
 {_BOOL('page_number % 5 = 0')} AS llm_called, 'False' AS llm_failed, CASE WHEN page_number % 5 = 0 THEN doc_type ELSE '' END AS llm_doc_type, CASE WHEN page_number % 5 = 0 THEN '0.75' ELSE '' END AS llm_confidence, marker_style, coalesce(CAST(marker_page AS VARCHAR), '') AS marker_page, coalesce(CAST(marker_total AS VARCHAR), '') AS marker_total,
 coalesce(instance_id, '') AS instance_id, {_BOOL('tr IS NULL')} AS is_orphan, 90 AS rotation, page_number * 10 AS normalized_text_length, CASE WHEN tr IS NULL THEN 'ORPHAN_PAGE' ELSE '' END AS warnings FROM fl"""),
    "saved_groups": (saved_groups, _RUNS_SQL(f"{_ORDER_PAGES_SQL} SELECT package_id, page_number, doc_type FROM pages") + f" SELECT package_id, {_NUMBERED('PG', 'CAST(run AS BIGINT)')} AS group_id, doc_type, start_page, end_page, page_count, physical_pages FROM g"),
    "saved_documents": (saved_documents, f"""WITH recursive_free AS ({_DOCUMENTS_SQL}), o AS ({_ORDER_PAGES_SQL} SELECT package_id, doc_type, instance_id, dense_rank() OVER (PARTITION BY package_id, doc_type ORDER BY first) AS nr FROM (SELECT package_id, doc_type, instance_id, min(page_number) AS first FROM pages WHERE instance_id IS NOT NULL GROUP BY ALL))
 SELECT r.package_id, doc_id, r.doc_type, CASE WHEN r.instance_id = '' THEN '' ELSE r.doc_type || '#' || CAST(o.nr AS VARCHAR) END AS instance_id, marker_style, coalesce(CAST(expected_pages AS VARCHAR), '') AS expected_pages, observed_logical_pages, missing_logical_pages, duplicate_logical_pages, coalesce(CAST(first_page_at AS VARCHAR), '') AS first_page_at,
  coalesce(CAST(last_page_at AS VARCHAR), '') AS last_page_at, physical_span, is_contiguous, completeness, issues, logical_to_physical FROM recursive_free r LEFT JOIN o ON r.package_id = o.package_id AND r.doc_type = o.doc_type AND r.instance_id = o.instance_id"""),
    "page_tiers": (page_tiers, f"{_ORDER_FLAGS_SQL} SELECT package_id, page_number, tr AS tier, {_BOOL('tr IS NULL')} AS is_orphan, CASE WHEN tr IS NULL THEN 'ORPHAN_PAGE' ELSE '' END AS warnings FROM fl"),
    "page_links": (page_links, f"""{_ORDER_FLAGS_SQL}, w AS (SELECT *, max(tr) OVER (PARTITION BY package_id, doc_type, instance_id, marker_style, marker_total) AS worst FROM fl WHERE tr IS NOT NULL)
 SELECT package_id, page_number AS physical_page, marker_page AS logical_page, CASE WHEN worst = 2 THEN 'marker_match_within_unique_instance' ELSE 'identifier_and_marker_match' END AS evidence FROM w"""),
    "page_listing": (page_listing, f"""SELECT package_id, page_number, CAST(length(CAST(page_number AS VARCHAR) || 'of90mailto://' || lang || '/' || CAST(doc_id AS VARCHAR)) AS INTEGER) AS normalized_text_length, 0 AS rotation, 0 AS image_count, CASE WHEN page_number <= 90 THEN 'N_OF_M' ELSE 'NONE' END AS marker_style,
 CASE WHEN page_number <= 90 THEN page_number END AS marker_page, CASE WHEN page_number <= 90 THEN 90 END AS marker_total, CASE WHEN doc_id >= 10 THEN 'host;number' ELSE 'host' END AS identifier_names FROM ({_PAGES_SQL})"""),
    "truth_file": (truth_file, f"""SELECT package_id, page_number, ['URLA_1003','INCOME_DOC','CREDIT_REPORT','TITLE_REPORT','OTHER'][doc_id % 5 + 1] AS doc_type, CASE WHEN doc_id % 2 = 0 THEN 'a, "b" ' || lang END AS source_document, CASE WHEN doc_id % 3 = 0 THEN page_number END AS source_page FROM ({_PAGES_SQL})"""),
    "evaluation_report": (evaluation_report, f"""{_METRICS_SQL}, w AS (SELECT count(*) AS n FROM pairs WHERE actual <> predicted), u AS (SELECT string_agg(l, ', ') AS names FROM (SELECT unnest(['en','fr','de','es','OTHER']) AS l) WHERE l NOT IN (SELECT actual FROM pairs)),
 t AS (SELECT 0 AS nr, 'mode: rule-only' AS line UNION ALL SELECT 1, 'dataset: documents' UNION ALL SELECT 2, 'total_pages: ' || CAST((SELECT count(*) FROM pairs) AS VARCHAR) UNION ALL SELECT 3, printf('accuracy: %.4f', (SELECT avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END) FROM pairs))
  UNION ALL SELECT 4, printf('macro_f1_supported: %.4f', (SELECT avg(f1)::DOUBLE FROM f WHERE support > 0)) UNION ALL SELECT 5, 'Note: ' || names || ' has support 0: no true page, so recall and F1 stay N/A and don''t enter macro_f1_supported.' FROM u WHERE names IS NOT NULL
  UNION ALL SELECT 6, 'misclassified pages (' || CAST(n AS VARCHAR) || '):' FROM w UNION ALL SELECT 7, '  and ' || CAST(n - 3 AS VARCHAR) || ' more' FROM w WHERE n > 3)
 SELECT CAST(row_number() OVER (ORDER BY nr) - 1 AS INTEGER) AS nr, line FROM t"""),
    "broken_invariants": (broken_invariants, f"""{_ORDER_FLAGS_SQL}, b AS (SELECT 'doc_type is a label' AS rule, count(*) AS n FROM fl WHERE doc_type NOT IN ('A', 'N') UNION ALL SELECT 'a style of NONE has no marker page', count(*) FROM fl WHERE marker_style = 'NONE' AND marker_page IS NOT NULL
  UNION ALL SELECT 'marker page does not pass the total', count(*) FROM fl WHERE marker_page > marker_total - 4 UNION ALL SELECT 'what failed was called', count(*) FROM fl WHERE page_number % 9 = 0 AND page_number % 5 <> 0) SELECT rule, n FROM b WHERE n > 0"""),
}
