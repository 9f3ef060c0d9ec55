"""Registered queries: every operator on the driver's tables, beside the SQL that says the same.

The tables hold no loan papers, so queries run with a small rule pack of their own, from which the SQL is made too.
Results are strings and numbers, so that values compare alike everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import masking, text as t
from .operators import classify, delegate, evaluate, extract, group, match, report
from .plans.rulepack import RulePack, compile_rules

Query = Callable[[SparkSession, str], DataFrame]

LANGS = ("en", "fr", "de", "es")
RULES = {
    "version": "test",
    "scoring": {"strong_weight": 1.0, "weak_weight": 0.25, "evidence_saturation": 1.0, "case_sensitive": False},
    "delegation": {"strong_signature_short_circuit": True, "short_text_threshold": 200, "rule_score_threshold": 0.6, "rule_margin_threshold": 0.2, "delegate_on_conflicting_strong_signals": True, "require_multiple_classes_for_margin_check": True},
    "markers": [
        {"style": "PAGE_N_OF_M", "priority": 20, "regex": r"Page\s+(?P<page>\d{1,3})\s+of\s+(?P<total>\d{1,3})", "flags": ["IGNORECASE"]},
        {"style": "N_OF_M", "priority": 30, "regex": r"(?P<page>\d{1,3})\s+of\s+(?P<total>\d{1,3})", "flags": ["IGNORECASE"]},
    ],
    "marker_constraints": {"max_total": 500, "reject_if_page_gt_total": True},
    "instance_identifiers": [{"name": "host", "regex": r"://([a-z.]+)", "scope": list(LANGS)}, {"name": "number", "regex": r"/(\d{2,6})", "scope": ["en", "fr"]}],
    "masking": {"patterns": [{"name": "email", "regex": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "replacement": "[EMAIL]"}, {"name": "phone", "regex": r"\(?\d{3}\)?[-. ]\d{3}[-.]\d{4}", "replacement": "[PHONE]"}], "name_masking": {"enabled": False}, "max_excerpt_chars": 300},
    "doc_types": {
        "en": {"strong": ["permission is hereby granted", "all rights reserved"], "weak": [" the ", " and ", " of "]},
        "fr": {"strong": [], "weak": [" les ", " des ", " et "]},
        "de": {"strong": [], "weak": [" und ", " der ", " die "]},
        "es": {"strong": [], "weak": [" los ", " que ", " el "]},
    },
    "never_strong": ["the"],
}


def rules() -> RulePack:
    return compile_rules(RULES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", *columns)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one package per source."""
    order = Window.partitionBy("source").orderBy("doc_id")
    return _documents(spark, sf_dir, "source", "text", "lang").select(F.col("source").alias("package_id"), F.row_number().over(order).alias("page_number"), "text", "lang", "doc_id")


def _classified(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "text", "lang", *more).withColumn("normalized_text_length", t.normalized_length("text"))
    return classify.classify(docs, rules())


# SQL of the rule pack.
_TEXT = "lower(coalesce(text, ''))"


def _has(signal: str) -> str:
    return f"contains({_TEXT}, '{signal.lower()}')"


def _raw_sql() -> str:
    parts = []
    for label, block in RULES["doc_types"].items():
        terms = [f"(CASE WHEN {_has(s)} THEN 1.0::DOUBLE ELSE 0 END)" for s in block["strong"]] + [f"(CASE WHEN {_has(s)} THEN 0.25::DOUBLE ELSE 0 END)" for s in block["weak"]]
        parts.append(f"({' + '.join(terms)}) AS raw_{label}")
    strong = " OR ".join(_has(s) for s in RULES["doc_types"]["en"]["strong"])
    return f"SELECT doc_id, lang, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS len, CAST(({strong}) AS INTEGER) AS strong, {', '.join(parts)} FROM documents"


_RANKED_SQL = f"""
WITH raw AS ({_raw_sql()}),
 long AS (SELECT doc_id, label, nr, raw FROM (
   {' UNION ALL '.join(f"SELECT doc_id, '{label}' AS label, {i} AS nr, raw_{label} AS raw FROM raw" for i, label in enumerate(LANGS))}) WHERE raw > 0),
 shares AS (SELECT doc_id, label, nr, raw, raw / sum(raw) OVER (PARTITION BY doc_id) AS share FROM long),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, nr) AS rk, lead(share) OVER (PARTITION BY doc_id ORDER BY share DESC, nr) AS next, count(*) OVER (PARTITION BY doc_id) AS classes FROM shares),
 scored AS (SELECT raw.doc_id, raw.lang, raw.len, raw.strong, coalesce(r.label, 'OTHER') AS label, coalesce(r.share * least(1.0::DOUBLE, r.raw), 0.0::DOUBLE) AS score,
   coalesce(r.share - coalesce(r.next, 0), 0.0::DOUBLE) AS margin, coalesce(r.classes, 0) AS classes FROM raw LEFT JOIN (SELECT * FROM ranked WHERE rk = 1) r ON raw.doc_id = r.doc_id)
"""
_DELEGATE_SQL = """CASE WHEN strong = 1 THEN '' ELSE concat_ws(';', CASE WHEN len < 200 THEN 'SHORT_TEXT' END, CASE WHEN score < 0.6 THEN 'LOW_RULE_SCORE' END, CASE WHEN classes >= 2 AND margin < 0.2 THEN 'NARROW_RULE_MARGIN' END) END"""


def normalized_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "text").select("doc_id", t.normalized_length("text").alias("normalized_text_length"))


def page_hash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _documents(spark, sf_dir, "text").select(F.lit("all").alias("package_id"), F.lit("x").alias("label"), F.col("doc_id").alias("source_page"), t.text_hash("text").alias("hash"))
    return match.source_collisions(pages).select("hash", "n", F.col("first.source_page").alias("first_page"), F.col("last.source_page").alias("last_page"))


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", F.col("rule_doc_type").alias("label"), F.round("rule_score", 9).alias("score"), F.round("rule_margin", 9).alias("margin"), F.col("matched_class_count").cast("long").alias("classes"))


def matched_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", t.joined("matched_signals", "|").alias("signals"), t.truth_value("strong_signature_matched").alias("strong"))


def delegation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", t.joined("delegation_reasons").alias("reasons"), t.truth_value("delegate").alias("delegate"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy(F.col("rule_doc_type").alias("label")).agg(F.count("*").alias("n"), F.count_if("delegate").alias("delegated"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select(F.lit("all").alias("package_id"), F.col("doc_id").alias("page_number"), F.col("lang").alias("actual"), F.col("rule_doc_type").alias("predicted"))


_LABELS = (*LANGS, "OTHER")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_pairs(spark, sf_dir), _LABELS)


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.class_metrics(_pairs(spark, sf_dir), _LABELS)
    return rows.select("doc_type", "support", "predicted_count", "true_positives", "false_positives", "false_negatives", *(t.four_places(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    macro = evaluate.macro_f1(evaluate.class_metrics(pairs, _LABELS)).scalar()
    return evaluate.overall(pairs).select("total_pages", F.round("accuracy", 9).alias("accuracy"), F.round(macro, 9).alias("macro_f1_supported"))


def misclassified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.misclassified(_pairs(spark, sf_dir)).select(F.col("page_number").alias("doc_id"), "actual", "predicted")


def physical_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _pages(spark, sf_dir).select("package_id", "page_number", F.col("lang").alias("doc_type"))
    return group.physical_groups(results).select("package_id", "group_id", "doc_type", "start_page", "end_page", "page_count", t.joined("physical_pages").alias("physical_pages"))


def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("package_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("role").alias("doc_type"))
    return group.physical_groups(results).select("package_id", "doc_type", "start_page", "end_page", "page_count")


def _order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pages of a package per supplier: an instance per order, logical pages by line number, totals by flag."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", "l_partkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    return lines.select(
        F.col("l_suppkey").cast("string").alias("package_id"), F.row_number().over(order).alias("page_number"), F.col("l_returnflag").alias("doc_type"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("O#"), F.col("l_orderkey").cast("string"))).alias("instance_id"),
        F.when(F.col("l_orderkey") % 7 == 0, "NONE").otherwise("N_OF_M").alias("marker_style"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber")).alias("marker_page"),
        F.when(F.col("l_orderkey") % 4 != 0, 7).alias("marker_total"), F.array().cast("array<string>").alias("warnings"),
    )


_ORDER_PAGES_SQL = """
WITH pages AS (SELECT CAST(l_suppkey AS VARCHAR) AS package_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) AS INTEGER) AS page_number,
  l_returnflag AS doc_type, CASE WHEN l_orderkey % 3 <> 0 THEN 'O#' || CAST(l_orderkey AS VARCHAR) END AS instance_id, CASE WHEN l_orderkey % 7 = 0 THEN 'NONE' ELSE 'N_OF_M' END AS marker_style,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_linenumber END AS marker_page, CASE WHEN l_orderkey % 4 <> 0 THEN 7 END AS marker_total FROM lineitem),
 kept AS (SELECT *, CASE WHEN instance_id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM pages WHERE marker_page IS NOT NULL AND (instance_id IS NOT NULL OR marker_style <> 'NONE'))
"""


def reconstructed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = group.reconstruct(group.flag_orphans(_order_pages(spark, sf_dir)))
    mapping = F.array_sort(F.transform("page_links", lambda x: F.struct(x["logical_page"].alias("l"), x["physical_page"].alias("p"))))
    return docs.select(
        "package_id", "doc_id", "doc_type", F.coalesce("instance_id", F.lit("")).alias("instance_id"), "marker_style", "expected_pages", *(t.joined(c).alias(c) for c in ("observed_logical_pages", "missing_logical_pages", "duplicate_logical_pages")),
        "first_page_at", "last_page_at", "physical_span", t.truth_value("is_contiguous").alias("is_contiguous"), "completeness", t.joined("issues").alias("issues"),
        F.array_join(F.transform(mapping, lambda x: F.concat(x["l"].cast("string"), F.lit("->"), x["p"].cast("string"))), ";").alias("logical_to_physical"),
    )


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.orphans(group.flag_orphans(_order_pages(spark, sf_dir)))


def _url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    pages = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("package_id"), F.col("page_id").cast("int").alias("page_number"), "url", F.when(lang.isin(*LANGS), lang).otherwise("OTHER").alias("doc_type"))
    return extract.with_markers(pages, "url", rules())


def url_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_pages(spark, sf_dir).select(F.col("page_number").cast("long").alias("page_id"), *(F.try_element_at("raw_identifiers", F.lit(k)).alias(k) for k in ("host", "number")))


def instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = group.assign_instances(_url_pages(spark, sf_dir), rules(), "page_number")
    return rows.select(F.col("page_number").cast("long").alias("page_id"), "doc_type", "instance_id")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber").cast("string")
    key = F.col("l_orderkey")
    body = F.when(key % 4 == 0, F.concat(F.lit("Page "), number, F.lit(" of 7"))).when(key % 4 == 1, F.concat(number, F.lit(" OF 5 end"))).when(key % 4 == 2, F.concat(F.lit("page "), number, F.lit(" of 501"))).otherwise(F.lit("no marker"))
    rows = extract.with_markers(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", body.alias("body")), "body", rules())
    return rows.groupBy((key % 4).alias("kind"), "l_linenumber", F.col("marker.style").alias("style"), F.col("marker.page").alias("page"), F.col("marker.total").alias("total")).agg(F.count("*").alias("n"))


def masked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "text").select("doc_id", F.sha2(masking.masked("text", rules().mask), 256).alias("masked_sha256"))


def masked_natively(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "text").select("doc_id", F.sha2(masking.masked_natively("text", rules().mask), 256).alias("masked_sha256"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "text").select("doc_id", t.truncated(F.col("text"), 300).alias("excerpt"))


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delegate.batches(_pages(spark, sf_dir).select("package_id", "page_number"), 10)


def _fake(prompt: str, user: str, settings: delegate.Settings) -> dict:
    """A classifier for tests: decides by page number, badly for some."""
    ids = [int(line.split(": ")[1]) for line in user.splitlines() if line.startswith("page_id: ")]
    decisions = [{"page_id": i, "doc_type": "wrong" if i % 11 == 0 else LANGS[i % 4], "confidence": 0.5, "evidence": "none"} for i in ids if i % 13 != 0]
    return {"decisions": decisions}


def delegated_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = delegate.Settings(enabled=True, batch_size=10, max_retries=0)
    pages = _pages(spark, sf_dir).select("package_id", "page_number", "text", F.lit(None).cast("int").alias("marker_page"), F.lit(None).cast("int").alias("marker_total"), F.lit("NONE").alias("marker_style"))
    asked = delegate.batches(delegate.requests(pages, rules(), settings), settings.batch_size)
    answered = delegate.answers(asked, _fake, settings, (*LANGS, "OTHER"))
    plain = pages.select("package_id", "page_number", F.lit("OTHER").alias("doc_type"), F.array().cast("array<string>").alias("warnings"))
    return delegate.resolved(plain, answered).select("package_id", "page_number", "doc_type", "decision_source", t.truth_value("llm_failed").alias("llm_failed"), t.joined("warnings").alias("warnings"))


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as shuffled pages, and those with a label as the pages that they were taken from; a package per language."""
    pages = match.hashed(_documents(spark, sf_dir, "text", "lang").withColumnRenamed("lang", "package_id"))
    labelled = pages.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    sources = labelled.select("package_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"), F.col("doc_id").alias("source_page"), "hash")
    return pages.select("package_id", F.col("doc_id").alias("page_number"), "hash"), sources


def hash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matches(*_hashed(spark, sf_dir))


def hash_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unmatched(*_hashed(spark, sf_dir))


def hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.source_collisions(_hashed(spark, sf_dir)[1])
    return found.select("package_id", "hash", "n", F.col("first.source_page").alias("first_page"), F.col("last.source_page").alias("last_page"))


def multiple_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.multiple_claims(hash_matches(spark, sf_dir))


def unequal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unequal_counts(*_hashed(spark, sf_dir))


def incomplete_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as packages, turns as pages: which of them lack a turn or hold one twice, of as many as their last turn says."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("package_id"), (F.col("turn") + 1).alias("page_number"), "text")
    expected = turns.groupBy("package_id").agg(F.count("*").alias("n"))
    kept = turns.where(F.length("text") >= 40)
    return match.incomplete_numbers(kept, expected).select("package_id", "n")


def truth_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = hash_matches(spark, sf_dir)
    return match.label_distribution(matched.select(F.col("label").alias("doc_type")))


def misaligned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as truth, all documents as predictions, copies of a text as pages of one number: every check fails for some."""
    docs = _documents(spark, sf_dir, "lang").select(F.lit("all").alias("package_id"), F.floor(F.col("doc_id") / 3).cast("int").alias("page_number"), F.col("lang").alias("doc_type"), "doc_id")
    truth = docs.join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return evaluate.misaligned(truth, docs.where("doc_type != 'es'"), ("en", "fr", "es")).select("nr", "page_number")


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir, "source").withColumns({"package_id": F.col("source"), "page_number": F.col("doc_id"), "targeted": F.col("delegate"), "is_orphan": F.col("doc_id") % 10 == 0})
    counts = report.run_counters(rows)
    return counts.select("package_id", "total_pages", "rule_resolved", "llm_called", "llm_target_count", "orphan_count", "empty_text_count", t.joined("llm_target_pages").alias("llm_target_pages"), t.joined("orphan_pages").alias("orphan_pages"))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir).withColumns({"page_number": F.col("doc_id"), "targeted": F.col("delegate"), "is_orphan": F.col("doc_id") % 10 == 0})
    return report.run_totals(rows).select("total_pages", "rule_resolved", "llm_called", "llm_target_count", "orphan_count", "empty_text_count")


def page_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    results = pages.select("package_id", "page_number", F.when(F.col("doc_id") % 9 == 0, "URLA_1003").otherwise("OTHER").alias("doc_type"))
    truth = pages.select("package_id", "page_number", F.when(F.col("doc_id") % 6 == 0, "URLA_1003").otherwise("OTHER").alias("doc_type"))
    tiles = report.tile_layout(results, truth)
    return tiles.select("package_id", "page_number", "band", "place", "predicted_colour", "actual_colour", t.truth_value("mismatch").alias("mismatch"))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.heatmap_cells(confusion_matrix(spark, sf_dir), _LABELS).select("actual", "predicted", "row", "column", "n", F.round("share", 9).alias("share"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.personal_data(_documents(spark, sf_dir, "text").select("text"))


_WINDOW_SQL = "substr(text, 1, 300)"
_LAST = lambda mark, size: f"CASE WHEN contains({_WINDOW_SQL}, {mark}) THEN 300 - instr(reverse({_WINDOW_SQL}), reverse({mark})) + 1 - {size} ELSE -1 END"
_CUT = lambda n: f"regexp_replace(substr({_WINDOW_SQL}, 1, {n}), '\\s+$', '')"
_PAGES_SQL = "SELECT source AS package_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_number, text, lang, doc_id FROM documents"
_PAIRS_SQL = f"{_RANKED_SQL}, pairs AS (SELECT doc_id, lang AS actual, label AS predicted FROM scored), labels AS (SELECT unnest(['en','fr','de','es','OTHER']) AS l)"
_METRICS_SQL = f"""{_PAIRS_SQL}, m AS (SELECT l AS doc_type, (SELECT count(*) FROM pairs WHERE actual = l) AS support, (SELECT count(*) FROM pairs WHERE predicted = l) AS predicted_count, (SELECT count(*) FROM pairs WHERE predicted = l AND actual = l) AS tp FROM labels),
 p AS (SELECT *, CASE WHEN predicted_count > 0 THEN tp::DOUBLE / predicted_count END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE / support END AS recall FROM m),
 f AS (SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision = 0 AND recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p)"""
_HASHED_SQL = """WITH h AS (SELECT doc_id, lang AS package_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS hash FROM documents), s AS (SELECT h.package_id, 'q' || CAST(quality AS VARCHAR) AS label, h.doc_id AS source_page, hash FROM h JOIN labels USING (doc_id)),
 f AS (SELECT package_id, hash, count(*) AS candidates, min((label, source_page)) AS first FROM s GROUP BY 1, 2),
 m AS (SELECT h.package_id, h.doc_id AS page_number, first[1] AS label, first[2] AS source_page, candidates FROM h JOIN f ON h.package_id = f.package_id AND h.hash = f.hash)"""
_NUMBERED = lambda prefix, n: f"'{prefix}' || CASE WHEN length(CAST({n} AS VARCHAR)) < 3 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"
_RUNS_SQL = lambda source: f"""WITH p AS ({source}), f AS (SELECT *, CASE WHEN page_number = lag(page_number) OVER w + 1 AND doc_type = lag(doc_type) OVER w THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY package_id ORDER BY page_number)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY package_id ORDER BY page_number) AS run FROM f),
 g AS (SELECT package_id, run, min(doc_type) AS doc_type, CAST(min(page_number) AS INTEGER) AS start_page, CAST(max(page_number) AS INTEGER) AS end_page, CAST(count(*) AS INTEGER) AS page_count, string_agg(CAST(page_number AS VARCHAR), ';' ORDER BY page_number) AS physical_pages FROM r GROUP BY package_id, run)"""  # noqa: E731
_URLS_SQL = """WITH u AS (SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS package_id, CASE WHEN regexp_extract(url, '://[^/]*/([a-z]+)/', 1) IN ('en','fr','de','es') THEN regexp_extract(url, '://[^/]*/([a-z]+)/', 1) ELSE 'OTHER' END AS doc_type,
  CASE WHEN regexp_matches(url, '://([a-z.]+)') THEN regexp_extract(url, '://([a-z.]+)', 1) END AS host, CASE WHEN regexp_matches(url, '/(\\d{2,6})') THEN regexp_extract(url, '/(\\d{2,6})', 1) END AS number FROM pages)"""
_MASK_SQL = "sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+', '[EMAIL]', 'g'), '\\(?\\d{3}\\)?[-. ]\\d{3}[-.]\\d{4}', '[PHONE]', 'g'))"

_COUNTERS_SQL = f"count(*) AS total_pages, count(*) AS rule_resolved, 0::BIGINT AS llm_called, count(*) FILTER (WHERE {_DELEGATE_SQL} <> '') AS llm_target_count, count(*) FILTER (WHERE doc_id % 10 = 0) AS orphan_count, count(*) FILTER (WHERE len = 0) AS empty_text_count"

#: Each query with its SQL.
REGISTERED: dict[str, tuple[Query, str | None]] = {
    "normalized_length": (normalized_length, "SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS INTEGER) AS normalized_text_length FROM documents"),
    "page_hash_copies": (page_hash_copies, "SELECT sha256(regexp_replace(text, '\\s+', '', 'g')) AS hash, count(*) AS n, min(doc_id) AS first_page, max(doc_id) AS last_page FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "classify_documents": (classify_documents, f"{_RANKED_SQL} SELECT doc_id, label, round(score, 9) AS score, round(margin, 9) AS margin, classes FROM scored"),
    "matched_signals": (matched_signals, "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {_has(s)} THEN '{s}' END" for b in RULES["doc_types"].values() for s in (*b["strong"], *b["weak"])) + f") AS signals, CASE WHEN strong = 1 AND label = 'en' THEN 'True' ELSE 'False' END AS strong FROM ({_RANKED_SQL} SELECT scored.*, d.text FROM scored JOIN documents d USING (doc_id))"),
    "delegation": (delegation, f"{_RANKED_SQL} SELECT doc_id, {_DELEGATE_SQL} AS reasons, CASE WHEN {_DELEGATE_SQL} <> '' THEN 'True' ELSE 'False' END AS delegate FROM scored"),
    "label_counts": (label_counts, f"{_RANKED_SQL} SELECT label, count(*) AS n, count(*) FILTER (WHERE {_DELEGATE_SQL} <> '') AS delegated FROM scored GROUP BY label"),
    "confusion_matrix": (confusion_matrix, f"{_PAIRS_SQL} SELECT a.l AS actual, b.l AS predicted, (SELECT count(*) FROM pairs WHERE actual = a.l AND predicted = b.l) AS n FROM labels a, labels b"),
    "class_metrics": (class_metrics, f"{_METRICS_SQL} SELECT doc_type, support, predicted_count, tp AS true_positives, predicted_count - tp AS false_positives, support - tp AS false_negatives, coalesce(printf('%.4f', precision), 'N/A') AS precision, coalesce(printf('%.4f', recall), 'N/A') AS recall, coalesce(printf('%.4f', f1), 'N/A') AS f1 FROM f"),
    "overall_metrics": (overall_metrics, f"{_METRICS_SQL} SELECT (SELECT count(*) FROM pairs) AS total_pages, round((SELECT avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END) FROM pairs), 9) AS accuracy, round((SELECT coalesce(avg(f1), 0) FROM f WHERE support > 0), 9) AS macro_f1_supported"),
    "misclassified_pages": (misclassified_pages, f"{_PAIRS_SQL} SELECT doc_id, actual, predicted FROM pairs WHERE actual <> predicted"),
    "physical_runs": (physical_runs, _RUNS_SQL(f"SELECT package_id, page_number, lang AS doc_type FROM ({_PAGES_SQL})") + f" SELECT package_id, {_NUMBERED('PG', 'CAST(run AS BIGINT)')} AS group_id, doc_type, start_page, end_page, page_count, physical_pages FROM g"),
    "conversation_runs": (conversation_runs, _RUNS_SQL("SELECT CAST(conv_id AS VARCHAR) AS package_id, turn + 1 AS page_number, role AS doc_type FROM conversations") + " SELECT package_id, doc_type, start_page, end_page, page_count FROM g"),
    "reconstructed_orders": (reconstructed_orders, f"""{_ORDER_PAGES_SQL},
 d AS (SELECT package_id, doc_type, instance_id, marker_style, marker_total, list(marker_page ORDER BY marker_page) AS obs, list(DISTINCT page_number) AS phys, min(page_number) AS first, min(CASE WHEN marker_page = 1 THEN page_number END) AS first_page_at,
   max(marker_page) AS top, max(tier) AS tier, string_agg(CAST(marker_page AS VARCHAR) || '->' || CAST(page_number AS VARCHAR), ';' ORDER BY marker_page, page_number) AS logical_to_physical FROM kept GROUP BY ALL),
 e AS (SELECT d.*, (SELECT min(k.page_number) FROM kept k WHERE k.package_id = d.package_id AND k.doc_type = d.doc_type AND k.instance_id IS NOT DISTINCT FROM d.instance_id AND k.marker_style = d.marker_style AND k.marker_total IS NOT DISTINCT FROM d.marker_total AND k.marker_page = d.top) AS last_page_at,
   list_sort(list_distinct(list_filter(obs, lambda x: len(list_filter(obs, lambda y: y = x)) > 1))) AS dup, list_filter(range(1, coalesce(marker_total, 0) + 1), lambda x: NOT list_contains(obs, x)) AS miss,
   row_number() OVER (PARTITION BY package_id ORDER BY first) AS nr, count(*) OVER (PARTITION BY package_id, doc_type, instance_id, marker_style) AS totals FROM d)
 SELECT package_id, {_NUMBERED('RD', 'nr')} AS doc_id, doc_type, coalesce(instance_id, '') AS instance_id, marker_style, CAST(marker_total AS INTEGER) AS expected_pages, array_to_string(obs, ';') AS observed_logical_pages, coalesce(array_to_string(miss, ';'), '') AS missing_logical_pages,
   coalesce(array_to_string(dup, ';'), '') AS duplicate_logical_pages, first_page_at, last_page_at, CASE WHEN list_min(phys) = list_max(phys) THEN CAST(list_min(phys) AS VARCHAR) ELSE list_min(phys) || '-' || list_max(phys) END AS physical_span,
   CASE WHEN len(phys) = list_max(phys) - list_min(phys) + 1 THEN 'True' ELSE 'False' END AS is_contiguous, CASE WHEN marker_total IS NULL THEN 'UNKNOWN_EXTENT' WHEN len(miss) = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS completeness,
   concat_ws(';', CASE WHEN len(dup) > 0 THEN 'DUPLICATE_PAGE' END, CASE WHEN tier = 2 THEN 'AMBIGUOUS_ATTACHMENT' END, CASE WHEN totals > 1 THEN 'CONFLICTING_MARKER_TOTAL' END) AS issues, logical_to_physical FROM e"""),
    "orphan_pages": (orphan_pages, f"{_ORDER_PAGES_SQL} SELECT package_id, page_number, doc_type, CASE WHEN marker_page IS NULL THEN 'no marker_page' ELSE 'no instance_id, no marker style' END AS reason FROM pages WHERE marker_page IS NULL OR (instance_id IS NULL AND marker_style = 'NONE')"),
    "url_identifiers": (url_identifiers, f"{_URLS_SQL} SELECT page_id, host, number FROM u"),
    "instance_ids": (instance_ids, f"""{_URLS_SQL}, k AS (SELECT page_id, package_id, doc_type, CASE WHEN doc_type = 'OTHER' OR (host IS NULL AND (number IS NULL OR doc_type NOT IN ('en','fr'))) THEN NULL ELSE coalesce(host, '-') || '|' || CASE WHEN doc_type IN ('en','fr') THEN coalesce(number, '-') ELSE '' END END AS key FROM u),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY package_id, doc_type, key) AS first FROM k), n AS (SELECT *, dense_rank() OVER (PARTITION BY package_id, doc_type ORDER BY CASE WHEN key IS NULL THEN NULL ELSE first END NULLS LAST) AS nr FROM f)
 SELECT page_id, doc_type, CASE WHEN key IS NOT NULL THEN doc_type || '#' || CAST(nr AS VARCHAR) END AS instance_id FROM n"""),
    "markers": (markers, """SELECT l_orderkey % 4 AS kind, l_linenumber, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber <= 7 THEN 'PAGE_N_OF_M' WHEN l_orderkey % 4 = 1 AND l_linenumber <= 5 THEN 'N_OF_M' ELSE 'NONE' END AS style,
 CASE WHEN (l_orderkey % 4 = 0 AND l_linenumber <= 7) OR (l_orderkey % 4 = 1 AND l_linenumber <= 5) THEN l_linenumber END AS page, CAST(CASE WHEN l_orderkey % 4 = 0 AND l_linenumber <= 7 THEN 7 WHEN l_orderkey % 4 = 1 AND l_linenumber <= 5 THEN 5 END AS INTEGER) AS total, count(*) AS n FROM lineitem GROUP BY ALL"""),
    "masked_contacts": (masked_contacts, f"SELECT doc_id, {_MASK_SQL} AS masked_sha256 FROM documents"),
    "masked_natively": (masked_natively, f"SELECT doc_id, {_MASK_SQL} AS masked_sha256 FROM documents"),
    "excerpts": (excerpts, f"SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN {_LAST(chr(39) + '. ' + chr(39), 2)} > 150 THEN {_CUT('(' + _LAST(chr(39) + '. ' + chr(39), 2) + ') + 2')} WHEN {_LAST('chr(10)', 1)} > 150 THEN {_CUT('(' + _LAST('chr(10)', 1) + ') + 1')} WHEN {_LAST(chr(39) + ' ' + chr(39), 1)} > 0 THEN {_CUT(_LAST(chr(39) + ' ' + chr(39), 1))} ELSE {_WINDOW_SQL} END AS excerpt FROM documents"),
    "request_batches": (request_batches, f"SELECT package_id, page_number, CAST((page_number - 1) // 10 AS INTEGER) AS batch_index FROM ({_PAGES_SQL})"),
    "delegated_resolution": (delegated_resolution, f"""WITH p AS (SELECT package_id, page_number, (page_number - 1) // 10 AS b FROM ({_PAGES_SQL})), w AS (SELECT *, page_number % 13 <> 0 AND page_number % 11 <> 0 AS ok, sum(CASE WHEN page_number % 11 = 0 AND page_number % 13 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY package_id, b) AS bad FROM p)
 SELECT package_id, page_number, CASE WHEN ok THEN ['en','fr','de','es'][page_number % 4 + 1] ELSE 'OTHER' END AS doc_type, CASE WHEN ok THEN 'LLM' ELSE 'RULE_FALLBACK' END AS decision_source, CASE WHEN ok THEN 'False' ELSE 'True' END AS llm_failed,
 CASE WHEN ok THEN '' ELSE repeat('LLM_LABEL_INVALID;', CAST(bad AS BIGINT)) || 'LLM_COUNT_MISMATCH' END AS warnings FROM w"""),
    "hash_matches": (hash_matches, f"{_HASHED_SQL} SELECT * FROM m"),
    "hash_unmatched": (hash_unmatched, f"{_HASHED_SQL} SELECT h.package_id, doc_id AS page_number FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.package_id = h.package_id AND s.hash = h.hash)"),
    "hash_collisions": (hash_collisions, f"{_HASHED_SQL} SELECT package_id, hash, count(*) AS n, min_by(source_page, (label, source_page)) AS first_page, max_by(source_page, (label, source_page)) AS last_page FROM s GROUP BY package_id, hash HAVING count(*) > 1"),
    "multiple_claims": (multiple_claims, f"{_HASHED_SQL} SELECT package_id, label, source_page, count(*) AS n, min(page_number) AS first_page, max(page_number) AS last_page FROM m GROUP BY package_id, label, source_page HAVING count(*) > 1"),
    "unequal_counts": (unequal_counts, f"{_HASHED_SQL}, c AS (SELECT package_id, count(*) AS shuffled FROM h GROUP BY 1), d AS (SELECT package_id, count(*) AS source FROM s GROUP BY 1) SELECT package_id, coalesce(shuffled, 0) AS shuffled, coalesce(source, 0) AS source FROM c FULL JOIN d USING (package_id) WHERE coalesce(shuffled, 0) <> coalesce(source, 0)"),
    "incomplete_numbers": (incomplete_numbers, """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS package_id, turn + 1 AS page_number, text FROM conversations), e AS (SELECT package_id, count(*) AS n FROM t GROUP BY 1)
 SELECT package_id, n FROM e WHERE NOT (n = (SELECT count(*) FROM t WHERE t.package_id = e.package_id AND length(text) >= 40) AND n = (SELECT count(DISTINCT page_number) FROM t WHERE t.package_id = e.package_id AND length(text) >= 40)
   AND (SELECT coalesce(min(page_number), 0) FROM t WHERE t.package_id = e.package_id AND length(text) >= 40) = 1 AND (SELECT coalesce(max(page_number), 0) FROM t WHERE t.package_id = e.package_id AND length(text) >= 40) = n)"""),
    "truth_distribution": (truth_distribution, f"{_HASHED_SQL} SELECT label AS doc_type, count(*) AS n FROM m GROUP BY label"),
    "misaligned_pages": (misaligned_pages, """WITH d AS (SELECT doc_id, doc_id // 3 AS page_number, lang AS doc_type FROM documents), t AS (SELECT d.* FROM d JOIN labels USING (doc_id)), p AS (SELECT * FROM d WHERE doc_type <> 'es'),
 bad AS (SELECT 0 AS nr, page_number FROM t GROUP BY page_number HAVING count(*) > 1 UNION ALL SELECT 1, page_number FROM p GROUP BY page_number HAVING count(*) > 1 UNION ALL SELECT DISTINCT 2, page_number FROM t WHERE page_number NOT IN (SELECT page_number FROM p)
  UNION ALL SELECT DISTINCT 3, page_number FROM p WHERE page_number NOT IN (SELECT page_number FROM t) UNION ALL SELECT DISTINCT 4, page_number FROM t WHERE doc_type NOT IN ('en', 'fr', 'es') UNION ALL SELECT DISTINCT 5, page_number FROM p WHERE doc_type NOT IN ('en', 'fr', 'es'))
 SELECT CAST(nr AS INTEGER) AS nr, CAST(page_number AS INTEGER) AS page_number FROM bad"""),
    "run_counters": (run_counters, f"{_RANKED_SQL} SELECT source AS package_id, {_COUNTERS_SQL}, coalesce(string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) FILTER (WHERE {_DELEGATE_SQL} <> ''), '') AS llm_target_pages, coalesce(string_agg(CAST(doc_id AS VARCHAR), ';' ORDER BY doc_id) FILTER (WHERE doc_id % 10 = 0), '') AS orphan_pages FROM scored JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source"),
    "run_totals": (run_totals, f"{_RANKED_SQL} SELECT {_COUNTERS_SQL} FROM scored"),
    "page_tiles": (page_tiles, f"""SELECT package_id, page_number, CAST((page_number - 1) // 40 AS INTEGER) AS band, CAST((page_number - 1) % 40 AS INTEGER) AS place, CASE WHEN doc_id % 9 = 0 THEN '#0072B2' ELSE '#999999' END AS predicted_colour,
 CASE WHEN doc_id % 6 = 0 THEN '#0072B2' ELSE '#999999' END AS actual_colour, CASE WHEN (doc_id % 9 = 0) <> (doc_id % 6 = 0) THEN 'True' ELSE 'False' END AS mismatch FROM ({_PAGES_SQL})"""),
    "heatmap": (heatmap, f"""{_PAIRS_SQL}, c AS (SELECT a.l AS actual, b.l AS predicted, (SELECT count(*) FROM pairs WHERE actual = a.l AND predicted = b.l) AS n FROM labels a, labels b)
 SELECT actual, predicted, CAST(list_position(['en','fr','de','es','OTHER'], actual) - 1 AS INTEGER) AS row, CAST(list_position(['en','fr','de','es','OTHER'], predicted) - 1 AS INTEGER) AS "column", n, round(CASE WHEN sum(n) OVER (PARTITION BY actual) > 0 THEN n::DOUBLE / sum(n) OVER (PARTITION BY actual) END, 9) AS share FROM c"""),
    "personal_data": (personal_data, "SELECT count(*) FILTER (WHERE regexp_matches(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b')) AS SSN_like, count(*) FILTER (WHERE regexp_matches(text, '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+\\b')) AS email_like FROM documents"),
}


def _registered() -> dict[str, tuple[Query, str | None]]:
    from . import run_queries

    return REGISTERED | run_queries.REGISTERED


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}
