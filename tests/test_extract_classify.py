import pytest

from leafwright.operators import classify, extract
from leafwright.plans.rulepack import check_strong_signals, compile_rules, load_rules, read_rules
from leafwright.sources import pages

RULES = load_rules()

MINI = {
    "scoring": {"strong_weight": 1.0, "weak_weight": 0.25, "evidence_saturation": 1.0, "case_sensitive": False},
    "delegation": {"strong_signature_short_circuit": True, "short_text_threshold": 10, "rule_score_threshold": 0.6, "rule_margin_threshold": 0.2, "delegate_on_conflicting_strong_signals": True, "require_multiple_classes_for_margin_check": True},
    "doc_types": {"A": {"strong": ["alpha form"], "weak": ["aa", "ab"]}, "B": {"strong": ["beta form"], "weak": ["bb", "bc"]}},
}


def _markers(spark, texts, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [tuple(r.marker) for r in extract.with_markers(df, "x", RULES, **kw).orderBy("i").collect()]


def test_markers(spark):
    cases = {
        "Page 7 of 11": ("PAGE_N_OF_M", 7, 11), "7 of 11": ("N_OF_M", 7, 11), "CLTA Preliminary Report Form x\ny Page 4": ("CLTA_PAGE_N", 4, None), "none": ("NONE", None, None),
        "Page 11 of 7": ("NONE", None, None), "1 of 501": ("NONE", None, None), "9 of 3 then 1 of 3": ("NONE", None, None), "2023 of 1000": ("N_OF_M", 23, 100), "0 of 5": ("NONE", None, None),
        "page 2\n of 3": ("PAGE_N_OF_M", 2, 3), "CLTA Preliminary Report Form Page 2 of 9, Page 3 of 9": ("CLTA_PAGE_N", 2, None), "Page ٣ of ٤": ("NONE", None, None),
    }
    assert _markers(spark, list(cases)) == list(cases.values())


def test_page_zero_fails_when_strict(spark):
    with pytest.raises(Exception, match="page number 0"):
        _markers(spark, ["0 of 5"], strict=True)


def test_identifiers_keep_case_and_first_hits(spark):
    df = spark.createDataFrame([("Loan Number: 123456 Loan Number: 999999 PRELIM NO. 12-3456",), ("loan number 123456",), ("Freddie  Mac Form 65",)], "x string")
    got = [r.raw_identifiers for r in extract.with_markers(df, "x", RULES).collect()]
    assert got == [{"loan_number": "123456", "prelim_number": "12-3456"}, {}, {"form_family": "Freddie  Mac Form 65"}]


def _classified(spark, texts, rules=None):
    raw = pages.from_rows(spark, [("p", i, x) for i, x in enumerate(texts, 1)])
    return classify.classify(extract.extract_pages(raw, RULES), rules or compile_rules(MINI)).orderBy("page_number").collect()


def test_scores(spark):
    rows = _classified(spark, ["an ALPHA Form of some length", "aa of some length here", "nothing of the kind at all", "aa and bb are both in here", "alpha form and beta form meet", "alpha form"])
    got = [(r.rule_doc_type, r.rule_score, r.rule_margin, r.matched_class_count, r.strong_signature_matched, r.delegation_reasons, r.warnings) for r in rows]
    assert got == [
        ("A", 1.0, 1.0, 1, True, [], []), ("A", 0.25, 1.0, 1, False, ["LOW_RULE_SCORE"], []), ("OTHER", 0.0, 0.0, 0, False, ["LOW_RULE_SCORE"], ["NO_SIGNATURE"]),
        ("A", 0.125, 0.0, 2, False, ["LOW_RULE_SCORE", "NARROW_RULE_MARGIN"], []), ("A", 0.5, 0.0, 2, True, ["CONFLICTING_SIGNALS"], []), ("A", 1.0, 1.0, 1, True, [], []),
    ]
    assert rows[3].rule_scores == {"A": 0.5, "B": 0.5} and rows[3].matched_signals == ["aa", "bb"]


def test_flags_default_to_off(spark):
    rules = compile_rules({**MINI, "delegation": {"short_text_threshold": 30, "rule_score_threshold": 0.6, "rule_margin_threshold": 0.2}})
    rows = _classified(spark, ["alpha form", "alpha form and beta form"], rules)
    assert rows[0].delegation_reasons == ["SHORT_TEXT"] and rows[1].delegation_reasons == ["SHORT_TEXT", "LOW_RULE_SCORE", "NARROW_RULE_MARGIN"]


def test_never_strong_is_checked_in_any_file():
    with pytest.raises(ValueError, match="CTEC"):
        check_strong_signals({"doc_types": {"A": {"strong": ["CTEC"]}}, "never_strong": ["CTEC"]})
    with pytest.raises(ValueError):
        compile_rules({**MINI, "never_strong": ["alpha form"]})
    assert RULES.version == read_rules()["version"] and len(RULES.labels) == 5


def test_large_packs_compile(spark):
    big = {**MINI, "doc_types": {f"C{i}": {"strong": [f"s{i}x{j}" for j in range(40)], "weak": []} for i in range(5)}}
    rows = _classified(spark, ["s3x17 is here and more"], compile_rules(big))
    assert rows[0].rule_doc_type == "C3"


def test_null_text_is_empty(spark):
    rows = _classified(spark, [None, ""])
    assert [(r.rule_doc_type, r.normalized_text_length) for r in rows] == [("OTHER", 0)] * 2


def test_plan_is_one_narrow_stage(spark):
    raw = pages.from_rows(spark, [("p", 1, "x")])
    plan = classify.classify(extract.extract_pages(raw, RULES), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
