import random

import pytest
from pyspark.sql import functions as F

from leafwright import schema
from leafwright.operators import group, match, report
from leafwright.plans.rulepack import load_rules

PAGE = "package_id string, page_number int, doc_type string, marker_style string, marker_page int, marker_total int, instance_id string, warnings array<string>"


def _pages(spark, rows):
    return spark.createDataFrame([("p", *r, []) for r in rows], PAGE)


def _docs(spark, rows):
    return group.reconstruct(group.flag_orphans(_pages(spark, rows))).orderBy("doc_id").collect()


def test_runs(spark):
    rows = [(1, "A"), (2, "A"), (3, "B"), (5, "B"), (6, "A"), (7, "A"), (8, "A")]
    df = spark.createDataFrame([("p", *r) for r in rows] + [("q", 1, "B")], "package_id string, page_number int, doc_type string")
    got = group.physical_groups(df).orderBy("package_id", "start_page")
    schema.validate(got, schema.group_invariants())
    assert [(r.package_id, r.group_id, r.doc_type, r.physical_pages) for r in got.collect()] == [
        ("p", "PG001", "A", [1, 2]), ("p", "PG002", "B", [3]), ("p", "PG003", "B", [5]), ("p", "PG004", "A", [6, 7, 8]), ("q", "PG001", "B", [1]),
    ]
    assert group.physical_groups(df.limit(0)).count() == 0


def test_complete_incomplete_and_unknown(spark):
    docs = _docs(spark, [(4, "A", "N_OF_M", 2, 3, None), (2, "A", "N_OF_M", 1, 3, None), (9, "A", "N_OF_M", 3, 3, None), (5, "B", "PAGE_N_OF_M", 2, 3, "B#1"), (6, "C", "CLTA_PAGE_N", 4, None, None)])
    assert [(d.doc_id, d.doc_type, d.completeness, d.missing_logical_pages, d.first_page_at, d.last_page_at, d.physical_span, d.is_contiguous, d.issues) for d in docs] == [
        ("RD001", "A", "COMPLETE", [], 2, 9, "2-9", False, ["AMBIGUOUS_ATTACHMENT"]), ("RD002", "B", "INCOMPLETE", [1, 3], None, 5, "5", True, []), ("RD003", "C", "UNKNOWN_EXTENT", [], None, 6, "6", True, ["AMBIGUOUS_ATTACHMENT"]),
    ]
    assert docs[1].page_links[0].evidence == ["identifier_and_marker_match"] and docs[0].page_links[0].evidence == ["marker_match_within_unique_instance"]


def test_duplicates_and_conflicts_are_flagged(spark):
    docs = _docs(spark, [(1, "A", "N_OF_M", 1, 2, "A#1"), (2, "A", "N_OF_M", 1, 2, "A#1"), (3, "A", "N_OF_M", 2, 2, "A#1"), (4, "A", "N_OF_M", 1, 5, "A#1"), (5, "A", "N_OF_M", 2, None, "A#1")])
    assert [(d.expected_pages, d.observed_logical_pages, d.duplicate_logical_pages, d.issues) for d in docs] == [
        (2, [1, 1, 2], [1], ["DUPLICATE_PAGE", "CONFLICTING_MARKER_TOTAL"]), (5, [1], [], ["CONFLICTING_MARKER_TOTAL"]), (None, [2], [], ["CONFLICTING_MARKER_TOTAL"]),
    ]
    schema.validate(group.reconstruct(group.flag_orphans(_pages(spark, [(1, "A", "N_OF_M", 1, 2, "A#1")]))), schema.document_invariants())


def test_orphans(spark):
    flagged = group.flag_orphans(_pages(spark, [(1, "A", "NONE", None, None, "A#1"), (2, "A", "NONE", 1, 2, None), (3, "A", "N_OF_M", 1, 2, None)]))
    assert {r.page_number: (r.is_orphan, r.warnings) for r in flagged.collect()} == {1: (True, ["ORPHAN_PAGE"]), 2: (True, ["ORPHAN_PAGE"]), 3: (False, [])}
    assert {r.page_number: r.reason for r in group.orphans(flagged).collect()} == {1: "no marker_page", 2: "no instance_id, no marker style"}


def test_instances(spark):
    rules = load_rules()
    rows = [
        (1, "CREDIT_REPORT", {"loan_number": "1"}, 2), (2, "CREDIT_REPORT", {"loan_number": "2", "prelim_number": "x"}, 1), (3, "CREDIT_REPORT", {"loan_number": "1"}, 3), (4, "URLA_1003", {"loan_number": "1"}, 4),
        (5, "URLA_1003", {"loan_number": "1", "form_family": "f"}, 5), (6, "TITLE_REPORT", {"loan_number": "1"}, 6), (7, "OTHER", {}, 7),
    ]
    df = spark.createDataFrame([("p", *r) for r in rows], "package_id string, page_number int, doc_type string, raw_identifiers map<string,string>, emit_order int")
    got = {r.page_number: r.instance_id for r in group.assign_instances(df, rules).collect()}
    assert got == {1: "CREDIT_REPORT#2", 2: "CREDIT_REPORT#1", 3: "CREDIT_REPORT#2", 4: "URLA_1003#1", 5: "URLA_1003#2", 6: None, 7: None}


def test_row_order_changes_nothing(spark):
    r = random.Random(3)
    rows = [(i, r.choice("AB"), "N_OF_M", r.randrange(1, 5), r.choice([4, 5, None]), r.choice(["x", None])) for i in range(1, 60)]
    one, two = _docs(spark, rows), None
    r.shuffle(rows)
    two = group.reconstruct(group.flag_orphans(_pages(spark, rows).repartition(7))).orderBy("doc_id").collect()
    assert one == two


def test_numbers_grow_past_three_digits(spark):
    assert [r[0] for r in spark.range(3).select(group.numbered("PG", F.col("id") * 1000 + 7)).collect()] == ["PG007", "PG1007", "PG2007"]


def _sources(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "package_id string, label string, source_page int, text string")


def _shuffled(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "package_id string, page_number int, text string")


def test_ground_truth(spark):
    sources = _sources(spark, [("A", 1, "a b"), ("A", 2, "c"), ("B", 1, "d")])
    got = match.ground_truth(_shuffled(spark, [(1, "d\n"), (2, "ab"), (3, "c ")]), sources, {"A": "a.pdf", "B": "b.pdf"}).orderBy("page_number").collect()
    assert [(r.page_number, r.doc_type, r.source_document, r.source_page) for r in got] == [(1, "B", "b.pdf", 1), (2, "A", "a.pdf", 1), (3, "A", "a.pdf", 2)]


@pytest.mark.parametrize(("sources", "shuffled", "message"), [
    ([("A", 1, "a")], [(1, "a"), (2, "b")], "page count"),
    ([("A", 1, "a"), ("B", 1, " a")], [(1, "a"), (2, "b")], "collision"),
    ([("A", 1, "a"), ("B", 1, "b")], [(1, "a"), (2, "x")], "match no source"),
    ([("A", 1, "a"), ("B", 1, "b")], [(1, "a"), (2, "a")], "more than one"),
    ([("A", 1, "a"), ("B", 1, "b")], [(1, "a"), (3, "b")], "not complete"),
    ([("A", 1, ""), ("B", 1, " ")], [(1, ""), (2, "")], "collision"),
])
def test_ground_truth_errors(spark, sources, shuffled, message):
    with pytest.raises(ValueError, match=message):
        match.ground_truth(_shuffled(spark, shuffled), _sources(spark, sources))


def test_bands():
    assert report.bands(39) == [(1, 39)] and report.bands(100) == [(1, 40), (41, 80), (81, 100)] and report.bands(0) == []


def test_tiles_and_heat_map(spark):
    results = spark.createDataFrame([("p", 1, "OTHER"), ("p", 41, "URLA_1003")], "package_id string, page_number int, doc_type string")
    truth = spark.createDataFrame([("p", 1, "OTHER"), ("p", 41, "OTHER")], "package_id string, page_number int, doc_type string")
    rows = report.tile_layout(results, truth).orderBy("page_number").collect()
    assert [(r.band, r.place, r.mismatch) for r in rows] == [(0, 0, False), (1, 0, True)]
    assert report.zero_support_note([{"doc_type": "A", "support": 0}, {"doc_type": "B", "support": 2}]).startswith("A") and report.zero_support_note([]) is None


@pytest.mark.parametrize("text", ["id 123-45-6789", "mail josé@ex.com"])
def test_personal_data_is_refused(spark, text):
    with pytest.raises(ValueError, match="Refusing"):
        report.check_no_pii(spark.createDataFrame([("x", [text])], "a string, b array<string>"))
    with pytest.raises(ValueError):
        report.check_text(text)
    report.check_no_pii(spark.createDataFrame([("clean", ["12345"])], "a string, b array<string>"))
