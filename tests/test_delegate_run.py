import json

import pytest
from pyspark.sql import functions as F

from leafwright import run_queries, schema
from leafwright.operators import delegate, evaluate, report
from leafwright.plans import cli, materialise, run as runs
from leafwright.plans.rulepack import load_rules
from leafwright.plans.run import run
from leafwright.sources import pages, settings, sinks, truth
from leafwright.streaming import pages as streaming

RULES = load_rules()
ON = delegate.Settings(enabled=True, batch_size=2, max_retries=1)
STRONG = "Uniform Residential Loan Application " + "long enough text " * 10
ROWS = [("p", 1, STRONG + " 1 of 2"), ("p", 2, "short one"), ("p", 3, STRONG + " 2 of 2"), ("p", 4, "another 123-45-6789"), ("p", 5, "")]


def _raw(spark):
    return pages.from_rows(spark, ROWS)


def _item(page, label="OTHER", confidence=0.5, **more):
    return {"page_id": page, "doc_type": label, "confidence": confidence, "evidence": "", **more}


@pytest.mark.parametrize(("answer", "found", "warnings"), [
    ({"decisions": [_item(1), _item(2)]}, {1, 2}, []),
    (json.dumps({"decisions": [_item(1), _item(2)]}), {1, 2}, []),
    ({"decisions": [_item(1)]}, {1}, ["LLM_COUNT_MISMATCH"]),
    ({"decisions": [_item(1), _item(2, "url")]}, {1}, ["LLM_LABEL_INVALID", "LLM_COUNT_MISMATCH"]),
    ({"decisions": [_item(1), _item(2, confidence=1.5)]}, {1}, ["LLM_LABEL_INVALID", "LLM_COUNT_MISMATCH"]),
    ({"decisions": [_item(1), _item(2), _item(9)]}, {1, 2}, []),
    ({"decisions": [_item("1", confidence="0.5"), _item(2.0, confidence=True)]}, {1, 2}, []),
    ({"decisions": [_item(1.5), _item(2, extra=1)]}, set(), ["LLM_LABEL_INVALID", "LLM_LABEL_INVALID", "LLM_COUNT_MISMATCH"]),
    ({"decisions": [_item(1, confidence=float("nan")), {**_item(2), "evidence": "x" * 201}]}, set(), ["LLM_LABEL_INVALID", "LLM_LABEL_INVALID", "LLM_COUNT_MISMATCH"]),
    ("not json", set(), ["LLM_PARSE_FAILED"]), ({"decisions": 3}, set(), ["LLM_PARSE_FAILED"]), (None, set(), ["LLM_PARSE_FAILED"]),
])
def test_answers_are_validated(answer, found, warnings):
    got, said = delegate.read_answer(answer, [1, 2])
    assert set(got) == found and said == warnings


def test_last_of_several_decisions_counts():
    got, said = delegate.read_answer({"decisions": [_item(1, "OTHER"), _item(1, "URLA_1003")]}, [1])
    assert got[1]["doc_type"] == "URLA_1003" and said == []


def test_rule_only(spark):
    result = run(_raw(spark), RULES)
    rows = {r.page_number: r for r in result.page_results.collect()}
    assert [rows[i].doc_type for i in range(1, 6)] == ["URLA_1003", "OTHER", "URLA_1003", "OTHER", "OTHER"]
    assert not set(schema.PRIVATE) & set(result.page_results.columns)
    counters = result.report("/some/where/p.pdf", "p")
    assert counters["source_pdf_name"] == "p.pdf" and counters["llm_target_pages"] == [2, 4, 5] and counters["empty_text_pages"] == [5] and counters["orphan_pages"] == [2, 4, 5] and counters["llm_called"] == 0
    schema.validate(result.page_results, schema.page_invariants())
    assert [(d.doc_id, d.completeness) for d in result.documents.collect()] == [("RD001", "COMPLETE")]


def test_hybrid_without_a_classifier(spark):
    result = run(_raw(spark), RULES, "hybrid")
    rows = {r.page_number: r for r in result.page_results.collect()}
    assert rows[2].warnings == ["NO_SIGNATURE", "LLM_DISABLED", "ORPHAN_PAGE"] and rows[1].warnings == [] and rows[2].decision_source == "RULE"
    assert result.warnings == ("LLM_DISABLED",) and result.report()["warnings"] == ["LLM_DISABLED"]
    assert {n: rows[n].emit_order for n in rows} == {1: 1, 3: 2, 2: 3, 4: 4, 5: 5}


def test_hybrid_sends_masked_pages_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client(prompt, user, config):
        with open(log, "a") as f:
            f.write(user.replace("\n", "|") + "\n")
        ids = [int(x.split(": ")[1]) for x in user.splitlines() if x.startswith("page_id")]
        return {"decisions": [{"page_id": i, "doc_type": "INCOME_DOC", "confidence": 0.5, "evidence": ""} for i in ids]}

    result = run(_raw(spark), RULES, "hybrid", ON, client)
    rows = {r.page_number: r for r in result.page_results.collect()}
    result.physical_groups.collect(), result.documents.collect(), result.report()
    sent = open(log).read().splitlines()
    assert len(sent) == 2 and "123-45-6789" not in "".join(sent) and "[SSN]" in "".join(sent)
    assert rows[2].doc_type == "INCOME_DOC" and rows[2].rule_doc_type == "OTHER" and rows[2].decision_source == "LLM" and rows[1].decision_source == "RULE"
    calls = result.call_records.orderBy("batch_index").collect()
    assert [(c.requested_page_ids, c.returned_page_ids, c.succeeded, c.attempt_count) for c in calls] == [([2, 4], [2, 4], True, 1), ([5], [5], True, 1)]


def _counting(rows, counter):
    """The same rows, counted each time that they are made."""

    def count(batches):
        for batch in batches:
            counter.add(len(batch))
            yield batch

    return rows.mapInPandas(count, rows.schema)


def _client():
    def answer(prompt, user, settings):
        ids = [int(line.split(": ")[1]) for line in user.splitlines() if line.startswith("page_id: ")]
        return {"decisions": [{"page_id": i, "doc_type": "OTHER", "confidence": 0.5, "evidence": ""} for i in ids]}

    return answer


@pytest.mark.parametrize("mode", schema.MODES)
def test_texts_are_read_once_a_run(spark, mode):
    read = spark.sparkContext.accumulator(0)
    assert run(_counting(_raw(spark), read), RULES, mode, ON, _client()).page_results.count() == len(ROWS)
    assert read.value == len(ROWS)


def test_texts_are_read_once_for_all_modes(spark, monkeypatch):
    read, given = spark.sparkContext.accumulator(0), run_queries._pages
    monkeypatch.setattr(run_queries, "_pages", lambda *args: _counting(given(*args), read))
    found = run_queries.run_modes(spark, "/root/testdata/sf0.001")
    assert found.count() == 4 * read.value


def test_decided_pages_go_and_hold_no_text(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(runs, "forget", lambda *tables: kept.extend(tables))
    run(_raw(spark), RULES, "hybrid", ON, _client())
    [table] = kept
    assert "text" not in table.columns and "123-45-6789" not in str(table.collect())
    assert {r.page_number: r.excerpt is not None for r in table.collect()} == {r.page_number: r.delegate for r in table.collect()}
    materialise.forget(table)


def test_failing_calls_fall_back(spark):
    def client(prompt, user, config):
        raise TimeoutError

    result = run(_raw(spark), RULES, "llm-only", ON, client)
    rows = result.page_results.collect()
    assert {r.decision_source for r in rows} == {"RULE_FALLBACK"} and all("LLM_CALL_FAILED" in r.warnings for r in rows)
    assert {(c.attempt_count, c.succeeded) for c in result.call_records.collect()} == {(2, False)}
    counters = result.report()
    assert counters["rule_fallback_count"] == counters["llm_called"] == 5
    schema.validate(result.page_results, schema.page_invariants())


def test_modes_are_checked(spark):
    with pytest.raises(ValueError, match="llm-only"):
        run(_raw(spark), RULES, "llm-only")
    with pytest.raises(ValueError, match="Unsupported"):
        run(_raw(spark), RULES, "both")
    with pytest.raises(ValueError):
        delegate.Settings(batch_size=0)


def test_batches(spark):
    df = spark.createDataFrame([("p", i) for i in range(5)], "package_id string, page_number int")
    assert [r.batch_index for r in delegate.batches(df, 2).orderBy("page_number").collect()] == [0, 0, 1, 1, 2]


TRUTH = "package_id string, page_number int, doc_type string"


def _labels(spark, labels, start=1):
    return spark.createDataFrame([("p", i, x) for i, x in enumerate(labels, start)], TRUTH)


def test_evaluation(spark):
    e = evaluate.evaluate(_labels(spark, ["URLA_1003", "URLA_1003", "TITLE_REPORT", "INCOME_DOC"]), _labels(spark, ["URLA_1003", "OTHER", "TITLE_REPORT", "TITLE_REPORT"]), "rule-only", "x.csv")
    by = {m["doc_type"]: m for m in e.per_class}
    assert e.accuracy == 0.5 and e.misclassified_pages == [2, 4] and e.confusion_matrix["URLA_1003"] == {"URLA_1003": 1, "INCOME_DOC": 0, "CREDIT_REPORT": 0, "TITLE_REPORT": 0, "OTHER": 1}
    assert (by["URLA_1003"]["precision"], by["URLA_1003"]["recall"]) == (1.0, 0.5) and by["INCOME_DOC"]["precision"] is None and by["INCOME_DOC"]["f1"] is None
    assert (by["OTHER"]["precision"], by["OTHER"]["recall"], by["OTHER"]["f1"]) == (0.0, None, None) and by["CREDIT_REPORT"]["f1"] is None
    assert e.macro_f1_supported == pytest.approx((2 / 3 + 2 / 3) / 2) and e.supported_classes == ["URLA_1003", "INCOME_DOC", "TITLE_REPORT"]
    text = evaluate.report_text(e)
    assert "N/A" in text and "CREDIT_REPORT, OTHER has support 0" in text and "2     URLA_1003   OTHER" in text
    report.check_text(sinks.json_text(e.as_dict()))


def test_mistakes_beyond_the_limit_are_counted(spark):
    e = evaluate.evaluate(_labels(spark, ["URLA_1003"] * 9), _labels(spark, ["OTHER"] * 9), listed=4)
    assert e.misclassified_count == 9 and e.misclassified_pages == [1, 2, 3, 4] and "(9):" in evaluate.report_text(e) and "and 5 more" in evaluate.report_text(e)


def test_a_run_fails_on_broken_rows(spark):
    bad = pages.from_rows(spark, [("p", 0, "page 0 of nothing")])
    with pytest.raises(Exception, match="page_number is at least 1"):
        run(bad, RULES)


def test_reports_of_several_packages_hold_counts(spark):
    two = run(pages.from_rows(spark, [*ROWS, ("q", 1, "short one")]), RULES)
    whole, one = two.report(), two.report(package_id="q")
    assert whole["total_pages"] == 6 and whole["llm_target_count"] == 4 and "llm_target_pages" not in whole
    assert one["llm_target_pages"] == [1] and one["orphan_pages"] == [1]


def test_all_undefined_and_empty(spark):
    e = evaluate.evaluate(_labels(spark, ["URLA_1003"]), _labels(spark, ["OTHER"]))
    assert e.macro_f1_supported == 0.0 and e.accuracy == 0.0
    empty = _labels(spark, ["OTHER"]).limit(0)
    assert evaluate.evaluate(empty, empty).accuracy == 0.0


@pytest.mark.parametrize(("known", "predicted", "message"), [
    ([1, 1], [1], "Duplicate page_number.* in ground truth"), ([1], [1, 1], "Duplicate page_number.* in predictions"), ([1, 2], [1], "missing from predictions"), ([1], [1, 2], "missing from ground truth"),
])
def test_misaligned_inputs(spark, known, predicted, message):
    frame = lambda ids: spark.createDataFrame([("p", i, "OTHER") for i in ids], TRUTH)
    with pytest.raises(ValueError, match=message):
        evaluate.evaluate(frame(known), frame(predicted))


def test_unknown_labels_are_refused(spark):
    with pytest.raises(ValueError, match="invalid doc_type"):
        evaluate.evaluate(_labels(spark, ["x"]), _labels(spark, ["OTHER"]))


def test_truth_csv(spark, tmp_path):
    good = tmp_path / "t.csv"
    good.write_text("page_number,doc_type,source_document,source_page\n1,OTHER,,\n2,URLA_1003,a.pdf,3\n")
    rows = truth.load_ground_truth(spark, str(good), "p").orderBy("page_number").collect()
    assert [tuple(r) for r in rows] == [("p", 1, "OTHER", None, None), ("p", 2, "URLA_1003", "a.pdf", 3)]
    bad = tmp_path / "b.csv"
    bad.write_text("page_number,doc_type\n1,OTHER\n0,OTHER\n")
    with pytest.raises(ValueError, match="row 3"):
        truth.load_ground_truth(spark, str(bad))


def test_settings(tmp_path, monkeypatch):
    for name in ("LLM_API_KEY", "LLM_MODEL", "LLM_MAX_RETRIES", "LLM_TEMPERATURE", "LLM_PROVIDER", "LLM_TIMEOUT_SECONDS"):
        monkeypatch.delenv(name, raising=False)
    assert not settings.load_settings(tmp_path / "none").enabled
    env = tmp_path / ".env"
    env.write_text("# c\nexport LLM_API_KEY='abc'\nLLM_MODEL=\"m\"\nLLM_MAX_RETRIES=5 # n\n")
    monkeypatch.setenv("LLM_MODEL", "own")
    monkeypatch.setattr("os.environ", dict(__import__("os").environ))
    got = settings.load_settings(env)
    assert got.enabled and got.model == "own" and got.max_retries == 5 and got.max_excerpt_chars == 1200 and "abc" not in str(got)


def test_files_and_tables(spark, tmp_path):
    result = run(_raw(spark), RULES)
    text = sinks.csv_text(report.page_rows(result.page_results), schema.PAGE_RESULT_COLUMNS)
    assert text.splitlines()[0] == ",".join(schema.PAGE_RESULT_COLUMNS) and text.splitlines()[2].startswith("2,OTHER,RULE,OTHER,0.0,0.0,0,False,False,False,,,NONE,,,,True,0,8,NO_SIGNATURE;ORPHAN_PAGE")
    docs = sinks.csv_text(report.document_rows(result.documents), schema.DOCUMENT_COLUMNS)
    assert docs.splitlines()[1] == "RD001,URLA_1003,,N_OF_M,2,1;2,,,1,3,1-3,False,COMPLETE,AMBIGUOUS_ATTACHMENT,1->1;2->3"
    with pytest.raises(ValueError):
        sinks.write_files({"a.txt": "fine", "b.txt": "x@y.org"}, str(tmp_path / "o"))
    assert not (tmp_path / "o").exists()
    sinks.write_tables({"groups": result.physical_groups}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/groups")).count() == result.physical_groups.count()
    with pytest.raises(ValueError, match="private"):
        sinks.write_tables({"raw": _raw(spark)}, str(tmp_path / "u"))


def test_pdf_packages_with_a_decoder(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"a\x00b")
    (tmp_path / "two.pdf").write_bytes(b"c")
    rows = pages.read_pdfs(spark, str(tmp_path / "*.pdf"), lambda raw: [(x, 90, 1) for x in raw.decode().split("\x00")]).orderBy("package_id", "page_number").collect()
    assert [tuple(r) for r in rows] == [("one.pdf", 1, "a", 90, 1), ("one.pdf", 2, "b", 90, 1), ("two.pdf", 1, "c", 90, 1)]

    def locked(raw):
        raise ValueError("Encrypted PDF requires a password")

    with pytest.raises(Exception, match="Encrypted"):
        pages.read_pdfs(spark, str(tmp_path / "one.pdf"), locked).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        pages.read_pdfs(spark, str(tmp_path / "none.pdf")).collect()


def test_command_line(spark, tmp_path, capsys):
    _raw(spark).write.parquet(str(tmp_path / "in.parquet"))
    (tmp_path / "t.csv").write_text("page_number,doc_type\n1,URLA_1003\n2,OTHER\n3,URLA_1003\n4,OTHER\n5,OTHER\n")
    args = cli.parser().parse_args(["run", "--pages", str(tmp_path / "in.parquet"), "--out", str(tmp_path / "out"), "--truth", str(tmp_path / "t.csv")])
    args.function(spark, args)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"page_results.csv", "physical_groups.csv", "reconstructed_documents.csv", "run_report.json", "evaluation.json", "evaluation.txt"}
    assert "accuracy 1.0000" in capsys.readouterr().out
    for command in ("rules", "extract", "delegation"):
        args = cli.parser().parse_args([command, "--pages", str(tmp_path / "in.parquet"), "--rows", "2"])
        args.function(spark, args)
        assert f"and {1 if command == 'delegation' else 3} more rows" in capsys.readouterr().out
    with pytest.raises(ValueError, match="more than once"):
        cli.one_path_per_label([("OTHER", "a"), ("OTHER", "b")])
    assert cli.labelled_path("OTHER=a=b") == ("OTHER", "a=b")


def test_streams_classify_like_batches(spark, tmp_path):
    _raw(spark).write.parquet(str(tmp_path / "in"))
    stream = streaming.classify_stream(spark.readStream.schema(schema.RAW_PAGES).parquet(str(tmp_path / "in")), RULES)
    query = stream.select("page_number", "doc_type").writeStream.format("memory").queryName("labels").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("labels").collect()} == {(r.page_number, r.doc_type) for r in run(_raw(spark), RULES).page_results.collect()}


def test_finished_packages_are_grouped(spark, tmp_path):
    _raw(spark).groupBy("package_id").agg(F.collect_list(F.struct("page_number", "text", "rotation", "image_count")).alias("pages")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    seen = []
    streaming.group_finished(source, RULES, lambda result, nr: seen.append((nr, result.documents.count())), str(tmp_path / "cp")).awaitTermination(90)
    assert seen == [(0, 1)]


def test_guards_fail_at_run_time(spark):
    df = spark.range(3)
    assert schema.guarded(df, {"small": F.col("id") < 9}).count() == 3
    with pytest.raises(Exception, match="small"):
        schema.guarded(df, {"small": F.col("id") < 2}).collect()
    with pytest.raises(ValueError, match="small"):
        schema.validate(df, {"small": F.col("id") < 2})
