import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from leafwright import queries
from leafwright.functions import masking
from leafwright.functions.regexes import java_pattern
from leafwright.plans import materialise
from leafwright.plans.rulepack import load_rules

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def _plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.date) else x for x in row)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_agree_with_their_sql(spark, tables, name):
    found, sql = queries.queries()[name](spark, SF), queries.oracle_sql()[name]
    columns = sorted(found.columns)
    assert columns == sorted(tables.sql(sql).columns)
    want = tables.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({sql})").fetchall()
    assert sorted(map(_plain, found.select(*columns).collect()), key=repr) == sorted(map(_plain, want), key=repr)


def _agrees(spark, folder, name, *used):
    """The query and its SQL over tables written to ``folder``."""
    connection = duckdb.connect()
    for table in used:
        connection.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found, sql = queries.queries()[name](spark, str(folder)), queries.oracle_sql()[name]
    columns = sorted(found.columns)
    want = connection.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    assert sorted(map(_plain, found.select(*columns).collect()), key=repr) == sorted(map(_plain, want), key=repr)


def test_page_numbers_of_four_digits_are_no_markers(spark, tmp_path):
    spark.range(2105).selectExpr("id AS doc_id", "'a' AS text", "'en' AS lang", "'src' AS source", "1L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    _agrees(spark, tmp_path, "page_listing", "documents")


def test_tables_go_with_their_scope(spark):
    folder = materialise.shared_dir(spark)
    with materialise.scope() as outer:
        with materialise.scope() as keep:
            kept, gone = keep(materialise.materialised(spark.range(3), "kept")), materialise.materialised(spark.range(4), "gone")
            assert gone.count() == 4
        path = gone._written_path.removeprefix("file://")
        assert path.startswith(folder.removeprefix("file://")) and not os.path.exists(path) and kept.count() == 3
        last = outer(materialise.materialised(kept, "last"))
    assert not os.path.exists(kept._written_path.removeprefix("file://")) and last.count() == 3
    materialise.forget(last)
    assert not os.path.exists(last._written_path.removeprefix("file://"))
    with pytest.raises(ZeroDivisionError), materialise.scope() as keep:
        lost = keep(materialise.materialised(spark.range(2), "lost"))
        1 / 0
    assert not os.path.exists(lost._written_path.removeprefix("file://"))


def test_settings_hold_only_while_a_table_is_written(spark):
    keys = list(materialise._SETTINGS)
    before = [spark.conf.get(k, None) for k in keys]
    materialise.materialised(spark.range(3).groupBy("id").count(), "probe")
    assert [spark.conf.get(k, None) for k in keys] == before
    rows = spark.range(1000).repartition(20, "id").groupBy("id").count().toLocalIterator()
    first = next(rows)
    materialise.forget(materialise.materialised(spark.range(3).groupBy("id").count(), "probe"))
    assert len({first.id, *(r.id for r in rows)}) == 1000


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        materialise.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert materialise.shared_dir(Session()).startswith("file:///")


@pytest.mark.parametrize(("text", "masked"), [
    ("Borrower: Ann Lee signs", "Borrower: [NAME] signs"), ("Name: Ann", "Name: Ann"), ("APPLICANT - Ann B. Lee", "APPLICANT - [NAME]. Lee"), ("Name Mary Ann Jo Lee", "Name [NAME] Lee"), ("Name:  Ann  Lee", "Name:  Ann  Lee"),
    ("Signature: Realtor Bob Ray", "Signature: Realtor Bob Ray"), ("Name: Bob Statement Ray", "Name: Bob Statement Ray"), ("Attn: Borrower: Ed Poe", "Attn: Borrower: [NAME]"), ("Nametag: Ann Lee", "Nametag: Ann Lee"), ("Trustor Ann O'Hara-Lee, x", "Trustor [NAME], x"), ("Name: ann lee", "Name: ann lee"),
])
def test_names_beside_labels(text, masked):
    assert masking.mask(text, load_rules().mask) == masked


def test_masking_is_dealt_to_all_cores(spark):
    rows = queries.queries()["masked_personal"](spark, SF).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in rows) <= 2 * sum(r["count"] for r in rows) / len(rows) + 10


def test_amounts_are_sought_only_where_something_hits(monkeypatch):
    sought, given = [], masking.MaskPolicy.spared
    monkeypatch.setattr(masking.MaskPolicy, "spared", lambda policy, text: sought.append(text) or given(policy, text))
    policy = load_rules().mask
    assert masking.mask("Paid $1,234.56 to the bank", policy) == "Paid $1,234.56 to the bank" and not sought
    text = "SSN 123-45-6789, $123-45-6789 and 123-45-6789 of Ann"
    assert masking.mask(text, policy) == "SSN [SSN], $123-45-6789 and [SSN] of Ann" and sought == [text]


@pytest.mark.parametrize(("pattern", "around"), [(r"Page\s+(\d{1,3})", False), (r"\bPage", True), (r"(?<!x)a", True), (r"a(?=b)", True), (r"^a", True), (r"a$", True), (r"[$^]\$\^(?P<n>a)(?:b)", False), (r"a\\b", False), (r"[\b]x", False)])
def test_patterns_that_look_around(pattern, around):
    assert java_pattern(pattern).looks_around == around
