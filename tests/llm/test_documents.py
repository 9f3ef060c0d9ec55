import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwright.llm import graph, language_id, line_dedup, near_dedup, quality, secret_scan, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, line string"
SF = "/root/testdata/sf0.001"


def _docs(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", None if x is None else len(x), "n", "k", "l") for i, x in rows], DOCS)


def _words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(n))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(30)] + [(500, k) for k in range(501, 540)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _sketch(samples):
    return sum((v & 3) << 2 * i for i, v in enumerate(samples)) - (1 << 64 if samples[-1] & 2 else 0)


def test_sketches_count_differing_samples(spark):
    r = random.Random(4)
    pairs = [([r.randrange(4) for _ in range(32)], [r.randrange(4) for _ in range(32)]) for _ in range(50)]
    df = spark.createDataFrame([(sum(x != y for x, y in zip(a, b)), _sketch(a), _sketch(b)) for a, b in pairs], "n int, a long, b long")
    assert df.where(F.col("n") != graph.differing(F.col("a").bitwiseXOR(F.col("b")))).count() == 0


@pytest.mark.parametrize(("all_pairs", "block"), [(2, 2000), (12, 7), (50, 7)])
def test_buckets_of_every_size_keep_their_links(spark, block, all_pairs):
    # Thirty ids in one bucket: 0 is the centre, 10 and 11, 20 and 21 are alike, all others are like none. A second bucket of two.
    alike = {(10, 11), (20, 21), (0, 3), (40, 41)}
    near = {i: _sketch([0] * 31 + [1 if i in (0, 3) else 2 if i in (10, 11, 12) else 3]) for i in range(42)}
    rows = [(1, i) for i in range(30)] + [(2, 0), (2, 1), (2, 2), (3, 40), (3, 41), (4, 7), (4, 8)]
    rows = spark.createDataFrame([(k, i, near[i]) for k, i in rows], "key long, id long, sketch long")
    seen = set()

    def verify(pairs):
        got = {tuple(p) for p in pairs.collect()}
        seen.update(got)
        return spark.createDataFrame(sorted(got & alike), "a long, b long")

    got = {x.id: x.root for x in graph.linked(rows, 0, lambda ids: graph.Detail(None, None, verify), "t", all_pairs, block).collect()}
    assert {k: v for k, v in got.items() if k != v} == {3: 0, 11: 10, 21: 20, 41: 40}
    assert all(near[a] == near[b] for a, b in seen)


def test_tables_go_with_their_scope(spark):
    import os

    from leafwright.llm import common

    docs = _docs(spark, [(1, "a b c d e f\nx"), (2, "a b c d e f\ny"), (3, "other words here")])
    root = common.written(docs, "probe")._written_path.rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(root))
    out = line_dedup.deduplicated(docs)
    assert {x.split("-")[1] for x in set(os.listdir(root)) - before} == {"gone"} and out.count() == 3
    out = near_dedup.deduplicated(docs)
    assert {x.split("-")[0] for x in set(os.listdir(root)) - before} <= {"line", "gone", "again"} and out.count() == 3


@pytest.mark.parametrize("parts", [1, 4, 211])
def test_idf_and_classes_do_not_depend_on_the_layout(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    weights = Counter(k for x in docs for k in near_dedup.shingles([x.text or ""])[0][0].tolist())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    table = df.select("text").rdd.map(lambda r: (bytearray(near_dedup.shingles([r.text or ""])[0][0].tobytes()), None)).toDF("shingles binary, times binary")
    got = {x["hash"] % (1 << 64): x["n"] for x in near_dedup.common_shingles(table, 2.5, len(docs)).collect()}
    assert got == {k: n for k, n in weights.items() if n > 2.5}
    classes = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(df).collect()}
    _CLASSES.setdefault("classes", classes)
    assert classes == _CLASSES["classes"]


_CLASSES = {}


def _words_of(r, n, alphabet):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnop   ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_/.", "".join(chr(0x4E00 + i) for i in range(900))])
def test_recall_of_lines_near_the_limit(spark, alphabet):
    # Evenly spread edits of one character leave the least of the longer shingles: pairs of 0.80 to 0.85, of 60 to 600 characters.
    r, docs, wanted = random.Random(17), [], 0
    for k in range(400):
        n = r.choice((60, 120, 200, 330, 600))
        line = list(_words_of(r, n, alphabet).strip() or "x")
        other = list(line)
        for at in range(r.randrange(20, 40), len(line), 46):
            other[at] = "§"
        a, b = "".join(line), "".join(other)
        x, y = {a[i : i + 5] for i in range(len(a) - 4)}, {b[i : i + 5] for i in range(len(b) - 4)}
        if 0.8 <= len(x & y) / len(x | y) < 1:
            wanted += 1
            docs += [(2 * k, a), (2 * k + 1, b)]
    kept = line_dedup.deduplicated(_docs(spark, docs)).where("text <> ''").count()
    assert wanted > 100 and len(docs) - kept >= 0.96 * wanted


def test_of_repeated_rows_one_keeps_its_lines(spark):
    rows = [(1, "one line of text\n \nanother line here", "en", s, 9, "n", "k", "l") for s in "abc"] + [(2, "another line here", "en", "d", 9, "n", "k", "l")] + [(None, "one more", "en", "e", 9, "n", "k", "l")] * 2
    got = line_dedup.deduplicated(spark.createDataFrame(rows, DOCS).repartition(3), counts=True)
    texts = Counter((x.doc_id, x.text) for x in got.collect())
    assert texts == {(1, "one line of text\n \nanother line here"): 1, (1, " "): 2, (2, ""): 1, (None, "one more"): 1, (None, ""): 1}
    assert sorted(x.dropped for x in got.collect()) == [[], [], [0], [0], [0, 2], [0, 2]]


def test_lines_with_few_different_shingles_meet(spark):
    docs = list(enumerate(["é" * 3000, "é" * 200, "ab" * 900, "ab" * 100, "x y z " * 200, "x y z " * 90, "abcdefghij" * 4, "abcdefghij" * 40, "no such line"]))
    assert {x.doc_id: x.text for x in line_dedup.deduplicated(_docs(spark, docs)).collect()} == _expected_lines(docs)


def test_lines_around_a_shared_passage_agree_with_all_pairs(spark):
    r = random.Random(31)
    passage = _words(r, 30)
    lines = []
    for _ in range(40):  # 0.7 of each line is a passage that all share; each has one near copy
        own = _words(r, 13)
        lines += [f"{passage} {own}", f"{passage} {own[:-1]}Z"]
    docs = list(enumerate(lines))
    assert {x.doc_id: x.text for x in line_dedup.deduplicated(_docs(spark, docs)).collect()} == _expected_lines(docs)


def _shingle_weights(texts):
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(k for s in sets for k in s)
    return [{k: n * (1 + np.log(len(texts) / max(df[k], len(texts) / near_dedup.RARE))) for k, n in s.items()} for s in sets]


def test_near_duplicates_agree_with_all_pairs(spark):
    r = random.Random(2)
    base = [_words(r, r.randrange(40, 160)) for _ in range(25)]
    texts = base + base[:5] + [None, "", "", "one two", "one two", "two one", "One two", " ".join(["same words again"] * 30)]
    hub = _words(r, 150).split()
    for k in range(30):  # a group of copies, each edited in its own place
        own = list(hub)
        own[3 + 4 * k] = f"edit{k}"
        texts.append(" ".join(own))
    texts.append(" ".join(hub))
    weights = _shingle_weights(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            u, v = weights[i], weights[j]
            both = sum(min(u[k], v[k]) for k in u.keys() & v.keys())
            if (texts[i] or "") == (texts[j] or "") or (both and both >= 0.8 * (sum(u.values()) + sum(v.values()) - both)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = _docs(spark, enumerate(texts)).repartition(3)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = near_dedup.deduplicated(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(got.values())) and kept.columns == df.columns


def test_a_drifting_family_agrees_with_all_pairs(spark):
    r = random.Random(1)
    base, texts = _words(r, 400).split(), []
    for v in range(14):  # versions that drift, eight copies each: large buckets, of which the centre is like some only
        for c in range(8):
            own = list(base)
            own[r.randrange(4, 396)] = f"own{v}x{c}"
            texts.append(" ".join(own))
        base = base[: 9 * v] + _words(r, 9).split() + base[9 * (v + 1) :]
    weights, root = _shingle_weights(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            u, v = weights[i], weights[j]
            both = sum(min(u[k], v[k]) for k in u.keys() & v.keys())
            if both >= 0.8 * (sum(u.values()) + sum(v.values()) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(_docs(spark, enumerate(texts))).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_one_of_repeated_rows_and_null_ids_stays(spark):
    df = _docs(spark, [(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "x y"), (None, "x y"), (5, "z")])
    kept = sorted(((x.doc_id is None, x.doc_id or 0, x.text) for x in near_dedup.deduplicated(df).collect()))
    assert kept == [(False, 1, "a b c d e f"), (False, 5, "z"), (True, 0, "x y")]
    assert near_dedup.deduplicated(df.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    r = np.random.default_rng(5)
    a = np.sort(r.integers(0, 2**63, 400, np.uint64))
    hits = total = 0
    for k in range(40):
        b = np.sort(np.concatenate([a[: 320], r.integers(0, 2**63, 80, np.uint64)]))
        w = r.random(400) * 3 + 0.5
        x = near_dedup.samples([a ^ np.uint64(k), b ^ np.uint64(k)], [np.ones(400), np.ones(400)])
        hits, total = hits + (x[0] == x[1]).sum(), total + x.shape[1]
        del w
    assert abs(hits / total - 320 / 480) < 0.04


def _expected_lines(docs):
    where = defaultdict(list)
    for i, x in docs:
        for n, line in enumerate((x or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                where[line].append((i, n))
    lines = list(where)
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} if len(x) >= 5 else {x} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    places = defaultdict(list)
    for i, line in enumerate(lines):
        places[find(i)] += where[line]
    gone = {p for own in places.values() for p in sorted(own)[1:]}
    return {i: None if x is None else "\n".join(line for n, line in enumerate(x.split("\n")) if (i, n) not in gone) for i, x in docs}


def test_fuzzy_lines_agree_with_all_pairs(spark):
    r = random.Random(8)
    shared = [_words(r, 30) for _ in range(6)] + ["short line", "Menu", "x"]
    docs = []
    for i in range(40):
        own = [_words(r, r.randrange(2, 40)) for _ in range(r.randrange(4))]
        for line in r.sample(shared, 3):
            words = line.split()
            if len(words) > 5 and r.random() < 0.6:
                words[r.randrange(len(words))] = "changed"
            own.append(" ".join(words))
        r.shuffle(own)
        docs.append((i, "\n".join([*own, "", "  "])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "é" * 3000 + "\n" + "é" * 3000)]
    df = _docs(spark, docs).repartition(3)
    got = line_dedup.deduplicated(df)
    assert got.columns == df.columns
    assert {x.doc_id: x.text for x in got.collect()} == _expected_lines(docs)
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_long_lines_need_no_white_space_and_bear_spread_edits(spark):
    r = random.Random(21)
    docs = []
    for k in range(30):
        solid = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(600))  # no white space; one of the first characters differs
        spread = _words(r, 90)[:500]
        own = list(spread)
        for i in range(11):  # eleven spread edits of one character: about 0.8
            own[20 + 44 * i] = "Z"
        docs.append((k, "\n".join([solid, solid[:10] + "x" + solid[11:], spread, "".join(own)])))
    assert {x.doc_id: x.text for x in line_dedup.deduplicated(_docs(spark, docs)).collect()} == _expected_lines(docs)


def test_line_dedup_is_native(spark):
    plan = line_dedup.deduplicated(_docs(spark, [(1, "a\na")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_outliers(spark):
    r = random.Random(6)
    texts = [_words(r, r.randrange(30, 200)) for _ in range(200)] + [None, "", "a b", "x y z w v " * 40, "l\nl\nl\n k", "é\u00a0b c\x0bd", "### $$$ " * 30 + _words(r, 40)]
    odd = _words(r, 120).replace(" ", "*** $$$ ###")
    df = _docs(spark, [*enumerate(texts), (999, odd)])
    rows = {x.doc_id: x for x in quality.judge(df).collect()}
    for i, x in enumerate(texts):
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == _statistics(x)
        assert rows[i].base_failed == (rows[i].n_words < 10 or 100 * rows[i].n_repeat_words > 20 * rows[i].n_words)
    assert all(rows[i].kept for i in range(200)) and not rows[999].kept and not rows[200].kept
    assert quality.judge(df.limit(0)).count() == 0
    assert all(x.kept for x in quality.judge(df.limit(5)).collect())


def _numpy_mcd(x):
    """The same estimates by numpy: two starts, six concentration steps over three quarters of the vectors, floors on the diagonal."""
    floors = np.array(list(quality.FLOORS.values()))

    def nearest_rank(v, q):
        return np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]

    def distances(mean, cov):
        inner = np.linalg.inv(cov)
        return np.einsum("ij,jk,ik->i", x - mean, inner, x - mean)

    def moments(y):
        return y.mean(0), np.cov(y.T, bias=True) + np.diag(floors**2)

    middle = np.array([nearest_rank(x[:, i], 0.5) for i in range(x.shape[1])])
    spread = np.array([nearest_rank(np.abs(x[:, i] - middle[i]), 0.5) for i in range(x.shape[1])])
    best = None
    for mean, cov in ((middle, np.diag((1.4826 * spread) ** 2 + floors**2)), moments(x)):
        for _ in range(quality.STEPS):
            d = distances(mean, cov)
            mean, cov = moments(x[d <= nearest_rank(d, quality.CORE)])
        if best is None or np.linalg.slogdet(cov)[1] < np.linalg.slogdet(best[1])[1]:
            best = mean, cov
    d = distances(*best)
    return d, d <= max(quality.FAR_UNITS, quality.FAR * nearest_rank(d, 0.5))


def test_verdicts_agree_with_numpy(spark):
    r = random.Random(44)
    texts = [_words(r, r.randrange(20, 300)) for _ in range(260)]
    texts += [_words(r, r.randrange(20, 200)).replace(" ", r.choice([" # ", " $$ ", "***"])) for _ in range(24)] + ["\n".join([_words(r, 12)] * 2 + [_words(r, 9)]) for _ in range(6)]
    rows = [(i, x, "en", "s", 0, "n", "k", "l") for i, x in enumerate(texts)] + [(7, texts[7], "en", "s", 0, "n", "k", "l")] * 3 + [(None, texts[8], "en", "s", 0, "n", "k", "l"), (900, "plain words " + _words(r, 60), None, None, 0, "n", "k", "l"), (901, _words(r, 40_000), "en", "s", 0, "n", "k", "l")]
    df = spark.createDataFrame(rows, DOCS)
    got = quality.judge(df)
    assert got.count() == len(rows)
    rows = {x.doc_id: x for x in got.where("doc_id < 900").collect()}
    stats = quality._fitted(df, "doc_id", "text", "lang", "source", quality.LEAST_CELL)[0]
    vectors = stats.where("not base_failed and (doc_id < 900 or doc_id = 901)").select("doc_id", *quality.DIMS).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    want, kept = _numpy_mcd(np.array([tuple(v)[1:] for v in vectors]))
    far = 0
    for v, d, k in zip(vectors, want, kept):
        if v.doc_id in rows:
            assert rows[v.doc_id].distance == pytest.approx(d, rel=0.05, abs=0.05) and (rows[v.doc_id].kept == k or abs(d - quality.FAR_UNITS) < 3)
            far += not k
    assert far >= 15


def test_determinants_ignore_a_minority(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 6)) * 2
    x[:60] += 40
    vectors = spark.createDataFrame([("c", *map(float, v)) for v in x], "cell string, " + ", ".join(f"{d} double" for d in quality.DIMS))
    state = quality.covariances(vectors).first()
    assert max(abs(state[f"m_{i}"]) for i in range(6)) < 0.6


def test_urls(spark):
    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for rule, action in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block")):
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = rule, action
        low = (url or "").lower()
        return host, path, best and best[0], best[1] if best else "block" if "utm_source=" in low else "allow"

    urls = ["http://a.Example.COM/en/77?x#y", "https://example.com/en/6", "x://com/en/", "x://xcom/en/", "x://net/de", "x://A.net/de/8", "x://example.net/de/8a", "://org/es/1", "org/es/1", "", None, "a://É.org/es/", "http://h.com?/en/", "http://h.com#/en/", "x://a.com/en/://b", "http://com/EN/", "http://a.b.fr/x?UTM_source=feed&" + "y" * 50_000, "http://a.b.fr/" + "z/" * 30_000]
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)] + [(0, urls[0], "r", "h"), (None, urls[1], "r", "h")], "page_id long, url string, rule string, host string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(urls) + 2
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == plain(urls[1 if x.page_id is None else x.page_id])
    login = spark.createDataFrame([(1, "http://h.org/wp-login.php?x")], "page_id long, url string")
    assert url_filter.filter_urls(login).first().pattern == "login"
    with pytest.raises(ValueError):
        url_filter.pattern_rule("all", ".*")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_listed_rules_have_the_verdicts_of_the_contract(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.action for r in url_filter.RULES if r.listed} == rules
    urls = ["x://a.com/en/1", "x://b.example.com/en/77", "x://net/de/", "x://a.net/de/8", "x://example.net/de/7", "x://a.example.net/de/8a", "x://org/es/", "x://a.net/de/?utm_source=b"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    verdicts = {x.page_id: (x.rule, x.verdict, x.pattern) for x in got}
    names = ["com/en/", "example.com/en/7", "net/de/", "net/de/", "net/de/", "example.net/de/8", "org/es/", "net/de/"]
    assert verdicts == {i: (name, rules[name], None) for i, name in enumerate(names)}


def test_literals_come_from_the_pattern():
    tokens = url_filter.required_tokens
    assert tokens(r"/wp-login\.php(?:[?#]|$)") == ("wp", "login", "php") and tokens(r"[?&]add-to-cart=\d+") == ("add", "to", "cart")
    assert tokens(r"/cal(?:endar)?/") == () and tokens("abc") == () and tokens(r"^abc$") == ("abc",) and tokens(r"/a|/b/") == () and tokens(r"/(x1)/\w+/") == ("x1",) and tokens(r"\babc\b") == ()
    r = random.Random(5)
    for pattern in (r"/wp-login\.php(?:[?#]|$)", r"/(x1)/\w+/", r"[?&]page=\d{2,}(?:[&#]|$)", "/-+go[.]"):
        for _ in range(3000):  # no match without its tokens
            url = "".join(r.choice(["/", "wp", "-", "login", ".php", "?", "x1", "q", "page", "=", "22", "&", "go", "."]) for _ in range(r.randrange(1, 9)))
            if re.search(pattern, url):
                assert set(tokens(pattern)) <= set(re.split("[^0-9a-z]+", url))


@pytest.mark.parametrize("compiled", [0, 64])
def test_equally_long_rules_and_large_packs(spark, compiled, monkeypatch):
    monkeypatch.setattr(url_filter, "COMPILED", compiled)
    rules = (url_filter.site_rule("block", "aa.org", "/x/"), url_filter.site_rule("allow", "org", "/x/yy/"), url_filter.pattern_rule("one", "/yy/", "allow"), url_filter.pattern_rule("two", "/yy/"))
    df = spark.createDataFrame([(1, "u://aa.org/x/yy/"), (2, "u://b.fr/yy/"), (2, "u://b.fr/yy/")], "page_id long, url string")
    got = sorted((x.page_id, x.rule or "", x.verdict, x.pattern or "") for x in url_filter.filter_urls(df, rules).collect())
    assert got == [(1, "org/x/yy/", "allow", ""), (2, "", "allow", "one"), (2, "", "allow", "one")]


def test_shards(spark):
    r = random.Random(9)
    rows = [(i, None if i % 50 == 0 else "é" * r.randrange(400)) for i in range(700)] + [(5, "x")] * 3 + [(None, "y")] * 40
    df = _docs(spark, rows).repartition(4)
    got = sharding.balanced_shards(df, 7).collect()
    sizes, slots = Counter(), defaultdict(list)
    for x in got:
        sizes[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(x.size for x in got)
    text = dict(rows[:700])
    assert all(x.text_crc32 == zlib.crc32((text[x.doc_id] or "").encode()) and x.size == len((text[x.doc_id] or "").encode()) + 16 for x in got if x.doc_id is not None and x.doc_id != 5)
    ids = sorted((x.shard, x.slot, -1 if x.doc_id is None else x.doc_id) for x in got)
    assert [i for *_, i in ids] == sorted(i for *_, i in ids)
    assert sharding.balanced_shards(df.limit(0)).count() == 0


def _plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    r = random.Random(3)
    return secret_scan.fit([_words(r, 300) for _ in range(10)], planted=500, turns=25)


def test_base_spans_agree_with_plain_search():
    r = random.Random(12)
    parts = ["password", "Token", "=", ": ", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "api_key", "é", "secret", ".", "x" * 9]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert secret_scan.base_spans(text) == _plain_spans(text)


def test_secrets_are_found_and_masked(spark, field):
    texts = ["login password = 'hunter2hunter2X9' now", "key AKIA" + "Z7" * 8 + " end", "plain words only, nothing else at all", None, "", "my api token Zx8Qw2Lp9Rt4Vb7Nm1Ks is here", "word " * 30_000 + "deadbeefdeadbeef99"]
    df = _docs(spark, enumerate(texts))
    rows = {x.doc_id: x for x in secret_scan.scan(df, field).collect()}
    for i, x in enumerate(texts):
        base = [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in rows[i].spans if s.kind != "crf"]
        assert base == _plain_spans(x or "")
    assert not rows[2].spans and rows[5].spans[0].kind == "crf"
    clean = {x.doc_id: x.text for x in secret_scan.redact(df, field).collect()}
    assert clean[2] == texts[2] and clean[3] is None and "hunter2" not in clean[0] and clean[6].endswith(secret_scan.MASK)


def test_field_finds_planted_secrets_of_one_and_several_tokens(field):
    r, alnum = random.Random(13), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda n, pool=alnum: "".join(r.choice(pool) for _ in range(n))
    kinds = {"one": lambda: some(r.randrange(20, 40)), "parts": lambda: ".".join(some(n, alnum + "-_") for n in (20, 36, 28)), "marks": lambda: 'pwd: "' + some(1) + some(16, alnum + "$!@%^*" * 2) + some(1) + '"'}
    clean = [_words(r, 60) for _ in range(120)]
    assert sum(map(len, secret_scan.scan_texts(clean, field, {}, {}, []))) <= 1
    for name, secret in kinds.items():
        texts, places = [], []
        for x in clean:
            value, left = secret(), x[: r.randrange(len(x))].rsplit(" ", 1)[0] + " "
            texts.append(left + value + " " + x[len(left) :])
            inner = value.removeprefix('pwd: "').rstrip('"')
            places.append((texts[-1].index(inner, len(left)), len(inner)))
        found = secret_scan.scan_texts(texts, field, {}, {}, [])
        hit = sum(any(a <= at and b >= at + n for a, _, b in own) for (at, n), own in zip(places, found))
        assert hit >= {"one": 0.95, "parts": 0.9, "marks": 0.5}[name] * len(texts), (name, hit)
        masked = [secret_scan.redacted(t, [(a, b) for a, _, b in own]) for t, own in zip(texts, found)]
        assert all(len(m) <= len(t) for m, t in zip(masked, texts))


def test_scan_of_odd_rows(spark, field):
    df = spark.createDataFrame([(None, "x token=abcdefabcdef12", "h", "s"), (None, "x token=abcdefabcdef12", "h", "s"), (3, None, None, None), (4, "", "h", "s")], "doc_id long, text string, h string, spans string")
    got = sorted((x.doc_id or 0, x.n_assign, len(x.spans)) for x in secret_scan.scan(df, field).collect())
    assert got == [(0, 1, 1), (0, 1, 1), (3, 0, 0), (4, 0, 0)] and secret_scan.scan(df.limit(0), field).count() == 0
    assert [x.h for x in secret_scan.redact(df, field).where("doc_id is null").collect()] == ["h", "h"]
    assert not secret_scan.scan_texts(["plain"], secret_scan.train(df.limit(0)), {}, {}, [])[0]


def test_viterbi_agrees_with_all_paths():
    from itertools import product

    r = np.random.default_rng(2)
    step = r.normal(size=(3, 3))
    lengths = np.array([1, 4, 3, 5])
    scores = r.normal(size=(lengths.sum(), 3))
    tags, at = secret_scan.viterbi(scores, lengths, step), 0
    for n in lengths:
        best = max(product(range(3), repeat=int(n)), key=lambda p: step[0, p[0]] + sum(scores[at + i, p[i]] for i in range(n)) + sum(step[p[i - 1], p[i]] for i in range(1, n)) + step[p[-1], 0])
        assert tuple(tags[at : at + n]) == best
        at += n


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang", language_id.held_out().alias("out")), "doc_id").where("out").collect()
    assert sum(x.lang == x.lang_pred for x in rows) >= 0.97 * len(rows) > 0 and all(0 <= x.score <= 1 for x in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (None, "the of and")], "doc_id long, text string")
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] != "und"
    texts = {x.lang: x.text for x in docs.where("n_chars > 800").collect()}
    mixed = spark.createDataFrame([(1, texts["en"][:800] + " " + texts["de"][:500])], "doc_id long, text string")
    found = language_id.identify(mixed, model).first()
    assert found.n_langs == 2 and found.lang_pred == "en" and 0.45 < found.score < 0.8
    nothing = language_id.train(docs.limit(0))
    assert language_id.identify(odd, nothing).where("lang_pred = 'und'").count() == 4


def test_mixtures_agree_with_all_sets():
    # Proportions by a long run of the same updates for every set of languages, sizes by penalised likelihood.
    from itertools import combinations

    r = np.random.default_rng(8)
    like, lengths = [], []
    for _ in range(60):
        n, langs = int(r.integers(30, 120)), r.choice(4, int(r.integers(1, 4)), replace=False)
        own = r.normal(-12, 0.7, (n, 4))
        own[np.arange(n), r.choice(langs, n)] += 5
        like.append(own)
        lengths.append(n)
    share, size, value = language_id.mixtures(np.concatenate(like).astype(np.float32), np.array(lengths))
    for own, s, k, v in zip(like, share, size, value):
        best = None
        for m in range(1, 4):
            for picked in combinations(range(4), m):
                p, mix = np.exp(own[:, picked]), np.full(m, 1 / m)
                for _ in range(300):
                    joint = p * mix
                    mix = (joint / joint.sum(1, keepdims=True)).mean(0)
                ll = np.log((p * mix).sum(1)).sum() - 3.0 * np.log(len(own)) * (m - 1)
                if best is None or ll > best[0]:
                    best = ll, picked, mix
        assert set(np.flatnonzero(s > 0)) == set(best[1]) and k == len(best[1])
        assert np.abs(s[list(best[1])] - best[2]).max() < 0.05


def test_languages_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.where("lang is not null and length(text) > 300").first()
    rows = [(one.doc_id, one.text, one.lang, "x", 0.0)] * 50 + [(None, one.text, one.lang, "x", 0.0), (5, "ab " * 200_000, None, "y", 1.0), (5, one.text.upper(), "zz", "y", 1.0), (7, "x", "aa", "z", 0.0), (8, "x", "bb", "z", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    model = language_id.train(df)
    assert model.langs == sorted({one.lang, "zz", "aa", "bb"})
    got = language_id.identify(df, model)
    assert got.count() == len(rows) and got.columns == ["doc_id", "lang_pred", "score", "n_langs"]
    assert len({x.lang_pred for x in got.where("doc_id in (7, 8)").collect()}) == 1  # a tie goes one way
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.accepted(df, model).columns == df.columns


def test_stages_take_empty_tables_and_null_ids(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(None, "some plain words of a text " * 4, None, None, 9), (None, "some plain words of a text " * 4, "en", "s", 9), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "the words of another one here " * 5, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.count() > 0 or name == "language_id", name
        assert name == "packing" or out.columns == docs.columns


def test_stages_keep_clean_documents_and_columns(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = p.written(out, name)
    assert docs.groupBy("text").count().where("count > 1 and text <> ''").count() == 0
    assert not any(_plain_spans(x.text or "") for x in docs.select("text").collect())
    pieces = p.packed(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_hashes_reach_the_driver_as_arrays(spark):
    x = np.unique(np.random.default_rng(5).integers(1, 2**63, 200_000, np.uint64))
    table = spark.createDataFrame([(bytearray(x.tobytes()), None)], "shingles binary, times binary")
    tracemalloc.start()
    try:
        counts = near_dedup.common_shingles(table, 0.5, 1)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20  # 8 bytes each, a few times; a row object takes hundreds
    finally:
        tracemalloc.stop()
    assert counts.count() == len(x) and counts.agg(F.sum("n")).first()[0] == len(x)


def test_more_segments_do_not_name_more_shingles(spark, monkeypatch):
    # Each part of 100 documents holds a shingle of its own in eight of them; one shingle is in six of each part, another in three of each.
    monkeypatch.setattr(near_dedup, "LEAST_DOCS", 100)
    rows = [[7] * (i % 100 < 6) + [8] * (i % 100 < 3) + [100 + i // 100] * (i % 100 < 8) for i in range(2000)]
    table = spark.createDataFrame([(bytearray(np.array(sorted(x), "<u8").tobytes()), None) for x in rows], "shingles binary, times binary").coalesce(1).repartitionByRange(20, F.monotonically_increasing_id())
    names, written = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: names.append((name, out := written(df, name), out.count())) or out)
    with graph.scope():
        counts = {x["hash"]: x["n"] for x in near_dedup.common_shingles(table, 100, 2000).collect()}
    assert counts == {7: 120}
    assert names[0][0] == "named" and names[0][2] <= 2  # not one more for each part


def test_apart_members_of_several_buckets_meet_once(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i, 0) for k in range(5) for i in range(40)], "key long, id long, sketch long")
    made = []
    monkeypatch.setattr(type(rows), "distinct", lambda df: (made.append(df.count()) if set(df.columns) == {"a", "b"} else None) or df.dropDuplicates())
    with graph.scope():
        united = graph.components(spark.createDataFrame([(0, 1)], "a long, b long"))
        made.clear()
        pairs, _ = graph._apart(rows.withColumn("m", F.lit(40).cast("long")), united, 13, lambda ids: graph.Detail(None, None, None), "tens", 16)
        got = sorted(map(tuple, pairs.collect()))
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if (a, b) != (0, 1)]
    assert made == [len(got)]  # the join itself makes no pair twice


def test_hashed_shingles_tell_what_runs_tell(spark):
    r = random.Random(4)
    lines = ["", "a", "ab\u00e9", "abcd", "abcde", "aaaaaaaaaa", "\U0001f600bcdefg\u00e9", *("".join(r.choice("ab\u00e9 \U0001f600") for _ in range(r.randrange(60))) for _ in range(30))]
    cut = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x}
    df = spark.createDataFrame([(x, y) for x in lines for y in lines], "x string, y string")
    got = df.select("x", "y", F.size(line_dedup.shingles("x")).alias("n"), line_dedup.alike("x", "y", 0.3).alias("alike")).collect()
    assert all(g.n == len(cut(g.x)) and g.alike == (len(cut(g.x) & cut(g.y)) >= 0.3 * len(cut(g.x) | cut(g.y))) for g in got)


def _sides(table):
    """All pairs of the rows of ``table``, and what gives the columns of their ends."""
    return table.alias("x").crossJoin(table.alias("y")), lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")


def test_codes_of_lines_bound_their_likeness(spark):
    r, lines = random.Random(6), ["", "abcd", "aaaaaaaaaaaa"]
    base = "".join(r.choice("abcdefghij ") for _ in range(500))
    for k in range(60):
        lines.append("".join(r.choice("xyz") if r.random() < k / 2000 else c for c in base)[: r.randrange(400, 500)])
    lines.append("".join(chr(0x4E00 + r.randrange(20000)) for _ in range(60_000)))  # so many runs that codes collide
    df = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    pairs, x, y = _sides(line_dedup.codes(df).join(df.withColumnRenamed("node", "id"), "id"))
    pairs = pairs.where("x.id < y.id or x.id = y.id and x.id < 5").select(line_dedup.alike("x.line", "y.line", 0.8).alias("alike"), line_dedup._reach(x, y, 0.8).alias("may"))
    got = Counter(map(tuple, pairs.collect()))
    assert not got[True, False] and got[True, True] > 50 and got[False, False] > 50 and got[False, True] <= 5
    assert line_dedup.codes(df).where("lost > 1000").count() == 1


def test_codes_of_documents_bound_their_likeness(spark):
    r = np.random.default_rng(8)
    rows, usual = [], 7.9
    weight = np.where(r.random(5000) < 0.5, usual, r.uniform(1, usual, 5000))
    for k in range(60):
        x = np.unique(np.concatenate([np.arange(300)[r.random(300) > k / 400], r.integers(300, 5000, k // 3)])).astype(np.uint64)
        rows.append((x, r.integers(1, 4, len(x)) if k % 3 == 0 else np.ones(len(x), int)))
    got = [near_dedup._codes(x, n, weight[x], usual) for x, n in rows]
    table = spark.createDataFrame([(i, c.view(np.int64).tolist(), h, t, lost) for i, (c, h, t, lost) in enumerate(got)], "id long, codes array<long>, held long, total double, lost double")
    pairs, x, y = _sides(table)
    may = {(a, b): m for a, b, m in pairs.select("x.id", "y.id", near_dedup._reach(x, y, 0.8)).collect()}
    seen = Counter()
    for (a, b), m in may.items():
        (x, n), (y, k) = rows[a], rows[b]
        _, i, j = np.intersect1d(x, y, return_indices=True)
        both = (np.minimum(n[i], k[j]) * weight[x[i]]).sum()
        likeness = both / ((n * weight[x]).sum() + (k * weight[y]).sum() - both)
        assert m or likeness < 0.8
        assert not m or likeness > 0.799
        seen[m] += 1
    assert seen[True] > 300 and seen[False] > 300


def test_only_links_leave_a_bucket_of_ids_near_the_limit(spark, monkeypatch):
    # Copies of a text, each edited in its own way: some within the limit, and more of them just beyond it, to the text and to each other.
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    edited = lambda rate: " ".join(f"e{r.randrange(10**6)}" if r.random() < rate else w for w in words)
    texts = [" ".join(words), *(edited(0.012) for _ in range(60)), *(edited(0.025) for _ in range(100))]
    asked, made, linked = [], [], near_dedup.linked

    def watched(rows, most, prepare, *more):
        def counted(ids):
            detail = prepare(ids)
            return detail._replace(verify=lambda some: asked.append(some.count()) or made.append((out := detail.verify(some)).count()) or out)

        return linked(rows, most, counted, *more)

    monkeypatch.setattr(near_dedup, "linked", watched)
    classes = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(_docs(spark, enumerate(texts))).collect()}
    sets = _shingle_weights(texts)
    for i in range(len(texts)):  # bands miss few pairs: what is similar to the first text is in its class
        both = sum(min(sets[0][k], sets[i][k]) for k in sets[0].keys() & sets[i].keys())
        assert both < 0.8 * (sum(sets[0].values()) + sum(sets[i].values()) - both) or classes[i] == 0
    assert len(asked) >= 3 and sum(asked[3:]) <= 1.1 * sum(made[3:]) + 2  # the three rounds before are of nearest partners
