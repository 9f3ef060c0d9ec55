import numpy as np
import pytest

from leafwright.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, class string"


def _exact(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for q, a in good.items():
        if q % every == 0:
            near = sorted(((-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i) for i, b in good.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_recall_scores_and_common_vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    x[200:500] = x[100]  # one vector of a fifth of all rows
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (2200, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA).repartition(4)
    got = {}
    for y in ann.search(df, k=5, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(y.query_id, []).append((y.vec_id, y.score))
    want = _exact(rows, 50, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for i, _ in got[250]] == [100, 200, 201, 202, 203] and got[250][0][1] == pytest.approx(1.0, abs=1e-12)
    for q, near in got.items():
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-12 for i, s in near if i in scores)


def test_recall_where_few_are_ranked_again(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for y in ann.search(df, every=100, rerank=50).collect():  # 0.8 % of the classes
        got.setdefault(y.query_id, set()).add(y.vec_id)
    hits = sum(len(got[q] & set([i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5])) for q in range(0, 6000, 100))
    assert hits >= 0.9 * 5 * 60


def test_ties_go_to_the_smaller_id(spark):
    # Different vectors of exactly one cosine: multiples of each other, and mirrored ones.
    rows = [(0, [1.0, 0.0]), (7, [3.0, 4.0]), (5, [6.0, 8.0]), (3, [3.0, -4.0]), (9, [0.0, 1.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA)
    assert [(y.rank, y.vec_id) for y in ann.search(df, every=100).orderBy("rank").collect()] == [(1, 3), (2, 5), (3, 7), (4, 9), (5, 11)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "c"), (1, [1.0, 0.1], 1, "c"), (0, [1.0, 0.0], 1, "c")], SCHEMA)
    assert [(y.query_id, y.rank, y.vec_id) for y in ann.search(df).collect()] == [(0, 1, 1)]
    assert ann.search(df.limit(0)).count() == 0


def test_rounds_give_out_what_may_be_among_the_best(spark, monkeypatch):
    r = np.random.default_rng(8)
    s, given, best = r.normal(size=(20, 64 * 500)).astype(np.float32), 0, [np.empty(0, np.float32)] * 20
    for some in ann.rounds(64):
        floors = np.array([x.min() if len(x) == 50 else np.nan for x in best])
        found = [x for b in some for at, to in [ann.leading(s[:, 500 * b : 500 * b + 500], floors, 50)] for x in zip(at, s[at, 500 * b + to])]
        given += len(found)
        best = [np.sort(np.concatenate([x, [v for at, v in found if at == q]]).astype(np.float32))[-50:] for q, x in enumerate(best)]
    assert np.array_equal(best, np.sort(s, 1)[:, -50:])
    assert given <= 20 * 50 * 8 * 1.2  # one share for each of seven rounds, not of 64 blocks
    assert [list(x) for x in ann.rounds(6)] == [[0], [1], [2, 3], [4, 5]]
    x = r.normal(size=(1000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    whole = sorted(map(tuple, ann.search(df, rerank=40, books=4).collect()))
    monkeypatch.setattr(ann, "BLOCK", 150)
    assert sorted(map(tuple, ann.search(df, rerank=40, books=4).collect())) == whole
