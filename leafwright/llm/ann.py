"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of several full-dimensional codebooks, fitted one on the
residuals of the other and chosen by beam search. Scores of all codes come from lookup tables of query and
codeword products and a stored norm; the best are ranked again exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scope, small, written

#: Distinct vectors that codebooks are fitted on at most: those with the smallest hashes.
SAMPLE = 8192
BOOKS, WORDS, BEAM = 24, 256, 4
#: Classes of equal vectors ranked again for each query, from each block of codes and in all.
RERANK = 300
#: Vectors in a block of codes, queries in a block of queries.
BLOCK, QUERIES = 16_384, 2_048


@dataclass
class Codebooks:
    books: np.ndarray  # (BOOKS, WORDS, dimension)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, BOOKS) and norms of what they stand for, by beam search over the residual codebooks."""
        n, dim = x.shape
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)[None, None, :]
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            top = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            path, word = top // len(book), top % len(book)
            rest = np.take_along_axis(rest, path[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        best = (rest**2).sum(2).argmin(1)
        at = np.arange(n)
        return codes[at, best], np.linalg.norm(x - rest[at, best], axis=1)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(query, code) approximate cosines of unit queries, from lookup tables."""
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            out += (queries @ book.T).astype(np.float32)[:, codes[:, m]]
        return out / np.maximum(norms, 1e-9).astype(np.float32)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, turns: int = 12, seed: int = 3) -> Codebooks:
    """Codebooks by k-means on the residuals of those before; fewer vectors than words: a word for each."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32).copy(), []
    for _ in range(books):
        book = rest[rng.permutation(len(rest))[:words]].copy()
        for _ in range(turns):
            near = ((book**2).sum(1)[None] - 2 * rest @ book.T).argmin(1)
            sums, n = np.zeros_like(book), np.bincount(near, minlength=len(book))
            np.add.at(sums, near, rest)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), len(book))])
        rest -= book[((book**2).sum(1)[None] - 2 * rest @ book.T).argmin(1)]
        out.append(book)
    return Codebooks(np.stack(out).astype(np.float32))


def rounds(blocks: int) -> list[range]:
    """Numbers of blocks, each in one round: 1, 1, 2, 4, 8, ... blocks, so each round doubles what was searched before."""
    out, at = [range(min(1, blocks))], 1
    while at < blocks:
        out.append(range(at, min(2 * at, blocks)))
        at *= 2
    return out


def leading(scores: np.ndarray, floors: np.ndarray, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``rerank`` best scores of each row, without those below its floor: others have ``rerank`` better ones already (NaN: no floor)."""
    keep = min(rerank, scores.shape[1])
    top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    at, place = np.nonzero(~(np.take_along_axis(scores, top, 1) < floors[:, None]))
    return at, top[at, place]


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def search(
    table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = SAMPLE, rerank: int = RERANK, books: int = BOOKS, beam: int = BEAM,
) -> DataFrame:
    """The ``k`` nearest rows by cosine of every row whose id is divisible by ``every``, among all other rows.

    Equal vectors form a class that is coded once and answers with its ``k + 1`` smallest ids, which is all
    that ``k`` neighbours other than the query itself can need, so that a vector that a third of the rows share costs no more than
    another one. Codes travel in blocks against blocks of queries; every code is scored for every query. Blocks are searched in
    rounds that double, and a round gives out only what reaches the worst of a query's ``rerank`` best so far: some ``rerank`` rows a query and round,
    with the same classes at the end as if each block gave out its ``rerank`` best.
    Candidates (``rerank`` classes a query) are scored again from the original vectors in double precision.

    Returns ``(query_id, rank, vec_id, score)``, nearest first, ties to the smaller id; a query with fewer candidates returns
    all. Null ids, null, zero and non-finite vectors take no part, nor do vectors of another length than the most frequent
    one. Repeated rows of one id and vector count as one; of several vectors under one id, each is a row of its own.
    """
    spark = table.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims["n"])

    with scope() as keep:
        # Row numbers up to a limit are cut before the shuffle too, so a common vector sends k + 1 ids from each task at most.
        first = Window.partitionBy("class").orderBy("id")
        keyed = rows.select("id", F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x))), ""), 256).alias("class"), "v")
        members = keyed.withColumn("nr", F.dense_rank().over(first)).where(F.col("nr") <= k + 1).dropDuplicates(["class", "id"])
        members = keep(written(members, "members"))
        classes = members.where("nr = 1").select("class", "v")
        picked = classes.orderBy("class").limit(sample).select("v").toPandas()
        model = fit(_unit(picked["v"]), books)

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 512):
                    part = pdf.iloc[a : a + 512]
                    codes, norms = model.encode(_unit(part["v"]), beam)
                    yield pd.DataFrame({"class": part["class"], "code": [c.tobytes() for c in codes], "norm": norms})

        codes = written(classes.mapInPandas(code, "class string, code binary, norm double"), "codes")
        queries = keyed.where(F.col("id") % every == 0).dropDuplicates(["class", "id"])
        asked = keep(written(queries.groupBy("class").agg(F.first("v").alias("v")).withColumn("part", F.lit(0)), "queries"))  # equal queries are scored once
        n_codes, n_asked = codes.count(), asked.count()
        code_blocks, query_blocks = -(-n_codes // BLOCK), max(1, -(-n_asked // QUERIES))
        block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
        left = asked.select(block(query_blocks).alias("q"), "class", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("norm"))
        right = codes.select(block(max(1, code_blocks)).alias("c"), "class", F.lit(None).cast("array<double>").alias("v"), "code", "norm", F.lit(None).cast("double").alias("floor"))

        def score(pdf: pd.DataFrame) -> pd.DataFrame:
            ask, own = pdf[pdf["code"].isna()], pdf[pdf["code"].notna()].sort_values("class")
            if ask.empty or own.empty:
                return pd.DataFrame({"query": [], "class": [], "near": []})
            book = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            names, norms, out = own["class"].to_numpy(), own["norm"].to_numpy(), []
            for a in range(0, len(ask), 256):
                part = ask.iloc[a : a + 256]
                s = model.scores(_unit(part["v"]), book, norms)
                at, to = leading(s, part["floor"].to_numpy(np.float64), rerank)
                out.append(pd.DataFrame({"query": part["class"].to_numpy()[at], "class": names[to], "near": s[at, to].astype(float)}))
            return pd.concat(out)

        best = Window.partitionBy("query").orderBy(F.desc("near"), "class")
        near = None
        for some in rounds(code_blocks):
            wanted = left.withColumn("floor", F.lit(None).cast("double"))
            if near is not None:
                floors = near.groupBy("query").agg(F.count("*").alias("n"), F.min("near").alias("floor")).where(F.col("n") >= rerank).select(F.col("query").alias("class"), "floor")
                wanted = left.join(small(written(floors, "floors")), "class", "left").select(*left.columns, "floor")
            wanted = wanted.withColumn("c", F.explode(F.array(*map(F.lit, some)).cast("array<int>")))
            held = right.where(F.col("c").isin(*some)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
            columns = ("q", "c", "class", "v", "code", "norm", "floor")
            scored = wanted.select(*columns).unionByName(held.select(*columns)).groupBy("q", "c").applyInPandas(score, "query string, class string, near double")
            found = scored if near is None else near.unionByName(scored)
            near = written(found.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= rerank).select("query", "class", "near"), "near")
        near = keep(near).select("query", "class")

    one = asked.select(F.col("class").alias("query"), F.col("v").alias("a"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = near.join(small(one), "query").join(classes.select("class", F.col("v").alias("b")), "class")
    # One exact cosine per pair of classes, then the ids of the nearest classes: k + 1 of them hold the k nearest.
    exact = pairs.select("query", "class", (dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))).alias("score"))
    tied = exact.withColumn("nr", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("nr") <= k + 1).drop("nr")
    answers = queries.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(tied, "query").join(members.select("class", F.col("id").alias("vec_id")), "class").where("query_id != vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
