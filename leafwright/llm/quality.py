"""Quality rules: base counts of words, symbols and repeats, then robust multivariate outliers.

All native: arrays of hashes inside a row find repeats, minimum-covariance-determinant estimates come
from concentration steps written as grouped aggregates, and distances from Cholesky factors held in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scope, small, text_of, written

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Share of a cell's vectors that the covariance of least determinant is taken over.
CORE = 0.75
#: Cells with fewer distinct vectors join the other small ones of their language, then of all.
LEAST_CELL = 80
STEPS = 6
#: A document goes if its squared distance exceeds the value that one in 100,000 exceeds in a normal distribution of six statistics (chi-square), and
#: where a cell's median squared distance is above that distribution's, so many times the median.
FAR_UNITS = 33.1
FAR = FAR_UNITS / 5.348

#: Standard deviation of each transformed statistic below which a difference isn't worth a remark.
FLOORS = {"x_words": 1.5, "x_length": 0.06, "x_symbols": 0.5, "x_lines": 0.1, "x_repeats": 0.1, "x_variety": 0.02}
DIMS = tuple(FLOORS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct)`` of each row.

    Words are hashed to 64 bits and five neighbouring hashes to one; a text whose window hashes are all distinct
    (most) ends there, in the others windows are sorted with their places to find the words that repeats cover.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text_of(text_col).alias("text")
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("*", F.array_remove(F.split("text", WORD_GAP), "").alias("words"), lines.alias("lines")).select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(5))))
    rows = rows.select("*", F.when(F.col("n_words") >= 5, window).otherwise(F.array().cast("array<bigint>")).alias("w"), F.size(F.array_distinct("h")).cast("long").alias("n_distinct")).drop("h")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("w")
    same = lambda a, k: F.coalesce(F.get("s", k)["x"] == a["x"], F.lit(False))
    places = F.filter("s", lambda a, k: same(a, k + 1) | F.when(k > 0, same(a, k - 1)).otherwise(False))
    rows = rows.withColumn("p", F.sort_array(F.transform(places, lambda a: a["i"]))).drop("s")
    # Each repeated window covers five words, or those up to the next one.
    covered = F.aggregate(F.transform("p", lambda i, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - i, F.lit(5)))), F.lit(0), lambda a, b: a + b)
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: Words of the usual length, without symbols or repeats, that each text counts as having besides its own, so that a short one isn't odd by chance.
PRIOR_WORDS, PRIOR_CHARS = 30, 150


def vector() -> list[Column]:
    """Transformed statistics: logarithms of sizes, arcsine roots of shares."""
    words = F.col("n_words") + PRIOR_WORDS
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / b)))
    return [
        F.log(words).alias("x_words"),
        F.log((F.col("word_chars") + PRIOR_CHARS) / words).alias("x_length"),
        F.asinh(100 * F.col("n_symbols") / (F.col("word_chars") + PRIOR_CHARS)).alias("x_symbols"),
        share("n_dup_lines", F.col("n_lines") + 3).alias("x_lines"),
        share("n_repeat_words", words).alias("x_repeats"),
        (F.log(F.col("n_distinct") + PRIOR_WORDS) / F.log(words)).alias("x_variety"),
    ]


def _factor(rows: DataFrame) -> DataFrame:
    """From ``m_i`` (means) and ``c_i_j`` (covariances): ``m_i``, the inverse Cholesky factor ``v_i_j`` and ``logdet``."""
    n = len(DIMS)
    for i in range(n):
        for j in range(i + 1):
            rest = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            value = F.col(f"c_{i}_{j}") - rest
            rows = rows.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[DIMS[i]] ** 2 / 4))) if i == j else value / F.col(f"l_{j}_{j}"))
    for i in range(n):
        for j in range(i + 1):
            rest = sum((F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            rows = rows.withColumn(f"v_{i}_{j}", (F.lit(1.0 if i == j else 0.0) - rest) / F.col(f"l_{i}_{i}"))
    logdet = sum((2 * F.log(f"l_{i}_{i}") for i in range(n)), F.lit(0.0))
    return rows.select("cell", "start", *(f"m_{i}" for i in range(n)), *(f"v_{i}_{j}" for i in range(n) for j in range(i + 1)), logdet.alias("logdet"))


def _distance() -> Column:
    n = len(DIMS)
    parts = (sum((F.col(f"v_{i}_{j}") * (F.col(DIMS[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(n))
    return sum((p * p for p in parts), F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    n = len(DIMS)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    sums = rows.groupBy("cell", "start").agg(F.count("*").alias("k"), *(F.sum(d).alias(f"s_{i}") for i, d in enumerate(DIMS)), *(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q_{i}_{j}") for i, j in pairs))
    mean = lambda i: F.col(f"s_{i}") / F.col("k")
    return sums.select(
        "cell", "start", *(mean(i).alias(f"m_{i}") for i in range(n)),
        *((F.col(f"q_{i}_{j}") / F.col("k") - mean(i) * mean(j) + F.lit(FLOORS[DIMS[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs),
    )


def covariances(vectors: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates of each ``cell``: ``(cell, m_*, v_*, middle)``.

    Two deterministic starts, from medians with median absolute deviations and from classical moments, are
    concentrated: the ``core`` share of nearest vectors gives the next mean and covariance, whose determinant
    can't grow. The start that ends with the smaller determinant wins. Covariances carry the floors on their
    diagonal, so that a statistic that is nearly always the same doesn't make them singular. ``middle``: the median squared distance.
    Percentiles are approximate, to 1/2000 of a cell, and may differ by that with the order of rows.
    """
    n = len(DIMS)
    medians = vectors.groupBy("cell").agg(*(F.percentile_approx(d, 0.5, 2000).alias(f"m_{i}") for i, d in enumerate(DIMS)))
    medians = small(written(medians, "medians"))  # a row per cell, as are all tables that vectors meet
    spread = vectors.join(medians, "cell").groupBy("cell").agg(*(F.percentile_approx(F.abs(F.col(d) - F.col(f"m_{i}")), 0.5, 2000).alias(f"d_{i}") for i, d in enumerate(DIMS)))
    robust = medians.join(spread, "cell").select(
        "cell", F.lit(0).alias("start"), *(F.col(f"m_{i}").cast("double") for i in range(n)),
        *((F.pow(1.4826 * F.col(f"d_{i}"), 2) + FLOORS[DIMS[i]] ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)),
    )
    classical = _moments(vectors.withColumn("start", F.lit(1)))
    state = written(_factor(robust.unionByName(classical)), "mcd")
    for _ in range(steps):
        near = vectors.join(small(state), "cell").select("cell", "start", *DIMS, _distance().alias("d"))
        edge = small(written(near.groupBy("cell", "start").agg(F.percentile_approx("d", core, 2000).alias("edge")), "edges"))
        state = written(_factor(_moments(near.join(edge, ["cell", "start"]).where("d <= edge"))), "mcd")
    best = state.groupBy("cell").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    state = written(state.join(best, ["cell", "start"]).drop("start", "logdet"), "mcd")
    middle = vectors.join(small(state), "cell").groupBy("cell").agg(F.percentile_approx(_distance(), 0.5, 2000).alias("middle"))
    return written(state.join(middle, "cell"), "mcd")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", far: float = FAR, far_units: float = FAR_UNITS, least_cell: int = LEAST_CELL) -> DataFrame:
    """Counts, base rules and the outlier verdict of every row.

    Estimates come from the distinct vectors of documents that pass the base rules, per language and source, so that copies of
    one text don't narrow a cell. Cells with fewer than ``least_cell`` vectors are pooled by language, then all together, however few that
    makes: there the floors decide. Returns ``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance)``. Null or empty text: no words, so it fails. Null languages and sources are cells of their
    own. One row out for each row in, ids may repeat or be null; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    with scope() as keep:
        stats, cells, state = map(keep, _fitted(docs, id_col, text_col, lang_col, source_col, least_cell))
        judged = stats.join(small(cells), ["lang", "source"], "left").join(small(state), "cell", "left")
    limit = F.greatest(F.lit(far_units), far * F.col("middle"))
    return judged.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(_distance() <= limit, F.lit(True))).alias("kept"), _distance().alias("distance"),
    )


def _fitted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, least_cell: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: statistics and vectors of all rows, the cell of each language and source, and the estimates of each cell."""
    stats = written(statistics(docs, id_col, text_col, lang_col, source_col).select("*", base_failed().alias("base_failed"), *vector()), "statistics")
    distinct = stats.where("not base_failed").select("lang", "source", *DIMS).distinct()
    counts = distinct.groupBy("lang", "source").count()
    key = lambda *parts: F.concat_ws("\u0001", *parts)
    fine = counts.withColumn("cell", F.when(F.col("count") >= least_cell, key("lang", "source")))
    pooled = fine.where("cell is null").groupBy("lang").agg(F.sum("count").alias("pool"))
    cells = written(
        fine.join(pooled, "lang", "left").select("lang", "source", F.coalesce("cell", F.when(F.col("pool") >= least_cell, key("lang")), F.lit("")).alias("cell")), "cells"
    )
    vectors = written(distinct.join(small(cells), ["lang", "source"]).select("cell", *DIMS), "vectors")
    return stats, cells, covariances(vectors)
