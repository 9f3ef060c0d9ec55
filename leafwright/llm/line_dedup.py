"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, union-find. All native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, forget, scope, small, text_of, written
from .graph import Detail, linked

SIMILARITY = 0.8
#: Characters of a shingle when similarity is computed.
SHINGLE = 5
#: Characters of a shingle from which signatures are drawn. Edits spread so that 0.8 of the 5-character shingles remain leave
#: 35 of 45 + 10, a likeness of 0.64, of these, and lines that are alike by chance share far fewer of them.
SIGNED = 10
#: A pair at the limit of similarity shares no band with a probability of (1 - 0.64^2)^10 = 0.5 %.
BANDS, ROWS = 10, 2
#: Samples of which a sketch holds two bits each; bands use the first ones. At the limit 8.7 of 32 differ, give or take 2.5; 22 in lines alike by chance.
SAMPLES, MOST_DIFFERING = 32, 16
#: Before a pair's shingles are compared exactly, its likeness is estimated from sets of 64 * WORDS bits, to 0.015 (0.025 where they are nearly
#: full); it is dropped only if that is SLACK below the limit. Sets that fill FULL bits tell nothing.
WORDS, SLACK, FULL = 16, 0.07, 960
#: Signatures use each fourth shingle by its hash; lines of fewer characters, or with fewer different shingles of that kind, get one from all shingles besides.
THIN, SHORT, FEW = 4, 112, 12


def _seeds(n: int) -> tuple[int, ...]:
    """XORed to a shingle's hash, one for each band, so that each orders the shingles anew; below 2^31."""
    return tuple((0x9E3779B1 * (2 * k + 1) ^ 0x85EBCA6B * (k + 3)) % (1 << 31) for k in range(n))


_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def _wide(line: str | Column) -> Column:
    """Four bytes a character, so that a shingle is cut out at its place without a walk through the line."""
    return F.encode(line, "UTF-32")


def _places(wide: str | Column, size: int) -> Column:
    """Where runs of ``size`` characters begin; 1 alone if the line is shorter."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(wide) / 4).cast("int") - (size - 1)))


def shingles(line: str | Column) -> Column:
    """The distinct 64-bit hashes of all runs of ``SHINGLE`` characters of a line; that of the whole line if it is shorter."""
    runs = lambda wide: F.transform(_places(wide, SHINGLE), lambda at: F.xxhash64(F.substring(wide, 4 * at - 3, F.lit(4 * SHINGLE))))
    return F.get(F.transform(F.array(_wide(line)), lambda wide: F.array_distinct(runs(wide))), 0)  # the lambda's name stands for the bytes, made once


def alike(x: str | Column, y: str | Column, similarity: float) -> Column:
    """Whether the Jaccard similarity of two lines' shingles reaches ``similarity``."""
    sets = F.array(F.struct(shingles(x).alias("x"), shingles(y).alias("y")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("both"), (F.size(s["x"]) + F.size(s["y"])).alias("sum")))
    return F.exists(sizes, lambda n: n["both"] >= similarity * (n["sum"] - n["both"]))


def codes(lines: DataFrame) -> DataFrame:
    """``(id, codes, total, lost)``: 16 bits of the hash of each different run of ``SHINGLE`` characters, how many runs there are, and how many of them share their code with another."""
    sets = lines.select(F.col("node").alias("id"), shingles("line").alias("all"))
    short = F.array_distinct(F.transform("all", lambda h: (h.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint")))
    return sets.select("id", short.alias("codes"), F.size("all").alias("total")).withColumn("lost", F.col("total") - F.size("codes"))


def _reach(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Whether lines can have ``similarity``: runs that both hold have a code that both hold, so these and the fewer of those lost are the most that they can share."""
    both = F.size(x("codes")) + F.size(y("codes")) - F.size(F.array_union(x("codes"), y("codes")))  # in half the time of an intersection
    most = both + F.least(x("lost"), y("lost"))
    # A lambda keeps a join's condition out of the stage's one method, which would be too long to be compiled to machine code.
    return F.exists(F.array(most), lambda n: n >= similarity / (1 + similarity) * (1 - 1e-9) * (x("total") + y("total")))


def bitmaps(lines: DataFrame) -> DataFrame:
    """``(id, w0, w1, ...)``: the hashes of a line's runs of ``SHINGLE`` characters as a set of ``64 * WORDS`` bits; ``lines``: ``(node, line)``, no line twice."""
    wide = lines.select("node", _wide("line").alias("wide"))
    spots = wide.select("node", "wide", F.explode(_places("wide", SHINGLE)).alias("at")).select("node", F.xxhash64(F.substring("wide", 4 * F.col("at") - 3, F.lit(4 * SHINGLE))).alias("h"))
    marked = spots.select("node", F.pmod(F.shiftrightunsigned("h", 32), F.lit(WORDS)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    return marked.groupBy(F.col("node").alias("id")).agg(*(F.coalesce(F.bit_or(F.when(F.col("w") == i, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)))


def _estimate(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> tuple[Column, Column]:
    """Whether two sets of bits may stem from lines of ``similarity``, by the sizes of both sets and of them together, as the bits that are set tell them; and their distance in 1/1000."""
    count = lambda word: sum((F.bit_count(word(f"w{i}")) for i in range(WORDS)), F.lit(0))
    size = lambda n: -F.log(1 - F.least(n, F.lit(FULL)) / (64.0 * WORDS))
    both = count(lambda w: x(w).bitwiseOR(y(w)))
    alike = (size(count(x)) + size(count(y))) / size(both) - 1
    return (both >= FULL) | (alike >= similarity - SLACK), F.round(1000 * (1 - alike)).cast("int")


def _signed(lines: DataFrame, thin: bool) -> DataFrame:
    """``(id, kind, sketch, keys, guess)`` of lines ``(node, line)``, which may repeat, from all shingles or from one of ``THIN``.

    The least values over n shingles are 2^31 / n on average, and so tell how many different ones there are.
    """
    wide = lines.select("node", _wide("line").alias("wide"))
    hashed = wide.select("node", "wide", F.explode(_places("wide", SIGNED)).alias("at")).select("node", F.xxhash64(F.substring("wide", 4 * F.col("at") - 3, F.lit(4 * SIGNED))).alias("h"))
    if thin:
        hashed = hashed.where(F.col("h").bitwiseAND(F.lit(THIN - 1)) == 0)
    # The samples of a band order by bits of their own, so that they agree independently in short lines, too.
    parts = hashed.select("node", *(F.shiftrightunsigned("h", 8 * r + 3).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias(f"h{r}") for r in range(ROWS + 2)))
    drawn = [(b, r) for b in range(BANDS) for r in range(ROWS)] + [(BANDS + e, ROWS + e % 2) for e in range(SAMPLES - BANDS * ROWS)]
    seeds = _seeds(BANDS + SAMPLES)
    mins = parts.groupBy("node").agg(*(F.min(F.col(f"h{r}").bitwiseXOR(F.lit(seeds[b]))).alias(f"m{i}") for i, (b, r) in enumerate(drawn)))
    sketch = F.lit(0).cast("long")
    for i in range(SAMPLES):
        sketch = sketch.bitwiseOR(F.shiftleft(F.col(f"m{i}").bitwiseAND(F.lit(3)).cast("long"), 2 * i))
    keys = F.array(*(F.xxhash64(F.lit(b + (BANDS if thin else 0)), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))) for b in range(BANDS)))
    total = sum((F.col(f"m{i}").cast("double") for i in range(SAMPLES)), F.lit(0.0))
    return mins.select(F.col("node").alias("id"), sketch.alias("sketch"), keys.alias("keys"), (SAMPLES * float(1 << 31) / (total + 1)).alias("guess"))


def signatures(lines: DataFrame, places: DataFrame) -> list[DataFrame]:
    """Written tables ``(id, sketch, keys, guess)``: of all lines ``(node, line)`` from some of their shingles, and of short or repetitive ones from all.

    ``places``: ``(node, long)`` of the same lines. A line whose thinned set is empty, as it can be with a few different shingles, is among the latter, too.
    """
    thin = written(_signed(lines, True), "line-thin")
    full = [written(_signed(lines.where(~_long()), False), "line-full")]
    enough = thin.where(F.col("guess") >= FEW).select(F.col("id").alias("node"))
    odd = written(places.where("long").select("node").distinct().join(enough, "node", "left_anti"), "line-odd")
    if not odd.isEmpty():
        full.append(written(_signed(lines.where(_long()).join(small(odd, BROADCAST_IDS), "node", "left_semi"), False), "line-full"))
    return [thin, *full]


def _long() -> Column:
    return F.char_length("line") >= SHORT


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Written tables ``(key, gone)``: the line numbers (from 0, ascending) that go from the text with this key, where any go; and ``(key)`` of repeated rows.

    Lines with a word that are equal, or whose sets of ``SHINGLE`` characters have a Jaccard similarity of ``similarity`` or
    more, are connected; of each component the first line stays, by document id (nulls first), key and line number.
    ``key`` is the 64-bit hash of id and text; of rows that repeat both, ``gone`` is meant for one, and the others keep no line. Null and empty
    texts, and those without a word, have no lines; an empty table gives no rows.

    Equal lines are one node. Shingles are exploded and reduced to signatures by an aggregate that combines before the
    shuffle, so neither long lines nor frequent ones gather anywhere; the text of lines is read again only for candidates.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("id", "text").alias("key"), "text")
    lines = base.select("id", "key", F.posexplode(_lines("text")).alias("nr", "line")).where(F.col("line").rlike(_WORD)).withColumn("node", F.xxhash64("line"))

    def prepare(ids: DataFrame) -> Detail:
        ends = written(ids.withColumnRenamed("id", "node"), "line-ends")
        texts = written(lines.select("node", "line").join(small(ends, BROADCAST_IDS), "node", "left_semi").dropDuplicates(["node"]), "line-texts")

        def verify(some: DataFrame) -> DataFrame:
            compared = some.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
            return written(compared.where(alike("x", "y", similarity)).select("a", "b"), "line-edges")

        return Detail(written(bitmaps(texts), "line-bits"), lambda x, y: _estimate(x, y, similarity), verify, lambda: codes(texts), lambda x, y: _reach(x, y, similarity))

    with scope() as keep:
        places = written(lines.select("id", "key", "nr", "node", _long().alias("long")), "line-places")
        signs = signatures(lines.select("node", "line"), places)
        rows = signs[0].select(F.explode("keys").alias("key"), "id", "sketch")
        for more in signs[1:]:
            rows = rows.unionByName(more.select(F.explode("keys").alias("key"), "id", "sketch"))
        united = linked(rows, MOST_DIFFERING, prepare, "lines").withColumnRenamed("id", "node")
        forget(*signs)

        placed = places.join(small(united), "node", "left").select("id", "key", "nr", F.coalesce("root", "node").alias("root"))
        counts = placed.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
        many = written(placed.join(small(written(counts, "line-counts"), BROADCAST_IDS), "root"), "line-many")
        first = many.groupBy("root").agg(F.min(F.struct("id", "key", "nr")).alias("first"))
        others = many.join(small(written(first, "line-first")), "root").where(~((F.col("key") == F.col("first.key")) & (F.col("nr") == F.col("first.nr"))))
        # As many numbers as a text has lines, at most; rows that repeat a text name each number once.
        gone = keep(written(others.groupBy("key").agg(F.sort_array(F.collect_set("nr")).alias("gone")), "line-gone"))
        again = places.groupBy("key", "nr").agg(F.count("*").alias("n")).where("n > 1").select("key").distinct()
        return gone, keep(written(again, "line-again"))


def _flags(gone: str) -> Column:
    """A string with a 1 for each line number in ``gone`` and a 0 for each between them."""
    gaps = F.transform(gone, lambda p, k: F.concat(F.repeat(F.lit("0"), p - F.when(k > 0, F.get(gone, k - 1)).otherwise(F.lit(-1)) - 1), F.lit("1")))
    return F.array_join(gaps, "")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, counts: bool = False) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` names; all rows and columns stay.

    A text from which all lines go becomes empty; lines without a word stay; null texts stay null. Of rows that repeat id and
    text, one counts and the others lose all lines with a word. With ``counts`` the columns ``n_lines``, ``dropped`` (the
    numbers of the lines that went) are added.
    """
    key = "__key_of_lines"
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), text_of(text_col)))
    with scope() as keep:
        gone, again = repeated_lines(docs, id_col, text_col, similarity)
        marked = keyed.join(small(keep(gone).toDF(key, "__gone")), key, "left")
        if not again.isEmpty():
            again = small(keep(again).toDF(key), BROADCAST_IDS)
            copies = keep(written(keyed.join(again, key, "left_semi").withColumn("__row", F.monotonically_increasing_id()), "line-copies"))
            first = small(keep(written(copies.groupBy(key).agg(F.min("__row").alias("__first")), "line-firsts")))
            words = F.filter(F.sequence(F.lit(0), F.size(_lines(text_of(text_col))) - 1), lambda i: F.get(_lines(text_of(text_col)), i).rlike(_WORD))
            copies = copies.join(small(gone.toDF(key, "__gone")), key, "left").join(first, key)
            copies = copies.withColumn("__gone", F.when(F.col("__row") == F.col("__first"), F.col("__gone")).otherwise(F.nullif(words, F.array().cast("array<int>"))))
            marked = marked.join(again, key, "left_anti").unionByName(copies.drop("__row", "__first"))
    # Line numbers become one string of flags, read byte by byte.
    flags = _flags("__gone").cast("binary")
    marked = marked.withColumn("__flags", flags)
    left = F.filter(_lines(F.col(text_col)), lambda line, i: F.coalesce(F.substring("__flags", i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True)))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    extra = {"n_lines": F.size(F.filter(_lines(text_of(text_col)), lambda x: x.rlike(_WORD))), "dropped": F.coalesce("__gone", F.array().cast("array<int>"))} if counts else {}
    return marked.withColumns(extra | {text_col: text}).select(*docs.columns, *extra)
