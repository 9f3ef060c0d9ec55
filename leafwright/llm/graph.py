"""Candidate pairs from buckets without all pairs of a large group, and distributed union-find."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, forget, scope, small, written

#: Buckets up to this size are compared member by member at once; larger ones against their centre first.
ALL_PAIRS = 12
#: What stays apart in a large bucket is compared in blocks of about so many members against each other.
BLOCK = 10_000
#: Samples that a sketch holds, two bits of each.
SKETCH = 32
_ODD_BITS = 0x5555555555555555


def differing(xored: Column) -> Column:
    """How many of ``SKETCH`` samples differ in their two bits, from the exclusive or of two sketches. A sample that is the same never counts; one that isn't does three times of four."""
    return F.bit_count((xored.bitwiseOR(F.shiftrightunsigned(xored, 1))).bitwiseAND(F.lit(_ODD_BITS)))


def _pairs(rows: DataFrame, most: int, all_pairs: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``(a, b, far)``, a < b, whose sketches differ in ``far`` samples, ``most`` at most, and ``(key, id, sketch, m)`` of the large buckets.

    Buckets of two, the most frequent ones, are told by aggregates. Up to ``all_pairs`` members meet each other; a larger
    bucket gives a star around its centre, the id whose buckets are largest in sum: among copies edited
    each in its own way that is the text they were made from. Counts and centres are aggregates, so no bucket is gathered in one task.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("a"), F.max("id").alias("b"), F.bit_xor("sketch").alias("xored")).where("m > 1")
    counts = written(counts, name + "-counts")
    two = counts.where((F.col("m") == 2) & (F.col("a") != F.col("b"))).select("a", "b", differing(F.col("xored")).alias("far")).where(F.col("far") <= most)
    full = written(rows.join(small(counts.where("m > 2").select("key", "m"), BROADCAST_IDS), "key"), name + "-members")
    far = differing(F.col("x.sketch").bitwiseXOR(F.col("y.sketch")))
    few, many = full.where(F.col("m") <= all_pairs), full.where(F.col("m") > all_pairs)
    near = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (far <= most)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), far.alias("far"))
    weight = full.groupBy("id").agg(F.sum("m").alias("weight"))
    ranked = many.join(weight, "id").select("key", F.struct("weight", (-F.col("id")).alias("nid"), "id", "sketch").alias("rank"))
    centres = written(ranked.groupBy("key").agg(F.max("rank").alias("rank")).select("key", F.col("rank.id").alias("centre"), F.col("rank.sketch").alias("middle")), name + "-centres")
    star = many.join(small(centres), "key").where(F.col("id") != F.col("centre"))
    star = star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), differing(F.col("sketch").bitwiseXOR(F.col("middle"))).alias("far")).where(F.col("far") <= most)
    # A pair may be near by one kind of sketch and nearer by another.
    return written(two.unionByName(near).unionByName(star).groupBy("a", "b").agg(F.min("far").alias("far")), name + "-pairs"), many


class Detail(NamedTuple):
    """What candidates are judged by, fetched once for some ids."""

    #: ``(id, ...)``, from which ``judge`` estimates how far two ids are apart; None if sketches tell enough.
    table: DataFrame | None
    #: Takes two functions from the name of a column of ``table`` to the column of one end, and gives whether a pair may be similar, and its distance.
    judge: Callable[[Callable[[str], Column], Callable[[str], Column]], tuple[Column, Column]] | None
    #: Those of some pairs ``(a, b)`` that are similar.
    verify: Callable[[DataFrame], DataFrame]
    #: Gives ``(id, ...)``, by which ``reach`` bounds the likeness of two ids from above; None if there is no such bound.
    whole: Callable[[], DataFrame] | None = None
    #: Takes two functions as ``judge`` does, for columns of ``whole``, and gives whether the bound lets a pair be similar: never false for one that is.
    reach: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None


def _judged(pairs: DataFrame, detail: Detail, name: str) -> DataFrame:
    """The ``pairs (a, b, far)`` that may be similar, with the distances that ``detail`` estimates."""
    if detail.table is None:
        return pairs
    more = [c for c in detail.table.columns if c != "id"]
    side = lambda end: detail.table.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in more))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    may, far = detail.judge(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    return written(both.where(may).select("a", "b", far.alias("far")), name + "-near")


def _apart(many: DataFrame, united: DataFrame, most: int, prepare: Callable[[DataFrame], Detail], name: str, block: int) -> tuple[DataFrame, Detail]:
    """Pairs ``(a, b)`` in large buckets whose ends aren't connected in ``united`` yet and that may be similar, and what they are judged by.

    Of each bucket, the members outside its largest group meet all its members, block by block, and are judged to the end there: where hundreds of copies lie
    just beyond the limit, nearly all of their pairs are near by sketches, and few are similar. Members that meet in several buckets are compared in
    the first of them: by ids and sketches, for a second kind of sketch may tell otherwise.
    """
    held = written(many.join(small(united), "id", "left").select("key", "id", "sketch", "m", F.coalesce("root", "id").alias("root")), name + "-held")
    groups = held.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main")
    apart = held.join(small(written(groups, name + "-groups"), BROADCAST_IDS), "key")
    apart = written(apart.select("key", "id", "sketch", "root", (F.col("root") != F.col("main")).alias("minor"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), name + "-parts")
    detail = prepare(apart.select("id").distinct())
    dealt = apart.join(apart.groupBy("id", "sketch").agg(F.collect_set("key").alias("keys")), ["id", "sketch"])
    dealt = dealt if detail.table is None else dealt.join(detail.table, "id")
    apart = written(dealt if detail.whole is None else dealt.join(detail.whole(), "id"), name + "-dealt")
    x = apart.where("minor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = apart.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("y")
    # All conditions belong to the join, so no row is made of a pair that doesn't meet them.
    meet = F.expr("x.key = y.key and x.block = y.block and x.root != y.root and (not y.minor or x.id < y.id)") & (differing(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= most)
    if detail.table is not None:
        meet = meet & detail.judge(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))[0]
    meet = meet & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    if detail.whole is not None:  # last, for it costs most
        meet = meet & detail.reach(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    pairs = x.join(y, meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return written(pairs, name + "-apart"), detail


def linked(rows: DataFrame, most: int, prepare: Callable[[DataFrame], Detail], name: str, all_pairs: int = ALL_PAIRS, block: int = BLOCK) -> DataFrame:
    """``(id, root)`` of all ids that verified pairs connect: pairs that share a bucket of ``rows (key, id, sketch)`` and whose sketches differ in ``most`` samples at most.

    ``prepare`` fetches what the ids of candidates are judged by. First each id meets its nearest partner alone, then of each two groups so far the
    nearest two members, then all pairs whose ends are still apart. In large buckets all that is apart then meets all others there, block
    by block, so no link in a bucket is lost. That is linear for copies, and grows with the square of a bucket
    whose ids aren't alike, by some nanoseconds for each pair of sketches; what is near by them is bounded by whole sets, and only what that lets pass leaves it.
    """
    with scope() as keep:
        pairs, many = _pairs(rows, most, all_pairs, name)
        detail = prepare(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        nearest = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "far")).groupBy("b").agg(F.min_by("a", "far").alias("a"))
        first = written(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("far")).distinct(), name + "-first")
        united = components(detail.verify(_judged(first, detail, name).select("a", "b")))
        rest = _still_apart(_judged(_still_apart(pairs, united, name).select("a", "b", "far"), detail, name), united, name)
        # Of each two groups the nearest pair; it may fail where others don't, so these follow.
        one = rest.groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.min(F.struct("far", "a", "b")).alias("n")).select("n.a", "n.b")
        united = _joined(united, detail.verify(written(one, name + "-second")))
        rest = _still_apart(rest.select("a", "b", "far"), united, name)
        united = _joined(united, detail.verify(rest.select("a", "b")))
        apart, detail = _apart(many, united, most, prepare, name, block)
        return keep(_joined(united, detail.verify(apart)) if not apart.isEmpty() else united)


def _still_apart(pairs: DataFrame, united: DataFrame, name: str) -> DataFrame:
    """``(a, b, far, ra, rb)``: the pairs whose ends ``united`` doesn't connect, with their roots."""
    roots = small(united)
    both = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    both = both.select("a", "b", "far", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    return written(both.where("ra != rb"), name + "-rest")


def _joined(united: DataFrame, edges: DataFrame) -> DataFrame:
    """``united (id, root)`` with further edges."""
    if edges.isEmpty():
        return united
    return components(united.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(edges), united.select("id"))


def components(edges: DataFrame, ids: DataFrame | None = None, name: str = "components") -> DataFrame:
    """``(id, root)`` for every id in ``edges (a, b)`` and ``ids (id)``: the smallest id that it is connected with.

    Union-find by contraction: every id points at its smallest neighbour, pointers are followed twice, and edges are
    carried over to what their ends point at, until none is left. Rounds grow with the logarithm of a component's
    length; the smallest id always points at itself, so it is what a component ends in. Only written tables pass from one round to the next, and nothing is collected.
    """
    with scope() as keep:
        edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
        ends = edges.select(F.col("a").alias("id")).union(edges.select("b"))
        roots = written((ends if ids is None else ends.unionByName(ids)).distinct().withColumn("root", F.col("id")), name)
        while not edges.isEmpty():
            both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
            step = written(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")), name)
            further = small(step.select(F.col("id").alias("to"), F.col("to").alias("next")))
            step, old = written(step.join(further, "to").select("id", F.col("next").alias("to")), name), step
            forget(old)
            hint = small(step)
            roots, old = written(roots.join(hint.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), name), roots
            forget(old)
            left = edges.join(hint.select(F.col("id").alias("a"), F.col("to").alias("c")), "a").join(hint.select(F.col("id").alias("b"), F.col("to").alias("d")), "b")
            edges, old = written(left.where("c != d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), name), edges
            forget(old, step)
        return keep(roots)
