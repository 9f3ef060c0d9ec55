"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, BROADCAST_ROWS, forget, release, scope, small, text_of, written
from .graph import SKETCH, Detail, differing, linked

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
#: A shingle in more than one of so many documents weighs less than others, by the logarithm of how many times more.
RARE = 1000
#: Such shingles are this many at most (12 bytes each on every executor): where documents are so long that there could be more, fewer count as common.
COMMON = 4 * BROADCAST_ROWS
#: A pair whose sketches differ in more of ``SKETCH`` samples isn't verified; at the limit of similarity 4.8 differ, give or take 2.
MOST_DIFFERING = 13
#: Shingles that a task holds at a time while it names common ones, and documents that such a task should see at least.
SEGMENT, LEAST_DOCS = 1 << 22, 8192
#: Part of a common shingle's share of documents that names it in a segment.
NAMED = 0.75
#: Candidates get longer sketches, of 64-bit words of 32 samples; at the limit of similarity 38 of 256 samples differ, give or take 6, and a pair in which
#: more than FARTHEST do isn't verified.
WORDS, FARTHEST = 8, 62

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct 64-bit hashes of each text's word runs, ascending, and how often each occurs.

    Words are lower-cased runs without white space. A text with fewer than ``size`` words is one shingle, one without words has none.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    limits = np.cumsum([0, *(len(r) + 1 for r in raw)])
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    none = (np.empty(0, np.uint64), np.empty(0, np.uint32))
    if not len(starts):
        return [none] * len(texts)
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1
    word = np.maximum(np.cumsum(inside & np.concatenate([[True], space[:-1]])) - 1, 0)
    place = np.where(inside, np.arange(len(data)) - starts[word], 0)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int((ends - starts).max()), 0x100000001B3, np.uint64)]), dtype=np.uint64)
    value = np.where(inside, _BYTES[data] * powers[place], np.uint64(0))
    words = _mix(np.add.reduceat(value, starts))
    first = np.searchsorted(starts, limits)
    out = []
    if len(words) >= size:
        runs = words[: len(words) - size + 1] * _PLACE[0]
        for k in range(1, size):
            runs = runs + words[k : len(words) - size + 1 + k] * _PLACE[k]
        runs = _mix(runs)
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            out.append(_counted(runs[a : b - size + 1]))
        elif b > a:
            out.append((_mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64)), np.ones(1, np.uint32)))
        else:
            out.append(none)
    return out


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    at = np.flatnonzero(new)
    return x[at], np.diff([*at, len(x)]).astype(np.uint32)


def _chunks(texts: list[str], size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters, with the number of the first."""
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield at, texts[at : i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


#: Quantiles from which samples are drawn: Gamma(2, 1) twice and a uniform shift.
_DRAW = np.random.default_rng(13)
_RATE = _DRAW.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOGC = np.log(_DRAW.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_SHIFT = _DRAW.random(1 << 16).astype(np.float32)
_KEYS = _DRAW.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = _DRAW.integers(1, 2**63, WORDS * SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def samples(found: list[np.ndarray], weights: list[np.ndarray], keys: np.ndarray = _KEYS) -> np.ndarray:
    """(text, sample) of texts with at least one shingle; two texts agree on a sample with the probability of their weighted Jaccard similarity.

    Improved consistent weighted sampling: for each shingle of weight w a rate r, an offset c and a shift b
    follow from its hash; t = floor(ln w / r + b), and the least ln c - r (t - b + 1) is drawn. That value
    is a function of the shingle and of t, and so stands for both.
    """
    hashes, logs = np.concatenate(found), np.log(np.concatenate(weights)).astype(np.float32)
    sizes = np.array([len(f) for f in found])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(found), len(keys)), np.float32)
    low = np.uint64(0xFFFF)
    for k, key in enumerate(keys):
        m = (hashes * key) ^ (hashes >> np.uint64(29))
        m = m * _M2
        rate = _RATE[((m >> np.uint64(16)) & low).view(np.int64)]
        shift = _SHIFT[((m >> np.uint64(32)) & low).view(np.int64)]
        t = np.floor(logs / rate + shift)
        out[:, k] = np.minimum.reduceat(_LOGC[(m >> np.uint64(48)).view(np.int64)] - rate * (t - shift + 1), starts)
    return out


def _sketches(drawn: np.ndarray) -> np.ndarray:
    """(text, word): two bits of each sample, ``SKETCH`` samples a word."""
    bits = (_mix(drawn.view(np.uint32).astype(np.uint64) * _M2) & np.uint64(3)).reshape(len(drawn), -1, SKETCH) << (2 * np.arange(SKETCH)).astype(np.uint64)
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def _weights(hashes: np.ndarray, times: np.ndarray, common: np.ndarray, idf: np.ndarray, usual: float) -> np.ndarray:
    """TF-IDF weights: ``idf`` for the shingles in ``common`` (ascending), ``usual`` for all others."""
    w = np.full(len(hashes), usual)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hit = common[at] == hashes
        w[hit] = idf[at[hit]]
    return w * times


def _codes(x: np.ndarray, n: np.ndarray, weights: np.ndarray, usual: float) -> tuple[np.ndarray, int, float, float]:
    """A code of each different place of each shingle, its ``weights`` (``usual`` at most) in the last 16 bits, rounded up; their sum; the exact sum of all weights in these units; and what is lost where codes agree."""
    unit = 0xFFFF / usual
    size = np.minimum(np.ceil(weights * unit), 0xFFFF).astype(np.uint64)
    at = np.repeat(np.arange(len(x)), n)
    place = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    codes = np.unique((_mix(x[at] + place * _M1) & ~np.uint64(0xFFFF)) | size[at])
    held = int((codes & np.uint64(0xFFFF)).sum())
    return codes, held, float((weights * n).sum() * unit), float(int(size[at].sum()) - held)


def _reach(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Whether texts can have ``similarity``: no more weight can be in both than that of the codes in both, and what the one with less has lost."""
    both = F.aggregate(F.array_except(x("codes"), y("codes")), x("held"), lambda left, code: left - code.bitwiseAND(F.lit(0xFFFF)))
    return both + F.least(x("lost"), y("lost")) >= similarity / (1 + similarity) * (1 - 1e-9) * (x("total") + y("total"))


def _blob_rows(batch: pa.RecordBatch, name: str, times: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and counts; absent counts are ones."""
    for blob, t in zip(batch.column(name), batch.column(times)):
        x = np.frombuffer(blob.as_buffer() or b"", "<u8")
        raw = t.as_py()
        yield x, np.ones(len(x), np.uint32) if raw is None else np.frombuffer(raw, "<u4")


def _collected(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of ``df``, which are of type long, as arrays: Arrow buffers all the way to the driver, 8 bytes a value, never a row object."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in df.columns}


def common_shingles(table: DataFrame, least: float, documents: int) -> DataFrame:
    """``(hash, n)``: exact counts of the shingles that more than ``least`` of ``documents`` documents hold, however rows are dealt to tasks.

    Tasks name, with its count there, what passes ``NAMED`` of its share, ``least / documents`` of the documents, in a segment. What a segment doesn't
    name has no more than that there, so its counts elsewhere and as much for each other segment bound a shingle; those whose bound passes ``least`` are
    counted everywhere in a second pass. Each of them stands in more than ``least * (1 - NAMED)`` documents, so more tasks don't make more of them.
    Tasks are merged until they see ``LEAST_DOCS`` documents on average, for in a part of few documents everything passes.
    """
    rows = table.select("shingles", "times")
    passed = NAMED * least / documents

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def passing() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            x.sort()
            more = int(passed * docs)  # what stands again so many places on occurs more often than that
            first = x[: max(0, len(x) - more)]
            names = np.unique(first[first == x[more:]])
            times = np.searchsorted(x, names, "right") - np.searchsorted(x, names)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(times, pa.int64()), pa.array(np.full(len(names), docs, np.int64))], names=["hash", "n", "docs"])

        for batch in batches:
            for x, _ in _blob_rows(batch, "shingles", "times"):
                held.append(x.copy())
                size, docs = size + len(x), docs + 1
                if size >= SEGMENT:
                    yield passing()
                    size = docs = 0
        if held:
            yield passing()
        release()

    merged = rows.coalesce(max(1, documents // LEAST_DOCS))
    parts = merged.mapInArrow(named, "hash long, n long, docs long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # Rounded in favour of a name; the second pass decides.
    names = written(parts.where(F.col("n") + passed * (documents - F.col("docs")) > least * (1 - 1e-9)).select("hash"), "named")
    if names.count() > COMMON:  # documents of very many words
        exploded = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["hash"]) for b in batches for x, _ in _blob_rows(b, "shingles", "times")), "hash long")
        counts = exploded.join(names, "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n"))
    else:
        listed = table.sparkSession.sparkContext.broadcast(np.sort(_collected(names)["hash"].view(np.uint64)))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = listed.value
            total = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for x, _ in _blob_rows(batch, "shingles", "times"):
                    if len(wanted) and len(x):
                        at = np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)
                        total[at[wanted[at] == x]] += 1  # a text's shingles are distinct
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[k].view(np.int64)), pa.array(total[k])], names=["hash", "n"])
            release()

        counts = rows.mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    common = written(counts.where(F.col("n") > least), "common")
    forget(names)
    return common


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Classes of documents connected by a weighted Jaccard similarity of ``similarity`` or more.

    Equal texts are one node, whatever their number. A shingle of ``size`` words weighs its count times ``1 + ln(N / n)``, n
    being the documents that hold it, or N / ``RARE`` if that is more (more than that where documents have more than
    ``COMMON / RARE`` shingles on average). Texts that agree in ``ROWS`` samples of a band share a bucket; pairs from buckets whose
    sketches are near are verified on their whole shingle sets; verified pairs are united.

    Returns ``(doc_id, node, class_id)`` per row of ``docs``: the 64-bit hash of its text, and the smallest id in its class. Null and
    empty texts are equal texts; those without words are alike only if equal. Rows may repeat; null ids take class ids from others, or null.
    An empty table gives no rows; other columns of ``docs``, whatever their names, aren't read.
    """
    with scope() as keep:
        members, classes = _classes(docs, id_col, text_col, similarity, size)
        named = keep(members).join(small(keep(classes)), "root", "left")
        return named.select("doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"))


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, size: int) -> tuple[DataFrame, DataFrame]:
    """Written tables ``(doc_id, node, root)`` of all rows and ``(root, class_id)`` of classes of more than one row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("node"), text_of(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for k, part in _chunks(some.column("text").to_pylist()):
                    own = shingles(part, size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(some.column(i).slice(k, len(part)) for i in (0, 1)), pa.array([len(x) for x, _ in own], pa.int32()), pa.array([x.tobytes() for x, _ in own], pa.binary()),
                            pa.array([None if len(n) == 0 or n.max() == 1 else n.tobytes() for _, n in own], pa.binary()),
                        ],
                        names=["doc_id", "node", "size", "shingles", "times"],
                    )
        release()

    table = written(rows.mapInArrow(cut, "doc_id long, node long, size int, shingles binary, times binary"), "shingles")
    documents, total = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    documents = max(1, documents)
    least = max(documents / RARE, total / COMMON)
    common = common_shingles(table, least, documents)
    known = _collected(common)  # COMMON rows at most
    order = np.argsort(known["hash"].view(np.uint64))
    usual = 1.0 + float(np.log(documents / max(1.0, least)))
    weigh = table.sparkSession.sparkContext.broadcast((known["hash"][order].view(np.uint64), 1.0 + np.log(documents / np.maximum(known["n"][order].astype(float), 1.0)), usual))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, weights, nodes = [], [], []
            for node, (x, n) in zip(batch.column("node").to_pylist(), _blob_rows(batch, "shingles", "times")):
                if len(x):
                    found.append(x)
                    weights.append(_weights(x, n, *weigh.value))
                    nodes.append(node)
            a = 0
            while a < len(found):
                b, n = a, 0
                while b < len(found) and n < 120_000:
                    n += len(found[b])
                    b += 1
                drawn = samples(found[a:b], weights[a:b])
                s = drawn.view(np.uint32).astype(np.uint64)
                keys = np.zeros((b - a, BANDS), np.uint64)
                for band in range(BANDS):
                    key = np.full(b - a, band + 1, np.uint64)
                    for r in range(ROWS):
                        key = _mix(key * _M1 + s[:, band * ROWS + r])
                    keys[:, band] = key
                sketch = _sketches(np.ascontiguousarray(drawn[:, :SKETCH]))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a:b], pa.int64()), pa.array(sketch), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], names=["node", "sketch", "keys"])
                a = b
        release()

    signed = written(table.select("node", "shingles", "times").mapInArrow(sign, "node long, sketch long, keys array<long>").dropDuplicates(["node"]), "signed")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for (x, n), (y, m) in zip(_blob_rows(batch, "xa", "ta"), _blob_rows(batch, "xb", "tb")):
                u, v = _weights(x, n, *weigh.value), _weights(y, m, *weigh.value)
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = np.minimum(u[i], v[j]).sum()
                keep.append(bool(both >= similarity * (u.sum() + v.sum() - both) * (1 - 1e-12)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
        release()

    def prepare(ids: DataFrame) -> Detail:
        ends = written(ids.withColumnRenamed("id", "node"), "ends")
        sets = written(table.select("node", "shingles", "times").join(small(ends, BROADCAST_IDS), "node", "left_semi").dropDuplicates(["node"]), "sets")

        def verify(some: DataFrame) -> DataFrame:
            compared = some.join(sets.toDF("a", "xa", "ta"), "a").join(sets.toDF("b", "xb", "tb"), "b")
            return written(compared.mapInArrow(similar, "a long, b long"), "edges")

        def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = np.array([_sketches(samples([x], [_weights(x, n, *weigh.value)], _MORE))[0] for x, n in _blob_rows(batch, "shingles", "times")]).reshape(-1, WORDS)
                yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(words[:, i], pa.int64()) for i in range(WORDS))], names=["id", *(f"w{i}" for i in range(WORDS))])
            release()

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    some = batch.slice(at, 64)
                    own = [_codes(x, n, _weights(x, np.ones(len(x)), *weigh.value), usual) for x, n in _blob_rows(some, "shingles", "times")]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("node"), pa.array([o[0].view(np.int64) for o in own], pa.list_(pa.int64())), *(pa.array([o[i] for o in own]) for i in (1, 2, 3))],
                        names=["id", "codes", "held", "total", "lost"],
                    )
            release()

        def judge(x: Callable[[str], Column], y: Callable[[str], Column]) -> tuple[Column, Column]:
            far = sum((differing(x(f"w{i}").bitwiseXOR(y(f"w{i}"))) for i in range(WORDS)), F.lit(0))
            return far <= FARTHEST, far

        return Detail(written(sets.mapInArrow(longer, "id long, " + ", ".join(f"w{i} long" for i in range(WORDS))), "longer"), judge, verify, lambda: sets.mapInArrow(coded, "id long, codes array<long>, held long, total double, lost double"), lambda x, y: _reach(x, y, similarity))

    united = linked(signed.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "sketch"), MOST_DIFFERING, prepare, "buckets")
    members = table.select("doc_id", "node").join(small(united).withColumnRenamed("id", "node"), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    members = written(members, "members")
    classes = members.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    return members, written(classes.drop("n"), "classes")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id (of repeated rows one, null ids last).

    Null and empty texts are one class, so one of them stays. An empty table gives no rows; all columns stay as they are.
    """
    keyed = docs.withColumn("__node_of_text", F.xxhash64(text_of(text_col))).withColumn("__id_of_row", F.col(id_col).cast("long"))
    same = lambda a, b: a["__id_of_row"].eqNullSafe(b["doc_id"]) & (a["__node_of_text"] == b["node"])
    with scope() as keep:
        members, _ = _classes(docs, id_col, text_col, SIMILARITY, SHINGLE)
        # Of each class the least (id, node), null ids last; the others of its members go.
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
        many = written(members.groupBy("root").agg(F.count("*").alias("n"), least.alias("keep")).where("n > 1").select("root", F.col("keep.doc_id").alias("first"), F.col("keep.node").alias("keep")), "groups")
        settled = members.join(small(many), "root").select("doc_id", "node", (F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("node") == F.col("keep"))).alias("stays"))
        settled = written(settled.groupBy("doc_id", "node", "stays").agg(F.count("*").alias("copies")), "settled")
        gone = written(settled.where("not stays or copies > 1"), "gone")
        again = written(settled.where("stays and copies > 1"), "again")
        out = keyed.join(small(keep(gone)), same(keyed, gone), "left_anti")
        if not again.isEmpty():
            repeated = keyed.join(small(keep(again)), same(keyed, again), "left_semi").dropDuplicates(["__id_of_row", "__node_of_text"])
            out = out.unionByName(repeated)
        return out.drop("__node_of_text", "__id_of_row")
