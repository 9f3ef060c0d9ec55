"""Mixture-controlled packing: deficit round-robin over source queues, cut into windows of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder
from .common import exclusive_prefix, release, scope, small, text_of, written

#: Tokens in a window (a training sequence).
WINDOW = 1024
#: A source waits until its deficit allows so many tokens, so that windows aren't cut into crumbs.
LEAST_PIECE = 64
#: Tokens that one task packs at a time (2 bytes each in the shuffle).
GROUP_TOKENS = 1 << 20
#: Tokens of a source that go to groups of windows together, so that a rare source isn't spread in crumbs over all of them.
QUANTUM = 4096
END = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def tokenised(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    """``(part, doc_id, source, before, n, ids)``: ids closed by ``END``, and the tokens of the same source before them in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, own, seen = (context.partitionId() if context else 0), encoder(vocabulary), {}
        for batch in batches:
            before, n, blobs = [], [], []
            sources = batch.column(1).to_pylist()
            for source, text in zip(sources, batch.column(2)):
                found = own.ids(text.as_py())
                ids = np.full(len(found) + 1, END, "<u4")
                ids[:-1] = found
                before.append(seen.get(source, 0))
                n.append(len(ids))
                seen[source] = before[-1] + len(ids)
                blobs.append((ids if ids.max() > 0xFFFF else ids.astype("<u2")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), batch.column(0), pa.array(sources, pa.string()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())],
                names=["part", "doc_id", "source", "before", "n", "ids"],
            )
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, source string, before long, n long, ids binary")


def serve(available: np.ndarray, deficit: np.ndarray, first: int, window: int, least: int) -> list[tuple[int, int, int, int]]:
    """Deficit round-robin until all queues are empty: ``(queue, from, tokens, position)`` in the order of the line.

    Each window adds to every queue's deficit its share of the window; queues are served in turn while
    their deficit allows ``least`` tokens, and what rounding leaves open goes to the largest deficits,
    which turn negative and are paid back in later windows. ``first`` is the position on the line, so
    that a window begun by the group before is filled up first.
    """
    left, taken, deficit = available.astype(np.int64), np.zeros(len(available), np.int64), deficit.astype(float).copy()
    share = left / max(1, left.sum())
    at, end, out = first, first + int(left.sum()), []
    while at < end:
        room = min(window - at % window, end - at)
        deficit += share * room
        whole = np.floor(deficit + 1e-9).astype(np.int64)
        give = np.where(whole >= np.minimum(least, left), np.minimum(np.maximum(whole, 0), left), 0)
        over = int(give.sum()) - room
        if over > 0:  # deficits carried so far exceed the room: the last in turn wait
            total = np.cumsum(give)
            give = np.clip(room - (total - give), 0, give)
        elif over < 0:
            for q in np.argsort(give - deficit, kind="stable"):
                more = min(int(left[q] - give[q]), -over, max(least, int(whole[q] - give[q])))
                if more > 0:
                    give[q] += more
                    over += more
                if not over:
                    break
            if over:  # only few queues are still open
                for q in np.argsort(give - left, kind="stable"):
                    more = min(int(left[q] - give[q]), -over)
                    give[q] += more
                    over += more
                    if not over:
                        break
        deficit -= give
        left -= give
        for q in np.flatnonzero(give):
            out.append((int(q), int(taken[q]), int(give[q]), at))
            at += int(give[q])
        taken += give
    return out


def _line(queues: DataFrame, targets: dict[str, float] | None) -> str:
    """SQL for the place on the line, from 0 to 1, of the share ``rel`` of a ``source``'s queue.

    Without targets all queues run out together, at the end. With them, each source sends by its target, all others by what is left
    over, until it runs out; then what it had goes to those that are still open, in proportion.
    """
    if not targets:
        return "rel"
    rest = 1.0 - sum(targets.values())
    if min(targets.values()) <= 0 or rest < -1e-9:
        raise ValueError("targets must be positive and sum up to 1 at most")
    named = F.when(F.col("source").isin(*targets), F.col("source"))
    totals = {r[0]: r[1] for r in queues.select("source", "queue").distinct().groupBy(named).agg(F.sum("queue")).collect()}  # a row for each target and one for all others
    rates = [(total, targets.get(source, max(rest, 1e-9))) for source, total in totals.items()]
    quoted = {source: "'" + source.replace("\\", "\\\\").replace("'", "\\'") + "'" for source in targets}
    ends = " ".join(f"when {quoted[source]} then {totals[source] / targets[source]!r}D" for source in totals if source is not None)
    last = f"{totals[None] / max(rest, 1e-9)!r}D" if None in totals else "0D"
    at = f"(rel * case source {ends} else {last} end)" if ends else f"(rel * {last})"
    return "(" + " + ".join(f"least({float(total)!r}D, {rate!r}D * {at})" for total, rate in rates) + f") / {float(sum(totals.values()))!r}D"


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, vocabulary: str = VOCABULARY,
    least: int = LEAST_PIECE, group_tokens: int = GROUP_TOKENS, with_ids: bool = False, targets: dict[str, float] | None = None, quantum: int = QUANTUM,
) -> DataFrame:
    """Packs every document into windows that hold the sources in target proportions.

    ``targets`` gives sources their shares of a window; the sources that it doesn't name divide the rest among them by their sizes.
    Without it, all do. A source that has run out leaves its share to the others, for every token is packed.

    Each source is a queue, in task order, cut into quanta of ``quantum`` tokens. A quantum's place on the line of all
    tokens follows from its number and the sources' totals alone, so quanta are dealt to groups of windows (``group_tokens``
    tokens of all sources, so never skewed) without packing what comes before. A group runs the
    round-robin over its windows; a source begins it with the deficit that its quanta so far leave, and a
    window that a group leaves half full is filled up by the next. Only the very last window can be short.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`` (with ``ids``,
    little-endian unsigned 32-bit, if asked). Null text counts as empty and packs as its closing token alone; null sources
    form one queue with ``""``; repeated rows are packed each; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    with scope() as keep:
        tokens = keep(written(tokenised(docs, id_col, text_col, source_col, vocabulary), "tokens", "zstd"))

        # A row per task and source.
        parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
        totals = F.sum("n").over(Window.partitionBy("source"))
        before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        queues = keep(written(parts.select("part", "source", totals.alias("queue"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("queue0")), "queues"))
        groups = max(1, -(-(parts.agg(F.sum("n")).first()[0] or 0) // group_tokens))

        phase = "(pmod(xxhash64(source), 65536) / 65536D)"  # so that rare sources don't meet in one group
        spread = (
            tokens.join(small(queues), ["part", "source"])
            .withColumn("at", F.expr("queue0 + before"))
            .withColumn("j", F.explode(F.expr(f"sequence(at div {quantum}, (at + n - 1) div {quantum})")))
            .withColumn("rel", F.expr(f"(j + {phase}) / ceil(queue / {quantum}D)"))
            .withColumn("x", F.expr(f"least({_line(queues, targets)} * {groups}, {groups - 1e-9!r}D)"))
            .withColumn("g", F.floor("x"))
            .withColumn("lo", F.expr(f"greatest(0, j * {quantum} - at)"))
            .withColumn("hi", F.expr(f"least(n, (j + 1) * {quantum} - at)"))
        )
        sizes = written(spread.groupBy("g").agg(F.sum(F.expr("hi - lo")).alias("size")), "sizes")
        firsts = keep(written(exclusive_prefix(sizes, "g", "size", "first").select("g", "first"), "groups"))
    slices = spread.select(
        "g", "source", (F.col("at") + F.col("lo")).alias("at"), "doc_id", F.col("n").alias("doc_tokens"), F.col("lo").alias("start"), (F.col("x") - F.col("g")).alias("due"), F.expr(f"{phase} * {quantum}").alias("carry"),
        F.expr("substring(ids, cast(lo * (octet_length(ids) div n) + 1 as int), cast((hi - lo) * (octet_length(ids) div n) as int))").alias("ids"), F.expr("cast(octet_length(ids) div n as int)").alias("width"),
    )
    columns = PIECES + (", ids binary" if with_ids else "")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "at", "doc_id"], kind="stable")
        out: list[tuple] = []
        streams, bounds, rows, deficit = [], [], [], []
        for _, own in pdf.groupby("source", sort=True):
            ids = [np.frombuffer(b, "<u2" if w == 2 else "<u4").astype("<u4") for b, w in zip(own["ids"], own["width"])]
            streams.append(memoryview(np.concatenate(ids)).cast("B"))
            bounds.append(np.cumsum([0, *map(len, ids)]))
            rows.append((own["doc_id"].tolist(), own["start"].tolist(), own["doc_tokens"].tolist(), own["source"].iloc[0]))
            # What the source should have sent when the group begins, less what it has: by how far into the group its first quantum is due.
            deficit.append(own["carry"].iloc[0] - own["due"].iloc[0] * bounds[-1][-1])
        for q, a, n, at in serve(np.array([b[-1] for b in bounds]), np.array(deficit), int(pdf["first"].iloc[0]), window, least):
            ends, (doc, start, size, source) = bounds[q], rows[q]
            k = int(np.searchsorted(ends, a, "right")) - 1
            stop = a + n
            while a < stop:
                b = min(stop, int(ends[k + 1]))
                if b > a:
                    raw = streams[q][4 * a : 4 * b]
                    out.append((doc[k], start[k] + a - int(ends[k]), b - a, zlib.crc32(raw), size[k], at // window, at % window, source) + ((bytes(raw),) if with_ids else ()))
                at, a, k = at + b - a, b, k + 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")]).astype({"doc_id": "Int64"})

    return slices.join(small(firsts), "g").groupBy("g").applyInPandas(group, columns)
