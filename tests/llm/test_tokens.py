import hashlib
import random
import zlib

import numpy as np
import pytest

from leafwright.llm import bpe, packing

SCHEMA = "doc_id long, text string, source string, n string, ids int"
TRICKY = ["", "a", " ", "  b", "x" * 5000, " " * 3000, "a<|endoftext|>b " * 40, "日本語 " * 90, "it's  we'll\n\n\tgo \x1c \x85 on", "é" * 300, "one two three four five. " * 200]


def _random_texts(n, seed=2):
    r = random.Random(seed)
    return ["".join(r.choice("ab c'  \n\t.,éß0١\x1c s'tsد日") for _ in range(r.randrange(900))) for _ in range(n)]


def test_chunked_ids_are_the_whole_texts(spark):
    chunked = bpe.ChunkedEncoder(bits=5, keep=50)
    for text in TRICKY + _random_texts(150):
        ids = chunked.base.slow.encode(text, add_special_tokens=False).ids
        assert chunked.ids(text).tolist() == ids
        assert chunked.base.decode(ids) == chunked.base.slow.decode(ids, skip_special_tokens=False)
    assert len(chunked.known) <= 50 and chunked.misses


def test_equal_passages_are_cut_alike():
    r = random.Random(4)
    passage = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(400)).encode()
    a, b = bpe.cuts(passage, 5), bpe.cuts(b"another beginning " + passage, 5)
    assert set(a + 18) <= set(b) and len(a) > 10
    chunked = bpe.ChunkedEncoder(bits=6)
    chunked.ids(passage.decode())
    misses = chunked.misses
    chunked.ids("new start " + passage.decode())
    assert chunked.misses - misses <= 3


def test_encode_decode_rows(spark):
    df = spark.createDataFrame([(i, x, None, "clash", 7) for i, x in enumerate([*TRICKY, None])] + [(None, "a", "s", None, None)] * 2, SCHEMA)
    slow = bpe.encoder().slow
    rows = bpe.encode_decode(df).collect()
    assert len(rows) == len(TRICKY) + 3
    for r in rows:
        text = TRICKY[r.doc_id] if r.doc_id is not None and r.doc_id < len(TRICKY) else ("a" if r.doc_id is None else "")
        ids = np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids), ids.tobytes(), slow.decode(ids.tolist(), skip_special_tokens=False))
    digest = {r.doc_id: r for r in bpe.encode_decode(df, digests=True).collect()}
    assert digest[1].decoded_sha256 == hashlib.sha256(b"a").hexdigest()
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_round_robin_keeps_proportions_and_carries_deficits():
    sizes = np.array([7000, 1500, 700, 33, 1])
    out = packing.serve(sizes, np.zeros(5), 300, 1024, 64)
    at, sent = 300, np.zeros(5, int)
    for q, a, n, position in out:
        assert position == at and a == sent[q] and n > 0 and at // 1024 == (at + n - 1) // 1024
        sent[q] += n
        at += n
        if at % 1024 == 0:
            assert np.abs(sent - sizes / sizes.sum() * (at - 300)).max() <= 130
    assert (sent == sizes).all()


@pytest.mark.parametrize("group", [2048, 1 << 20])
def test_packing_places_every_token_once(spark, group):
    texts = _random_texts(60) + TRICKY
    rows = [(i, x, ["a", "b", None][i % 3 if i % 5 else 0], "x", 1) for i, x in enumerate(texts)] + [(900, None, "b", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = packing.pack(df, group_tokens=group).toPandas()
    slow = bpe.encoder().slow
    for doc_id, own in got.sort_values("start").groupby("doc_id"):
        text = texts[doc_id] if doc_id < len(texts) else ""
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in own.itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert got.doc_id.nunique() == len(rows)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.sequence_id * 1024 + ordered.offset == ordered.length.cumsum() - ordered.length).all()
    assert ((ordered.offset + ordered.length) <= 1024).all()


def test_packing_nothing_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text", "a", None, None)] * 3, SCHEMA)
    assert packing.pack(df).count() >= 3
    assert packing.pack(df.limit(0)).count() == 0


def test_rare_sources_are_not_cut_to_crumbs(spark):
    texts = [(i, "some words of text " * 120, f"s{i % 49}", "x", 1) for i in range(300)] + [(900, "one lone short document of a rare source", "rare", "x", 1)]
    got = packing.pack(spark.createDataFrame(texts, SCHEMA).repartition(3), group_tokens=4096, quantum=512).toPandas()
    assert (got.doc_id == 900).sum() <= 2 and got.length.sum() == got.drop_duplicates("doc_id").doc_tokens.sum()
    # Pieces of a document: as many as windows give it a share, not as groups there are.
    assert len(got) <= 1.3 * (got.length.sum() / packing.LEAST_PIECE)


def test_windows_meet_given_targets(spark):
    rows = [(i, "word " * 250, "big" if i % 10 else "small", "x", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = packing.pack(df, group_tokens=16_384, targets={"small": 0.4}, quantum=128).toPandas()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.sequence_id * 1024 + ordered.offset == ordered.length.cumsum() - ordered.length).all()
    total = {s: int(x) for s, x in got.groupby("source").length.sum().items()}
    filled = total["small"] / 0.4 / 1024  # windows until the small source has run out
    share = got[got.source == "small"].groupby("sequence_id").length.sum() / 1024
    early = share.reindex(range(int(filled * 0.8)), fill_value=0.0)
    assert len(early) >= 15 and abs(early.mean() - 0.4) < 0.05 and early.min() > 0.2
    assert share.reindex(range(int(filled * 1.3) + 2, int(got.sequence_id.max()))).fillna(0).max() < 0.05
    with pytest.raises(ValueError):
        packing.pack(df, targets={"small": 0.7, "big": 0.6})
    quoted = spark.createDataFrame([(1, "a b", "it's", "x", 1), (2, "c", None, "x", 1)], SCHEMA)
    assert packing.pack(quoted, targets={"it's": 0.5, "absent": 0.2}).count() == 2
    assert packing.pack(quoted, targets={"it's": 0.5, "": 0.5}).count() == 2
