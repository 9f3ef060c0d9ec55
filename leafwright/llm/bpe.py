"""Byte-pair encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes hits a pattern, so that passages shared by
documents are cut alike wherever they stand. A chunk's inside is encoded once and kept; what lies
around a join is encoded again, over a window that reaches to places where the encoding of the left and the
right can't depend on each other, and whose ids must agree with those of the pieces that it overlaps.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_of

VOCABULARY = "byte_bpe_50k"
#: A chunk has 2^BITS bytes on average; a task keeps so many distinct ones.
BITS, KEEP = 8, 60_000
#: Letters whose class every Unicode version agrees on; a text with any other letter goes to the `tokenizers` library itself.
_RARE = re.compile("[^\u0000-ɏ‐-‧‰-⁞€]")
#: White space after a character that is none: the encoding on either side can't depend on the other.
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?)\]}\"'À-ÖØ-öø-ɏ])[ \n]")


class Encoder:
    """Ids of texts as the `tokenizers` library gives them with ``<name>.json``, by a faster route where that is the same."""

    def __init__(self, name: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self.allowed = set(self.special)
        self.marks = tuple(self.special)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text.isascii() and _RARE.search(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the fast route's regex engine gives up on very long runs, with an exception of its own kind
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, as the library's ``decode(ids, skip_special_tokens=False)``."""
        return self.fast.decode_bytes(list(ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    return Encoder(name)


def cuts(data: bytes, bits: int = BITS) -> np.ndarray:
    """Byte offsets where chunks begin (without 0): those after which a hash of the eight bytes before hits a pattern.

    A hash of a sliding window depends on these bytes alone, so equal passages are cut alike. Offsets
    move on to the next character.
    """
    a = np.frombuffer(data, np.uint8)
    if len(a) < 16:
        return np.empty(0, np.int64)
    words = np.ndarray((len(a) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each offset on
    hashed = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    at = np.flatnonzero(hashed == 0) + 8
    at = at[at < len(a)]
    for _ in range(3):  # continuation bytes
        at = at + ((at < len(a)) & ((a[np.minimum(at, len(a) - 1)] & 0xC0) == 0x80))
    return np.unique(at[at < len(a)])


class Chunk(NamedTuple):
    """A chunk between its first and its last safe place: what stands before and after, the ids between, and the text and number of ids of the first and last piece of them."""

    head: str
    ids: np.ndarray
    tail: str
    first: str
    n_first: int
    last: str
    n_last: int


class ChunkedEncoder:
    """Encodes texts by chunks, each distinct one once while it stays among the ``keep`` last used."""

    def __init__(self, name: str = VOCABULARY, bits: int = BITS, keep: int = KEEP) -> None:
        self.base, self.bits, self.keep = encoder(name), bits, keep
        self.known: OrderedDict[bytes, Chunk | None] = OrderedDict()
        self.hits = self.misses = self.widened = 0

    def _chunk(self, raw: bytes) -> Chunk | None:
        """None if it has fewer than three safe places."""
        if raw in self.known:
            self.hits += 1
            self.known.move_to_end(raw)
            return self.known[raw]
        self.misses += 1
        text = raw.decode("utf-8")
        at = [m.start() for m in _SAFE.finditer(text)]
        got = None
        if len(at) >= 3:
            a, b, c, d = at[0], at[1], at[-2], at[-1]
            got = Chunk(text[:a], self.base.ids(text[a:d]), text[d:], text[a:b], len(self.base.ids(text[a:b])), text[c:d], len(self.base.ids(text[c:d])))
        self.known[raw] = got
        if len(self.known) > self.keep:
            self.known.popitem(last=False)
        return got

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text.

        What lies around a join is encoded again, from the last piece of the chunk before to the first one of the chunk after. Where the new ids
        agree with both pieces, they take the place of these; a chunk without safe places is taken in whole, and if they ever don't
        agree, the window grows to the whole text.
        """
        if any(m in text for m in self.base.marks):
            return self.base.ids(text)  # special tokens may span what is safe otherwise
        data = text.encode("utf-8")
        ends = [0, *cuts(data, self.bits).tolist(), len(data)]
        parts: list[np.ndarray] = []
        window, begin = "", np.empty(0, np.uint32)  # text to be encoded again, and the ids that it must begin with
        for a, b in zip(ends, ends[1:]):
            got = self._chunk(data[a:b])
            if got is None:
                window += data[a:b].decode("utf-8")
                continue
            new, head = self.base.ids(window + got.head + got.first), got.ids[: got.n_first]
            if not (np.array_equal(new[: len(begin)], begin) and np.array_equal(new[len(new) - len(head) :], head)):
                self.widened += 1
                return self.base.ids(text)
            parts += [new, got.ids[got.n_first : len(got.ids) - got.n_last]]
            window, begin = got.last + got.tail, got.ids[len(got.ids) - got.n_last :]
        parts.append(self.base.ids(window))
        return np.concatenate(parts)


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, bits: int = BITS, keep: int = KEEP, digests: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns ``(doc_id, n_tokens, ids binary of little-endian unsigned 32-bit integers, decoded)``, or with
    ``digests`` ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` so that ids needn't leave the task. Null text
    counts as empty, and an empty one has no ids. One row out for each row in; ids may repeat or be null.
    No shuffle: a task reuses the chunks of its own documents, of which at most ``keep`` stay in memory,
    so that a lost task is simply run again.
    """
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = ChunkedEncoder(vocabulary, bits, keep)
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(1):
                ids = chunked.ids(text.as_py())
                raw, decoded = ids.astype("<u4").tobytes(), chunked.base.fast.decode_bytes(ids.tolist())
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(raw).hexdigest() if digests else raw)
                decoded = decoded.decode("utf-8", "replace")
                out[2].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest() if digests else decoded)
            kinds = (pa.int64(), pa.string() if digests else pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names=[c.split()[0] for c in columns.split(", ")])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, columns)
