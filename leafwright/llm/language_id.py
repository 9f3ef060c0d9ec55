"""Language identification by multilingual mixtures.

Letter trigrams give each word a likelihood under every language; expectation-maximisation finds the
proportions in which a document mixes the languages, and a penalised likelihood says how many of
them it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, scope, small, written

#: Labelled documents per language that a model is fitted on at most.
TRAIN_DOCS = 600
UNDETERMINED = "und"
#: Letter classes of the trigram table: 0 bounds words, the last one stands for all rare letters.
CLASSES = 64
#: Words whose likelihoods a task keeps.
KNOWN = 300_000


@dataclass
class Model:
    """Log-likelihoods ``table[c1, c2, c3, language]`` of a letter after two others; ``classes`` by code point."""

    langs: list[str]
    classes: np.ndarray
    table: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """(word, language): the log-likelihood of each word's trigrams; zeros for words without a letter."""
        joined = "\0\0" + "\0\0".join(words) + "\0\0"
        c = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        one, two, three = c[:-2], c[1:-1], c[2:]
        rows = self.table[(np.where(two == 0, 0, one) * CLASSES + two) * CLASSES + three]
        rows[(two == 0) & (three == 0)] = 0
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        return np.add.reduceat(rows, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64).astype(np.float32)


def fit(texts: list[tuple[str, str]]) -> Model:
    """Fits a model to (language, text) pairs."""
    langs = sorted({lang for lang, _ in texts})
    seen: dict[str, int] = {}
    lowered = [(langs.index(lang), text.lower()) for lang, text in texts]
    for _, text in lowered:
        codes, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        for code, k in zip(codes.tolist(), n.tolist()):
            if chr(code).isalpha():
                seen[code] = seen.get(code, 0) + k
    classes = np.zeros(0x110000, np.uint8)
    classes[[i for i in range(0x110000) if chr(i).isalpha()]] = CLASSES - 1
    for rank, code in enumerate(sorted(seen, key=lambda k: (-seen[k], k))[: CLASSES - 2]):
        classes[code] = rank + 1
    counts = np.zeros((CLASSES**3, max(1, len(langs))))
    for lang, text in lowered:
        c = classes[np.frombuffer(("\0\0" + text + "\0").encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        one, two, three = c[:-2], c[1:-1], c[2:]
        keep = (two != 0) | (three != 0)
        at = ((np.where(two == 0, 0, one) * CLASSES + two) * CLASSES + three)[keep]
        counts[:, lang] += np.bincount(at, minlength=CLASSES**3)
    smooth = counts.reshape(CLASSES**2, CLASSES, -1) + 0.05
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).reshape(CLASSES**3, -1).astype(np.float32)
    return Model(langs, classes, table)


def mixtures(like: np.ndarray, lengths: np.ndarray, steps: int = 12, most: int = 3, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (document, language) of the chosen language sets, their sizes, and the log-likelihoods.

    ``like``: (word, language) log-likelihoods of all documents' words, ``lengths``: words of each document (none is 0).
    Sets grow by the languages' proportions in the full mixture while the log-likelihood gains more than
    ``penalty * log(words)`` a language. Where even the best language for every single word would gain less,
    one language is right and no mixture is computed.
    """
    docs, langs = len(lengths), like.shape[1]
    starts = np.cumsum(lengths) - lengths
    single = np.add.reduceat(like, starts, axis=0, dtype=np.float64)
    best, cost = single.max(axis=1), penalty * np.log(np.maximum(lengths, 2))
    share, size, value = np.eye(langs)[single.argmax(axis=1)], np.ones(docs, np.int64), best.copy()
    bound = np.add.reduceat(like.max(axis=1), starts, dtype=np.float64) - best
    hard = np.flatnonzero(bound > cost)
    if langs < 2 or not len(hard):
        return share, size, value
    rows = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in hard])
    n = lengths[hard]
    at, of = np.cumsum(n) - n, np.repeat(np.arange(len(hard)), n)
    top = like[rows].max(axis=1, keepdims=True)
    p = np.exp(like[rows] - top)
    base = np.add.reduceat(top[:, 0], at, dtype=np.float64)

    def em(mix: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(turns):
            joint = p * mix[of]
            joint /= joint.sum(axis=1, keepdims=True) + 1e-30
            mix = (np.add.reduceat(joint, at, axis=0) / n[:, None]).astype(np.float32)
        return mix, base + np.add.reduceat(np.log((p * mix[of]).sum(axis=1) + 1e-30), at, dtype=np.float64)

    full, _ = em(np.full((len(hard), langs), 1 / langs, np.float32), steps)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    score = value[hard].copy()
    for k in range(2, min(most, langs) + 1):
        mix = np.where(rank < k, np.maximum(full, 1e-4), 0)
        mix, ll = em((mix / mix.sum(axis=1, keepdims=True)).astype(np.float32), max(3, steps // 3))
        better = ll - cost[hard] * (k - 1) > score
        score[better] = (ll - cost[hard] * (k - 1))[better]
        share[hard[better]], size[hard[better]], value[hard[better]] = mix[better], k, ll[better]
    return share, size, value


_UNITS = 1 << 30


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS) -> Model:
    """Fits a model on at most ``per_lang`` labelled documents a language, those with the smallest hashes of their ids.

    Null languages, texts and ids aren't used; rows that repeat id, language and text count once. The sample is picked from ids alone;
    only the picked texts are read out. A table without labels gives a model that knows no language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(_UNITS)).alias("h"))
    # Hashes are even, so those below a threshold are some three times per_lang ids of each language, however many it has.
    with scope():
        counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
        near = ids.join(small(written(counts, "languages")), "lang").where(F.col("h") * F.col("n") < F.lit(3.0 * per_lang * _UNITS)).distinct()
        first = Window.partitionBy("lang").orderBy("h", "id")
        picked = written(near.withColumn("nr", F.row_number().over(first)).where(F.col("nr") <= per_lang).drop("nr"), "picked")  # per_lang rows a language
        texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(small(picked), ["id", "lang"])
        # An id may have several texts: each counts, up to per_lang in all.
        texts = texts.withColumn("code", F.xxhash64("text")).dropDuplicates(["lang", "h", "id", "code"])
        kept = texts.withColumn("nr", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "code"))).where(F.col("nr") <= per_lang)
        return fit(sorted((r.lang, r.text) for r in kept.select("lang", "text").toLocalIterator()))


class Predictor:
    """Predicts texts of one task; words are weighed once while among the last ``KNOWN``."""

    def __init__(self, model: Model, words_a_time: int = 200_000) -> None:
        self.model, self.words_a_time = model, words_a_time
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)), np.float32)

    def _settle(self, pending: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KNOWN:
            self.known.clear()
            self.rows = self.rows[:0]
        new = list(set().union(*pending).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.concatenate([self.rows, self.model.words(new)])
        lengths = np.fromiter(map(len, pending), np.int64, len(pending))
        codes = np.fromiter((self.known[w] for own in pending for w in own), np.int64, int(lengths.sum()))
        share, size, _ = mixtures(self.rows[codes], lengths)
        return share, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their proportions, and the sizes of the chosen sets."""
        langs, scores, sizes = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        at, pending, n = [], [], 0
        for i, text in enumerate(texts):
            if text and self.model.langs and next(filter(str.isalpha, text), None):
                at.append(i)
                pending.append(text.lower().split())
                n += len(pending[-1])
            if pending and (n > self.words_a_time or i == len(texts) - 1):
                for j, s, k in zip(at, *self._settle(pending)):
                    best = int(s.argmax())
                    langs[j], scores[j], sizes[j] = self.model.langs[best], min(1.0, float(s[best])), k
                at, pending, n = [], [], 0
        return langs, scores, sizes


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of every whole text from the text alone.

    Returns ``(id, lang_pred, score, n_langs)``: the language with the largest proportion of the chosen set, that
    proportion, and the set's size. ``und`` with score 0 if the text is null, holds no letter, or nothing was learned. One row
    out for each row in; ids may repeat or be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for batch in batches:
            langs, scores, sizes = predictor.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(sizes)], names=["id", "lang_pred", "score", "n_langs"])
        del predictor
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, n_langs int").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language can't be told: null texts, texts without a letter, and mixtures in which no language has ``least`` of the text.

    All columns stay as they are, whatever their names; rows may repeat. A model that knows no language rejects all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        for batch in batches:
            langs, scores, _ = predictor.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in zip(langs, scores)], pa.bool_()))
        del predictor
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose ``crc32(id as text) mod 3`` is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
