"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token as outside, begin or inside of a secret from the token's own shape, its
neighbours and features of the whole text, and is decoded by Viterbi. It is fitted here, on a bounded
sample of texts in which generated secrets are planted next to what the patterns find.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scope, text_of, written

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

_KEY = re.compile("passw|secret|token|api_?key|akia|auth|bearer|key|pwd|cred")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
#: Texts and planted secrets that the field is fitted on at most.
SAMPLE_TEXTS, PLANTED = 300, 2000
#: Tokens on each side of a planted or found secret that are learned from.
CONTEXT = 10
OUT, BEGIN, INSIDE = 0, 1, 2
#: Tokens whose shapes a task keeps.
KNOWN = 300_000
#: Characters of the shortest span that the field may add.
LEAST_CHARS = 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(token: str) -> tuple:
    """What the field sees of a token: length, characters used, how mixed they are, or which key word it is."""
    n = len(token)
    if not token[0].isalnum() and n == 1:
        return ("mark", token if token in "\"'=:.,;()[]{}<>@#$" else "")
    low = token.lower()
    if n <= 24 and (key := _KEY.search(low)):
        return ("word", key[0], n >= 16)
    if token.isalpha():
        kind = "low" if token.islower() else "title" if token[1:].islower() or n == 1 else "up" if token.isupper() else "mixed"
        return ("alpha", kind, min(n // 4, 7))
    digits = sum(c.isdigit() for c in token)
    changes = sum(a.isdigit() != b.isdigit() or (a.islower() and b.isupper()) for a, b in zip(token, token[1:]))
    return (
        "hex" if re.fullmatch("[0-9a-f]+", low) else "code", "all" if digits == n else "digits" if digits else "none",
        any(c.islower() for c in token), any(c.isupper() for c in token), any(c in "+/_-" for c in token), min(n // 4, 8), min(4 * changes // n, 3), min(int(_entropy(token)), 5),
    )


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values())


def features(kind: tuple) -> list[str]:
    """Indicator features of a shape: the whole of it, and each part beside its class."""
    return ["|".join(map(str, kind)), kind[0], *(f"{kind[0]}.{i}={x}" for i, x in enumerate(kind[1:]))]


PLAIN = ("alpha", "mark")


def text_features(odd: int, n: int) -> list[str]:
    """Features of the whole text: the share of tokens that are no plain words or marks, and how many tokens there are."""
    return [f"whole:codes={min(5, int(10 * odd / max(1, n)))}", f"whole:length={min(6, int(math.log10(n + 1) * 2))}"]


@dataclass
class Field:
    """Weights of a fitted field: ``own``, ``before``, ``before2``, ``after`` by feature and tag, ``whole`` by text feature; ``step[a, b]`` from tag to tag."""

    weights: dict[str, np.ndarray]
    step: np.ndarray

    def roles(self, kind: tuple) -> np.ndarray:
        """(4, 3): what a token of this shape adds to its own tag, the next token's, the one after's, and the previous one's."""
        return np.array([sum((self.weights.get(f"{role}{f}", 0.0) for f in features(kind)), np.zeros(3)) for role in ("own:", "before:", "before2:", "after:")])

    def whole(self, odd: int, n: int) -> np.ndarray:
        """(3,): what the whole text adds to each tag of all its tokens."""
        return sum((self.weights.get(f, 0.0) for f in text_features(odd, n)), np.zeros(3))


def viterbi(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best tags of many sequences at once; ``scores`` are (token, tag), all sequences after each other.

    Every sequence begins and ends beside an outside token. All sequences advance together, longest first.
    """
    tags = np.zeros(len(scores), np.int8)
    if not len(lengths):
        return tags
    order = np.argsort(-lengths, kind="stable")
    starts, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    back = np.zeros((len(scores), 3), np.int8)
    best = step[OUT] + scores[starts]
    ends = np.zeros((len(n), 3))
    for t in range(1, int(n[0]) + 1):
        live = int(np.searchsorted(-n, -t, "left"))  # sequences longer than t
        ends[live : len(best)] = best[live:]
        best = best[:live]
        if not live:
            break
        paths = best[:, :, None] + step[None]
        at = starts[:live] + t
        back[at] = paths.argmax(axis=1)
        best = paths.max(axis=1) + scores[at]
    now = (ends + step[:, OUT]).argmax(axis=1).astype(np.int8)
    for t in range(int(n[0]) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, "left"))
        at = starts[:live] + t
        tags[at] = now[:live]
        now[:live] = back[at, now[:live]] if t else now[:live]
    return tags


def _planted(texts: list[str], rng: random.Random, most: int) -> list[tuple[list[str], list[int]]]:
    """Token sequences around planted secrets, look-alikes and plain passages, with tags."""
    letters, alnum, b64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    text_of_ = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    names = ("password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "auth_token", "client_secret", "access_key", "private_key", "pwd", "Authorization: Bearer")
    out = []
    words = [w for t in texts for w in t.split()] or ["text"]
    for _ in range(most):
        kind = rng.randrange(13)
        at = rng.randrange(len(words))
        left, right = words[max(0, at - CONTEXT) : at], words[at : at + CONTEXT]
        if kind < 3:
            value = text_of_(rng.choice((alnum, b64)), rng.randrange(16, 44))
            quote = rng.choice(("", '"', "'"))
            middle, before = value, f"{rng.choice(names)}{rng.choice((' = ', '=', ': ', ':', ' '))}{quote}"
            after = quote
        elif kind == 3:
            middle, before, after = "AKIA" + text_of_(alnum[:26] + alnum[52:], 16), "", rng.choice(("", ".", ","))
        elif kind == 4:
            middle, before, after = text_of_("0123456789abcdef", rng.choice((16, 24, 32, 40, 64))), rng.choice(("", "key ", "hash ")), ""
        elif kind == 5:
            middle, before, after = text_of_(b64, rng.randrange(24, 48)), "", rng.choice(("", "="))
        elif kind == 6:  # of several tokens: three parts with full stops
            middle, before, after = ".".join(text_of_(b64, rng.randrange(*size)) for size in ((12, 30), (20, 50), (20, 44))), rng.choice(("", "Bearer ", f"{rng.choice(names)}=")), ""
        elif kind == 7:  # with marks among letters and digits
            value = text_of_(alnum, 1) + text_of_(alnum + "$!@%^*~?#&" * 2, rng.randrange(10, 22)) + text_of_(alnum, 1)
            quote = rng.choice(("", '"', "'"))
            middle, before, after = value, f"{rng.choice(names)}{rng.choice((' = ', '=', ': ', ':', ' '))}{quote}", quote
        elif kind == 8:  # over several lines, or parts with colons
            middle, before, after = rng.choice(("\n", ":")).join(text_of_(b64, rng.randrange(16, 48)) for _ in range(rng.randrange(2, 4))), rng.choice(("", f"{rng.choice(names)}: ")), ""
        else:  # what looks like one and isn't
            middle = ""
            before = rng.choice((
                "", text_of_(letters, rng.randrange(12, 34)), text_of_("0123456789", rng.randrange(4, 15)), f"{text_of_(letters, 6)}@{text_of_(letters, 8)}.com",
                f"https://www.{text_of_(letters, 7)}.org/{text_of_(letters, 5)}/{text_of_('0123456789', 5)}", f"+{text_of_('0123456789', 2)} {text_of_('0123456789', 9)}", f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}",
                text_of_(letters, 5).upper() + "-" + text_of_("0123456789", 4), f"{text_of_(letters, 7)}_{text_of_(letters, 9)}", f"{text_of_(letters, 6)}-{text_of_(letters, 9)}-{text_of_(letters, 7)}", "the password is short",
                f"{text_of_(letters, 5)}.{text_of_(letters, 8)}.{text_of_(letters, 3)}", f"v{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(9)}", f"${rng.randrange(1, 90)},{rng.randrange(100, 999)}.{rng.randrange(10, 99)}", f"{text_of_(letters, 4)}!!! {text_of_(letters, 3)}?!", f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}",
                f"({text_of_(letters, 4)}: {text_of_(letters, 6)}; {text_of_(letters, 5)})", f"{text_of_(letters, 6)} & {text_of_(letters, 6)} = {rng.randrange(100)}%", "token: yes", rng.choice(names),
            ))
            after = ""
        tokens, tags = [], []
        for part, secret in ((" ".join(left) + " " + before, False), (middle, True), (after + " " + " ".join(right), False)):
            own = TOKEN.findall(part)
            tokens += own
            tags += [(BEGIN if i == 0 else INSIDE) if secret else OUT for i in range(len(own))]
        text = " ".join(tokens)
        if not middle and (HEX.search(text) or ASSIGN.search(text)):
            continue
        out.append((tokens, tags))
    return out


def fit(texts: list[str], planted: int = PLANTED, turns: int = 40, seed: int = 7, decay: float = 1e-3) -> Field:
    """Maximum-likelihood fit by gradient ascent with adaptive steps; likelihoods by the forward-backward recursion."""
    rng = random.Random(seed)
    data = [(k, t) for k, t in _planted(texts, rng, planted) if k]
    names: dict[str, int] = {}
    rows, gold, lengths = [], [], []
    for tokens, tags in data:
        kinds = [features(shape(t)) for t in tokens]
        # As if in a text twenty times as long, for the windows are short.
        whole = text_features(sum(shape(t)[0] not in PLAIN for t in tokens), 20 * len(tokens))
        for i in range(len(tokens)):
            own = [f"own:{f}" for f in kinds[i]] + whole
            own += [f"before:{f}" for f in kinds[i - 1]] if i else []
            own += [f"before2:{f}" for f in kinds[i - 2]] if i > 1 else []
            own += [f"after:{f}" for f in kinds[i + 1]] if i + 1 < len(tokens) else []
            rows.append([names.setdefault(f, len(names)) for f in own])
        gold += tags
        lengths.append(len(tokens))
    wide, n = max(map(len, rows)), np.array(lengths)
    ids = np.full((len(rows), wide), len(names))
    for i, r in enumerate(rows):
        ids[i, : len(r)] = r
    y, order = np.array(gold), np.argsort(-n, kind="stable")
    starts, n = (np.cumsum(n) - n)[order], n[order]
    w, step = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    seen_w, seen_s = np.full_like(w, 1e-6), np.full_like(step, 1e-6)
    ahead = np.concatenate([starts[n > t] + t for t in range(1, int(n[0]))])
    gold_step = np.zeros((3, 3))
    np.add.at(gold_step, (y[ahead - 1], y[ahead]), 1)
    for _ in range(turns):
        e = w[ids].sum(axis=1)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[starts] = e[starts] + step[OUT]
        live = [int((n > t).sum()) for t in range(int(n[0]))]
        for t in range(1, int(n[0])):
            at = starts[: live[t]] + t
            alpha[at] = e[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + step[None], axis=1)
        beta[starts + n - 1] = step[:, OUT]
        for t in range(int(n[0]) - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            beta[at] = np.logaddexp.reduce(step[None] + (e[at + 1] + beta[at + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(alpha + beta, axis=1)
        p = np.exp(alpha + beta - total[:, None])
        pair = np.exp(alpha[ahead - 1][:, :, None] + step[None] + (e[ahead] + beta[ahead])[:, None, :] - total[ahead][:, None, None])
        off = -p
        off[np.arange(len(y)), y] += 1
        gain = np.stack([np.bincount(ids.ravel(), np.repeat(off[:, k], wide), minlength=len(names) + 1) for k in range(3)], axis=1) - decay * len(y) * w / 100
        gain[-1] = 0
        gain_s = gold_step - pair.sum(axis=0)
        gain_s[OUT] += np.bincount(y[starts], minlength=3) - p[starts].sum(axis=0)
        last = starts + n - 1
        gain_s[:, OUT] += np.bincount(y[last], minlength=3) - p[last].sum(axis=0)
        seen_w += gain**2
        seen_s += gain_s**2
        w += 0.3 * gain / np.sqrt(seen_w)
        step += 0.3 * gain_s / np.sqrt(seen_s)
    step[OUT, INSIDE] = min(step[OUT, INSIDE], step[OUT].min() - 6)  # a secret begins before it goes on
    return Field({f: w[i] for f, i in names.items()}, step)


_UNITS = 1 << 30


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS) -> Field:
    """Fits a field on at most ``texts`` distinct texts, those with the smallest hashes of id and text.

    A threshold on the hashes leaves some three times as many rows, so neither tasks nor the driver see more, and only the
    picked texts are read out.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    near = rows.where(F.pmod("h", F.lit(_UNITS)) * F.lit(docs.count()) < F.lit(3.0 * texts * _UNITS))
    with scope():
        picked = written(near.select("h").distinct().orderBy(F.pmod("h", F.lit(_UNITS)), "h").limit(texts), "picked")
        sample = near.join(F.broadcast(picked), "h", "left_semi").dropDuplicates(["h"]).collect()
    return fit([r.text for r in sorted(sample, key=lambda r: r.h)])


def scan_texts(texts: list[str], field: Field, known: dict[str, int], kinds: dict[tuple, int], roles: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans in each text: base ones, and the field's where they reach beyond these."""
    found = [base_spans(t) for t in texts]
    step = field.step
    # What a run of tags other than outside can gain at most through its steps: at both ends together, and from each token to the next.
    ends = max(step[OUT, y] + step[z, OUT] for y in (BEGIN, INSIDE) for z in (BEGIN, INSIDE)) - step[OUT, OUT]
    inner = max(0.0, step[1:, 1:].max() - step[OUT, OUT])
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        if not tokens:
            continue
        for t in set(tokens).difference(known):
            kind = shape(t)
            if kind not in kinds:
                kinds[kind] = len(kinds)
                roles.append(field.roles(kind))
            known[t] = kinds[kind]
        table = np.array(roles)
        codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        odd = int(np.array([k[0] not in PLAIN for k in kinds])[codes].sum())
        scores = table[codes, 0] + field.whole(odd, len(tokens))
        scores[1:] += table[codes[:-1], 1]
        scores[2:] += table[codes[:-2], 2]
        scores[:-1] += table[codes[1:], 3]
        # Where no run that holds a token can gain anything, by the best sums of gains up to it and from it on, Viterbi says outside.
        sums = np.cumsum(scores[:, 1:].max(axis=1) - scores[:, OUT] + inner)
        before = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
        doubt = np.flatnonzero(np.maximum.accumulate(sums[::-1])[::-1] - before + ends - inner > -1e-6)
        if not len(doubt):
            continue
        cut = np.flatnonzero(np.diff(doubt) > 1)
        a, b = doubt[np.concatenate([[0], cut + 1])], doubt[np.concatenate([cut, [len(doubt) - 1]])] + 1
        tags = np.zeros(len(tokens), np.int8)
        tags[doubt] = viterbi(scores[doubt], b - a, step)
        if not tags.any():
            continue
        found[i] = sorted(found[i] + _spans(text, tags, found[i]))
    return found


def _spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of tagged tokens that may be secrets and don't lie within base ones; tokens go on with a span if nothing, or one line end, parts them."""
    own: list[list[int]] = []
    last = -2
    for k, m in enumerate(TOKEN.finditer(text)):
        if not tags[k]:
            continue
        if tags[k] == INSIDE and last == k - 1 and (m.start() == own[-1][1] or text[own[-1][1] : m.start()] == "\n"):
            own[-1][1] = m.end()
        else:
            own.append([m.start(), m.end()])
        last = k
    covered = np.zeros(len(text) + 1, bool)
    for a, _, b in base:
        covered[a:b] = True
    return [(a, 3, b) for a, b in own if _looks(text[a:b]) and not covered[a:b].all()]


def _looks(span: str) -> bool:
    """Whether a span may be a secret at all: long, and no plain words, numbers or marks."""
    inner = "".join(c for c in span if c.isalnum())
    if len(span) < LEAST_CHARS or inner.isdigit():
        return False
    if inner.isalpha():  # letters alone change case within as words don't
        return sum(a.islower() and b.isupper() for a, b in zip(span, span[1:])) >= 3
    return len(inner) >= LEAST_CHARS // 2


SCHEMA = "id {id}, n_assign long, n_access long, n_hex long, spans array<struct<start:int,kind:string,end:int>>"


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets in every whole text.

    Returns ``(id, n_assign, n_access, n_hex, spans)``; spans are by start, then kind in the order of ``KINDS``, in code points
    with the end exclusive. Null and empty texts have none. One row out for each row in; ids may repeat or be null, other columns aren't read. No
    shuffle; a task keeps the shapes of about KNOWN tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        kinds: dict[tuple, int] = {}
        roles: list[np.ndarray] = []
        kind_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            if len(known) > KNOWN:
                known.clear()
            spans = scan_texts(batch.column(1).to_pylist(), field, known, kinds, roles)
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in spans], pa.int64()) for kind in range(3)]
            listed = pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in s] for s in spans], kind_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, listed], names=["id", "n_assign", "n_access", "n_hex", "spans"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(id=dict(rows.dtypes)["id"])).withColumnRenamed("id", id_col)


def listing(spans: str, base_only: bool = False):
    """Spans as ``kind:start:end``, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"] != "crf") if base_only else F.col(spans)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


MASK = "[SECRET]"


def redacted(text: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    """The text with each span, or run of overlapping spans, replaced by ``mask``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced by ``MASK``; null texts stay null and all other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        kinds: dict[tuple, int] = {}
        roles: list[np.ndarray] = []
        for batch in batches:
            if len(known) > KNOWN:
                known.clear()
            k = batch.schema.get_field_index(text_col)
            texts = batch.column(k).to_pylist()
            spans = scan_texts([t or "" for t in texts], field, known, kinds, roles)
            new = [t if not s else redacted(t, [(a, b) for a, _, b in s]) for t, s in zip(texts, spans)]
            yield batch.set_column(k, text_col, pa.array(new, pa.string()))
        release()

    return docs.mapInArrow(run, docs.schema)
