"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, a gated attention network, learned from document labels alone, weighs
the passages, and a logistic layer scores the weighted sum of their encodings.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.langid import held_out
from barloom.llm.words import CACHE_WORDS
from barloom.llm.work import map_batches, session_of

#: Words of a passage; buckets of hashed words; width of encoding and attention.
PASSAGE, BUCKETS, WIDTH = 80, 96, 24
#: Labelled documents that the model is fitted on, about; they are drawn by a hash over all of them.
TRAIN_ROWS = 4000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4

#: Class of each byte: lower, upper, digit, stop, comma, quote, bracket, dash, bar or slash, other signs, space, control, UTF-8 lead and rest.
_CLASS = np.full(256, 9, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:", b"'\"`", b"()[]{}<>", b"-_=+~", b"|/\\")):
    _CLASS[list(_chars)] = _k
_CLASS[32] = 10
_CLASS[list(range(32))] = 11
_CLASS[192:] = 12
_CLASS[128:192] = 13
_SHAPES, _MORE = 14, 9
FEATURES = _SHAPES + _MORE + BUCKETS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = b = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def passages(text: str | None, cache: _Buckets) -> np.ndarray:
    """(passages, FEATURES): shares of kinds of characters, shapes of words, hashed words; an empty text is one empty passage."""
    words = (text or "").split()
    rows = np.zeros((max(1, -(-len(words) // PASSAGE)), FEATURES), np.float32)
    if not words:
        return rows
    lines = text.count("\n") + 1
    whole = [np.log1p(len(words)), np.log1p(len(words) / lines), len(set(words)) / len(words)]
    for row, k in zip(rows, range(0, len(words), PASSAGE)):
        part = words[k : k + PASSAGE]
        raw = np.frombuffer(" ".join(part).encode("utf-8", "surrogatepass"), np.uint8)
        row[:_SHAPES] = np.bincount(_CLASS[raw], minlength=_SHAPES) / len(raw)
        size, kinds = np.array([len(w) for w in part]), len(set(part))
        row[_SHAPES : _SHAPES + _MORE] = [*whole, size.mean(), size.std(), (size <= 2).mean(), (size > 12).mean(), kinds / len(part), sum(not w[-1].isalnum() for w in part) / len(part)]
        row[_SHAPES + _MORE :] = np.sqrt(np.bincount([cache[w] for w in part], minlength=BUCKETS) / len(part))
    return rows


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    enc: np.ndarray  # FEATURES + 1, WIDTH
    tan: np.ndarray  # WIDTH, WIDTH
    gate: np.ndarray
    att: np.ndarray  # WIDTH
    out: np.ndarray  # WIDTH + 1

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """starts: place of each document's first passage."""
        x = np.concatenate(((x - self.mean) * self.scale, np.ones((len(x), 1), np.float32)), axis=1)
        h = np.maximum(x @ self.enc, 0)
        t, g = np.tanh(h @ self.tan), 1 / (1 + np.exp(-(h @ self.gate)))
        e = (t * g) @ self.att
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.out[:-1] + self.out[-1], -30, 30)))
        return x, h, t, g, a, sizes, z, p

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        return self.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1])[-1].astype(float)


_LEARNED = ("enc", "tan", "gate", "att", "out")


def _gradients(m: Model, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    x, h, t, g, a, sizes, z, p = m.forward(x, starts)
    d = (p - y) / len(y)
    dz = d[:, None] * m.out[:-1]
    dzr = np.repeat(dz, sizes, axis=0)
    da = (dzr * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dt, dg = de[:, None] * m.att * g * (1 - t * t), de[:, None] * m.att * t * g * (1 - g)
    dh = (a[:, None] * dzr + dt @ m.tan.T + dg @ m.gate.T) * (h > 0)
    return {"enc": x.T @ dh, "tan": h.T @ dt, "gate": h.T @ dg, "att": (t * g).T @ de, "out": np.append(z.T @ d, d.sum())}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Model:
    """Adam on the log loss of document labels; without documents, a model that gives every text the same score."""
    r = np.random.default_rng(seed)
    weights = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    prior = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    m = Model(every.mean(0), (1 / (every.std(0) + 1e-2)).astype(np.float32), weights(FEATURES + 1, WIDTH), weights(WIDTH, WIDTH), weights(WIDTH, WIDTH), weights(WIDTH), np.append(weights(WIDTH) * 0.1, np.log(prior / (1 - prior))).astype(np.float32))
    first, second, step = {k: 0.0 for k in _LEARNED}, {k: 0.0 for k in _LEARNED}, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(bags))
        for k in range(0, len(bags), BATCH):
            own = order[k : k + BATCH]
            part = [bags[i] for i in own]
            step += 1
            for name, grad in _gradients(m, np.concatenate(part), np.cumsum([0, *map(len, part)])[:-1], y[own]).items():
                w = getattr(m, name)
                grad = grad + DECAY * w
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                setattr(m, name, (w - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    assert all(np.isfinite(getattr(m, f.name)).all() for f in fields(m))
    return m


def _encode():
    cache = _Buckets()

    def run(texts: list, labels: list) -> tuple:
        return [passages(t, cache).tobytes() for t in texts], labels

    return run


def _apply(model: Model):
    def make():
        cache = _Buckets()

        def run(doc_ids: list, texts: list, out: list) -> tuple:
            score = model.score([passages(t, cache) for t in texts])
            return doc_ids, out, score, (score >= 0.5).astype(int)

        return run

    return make


def learn_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model from labels(doc_id, quality 0 or 1; other values, nulls and contradictions teach nothing) of docs(doc_id, text)."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other")).filter("y = other").select("doc_id", "y")
    n = known.count()
    share = min(1.0, train_rows / max(1, n))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = map_batches(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "y"), _encode, "bag binary, y int").collect()
    rows = sorted(rows, key=lambda r: (bytes(r.bag), r.y))
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.y for r in rows], np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text), from its whole text alone.

    Labels are learned only from ids whose crc32 mod 3 is not 1; held_out tells the others. score: probability of label 1; predicted
    is 1 from 0.5 on. Null and empty texts are scored as one empty passage; a null doc_id is not held out; no rows, no result.
    """
    session_of(docs)
    held = held_out(F.col("doc_id"), 3, 1) if out is None else out
    model = learn_quality(docs, labels.filter(~held_out(F.col("doc_id"), 3, 1)), train_rows)
    return map_batches(docs.select("doc_id", "text", held), _apply(model), "doc_id long, held_out boolean, score double, predicted int")
