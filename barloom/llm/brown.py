"""Brown class-based n-gram language model: exchange clustering, class transitions, word emissions.

Every training word has a class of its own choice. The CORE most frequent words are clustered one by one on the driver, together
with ENDINGS groups of all other words by their ending, so the table on which that exchange works has a fixed size. Then each
other training word goes, in Spark, to the class that its own neighbours' classes speak for, by the same likelihood; its
ending's class only stands for it as a neighbour in that step, and for words that never occur in training. The class pairs are
counted anew with the final classes, over all training tokens, and the weights of the model are fitted to them, each pair left
out once. With P(w | class) and the unigram probability both proportional to count(w) + 1/2, a text's score splits into a sum
over its words of log10(count + 1/2) and a sum over its class pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.langid import held_out
from barloom.llm.words import hashed_words
from barloom.llm.work import Workspace, map_batches, session_of

CORE, ENDINGS, CLASSES, ROUNDS = 2048, 512, 64, 3
#: Weights of the class prior in a transition that are tried.
PRIORS = (0.5, 2.0, 5.0, 20.0, 100.0)
#: Training words that are sent to every executor, 13 bytes each; a larger vocabulary is joined by shuffle.
BROADCAST_WORDS = 6_000_000
_SLOTS = 2 * CLASSES + 1  # neighbours after a word, before it, and itself
_GROUP = ENDINGS - 1  # the low bits of a word's id name the group of its ending
_END_UNIT = CORE + ENDINGS
_MANY = _END_UNIT + 1
#: Id of the end, which is no word's but by chance.
END = 0x5DEECE66D1CE4E5B


def _found(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ids are in sorted_ids, and their places there."""
    if not len(sorted_ids):
        return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return sorted_ids[at] == ids, at


class _Tokens:
    """Tokens of a batch as codes: an end, and then each text's words and its end. Code 0 is the end, others are the distinct words.

    starts: the place of each text's first code. By code: ids, units (the place in the core, or CORE plus the group of the
    ending, or the end), counts n and classes. vocab: (words, n, classes) of training words outside the core, sorted by word.
    """

    def __init__(self, texts: list, core: _Core | None = None, vocab: tuple | None = None):
        hashes, ends, many = hashed_words(texts)
        words, at = np.unique(((hashes & ~np.uint64(_GROUP)) | (ends & np.uint64(_GROUP))).view(np.int64), return_inverse=True)
        self.ids = np.concatenate(([END], words))
        self.codes = np.zeros(1 + len(at) + len(texts), np.int64)
        self.codes[np.arange(1, 1 + len(at)) + np.repeat(np.arange(len(texts)), many)] = at + 1
        self.starts = np.cumsum(many + 1) - many
        if core:
            self.units = CORE + (self.ids & _GROUP)
            hit, at = _found(core.ids, self.ids)
            self.units[hit] = core.place[at[hit]]
            self.units[0] = _END_UNIT
            self.classes = core.cls[self.units]
        if vocab:
            self.n = np.zeros(len(self.ids), np.int64)
            known, n, classes = vocab
            hit, at = _found(known, self.ids)
            self.n[hit], self.classes[hit] = n[at[hit]], classes[at[hit]]


class _Core:
    """Ids of the core, sorted, with their places by frequency; the class of each unit."""

    def __init__(self, ids: np.ndarray, cls: np.ndarray | None = None):
        self.place = np.argsort(ids)
        self.ids, self.cls = ids[self.place], np.zeros(_MANY, np.int64) if cls is None else cls


def _count_words():
    def run(texts: list) -> tuple:
        t = _Tokens(texts)
        return t.ids, np.bincount(t.codes[1:], minlength=len(t.ids))

    return run


def _count_pairs(core: _Core):
    def make():
        def run(texts: list) -> tuple:
            t = _Tokens(texts, core)
            u = t.units[t.codes]
            return np.unique(u[:-1] * _MANY + u[1:], return_counts=True)

        return run

    return make


def exchange(pairs: np.ndarray, n: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit; the last unit, the end, has the last class to itself.

    pairs: first * units + second, n: their counts. Starts from units dealt out by frequency; then each unit in turn moves to
    the class that raises the sum of n(c, d) log n(c, d) - 2 n(c) log n(c), the bigram likelihood of the classes, the most.
    """
    units = CORE + ENDINGS + 1
    a, b = np.divmod(pairs, units)
    total = np.bincount(a, n, units)
    cls = np.empty(units, np.int64)
    order = np.argsort(-total, kind="stable")
    order = order[order != units - 1]
    cls[order] = np.arange(units - 1) % (classes - 1)
    cls[-1] = classes - 1
    f = lambda x: x * np.log(np.maximum(x, 1))

    def grouped(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = np.argsort(key, kind="stable")
        return np.searchsorted(key[s], np.arange(units + 1)), other[s], n[s].astype(float)

    (at_r, to, n_r), (at_l, fro, n_l) = grouped(a, b), grouped(b, a)
    table = np.bincount(cls[a] * classes + cls[b], n, classes * classes).reshape(classes, classes).astype(float)
    for _ in range(rounds):
        moved = 0
        for w in order:
            r, l = slice(at_r[w], at_r[w + 1]), slice(at_l[w], at_l[w + 1])
            self_n = n_r[r][to[r] == w].sum()
            right = np.bincount(cls[to[r]], n_r[r], classes)
            left = np.bincount(cls[fro[l]], n_l[l], classes)
            was = cls[w]
            right[was] -= self_n
            left[was] -= self_n
            if not right.any() and not left.any():
                continue
            table[was] -= right
            table[:, was] -= left
            table[was, was] -= self_n
            rows, cols = f(table + right).sum(1) - f(table).sum(1), f(table.T + left).sum(1) - f(table.T).sum(1)
            d = np.diagonal(table)
            corner = f(d + right + left + self_n) - f(d) - (f(d + right) - f(d)) - (f(d + left) - f(d))
            out, inn = table.sum(1), table.sum(0)
            size = right.sum() + self_n
            size_in = left.sum() + self_n
            gain = rows + cols + corner - (f(out + size) - f(out)) - (f(inn + size_in) - f(inn))
            gain[classes - 1] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9:
                best = was
            table[best] += right
            table[:, best] += left
            table[best, best] += self_n
            cls[w] = best
            moved += best != was
        if not moved:
            break
    return cls


def _near(core: _Core):
    """Classes beside each word outside the core: slot c for class c after it, CLASSES + c before it, 2 * CLASSES for itself after it."""

    def make():
        def run(texts: list) -> tuple:
            t = _Tokens(texts, core)
            codes = t.codes
            u = t.units[codes]
            at = np.flatnonzero((u >= CORE) & (u < _END_UNIT))
            same = np.append(codes[1:] == codes[:-1], False)  # whether a word stands before itself
            first = at[~same[at - 1]]
            c = t.classes[codes]
            key, n = np.unique(np.concatenate((codes[at] * _SLOTS + np.where(same[at], 2 * CLASSES, c[at + 1]), codes[first] * _SLOTS + CLASSES + c[first - 1])), return_counts=True)
            return t.ids[key // _SLOTS], key % _SLOTS, n

        return run

    return make


def _choose(table: np.ndarray):
    """The class of each word outside the core, and its count, from slot + 256 * n of its neighbours.

    table: class pairs of the core alone. A word goes where adding it raises the likelihood of exchange() the most.
    """

    def make():
        f = lambda x: x * np.log(np.maximum(x, 1))
        d, out, inn = np.diagonal(table), table.sum(1), table.sum(0)

        def run(words: list, near: list) -> tuple:
            many = len(words)
            i = np.repeat(np.arange(many), [len(x) for x in near])
            n, slot = np.divmod(np.fromiter((y for x in near for y in x), np.int64, len(i)), 256)

            def side(low: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Counts by class, and what they add to the likelihood for each class that the word could have; t: from that side's class."""
                own = (slot >= low) & (slot < low + CLASSES)
                k, c, x = i[own], slot[own] - low, n[own]
                each, at = np.unique(x * CLASSES + c, return_inverse=True)  # few: most counts are small
                x_each, c_each = np.divmod(each, CLASSES)
                gain = (f(t[c_each] + x_each[:, None]) - f(t)[c_each])[at]
                return np.bincount(k * CLASSES + c, x, many * CLASSES).reshape(many, CLASSES), np.add.reduceat(gain, np.searchsorted(k, np.arange(many)))

            # A word's last occurrence in a run of itself has another neighbour or the end, so both sides have an entry.
            (right, rows), (left, cols) = side(0, table.T), side(CLASSES, table)
            own = slot == 2 * CLASSES
            self_n = np.bincount(i[own], n[own], many)[:, None]
            corner = f(d + right + left + self_n) - f(d + right) - f(d + left) + f(d)
            size, size_in = right.sum(1, keepdims=True) + self_n, left.sum(1, keepdims=True) + self_n
            gain = rows + cols + corner - (f(out + size) - f(out)) - (f(inn + size_in) - f(inn))
            gain[:, CLASSES - 1] = -np.inf
            return words, size[:, 0].astype(np.int64), gain.argmax(1)

        return run

    return make


def _seen_by(vocab, seen: tuple) -> tuple:
    """What a batch knows of training words: the broadcast vocabulary, or its rows' own words from a join."""
    if vocab:
        return vocab.value
    words, n, classes = (np.fromiter(itertools.chain.from_iterable(x or () for x in column), np.int64) for column in seen)
    words, at = np.unique(words, return_index=True)
    return words, n[at], classes[at]


def _count_classes(core: _Core, vocab):
    def make():
        def run(texts: list, *seen: list) -> tuple:
            t = _Tokens(texts, core, _seen_by(vocab, seen))
            c = t.classes[t.codes]
            return np.unique(c[:-1] * CLASSES + c[1:], return_counts=True)

        return run

    return make


def _rare_words(core: _Core):
    """(row, word) of each row's distinct words outside the core."""

    def make():
        def run(rows: list, texts: list) -> tuple:
            t = _Tokens(texts, core)
            code, row = t.codes, np.repeat(np.arange(len(texts) + 1), np.diff(np.concatenate(([0], t.starts, [len(t.codes)]))))
            rare = (t.units[code] >= CORE) & (t.units[code] < _END_UNIT)
            row, code = np.divmod(np.unique(row[rare] * len(t.ids) + code[rare]), len(t.ids))
            return np.array(rows, np.int64)[row - 1], t.ids[code]

        return run

    return make


def _score(core: _Core, log_pair: np.ndarray, core_n: np.ndarray, vocab):
    """log_pair: log10 of what a class pair puts before count + 1/2; core_n: counts of core words and of the end."""

    def make():
        core_count = np.concatenate((core_n[:CORE], np.zeros(ENDINGS), core_n[CORE:]))

        def run(doc_ids: list, texts: list, out: list, *seen: list) -> tuple:
            t = _Tokens(texts, core, _seen_by(vocab, seen))
            n = np.where((t.units >= CORE) & (t.units < _END_UNIT), t.n, core_count[t.units])
            c, n, at = t.classes[t.codes], n[t.codes[1:]], t.starts - 1
            each = lambda x: np.add.reduceat(x, at) if len(at) else x[:0]
            return doc_ids, out, np.diff(np.append(at, len(n))), each((n > 0).astype(np.int64)), each(log_pair[c[:-1], c[1:]]), each(np.log10(n + 0.5))

        return run

    return make


def fit_weights(table: np.ndarray, prior: np.ndarray, mass: np.ndarray, whole: float) -> tuple[float, float]:
    """Weight of the class bigram against the unigram, and of the class prior in a transition.

    Those under which each of the counted class pairs is likeliest, from all others (one taken out at a time); of the prior's
    weights those of PRIORS are tried, the other comes from expectation and maximisation. mass: of each class, whole: of all.
    """
    some = table > 0
    n, best = table[some], (-math.inf, 0.95, PRIORS[0])
    if not len(n):
        return best[1:]
    for p in PRIORS:
        step = (table - 1 + p * prior) / np.maximum(table.sum(1, keepdims=True) - 1 + p, 1e-9)
        bigram, unigram, w = (step / np.maximum(mass, 0.5))[some], 1 / whole, 0.9
        for _ in range(30):
            share = w * bigram / (w * bigram + (1 - w) * unigram)
            w = min(0.999, max(0.001, float((n * share).sum() / n.sum())))
        best = max(best, (float((n * np.log(w * bigram + (1 - w) * unigram)).sum()), w, p))
    return best[1:]


def pair_logs(table: np.ndarray, mass: np.ndarray, whole: float, weight: float, prior_weight: float) -> np.ndarray:
    """log10, by class and next class, of the probability of the next word over its count + 1/2."""
    step = (table + prior_weight * mass / whole) / (table.sum(1, keepdims=True) + prior_weight)
    return np.log10(weight * step / np.maximum(mass, 0.5) + (1 - weight) / whole)


def class_model_scores(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row of docs(doc_id, text).

    Learns from rows whose crc32(doc_id) mod 5 is not 1 (a null doc_id is not held out, nor learned from); rows that share a
    doc_id or a text each count, and each is scored. Words are runs without ASCII white space, A-Z lower-cased; each text (null:
    empty) has one end token besides. base_score is the unigram log10 probability with 1/2 added to each count and one unknown
    word; score that of the interpolated class bigram, whose probabilities, with one unknown word for each ending, sum to 1.
    perplexity is 10 ** (-score / n_tokens). With nothing to learn from, every token is unknown, with base probability 1. Other
    columns are ignored, whatever their names; no rows, no result.
    """
    spark = session_of(docs)
    ws = Workspace(spark, "brown")
    out = held_out(F.col("doc_id"), 5, 1).alias("held_out")
    train = docs.filter(~out & F.col("doc_id").isNotNull()).select("text")
    counts = ws.stash(map_batches(train, _count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    top = counts.filter(F.col("word") != END).orderBy(F.desc("n"), "word").limit(CORE).collect()
    core, core_n = np.array([r.word for r in top], np.int64), np.zeros(CORE + 1)
    core_n[: len(top)] = [r.n for r in top]
    core_n[CORE] = size.ends
    pairs = map_batches(train, _count_pairs(_Core(core)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = pairs["pair"].to_numpy(), pairs["n"].to_numpy()
    del pairs
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    cls = exchange(pair, n)
    units = _Core(core, cls)
    first, second = np.divmod(pair, _MANY)
    inner = ((first < CORE) | (first == _END_UNIT)) & ((second < CORE) | (second == _END_UNIT))
    core_table = np.bincount(cls[first[inner]] * CLASSES + cls[second[inner]], n[inner], CLASSES * CLASSES).reshape(CLASSES, CLASSES).astype(float)
    near = map_batches(train, _near(units), "word long, slot long, n long").repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    near = near.groupBy("word").agg(F.sort_array(F.collect_list(F.col("n") * 256 + F.col("slot"))).alias("near"))
    seen = ws.stash(map_batches(near, _choose(core_table), "word long, n long, class int"))
    class_n, class_types = np.bincount(cls[np.r_[: len(core), _END_UNIT]], core_n[np.r_[: len(core), CORE]], CLASSES), np.bincount(cls[np.r_[: len(core), CORE:_MANY]], minlength=CLASSES).astype(float)
    for r in seen.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # the unknown word counts in each ending
        class_n[r["class"]] += r.n
        class_types[r["class"]] += r.words
    rows = docs.select("doc_id", "text", out)
    known: list[str] = []
    vocab = None
    if size.words <= broadcast_words:
        arrow = seen.toArrow()
        words, word_n, word_class = (arrow[c].to_numpy() for c in ("word", "n", "class"))
        del arrow
        order = np.argsort(words)
        vocab = spark.sparkContext.broadcast((words[order], word_n[order].astype(np.int32 if word_n.max(initial=0) < 2**31 else np.int64), word_class[order].astype(np.int8)))
    else:
        known = ["words", "ns", "classes"]
        rows = ws.stash(rows.withColumn("row", F.monotonically_increasing_id()))
        own = map_batches(rows.select("row", "text"), _rare_words(units), "row long, word long").join(seen, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "n", "class"))).alias("x"))
        rows = ws.stash(rows.join(own.select("row", *[F.col(f"x.{c}").alias(k) for c, k in zip(("word", "n", "class"), known)]), "row", "left"))
    learned = rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", *known)
    table = np.zeros(CLASSES * CLASSES)
    for r in map_batches(learned, _count_classes(units, vocab), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair] = r.n
    table = table.reshape(CLASSES, CLASSES)
    mass, whole = class_n + 0.5 * class_types, size.tokens + 0.5 * (size.words + ENDINGS + (not size.ends))
    weight, prior_weight = fit_weights(table, mass / whole, mass, whole)
    log_pair = pair_logs(table, mass, whole, weight, prior_weight)
    made = map_batches(rows.select("doc_id", "text", "held_out", *known), _score(units, log_pair, core_n, vocab), "doc_id long, held_out boolean, n_tokens long, n_known long, pair_sum double, word_sum double")
    unit = math.log10(size.tokens + 0.5 * (size.words + 1))
    score = F.col("word_sum") + F.col("pair_sum")
    return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size.tokens).cast("long").alias("train_tokens"), (F.col("word_sum") - unit * F.col("n_tokens")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
