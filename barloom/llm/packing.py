"""Packing of tokenised documents into sequences of fixed capacity: large-item matching, then best fit.

How full the sequences get depends on lengths alone, so the plan is made on the histogram of lengths, which has at most
`capacity` entries however many documents there are. Its result is a list of runs: `count` sequences alike, each with pieces
of given lengths at given offsets. Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace, map_batches, session_of, worker_cache

CAPACITY, END_ID = 4096, 1
#: The tokenizer's words, as its file has them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a worker remembers.
CACHE_WORDS = 700_000
#: Pieces of one length that one task ranks, about.
RANKED = 500_000


class _Ids:
    """Ids of texts, from the distinct words of the tokenizer in them, whose ids are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Bytes of Latin-1 that may be normalised or split otherwise than by lower-casing and white space.
        self.odd = bytes([*range(9), 11, 12, *range(14, 32), *range(127, 161), 173])
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        #: Whether words are SPLIT's and end in ids of their own kind; texts of other tokenizers are encoded whole.
        self.by_word = bool(suffix) and [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])] == [SPLIT, None]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.by_word:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_apart(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one text of them all: a call and an object for each cost more than its ids."""
        raw = self.ids([" ".join(words)])[0]
        at = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
        if len(at) != len(words) or at[-1:] != [len(raw)]:
            return self.ids(words)
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        known = self.known
        new = [w for w in words if w not in known]
        for k in range(0, len(new), 4096):
            known.update(zip(new[k : k + 4096], self.ids_apart(new[k : k + 4096])))
        out = list(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:  # what came first is mostly what is frequent; it stays
            for w in new:
                del known[w]
        return out

    def ids_of_plain(self, texts: list[str]) -> list[bytes]:
        """Texts are looked at as distinct chunks between white space, and these as distinct words."""
        import pyarrow as pa
        import pyarrow.compute as pc

        chunks, in_text, of_text = _distinct(pc.ascii_split_whitespace(pa.array(texts, pa.string())))
        words, in_chunk, of_chunk = _distinct(pc.ascii_split_whitespace(pc.replace_substring_regex(chunks, SPLIT, r"\0 ")))
        found = self.ids_of_words(words.to_pylist())
        bounds = np.cumsum([0, *map(len, found)]) // 4
        flat, bounds = _joined(np.frombuffer(b"".join(found), "<u4"), bounds, in_chunk, of_chunk)
        flat, bounds = _joined(flat, bounds, in_text, of_text)
        raw, at = flat.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def plain(self, text: str) -> bool:
        """Whether the tokenizer's normaliser only lower-cases the text and splits it at white space, so that chunks stand alone."""
        if not self.by_word:
            return False
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, self.odd)) == len(raw) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain(t) for t in texts]
        own, whole = iter(self.ids_of_plain([t.lower() for t, p in zip(texts, plain) if p])), iter(self.ids([t for t, p in zip(texts, plain) if not p]))
        return [next(own if p else whole) for p in plain]


def _distinct(rows) -> tuple:
    """The distinct values of an array of lists, the place of each value among them, and the bounds of each list."""
    found = rows.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), rows.offsets.to_numpy()


def _joined(flat: np.ndarray, bounds: np.ndarray, index: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of the parts flat[bounds[i] : bounds[i + 1]], i along index: their values one behind the other, and the bounds of each list."""
    counts = np.diff(bounds)[index]
    ends = np.cumsum(counts, dtype=np.int64)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1][index] - (ends - counts), counts)
    return flat[place], np.concatenate([[0], ends])[of]


def _pieces(path: str, capacity: int):
    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, end, step = worker_cache(f"ids:{path}", lambda: _Ids(path)), np.array([END_ID], "<u4").tobytes(), 4 * capacity

        def run(doc_ids: list, texts: list) -> tuple:
            out = []
            for doc_id, raw in zip(doc_ids, ids.encode([t or "" for t in texts])):
                raw += end
                for piece, start in enumerate(range(0, len(raw), step)):
                    part = raw[start : start + step]
                    out.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            return tuple(zip(*out)) if out else ((), (), (), (), ())

        return run

    return make


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(count, [(length, how many in each)])]: runs of equal sequences that hold all pieces of the histogram.

    Pieces longer than a third of the capacity come at most two to a sequence: the longest takes the longest that still fits.
    Then shorter ones, longest first, go where they leave the least room: a run of n equal gaps takes floor(gap / length) in
    each, just as placing them one by one would.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    sizes: list[int] = []

    def put(count: int, parts: list[tuple[int, int]], gap: int) -> None:
        if count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((count, parts))

    while large:
        n = large[-1]
        k = bisect.bisect_right(large, capacity - n) - 1
        if k < 0:
            put(left[n], [(n, 1)], capacity - n)
            large.pop()
            continue
        m = large[k]
        count = left[n] // 2 if m == n else min(left[n], left[m])
        if count:
            put(count, [(n, 2)] if m == n else [(n, 1), (m, 1)], capacity - n - m)
        left[n] -= count
        left[m] -= count
        if m == n and left[n] == 1:
            k2 = k - 1
            if k2 >= 0:
                put(1, [(n, 1), (large[k2], 1)], capacity - n - large[k2])
                left[large[k2]] -= 1
                if not left[large[k2]]:
                    large.pop(k2)
            else:
                put(1, [(n, 1)], capacity - n)
            left[n] = 0
        large = [x for x in large if left[x]] if not (left[n] and left[m]) else large
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        todo = left[n]
        while todo:
            k = bisect.bisect_left(sizes, n)
            if k == len(sizes):
                each = capacity // n
                full, rest = divmod(todo, each)
                put(full, [(n, each)], capacity - n * each)
                if rest:
                    put(1, [(n, rest)], capacity - n * rest)
                break
            gap = sizes[k]
            count, parts = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(k)
            each = gap // n
            full = min(count, todo // each)
            put(full, [*parts, (n, each)], gap - n * each)
            todo -= full * each
            if full < count:
                if todo:
                    put(1, [*parts, (n, todo)], gap - n * todo)
                    todo, full = 0, full + 1
                put(count - full, parts, gap)
    return [x for runs in gaps.values() for x in runs]


def _slots(runs: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, ...]]:
    """(length, low, high, count, sequence, offset): the piece of that length with low <= rank < high goes to sequence +
    (rank - low) % count, at offset + (rank - low) // count * length."""
    out, used, sequence = [], {}, 0
    for count, parts in runs:
        offset = 0
        for length, each in parts:
            low = used.get(length, 0)
            used[length] = low + count * each
            out.append((length, low, used[length], count, sequence, offset))
            offset += length * each
        sequence += count
    return out


def _slot_table(slots: list[tuple[int, ...]]):
    import pyarrow as pa

    names = ("slot_length", "low", "high", "count", "sequence", "at")
    return pa.table({n: pa.array([x[i] for x in slots], pa.int64()) for i, n in enumerate(names)})


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs(doc_id, text).

    A document is the tokenizer's ids of its text (null: empty), then id 1. Longer ones than capacity are cut into pieces of
    capacity, the last may be shorter; others are never cut. Pieces of a sequence lie one behind the other from offset 0. Null
    and repeated doc_ids are packed like any other; no rows give no pieces. tokenizer is the path of a tokenizer file that
    every executor has.
    """
    spark = session_of(docs)
    ws = Workspace(spark, "packing")
    pieces = ws.stash(map_batches(docs.select("doc_id", "text"), _pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    total = pieces.count()
    salts = max(8, total // RANKED)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = ws.stash(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity))
    stride = max(256, total >> 18)  # ranks that share a key of the join below, so that it has at most some 2**18 keys besides the slots
    table = spark.createDataFrame(_slot_table(slots))  # from rows, Spark would start Python workers for it
    table = table.withColumn("block", F.explode(F.sequence(F.expr(f"low div {stride}"), F.expr(f"(high - 1) div {stride}"))))
    before = counts.select("length", "salt", F.coalesce(F.expr("sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("nth", F.expr("row_number() over (partition by length, salt order by doc_id, piece, ids_crc32)") - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("before")).withColumn("key", F.expr(f"nth div {stride}"))
    placed = ranked.join(F.broadcast(table), (ranked.length == table.slot_length) & (ranked.key == table.block) & (ranked.nth >= table.low) & (ranked.nth < table.high))
    step = F.col("nth") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + step % F.col("count")).alias("sequence_id"), (F.col("at") + F.floor(step / F.col("count")) * F.col("length")).cast("long").alias("offset"))
