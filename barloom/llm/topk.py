"""Exact top-k by inner product on a bit-sliced index.

Vectors are quantised to integers. A block of vectors is stored as bit slices: for each component and each bit, a bitmap over
the block's rows. A query's scores come as bit slices too: every set bit of the query's component adds the component's
slices, shifted, and the bitmaps of one weight are summed with carry-save adders. The top rows are then read off from the
most significant slice downward; rows that tie at the boundary are resolved by id, and their scores computed exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.work import Workspace, map_batches, session_of

SCALE, K = 256, 5
#: Vectors of an index block, and queries of a query block at least and at most: what one task holds at a time. The index is
#: copied once for each query block, so these get as large as leaves PAIRS pairs of blocks to deal out.
BLOCK, QUERY_BLOCK, PAIRS = 16_384, (512, 8192), 4096
_U = np.uint64
_INDEX = "block long, dim int, rows binary, ids binary, low binary, values binary, bits binary, slices binary"


def _pack(rows: np.ndarray) -> np.ndarray:
    """(slices, rows) of bits -> (slices, words)."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return np.ascontiguousarray(packed).view(_U)


def slice_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integers (rows, components): the least of each component, its number of bits above that, and all slices, one after the other."""
    low = values.min(axis=0)
    above = (values.view(_U) - low.view(_U)).T  # up to 64 bits
    bits = np.array([int(x).bit_length() for x in above.max(axis=1)])
    return low, bits, _pack(np.concatenate([((above[d] >> np.arange(bits[d], dtype=_U)[:, None]) & _U(1)).astype(np.uint8) for d in range(len(bits)) if bits[d]] or [np.zeros((0, len(values)), np.uint8)]))


def _add(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sum of bitmaps of one weight: the bitmap of that weight and those carried to the next."""
    carried = []
    while len(rows) > 2:
        m = len(rows) // 3
        a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
        t = a ^ b
        carried.append((a & b) | (t & c))
        rows = np.concatenate((t ^ c, rows[3 * m :]))
    if len(rows) == 2:
        carried.append((rows[0] & rows[1])[None])
        rows = (rows[0] ^ rows[1])[None]
    return rows[0], carried


def score_slices(query: np.ndarray, low: np.ndarray, bits: np.ndarray, both: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the scores, least significant first, and what to add to them. both: all slices and then their complements."""
    n = len(both) // 2
    extra, by_weight = 0, {}
    for d in np.flatnonzero(query):
        q = int(query[d])
        extra += q * int(low[d])
        if q < 0:  # -|q| x = |q| (top - x) - |q| top, and top - x is the complement of x
            extra -= -q * ((1 << int(bits[d])) - 1)
        at, p = first[d] + (n if q < 0 else 0), 0
        q = abs(q)
        while q >> p:
            if q >> p & 1:
                for b in range(bits[d]):
                    by_weight.setdefault(p + b, []).append(at + b)
            p += 1
    out, carried, w = [], [], 0
    while by_weight or carried:
        rows = [both[by_weight.pop(w)]] if w in by_weight else []
        rows += carried
        total, carried = _add(np.concatenate(rows)) if rows else (np.zeros(both.shape[1], _U), [])
        out.append(total)
        w += 1
    return out, extra


def top_rows(slices: list[np.ndarray], eligible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the top k, and of those that tie at the boundary."""
    sure, tied = np.zeros_like(eligible), eligible
    have = 0
    for s in reversed(slices):
        ones = tied & s
        more = int(np.bitwise_count(ones).sum())
        if have + more > k:
            tied = ones
        else:
            sure, tied, have = sure | ones, tied & ~s, have + more
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _build():
    def run(blocks: list, dims: list, rows: list, ids: list, vectors: list) -> tuple:
        out = []
        for block, dim, r, i, v in zip(blocks, dims, rows, ids, vectors):
            values, r, i = np.array(v, np.int64).reshape(-1, dim), np.array(r, np.int64), np.array(i, np.int64)
            order = np.lexsort((r, i))
            values, r, i = np.ascontiguousarray(values[order]), r[order], i[order]
            low, bits, slices = slice_block(values)
            out.append((block, dim, r.tobytes(), i.tobytes(), low.tobytes(), values.tobytes(), bits.tobytes(), slices.tobytes()))
        return tuple(zip(*out)) if out else ((),) * 8

    return run


_LONG = 2**63 - 1


def _scores(values: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products; beyond the range of a long, its ends."""
    if np.abs(values.astype(float)).max(initial=0) * np.abs(query.astype(float)).sum() < 2.0**62:
        return (values @ query).tolist()
    return [max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(v, query.tolist())))) for v in values.tolist()]


def _search(k: int):
    def make():
        def run(dims: list, all_rows: list, ids: list, lows: list, values: list, all_bits: list, all_slices: list, query_rows: list, query_ids: list, queries: list) -> tuple:
            found: list[tuple[int, int, int, int]] = []
            for dim, r, i, low, v, bits, slices, qr, qi, q in zip(dims, all_rows, ids, lows, values, all_bits, all_slices, query_rows, query_ids, queries):
                r, i, low, bits = np.frombuffer(r, np.int64), np.frombuffer(i, np.int64), np.frombuffer(low, np.int64), np.frombuffer(bits, np.int64)
                v = np.frombuffer(v, np.int64).reshape(-1, dim)
                words = -(-len(i) // 64)
                s = np.frombuffer(slices, _U).reshape(-1, words)
                both, first = np.concatenate((s, ~s)), np.concatenate(([0], np.cumsum(bits)))[:-1]
                every = _pack(np.ones((1, len(i)), np.uint8))[0]
                by_row = np.argsort(r)
                for query_row, query_id, query in zip(qr, qi, np.array(q, np.int64).reshape(len(qi), dim)):
                    eligible, own = every, np.searchsorted(r, query_row, sorter=by_row)
                    if own < len(r) and r[by_row[own]] == query_row:
                        eligible, own = every.copy(), by_row[own]
                        eligible[own >> 6] &= ~(_U(1) << _U(own & 63))
                    sums, _ = score_slices(query, low, bits, both, first)
                    sure, tied = top_rows(sums, eligible, k)
                    sure = _rows(sure)
                    best = np.concatenate((sure, _rows(tied)[: k - len(sure)]))  # rows are in the order of ids
                    found.extend(zip([query_row] * len(best), [query_id] * len(best), i[best].tolist(), _scores(v[best], query)))
            return tuple(zip(*found)) if found else ((), (), (), ())

        return run

    return make


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) that is_query holds for, the k rows of highest score.

    Components become floor(scale * x), beyond the range of a long its ends; the score is the integer inner product with every
    other row of equal length, ties to the smaller vec_id, all of them if fewer than k. Scores beyond that range are told as its
    ends too, and which of several such rows come first is open. Rows that share a vec_id or a vector are rows of their own: each is a candidate, also for the other, and each that is a query has its k
    rows. Null, empty, or with null or non-finite components, a vector takes no part, nor does a null vec_id. Other columns
    are ignored; no rows, no result.
    """
    spark = session_of(vectors)
    ws = Workspace(spark, "topk")
    scaled = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024)))  # noqa: E731  1024: to the next double below
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & fine)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("embedding", scaled).alias("v"), is_query(F.col("vec_id")).alias("is_query"))
    rows = ws.stash(rows.withColumn("dim", F.size("v")))
    n, queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK))
    query_blocks = max(1, -(-queries // QUERY_BLOCK[1]), min(-(-queries // QUERY_BLOCK[0]), PAIRS // blocks))
    dealt = lambda df, many, seed: df.groupBy(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(many)).alias("block"), "dim").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("x")).select("block", "dim", F.col("x.row").alias("rows"), F.col("x.vec_id").alias("ids"), F.flatten("x.v").alias("v"))
    index = ws.stash(map_batches(dealt(rows, blocks, 1), _build, _INDEX))
    asked = dealt(rows.filter("is_query"), query_blocks, 2).select(F.col("block").alias("query_block"), F.col("dim").alias("query_dim"), F.col("rows").alias("query_rows"), F.col("ids").alias("query_ids"), F.col("v").alias("queries"))
    spread = index.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    pairs = spread.join(asked, ["query_block"]).filter("dim = query_dim").repartition(max(8, min(blocks * query_blocks, 10 * PAIRS)), "block", "query_block")
    found = map_batches(pairs.select("dim", "rows", "ids", "low", "values", "bits", "slices", "query_rows", "query_ids", "queries"), _search(k), "query_row long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_row order by score desc, vec_id)").cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
