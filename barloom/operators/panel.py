"""Model inputs of whole symbols in numpy, for the models' passes over tables that no disk holds with all features spelled out.

Definitions are those of bars, labeling, zigzag, features and folds, and tests hold the two against each other. A chunk is some
whole symbols, one after the other; missing values are NaN. Only lines are dealt out, once; a chunk keeps a few small integers a bar.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.features import EMA_WINDOWS, LONG_EMAS, MARKET_FEATURES, NUMERIC_FEATURES, SHORT_EMAS, FeatureConfig
from barloom.operators.labeling import Barriers
from barloom.operators.zigzag import ZigZagConfig

#: Numeric features of a stock's own rows, in the models' order; the others belong to a day.
STOCK = tuple(c for c in NUMERIC_FEATURES if c not in MARKET_FEATURES)
STATES = ("bearish", "bullish", "mixed")
NO_STATE = 255
_CHUNK = 1 << 16
_NULL = -(2**31)
_FLOWS = ("bv", "bc", "sv", "sc", "bn", "sn")


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return len(out.getvalue()).to_bytes(8, "little") + pa.compress(out.getvalue(), "zstd", asbytes=True)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))) as z:
        return dict(z)


def small(a: np.ndarray) -> np.ndarray:
    for t in (np.int8, np.int16, np.int32):
        if not len(a) or (a.min() >= np.iinfo(t).min and a.max() <= np.iinfo(t).max):
            return a.astype(t)
    return a


def lines_by_day(lines: DataFrame) -> DataFrame:
    """What bars_from_lines and raw_flow sum up of a symbol's day, in one exchange by symbol; no sum's order matters."""
    q, flag, status = F.col("l_quantity").cast("long"), F.col("l_returnflag"), F.col("l_linestatus")
    kind = F.when(flag == "R", 1).when(flag == "A", 2).when((flag == "N") & (status == "O"), 3).when((flag == "N") & (status == "F"), 4).otherwise(0).cast("byte")
    t = lines.select(F.col("l_suppkey").alias("symbol"), F.unix_date(F.to_date("l_shipdate")).alias("d"), (F.round(F.col("l_discount") * 100.0).cast("int") - 5).alias("k"), q.alias("q"), F.round(F.col("l_tax") * 100.0).cast("int").alias("tx"), kind.alias("f"))
    volume = lambda n: F.greatest(F.sum(F.when(F.col("f") == n, F.col("q")).otherwise(0)), F.lit(1)).cast("long")
    count = lambda n: F.greatest(F.count_if(F.col("f") == n), F.lit(1)).cast("long")
    sums = [F.coalesce(F.sum(c).cast("long"), F.lit(_NULL).cast("long")).alias(name) for c, name in (("k", "k"), ("q", "vol"), ("tx", "tx"))]
    flows = [volume(1), count(1), volume(2), count(2), volume(3), volume(4)]
    return t.repartition("symbol").groupBy("symbol", "d").agg(*sums, *[x.alias(n) for x, n in zip(flows, _FLOWS)])


def chunks_of(batches):
    """Packed chunks of the rows of lines_by_day that a task has."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    none = t["symbol"].is_null().to_numpy()
    sym = t["symbol"].fill_null(0).to_numpy().astype(np.int64)
    col = {c: t[c].fill_null(_NULL).to_numpy().astype(np.int64) for c in ("d", "k", "vol", "tx", *_FLOWS)}
    order = np.lexsort((col["d"], sym, none))
    sym, none, col = sym[order], none[order], {c: v[order] for c, v in col.items()}
    first = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | (none[1:] != none[:-1])])
    size = np.diff(np.r_[first, len(sym)])
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + _CHUNK)))
        a, b = first[at], first[to] if to < len(first) else len(sym)
        yield {"sym": sym[first[at:to]], "none": none[first[at:to]], "size": size[at:to]} | {c: small(v[a:b]) for c, v in col.items()}
        at = to


class Panel:
    """A chunk's bars, spelled out: prices, then labels() and features()."""

    def __init__(self, c: dict[str, np.ndarray]):
        self.sym, self.none, size = c["sym"], c["none"], c["size"].astype(np.int64)
        self.size, self.n = size, int(size.sum())
        self.first = np.cumsum(size) - size
        self.start, self.end = np.repeat(self.first, size), np.repeat(self.first + size, size)
        self.idx = np.arange(self.n)
        self.pos, self.left = self.idx - self.start, self.end - self.idx - 1
        self.d = c["d"].astype(np.int64)
        self.flow = {f: c[f].astype(float) for f in _FLOWS}
        k, vol, tx = (c[x].astype(np.int64) for x in ("k", "vol", "tx"))
        known = k != _NULL
        run, seen = np.cumsum(np.where(known, k, 0)), np.cumsum(known)
        run, seen = run - np.repeat((run - np.where(known, k, 0))[self.first], size), seen - np.repeat((seen - known)[self.first], size)
        with np.errstate(all="ignore"):
            x = 1000.0 * np.exp(run / 100.0)
            self.c = np.where(seen > 0, np.where(x < 1e11, np.floor(x * 10000.0 + 0.5) / 10000.0, x), np.nan)
            was = self.lag(self.c)
            was = np.where(np.isnan(was), self.c, was)
            self.o = np.where(vol != _NULL, was * (1.0 + (np.fmod(vol, 5) - 2).astype(float) * 0.002), np.nan)
            t = np.where(tx != _NULL, tx.astype(float) * 0.001, np.nan)
            self.h, self.l = np.fmax(self.c, self.o) * (1.0 + t), np.fmin(self.c, self.o) * (1.0 - t)

    def lag(self, x, n=1):
        out = np.full(self.n, np.nan)
        out[n:] = x[:-n] if n < self.n else []
        out[self.pos < n] = np.nan
        return out

    def lead(self, x, n=1):
        out = np.full(self.n, np.nan)
        out[: max(0, self.n - n)] = x[n:]
        out[self.left < n] = np.nan
        return out

    def mean(self, x, size):
        total = self.lag(x, size - 1) + 0.0
        for n in range(size - 2, 0, -1):
            total += self.lag(x, n)
        return (total + x) / size

    def zscore(self, x, size):
        mean, m2 = np.zeros(self.n), np.zeros(self.n)
        for i, n in enumerate(range(size - 1, -1, -1), 1):
            delta = (self.lag(x, n) if n else x) - mean
            part = delta / i
            mean, m2 = mean + part, m2 + delta * (delta - part)
        dev = np.sqrt(m2 / size)
        return np.where(dev == 0, 0.0, (x - self.mean(x, size)) / np.where(dev == 0, 1.0, dev))

    def labels(self, p: Barriers = Barriers()) -> None:
        """ok: eligible_for_modeling; y: label; hold: holding_period_observations; ended: event_end_date."""
        good = lambda x: np.isfinite(x) & (x > 0)
        with np.errstate(all="ignore"):
            bad = ~(good(self.h) & good(self.l)) | (self.h < self.l)
            up, down, entry = self.c * (1.0 + p.upper), self.c * (1.0 + p.lower), good(self.c)
            hold, y, ok = np.full(self.n, p.horizon), np.zeros(self.n, np.int8), np.zeros(self.n, bool)
            open_ = self.idx[entry]
            for j in range(1, p.horizon + 1):
                open_ = open_[self.left[open_] >= j]
                at = open_ + j
                b, u, v = bad[at], self.h[at] >= up[open_], self.l[at] <= down[open_]
                hit = b | u | v
                i = open_[hit]
                ok[i], y[i], hold[i] = ~b[hit], ~v[hit], j
                open_ = open_[~hit]
            there = self.c[open_ + p.horizon]  # whole horizon, no hit
            ok[open_] = good(there)
            y[open_] = there / self.c[open_] - 1.0 > 0
        self.ok, self.y, self.hold = ok, y, hold
        self.ended = self.d[np.minimum(self.idx + hold, self.n - 1)]

    def _emas(self, spans: list[int]) -> dict[int, np.ndarray]:
        keep, gain = np.array([[1.0 - 2.0 / (s + 1.0)] for s in spans]), np.array([[2.0 / (s + 1.0)] for s in spans])
        order = np.argsort(-self.size, kind="stable")
        first, size = self.first[order], self.size[order]
        out, y = np.full((self.n, len(spans)), np.nan), np.full((len(spans), len(first)), np.nan)
        there = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # symbols with more than t bars
        for t, m in enumerate(there):
            at = first[:m] + t
            x, was = self.c[at], y[:, :m]
            now = keep * was + gain * x
            if np.isnan(now[0]).any():
                now = np.where(np.isnan(was), x, now)
            y[:, :m] = now
            out[at] = now.T
        seen = np.cumsum(~np.isnan(self.c))
        seen = seen - np.repeat((seen - ~np.isnan(self.c))[self.first], self.size)
        return {s: np.where(seen >= s, out[:, i], np.nan) for i, s in enumerate(spans)}

    def _pivots(self, v, high: bool, c: ZigZagConfig):
        v = np.where(np.isfinite(v), v, np.nan)
        s = v if high else -v
        near = lambda f, steps: f.reduce(list(steps))
        left, right = near(np.maximum, [self.lag(s, n) for n in range(1, c.half + 1)]), near(np.maximum, [self.lead(s, n) for n in range(1, c.half + 1)])
        after = near(np.fmax, [self.lead(s, n) for n in range(c.half + 1, c.confirm_after + 1)])
        known = np.minimum.accumulate(np.where(np.isnan(s), self.n, self.idx)[::-1])[::-1]
        far = self.idx + c.confirm_after
        sure = np.where(far < self.end, known[np.minimum(far, self.n - 1)], self.n)
        there = sure < self.end
        keep = (left <= s) & (s > right) & ~(after > s) & there
        i = np.flatnonzero(keep)
        i = i[~(s[sure[i]] > s[i])]
        return sure[i], i, np.full(len(i), high), v[i]

    def _zigzag(self, c: ZigZagConfig = ZigZagConfig()):
        """Prices of the last accepted high and low that are known at each bar."""
        confirm, pivot, high, price = (np.concatenate(x) for x in zip(self._pivots(self.h, True, c), self._pivots(self.l, False, c)))
        order = np.lexsort((high, pivot, confirm))
        confirm, high, price = confirm[order], high[order], price[order]
        of = np.searchsorted(self.first, confirm, side="right") - 1
        nth = np.arange(len(of)) - np.searchsorted(of, of, side="left")
        by = np.argsort(nth, kind="stable")
        ends = np.cumsum(np.bincount(nth)) if len(nth) else []
        h, l, up = (np.full(len(self.first), np.nan) for _ in range(3))
        hs, ls, at = np.empty(len(of)), np.empty(len(of)), 0
        for end in ends:
            e = by[at:end]
            s, p, is_high = of[e], price[e], high[e]
            last = np.where(up[s] == 1, h[s], l[s])
            more = np.where(is_high, p > last, p < last)
            far = (last > 0) & (np.abs(100.0 * (p - last) / np.where(last > 0, last, 1.0)) >= c.deviation_percent)
            take = np.isnan(up[s]) | np.where((up[s] == 1) == is_high, more, far)
            a, b = take & is_high, take & ~is_high
            h[s[a]], l[s[b]], up[s[take]] = p[a], p[b], is_high[take]
            hs[e], ls[e], at = h[s], l[s], end
        final = np.r_[confirm[1:] != confirm[:-1], True] if len(confirm) else np.zeros(0, bool)
        told = np.full(self.n, -1)
        told[confirm[final]] = np.flatnonzero(final)
        since = np.maximum.accumulate(np.where(told >= 0, self.idx, -1))
        state = np.where(since >= self.start, told[np.maximum(since, 0)], -1)
        take = lambda x: np.where(state >= 0, x[np.maximum(state, 0)], np.nan) if len(x) else np.full(self.n, np.nan)
        return take(hs), take(ls)

    def features(self, index_close: np.ndarray, c: FeatureConfig = FeatureConfig()) -> tuple[np.ndarray, np.ndarray]:
        """(one row for each of STOCK, number of gmma_state in STATES); index_close of each bar's day."""
        out = {}
        with np.errstate(all="ignore"):
            ratio = lambda a, b: np.where(np.isfinite(a) & np.isfinite(b) & (b > 0), a / b, np.nan)
            x, f = self.c, self.flow
            ema = self._emas([*dict.fromkeys([*EMA_WINDOWS, 12, 26])])
            out |= {f"ema_{n}_distance": ratio(x - ema[n], x) for n in EMA_WINDOWS}
            move = x - self.lag(x)
            up, down = (self.mean(np.where(np.isnan(move), np.nan, np.maximum(s * move, 0.0)), 14) for s in (1, -1))
            out["rsi_14_centered"] = (np.where(up + down > 0, 100.0 * up / (up + down), np.nan) - 50.0) / 50.0
            out["macd_relative"] = ratio(ema[12] - ema[26], x)
            short, long = np.array([ema[n] for n in SHORT_EMAS]), np.array([ema[n] for n in LONG_EMAS])
            state = np.where(short.min(0) > long.max(0), 1, np.where(short.max(0) < long.min(0), 0, 2)).astype(np.uint8)
            state[~(np.isfinite(short).all(0) & np.isfinite(long).all(0))] = NO_STATE
            out["log_power_of_buy"] = np.log((f["bv"] / f["bc"]) / (f["sv"] / f["sc"]))
            out["ho_buy_fraction"], out["ho_sell_fraction"] = f["bn"] / (f["bv"] + f["bn"]), f["sn"] / (f["sv"] + f["sn"])
            o, h, l = self.o, self.h, self.l
            fine = np.isfinite(o) & np.isfinite(h) & np.isfinite(l) & np.isfinite(x) & (h >= l) & (o >= l) & (o <= h) & (x >= l) & (x <= h)
            out["body_ratio"] = np.where(fine, np.where(h > l, (x - o) / np.where(h > l, h - l, 1.0), np.sign(np.where(np.isnan(move), 0.0, move))), np.nan)
            volume = f["bv"] + f["bn"]
            out["log_volume_ratio_30"] = np.log1p(ratio(volume, self.mean(volume, c.volume_window)))
            was = self.lag(x)
            out["x_relative_strength_zscore"] = z = self.zscore(ratio(x, index_close), c.zscore_window)
            out["y_return_zscore"] = self.zscore(np.where(was != 0, x / was - 1, np.nan), c.zscore_window)
            off = np.maximum.accumulate(np.where(z > 0, -1, self.idx))
            out["log_positive_rs_run_length"] = np.log1p((self.idx - np.maximum(off, self.start - 1)).astype(float))
            high, low = self._zigzag()
            fine = np.isfinite(x) & (x > 0)
            out["distance_above_confirmed_low_fraction"], out["distance_below_confirmed_high_fraction"] = np.where(fine, (x - low) / x, np.nan), np.where(fine, (high - x) / x, np.nan)
        values = np.array([out[n] for n in STOCK])
        unjoined = np.repeat(self.none, self.size)  # features are joined by symbol
        values[:, unjoined], state[unjoined] = np.nan, NO_STATE
        return values, state

    def members(self, folds: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(average_uniqueness of each fold's training rows, else NaN; the fold that an event validates, from 1, or 0).

        folds: last training day, first and last validation day. Needs labels().
        """
        out, valid = np.full((len(folds), self.n), np.nan), np.zeros(self.n, np.uint8)
        ok = self.ok & (self.d != _NULL)
        for k, (last, start, end) in enumerate(folds):
            valid[ok & (self.d >= start) & (self.d <= end)] = k + 1
            i = self.idx[ok & (self.d <= last) & (self.ended < start)]
            if len(i):
                e = i + self.hold[i] + 1
                at = np.cumsum(np.bincount(i, minlength=self.n + 1) - np.bincount(e, minlength=self.n + 1))[: self.n]
                run = np.r_[0.0, np.cumsum(np.where(at > 0, 1.0 / np.maximum(at, 1), 0.0))]
                out[k, i] = (run[e] - run[i]) / (e - i)
        return out, valid


def day_sums(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Of each day of a chunk: bars, sums and counts of prices, bars of symbol 7, events."""
    p = Panel(c)
    p.labels()
    days, of = np.unique(p.d, return_inverse=True)
    seven = np.repeat((p.sym == 7) & ~p.none, p.size)
    cols = {"day": days, "bars": np.bincount(of), "seven": np.bincount(of, seven), "events": np.bincount(of, p.ok)}
    for name, x in (("close", p.c), ("low", p.l), ("high", p.h)):
        there = ~np.isnan(x)
        cols |= {name: np.bincount(of, np.where(there, x, 0.0)), f"n_{name}": np.bincount(of, there)}
    return pa.RecordBatch.from_pydict({k: v.astype(float) if k in ("close", "low", "high") else v.astype(np.int64) for k, v in cols.items()})


DAY_SUMS = "day long, bars long, seven long, events long, close double, n_close long, low double, n_low long, high double, n_high long"
