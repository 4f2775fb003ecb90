"""Operators on small hand-made inputs, and causal operators on prefixes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions import exprs as X
from barloom.operators import backtest as T
from barloom.operators import bars as B
from barloom.operators import breadth as R
from barloom.operators import expect as E
from barloom.operators import folds as K
from barloom.operators import governance as G
from barloom.operators import labeling as L
from barloom.operators import metrics as M
from barloom.operators import policy as S
from barloom.operators import zigzag as Z
from barloom.operators.sequence import exponential_means, run_length

DAY = dt.date(2021, 1, 1)
BAR = "symbol long, d date, pos int, adj_open double, adj_high double, adj_low double, adj_last_price double"


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def series(spark, rows, symbol: int = 1):
    """rows: (open, high, low, close) or None for a missing bar's prices."""
    return spark.createDataFrame([(symbol, day(i), i, *(map(float, r) if r else (None,) * 4)) for i, r in enumerate(rows)], BAR)


def test_scalar_functions(spark):
    t = spark.createDataFrame([("20210105", "1.5"), (" 2021-01-05 ", "x"), ("bad", None), (None, "NaN")], "d string, x string")
    assert [(r.d, r.x) for r in t.select(X.market_date("d").alias("d"), X.number("x").alias("x")).collect()] == [(day(4), 1.5), (day(4), None), (None, None), (None, None)]
    r = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (None, 1.0)], "a double, b double")
    assert [x.q for x in r.select(X.ratio("a", "b").alias("q")).collect()] == [0.5, None, None, None]
    assert r.select(X.ratio("a", "b", positive=False).alias("q")).collect()[2].q == -0.5
    names = spark.createDataFrame([("file:/x/a_unseen_test.csv",), ("/y/b.csv",)], "p string").select(X.stem("p", ("_unseen_test",)).alias("s"))
    assert [n.s for n in names.collect()] == ["a", "b"]
    assert X.first_existing(["A", "vol"], ["Vol", "a"]) == "vol"


def test_exponential_means_with_gaps(spark):
    xs = [1.0, None, 3.0, 4.0, None, None, 7.0]
    t = spark.createDataFrame([(1, day(i), x) for i, x in enumerate(xs)], "symbol long, d date, x double")
    got = [r.y for r in exponential_means(t, [("x", "y", 3, 2)], by=["symbol"]).orderBy("d").collect()]
    y, gap, seen, want = None, 0, 0, []
    for x in xs:
        if x is None:
            gap += y is not None
        else:
            old = 0.5 ** (gap + 1)
            y, gap, seen = (x if y is None else (old * y + 0.5 * x) / (old + 0.5)), 0, seen + 1
        want.append(y if seen >= 2 else None)
    assert got == pytest.approx(want)


def test_run_length(spark):
    t = spark.createDataFrame([(1, day(i), x) for i, x in enumerate([1.0, 2.0, None, 3.0, -1.0, 4.0, 5.0])], "symbol long, d date, x double")
    assert [r.n for r in run_length(t, "x", "n").orderBy("d").collect()] == [1, 2, 0, 1, 0, 1, 2]


def brute_label(rows, i, p):
    e = rows[i][3] if rows[i] else None
    if not e or e <= 0:
        return "invalid_entry_price", None
    for j in range(i + 1, min(i + p.horizon, len(rows) - 1) + 1):
        if rows[j] is None or rows[j][1] < rows[j][2]:
            return "invalid_monitoring_price", None
        if rows[j][2] <= e * (1 + p.lower):
            return "labeled", 0
        if rows[j][1] >= e * (1 + p.upper):
            return "labeled", 1
    if len(rows) - 1 - i < p.horizon:
        return "right_censored", None
    return "labeled", int(rows[i + p.horizon][3] > e)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows, c = [], 100.0
    for _ in range(80):
        o, c = c, c * (1 + r.uniform(-0.06, 0.06))
        rows.append(None if r.random() < 0.04 else (o, max(o, c) * (1 + r.uniform(0, 0.03)), min(o, c) * (1 - r.uniform(0, 0.03)), c))
    p = L.Barriers("t", 0.05, -0.05, 6)
    got = [(x.label_status, x.label) for x in L.triple_barrier(series(spark, rows), p).orderBy("pos").collect()]
    assert got == [brute_label(rows, i, p) for i in range(len(rows))]


def test_double_touch_is_lower(spark):
    x = L.triple_barrier(series(spark, [(100, 101, 99, 100), (100, 130, 70, 100)])).orderBy("pos").first()
    assert (x.label, x.barrier_touched, x.same_bar_double_touch, x.event_return) == (0, "lower", True, -0.15)


def brute_zigzag(highs, lows, closes, c):
    n, h, events = len(highs), c.half, []
    for up, v in ((True, highs), (False, lows)):
        s = 1 if up else -1
        for i in range(h, n):
            if v[i] is None or i + h >= n or any(v[j] is None for j in (*range(i - h, i), *range(i + 1, i + h + 1))):
                continue
            if any(s * v[j] > s * v[i] for j in range(i - h, i)) or any(s * v[j] >= s * v[i] for j in range(i + 1, i + h + 1)):
                continue
            j = next((k for k in range(i + c.confirm_after, n) if v[k] is not None), None)
            if j is None or any(v[k] is not None and s * v[k] > s * v[i] for k in range(i + h + 1, j + 1)):
                continue
            events.append((j, i, up, v[i]))
    events.sort()
    taken, out, k = [], [], 0
    for t in range(n):
        while k < len(events) and events[k][0] <= t:
            e = events[k]
            k += 1
            if not taken:
                taken.append(e)
            elif taken[-1][2] == e[2]:
                if (e[3] > taken[-1][3]) if e[2] else (e[3] < taken[-1][3]):
                    taken[-1] = e
            elif taken[-1][3] > 0 and abs(100 * (e[3] - taken[-1][3]) / taken[-1][3]) >= c.deviation_percent:
                taken.append(e)
        out.append(tuple(next((e[3] for e in reversed(taken) if e[2] == up), None) for up in (True, False)))
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_zigzag_against_brute_force_with_gaps(spark, seed):
    r = random.Random(seed)
    rows, c = [], 100.0
    for _ in range(300):
        o, c = c, round(c * (1 + r.choice([-0.05, -0.03, 0, 0.03, 0.05])), 1)
        rows.append((o, max(o, c), min(o, c), c) if r.random() > 0.01 else None)
    got = [(x.confirmed_high, x.confirmed_low) for x in Z.zigzag_state(series(spark, rows)).orderBy("pos").collect()]
    assert got == brute_zigzag([x and x[1] for x in rows], [x and x[2] for x in rows], None, Z.ZigZagConfig())


def test_fold_boundaries():
    counts = [0, 5, 1, 9, 2, 2, 8, 1, 1, 6]
    ends = K.balanced_ends(counts, 3)
    assert ends[-1] == 9 and ends == sorted(set(ends))
    total, best = sum(counts), []
    run = [sum(counts[: i + 1]) for i in range(10)]
    best.append(min((i for i in range(0, 8) if run[i] > 0 and total - run[i] >= 2), key=lambda i: (abs(run[i] - total / 3), i)))
    best.append(min((i for i in range(best[0] + 1, 9) if run[i] > run[best[0]] and total - run[i] >= 1), key=lambda i: (abs(run[i] - 2 * total / 3), i)))
    assert ends[:2] == best
    with pytest.raises(ValueError):
        K.balanced_ends([1, 0], 3)


def test_uniqueness_against_expansion(spark):
    r = random.Random(9)
    bars = series(spark, [(1, 1, 1, 1)] * 30)
    iv = [(s, min(29, s + r.randint(0, 6))) for s in sorted(r.sample(range(30), 12))]
    ev = spark.createDataFrame([(str(i), 1, day(s), day(e)) for i, (s, e) in enumerate(iv)], "event_id string, symbol long, d date, event_end_date date")
    got = {x.event_id: x.average_uniqueness for x in K.average_uniqueness(ev, bars).collect()}
    for i, (s, e) in enumerate(iv):
        want = sum(1 / sum(a <= t <= b for a, b in iv) for t in range(s, e + 1)) / (e - s + 1)
        assert got[str(i)] == pytest.approx(want)


def test_classification_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1)]
    m = M.classification_metrics(spark.createDataFrame([(float(p), y) for p, y in rows], "p double, label int")).first()
    pairs = [(a, b) for a, y in rows for b, z in rows if y and not z]
    assert m.roc_auc == pytest.approx(sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs))
    assert m.average_precision == pytest.approx((1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 6))
    assert (m.tp, m.fp, m.tn, m.fn) == (2, 1, 2, 1)


def test_top_fraction_ties(spark):
    rows = [("B::1", "B", 0.9, DAY), ("A::1", "A", 0.9, DAY), ("C::1", "C", 0.8, DAY), ("A::2", "A", 0.7, day(1))]
    t = S.daily_top_fraction(spark.createDataFrame(rows, "event_id string, symbol string, score double, d date"))
    assert {r.event_id for r in t.filter("selected").collect()} == {"A::1", "A::2"}


def test_filter_before_rerank(spark):
    rows = [("a", "A", 0.99, 0), ("b", "B", 0.9, 1), ("c", "C", 0.8, 1)]
    t = spark.createDataFrame([(e, s, p, DAY, st) for e, s, p, st in rows], "event_id string, symbol string, score double, d date, started int")
    out = S.daily_top_fraction(t.filter("started <> 0"), fraction=0.5).orderBy("daily_rank").collect()
    assert [(r.event_id, r.daily_rank, r.selected) for r in out] == [("b", 1, True), ("c", 2, False)]


def test_breadth_counts_and_prefix(spark):
    rows = [(s, day(i), i, p, p, p, p) for s, ps in ((1, [100, 110, 120.0]), (2, [100, 90, 95.0]), (3, [100, 100, 90.0])) for i, p in enumerate(map(float, ps))]
    t = spark.createDataFrame(rows, BAR)
    c = R.BreadthConfig(span=2, min_periods=1, slope_lag=1)
    full = R.market_breadth(t, 3, c).orderBy("d").collect()
    assert (full[1].positive, full[1].negative, full[1].unchanged, full[1].raw_breadth) == (1, 1, 1, 0.0)
    assert R.market_breadth(t.filter(F.col("d") <= day(1)), 3, c).orderBy("d").collect() == full[:2]


def test_regimes(spark):
    c = R.BreadthConfig()
    t = spark.createDataFrame([(0.0, 0.1), (0.0, -0.1), (0.0, 0.0), (-0.5, 0.1), (0.5, -0.1), (None, 0.1), (0.1, None)], "b double, s double")
    assert [r.x for r in t.select(R.regime(F.col("b"), F.col("s"), c).alias("x")).collect()] == ["recovery", "deterioration", "transition_flat", "broad_decline", "broad_advance", "warmup_or_missing", "warmup_or_missing"]


def test_stop_constant():
    assert T.stop_loss_fraction() == pytest.approx(0.16375777591973245, abs=1e-15)


def _market(edit=None):
    rows = {i: [100.0, 101.0, 99.0, 100.0, 1e12] for i in range(40)}
    for i, r in (edit or {}).items():
        rows[i] = [*r, 1e12]
    return {"AAA": ({day(i): i for i in range(40)}, {i: tuple(r) for i, r in rows.items()})}


def _plans(*at):
    return [{"event_id": f"AAA::{p}", "symbol": "AAA", "d": day(p), "entry_date": day(p + 1), "signal_position": p, "entry_position": p + 1, "horizon_end_date": day(p + 30), "score": 0.9, "daily_rank": 1} for p in at]


def _run(plans, market, structure="multi_lot", exit_style="trailing"):
    return T.Portfolio({"scenario_id": "s", "initial_capital": 1e9, "slippage": 0.002, "structure": structure, "exit_style": exit_style, "adv_fraction": 0.01}, market, T.Rules()).run(plans)


def test_adverse_stop_comes_first():
    out = _run(_plans(0), _market({1: (100, 130, 70, 100)}), exit_style="fixed_take_profit")
    trade = next(r for r in out if r["kind"] == "trade")
    assert trade["reason"] == "initial_intraday_stop" and trade["net_return"] < 0


def test_risk_is_released_at_the_next_open():
    edit = {2: (100, 120, 99, 100)} | {i: (118, 120, 117, 118) for i in range(3, 40)}
    days = {r["d"]: r for r in _run(_plans(0), _market(edit)) if r["kind"] == "day"}
    assert (days[day(2)]["protected_lots"], days[day(2)]["open_risk"] > 0) == (0, True)
    assert (days[day(3)]["protected_lots"], days[day(3)]["open_risk"]) == (1, 0.0)


@pytest.mark.parametrize(("structure", "want"), [("multi_lot", [None, None, None, "symbol_lot_cap_reached"]), ("single_lot", [None, *["single_lot_symbol_already_open"] * 3])])
def test_repeated_signals(structure, want):
    out = [r for r in _run(_plans(0, 1, 2, 3), _market(), structure) if r["kind"] == "decision"]
    assert [r.get("reason") for r in out] == want


def test_simulation_in_spark(spark):
    bars = series(spark, [(100, 101, 99, 100)] * 40).withColumn("adv20_irr", F.lit(1e12))
    plans = T.execution_plan(spark.createDataFrame([("e", 1, DAY, 0.9, 1)], "event_id string, symbol long, d date, score double, daily_rank int"), bars)
    capital = spark.createDataFrame([("primary", 1e9)], "capital string, initial_capital double")
    grid = T.scenario_grid(spark, capital, slippages=("20bp",))
    ledger = T.simulate(grid, plans, bars)
    assert {(r.accepted_signals, r.closed_trades, r.entry_constraint_violations) for r in T.portfolio_integrity(ledger).collect()} == {(1, 1, 0)}
    assert {r.reason for r in ledger.filter("kind = 'trade'").collect()} == {"time_exit_observation_30"}
    assert T.performance(ledger, grid).count() == 4


def test_loader_drops_bad_bars(spark):
    t = series(spark, [(1, 1, 1, 1), (0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 1)])
    a = B.history_audit(t).first()
    assert (a.source_rows, a.nonfinite_rows, a.nonpositive_rows, a.kept_rows) == (4, 0, 1, 3)
    assert B.execution_rows(t).count() == 3


def test_lock(spark, tmp_path):
    t = spark.createDataFrame([("e", "A", DAY, 0.5, 1, 1, 1, 0.5, True)], "event_id string, symbol string, d date, score double, daily_candidate_count long, daily_rank int, daily_signal_quota long, daily_score_cutoff double, selected boolean")
    digest = G.write_lock(t, str(tmp_path / "lock"))
    assert G.read_lock(spark, str(tmp_path / "lock"), digest).count() == 1
    with pytest.raises(ValueError):
        G.read_lock(spark, str(tmp_path / "lock"), "0")


def test_expectations(spark):
    t = spark.createDataFrame([(1,), (None,)], "x int")
    assert E.violations(t, {"x": F.col("x") > 0}).first().violations == 1
    with pytest.raises(ValueError):
        E.enforce(t, {"x": F.col("x") > 0})
    with pytest.raises(KeyError):
        E.require_columns(t, ["y"])


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
