"""Registered queries of the simulation and the models cover all scenarios and folds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.plans import portfolio
from barloom.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two years of daily lines of three suppliers, and orders of a dozen customers."""
    path, r = tmp_path_factory.mktemp("tables"), random.Random(3)
    start = dt.datetime(1998, 1, 1)
    lines = [(s, start + dt.timedelta(days=i), float(r.randint(1, 50)), r.randint(0, 10) / 100, r.randint(0, 8) / 100) for s in (1, 2, 3) for i in range(0, 600, 3)]
    flags = F.substring(F.lit("RAN"), (F.col("l_quantity") % 3 + 1).cast("int"), F.lit(1)), F.substring(F.lit("OF"), (F.col("l_quantity") % 2 + 1).cast("int"), F.lit(1))
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double").withColumns({"l_returnflag": flags[0], "l_linestatus": flags[1]}).write.parquet(f"{path}/lineitem.parquet")
    orders = [(i % 12, 100_000.0 + 1_000 * i * i) for i in range(40)]
    spark.createDataFrame(orders, "o_custkey long, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_simulation_covers_the_grid(spark, tables):
    grid = {g.scenario_id: g.initial_capital for g in QUERIES["scenario_grid"](spark, tables).collect()}
    assert len(grid) == 48 and len(set(grid.values())) == 3
    assert {g.scenario_id: round(g.initial_capital, 2) for g in portfolio._scenarios(spark, tables).collect()} == grid
    assert {g.scenario_id for g in QUERIES["portfolio_daily"](spark, tables).select("scenario_id").distinct().collect()} == set(grid)
    assert {g.scenario_id for g in QUERIES["portfolio_integrity"](spark, tables).collect()} == set(grid)


def test_models_cover_all_folds(spark, tables, monkeypatch):
    assert {g.fold_id for g in QUERIES["logistic_baseline"](spark, tables).select("fold_id").distinct().collect()} == {1, 2, 3, 4, 5}
    seen = []
    monkeypatch.setattr(portfolio.ml, "out_of_fold", lambda m, folds, kind, *a: seen.append((kind, folds)) or m.withColumn("p", F.lit(0.5)))
    monkeypatch.setattr(portfolio.ml, "expanding_calibration", lambda oof, folds: seen.append(("calibration", folds)) or oof)
    monkeypatch.setattr(portfolio.ml, "calibration_summary", lambda t: t)
    monkeypatch.setattr(portfolio.S, "choose_calibration", lambda t: t)
    for name in ("forest_oof", "gbt_oof", "calibration_by_method"):
        QUERIES[name](spark, tables)
    assert seen == [(kind, [1, 2, 3, 4, 5]) for kind in ("forest", "gbt", "calibration")]


def exit_of(bars, slip, fixed):
    """(bar, reason, quote) of a lot bought at the open of bars[0], by the rules alone. bars: (d, open, high, low, last)."""
    buy, sell = 0.00464, 0.00964
    price = bars[0][1] * (1 + slip)
    stop, goal, even, top, pending, active = price * 0.85, price * 1.15, price * (1 + buy) / ((1 - slip) * (1 - sell)), price, False, False
    for i, (_, first, high, low, last) in enumerate(bars):
        if i and pending:
            pending, stop = False, max(even, 0.9 * top)
            if first <= stop:
                return i, "trailing_gap_exit_on_activation_open", first
            active = True
        if i and first <= stop:
            return i, "trailing_gap_stop" if active else "initial_gap_stop", first
        if i and fixed and first >= goal:
            return i, "fixed_target_gap_exit", first
        if low <= stop:
            return i, "trailing_intraday_stop" if active else "initial_intraday_stop", stop
        if fixed and high >= goal:
            return i, "fixed_take_profit", goal
        if not fixed:
            top = max(top, high)
            if active:
                stop = max(even, 0.9 * top)
            elif high >= goal:
                pending = True
        if i + 1 >= 30:
            return i, "time_exit_observation_30", last
    raise AssertionError("no exit")


def test_trades_against_the_rules(spark):
    """Each trade's exit is worked out again from its bars; money adds up over the ledger; signals are accepted, stopped and capped."""
    sf = "/root/testdata/sf0.001"
    bars, at = {}, {}
    for b in portfolio._history(spark, sf).orderBy("symbol", "d").collect():
        at[b.symbol, b.d] = len(bars.setdefault(b.symbol, []))
        bars[b.symbol].append((b.d, b.adj_open, b.adj_high, b.adj_low, b.adj_last_price))
    grid = {g.scenario_id: g for g in portfolio._scenarios(spark, sf).collect()}
    trades, gained = QUERIES["portfolio_trades"](spark, sf).collect(), {}
    assert len(trades) > 100 and len({t.reason for t in trades}) >= 4
    for t in trades:
        g, first = grid[t.scenario_id], at[t.symbol, t.entry_date]
        held, reason, quote = exit_of(bars[t.symbol][first:], g.slippage, g.exit_style == "fixed_take_profit")
        paid, got = bars[t.symbol][first][1] * (1 + g.slippage) * 1.00464, quote * (1 - g.slippage) * (1 - 0.00964)
        assert (t.d, t.reason) == (bars[t.symbol][first + held][0], reason), t
        assert t.net_return == pytest.approx(got / paid - 1) and t.pnl == pytest.approx(t.quantity * (got - paid))
        gained[t.scenario_id] = gained.get(t.scenario_id, 0.0) + t.pnl
    for p in QUERIES["scenario_performance"](spark, sf).collect():
        assert p.final_equity == pytest.approx(grid[p.scenario_id].initial_capital + gained.get(p.scenario_id, 0.0)) and p.accepted_signals == p.closed_trades
    reasons = {(r.decision, r.reason) for r in QUERIES["decision_breakdown"](spark, sf).collect()}
    assert ("accepted", None) in reasons and sum(d == "rejected" for d, _ in reasons) >= 2
    assert all((r.entry_constraint_violations, r.negative_cash_events, r.protected_lot_nonzero_planned_risk_events, r.closed) == (0, 0, 0, True) for r in QUERIES["portfolio_integrity"](spark, sf).collect())


def test_calibration_metrics_are_those_of_each_fold_alone(spark):
    rows = [(k, f"e{k}_{i}", (i * 7 + k) % 3 % 2, ((i * 37 + k * 11) % 101 + 0.5) / 102) for k in (1, 2, 3) for i in range(60)]
    oof = spark.createDataFrame(rows, "fold_id int, event_id string, meta_label int, p double")
    got = {(r.fold_id, r.method): r for r in portfolio.ml.expanding_calibration(oof, [1, 2, 3]).collect()}
    assert set(got) == {(k, m) for k in (2, 3) for m in ("identity", "platt", "isotonic")}
    for (k, method), r in got.items():
        one = portfolio.ml.calibrate(method, oof.filter(F.col("fold_id") < k), oof.filter(F.col("fold_id") == k))
        alone = portfolio.M.probability_metrics(one, label="meta_label", p="calibrated").first()
        assert all(abs(r[c] - alone[c]) < 1e-9 for c in ("rows", "roc_auc", "log_loss", "brier_score", "ece"))


def test_model_rows_hold_all_features_once(spark, tables):
    rows = portfolio._model_members(spark, tables)
    assert {*portfolio._NUMERIC, *portfolio._CATEGORICAL} <= set(rows.columns) and len(portfolio._NUMERIC + portfolio._CATEGORICAL) == 35
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold_id", "event_id").alias("u"), F.min("sample_weight").alias("w")).first()
    assert n.n == n.u == portfolio.V.members(spark, tables).filter("role in ('train', 'validation')").count() and n.w > 0


def test_settled_refuses_a_cluster_without_a_checkpoint_folder():
    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    frame = type("Frame", (), {"sparkSession": type("Session", (), {"sparkContext": Context()})})
    with pytest.raises(ValueError, match="checkpoint"):
        portfolio.ml.settled(frame)


#: Queries whose simulation streams plans by day.
STREAMED = ["portfolio_daily", "decision_breakdown", "portfolio_integrity", "portfolio_trades", "exit_reasons", "portfolio_decisions", "scenario_performance"]


@pytest.mark.parametrize("name", STREAMED)
def test_no_task_takes_a_market_for_each_scenario(spark, tables, name, capsys):
    """A scenario was one group of all plans and all bars, and the bars were dealt out once for each scenario."""
    QUERIES[name](spark, tables).explain()
    plan = capsys.readouterr().out
    assert "CoGroup" not in plan and "adv20_irr" not in plan


@pytest.mark.parametrize("name", ["decision_breakdown", "portfolio_integrity", "scenario_performance"])
def test_summaries_count_rejected_plans_without_a_row_for_each(spark, tables, name, capsys, monkeypatch):
    """Their plans joined each rejected plan to its run, scenarios times plans of them, to count them."""
    got = QUERIES[name](spark, tables)
    got.explain()
    assert "place#" not in capsys.readouterr().out
    simulate = portfolio.T.simulate
    monkeypatch.setattr(portfolio.T, "simulate", lambda *a, counted: simulate(*a))
    want = QUERIES[name](spark, tables)
    assert got.dtypes == want.dtypes
    told = lambda df: sorted(map(repr, df.collect()))
    assert told(got) == told(want)


def test_stream_of_plans_gives_the_ledger_of_the_rules(spark):
    """The ledger from streams, with bars for all plans at once or after a second run, is that of Portfolio.run over the whole market."""
    T, sf = portfolio.T, "/root/testdata/sf0.001"
    bars = portfolio._history(spark, sf).filter("symbol < 8").cache()
    plans = T.execution_plan(portfolio._signals(spark, sf).filter("symbol < 8"), bars).cache()
    grid = portfolio._scenarios(spark, sf).filter("capital = 'median' and slippage in (0.0, 0.005)").cache()
    market = {}
    for b in bars.orderBy("symbol", "pos").collect():
        dates, rows = market.setdefault(b.symbol, ({}, {}))
        dates[b.d], rows[b.pos] = b.pos, (b.adj_open, b.adj_high, b.adj_low, b.adj_last_price, b.adv20_irr)
    own = [p.asDict() for p in plans.filter("plan_error is null").collect()]
    market = {s: market[s] for s in {p.symbol for p in plans.select("symbol").distinct().collect()}}
    want = {(r["scenario_id"], r["seq"]): r for g in grid.collect() for r in T.Portfolio(g.asDict(), market, T.Rules()).run(own)}
    assert {r["decision"] for r in want.values() if r["kind"] == "decision"} == {"accepted", "rejected"}
    for near in (8, 0):
        got = {(r.scenario_id, r.seq): {k: v for k, v in r.asDict().items() if v is not None} for r in T.simulate(grid, plans, bars, near=near).collect()}
        assert got == {k: {c: v for c, v in r.items() if v is not None} for k, r in want.items()}


def test_the_ledger_flows_while_plans_come(spark):
    """Rows leave a task before its stream has ended, so that neither plans nor ledger gather in it."""
    import pyarrow as pa

    T, day = portfolio.T, dt.date(2000, 1, 1)
    schema = T.to_arrow_schema(T.StructType.fromDDL(f"{T._EVENT_FIELDS}, {T._RUN_FIELDS}"))
    came = []

    def batches():
        for k in range(50):
            came.append(k)
            days = [day + dt.timedelta(days=k * 100 + i) for i in range(100)]
            yield pa.RecordBatch.from_pydict({"lane": pa.array([0] * 100, pa.int32()), "day": days, "place": pa.array([-1] * 100, pa.int32()), "symbol": pa.array([None] * 100, pa.int64())})

    lanes = [[{"scenario_id": "s", "initial_capital": 1e6, "slippage": 0.0, "structure": "multi_lot", "exit_style": "trailing", "adv_fraction": 0.01}]]
    out = T._lanes(batches(), lanes, T.Rules(), schema)
    assert next(out).num_rows <= T._OUT_ROWS and len(came) < 50
    assert T._OUT_ROWS < 5001 and sum(b.num_rows for b in out) + T._OUT_ROWS >= 5001


def test_an_event_is_kept_once_with_its_weight_in_each_fold(spark, tables):
    """Rows of each fold are those of the long form, in features, role and weight, though an event is stored once."""
    names = (portfolio._NUMERIC, portfolio._CATEGORICAL)
    rows = portfolio.ml.event_rows(portfolio._fold_members(spark, tables), portfolio.V.feature_frame(spark, tables), portfolio._FOLDS, *names)
    assert rows.count() == rows.select("event_id").distinct().count()
    long = portfolio._model_members(spark, tables).cache()
    for k in portfolio._FOLDS:
        got = {r.event_id: r.asDict() for r in portfolio.ml.fold_rows_of(rows, k, *names).collect()}
        want = [r.asDict() for r in long.filter(F.col("fold_id") == k).collect()]
        assert len(got) == len(want)
        for w in want:
            g = got[w["event_id"]]
            assert g["sample_weight"] == pytest.approx(w["sample_weight"], rel=1e-12)
            assert all(g[c] == w[c] or g[c] == pytest.approx(w[c], rel=1e-12) for c in ("role", "meta_label", "symbol", "d", "event_end_date", *names[0], *names[1]))


def test_medians_are_exact_over_ties_nulls_and_nan(spark):
    r = random.Random(5)
    rows = [(r.gauss(0, 1), float(r.randint(0, 2)), None, r.choice([None, 0.0, 1e300, -1e300]), r.choice([float("nan"), 1.0, 2.0]), r.choice([float("nan"), float("inf"), -1.0]), r.randint(0, 9), r.random() if i % 2 else None) for i in range(5000)]
    t = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g int, h double").repartition(3)
    for df in (t, t.limit(4999), t.limit(2), t.limit(1), t.filter("false"), t.select("a").unionAll(t.select((F.col("a") + 3).alias("a")))):
        want = df.agg(*[F.median(c).alias(c) for c in df.columns]).first().asDict()
        got = portfolio.ml.medians(df.cache(), df.columns)
        assert {c: repr(v) for c, v in got.items()} == {c: repr(v) for c, v in want.items()}
