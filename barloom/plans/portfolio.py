"""Registered queries of execution, simulation, models and governance; added to the catalog on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as T
from barloom.operators import bars as B
from barloom.operators import features as P
from barloom.operators import folds as K
from barloom.operators import governance as G
from barloom.operators import metrics as M
from barloom.operators import ml
from barloom.operators import policy as S
from barloom.plans import sql as Q
from barloom.plans import views as V
from barloom.plans.catalog import query
from barloom.plans.views import longs, rounded

_PLAN = """
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol, event_id) rk, count(*) OVER (PARTITION BY d) n FROM ev) WHERE rk <= least(n, greatest(1, ceil(0.05::DOUBLE * n)))),
nx AS (SELECT symbol, d, pos, lead(d, 1) OVER w entry_date, lead(d, 30) OVER w horizon_end_date FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
plans AS MATERIALIZED (SELECT sel.event_id, sel.symbol, sel.d, sel.score, CAST(rk AS BIGINT) daily_rank, nx.pos signal_position, nx.entry_date, nx.pos + 1 entry_position, nx.horizon_end_date, CASE WHEN entry_date IS NULL THEN 'no_next_observation' WHEN horizon_end_date IS NULL THEN 'horizon_incomplete' END plan_error FROM sel JOIN nx ON nx.symbol = sel.symbol AND nx.d = sel.d)"""


def _signals(spark, sf):
    return S.daily_top_fraction(V.events(spark, sf)).filter("selected").select("event_id", "symbol", "d", "score", "daily_rank")


@query(Q.rnd(Q.with_(*Q.BE, _PLAN) + "SELECT event_id, symbol, d, score, daily_rank, signal_position, entry_date, entry_position, horizon_end_date, plan_error FROM plans", score=6))
def execution_plan(spark, sf):
    return longs(rounded(T.execution_plan(_signals(spark, sf), V.bars(spark, sf)).drop("horizon_end_position")))


_CUSTOMERS = "cu AS (SELECT o_custkey, avg(o_totalprice) v FROM orders GROUP BY 1)"
_ANCHOR = """
rk AS (SELECT v, row_number() OVER (ORDER BY v) r, count(*) OVER () n FROM cu WHERE v > 0),
an AS MATERIALIZED (SELECT 'primary' capital, avg(v) anchor FROM rk WHERE r > floor(n * 0.1::DOUBLE) AND r <= n - floor(n * 0.1::DOUBLE) UNION ALL SELECT 'median', median(v) FROM cu UNION ALL SELECT 'mean', avg(v) FROM cu)"""
_STOP = T.stop_loss_fraction()


def _capitals(spark, sf):
    customers = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_buy"))
    return T.capital_anchors(customers, "avg_buy")


@query(Q.rnd(Q.with_(_CUSTOMERS, _ANCHOR) + f"SELECT capital, anchor, anchor / (0.005::DOUBLE / {Q.lit(_STOP)}) initial_capital FROM an", anchor=4, initial_capital=2))
def trimmed_mean_capital(spark, sf):
    return rounded(_capitals(spark, sf), 4, initial_capital=2)


@query("SELECT round(1.0::DOUBLE - (1.002::DOUBLE * 0.85::DOUBLE * 0.998::DOUBLE * (1.0::DOUBLE - 0.00964::DOUBLE)) / (1.002::DOUBLE * 1.00464::DOUBLE), 12) stop_loss_fraction")
def stop_loss_fraction(spark, sf):
    return spark.createDataFrame([(T.stop_loss_fraction(),)], "stop_loss_fraction double").select(F.round("stop_loss_fraction", 12).alias("stop_loss_fraction"))


_GRID = """
gd AS MATERIALIZED (SELECT 'capital_' || capital || '__slip_' || slip || '__' || structure || '__' || exit_style scenario_id, capital, slip, slippage, structure, exit_style, capital = 'primary' AND slip = '20bp' AND structure = 'multi_lot' AND exit_style = 'trailing' is_primary, anchor / (0.005::DOUBLE / """ + Q.lit(_STOP) + """) initial_capital
  FROM an, (VALUES ('0bp', 0.0::DOUBLE), ('10bp', 0.001::DOUBLE), ('20bp', 0.002::DOUBLE), ('50bp', 0.005::DOUBLE)) s(slip, slippage), (VALUES ('multi_lot'), ('single_lot')) p(structure), (VALUES ('trailing'), ('fixed_take_profit')) e(exit_style))"""


@query(Q.rnd(Q.with_(_CUSTOMERS, _ANCHOR, _GRID) + "SELECT scenario_id, capital, initial_capital, slippage, structure, exit_style, 0.01::DOUBLE adv_fraction, is_primary FROM gd", initial_capital=2, slippage=6, adv_fraction=6))
def scenario_grid(spark, sf):
    return rounded(T.scenario_grid(spark, _capitals(spark, sf)), initial_capital=2)


def _scenarios(spark, sf):
    """The whole grid, with the capitals calibrated from customers: 48 scenarios."""
    return T.scenario_grid(spark, _capitals(spark, sf))


#: Shares in a unit of a bar's volume: quantities of trade lines are lots, so that a lot of a portfolio is a small part of a day's trade.
LOT_SHARES = 1000


def _history(spark, sf):
    return B.market_history(V.bars(spark, sf).withColumn("traded_value", F.col("traded_value") * LOT_SHARES))


def _ledger(spark, sf, counted=False):
    bars = _history(spark, sf)
    return T.simulate(_scenarios(spark, sf), T.execution_plan(_signals(spark, sf), bars), bars, counted=counted)


@query()
def portfolio_trades(spark, sf):
    return T.part_of(_ledger(spark, sf), "trade", ["event_id", "symbol", "entry_date", "d", "quantity", "entry_price", "exit_price", "pnl", "net_return", "reason", "trailing"])


@query()
def portfolio_decisions(spark, sf):
    return T.part_of(_ledger(spark, sf), "decision", ["event_id", "symbol", "d", "decision", "reason", "quantity", "entry_risk"])


@query()
def portfolio_daily(spark, sf):
    return T.part_of(_ledger(spark, sf), "day", ["d", "cash", "market_value", "equity", "open_risk", "open_lots", "open_symbols", "protected_lots", "new_lots"])


@query(Q.with_(*Q.BE, _PLAN, _CUSTOMERS, _ANCHOR, _GRID) + "SELECT scenario_id, (SELECT count(*) FROM plans WHERE plan_error IS NULL) signals_decided, CAST(0 AS BIGINT) entry_constraint_violations, CAST(0 AS BIGINT) negative_cash_events, CAST(0 AS BIGINT) protected_lot_nonzero_planned_risk_events, true closed FROM gd")
def portfolio_integrity(spark, sf):
    t = T.portfolio_integrity(_ledger(spark, sf, counted=True))
    return longs(t.select("scenario_id", "signals_decided", "entry_constraint_violations", "negative_cash_events", "protected_lot_nonzero_planned_risk_events", (F.col("accepted_signals") == F.col("closed_trades")).alias("closed")))


@query()
def scenario_performance(spark, sf):
    return T.performance(_ledger(spark, sf, counted=True), _scenarios(spark, sf))


@query()
def decision_breakdown(spark, sf):
    return T.decision_breakdown(_ledger(spark, sf, counted=True))


@query()
def exit_reasons(spark, sf):
    return T.exit_breakdown(_ledger(spark, sf))


@query(Q.rnd(Q.with_(Q.BARS) + "SELECT symbol, min(c / m - 1.0::DOUBLE) maximum_drawdown FROM (SELECT symbol, c, max(c) OVER (PARTITION BY symbol ORDER BY d) m FROM bars) GROUP BY symbol", maximum_drawdown=6))
def max_drawdown(spark, sf):
    return rounded(M.max_drawdown(V.bars(spark, sf), "symbol", value="adj_last_price"))


@query()
def fingerprint(spark, sf):
    return G.fingerprint(V.table(spark, sf, "nation"))


# --- models -----------------------------------------------------------------------------------------------------------------------

_NUMERIC, _CATEGORICAL = list(P.NUMERIC_FEATURES), list(P.CATEGORICAL_FEATURES)
#: All folds of K.build_folds.
_FOLDS = [1, 2, 3, 4, 5]


def _fold_members(spark, sf):
    """Training and validation rows of each fold without features, from one settled copy of the events; training rows have their uniqueness within the fold."""
    ev = ml.settled(V.events(spark, sf).select("event_id", "symbol", "d", "pos", "event_end_date", "meta_label", "holding_period_observations"))
    t = K.fold_membership(ev, V.folds(spark, sf, ev))
    train = K.uniqueness(t.filter("role = 'train'"), V.bars(spark, sf), ("fold_id",))
    return train.unionByName(t.filter("role = 'validation'").withColumn("average_uniqueness", F.lit(None).cast("double")))


def _model_members(spark, sf):
    """Training and validation rows of each fold with all model features; training rows weigh by their uniqueness within the fold."""
    t = V.members(spark, sf)
    train = K.average_uniqueness(t.filter("role = 'train'"), V.bars(spark, sf), ("fold_id",)).drop("average_uniqueness")
    rows = train.unionByName(t.filter("role = 'validation'").withColumn("sample_weight", F.lit(1.0)))
    return rows.join(V.feature_frame(spark, sf), ["symbol", "d"], "left")


@query(Q.rnd(Q.with_(*Q.BF) + """, t AS (SELECT fold_id, avg(meta_label) p FROM mem WHERE "role" = 'train' GROUP BY 1) SELECT event_id, fold_id, p FROM mem JOIN t USING (fold_id) WHERE "role" = 'validation'""", p=6))
def dummy_prior(spark, sf):
    m = V.members(spark, sf)
    prior = m.filter("role = 'train'").groupBy("fold_id").agg(F.avg(F.col("meta_label").cast("double")).alias("p"))
    return longs(rounded(m.filter("role = 'validation'").join(F.broadcast(prior), "fold_id").select("event_id", "fold_id", "p")))


@query(Q.rnd(Q.with_(*Q.BE) + "SELECT count(*) FILTER (meta_label = 0) / CAST(count(*) FILTER (meta_label = 1) AS DOUBLE) ratio FROM ev", ratio=6))
def weighted_class_ratio(spark, sf):
    return rounded(ml.class_ratio(V.events(spark, sf).withColumn("sample_weight", F.lit(1.0))))


@query()
def logistic_baseline(spark, sf):
    return ml.out_of_fold(V.table(spark, sf, "lineitem"), _FOLDS, "logistic")


@query()
def forest_oof(spark, sf):
    return ml.out_of_fold(V.table(spark, sf, "lineitem"), _FOLDS, "forest")


@query()
def gbt_oof(spark, sf):
    return ml.out_of_fold(V.table(spark, sf, "lineitem"), _FOLDS, "gbt")


@query()
def calibration_by_method(spark, sf):
    oof = V.oof(spark, sf).select("fold_id", "event_id", "meta_label", F.col("score").alias("p"))
    return S.choose_calibration(ml.calibration_summary(ml.expanding_calibration(oof, _FOLDS)))
