"""Registered queries of the engine's own operators, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import exprs as X
from barloom.operators import bars as B
from barloom.operators import breadth as R
from barloom.operators import expect as E
from barloom.operators import features as P
from barloom.operators import folds as K
from barloom.operators import labeling as L
from barloom.operators import metrics as M
from barloom.operators import policy as S
from barloom.operators import signals as N
from barloom.operators import zigzag as Z
from barloom.operators.sequence import calendar, date_gaps, exponential_means
from barloom.plans import sql as Q
from barloom.plans import views as V
from barloom.plans.views import longs, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# --- bars -------------------------------------------------------------------------------------------------------------------------


@query(Q.with_(Q.BARS) + "SELECT symbol, d, pos, o AS adj_open, h AS adj_high, l AS adj_low, c AS adj_last_price, vol, tv AS traded_value FROM bars")
def bars_canonical(spark, sf):
    return longs(V.bars(spark, sf))


@query(r"""WITH t AS (SELECT l_orderkey k, l_linenumber n, CASE WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%Y%m%d') WHEN l_linenumber % 3 = 1 THEN ' ' || strftime(l_shipdate, '%Y-%m-%d') || ' ' ELSE 'bad' END txt,
  CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END num, l_shipdate FROM lineitem)
SELECT CAST(count(*) AS BIGINT) "rows", CAST(count(CASE WHEN n % 3 < 2 THEN 1 END) AS BIGINT) parsed_dates, min(CASE WHEN n % 3 < 2 THEN CAST(l_shipdate AS DATE) END) first_date, max(CASE WHEN n % 3 < 2 THEN CAST(l_shipdate AS DATE) END) last_date,
  CAST(count(CASE WHEN num <> 'n/a' THEN 1 END) AS BIGINT) parsed_numbers, CAST(sum(CASE WHEN num <> 'n/a' THEN CAST(num AS BIGINT) END) AS DOUBLE) number_sum, CAST(count(DISTINCT CASE WHEN n % 3 < 2 THEN CAST(l_shipdate AS DATE) END) AS BIGINT) "days" FROM t""")
def parsing(spark, sf):
    n, day = F.col("l_linenumber"), F.col("l_shipdate")
    text = F.when(n % 3 == 0, F.date_format(day, "yyyyMMdd")).when(n % 3 == 1, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd"), F.lit(" "))).otherwise("bad")
    number = F.when(n % 4 == 0, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string"))
    t = V.table(spark, sf, "lineitem").select(X.market_date(text).alias("d"), X.number(number).alias("x"))
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count("d").alias("parsed_dates"), F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count("x").alias("parsed_numbers"), F.sum("x").alias("number_sum"), F.countDistinct("d").alias("days"))


@query("""SELECT l_suppkey symbol, CAST(l_shipdate AS DATE) d, max(l_orderkey * 8 + l_linenumber) last_ordinal FROM lineitem GROUP BY 1, 2""")
def keep_last_row(spark, sf):
    t = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("last_ordinal"))
    return X.keep_last(t, ["symbol", "d"], ["last_ordinal"])


@query(Q.with_(Q.BARS) + """SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) FILTER (c IS NULL) AS BIGINT) quality_price_missing, CAST(count(*) FILTER (least(o, h, l, c) <= 0) AS BIGINT) quality_price_nonpositive, CAST(count(*) FILTER (h < l) AS BIGINT) quality_high_below_low,
  CAST(count(*) FILTER (NOT (o BETWEEN l AND h) OR NOT (c BETWEEN l AND h)) AS BIGINT) quality_outside_range, CAST(count(*) FILTER (h = l) AS BIGINT) quality_locked_bar,
  CAST(count(*) FILTER (NOT (o BETWEEN l AND h AND c BETWEEN l AND h AND h >= l AND l > 0)) AS BIGINT) quality_any_price_issue FROM bars""")
def row_quality_summary(spark, sf):
    return B.quality_summary(B.quality_flags(V.bars(spark, sf)))


_PART = "CASE WHEN d <= DATE '1999-12-31' THEN 'train' WHEN d <= DATE '2001-06-30' THEN 'unseen_test' ELSE 'after' END"


@query(Q.with_(Q.BARS) + f"""SELECT symbol, CAST(count(*) FILTER (p = 'train') AS BIGINT) train_rows, CAST(count(*) FILTER (p = 'unseen_test') AS BIGINT) unseen_test_rows, CAST(count(*) FILTER (p = 'after') AS BIGINT) after_rows,
  max(d) FILTER (p = 'train') train_last, min(d) FILTER (p = 'unseen_test') test_first, max(d) FILTER (p = 'unseen_test') test_last, true chronological FROM (SELECT *, {_PART} p FROM bars) GROUP BY symbol""")
def temporal_split_summary(spark, sf):
    return B.split_summary(B.calendar_split(V.bars(spark, sf)))


@query(Q.rnd(Q.with_(Q.BARS) + """, t AS (SELECT symbol, count(*) train_rows, max(d) last_date, 0.0::DOUBLE price_missing_fraction, avg(CASE WHEN o BETWEEN l AND h AND c BETWEEN l AND h AND h >= l AND l > 0 THEN 0.0 ELSE 1.0 END) price_issue_fraction FROM bars WHERE d <= DATE '1999-12-31' GROUP BY symbol),
g AS (SELECT *, CAST(date_diff('day', last_date, DATE '1999-12-31') AS BIGINT) last_gap_days FROM t),
r AS (SELECT *, list_filter([CASE WHEN train_rows < 200 THEN 'too_few_rows' END, CASE WHEN last_gap_days > 45 THEN 'stale' END, CASE WHEN price_issue_fraction > 0.05 THEN 'price_issues' END], lambda x: x IS NOT NULL) rs FROM g)
SELECT symbol, train_rows, last_date, price_missing_fraction, price_issue_fraction, last_gap_days, len(rs) = 0 selected_for_frozen_universe, CASE WHEN len(rs) = 0 THEN 'selected' ELSE array_to_string(rs, '|') END universe_decision_reason FROM r""", price_missing_fraction=6, price_issue_fraction=6))
def universe_freeze(spark, sf):
    train = B.calendar_split(V.bars(spark, sf)).filter("part = 'train'")
    return longs(rounded(B.freeze_universe(train)))


@query(Q.rnd(Q.with_(Q.BARS, Q.IDX_OBS, """
u AS (UNPIVOT (SELECT d, ic AS index_close, il AS index_low, ih AS index_high FROM obs) ON index_close, index_low, index_high INTO NAME field VALUE x)""") + """SELECT d, field, count(*) observations, min(x) low, max(x) high, median(x) median, (max(x) - min(x)) / greatest(abs(median(x)), 1.0::DOUBLE) relative_spread, (max(x) - min(x)) / greatest(abs(median(x)), 1.0::DOUBLE) > 1e-10 inconsistent FROM u GROUP BY d, field""", low=4, high=4, median=4, relative_spread=9))
def index_consistency(spark, sf):
    return rounded(B.index_consistency(B.index_observations(V.bars(spark, sf))), 4, relative_spread=9)


@query(Q.rnd(Q.with_(Q.BARS, Q.IDX) + "SELECT d, ic AS index_close, il AS index_low, ih AS index_high FROM idx", index_close=4, index_low=4, index_high=4))
def market_index_canonical(spark, sf):
    return rounded(V.index(spark, sf), 4)


@query(Q.rnd(Q.with_(Q.BARS) + "SELECT symbol, d, CASE WHEN count(tv) OVER w = 20 THEN avg(tv) OVER w END adv20_irr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", adv20_irr=6))
def adv20(spark, sf):
    return rounded(B.market_history(V.bars(spark, sf)).select("symbol", "d", "adv20_irr"), 6)


@query(Q.with_(Q.BARS) + "SELECT symbol, count(*) source_rows, CAST(0 AS BIGINT) nonfinite_rows, count(*) FILTER (pos % 50 = 0) nonpositive_rows, count(*) FILTER (pos % 50 <> 0) kept_rows FROM bars GROUP BY symbol")
def market_history_audit(spark, sf):
    broken = V.bars(spark, sf).withColumn("adj_low", F.when(F.col("pos") % 50 == 0, F.lit(0.0)).otherwise(F.col("adj_low")))
    return B.history_audit(broken)


# --- labels -----------------------------------------------------------------------------------------------------------------------


@query(Q.rnd(Q.with_(*Q.BL) + """SELECT symbol, d, "label", label_status, barrier_touched, event_end_date, holding AS holding_period_observations, event_return, double_touch AS same_bar_double_touch FROM lab""", event_return=6))
def triple_barrier_labels(spark, sf):
    t = V.labels(spark, sf).select("symbol", "d", "label", "label_status", "barrier_touched", "event_end_date", "holding_period_observations", "event_return", "same_bar_double_touch")
    return longs(rounded(t))


_SCENARIOS = [(p.name, p.upper, p.lower, p.horizon) for p in L.SCENARIOS]
_ALL = (Q.BARS, *[Q.labels(u, d, h, f"s{i}") for i, (_, u, d, h) in enumerate(_SCENARIOS)], "\nsc AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{n}' scenario, * FROM s{i}" for i, (n, *_) in enumerate(_SCENARIOS)) + ")")


@query(Q.rnd(Q.with_(*_ALL) + """SELECT scenario, count(*) events, CAST(sum("label") AS BIGINT) positive, count(DISTINCT symbol) symbols, count(DISTINCT d) start_dates, CAST(count(*) - sum("label") AS BIGINT) negative, sum("label") / CAST(count(*) AS DOUBLE) positive_fraction FROM sc WHERE eligible GROUP BY scenario""", positive_fraction=6))
def label_distribution(spark, sf):
    return rounded(L.label_distribution(L.all_scenarios(V.bars(spark, sf)), "scenario"))


@query(Q.rnd(Q.with_(*Q.BL) + """SELECT symbol, count(*) AS "rows", count(*) FILTER (eligible) eligible_events, count(*) FILTER (NOT eligible) excluded_events, count(*) FILTER ("label" = 1) positive_labels, count(*) FILTER ("label" = 0) negative_labels,
  count(*) FILTER (barrier_touched = 'upper') upper_barrier_events, count(*) FILTER (barrier_touched = 'lower') lower_barrier_events, count(*) FILTER (barrier_touched = 'vertical') vertical_barrier_events, count(*) FILTER (double_touch) same_bar_double_touch_events,
  count(*) FILTER (label_status = 'right_censored') right_censored_events, CAST(0 AS BIGINT) invalid_entry_price_events, CAST(0 AS BIGINT) invalid_monitoring_price_events, CAST(0 AS BIGINT) invalid_vertical_price_events,
  min(d) first_event_start_date, max(d) last_event_start_date, max(event_end_date) last_event_end_date, count(*) FILTER ("label" = 1) / CAST(count(*) FILTER (eligible) AS DOUBLE) positive_label_fraction FROM lab GROUP BY symbol""", positive_label_fraction=6))
def label_audit(spark, sf):
    return rounded(L.label_audit(V.labels(spark, sf), "symbol"))


@query(Q.with_(*Q.BL) + """SELECT symbol, count(*) AS "rows", min(d) partition_first_date, max(d) partition_last_date, count(*) FILTER (eligible) eligible_events, count(*) FILTER (NOT eligible) right_censored_events, count(*) FILTER (event_end_date < d) end_before_start_count, count(*) FILTER (event_end_date > (SELECT max(d) FROM bars x WHERE x.symbol = lab.symbol)) event_end_after_partition_count,
  count(*) FILTER (eligible AND event_end_date IS NULL) eligible_missing_event_end_count, count(*) FILTER (eligible AND "label" IS NULL) eligible_invalid_label_count, count(*) FILTER (eligible <> (label_status = 'labeled')) status_eligibility_mismatch_count, CAST(0 AS BIGINT) right_censored_eligible_count,
  count(*) FILTER (barrier_touched IN ('upper', 'lower') AND NOT (holding BETWEEN 1 AND 30)) barrier_holding_invalid_count, count(*) FILTER (barrier_touched = 'vertical' AND holding <> 30) vertical_holding_invalid_count, count(*) FILTER (double_touch AND (barrier_touched <> 'lower' OR "label" <> 0)) double_touch_rule_invalid_count, true integrity_passed FROM lab GROUP BY symbol""")
def event_end_integrity(spark, sf):
    return L.event_end_integrity(V.labels(spark, sf), 30, "symbol")


_YEAR = """yr AS MATERIALIZED (SELECT scenario, CAST(year(d) AS BIGINT) AS "year", count(*) AS "rows", count(*) FILTER (eligible) events, count(*) FILTER (eligible AND "label" = 1) positive, count(*) FILTER (double_touch) double_touch, median(holding) FILTER (eligible) median_holding,
  CASE WHEN count(*) FILTER (eligible) > 0 THEN count(*) FILTER (eligible AND "label" = 1) / CAST(count(*) FILTER (eligible) AS DOUBLE) END positive_fraction FROM sc GROUP BY 1, 2)"""


@query(Q.rnd(Q.with_(*_ALL, _YEAR) + "SELECT * FROM yr", positive_fraction=6, median_holding=6))
def scenario_by_year(spark, sf):
    return longs(rounded(L.scenario_by_year(L.all_scenarios(V.bars(spark, sf)))))


@query(Q.rnd(Q.with_(*_ALL, _YEAR) + """, y2 AS (SELECT scenario, count(positive_fraction) "years", stddev_pop(positive_fraction) fraction_std, max(positive_fraction) - min(positive_fraction) fraction_range FROM yr GROUP BY 1)
SELECT sc.scenario, count(*) AS "rows", count(*) FILTER (eligible) events, count(*) FILTER (eligible AND "label" = 1) positive, median(holding) FILTER (eligible) median_holding, any_value("years") AS "years", any_value(fraction_std) fraction_std, any_value(fraction_range) fraction_range,
  count(*) FILTER (eligible AND "label" = 1) / CAST(count(*) FILTER (eligible) AS DOUBLE) positive_fraction FROM sc JOIN y2 USING (scenario) GROUP BY 1""", positive_fraction=6, fraction_std=6, fraction_range=6, median_holding=6))
def scenario_comparison(spark, sf):
    return rounded(L.scenario_comparison(L.all_scenarios(V.bars(spark, sf))))


_OUT = """
fo AS MATERIALIZED (SELECT ev.*, CASE barrier_touched WHEN 'upper' THEN (SELECT max(h) FROM bars f WHERE f.symbol = ev.symbol AND f.pos BETWEEN ev.pos + 1 AND ev.pos + 30) / c - 1.0::DOUBLE ELSE event_return END r FROM ev)"""
_OUT_COLS = """count(*) events, count(*) FILTER (meta_label = 1) winning_events, count(*) FILTER (meta_label = 0) nonwinning_events, count(*) FILTER (r < 0) losing_events_negative_return, count(*) FILTER (abs(r) <= 1e-12) breakeven_events, avg(meta_label) win_rate, avg(r) mean_return, median(r) median_return, stddev_pop(r) std_return, min(r) min_return, max(r) max_return,
  avg(r) FILTER (r > 0) average_winning_return, avg(r) FILTER (r < 0) average_losing_return, coalesce(sum(r) FILTER (r > 0), 0) gross_profit_sum, coalesce(-sum(r) FILTER (r < 0), 0) gross_loss_absolute_sum, count(*) FILTER (barrier_touched = 'upper') upper_barrier_events, count(*) FILTER (barrier_touched = 'lower') lower_barrier_events, count(*) FILTER (barrier_touched = 'vertical') vertical_barrier_events,
  avg(holding) mean_holding, median(holding) median_holding, avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) payoff_ratio, coalesce(sum(r) FILTER (r > 0), 0) / nullif(-sum(r) FILTER (r < 0), 0) profit_factor"""
_OUT_ROUND = dict.fromkeys(("win_rate", "mean_return", "median_return", "std_return", "min_return", "max_return", "average_winning_return", "average_losing_return", "gross_profit_sum", "gross_loss_absolute_sum", "mean_holding", "median_holding", "payoff_ratio", "profit_factor"), 6)


def _outcomes(spark, sf):
    t = L.forward_outcomes(V.labels(spark, sf))
    return t.withColumn("meta_label", F.col("label")).withColumn("score", V.pseudo_score()).withColumn("event_id", V.event_id())


@query(Q.rnd(Q.with_(*Q.BE, _OUT) + "SELECT symbol, d, barrier_touched, r AS corrected_event_return, true outcome_consistent FROM fo", corrected_event_return=6))
def forward_outcomes(spark, sf):
    return rounded(_outcomes(spark, sf).select("symbol", "d", "barrier_touched", "corrected_event_return", "outcome_consistent"))


@query(Q.rnd(Q.with_(*Q.BE, _OUT) + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol, event_id) rk, count(*) OVER (PARTITION BY d) n FROM fo),
p AS (SELECT 'all_candidates' population, * FROM ranked UNION ALL SELECT 'selected_signals', * FROM ranked WHERE rk <= least(n, greatest(1, ceil(0.05::DOUBLE * n))))
SELECT population, """ + _OUT_COLS + " FROM p GROUP BY 1", **_OUT_ROUND))
def corrected_outcome_metrics(spark, sf):
    return rounded(M.outcome_metrics(M.populations(S.daily_top_fraction(_outcomes(spark, sf))), "population"))


@query(Q.rnd(Q.with_(*Q.BE, _OUT) + 'SELECT CAST(year(d) AS BIGINT) AS "year", ' + _OUT_COLS + " FROM fo GROUP BY 1", **_OUT_ROUND))
def outcomes_by_group(spark, sf):
    return longs(rounded(M.outcome_metrics(_outcomes(spark, sf).withColumn("year", F.year("d")), "year")))


# --- features ---------------------------------------------------------------------------------------------------------------------


_MARKET_ROUND = dict.fromkeys(P.MARKET_FEATURES, 6)


@query(Q.rnd(Q.with_(Q.BARS, Q.MARKET) + "SELECT * FROM market", **_MARKET_ROUND))
def market_regime_features(spark, sf):
    return rounded(P.market_regime(V.index(spark, sf)))


_FLOW = """
fl AS (SELECT l_suppkey symbol, CAST(l_shipdate AS DATE) d, greatest(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 1) biv, greatest(count(*) FILTER (l_returnflag = 'R'), 1) bic, greatest(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 1) siv, greatest(count(*) FILTER (l_returnflag = 'A'), 1) sic,
  greatest(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 1) bnv, greatest(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 1) snv FROM lineitem GROUP BY 1, 2)"""
_STOCK = """
f0 AS (SELECT b.*, biv, bic, siv, sic, bnv, snv, ic, b.c / ic rs, CAST(biv + bnv AS DOUBLE) vv, b.c / lag(b.c) OVER (PARTITION BY b.symbol ORDER BY b.d) - 1 ret, coalesce(b.c - lag(b.c) OVER (PARTITION BY b.symbol ORDER BY b.d), 0) chg FROM bars b JOIN fl ON fl.symbol = b.symbol AND fl.d = b.d JOIN idx ON idx.d = b.d),
f1 AS (SELECT *, avg(rs) OVER w12 rm, stddev_pop(rs) OVER w12 rsd, count(rs) OVER w12 rn, avg(ret) OVER w12 tm, stddev_pop(ret) OVER w12 tsd, count(ret) OVER w12 tn, avg(vv) OVER w30 vm, count(vv) OVER w30 vn FROM f0
  WINDOW w12 AS (PARTITION BY symbol ORDER BY d ROWS 11 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY d ROWS 29 PRECEDING)),
f2 AS (SELECT *, CASE WHEN rn = 12 THEN CASE WHEN rsd = 0 THEN 0 ELSE (rs - rm) / rsd END END xz, CASE WHEN tn = 12 THEN CASE WHEN tsd = 0 THEN 0 ELSE (ret - tm) / tsd END END yz FROM f1),
f3 AS (SELECT *, sum(CASE WHEN xz > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY d) g FROM f2),
f4 AS MATERIALIZED (SELECT symbol, d, pos, ln((biv / CAST(bic AS DOUBLE)) / (siv / CAST(sic AS DOUBLE))) log_power_of_buy, CASE WHEN vn = 30 THEN ln(1 + vv / vm) END log_volume_ratio_30, bnv / CAST(biv + bnv AS DOUBLE) ho_buy_fraction, snv / CAST(siv + snv AS DOUBLE) ho_sell_fraction,
  xz x_relative_strength_zscore, yz y_return_zscore, CAST(CASE WHEN xz > 0 THEN count(*) FILTER (xz > 0) OVER (PARTITION BY symbol, g ORDER BY d) ELSE 0 END AS BIGINT) positive_rs_run_length,
  CASE WHEN h > l THEN (c - o) / (h - l) ELSE sign(chg) END body_ratio FROM f3)"""
_STOCK_COLS = ("log_power_of_buy", "log_volume_ratio_30", "ho_buy_fraction", "ho_sell_fraction", "x_relative_strength_zscore", "y_return_zscore", "body_ratio")


def _stock(spark, sf):
    panel = V.bars(spark, sf).join(P.raw_flow(V.table(spark, sf, "lineitem")), ["symbol", "d"]).join(F.broadcast(V.index(spark, sf).select("d", "index_close")), "d")
    return P.stock_features(panel)


@query(Q.rnd(Q.with_(Q.BARS, Q.IDX, _FLOW, _STOCK) + "SELECT * FROM f4", **dict.fromkeys(_STOCK_COLS, 6)))
def stock_features(spark, sf):
    return longs(rounded(_stock(spark, sf).select("symbol", "d", "pos", *_STOCK_COLS[:6], "positive_rs_run_length", "body_ratio"), 6))


_GMMA = {f"e{n}": n for n in (*P.SHORT_EMAS, *P.LONG_EMAS)}


@query(Q.rnd(Q.with_(Q.BARS, Q.ema("ge", "bars", "symbol", "d", "c", _GMMA)) + f"""SELECT b.symbol, b.d, CASE WHEN e60 IS NULL THEN NULL WHEN least({', '.join(f'e{n}' for n in P.SHORT_EMAS)}) > greatest({', '.join(f'e{n}' for n in P.LONG_EMAS)}) THEN 'bullish'
  WHEN greatest({', '.join(f'e{n}' for n in P.SHORT_EMAS)}) < least({', '.join(f'e{n}' for n in P.LONG_EMAS)}) THEN 'bearish' ELSE 'mixed' END gmma_state, (b.c - e3) / b.c ema_3_distance, (b.c - e30) / b.c ema_30_distance, (b.c - e60) / b.c ema_60_distance
  FROM bars b JOIN ge ON ge.symbol = b.symbol AND ge.d = b.d""", ema_3_distance=6, ema_30_distance=6, ema_60_distance=6))
def gmma_and_ema_distances(spark, sf):
    t = exponential_means(V.bars(spark, sf), [("adj_last_price", f"EMA_{n}", n, n) for n in (*P.SHORT_EMAS, *P.LONG_EMAS)], by=["symbol"])
    far = lambda n: X.ratio(F.col("adj_last_price") - F.col(f"EMA_{n}"), "adj_last_price").alias(f"ema_{n}_distance")
    return rounded(t.select("symbol", "d", P.gmma_state().alias("gmma_state"), far(3), far(30), far(60)))


_QUALITY = ("log_power_of_buy", "log_volume_ratio_30", "x_relative_strength_zscore", "y_return_zscore", "body_ratio")
_FQ = "fq AS MATERIALIZED (" + " UNION ALL ".join(f"""SELECT '{f}' feature, count(*) AS "rows", count(*) - count({f}) missing, CAST(0 AS BIGINT) infinite, count({f}) finite, min({f}) low, max({f}) high, count({f}) = 0 all_missing, false constant FROM f4""" for f in _QUALITY) + ")"


@query(Q.rnd(Q.with_(Q.BARS, Q.IDX, _FLOW, _STOCK, _FQ) + "SELECT * FROM fq", low=5, high=5))
def feature_quality(spark, sf):
    return rounded(P.feature_quality(_stock(spark, sf), list(_QUALITY)), 5)


_ROLES = {"candidate": list(_QUALITY), "identifier": ["symbol", "d"], "target": ["future_return", "meta_label"]}
_PATTERNS = ["future", "label", "^target"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{r}')" for r, fs in _ROLES.items() for f in fs) + ") t(feature, role)")
def feature_roles(spark, sf):
    return P.feature_roles(spark, _ROLES)


def _matched(f: str) -> str:
    return "|".join(p for p in _PATTERNS if p.lstrip("^") in f and (p[0] != "^" or f.startswith(p[1:])))


@query("SELECT feature, matched, matched <> '' AS prohibited FROM (VALUES " + ", ".join(f"('{f}', '{_matched(f)}')" for fs in _ROLES.values() for f in fs) + ") t(feature, matched)")
def prohibited_names(spark, sf):
    return P.prohibited_names(P.feature_roles(spark, _ROLES), _PATTERNS)


@query(Q.rnd(Q.with_(Q.BARS, Q.IDX, _FLOW, _STOCK, _FQ) + "SELECT r.feature, role, missing / CAST(\"rows\" AS DOUBLE) missing_fraction, role = 'candidate' approved, CASE role WHEN 'candidate' THEN '' WHEN 'target' THEN 'role:target|prohibited_name|no_quality' ELSE 'role:identifier|no_quality' END reasons FROM (VALUES " + ", ".join(f"('{f}', '{r}')" for r, fs in _ROLES.items() for f in fs) + ") r(feature, role) LEFT JOIN fq ON fq.feature = r.feature", missing_fraction=6))
def feature_approval(spark, sf):
    roles = P.feature_roles(spark, _ROLES)
    return rounded(P.approve_features(roles, P.feature_quality(_stock(spark, sf), list(_QUALITY)), P.prohibited_names(roles, _PATTERNS)))


@query()
def model_feature_schema(spark, sf):
    return P.feature_schema(spark)


# --- zigzag -----------------------------------------------------------------------------------------------------------------------


@query(Q.rnd(Q.with_(Q.BARS, Q.PIVOTS) + "SELECT * FROM piv", price=6))
def zigzag_pivots_confirmed(spark, sf):
    return longs(rounded(Z.confirmed_pivots(V.bars(spark, sf))))


_ZZ = (*Q.BL, Q.ZIGZAG)


@query(Q.rnd(Q.with_(*_ZZ) + "SELECT symbol, d, confirmed_high, confirmed_low, confirmed_high_date, confirmed_low_date, up_dist AS distance_above_confirmed_low_fraction, down_dist AS distance_below_confirmed_high_fraction FROM zs", confirmed_high=6, confirmed_low=6, distance_above_confirmed_low_fraction=6, distance_below_confirmed_high_fraction=6))
def zigzag_state(spark, sf):
    t = Z.zigzag_state(V.bars(spark, sf))
    return rounded(t.select("symbol", "d", "confirmed_high", "confirmed_low", "confirmed_high_date", "confirmed_low_date", "distance_above_confirmed_low_fraction", "distance_below_confirmed_high_fraction"))


_CAND = """
cand AS MATERIALIZED (SELECT CAST(symbol AS VARCHAR) || '::' || strftime(d, '%Y-%m-%d') event_id, * FROM zs WHERE eligible AND up_dist BETWEEN 0 AND 0.15::DOUBLE AND down_dist >= 0.15::DOUBLE)"""


@query(Q.rnd(Q.with_(*_ZZ, _CAND) + 'SELECT event_id, symbol, d, pos, event_end_date, "label" AS meta_label, up_dist AS distance_above_confirmed_low_fraction, down_dist AS distance_below_confirmed_high_fraction FROM cand', distance_above_confirmed_low_fraction=6, distance_below_confirmed_high_fraction=6))
def candidate_events(spark, sf):
    return longs(rounded(Z.candidate_events(V.labeled_state(spark, sf))))


def _thresholds(by_year: bool) -> str:
    y = ', CAST(year(d) AS BIGINT) AS "year"' if by_year else ""
    g = "1, 2" if by_year else "1"
    return f"""SELECT threshold{y}, count(*) candidates, count(*) FILTER ("label" = 1) positive, count(DISTINCT symbol) symbols, count(DISTINCT d) dates, count(*) FILTER ("label" = 1) / CAST(count(*) AS DOUBLE) positive_fraction
  FROM zs JOIN (VALUES (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE)) t(threshold) ON eligible AND up_dist BETWEEN 0 AND threshold AND down_dist >= threshold GROUP BY {g}"""


@query(Q.rnd(Q.with_(*_ZZ) + _thresholds(False), positive_fraction=6))
def threshold_comparison(spark, sf):
    return rounded(Z.threshold_comparison(V.labeled_state(spark, sf)))


@query(Q.rnd(Q.with_(*_ZZ) + _thresholds(True), positive_fraction=6))
def threshold_comparison_by_year(spark, sf):
    return longs(rounded(Z.threshold_comparison(V.labeled_state(spark, sf), by_year=True)))


@query(Q.rnd(Q.with_(*_ZZ, _CAND) + """SELECT symbol, count(*) candidates, count(*) FILTER ("label" = 1) positive, min(d) first_date, max(d) last_date, median(CAST(gap AS DOUBLE)) median_gap_days FROM (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY symbol ORDER BY d), d) gap FROM cand) GROUP BY symbol""", median_gap_days=6))
def candidate_audit(spark, sf):
    return rounded(Z.candidate_audit(Z.candidate_events(V.labeled_state(spark, sf))))


@query(Q.with_(Q.BARS) + "SELECT CAST(symbol AS VARCHAR) symbol, cut, true same FROM bars JOIN (VALUES (120::BIGINT), (250::BIGINT), (400::BIGINT)) t(cut) ON pos = cut")
def prefix_invariance(spark, sf):
    t = Z.prefix_invariance(V.bars(spark, sf), [120, 250, 400], Z.zigzag_state, ["confirmed_high", "confirmed_low", "confirmed_high_date", "distance_above_confirmed_low_fraction"])
    return longs(t)


# --- folds and weights ------------------------------------------------------------------------------------------------------------


@query(Q.with_(*Q.BF) + "SELECT d, CAST(i AS BIGINT) day_index, n AS events FROM cnt")
def calendar_event_counts(spark, sf):
    days = calendar(V.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")))
    return longs(K.event_counts(days, V.events(spark, sf)))


@query(Q.rnd(Q.with_(*Q.BF) + "SELECT * FROM folds", target_events=6))
def fold_boundaries(spark, sf):
    return longs(rounded(V.folds(spark, sf)))


@query(Q.with_(*Q.BF) + 'SELECT event_id, fold_id, "role" FROM mem')
def fold_membership(spark, sf):
    return longs(V.members(spark, sf).select("event_id", "fold_id", "role"))


def _fold_part(r: str) -> str:
    f = f"\"role\" = '{r}'"
    return f"""count(*) FILTER ({f}) {r}_events, count(*) FILTER ({f} AND meta_label = 1) {r}_positive_labels, count(*) FILTER ({f} AND meta_label = 0) {r}_negative_labels, count(DISTINCT CASE WHEN {f} THEN symbol END) {r}_symbols, count(DISTINCT CASE WHEN {f} THEN d END) {r}_unique_event_start_dates,
  CASE WHEN count(*) FILTER ({f}) > 0 THEN count(*) FILTER ({f} AND meta_label = 1) / CAST(count(*) FILTER ({f}) AS DOUBLE) END {r}_positive_fraction"""


@query(Q.rnd(Q.with_(*Q.BF) + f"""SELECT fold_id, count(*) FILTER ("role" IN ('train', 'purged')) historical_events_before_embargo, count(*) FILTER ("role" = 'purged') purged_event_overlap_count, count(*) FILTER ("role" = 'embargo') embargo_candidate_event_count, {_fold_part('train')}, {_fold_part('validation')} FROM mem GROUP BY fold_id""", train_positive_fraction=6, validation_positive_fraction=6))
def fold_summary(spark, sf):
    return longs(rounded(K.fold_summary(V.members(spark, sf))))


@query(Q.with_(*Q.BF) + """SELECT fold_id, CAST(0 AS BIGINT) train_start_after_train_end, CAST(0 AS BIGINT) train_event_end_on_or_after_validation_start, CAST(0 AS BIGINT) validation_before_validation_start, CAST(0 AS BIGINT) validation_after_validation_end,
  count(DISTINCT CASE WHEN "role" = 'train' THEN meta_label END) = 2 train_has_both_classes, count(DISTINCT CASE WHEN "role" = 'validation' THEN meta_label END) = 2 validation_has_both_classes, CAST(0 AS BIGINT) train_event_ids_in_validation, CAST(0 AS BIGINT) train_validation_event_start_date_overlap FROM mem GROUP BY fold_id""")
def fold_integrity(spark, sf):
    return longs(K.fold_integrity(V.members(spark, sf)))


@query(Q.with_(*Q.BF) + "SELECT a.fold_id fold_a, b.fold_id fold_b, a.validation_start_date <= b.validation_end_date AND b.validation_start_date <= a.validation_end_date overlap FROM folds a JOIN folds b ON a.fold_id < b.fold_id")
def fold_overlap(spark, sf):
    return longs(K.validation_overlap(V.folds(spark, sf)))


@query(Q.with_(*Q.BF) + """SELECT a.fold_id, a.fold_id + 1 next_fold_id, count(*) train_events, count(*) - count(b.event_id) missing_in_next FROM mem a LEFT JOIN mem b ON b.event_id = a.event_id AND b.fold_id = a.fold_id + 1 AND b."role" = 'train' WHERE a."role" = 'train' AND a.fold_id < 5 GROUP BY 1""")
def anchored_audit(spark, sf):
    return longs(K.anchored_audit(V.members(spark, sf)))


@query(Q.rnd(Q.with_(*Q.BF) + """, g AS (SELECT f.fold_id, f.target_events, count(m.event_id) actual_candidate_events, count(DISTINCT m.d) validation_unique_start_dates FROM folds f LEFT JOIN mem m ON m.fold_id = f.fold_id AND m."role" = 'validation' GROUP BY 1, 2)
SELECT *, actual_candidate_events - target_events signed_deviation_from_target, avg(actual_candidate_events) OVER () all_fold_event_count_mean, stddev_pop(actual_candidate_events) OVER () all_fold_event_count_std, stddev_pop(actual_candidate_events) OVER () / avg(actual_candidate_events) OVER () all_fold_event_count_cv,
  max(actual_candidate_events) OVER () / CAST(min(actual_candidate_events) OVER () AS DOUBLE) all_fold_max_to_min_ratio FROM g""", target_events=6, signed_deviation_from_target=6, all_fold_event_count_mean=6, all_fold_event_count_std=6, all_fold_event_count_cv=6, all_fold_max_to_min_ratio=6))
def count_balance(spark, sf):
    ev = V.events(spark, sf)
    f = V.folds(spark, sf, ev)
    return longs(rounded(K.count_balance(K.fold_membership(ev, f), f)))


@query(Q.with_(*Q.BF) + """SELECT fold_id, "role" part, meta_label AS "label", count(*) events FROM mem WHERE "role" IN ('train', 'validation') GROUP BY 1, 2, 3""")
def class_balance(spark, sf):
    return longs(K.class_balance(V.members(spark, sf)))


def _uniqueness(source: str, by: str) -> str:
    b = f"{by}, " if by else ""
    on = f"x.{by} = y.{by} AND " if by else ""
    return f"""
un AS MATERIALIZED (SELECT {b}symbol, event_id, pos s, (SELECT pos FROM bars q WHERE q.symbol = e.symbol AND q.d = e.event_end_date) t FROM {source} e),
st AS (SELECT {b}symbol, p, sum(x) x FROM (SELECT {b}symbol, s p, 1 x FROM un UNION ALL SELECT {b}symbol, t + 1, -1 FROM un) GROUP BY ALL),
gr AS (SELECT DISTINCT {b}symbol FROM un),
ln0 AS (SELECT {('gr.' + by + ', ') if by else ''}gr.symbol, bars.pos p, sum(coalesce(x, 0)) OVER (PARTITION BY {('gr.' + by + ', ') if by else ''}gr.symbol ORDER BY bars.pos) cc FROM gr JOIN bars ON bars.symbol = gr.symbol LEFT JOIN st ON {f'st.{by} = gr.{by} AND ' if by else ''}st.symbol = gr.symbol AND st.p = bars.pos),
lns AS MATERIALIZED (SELECT *, sum(CASE WHEN cc > 0 THEN 1.0::DOUBLE / cc ELSE 0 END) OVER (PARTITION BY {b}symbol ORDER BY p) tot FROM ln0),
uq AS (SELECT x.*, (y.tot - coalesce(z.tot, 0)) / (t - s + 1) average_uniqueness FROM un x JOIN lns y ON {on}x.symbol = y.symbol AND y.p = x.t LEFT JOIN lns z ON {on.replace('y.', 'z.')}z.symbol = x.symbol AND z.p = x.s - 1),
uw AS MATERIALIZED (SELECT *, average_uniqueness / avg(average_uniqueness) OVER ({f'PARTITION BY {by}' if by else ''}) sample_weight FROM uq)"""


_TRAIN = "\ntr AS MATERIALIZED (SELECT * FROM mem WHERE \"role\" = 'train')"
_UQ = "count(*) events, min(average_uniqueness) min_uniqueness, avg(average_uniqueness) mean_uniqueness, median(average_uniqueness) median_uniqueness, max(average_uniqueness) max_uniqueness, sum(sample_weight) * sum(sample_weight) / sum(sample_weight * sample_weight) effective_sample_size, sum(sample_weight) * sum(sample_weight) / sum(sample_weight * sample_weight) / count(*) effective_fraction"
_UQ_ROUND = dict.fromkeys(("min_uniqueness", "mean_uniqueness", "median_uniqueness", "max_uniqueness", "effective_fraction"), 6) | {"effective_sample_size": 4}


@query(Q.rnd(Q.with_(*Q.BE, _uniqueness("ev", "")) + "SELECT event_id, average_uniqueness, sample_weight FROM uw", average_uniqueness=9, sample_weight=9))
def average_uniqueness(spark, sf):
    return rounded(K.average_uniqueness(V.events(spark, sf), V.bars(spark, sf)).select("event_id", "average_uniqueness", "sample_weight"), 9)


@query(Q.rnd(Q.with_(*Q.BF, _TRAIN, _uniqueness("tr", "fold_id")) + f"SELECT fold_id, {_UQ} FROM uw GROUP BY 1", **_UQ_ROUND))
def uniqueness_audit(spark, sf):
    train = V.members(spark, sf).filter("role = 'train'")
    return longs(rounded(K.uniqueness_summary(K.average_uniqueness(train, V.bars(spark, sf), ("fold_id",)), "fold_id"), effective_sample_size=4))


@query(Q.rnd(Q.with_(*Q.BE, _uniqueness("ev", "")) + f"SELECT symbol, {_UQ} FROM uw GROUP BY 1", **_UQ_ROUND))
def kish_effective_size(spark, sf):
    return rounded(K.uniqueness_summary(K.average_uniqueness(V.events(spark, sf), V.bars(spark, sf)), "symbol"), effective_sample_size=4)


# --- policy and metrics -----------------------------------------------------------------------------------------------------------


@query(Q.rnd(Q.with_(*Q.BE) + """, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol, event_id) rk, count(*) OVER (PARTITION BY d) n FROM ev), q AS (SELECT *, CAST(least(n, greatest(1, ceil(0.05::DOUBLE * n))) AS BIGINT) quota FROM r)
SELECT event_id, n AS daily_candidate_count, rk AS daily_rank, quota AS daily_signal_quota, rk <= quota AS selected, min(CASE WHEN rk <= quota THEN score END) OVER (PARTITION BY d) daily_score_cutoff FROM q""", daily_score_cutoff=6))
def daily_top_fraction(spark, sf):
    t = S.daily_top_fraction(V.events(spark, sf))
    return longs(rounded(t.select("event_id", "daily_candidate_count", "daily_rank", "daily_signal_quota", "selected", "daily_score_cutoff")))


_FRACTIONS = (0.05, 0.1, 0.2)
_POLICY = """
val AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fold_id, d ORDER BY score DESC, symbol, event_id) rk, count(*) OVER (PARTITION BY fold_id, d) nd FROM mem WHERE "role" = 'validation'),
pf AS MATERIALIZED (SELECT fraction, fold_id, count(*) candidates, count(*) FILTER (sel) signals, count(*) FILTER (meta_label = 1) positives, count(*) FILTER (sel AND meta_label = 1) tp, count(*) FILTER (NOT sel AND meta_label = 0) tn FROM
  (SELECT *, rk <= least(nd, greatest(1, ceil(fraction * nd))) sel FROM val, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(fraction)) GROUP BY 1, 2),
pm AS MATERIALIZED (SELECT *, tp / CAST(signals AS DOUBLE) "precision", positives / CAST(candidates AS DOUBLE) base_rate, tp / CAST(signals AS DOUBLE) - positives / CAST(candidates AS DOUBLE) precision_lift, (tp / CAST(signals AS DOUBLE)) / (positives / CAST(candidates AS DOUBLE)) precision_ratio, tp / CAST(positives AS DOUBLE) sensitivity, tn / CAST(candidates - positives AS DOUBLE) specificity FROM pf),
ps AS MATERIALIZED (SELECT fraction, count(*) folds, CAST(sum(signals) AS BIGINT) signals, min(precision_lift) worst_lift, avg(precision_lift) mean_lift, avg(specificity) mean_specificity, avg("precision") mean_precision FROM pm WHERE fold_id <= 4 GROUP BY 1)"""


@query(Q.rnd(Q.with_(*Q.BF, _POLICY) + "SELECT * FROM pm", precision=6, base_rate=6, precision_lift=6, precision_ratio=6, sensitivity=6, specificity=6))
def signal_metrics_by_fold(spark, sf):
    return longs(rounded(S.policy_by_fold(V.oof(spark, sf), _FRACTIONS)))


_PS_ROUND = dict.fromkeys(("worst_lift", "mean_lift", "mean_specificity", "mean_precision"), 6)


@query(Q.rnd(Q.with_(*Q.BF, _POLICY) + "SELECT * FROM ps", **_PS_ROUND))
def policy_summary(spark, sf):
    return rounded(S.policy_summary(S.policy_by_fold(V.oof(spark, sf), _FRACTIONS), (1, 2, 3, 4)))


@query(Q.rnd(Q.with_(*Q.BF, _POLICY) + """, e AS (SELECT *, signals >= 250 AND worst_lift >= -1.0::DOUBLE ok FROM ps), b AS (SELECT *, ok AND worst_lift >= max(CASE WHEN ok THEN worst_lift END) OVER () - 0.005::DOUBLE in_band FROM e),
k AS (SELECT * EXCLUDE (ok), CASE WHEN in_band THEN row_number() OVER (PARTITION BY in_band ORDER BY mean_lift DESC, mean_specificity DESC, fraction) END selection_rank FROM b) SELECT *, coalesce(selection_rank = 1, false) chosen FROM k""", **_PS_ROUND))
def policy_selected(spark, sf):
    s = S.policy_summary(S.policy_by_fold(V.oof(spark, sf), _FRACTIONS), (1, 2, 3, 4))
    return longs(rounded(S.choose_policy(s, min_lift=-1.0)))


_CM = """
pr AS MATERIALIZED (SELECT fold_id, event_id, meta_label y, score p FROM mem WHERE "role" = 'validation'),
rk AS (SELECT *, rank() OVER (PARTITION BY fold_id ORDER BY p) + (count(*) OVER (PARTITION BY fold_id, p) - 1) / 2.0::DOUBLE ar FROM pr),
sc AS (SELECT fold_id, p, count(*) n, count(*) FILTER (y = 1) k FROM pr GROUP BY 1, 2),
ap AS (SELECT fold_id, sum(k / CAST(tot AS DOUBLE) * tops / alls) ap FROM (SELECT *, sum(k) OVER (PARTITION BY fold_id) tot, sum(k) OVER (PARTITION BY fold_id ORDER BY p DESC) tops, sum(n) OVER (PARTITION BY fold_id ORDER BY p DESC) alls FROM sc) GROUP BY 1),
c0 AS (SELECT fold_id, count(*) AS "rows", count(*) FILTER (y = 1) positives, count(*) FILTER (y = 0) negatives, avg(-ln(CASE WHEN y = 1 THEN greatest(p, 2.220446049250313e-16::DOUBLE) ELSE 1 - p END)) log_loss, avg((p - y) * (p - y)) brier_score, CAST(count(*) FILTER (p >= 0.5 AND y = 1) AS DOUBLE) tp, CAST(count(*) FILTER (p >= 0.5 AND y = 0) AS DOUBLE) fp,
  CAST(count(*) FILTER (p < 0.5 AND y = 0) AS DOUBLE) tn, CAST(count(*) FILTER (p < 0.5 AND y = 1) AS DOUBLE) fn, (sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) roc_auc FROM rk GROUP BY 1),
cm AS MATERIALIZED (SELECT c0.*, ap average_precision, (tp + tn) / "rows" accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 balanced_accuracy, tp / (tp + fp) "precision", tp / (tp + fn) recall, tn / (tn + fp) specificity, 2 * tp / (2 * tp + fp + fn) f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) mcc FROM c0 JOIN ap USING (fold_id)),
ece AS MATERIALIZED (SELECT fold_id, sum(n * abs(y - q)) / sum(n) ece FROM (SELECT fold_id, b, count(*) n, avg(y) y, avg(p) q FROM (SELECT *, ntile(10) OVER (PARTITION BY fold_id ORDER BY p, event_id) b FROM pr) GROUP BY 1, 2) GROUP BY 1)"""
_CM_ROUND = dict.fromkeys(("log_loss", "brier_score", "roc_auc", "average_precision", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "mcc"), 6)


@query(Q.rnd(Q.with_(*Q.BF, _CM) + "SELECT * FROM cm", **_CM_ROUND))
def classification_metrics(spark, sf):
    return longs(rounded(M.classification_metrics(V.oof(spark, sf), "fold_id", label="meta_label", p="score")))


@query(Q.rnd(Q.with_(*Q.BF, _CM) + "SELECT * FROM ece", ece=6))
def ece(spark, sf):
    return longs(rounded(M.calibration_error(V.oof(spark, sf), "fold_id", label="meta_label", p="score")))


@query(Q.rnd(Q.with_(*Q.BF, _CM) + 'SELECT cm.fold_id, "rows", roc_auc, average_precision, log_loss, brier_score, ece FROM cm JOIN ece USING (fold_id)', roc_auc=6, average_precision=6, log_loss=6, brier_score=6, ece=6))
def probability_metrics(spark, sf):
    return longs(rounded(M.probability_metrics(V.oof(spark, sf), "fold_id", label="meta_label", p="score")))


@query(Q.rnd(Q.with_(*Q.BF, _CM) + "SELECT 'pseudo' model, count(*) folds, avg(roc_auc) mean_auc, stddev_pop(roc_auc) std_auc, min(roc_auc) min_auc, max(roc_auc) max_auc FROM cm", mean_auc=6, std_auc=6, min_auc=6, max_auc=6))
def fold_auc_summary(spark, sf):
    m = M.classification_metrics(V.oof(spark, sf), "fold_id", label="meta_label", p="score").withColumn("model", F.lit("pseudo"))
    return rounded(M.fold_auc_summary(m, "model"))


@query(Q.rnd(Q.with_(*Q.BF, _CM) + """SELECT 'pseudo' model, count(*) folds, CAST(sum("rows") AS BIGINT) events, avg(roc_auc) mean_roc_auc, avg(average_precision) mean_average_precision, avg(log_loss) mean_log_loss, avg(brier_score) mean_brier_score, avg(mcc) mean_mcc, avg(f1) mean_f1, stddev_pop(roc_auc) std_roc_auc, stddev_pop(average_precision) std_average_precision, stddev_pop(log_loss) std_log_loss, stddev_pop(brier_score) std_brier_score, stddev_pop(mcc) std_mcc, stddev_pop(f1) std_f1 FROM cm""", **{f"{s}_{m}": 6 for s in ("mean", "std") for m in ("roc_auc", "average_precision", "log_loss", "brier_score", "mcc", "f1")}))
def model_summary(spark, sf):
    m = M.classification_metrics(V.oof(spark, sf), "fold_id", label="meta_label", p="score").withColumn("model", F.lit("pseudo"))
    return rounded(M.model_summary(m, "model"))


@query(Q.with_(*Q.BE) + "SELECT CAST(0 AS BIGINT) violations, true non_decreasing")
def calibration_monotone(spark, sf):
    t = V.events(spark, sf).withColumn("mapped", 1.0 / (1.0 + F.exp(-X.logit("score"))))
    return M.non_decreasing(t, "score", "mapped")


_TRIALS = [(i, 0.54 + ((i * 37) % 11) / 1000, 0.48 + ((i * 53) % 13) / 1000, 0.05 + ((i * 29) % 7) / 1000) for i in range(30)]


@query(Q.rnd("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {Q.lit(a)}, {Q.lit(b)}, {Q.lit(c)})" for i, a, b, c in _TRIALS) + """) t(trial, mean_auc, min_auc, std_auc)), b AS (SELECT *, mean_auc >= max(mean_auc) OVER () - 0.005::DOUBLE in_band FROM t),
k AS (SELECT *, CASE WHEN in_band THEN row_number() OVER (PARTITION BY in_band ORDER BY min_auc DESC, std_auc, trial) END selection_rank FROM b) SELECT *, coalesce(selection_rank = 1, false) chosen FROM k""", mean_auc=6, min_auc=6, std_auc=6))
def hierarchical_ranking(spark, sf):
    return longs(rounded(S.near_best_ranking(spark.createDataFrame(_TRIALS, "trial long, mean_auc double, min_auc double, std_auc double"))))


@query(Q.with_(*Q.BE) + """SELECT count(*) AS "rows", CAST(0 AS BIGINT) differing FROM ev""")
def rerank_reconstruction(spark, sf):
    return S.rerank_matches(S.daily_top_fraction(V.events(spark, sf)).select("event_id", "symbol", "d", "score", "selected"), fraction=0.05)


# --- breadth ----------------------------------------------------------------------------------------------------------------------


def _universe(spark, sf) -> int:
    return V.table(spark, sf, "lineitem").select("l_suppkey").distinct().count()


def _breadth(spark, sf):
    return R.market_breadth(V.bars(spark, sf), _universe(spark, sf))


_BR_ROUND = {"coverage": 6, "raw_breadth": 6, "breadth_ema": 6, "breadth_slope": 6}


@query(Q.rnd(Q.with_(Q.BARS, Q.breadth()) + "SELECT d, positive, negative, unchanged, valid, priced, coverage, raw_breadth, breadth_ema, breadth_slope, regime FROM br", **_BR_ROUND))
def market_breadth_daily(spark, sf):
    return rounded(_breadth(spark, sf))


_PANEL = """
pn AS MATERIALIZED (SELECT ev.*, br.regime, br.raw_breadth, CAST(year(ev.d) AS BIGINT) yr, (ev.symbol + ev.pos) % 5 started FROM ev LEFT JOIN br ON br.d = ev.d)"""
_EO = """count(DISTINCT d) dates, count(*) events, count(*) FILTER (meta_label = 1) positive_events, count(*) FILTER (meta_label = 0) negative_events, avg(meta_label) positive_rate, avg(score) mean_score, avg(event_return) mean_event_return, median(event_return) median_event_return, avg(event_return) FILTER (event_return > 0) average_positive_return, avg(event_return) FILTER (event_return < 0) average_negative_return,
  avg(event_return) FILTER (event_return > 0) / abs(avg(event_return) FILTER (event_return < 0)) payoff_ratio, CASE WHEN -sum(event_return) FILTER (event_return < 0) > 0 THEN coalesce(sum(event_return) FILTER (event_return > 0), 0) / -sum(event_return) FILTER (event_return < 0) END profit_factor"""
_EO_ROUND = dict.fromkeys(("positive_rate", "mean_score", "mean_event_return", "median_event_return", "average_positive_return", "average_negative_return", "payoff_ratio", "profit_factor"), 6)


def _panel(spark, sf):
    t = V.events(spark, sf).join(F.broadcast(_breadth(spark, sf).select("d", "regime", "raw_breadth")), "d", "left")
    return t.withColumn("started", (F.col("symbol") + F.col("pos")) % 5).withColumn("year", F.year("d"))


@query(Q.rnd(Q.with_(*Q.BE, Q.breadth(), _PANEL) + f"SELECT regime, {_EO} FROM pn GROUP BY 1", **_EO_ROUND))
def regime_metrics(spark, sf):
    return rounded(R.event_outcomes(_panel(spark, sf), "regime"))


@query(Q.rnd(Q.with_(*Q.BE, Q.breadth(), _PANEL) + f"SELECT CASE WHEN raw_breadth >= -1 AND raw_breadth < -0.5 THEN '[-1, -0.5)' WHEN raw_breadth < 0 AND raw_breadth >= -0.5 THEN '[-0.5, 0)' WHEN raw_breadth >= 0 AND raw_breadth < 0.5 THEN '[0, 0.5)' WHEN raw_breadth >= 0.5 AND raw_breadth <= 1 THEN '[0.5, 1]' END bin, {_EO} FROM pn GROUP BY 1", **_EO_ROUND))
def breadth_bins(spark, sf):
    return rounded(R.event_outcomes(_panel(spark, sf).withColumn("bin", R.half_open_bins("raw_breadth", [-1.0, -0.5, 0.0, 0.5, 1.0])), "bin"))


_VAR = """
vr AS (SELECT v variant, pn.* FROM pn, (VALUES ('baseline'), ('started_1_to_3'), ('recovery'), ('deterioration'), ('started_1_to_3_and_recovery'), ('started_1_to_3_and_deterioration')) t(v)
  WHERE CASE v WHEN 'baseline' THEN true WHEN 'started_1_to_3' THEN started BETWEEN 1 AND 3 WHEN 'recovery' THEN regime = 'recovery' WHEN 'deterioration' THEN regime = 'deterioration' WHEN 'started_1_to_3_and_recovery' THEN started BETWEEN 1 AND 3 AND regime = 'recovery' ELSE started BETWEEN 1 AND 3 AND regime = 'deterioration' END),
vk AS (SELECT *, row_number() OVER (PARTITION BY variant, d ORDER BY score DESC, symbol, event_id) rk, count(*) OVER (PARTITION BY variant, d) nd FROM vr),
vs AS MATERIALIZED (SELECT 'candidate_population' scope, * FROM vk UNION ALL SELECT 'daily_top_selected', * FROM vk WHERE rk <= least(nd, greatest(1, ceil(0.05::DOUBLE * nd)))),
vg AS (SELECT v variant, s scope FROM (VALUES ('baseline'), ('started_1_to_3'), ('recovery'), ('deterioration'), ('started_1_to_3_and_recovery'), ('started_1_to_3_and_deterioration')) t(v), (VALUES ('candidate_population'), ('daily_top_selected')) u(s))"""
_ZERO = "coalesce(dates, 0) dates, coalesce(events, 0) events, coalesce(positive_events, 0) positive_events, coalesce(negative_events, 0) negative_events"


@query(Q.rnd(Q.with_(*Q.BE, Q.breadth(), _PANEL, _VAR) + f"SELECT * REPLACE ({_ZERO.replace(') ', ') AS ')}) FROM vg LEFT JOIN (SELECT variant, scope, {_EO} FROM vs GROUP BY 1, 2) USING (variant, scope)", **_EO_ROUND))
def variant_summary(spark, sf):
    p = _panel(spark, sf)
    return rounded(R.on_grid(R.event_outcomes(R.variant_populations(p), "variant", "scope"), R.variant_grid(p), ["variant", "scope"]))


@query(Q.rnd(Q.with_(*Q.BE, Q.breadth(), _PANEL, _VAR) + f"""SELECT * REPLACE ({_ZERO.replace(') ', ') AS ')}) FROM (SELECT * FROM vg, (VALUES (1998::BIGINT), (1999::BIGINT), (2000::BIGINT), (2001::BIGINT)) t("year")) LEFT JOIN (SELECT variant, scope, yr AS "year", {_EO} FROM vs GROUP BY 1, 2, 3) USING (variant, scope, "year")""", **_EO_ROUND))
def yearly_variants(spark, sf):
    p = _panel(spark, sf)
    t = R.event_outcomes(R.variant_populations(p), "variant", "scope", "year")
    return longs(rounded(R.on_grid(t, R.variant_grid(p, [1998, 1999, 2000, 2001]), ["variant", "scope", "year"])))


_LEFT, _RIGHT = ["raw_breadth", "breadth_ema", "breadth_slope"], list(P.MARKET_FEATURES)
_CORR = """
dl AS MATERIALIZED (SELECT br.d, """ + ", ".join([*_LEFT, *_RIGHT]) + """, CASE WHEN br.d <= DATE '1999-12-31' THEN 'train' WHEN br.d <= DATE '2001-06-30' THEN 'unseen_test' ELSE 'gap' END part FROM br JOIN market ON market.d = br.d),
sp AS (SELECT part scope, * FROM dl WHERE part <> 'gap' UNION ALL SELECT 'full', * FROM dl),
lr AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT scope, '{a}' breadth_feature, '{b}' market_feature, {a} x, {b} y FROM sp WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in _LEFT for b in _RIGHT) + ")"


def _daily(spark, sf):
    market = P.market_regime(V.index(spark, sf)).select("d", *_RIGHT)
    t = R.join_daily(_breadth(spark, sf), market)
    return t.withColumn("partition", F.when(F.col("d") <= F.lit(B.Boundaries().train_end), "train").when(F.col("d") <= F.lit(B.Boundaries().test_end), "unseen_test").otherwise("gap"))


@query(Q.rnd(Q.with_(Q.BARS, Q.MARKET, Q.breadth(), _CORR) + "SELECT scope AS \"partition\", 'pearson' AS method, breadth_feature, market_feature, count(*) paired_dates, corr(x, y) correlation FROM lr GROUP BY 1, 3, 4", correlation=6))
def corr_pearson(spark, sf):
    return rounded(M.correlations(_daily(spark, sf), _LEFT, _RIGHT))


@query(Q.rnd(Q.with_(Q.BARS, Q.MARKET, Q.breadth(), _CORR) + """, g AS (SELECT *, rank() OVER (PARTITION BY scope, breadth_feature, market_feature ORDER BY x) + (count(*) OVER (PARTITION BY scope, breadth_feature, market_feature, x) - 1) / 2.0::DOUBLE rx, rank() OVER (PARTITION BY scope, breadth_feature, market_feature ORDER BY y) + (count(*) OVER (PARTITION BY scope, breadth_feature, market_feature, y) - 1) / 2.0::DOUBLE ry FROM lr)
SELECT scope AS "partition", 'spearman' AS method, breadth_feature, market_feature, count(*) paired_dates, corr(rx, ry) correlation FROM g GROUP BY 1, 3, 4""", correlation=4))
def corr_spearman(spark, sf):
    return rounded(M.correlations(_daily(spark, sf), _LEFT, _RIGHT, method="spearman"), 4)


# --- filtered signals -------------------------------------------------------------------------------------------------------------


_AGAIN = """
lk AS MATERIALIZED (SELECT *, (symbol + pos) % 5 started, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol, event_id) <= least(count(*) OVER (PARTITION BY d), greatest(1, ceil(0.05::DOUBLE * count(*) OVER (PARTITION BY d)))) was FROM ev),
ag0 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol, event_id) rk, count(*) OVER (PARTITION BY d) n FROM lk WHERE started <> 0),
ag AS MATERIALIZED (SELECT *, CAST(least(n, greatest(1, ceil(0.05::DOUBLE * n))) AS BIGINT) quota FROM ag0)"""


def _started(spark, sf):
    """Locked candidates with started, a small number of their symbol and day."""
    ev = V.events(spark, sf)
    return N.with_started(S.daily_top_fraction(ev), ev.select("symbol", "d", ((F.col("symbol") + F.col("pos")) % 5).alias("started")))


@query(Q.with_(*Q.BE, _AGAIN) + "SELECT event_id, was AS locked_selected, n AS daily_candidate_count, rk AS daily_rank, quota AS daily_signal_quota, rk <= quota AS selected FROM ag")
def filtered_rerank(spark, sf):
    t = N.filter_then_rerank(_started(spark, sf), N.nonzero())
    return longs(t.select("event_id", "locked_selected", "daily_candidate_count", "daily_rank", "daily_signal_quota", "selected"))


@query(Q.rnd(Q.with_(*Q.BE, _AGAIN) + """SELECT d, locked_candidates, kept_candidates, locked_signals, coalesce(signals, 0) signals, score_cutoff, kept_candidates = 0 day_without_candidates
FROM (SELECT d, count(*) locked_candidates, count(*) FILTER (started <> 0) kept_candidates, count(*) FILTER (was) locked_signals FROM lk GROUP BY d) LEFT JOIN (SELECT d, count(*) signals, min(score) score_cutoff FROM ag WHERE rk <= quota GROUP BY d) USING (d)""", score_cutoff=6))
def rerank_date_audit(spark, sf):
    locked = _started(spark, sf)
    return rounded(N.rerank_audit(locked, N.nonzero(), N.filter_then_rerank(locked, N.nonzero())))


@query(Q.with_(*Q.BE, _AGAIN) + """SELECT symbol, count(*) joined_events, count(*) FILTER (started = 0) started_equal_zero, count(*) FILTER (started <> 0) started_nonzero, count(*) FILTER (started = 1) started_equal_one, count(*) FILTER (started > 1) started_greater_than_one,
  count(*) FILTER (started < 0) started_less_than_zero, min(started) minimum_started, max(started) maximum_started FROM lk GROUP BY symbol""")
def started_audit(spark, sf):
    return N.started_audit(_started(spark, sf), "symbol")


@query(Q.rnd(Q.with_(*Q.BF) + """SELECT fold_id, count(*) events, count(DISTINCT d) dates, min(d) first_signal_date, max(d) last_signal_date, avg(meta_label) positive_fraction, min(score) minimum_raw_score, avg(score) mean_raw_score, max(score) maximum_raw_score,
  CAST(count(*) FILTER (NOT isfinite(score)) AS BIGINT) nonfinite_scores, count(*) - count(DISTINCT event_id) duplicate_event_ids FROM mem WHERE "role" = 'validation' GROUP BY fold_id""", positive_fraction=6, minimum_raw_score=6, mean_raw_score=6, maximum_raw_score=6))
def oof_audit(spark, sf):
    return longs(rounded(N.oof_audit(V.oof(spark, sf))))


@query(Q.with_(Q.BARS) + f"""SELECT symbol, p AS "partition", count(*) AS "rows", min(d) first_date, max(d) last_date FROM (SELECT *, {_PART} p FROM bars) WHERE p <> 'after' GROUP BY 1, 2""")
def warm_up_history(spark, sf):
    split = B.calendar_split(V.bars(spark, sf))
    t = N.with_warm_up(split.filter("part <> 'after' and part = 'train'"), split.filter("part = 'unseen_test'"), B.Boundaries().test_end)
    return t.groupBy("symbol", "partition").agg(F.count(F.lit(1)).alias("rows"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))


@query(Q.with_(Q.BARS, Q.PIVOTS) + """SELECT symbol, count(*) pivots, min(confirm - "pivot") least_lag, max(confirm - "pivot") greatest_lag, count(*) FILTER (confirm - "pivot" < 16) early FROM piv GROUP BY symbol""")
def pivot_confirmation_audit(spark, sf):
    return longs(Z.confirmation_audit(V.bars(spark, sf)))


_FRAME_EMAS = {f"e{n}": n for n in sorted({*P.EMA_WINDOWS, 26})}
_FRAME = Q.ema("fe", "bars", "symbol", "d", "c", _FRAME_EMAS) + """,
mv AS (SELECT symbol, d, c - lag(c) OVER (PARTITION BY symbol ORDER BY d) m FROM bars),
rs0 AS (SELECT symbol, d, CASE WHEN count(m) OVER w = 14 THEN avg(greatest(m, 0.0::DOUBLE)) OVER w END up, CASE WHEN count(m) OVER w = 14 THEN avg(greatest(-m, 0.0::DOUBLE)) OVER w END dn FROM mv WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING)),
ff AS MATERIALIZED (SELECT b.symbol, b.d, """ + ", ".join(f"(b.c - e{n}) / b.c ema_{n}_distance" for n in P.EMA_WINDOWS) + """, CASE WHEN up + dn > 0 THEN (100.0::DOUBLE * up / (up + dn) - 50) / 50 END rsi_14_centered, (e12 - e26) / b.c macd_relative,
  log_power_of_buy, log_volume_ratio_30, ho_buy_fraction, ho_sell_fraction, x_relative_strength_zscore, y_return_zscore, ln(1.0::DOUBLE + positive_rs_run_length) log_positive_rs_run_length, body_ratio, """ + ", ".join(P.MARKET_FEATURES) + """,
  up_dist distance_above_confirmed_low_fraction, down_dist distance_below_confirmed_high_fraction,
  CASE WHEN e60 IS NULL THEN NULL WHEN least(""" + ", ".join(f"e{n}" for n in P.SHORT_EMAS) + ") > greatest(" + ", ".join(f"e{n}" for n in P.LONG_EMAS) + ") THEN 'bullish' WHEN greatest(" + ", ".join(f"e{n}" for n in P.SHORT_EMAS) + ") < least(" + ", ".join(f"e{n}" for n in P.LONG_EMAS) + """) THEN 'bearish' ELSE 'mixed' END gmma_state
  FROM bars b JOIN fe ON fe.symbol = b.symbol AND fe.d = b.d JOIN rs0 ON rs0.symbol = b.symbol AND rs0.d = b.d JOIN f4 ON f4.symbol = b.symbol AND f4.d = b.d JOIN zs ON zs.symbol = b.symbol AND zs.d = b.d LEFT JOIN market ON market.d = b.d)"""


@query(Q.rnd(Q.with_(*Q.BL, Q.MARKET, _FLOW, _STOCK, Q.ZIGZAG, _FRAME) + "SELECT * FROM ff", **dict.fromkeys(P.NUMERIC_FEATURES, 5)))
def model_feature_frame(spark, sf):
    """All model features of every bar in one frame."""
    return rounded(V.feature_frame(spark, sf), 5)


# --- sets and audits --------------------------------------------------------------------------------------------------------------


@query(Q.with_(*Q.BE) + "SELECT count(*) FILTER (barrier_touched = 'upper') only_left, count(*) FILTER (barrier_touched = 'vertical') only_right FROM ev")
def semi_anti_population(spark, sf):
    ev = V.events(spark, sf)
    return E.population_difference(ev.filter("barrier_touched in ('upper', 'lower')"), ev.filter("barrier_touched in ('lower', 'vertical')"), ["event_id"])


@query("""WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) d FROM lineitem), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders)
SELECT 'union_all' AS op, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) n UNION ALL SELECT 'union', count(*) FROM (SELECT d FROM a UNION SELECT d FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT d FROM a INTERSECT SELECT d FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT d FROM a EXCEPT SELECT d FROM b)""")
def set_ops_audit(spark, sf):
    a = V.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    b = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    count = lambda name, t: t.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("union_all", a.unionByName(b)).unionByName(count("union", a.unionByName(b).distinct())).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", a.subtract(b)))


@query(Q.with_(*Q.BE) + """SELECT symbol, d, CAST(date_diff('day', lag(d) OVER (PARTITION BY symbol ORDER BY d), d) AS BIGINT) gap_days FROM ev""")
def event_date_gaps(spark, sf):
    return longs(date_gaps(V.events(spark, sf).select("symbol", "d")))


@query(Q.with_(*Q.BE) + """SELECT 'event id' expectation, CAST(0 AS BIGINT) violations UNION ALL SELECT 'end not before start', CAST(0 AS BIGINT) UNION ALL SELECT 'score above one half', (SELECT count(*) FROM ev WHERE NOT score > 0.5)""")
def expectation_report(spark, sf):
    ev = V.events(spark, sf)
    return E.violations(ev, {"event id": F.col("event_id").isNotNull(), "end not before start": F.col("event_end_date") >= F.col("d"), "score above one half": F.col("score") > 0.5})


@query(Q.with_(*Q.BE) + """SELECT d, count(*) events, CAST(sum(meta_label) AS BIGINT) positive, min(event_id) first_event FROM ev GROUP BY d""")
def date_audit(spark, sf):
    return V.events(spark, sf).groupBy("d").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("meta_label").cast("long")).alias("positive"), F.min("event_id").alias("first_event"))


@query(Q.with_(*Q.BE) + """SELECT count(*) AS "rows", count(DISTINCT event_id) event_ids, count(DISTINCT symbol) symbols, count(DISTINCT d) dates, count(*) FILTER (score IS NULL) null_scores, count(*) - count(DISTINCT event_id) duplicates FROM ev""")
def panel_audit(spark, sf):
    return V.events(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("event_ids"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("d").alias("dates"), F.count_if(F.col("score").isNull()).alias("null_scores"), (F.count(F.lit(1)) - F.countDistinct("event_id")).alias("duplicates"))

