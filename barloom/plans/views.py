"""Inputs of the registered queries, derived from the given tables, and the stages built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import features as P
from barloom.operators import folds as K
from barloom.operators import labeling as L
from barloom.operators import zigzag as Z
from barloom.operators.sequence import calendar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded for comparison, in the final projection only."""
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def longs(df: DataFrame, *keep_int: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" and c not in keep_int else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_lines(table(spark, sf_dir, "lineitem"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.triple_barrier(bars(spark, sf_dir))


def pseudo_score(symbol: str = "symbol", pos: str = "pos") -> Column:
    """Deterministic stand-in for a model's score."""
    return ((F.col(symbol) * 7919 + F.col(pos).cast("long") * 104729) % 10007) / 10007.0


def event_id() -> Column:
    return F.concat_ws("::", F.col("symbol").cast("string"), F.date_format("d", "yyyy-MM-dd"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eligible bar as an event with its interval, label, return and score."""
    t = labels(spark, sf_dir).filter("eligible_for_modeling")
    return t.select(event_id().alias("event_id"), "symbol", "d", "pos", "event_end_date", F.col("label").alias("meta_label"), "event_return", "barrier_touched", "holding_period_observations", pseudo_score().alias("score"))


def folds(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = events(spark, sf_dir) if ev is None else ev
    days = calendar(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")))
    return K.build_folds(spark, K.event_counts(days, ev))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return K.fold_membership(ev, folds(spark, sf_dir, ev))


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows of all folds, with a score as if predicted out of fold."""
    return members(spark, sf_dir).filter("role = 'validation'")


def labeled_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.zigzag_state(labels(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.canonical_index(B.index_observations(bars(spark, sf_dir)))


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, d, all model features) of every bar."""
    days = index(spark, sf_dir)
    panel = P.with_indicators(Z.zigzag_state(bars(spark, sf_dir))).join(P.raw_flow(table(spark, sf_dir, "lineitem")), ["symbol", "d"]).join(F.broadcast(days.select("d", "index_close")), "d")
    return P.with_market(P.stock_features(panel), P.market_regime(days)).select("symbol", "d", *P.MODEL_FEATURES)
