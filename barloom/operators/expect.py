"""Contracts on tables: required columns, and expectations that are counted in one pass and raised together."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def violations(df: DataFrame, expectations: Mapping[str, Column]) -> DataFrame:
    """(expectation, violations): how many rows don't meet each predicate; a null counts as not met."""
    names = list(expectations)
    counts = df.agg(*[F.count_if(~F.coalesce(expectations[n], F.lit(False))).alias(f"_{i}") for i, n in enumerate(names)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("expectation"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(names)])))


def enforce(df: DataFrame, expectations: Mapping[str, Column], examples: int = 10) -> DataFrame:
    """df, or ValueError with the number of violations of each expectation and the first few rows."""
    broken = [r for r in violations(df, expectations).collect() if r.violations]
    if broken:
        bad = ~F.coalesce(expectations[broken[0].expectation], F.lit(False))
        raise ValueError(f"{ {r.expectation: r.violations for r in broken} }; first rows: {df.filter(bad).limit(examples).collect()}")
    return df


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def population_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(only_left, only_right): number of distinct keys on one side only; both 0 for equal populations."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    left = x.join(y, keys, "left_anti").agg(F.count(F.lit(1)).alias("only_left"))
    right = y.join(x, keys, "left_anti").agg(F.count(F.lit(1)).alias("only_right"))
    return left.join(right)


EVENT_COLUMNS = ("event_id", "symbol", "d", "event_end_date", "meta_label")


def normalize_events(panel: DataFrame) -> DataFrame:
    """Candidate events with checked types: dates, binary label, end not before start, unique ids."""
    require_columns(panel, EVENT_COLUMNS)
    out = panel.withColumns({"event_id": F.col("event_id").cast("string"), "d": F.col("d").cast("date"), "event_end_date": F.col("event_end_date").cast("date"), "meta_label": F.col("meta_label").cast("int")})
    enforce(out, {"event id": F.col("event_id").isNotNull(), "dates": F.col("d").isNotNull() & F.col("event_end_date").isNotNull(), "binary label": F.col("meta_label").isin(0, 1), "end not before start": F.col("event_end_date") >= F.col("d")})
    twice = unique_key(out, ["event_id"]).limit(10).collect()
    if twice:
        raise ValueError(f"event ids occur more than once: {twice}")
    return out
