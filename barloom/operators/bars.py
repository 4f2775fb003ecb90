"""Daily bars: derivation from trade lines, hygiene, quality flags, calendar split, universe freeze, canonical market index."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import by_symbol, finite, finite_positive, keep_last, market_date, number, valid_ohlc

PRICES = ("adj_open", "adj_high", "adj_low", "adj_last_price")


def bars_from_lines(lines: DataFrame) -> DataFrame:
    """One bar for each supplier (symbol) and ship date, priced by a running sum of discounts, so no sum's order matters.

    Lines are dealt by symbol once; the aggregation by day and every later window by symbol use that exchange.
    """
    day = (
        lines.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"), "l_discount", "l_quantity", "l_tax")
        .repartition("symbol")
        .groupBy("symbol", "d")
        .agg(
            F.sum(F.round(F.col("l_discount") * 100.0).cast("int") - 5).cast("long").alias("k"),
            F.sum(F.col("l_quantity").cast("long")).alias("vol"),
            F.sum(F.round(F.col("l_tax") * 100.0).cast("int")).cast("long").alias("tx"),
        )
    )
    w = by_symbol()
    close = F.round(F.lit(1000.0) * F.exp(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 100.0), 4)
    out = day.withColumn("adj_last_price", close).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    last = F.coalesce(F.lag("adj_last_price").over(w), "adj_last_price")
    out = out.withColumn("adj_open", last * (1.0 + (F.col("vol") % 5 - 2).cast("double") * 0.002))
    return out.select(
        "symbol", "d", "pos", "adj_open",
        (F.greatest("adj_last_price", "adj_open") * (1.0 + F.col("tx").cast("double") * 0.001)).alias("adj_high"),
        (F.least("adj_last_price", "adj_open") * (1.0 - F.col("tx").cast("double") * 0.001)).alias("adj_low"),
        "adj_last_price", "vol", (F.col("adj_last_price") * F.col("vol").cast("double")).alias("traded_value"),
    )


def prepare_raw(raw: DataFrame, numeric: list[str], *, d: str = "d", keys: tuple[str, ...] = ("symbol",), ordinal: str = "ingest_ordinal") -> DataFrame:
    """Raw rows with parsed dates and numbers; rows without a date go, and of a day's rows the last one read stays."""
    out = raw.withColumn(d, market_date(d)).withColumns({c: number(c) for c in numeric}).filter(F.col(d).isNotNull())
    return keep_last(out, [*keys, d], [ordinal])


def quality_flags(bars: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """Own definition of row quality: quality_* flags of missing, non-positive and inconsistent prices, and missing features."""
    o, h, l, c = PRICES
    missing = lambda x: ~finite(x)
    flags = {
        "quality_price_missing": missing(o) | missing(h) | missing(l) | missing(c),
        "quality_price_nonpositive": F.coalesce((F.least(o, h, l, c) <= 0), F.lit(False)),
        "quality_high_below_low": F.coalesce(F.col(h) < F.col(l), F.lit(False)),
        "quality_outside_range": F.coalesce(~F.col(o).between(F.col(l), F.col(h)) | ~F.col(c).between(F.col(l), F.col(h)), F.lit(False)),
        "quality_locked_bar": F.coalesce(F.col(h) == F.col(l), F.lit(False)),
        "quality_missing_features": sum((missing(f).cast("int") for f in features), F.lit(0)),
    }
    out = bars.withColumns(flags)
    return out.withColumn("quality_any_price_issue", ~valid_ohlc(o, h, l, c))


def quality_summary(flagged: DataFrame, *by: str) -> DataFrame:
    names = [c for c in flagged.columns if c.startswith("quality_") and dict(flagged.dtypes)[c] == "boolean"]
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(c) for c in names])


@dataclass(frozen=True)
class Boundaries:
    """Last train day, and first and last day of the unseen test."""

    train_end: date = date(1999, 12, 31)
    test_start: date = date(2000, 1, 1)
    test_end: date = date(2001, 6, 30)

    def part(self, d: str = "d") -> Column:
        c = F.col(d)
        return F.when(c <= F.lit(self.train_end), "train").when(c.between(F.lit(self.test_start), F.lit(self.test_end)), "unseen_test").when(c > F.lit(self.test_end), "after").otherwise("gap")


def calendar_split(bars: DataFrame, boundaries: Boundaries = Boundaries()) -> DataFrame:
    return bars.withColumn("part", boundaries.part())


def split_summary(split: DataFrame) -> DataFrame:
    """Rows of each part of each symbol, their dates, and whether the parts follow each other."""
    rows = lambda p: F.count_if(F.col("part") == p).alias(f"{p}_rows")
    at = lambda f, p: f(F.when(F.col("part") == p, F.col("d")))
    out = split.groupBy("symbol").agg(*map(rows, ("train", "unseen_test", "after")), at(F.max, "train").alias("train_last"), at(F.min, "unseen_test").alias("test_first"), at(F.max, "unseen_test").alias("test_last"))
    return out.withColumn("chronological", F.coalesce(F.col("train_last") < F.col("test_first"), F.lit(True)))


@dataclass(frozen=True)
class UniverseCriteria:
    min_rows: int = 200
    max_last_gap_days: int = 45
    max_price_missing: float = 0.05
    max_price_issue: float = 0.05


def freeze_universe(train: DataFrame, criteria: UniverseCriteria = UniverseCriteria(), train_end: date = Boundaries().train_end) -> DataFrame:
    """One decision for each symbol from train rows alone; reasons of a rejection are joined by |."""
    f = quality_flags(train)
    out = f.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("train_rows"), F.max("d").alias("last_date"),
        F.avg(F.col("quality_price_missing").cast("double")).alias("price_missing_fraction"),
        F.avg(F.col("quality_any_price_issue").cast("double")).alias("price_issue_fraction"),
    )
    out = out.withColumn("last_gap_days", F.date_diff(F.lit(train_end), "last_date"))
    reasons = F.array_compact(F.array(
        F.when(F.col("train_rows") < criteria.min_rows, "too_few_rows"),
        F.when(F.col("last_gap_days") > criteria.max_last_gap_days, "stale"),
        F.when(F.col("price_missing_fraction") > criteria.max_price_missing, "prices_missing"),
        F.when(F.col("price_issue_fraction") > criteria.max_price_issue, "price_issues"),
    ))
    return out.withColumn("selected_for_frozen_universe", F.size(reasons) == 0).withColumn("universe_decision_reason", F.when(F.size(reasons) == 0, "selected").otherwise(F.array_join(reasons, "|")))


INDEX_FIELDS = ("index_close", "index_low", "index_high")


def index_observations(bars: DataFrame, off_symbol: int | None = 7, off_every: int = 97) -> DataFrame:
    """Each symbol's own copy of the day's index: averages over all symbols. One symbol's copy is off on some days."""
    # Prices have four decimals, so many averages lie right between two of them; an odd shift settles these alike everywhere.
    four = lambda c: F.floor(F.avg(c) * 10000 + 0.3137).cast("double") / 10000
    day = bars.groupBy("d").agg(four("adj_last_price").alias("index_close"), four("adj_low").alias("index_low"), four("adj_high").alias("index_high"))
    out = bars.select("symbol", "d").join(day, "d")
    if off_symbol is not None:
        out = out.withColumn("index_close", F.when((F.col("symbol") == off_symbol) & (F.dayofyear("d") % off_every == 0), F.col("index_close") + 1.0).otherwise(F.col("index_close")))
    return out.select("symbol", "d", *INDEX_FIELDS)


def index_consistency(observations: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(d, field, observations, low, high, median, relative_spread, inconsistent), one row for each day and field."""
    long = observations.unpivot("d", list(INDEX_FIELDS), "field", "value").filter(finite("value"))
    out = long.groupBy("d", "field").agg(F.count(F.lit(1)).alias("observations"), F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("median"))
    spread = F.abs(F.col("high") - F.col("low")) / F.greatest(F.abs("median"), F.lit(1.0))
    return out.withColumn("relative_spread", spread).withColumn("inconsistent", F.col("relative_spread") > tolerance)


def canonical_index(observations: DataFrame) -> DataFrame:
    """(d, index_close, index_low, index_high): the median of the day's copies."""
    return observations.groupBy("d").agg(*[F.median(F.when(finite(f), F.col(f))).alias(f) for f in INDEX_FIELDS])


def liquidity(bars: DataFrame, direct: str | None, volume: str, price: str = "adj_last_price") -> DataFrame:
    """Adds traded_value_irr and liquidity_source: the direct column for symbols where it is ever positive, else volume times price."""
    if direct is None:
        return bars.withColumn("traded_value_irr", F.col(volume) * F.col(price)).withColumn("liquidity_source", F.lit("volume_times_price"))
    has = F.max(F.coalesce(F.col(direct) > 0, F.lit(False))).over(Window.partitionBy("symbol"))
    return bars.withColumn("_has", has).withColumn("traded_value_irr", F.when(F.col("_has"), F.col(direct)).otherwise(F.col(volume) * F.col(price))).withColumn("liquidity_source", F.when(F.col("_has"), direct).otherwise("volume_times_price")).drop("_has")


def execution_rows(bars: DataFrame) -> DataFrame:
    """Rows that can be traded on: prices finite and positive, nothing imputed."""
    return bars.filter(" and ".join(f"{c} is not null" for c in PRICES)).filter(finite_positive(PRICES[0]) & finite_positive(PRICES[1]) & finite_positive(PRICES[2]) & finite_positive(PRICES[3]))


def market_history(bars: DataFrame, *, direct: str | None = "traded_value", volume: str = "vol") -> DataFrame:
    """Tradable bars with position, traded value and adv20_irr: the mean of the 20 trading days before, null without all 20."""
    b = liquidity(execution_rows(bars), direct, volume)
    w = by_symbol()
    before = w.rowsBetween(-20, -1)
    return b.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("adv20_irr", F.when(F.count("traded_value_irr").over(before) == 20, F.avg("traded_value_irr").over(before)))


def history_audit(bars: DataFrame) -> DataFrame:
    """Rows that loading drops, by symbol and reason."""
    fine = F.lit(True)
    for c in PRICES:
        fine = fine & finite(c)
    positive = F.least(*PRICES) > 0
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(~fine).alias("nonfinite_rows"), F.count_if(fine & ~positive).alias("nonpositive_rows"), F.count_if(fine & positive).alias("kept_rows"))
