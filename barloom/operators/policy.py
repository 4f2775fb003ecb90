"""Daily top-fraction selection, and hierarchical choices among near-best alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.metrics import signal_metrics


def daily_top_fraction(rows: DataFrame, *, score: str = "score", date: str = "d", fraction: float = 0.05, minimum: int = 1, prefix: str = "daily_", selected: str = "selected", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank, candidate count, quota, cutoff (the least selected score) and the selection within each day.

    The order is score falling, then symbol and event_id, so ties are settled; quota = min(n, max(minimum, ceil(fraction * n))).
    """
    day = Window.partitionBy(*by, date)
    n, rank = F.count(F.lit(1)).over(day), F.row_number().over(day.orderBy(F.desc(score), "symbol", "event_id"))
    out = rows.withColumn(f"{prefix}candidate_count", n.cast("long")).withColumn(f"{prefix}rank", rank.cast("int"))
    count = F.col(f"{prefix}candidate_count")
    out = out.withColumn(f"{prefix}signal_quota", F.least(count, F.greatest(F.lit(minimum).cast("long"), F.ceil(F.lit(float(fraction)) * count))))
    out = out.withColumn(selected, F.col(f"{prefix}rank") <= F.col(f"{prefix}signal_quota"))
    return out.withColumn(f"{prefix}score_cutoff", F.min(F.when(F.col(selected), F.col(score))).over(day))


def policies(rows: DataFrame, fractions: tuple[float, ...], **kw) -> DataFrame:
    """Rows once for each fraction, selected under it."""
    parts = [daily_top_fraction(rows, fraction=f, **kw).withColumn("fraction", F.lit(f)) for f in fractions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def policy_by_fold(rows: DataFrame, fractions: tuple[float, ...], label: str = "meta_label") -> DataFrame:
    """Signal metrics of each fraction on each fold's validation rows."""
    return signal_metrics(policies(rows, fractions, by=("fold_id",)), "fraction", "fold_id", label=label)


def policy_summary(by_fold: DataFrame, development: tuple[int, ...]) -> DataFrame:
    t = by_fold.filter(F.col("fold_id").isin(*development))
    return t.groupBy("fraction").agg(F.count(F.lit(1)).alias("folds"), F.sum("signals").alias("signals"), F.min("precision_lift").alias("worst_lift"), F.avg("precision_lift").alias("mean_lift"), F.avg("specificity").alias("mean_specificity"), F.avg("precision").alias("mean_precision"))


def _ranked(t: DataFrame, eligible: Column, value: str, band: float, order: list[Column], rank: str) -> DataFrame:
    one = Window.partitionBy(F.lit(0))  # a row for each alternative
    best = F.max(F.when(eligible, F.col(value))).over(one)
    t = t.withColumn("in_band", F.coalesce(eligible & (F.col(value) >= best - band), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("in_band").orderBy(*order))
    return t.withColumn(rank, F.when(F.col("in_band"), place)).withColumn("chosen", F.coalesce(F.col(rank) == 1, F.lit(False)))


def near_best_ranking(trials: DataFrame, *, band: float = 0.005, name: str = "trial", mean: str = "mean_auc", worst: str = "min_auc", std: str = "std_auc") -> DataFrame:
    """Among trials within `band` of the best mean: worst fold falling, deviation rising, id rising."""
    return _ranked(trials, F.col(mean).isNotNull(), mean, band, [F.desc(worst), F.asc(std), F.asc(name)], "selection_rank")


def choose_policy(summary: DataFrame, *, min_signals: int = 250, min_lift: float = 0.0, band: float = 0.005) -> DataFrame:
    """Among fractions with enough signals and no worse lift than min_lift, within `band` of the best worst lift: mean lift, then specificity, then the smaller fraction."""
    fine = (F.col("signals") >= min_signals) & (F.col("worst_lift") >= min_lift)
    return _ranked(summary, fine, "worst_lift", band, [F.desc("mean_lift"), F.desc("mean_specificity"), F.asc("fraction")], "selection_rank")


def choose_calibration(summary: DataFrame) -> DataFrame:
    """Admissible methods by mean and worst Brier score, then mean log loss and name; the first is chosen."""
    order = [F.desc("admissible"), F.asc("mean_brier"), F.asc("worst_brier"), F.asc("mean_log_loss"), F.asc("method")]
    t = summary.withColumn("selection_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return t.withColumn("chosen", (F.col("selection_rank") == 1) & F.col("admissible"))


def rerank_matches(locked: DataFrame, *, fraction: float, minimum: int = 1, score: str = "score") -> DataFrame:
    """(rows, differing): how many locked selections a new ranking of the same rows contradicts."""
    again = daily_top_fraction(locked.withColumnRenamed("selected", "_locked"), score=score, fraction=fraction, minimum=minimum, prefix="again_", selected="_again")
    return again.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_again") != F.col("_locked")).alias("differing"))


def consecutive_ranks(rows: DataFrame, rank: str = "daily_rank") -> DataFrame:
    """(rows, gaps): whether ranks of each day count up from 1 without a gap."""
    w = Window.partitionBy("d").orderBy(rank)
    return rows.withColumn("_n", F.row_number().over(w)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_n") != F.col(rank)).alias("gaps"))
