"""Classification, probability, outcome and correlation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import clip

EPS = 2.220446049250313e-16  # of a double


def _div(a: Column, b: Column, zero: float | None = None) -> Column:
    out = F.when(b != 0, a / F.when(b != 0, b))
    return out if zero is None else F.coalesce(out, F.lit(zero))


#: Stretches of the unit interval along which ordered passes over scores are dealt out.
STRETCHES = 4096


def _stretch(p: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(STRETCHES - 1), F.floor(p * STRETCHES))).cast("int")


def _before(rows: DataFrame, by: tuple[str, ...], sums: dict[str, str]) -> DataFrame:
    """(*by, stretch, and for each name the sum of its column over lower stretches, and over all as all_<name>): a few thousand rows a group."""
    each = rows.groupBy(*by, "stretch").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    low = group.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    told = [F.coalesce(F.sum(f"_{n}").over(low), F.lit(0)).alias(n) for n in sums] + [F.sum(f"_{n}").over(group).alias(f"all_{n}") for n in sums]
    return each.select(*by, "stretch", *told)


def classification_metrics(rows: DataFrame, *by: str, label: str = "label", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """ROC AUC (average ranks), average precision (step rule), log loss, Brier score and the threshold metrics, for each group.

    Rows are first counted by score; all figures come from these counts. The ordered passes go along stretches of scores, each on
    from the sums of those before, so no task takes a whole group.
    """
    y, x = F.col(label), F.col("p")
    scores = rows.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count(F.lit(1)).alias("n")).withColumn("stretch", _stretch(F.col("p")))
    before = F.broadcast(_before(scores, by, {"low_n": "n", "low_pos": "pos"}))
    s = scores.join(before, [*by, "stretch"])
    up = Window.partitionBy(*by, "stretch").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"upto": F.col("low_n") + F.sum("n").over(up), "pos_upto": F.col("low_pos") + F.sum("pos").over(up)})
    s = s.withColumns({"tops": F.col("all_low_pos") - F.col("pos_upto") + F.col("pos"), "all": F.col("all_low_n") - F.col("upto") + F.col("n")})
    pos, neg, q, hit = F.col("pos"), F.col("neg"), clip(x, EPS, 1 - EPS), x >= threshold
    t = s.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"),
        (-F.sum(pos * F.log(q) + neg * F.log(1.0 - q)) / F.sum("n")).alias("log_loss"), (F.sum(pos * (1.0 - x) * (1.0 - x) + neg * x * x) / F.sum("n")).alias("brier_score"),
        *[F.coalesce(F.sum(F.when(c, k)), F.lit(0)).cast("double").alias(name) for name, c, k in (("tp", hit, pos), ("fp", hit, neg), ("tn", ~hit, neg), ("fn", ~hit, pos))],
        F.sum(pos * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)).alias("rank_sum"), F.sum(_div(pos, F.col("all_low_pos"), 0.0) * F.col("tops") / F.col("all")).alias("average_precision"),
    )
    P, N, tp, fp, tn, fn = (F.col(c) for c in ("positives", "negatives", "tp", "fp", "tn", "fn"))
    sens, spec = _div(tp, tp + fn, 0.0), _div(tn, tn + fp, 0.0)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return t.withColumns({
        "roc_auc": _div(F.col("rank_sum") - P * (P + 1) / 2.0, (P * N).cast("double")), "accuracy": (tp + tn) / F.col("rows"), "balanced_accuracy": (sens + spec) / 2.0,
        "precision": _div(tp, tp + fp, 0.0), "recall": sens, "specificity": spec, "f1": _div(2.0 * tp, 2.0 * tp + fp + fn, 0.0), "mcc": _div(tp * tn - fp * fn, root, 0.0),
    }).drop("rank_sum")


def calibration_error(rows: DataFrame, *by: str, label: str = "label", p: str = "p", order: str = "event_id", bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal size; ties of p fall in the order of `order`. Rows are placed along stretches of p."""
    t = rows.select(*by, F.col(p).alias("_p"), F.col(label).cast("double").alias("_y"), F.col(order).alias("_o"), _stretch(F.col(p)).alias("stretch"), F.lit(1).alias("_n"))
    t = t.join(F.broadcast(_before(t, by, {"low": "_n"})), [*by, "stretch"])
    at = F.col("low") + F.row_number().over(Window.partitionBy(*by, "stretch").orderBy("_p", "_o")) - 1
    size, more = F.floor(F.col("all_low") / bins), F.col("all_low") % bins  # the first bins have one row more
    t = t.withColumn("_at", at).withColumn("bin", F.when(F.col("_at") < more * (size + 1), F.floor(F.col("_at") / (size + 1))).otherwise(more + F.floor((F.col("_at") - more * (size + 1)) / F.greatest(size, F.lit(1)))))
    b = t.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y"), F.avg("_p").alias("q"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("q"))) / F.sum("n")).alias("ece"))


def probability_metrics(rows: DataFrame, *by: str, label: str = "label", p: str = "p", order: str = "event_id", bins: int = 10) -> DataFrame:
    m = classification_metrics(rows, *by, label=label, p=p).select(*by, "rows", "roc_auc", "average_precision", "log_loss", "brier_score")
    e = calibration_error(rows, *by, label=label, p=p, order=order, bins=bins)
    return m.join(e, list(by)) if by else m.join(F.broadcast(e))


def signal_metrics(rows: DataFrame, *by: str, label: str = "label", selected: str = "selected") -> DataFrame:
    """Precision, lift over the base rate, specificity and sensitivity of a selection."""
    y, s = F.col(label), F.col(selected)
    t = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(s).alias("signals"), F.count_if(y == 1).alias("positives"), F.count_if(s & (y == 1)).alias("tp"), F.count_if(~s & (y == 0)).alias("tn"))
    n, k, P, tp, tn = (F.col(c).cast("double") for c in ("candidates", "signals", "positives", "tp", "tn"))
    t = t.withColumn("precision", _div(tp, k)).withColumn("base_rate", P / n)
    return t.withColumns({"precision_lift": F.col("precision") - F.col("base_rate"), "precision_ratio": _div(F.col("precision"), F.col("base_rate")), "sensitivity": _div(tp, P), "specificity": _div(tn, n - P)})


def fold_auc_summary(fold_metrics: DataFrame, *by: str) -> DataFrame:
    """Equal-weight mean, population deviation, worst and best AUC over folds."""
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc"), F.min("roc_auc").alias("min_auc"), F.max("roc_auc").alias("max_auc"))


def model_summary(fold_metrics: DataFrame, *by: str, metrics: tuple[str, ...] = ("roc_auc", "average_precision", "log_loss", "brier_score", "mcc", "f1")) -> DataFrame:
    return fold_metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.sum("rows").alias("events"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics])


def outcome_metrics(rows: DataFrame, *by: str, label: str = "meta_label", ret: str = "corrected_event_return") -> DataFrame:
    """Win rate, return moments, payoff ratio, profit factor and barrier counts of event outcomes."""
    r, y = F.col(ret), F.col(label)
    gain, loss = F.when(r > 0, r), F.when(r < 0, r)
    t = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(y == 1).alias("winning_events"), F.count_if(y == 0).alias("nonwinning_events"), F.count_if(r < 0).alias("losing_events_negative_return"),
        F.count_if(F.abs(r) <= 1e-12).alias("breakeven_events"), F.avg(y.cast("double")).alias("win_rate"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.stddev_pop(r).alias("std_return"),
        F.min(r).alias("min_return"), F.max(r).alias("max_return"), F.avg(gain).alias("average_winning_return"), F.avg(loss).alias("average_losing_return"),
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("gross_profit_sum"), F.coalesce(-F.sum(loss), F.lit(0.0)).alias("gross_loss_absolute_sum"),
        *[F.count_if(F.col("barrier_touched") == b).alias(f"{b}_barrier_events") for b in ("upper", "lower", "vertical")],
        F.avg("holding_period_observations").alias("mean_holding"), F.median(F.col("holding_period_observations").cast("double")).alias("median_holding"),
    )
    return t.withColumn("payoff_ratio", _div(F.col("average_winning_return"), F.abs("average_losing_return"))).withColumn("profit_factor", _div(F.col("gross_profit_sum"), F.col("gross_loss_absolute_sum")))


def populations(rows: DataFrame, selected: str = "selected") -> DataFrame:
    """Each row once as a candidate, and once more, if selected, as a signal."""
    of = F.array_compact(F.array(F.lit("all_candidates"), F.when(F.col(selected), "selected_signals")))
    return rows.withColumn("population", F.explode(of))


def correlations(daily: DataFrame, left: list[str], right: list[str], *, method: str = "pearson", part: str = "partition") -> DataFrame:
    """(partition, left, right, pairs, correlation) over each part and the full table; pairs with a null go.

    spearman correlates average ranks. Null where there are fewer than three pairs, or one side doesn't vary.
    """
    scoped = daily.withColumn("scope", F.explode(F.array(F.col(part), F.lit("full")))).filter("scope in ('train', 'unseen_test', 'full')")
    pairs = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a in left for b in right])
    t = scoped.select("scope", F.inline(pairs)).filter("x is not null and y is not null")
    if method == "spearman":
        g = Window.partitionBy("scope", "left", "right")
        rank = lambda c: F.rank().over(g.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("scope", "left", "right", c)) - 1) / 2.0
        t = t.withColumn("rx", rank("x")).withColumn("ry", rank("y")).select("scope", "left", "right", F.col("rx").alias("x"), F.col("ry").alias("y"))
    out = t.groupBy("scope", "left", "right").agg(F.count(F.lit(1)).alias("paired_dates"), F.corr("x", "y").alias("r"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    fine = (F.col("paired_dates") >= 3) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return out.select(F.col("scope").alias("partition"), F.lit(method).alias("method"), F.col("left").alias("breadth_feature"), F.col("right").alias("market_feature"), "paired_dates", F.when(fine, F.col("r")).alias("correlation"))


def max_drawdown(equity: DataFrame, *by: str, order: str = "d", value: str = "equity") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("_down", F.col(value) / F.max(value).over(w) - 1.0).groupBy(*by).agg(F.min("_down").alias("maximum_drawdown"))


def trimmed_mean(rows: DataFrame, value: str, fraction: float) -> DataFrame:
    """(kept, trimmed_mean, median, mean) of the positive finite values, floor(n * fraction) off each end for the first.

    Values are counted by distinct value first, so the ordered pass is over distinct values, not rows.
    """
    x = rows.select(F.col(value).cast("double").alias("v")).filter("v > 0 and v < double('infinity')")
    counts = x.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.count(F.lit(1)).alias("total"), F.median("v").alias("median"), F.avg("v").alias("mean"))
    w = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    t = counts.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(total)).withColumn("cut", F.floor(F.col("total") * fraction))
    inside = F.greatest(F.least("upto", F.col("total") - F.col("cut")) - F.greatest(F.col("upto") - F.col("n"), F.col("cut")), F.lit(0))
    return t.withColumn("inside", inside).groupBy("median", "mean").agg(F.sum("inside").alias("kept"), (F.sum(F.col("v") * F.col("inside")) / F.sum("inside")).alias("trimmed_mean"))


def non_decreasing(rows: DataFrame, raw: str, mapped: str, *by: str, tolerance: float = 1e-12) -> DataFrame:
    """(violations, non_decreasing): whether the mapped score never falls as the raw one grows."""
    points = rows.groupBy(*by, F.col(raw).alias("x")).agg(F.min(mapped).alias("lo"), F.max(mapped).alias("hi"))
    w = Window.partitionBy(*by).orderBy("x") if by else Window.partitionBy(F.lit(0)).orderBy("x")
    out = points.withColumn("fall", (F.col("lo") < F.lag("hi").over(w) - tolerance) | (F.col("hi") - F.col("lo") > tolerance)).groupBy(*by).agg(F.count_if(F.coalesce("fall", F.lit(False))).alias("violations"))
    return out.withColumn("non_decreasing", F.col("violations") == 0)
