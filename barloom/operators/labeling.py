"""Triple-barrier labels, censoring, and their audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import finite, finite_positive
from barloom.operators.expect import require_columns


@dataclass(frozen=True)
class Barriers:
    name: str = "primary"
    upper: float = 0.15
    lower: float = -0.15
    horizon: int = 30
    entry: str = "adj_last_price"
    high: str = "adj_high"
    low: str = "adj_low"

    def __post_init__(self):
        if not (self.upper > 0 > self.lower > -1 and self.horizon >= 1):
            raise ValueError(f"barriers out of range: {self}")

    @classmethod
    def from_config(cls, config: dict, name: str) -> Barriers:
        return cls(name=name, **{k: v for k, v in config["scenarios"][name].items() if k in cls.__dataclass_fields__})

    @classmethod
    def all_from_config(cls, config: dict) -> list[Barriers]:
        return [cls.from_config(config, n) for n in config["scenarios"]]


SCENARIOS = (Barriers(), Barriers("tight_stop", 0.15, -0.10), Barriers("short", 0.10, -0.10, 15), Barriers("touchy", 0.02, -0.02, 5))


def _ahead(bars: DataFrame, horizon: int, entry: str, high: str, low: str, by: tuple[str, ...]) -> DataFrame:
    """bars with _next, the next bars of the same group, and _last, the group's last day."""
    bar = F.struct(F.col("d").alias("d"), F.col(high).alias("h"), F.col(low).alias("l"), F.col(entry).alias("c"))
    w = Window.partitionBy(*by).orderBy("d")
    return bars.withColumn("_next", F.collect_list(bar).over(w.rowsBetween(1, horizon))).withColumn("_last", F.max("d").over(Window.partitionBy(*by)))


def _first_hit(p: Barriers) -> Column:
    """Of the next bars, the first that is invalid or touches a barrier: (n, d, bad, up, down)."""
    up, down = F.col(p.entry) * (1.0 + p.upper), F.col(p.entry) * (1.0 + p.lower)
    bad = lambda x: ~(finite_positive(x["h"]) & finite_positive(x["l"])) | (x["h"] < x["l"])
    told = F.transform(F.slice("_next", 1, p.horizon), lambda x, i: F.struct((i + 1).alias("n"), x["d"].alias("d"), bad(x).alias("bad"), F.coalesce(x["h"] >= up, F.lit(False)).alias("up"), F.coalesce(x["l"] <= down, F.lit(False)).alias("down")))
    return F.try_element_at(F.filter(told, lambda x: x["bad"] | x["up"] | x["down"]), F.lit(1))


def _judged(p: Barriers, hit: Column) -> dict[str, Column]:
    """Label columns of the bar whose first hit is given; the lower barrier wins a double touch."""
    up, down, entry, ok = F.col(p.entry) * (1.0 + p.upper), F.col(p.entry) * (1.0 + p.lower), F.col(p.entry), finite_positive(p.entry)
    avail = F.least(F.size("_next"), F.lit(p.horizon))
    there, end = F.try_element_at("_next", F.lit(p.horizon))["c"], F.try_element_at("_next", F.lit(p.horizon))["d"]
    full, hits = avail >= p.horizon, hit.isNotNull()
    touched, vertical = ok & hits & ~hit["bad"], ok & ~hits & full & finite_positive(there)
    status = (
        F.when(~ok, "invalid_entry_price").when(hits & hit["bad"], "invalid_monitoring_price").when(hits, "labeled")
        .when(~full, "right_censored").when(~finite_positive(there), "invalid_vertical_price").otherwise("labeled")
    )
    earned = F.when(vertical, there / entry - 1.0)
    return {
        "label_status": status,
        "event_start_date": F.col("d"),
        "event_end_date": F.when(~ok, F.col("d")).when(hits, hit["d"]).when(full, end).otherwise(F.col("_last")),
        "holding_period_observations": F.when(~ok, 0).when(hits, hit["n"]).when(full, p.horizon).otherwise(avail).cast("int"),
        "barrier_touched": F.when(touched & hit["down"], "lower").when(touched, "upper").when(vertical, "vertical").otherwise("none"),
        "event_return": F.when(touched & hit["down"], F.lit(p.lower)).when(touched, F.lit(p.upper)).otherwise(earned),
        "event_price": F.when(touched & hit["down"], down).when(touched, up).when(vertical, there),
        "label": F.when(touched & hit["down"], 0).when(touched, 1).when(vertical, (earned > 0).cast("int")).cast("int"),
        "same_bar_double_touch": F.coalesce(touched & hit["down"] & hit["up"], F.lit(False)),
        "eligible_for_modeling": touched | vertical,
        "full_horizon_available": full,
        "censoring_reason": F.when(ok & ~hits & ~full, "insufficient_future_observations").otherwise(""),
        "upper_barrier_price": F.when(ok, up),
        "lower_barrier_price": F.when(ok, down),
    }


def triple_barrier(bars: DataFrame, p: Barriers = Barriers(), *, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with label columns. Each bar looks at the next `horizon` bars of its own group only.

    The forward bars are gathered in one window frame, so labels take the exchange that the group's other windows use;
    the first bar that is invalid or touches a barrier decides, and the lower barrier wins a double touch.
    """
    require_columns(bars, (*by, "d", p.entry, p.high, p.low))
    t = _ahead(bars, p.horizon, p.entry, p.high, p.low, by).withColumn("_hit", _first_hit(p))
    return t.withColumns(_judged(p, F.col("_hit"))).drop("_next", "_last", "_hit")


def modeling_sample(labeled: DataFrame) -> DataFrame:
    return labeled.filter("eligible_for_modeling and label is not null")


_STATUSES = ("right_censored", "invalid_entry_price", "invalid_monitoring_price", "invalid_vertical_price")


def label_audit(labeled: DataFrame, *by: str) -> DataFrame:
    """Counts of labels, barriers and exclusions for each group."""
    ok, y = F.col("eligible_for_modeling"), F.col("label")
    touched = lambda b: F.count_if(F.col("barrier_touched") == b).alias(f"{b}_barrier_events")
    out = labeled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("eligible_events"), F.count_if(~ok).alias("excluded_events"),
        F.count_if(ok & (y == 1)).alias("positive_labels"), F.count_if(ok & (y == 0)).alias("negative_labels"),
        *map(touched, ("upper", "lower", "vertical")), F.count_if("same_bar_double_touch").alias("same_bar_double_touch_events"),
        *[F.count_if(F.col("label_status") == s).alias(f"{s}_events") for s in _STATUSES],
        F.min("event_start_date").alias("first_event_start_date"), F.max("event_start_date").alias("last_event_start_date"), F.max("event_end_date").alias("last_event_end_date"),
    )
    return out.withColumn("positive_label_fraction", F.when(F.col("eligible_events") > 0, F.col("positive_labels") / F.col("eligible_events")))


def label_distribution(labeled: DataFrame, *by: str) -> DataFrame:
    y = F.col("label")
    out = modeling_sample(labeled).groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.sum(y.cast("long")).alias("positive"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("d").alias("start_dates"))
    return out.withColumn("negative", F.col("events") - F.col("positive")).withColumn("positive_fraction", F.col("positive") / F.col("events"))


def event_end_integrity(labeled: DataFrame, horizon: int, *by: str) -> DataFrame:
    """Violations of the rules that labels must keep, each counted, and whether there are none."""
    part_end = F.max("d").over(Window.partitionBy(*by))
    t = labeled.withColumn("_part_end", part_end)
    ok, end, hold, b = F.col("eligible_for_modeling"), F.col("event_end_date"), F.col("holding_period_observations"), F.col("barrier_touched")
    rules = {
        "end_before_start_count": end < F.col("event_start_date"),
        "event_end_after_partition_count": end > F.col("_part_end"),
        "eligible_missing_event_end_count": ok & end.isNull(),
        "eligible_invalid_label_count": ok & ~F.coalesce(F.col("label").isin(0, 1), F.lit(False)),
        "status_eligibility_mismatch_count": ok != (F.col("label_status") == "labeled"),
        "right_censored_eligible_count": ok & (F.col("label_status") == "right_censored"),
        "barrier_holding_invalid_count": b.isin("upper", "lower") & ~F.coalesce(hold.between(1, horizon), F.lit(False)),
        "vertical_holding_invalid_count": (b == "vertical") & (hold != horizon),
        "double_touch_rule_invalid_count": F.col("same_bar_double_touch") & ((b != "lower") | ~F.coalesce(F.col("label") == 0, F.lit(False))),
    }
    out = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min("d").alias("partition_first_date"), F.max("d").alias("partition_last_date"), F.count_if(ok).alias("eligible_events"),
        F.count_if(F.col("label_status") == "right_censored").alias("right_censored_events"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()],
    )
    return out.withColumn("integrity_passed", sum((F.col(n) for n in rules), F.lit(0)) == 0)


def all_scenarios(bars: DataFrame, scenarios: tuple[Barriers, ...] = SCENARIOS) -> DataFrame:
    """Labels of every scenario, one below the other. The longest window is gathered once, and all scenarios are judged on it."""
    first = scenarios[0]
    if {(p.entry, p.high, p.low) for p in scenarios} != {(first.entry, first.high, first.low)}:
        raise ValueError("scenarios of one run share their price columns")
    keep = ["label", "label_status", "barrier_touched", "same_bar_double_touch", "eligible_for_modeling", "holding_period_observations"]
    t = _ahead(bars, max(p.horizon for p in scenarios), first.entry, first.high, first.low, ("symbol",))
    t = t.withColumns({f"_hit_{i}": _first_hit(p) for i, p in enumerate(scenarios)})
    told = [F.struct(F.lit(p.name).alias("scenario"), *[c.alias(n) for n, c in _judged(p, F.col(f"_hit_{i}")).items() if n in keep]) for i, p in enumerate(scenarios)]
    return t.select("symbol", "d", F.inline(F.array(*told))).select("scenario", "symbol", "d", *keep)


def scenario_by_year(labels: DataFrame) -> DataFrame:
    ok = F.col("eligible_for_modeling")
    out = labels.groupBy("scenario", F.year("d").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("events"), F.count_if(ok & (F.col("label") == 1)).alias("positive"),
        F.count_if("same_bar_double_touch").alias("double_touch"), F.median(F.when(ok, F.col("holding_period_observations")).cast("double")).alias("median_holding"),
    )
    return out.withColumn("positive_fraction", F.when(F.col("events") > 0, F.col("positive") / F.col("events")))


def scenario_comparison(labels: DataFrame) -> DataFrame:
    """One row for each scenario: totals, exact median holding period, and how the yearly positive fraction varies."""
    year = scenario_by_year(labels)
    spread = year.groupBy("scenario").agg(F.count("positive_fraction").alias("years"), F.stddev_pop("positive_fraction").alias("fraction_std"), (F.max("positive_fraction") - F.min("positive_fraction")).alias("fraction_range"))
    ok = F.col("eligible_for_modeling")
    total = labels.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("events"), F.count_if(ok & (F.col("label") == 1)).alias("positive"), F.median(F.when(ok, F.col("holding_period_observations")).cast("double")).alias("median_holding"))
    return total.join(spread, "scenario").withColumn("positive_fraction", F.col("positive") / F.col("events"))


def forward_outcomes(labeled: DataFrame, p: Barriers = Barriers()) -> DataFrame:
    """Corrected outcome of each eligible bar: an upper event earns the highest high of the next bars, a lower one the stop, a vertical one the close.

    Adds corrected_event_return, corrected_exit_date (first bar of the highest high, or the event's end), and outcome_consistent
    (the sign agrees with the label, and a vertical return with the stored one at 1e-8).
    """
    w = Window.partitionBy("symbol").orderBy("d")
    ahead = w.rowsBetween(1, p.horizon)
    t = labeled.withColumn("_top", F.max(F.struct(F.col(p.high).alias("h"), (-F.datediff("d", F.lit("1970-01-01"))).alias("n"), F.col("d").alias("d"))).over(ahead)).withColumn("_there", F.lead(p.entry, p.horizon).over(w))
    entry, b = F.col(p.entry), F.col("barrier_touched")
    ret = F.when(b == "upper", F.col("_top.h") / entry - 1.0).when(b == "lower", F.lit(p.lower)).when(b == "vertical", F.col("_there") / entry - 1.0)
    t = t.filter("eligible_for_modeling").withColumn("corrected_event_return", ret).withColumn("corrected_exit_date", F.when(b == "upper", F.col("_top.d")).otherwise(F.col("event_end_date")))
    agrees = (F.col("corrected_event_return") > 0) == (F.col("label") == 1)
    same = F.when(b == "vertical", F.abs(F.col("corrected_event_return") - F.col("event_return")) <= 1e-8).otherwise(F.lit(True))
    return t.withColumn("outcome_consistent", F.coalesce(agrees & same & finite("corrected_event_return"), F.lit(False))).drop("_top", "_there")
