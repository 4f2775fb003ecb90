"""Purged, embargoed, anchored walk-forward folds with balanced event counts, and average-uniqueness weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F




@dataclass(frozen=True)
class FoldConfig:
    folds: int = 5
    first_validation_fraction: float = 0.5
    embargo: int = 30


def event_counts(days: DataFrame, events: DataFrame) -> DataFrame:
    """(d, day_index, events): events that start on each day of the calendar, 0 where there are none."""
    counts = events.groupBy("d").agg(F.count(F.lit(1)).alias("events"))
    return days.join(counts, "d", "left").withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))


def off_calendar(days: DataFrame, events: DataFrame) -> DataFrame:
    return events.select("d").distinct().join(days, "d", "left_anti")


def balanced_ends(counts: list[int], folds: int) -> list[int]:
    """Last place of each block, so that running counts come nearest to even shares; every block has an event, later ones a day each."""
    running, total = [], 0
    for c in counts:
        total += c
        running.append(total)
    if total < folds:
        raise ValueError(f"{total} events can't fill {folds} blocks")
    ends, last = [], -1
    for k in range(1, folds):
        target, before = k * total / folds, running[last] if last >= 0 else 0
        places = [i for i in range(last + 1, len(counts) - (folds - k)) if running[i] > before and total - running[i] >= folds - k]
        if not places:
            raise ValueError(f"no boundary for block {k}")
        last = min(places, key=lambda i: (abs(running[i] - target), i))
        ends.append(last)
    return [*ends, len(counts) - 1]


_FOLD = "fold_id int, train_start_date date, train_end_date date, embargo_start_date date, embargo_end_date date, validation_start_date date, validation_end_date date, train_end_index int, validation_start_index int, validation_end_index int, validation_days int, target_events double, actual_events long"


def build_folds(spark: SparkSession, counts: DataFrame, c: FoldConfig = FoldConfig()) -> DataFrame:
    """One row for each fold. Boundaries are chosen on the driver from the calendar, a row a day, without any label."""
    days = counts.orderBy("day_index").collect()
    first = max(int(len(days) * c.first_validation_fraction), c.embargo + 1)
    late = [r.events for r in days[first:]]
    rows, start = [], first
    for k, end in enumerate(balanced_ends(late, c.folds), 1):
        end += first
        train = start - c.embargo - 1
        rows.append((k, days[0].d, days[train].d, days[train + 1].d if c.embargo else None, days[start - 1].d if c.embargo else None, days[start].d, days[end].d, train, start, end, end - start + 1, sum(late) / c.folds, sum(r.events for r in days[start : end + 1])))
        start = end + 1
    return spark.createDataFrame(rows, _FOLD)


def fold_membership(events: DataFrame, folds: DataFrame) -> DataFrame:
    """events with fold_id and role: train, purged (its interval reaches into the validation), embargo or validation.

    folds has a row for each fold, a handful by construction, so it is broadcast.
    """
    f = F.broadcast(folds.select("fold_id", "train_end_date", "validation_start_date", "validation_end_date"))
    t = events.join(f, events.d <= f.validation_end_date)
    d = F.col("d")
    role = F.when((d <= F.col("train_end_date")) & (F.col("event_end_date") < F.col("validation_start_date")), "train").when(d <= F.col("train_end_date"), "purged").when(d < F.col("validation_start_date"), "embargo").otherwise("validation")
    return t.withColumn("role", role)


def fold_summary(members: DataFrame) -> DataFrame:
    of = lambda r: F.col("role") == r
    y = F.col("meta_label")
    parts = []
    for r in ("train", "validation"):
        parts += [F.count_if(of(r)).alias(f"{r}_events"), F.count_if(of(r) & (y == 1)).alias(f"{r}_positive_labels"), F.count_if(of(r) & (y == 0)).alias(f"{r}_negative_labels"), F.countDistinct(F.when(of(r), F.col("symbol"))).alias(f"{r}_symbols"), F.countDistinct(F.when(of(r), F.col("d"))).alias(f"{r}_unique_event_start_dates")]
    out = members.groupBy("fold_id").agg(F.count_if(of("train") | of("purged")).alias("historical_events_before_embargo"), F.count_if(of("purged")).alias("purged_event_overlap_count"), F.count_if(of("embargo")).alias("embargo_candidate_event_count"), *parts)
    for r in ("train", "validation"):
        out = out.withColumn(f"{r}_positive_fraction", F.when(F.col(f"{r}_events") > 0, F.col(f"{r}_positive_labels") / F.col(f"{r}_events")))
    return out


def fold_integrity(members: DataFrame) -> DataFrame:
    """Leakage and boundary violations of each fold, all 0 for good folds, and whether both classes occur."""
    train, val = F.col("role") == "train", F.col("role") == "validation"
    ids = members.groupBy("fold_id", "event_id").agg((F.bool_or(train) & F.bool_or(val)).alias("both")).groupBy("fold_id").agg(F.count_if("both").alias("train_event_ids_in_validation"))
    days = members.groupBy("fold_id", "d").agg((F.bool_or(train) & F.bool_or(val)).alias("both")).groupBy("fold_id").agg(F.count_if("both").alias("train_validation_event_start_date_overlap"))
    classes = lambda c: (F.count_if(c & (F.col("meta_label") == 1)) > 0) & (F.count_if(c & (F.col("meta_label") == 0)) > 0)
    rules = members.groupBy("fold_id").agg(
        F.count_if(train & (F.col("d") > F.col("train_end_date"))).alias("train_start_after_train_end"),
        F.count_if(train & (F.col("event_end_date") >= F.col("validation_start_date"))).alias("train_event_end_on_or_after_validation_start"),
        F.count_if(val & (F.col("d") < F.col("validation_start_date"))).alias("validation_before_validation_start"),
        F.count_if(val & (F.col("d") > F.col("validation_end_date"))).alias("validation_after_validation_end"),
        classes(train).alias("train_has_both_classes"), classes(val).alias("validation_has_both_classes"),
    )
    return rules.join(ids, "fold_id").join(days, "fold_id")


def validation_overlap(folds: DataFrame) -> DataFrame:
    """(fold_a, fold_b, overlap) of each pair of folds: whether their validation windows share a day."""
    a = folds.select(F.col("fold_id").alias("fold_a"), F.col("validation_start_date").alias("s"), F.col("validation_end_date").alias("e"))
    b = folds.select(F.col("fold_id").alias("fold_b"), F.col("validation_start_date").alias("s2"), F.col("validation_end_date").alias("e2"))
    return a.join(F.broadcast(b), F.col("fold_a") < F.col("fold_b")).select("fold_a", "fold_b", ((F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e"))).alias("overlap"))


def anchored_audit(members: DataFrame) -> DataFrame:
    """(fold_id, next_fold_id, train_events, missing_in_next): training sets must grow without losing an event."""
    train = members.filter("role = 'train'").select("fold_id", "event_id")
    nxt = train.select((F.col("fold_id") - 1).alias("fold_id"), "event_id", F.lit(True).alias("kept"))
    last = members.agg(F.max("fold_id").alias("last_fold"))
    t = train.join(nxt, ["fold_id", "event_id"], "left").groupBy("fold_id").agg(F.count(F.lit(1)).alias("train_events"), F.count_if(F.col("kept").isNull()).alias("missing_in_next"))
    return t.join(F.broadcast(last), F.col("fold_id") < F.col("last_fold")).select("fold_id", (F.col("fold_id") + 1).alias("next_fold_id"), "train_events", "missing_in_next")


def count_balance(members: DataFrame, folds: DataFrame) -> DataFrame:
    """How near each validation block comes to its share of events, with statistics over all folds on every row."""
    got = members.filter("role = 'validation'").groupBy("fold_id").agg(F.count(F.lit(1)).alias("actual_candidate_events"), F.countDistinct("d").alias("validation_unique_start_dates"))
    t = folds.select("fold_id", "target_events").join(got, "fold_id", "left").withColumn("actual_candidate_events", F.coalesce("actual_candidate_events", F.lit(0)))
    one = Window.partitionBy(F.lit(0))  # a row for each fold
    x = F.col("actual_candidate_events")
    t = t.withColumn("signed_deviation_from_target", x - F.col("target_events")).withColumn("all_fold_event_count_mean", F.avg(x).over(one)).withColumn("all_fold_event_count_std", F.stddev_pop(x).over(one))
    return t.withColumn("all_fold_event_count_cv", F.col("all_fold_event_count_std") / F.col("all_fold_event_count_mean")).withColumn("all_fold_max_to_min_ratio", F.max(x).over(one) / F.min(x).over(one))


def class_balance(members: DataFrame) -> DataFrame:
    """(fold_id, part, label, events)."""
    return members.filter("role in ('train', 'validation')").groupBy("fold_id", F.col("role").alias("part"), F.col("meta_label").alias("label")).agg(F.count(F.lit(1)).alias("events"))


def uniqueness(events: DataFrame, bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """events(event_id, symbol, d, event_end_date, *by) with average_uniqueness, from concurrency within the group.

    Each interval counts on its symbol's own trading days. Intervals aren't expanded into days: a start and an end row of each lie
    in one order of places, concurrency is constant between two of them, and the sum of 1 / concurrency over an interval is the
    difference of what stands at its end and at its start. All of it stays in the exchange by symbol.
    """
    keys = [*by, "symbol"]
    if {"pos", "holding_period_observations"} <= set(events.columns):  # places are known already
        e = events.withColumn("_s", F.col("pos").cast("long")).withColumn("_e", F.col("pos") + F.col("holding_period_observations") + 1)
    else:
        cal = bars.select("symbol", "d", F.col("pos").cast("long").alias("_at"))
        e = events.join(cal, ["symbol", "d"]).withColumnRenamed("_at", "_s").join(cal.withColumnRenamed("d", "event_end_date"), ["symbol", "event_end_date"]).withColumn("_e", F.col("_at") + 1).drop("_at")
    own = [c for c in events.columns if c not in (*keys, "event_id")]
    rest = F.struct(*own) if own else F.struct(F.lit(0).alias("_none"))
    ends = F.array(F.struct(F.col("_s").alias("_at"), F.lit(1).alias("_step"), rest.alias("_rest")), F.struct(F.col("_e").alias("_at"), F.lit(-1).alias("_step"), F.lit(None).cast(dict(e.select(rest.alias("r")).dtypes)["r"]).alias("_rest")))
    line = Window.partitionBy(*keys).orderBy("_at")
    t = e.select(*keys, "event_id", F.inline(ends))
    t = t.withColumn("_c", F.sum("_step").over(line.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("_at").over(line))
    t = t.withColumn("_share", F.when(F.col("_c") > 0, (F.col("_next") - F.col("_at")) / F.col("_c")).otherwise(0.0)).withColumn("_sum", F.coalesce(F.sum("_share").over(line.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    start = F.col("_step") == 1
    told = lambda c, when: F.max(F.when(when, F.col(c)))
    t = t.groupBy(*keys, "event_id").agg(F.first("_rest", ignorenulls=True).alias("_rest"), ((told("_sum", ~start) - told("_sum", start)) / (told("_at", ~start) - told("_at", start))).alias("average_uniqueness"))
    return t.select(*keys, "event_id", *[F.col(f"_rest.{c}").alias(c) for c in own], "average_uniqueness").select(*events.columns, "average_uniqueness")


def average_uniqueness(events: DataFrame, bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """uniqueness, and its weight: uniqueness over its mean in the group."""
    out = uniqueness(events, bars, by)
    mean = out.groupBy(*by).agg(F.avg("average_uniqueness").alias("mean_uniqueness"))  # a row for each group, such as a fold
    out = out.join(F.broadcast(mean), list(by)) if by else out.join(F.broadcast(mean))
    return out.withColumn("sample_weight", F.col("average_uniqueness") / F.col("mean_uniqueness")).drop("mean_uniqueness")


def kish(weight: Column | str = "sample_weight") -> Column:
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.sum(w) * F.sum(w) / F.sum(w * w)


def uniqueness_summary(weighted: DataFrame, *by: str) -> DataFrame:
    u = "average_uniqueness"
    out = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.min(u).alias("min_uniqueness"), F.avg(u).alias("mean_uniqueness"), F.median(u).alias("median_uniqueness"), F.max(u).alias("max_uniqueness"), kish().alias("effective_sample_size"))
    return out.withColumn("effective_fraction", F.col("effective_sample_size") / F.col("events"))
