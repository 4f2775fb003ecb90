"""Order-dependent series operators: exponential means, run lengths, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import by_symbol


def _ewm(values: Column, span: int, min_periods: int) -> Column:
    """Exponential means of an array by one fold: weights adjusted for gaps as if nulls had decayed, nulls carry the mean on."""
    keep = 1.0 - 2.0 / (span + 1.0)
    gain = 2.0 / (span + 1.0)
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("gap"), F.lit(0).alias("seen"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        old = F.pow(F.lit(keep), (acc["gap"] + 1).cast("double"))
        plain = (old * acc["y"] + gain * x) / (old + gain)
        y = F.when(x.isNull(), acc["y"]).when(acc["y"].isNull(), x).when(acc["gap"] == 0, keep * acc["y"] + gain * x).otherwise(plain)
        seen = acc["seen"] + F.when(x.isNull(), 0).otherwise(1)
        gap = F.when(x.isNull() & acc["y"].isNotNull(), acc["gap"] + 1).otherwise(0)
        return F.struct(y.alias("y"), gap.alias("gap"), seen.alias("seen"), F.concat(acc["out"], F.array(F.when(seen >= min_periods, y))).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def exponential_means(df: DataFrame, specs: list[tuple[str, str, int, int]], *, by: list[str], order: str = "d") -> DataFrame:
    """df with a column for each (source, name, span, min_periods). A series is folded whole, as the recursion needs."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (*by, order)]))).alias("rows"))
    for i, (source, _, span, least) in enumerate(specs):
        rows = rows.withColumn(f"_{i}", _ewm(F.transform("rows", lambda r: r[source].cast("double")), span, least))  # noqa: B023
    both = F.arrays_zip("rows", *[f"_{i}" for i in range(len(specs))])
    out = rows.select(*by, F.explode(both).alias("x"))
    return out.select(*by, "x.rows.*", *[F.col(f"x._{i}").alias(name) for i, (_, name, _, _) in enumerate(specs)]).select(*df.columns, *[s[1] for s in specs])


def run_length(df: DataFrame, value: str, name: str, *, by: str = "symbol", order: str = "d") -> DataFrame:
    """Adds how many rows up to this one are positive without a break; 0 where it isn't positive or null."""
    w = Window.partitionBy(by).orderBy(order)
    positive = F.coalesce(F.col(value) > 0, F.lit(False))
    island = df.withColumn("_on", positive).withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    n = F.sum(F.col("_on").cast("long")).over(Window.partitionBy(by, "_island").orderBy(order))
    return island.withColumn(name, F.when(F.col("_on"), n).otherwise(F.lit(0)).cast("long")).drop("_on", "_island")


def date_gaps(df: DataFrame, name: str = "gap_days") -> DataFrame:
    return df.withColumn(name, F.date_diff("d", F.lag("d").over(by_symbol())))


def calendar(df: DataFrame, *by: str) -> DataFrame:
    """Distinct days with their place from 0, for the whole table or for each key.

    The global calendar has one row for each trading day, so its single-task window stays small whatever the panel's size.
    """
    days = df.select(*by, "d").filter("d is not null").distinct()
    w = Window.partitionBy(*by).orderBy("d") if by else Window.partitionBy(F.lit(0)).orderBy("d")
    return days.withColumn("day_index", (F.row_number().over(w) - 1).cast("int"))
