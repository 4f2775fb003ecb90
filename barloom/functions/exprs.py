"""Column expressions shared by the operators. All are null-safe under ANSI mode: nothing here divides by zero or fails to cast."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite; never null."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def finite_positive(c: str | Column) -> Column:
    return finite(c) & (col(c) > 0)


def number(c: str | Column) -> Column:
    """Text or number as double; what isn't a finite or infinite number is null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def market_date(c: str | Column) -> Column:
    """Date from yyyyMMdd, or from any ISO date or timestamp text; otherwise null."""
    t = F.trim(col(c).cast("string"))
    return F.when(t.rlike("^[0-9]{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd"))).otherwise(F.try_to_timestamp(t)).cast("date")


def ratio(num: str | Column, den: str | Column, positive: bool = True) -> Column:
    """num / den where both are finite and den is positive (or, if not asked for, other than 0); otherwise null."""
    num, den = col(num).cast("double"), col(den).cast("double")
    return F.when(finite(num) & finite(den) & ((den > 0) if positive else (den != 0)), num / den)


def truth(c: str | Column) -> Column:
    """Boolean from true, false, 1 or 0 in any case; anything else is null, which expectations report."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def close_to(a: Column, b: Column, rtol: float = 0.0, atol: float = 1e-12) -> Column:
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def valid_ohlc(o: str, h: str, l: str, c: str) -> Column:
    inside = (col(h) >= col(l)) & col(o).between(col(l), col(h)) & col(c).between(col(l), col(h))
    return finite_positive(o) & finite_positive(h) & finite_positive(l) & finite_positive(c) & F.coalesce(inside, F.lit(False))


def first_existing(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first candidate among columns, by exact name and then by name without case."""
    columns, candidates = list(columns), list(candidates)
    lower = {c.lower(): c for c in reversed(columns)}
    return next((c for c in candidates if c in columns), None) or next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def by_symbol(*, symbol: str = "symbol", d: str = "d"):
    return Window.partitionBy(symbol).orderBy(d)


def full_frame(agg: Column, value: str | Column, w, size: int) -> Column:
    """agg over the last `size` rows of w, null unless all of them have a value."""
    over = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(col(value)).over(over) == size, agg.over(over))


def change(c: str, w, n: int = 1) -> Column:
    """Relative change against n rows before."""
    was = F.lag(c, n).over(w)
    return F.when(was != 0, col(c) / was - 1)


def log_return(c: str, w) -> Column:
    was = F.lag(c, 1).over(w)
    return F.when(finite_positive(c) & finite_positive(was), F.log(col(c) / was))


def zscore(c: str, w, size: int) -> Column:
    """Population z-score in a full frame; 0 in a constant one."""
    mean, dev = full_frame(F.avg(c), c, w, size), full_frame(F.stddev_pop(c), c, w, size)
    return F.when(dev == 0, F.lit(0.0)).otherwise((col(c) - mean) / F.when(dev != 0, dev))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    q = clip(col(p), eps, 1 - eps)
    return F.log(q / (1 - q))


def stem(path: str | Column, suffixes: Iterable[str] = ()) -> Column:
    """File name without directory, its last extension and the longest of the given suffixes that it has."""
    s = F.regexp_extract(col(path), r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    ends = "|".join(sorted(suffixes, key=lambda x: (-len(x), x)))
    return F.regexp_replace(s, f"({ends})$", "") if ends else s


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*[col(c).desc() for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
