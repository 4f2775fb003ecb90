"""Extension: exponential means and run lengths of live bars, kept per symbol in the state store.

The batch operators are causal, so a stream that sees the same bars in order gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "symbol long, d date, value double, ema double, run_length long"


def live_series(stream: DataFrame, value: str, span: int) -> DataFrame:
    """(symbol, d, value, ema, run_length) of a stream(symbol, d, value) whose bars come in order for each symbol.

    State is three numbers a symbol: the mean, bars since its last value, and the length of the run of positive values. A bar that
    isn't later than the last one seen is dropped, as a duplicate or late.
    """
    keep, gain = 1 - 2 / (span + 1), 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, gap, run, last = state.get if state.exists else (None, 0, 0, None)
        rows = pd.concat(list(batches)).sort_values("d")
        out = []
        for d, x in zip(rows["d"], rows["value"]):
            day = str(d)
            if last is not None and day <= last:
                continue
            last = day
            if pd.isna(x):
                gap, run, x = gap + (mean is not None), 0, None
            else:
                old = keep ** (gap + 1)
                mean, gap = (x if mean is None else (old * mean + gain * x) / (old + gain)), 0
                run = run + 1 if x > 0 else 0
            out.append((key[0], d, x, mean, run))
        state.update((mean, gap, run, last))
        yield pd.DataFrame(out, columns=["symbol", "d", "value", "ema", "run_length"])

    rows = stream.selectExpr("symbol", "d", f"{value} as value")
    return rows.groupBy("symbol").applyInPandasWithState(step, _OUT, "mean double, gap long, run long, last string", "append", GroupStateTimeout.NoTimeout)
