"""Execution plans, scenario grids, the multi-lot portfolio simulation, and summaries of its ledger."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.functions.exprs import by_symbol
from barloom.operators.metrics import _div, trimmed_mean
from barloom.operators.ml import settled


@dataclass(frozen=True)
class Costs:
    buy: float = 0.00464
    sell: float = 0.00964
    sell_tax: float = 0.005


@dataclass(frozen=True)
class Limits:
    risk_per_lot: float = 0.005
    symbol_risk: float = 0.015
    portfolio_risk: float = 0.10
    symbol_exposure: float = 0.10
    gross_exposure: float = 0.70
    symbols: int = 10
    lots: int = 20
    lots_per_symbol: int = 3
    new_per_day: int = 3
    adv_fraction: float = 0.01


@dataclass(frozen=True)
class Exits:
    stop: float = 0.15
    activation: float = 0.15
    trailing: float = 0.10
    target: float = 0.15
    horizon: int = 30


@dataclass(frozen=True)
class Rules:
    costs: Costs = field(default_factory=Costs)
    limits: Limits = field(default_factory=Limits)
    exits: Exits = field(default_factory=Exits)


def stop_loss_fraction(costs: Costs = Costs(), slippage: float = 0.002, stop: float = 0.15) -> float:
    """Share of the entry's cash that is lost at the stop, costs included."""
    paid = (1 + slippage) * (1 + costs.buy)
    got = (1 + slippage) * (1 - stop) * (1 - slippage) * (1 - costs.sell)
    return 1 - got / paid


def capital_anchors(customers: DataFrame, value: str, rules: Rules = Rules(), slippage: float = 0.002, trim: float = 0.10) -> DataFrame:
    """(capital, anchor, initial_capital): trimmed mean, median and mean of customers' trades, over the weight of one lot."""
    weight = rules.limits.risk_per_lot / stop_loss_fraction(rules.costs, slippage, rules.exits.stop)
    t = trimmed_mean(customers, value, trim)
    rows = F.array(*[F.struct(F.lit(n).alias("capital"), F.col(c).alias("anchor")) for n, c in (("primary", "trimmed_mean"), ("median", "median"), ("mean", "mean"))])
    return t.select(F.inline(rows)).withColumn("initial_capital", F.col("anchor") / weight)


SLIPPAGES = {"0bp": 0.0, "10bp": 0.001, "20bp": 0.002, "50bp": 0.005}


def scenario_grid(spark: SparkSession, capitals: DataFrame, slippages: tuple[str, ...] = ("0bp", "10bp", "20bp", "50bp"), structures: tuple[str, ...] = ("multi_lot", "single_lot"), exits: tuple[str, ...] = ("trailing", "fixed_take_profit"), adv_fractions: tuple[float, ...] = (0.01,)) -> DataFrame:
    """Every combination of the parameter lists, a few dozen rows, with one primary scenario."""
    rest = spark.createDataFrame([(s, SLIPPAGES[s], p, e, float(a)) for s in slippages for p in structures for e in exits for a in adv_fractions], "slip string, slippage double, structure string, exit_style string, adv_fraction double")
    t = capitals.select("capital", "initial_capital").crossJoin(F.broadcast(rest))
    name = F.concat_ws("__", F.concat(F.lit("capital_"), "capital"), F.concat(F.lit("slip_"), "slip"), "structure", "exit_style", *([F.concat(F.lit("adv_"), F.col("adv_fraction").cast("string"))] if len(adv_fractions) > 1 else []))
    primary = (F.col("capital") == "primary") & (F.col("slip") == "20bp") & (F.col("structure") == "multi_lot") & (F.col("exit_style") == "trailing") & (F.col("adv_fraction") == 0.01)
    return t.select(name.alias("scenario_id"), "capital", "initial_capital", "slippage", "structure", "exit_style", "adv_fraction", primary.alias("is_primary"))


def execution_plan(signals: DataFrame, bars: DataFrame, horizon: int = 30) -> DataFrame:
    """signals with positions, entry (the next bar) and horizon end (the bar `horizon` on), and plan_error where one of them is missing."""
    w = by_symbol()
    at = bars.select("symbol", "d", F.col("pos").alias("signal_position"), F.lead("d", 1).over(w).alias("entry_date"), F.lead("d", horizon).over(w).alias("horizon_end_date"))
    t = signals.join(at, ["symbol", "d"], "left").withColumn("entry_position", F.col("signal_position") + 1).withColumn("horizon_end_position", F.col("signal_position") + horizon)
    return t.withColumn("plan_error", F.when(F.col("signal_position").isNull(), "signal_date_not_tradable").when(F.col("entry_date").isNull(), "no_next_observation").when(F.col("horizon_end_date").isNull(), "horizon_incomplete"))


_EVENT_FIELDS = (
    "scenario_id string, kind string, seq long, d date, event_id string, symbol long, signal_date date, entry_date date, lot_number int, exit_observation int, quantity long, score double, daily_rank int,"
    " entry_open double, entry_price double, entry_gross double, entry_cash double, buy_fee double, buy_slippage double, exit_quote double, exit_price double, proceeds_gross double, sell_tax double, sell_other_fee double,"
    " sell_slippage double, proceeds_net double, pnl double, net_return double, reason string, trailing boolean, activation_date date, entry_risk double, locked_before_exit double, initial_stop double, final_stop double, highest double, break_even double, decision string,"
    " cash double, market_value double, equity double, open_risk double, locked double, open_lots int, open_symbols int, protected_lots int, new_lots int, max_symbol_value double, max_symbol_risk double,"
    " constraint_violations int, negative_cash int, protected_risk int"
)
LEDGER_COLUMNS = tuple(part.split()[0] for part in _EVENT_FIELDS.split(","))


class _Lot:
    __slots__ = ("plan", "path", "number", "q", "open", "price", "gross", "cash", "fee", "stop0", "stop", "goal", "even", "high", "pending", "active", "since", "mark", "risk0", "risk", "locked")


class NoPath(Exception):
    """A plan was accepted whose bars didn't come along."""


class Offers:
    """The plans of an entry date by place (score falling, symbol, event_id); one is looked up when a portfolio comes to it.

    look(i): the plan with bar, (open, adv) of its entry date or None, and path, date -> (position, open, high, low, last) up to its horizon.
    """

    def __init__(self, symbols: list, look: Callable[[int], dict]):
        self.symbols, self._look, self._plans, self._places = symbols, look, {}, None

    def plan(self, i: int) -> dict:
        if i not in self._plans:
            self._plans[i] = self._look(i)
        return self._plans[i]

    def next_of(self, held: set, i: int) -> int:
        """The first place from i on whose symbol is held, or the end."""
        if self._places is None:
            self._places = {}
            for k, symbol in enumerate(self.symbols):
                self._places.setdefault(symbol, []).append(k)
        return min((k for symbol in held for k in self._places.get(symbol, ()) if k >= i), default=len(self.symbols))


_NO_OFFERS = Offers([], lambda i: {})


class Portfolio:
    """One scenario's portfolio, advanced a day at a time; it holds the bars of its open lots and nothing else of the market.

    out gets rows of the ledger, but rejected plans that follow each other for the same reason are one row of kind run: the places from low to high.
    bars, for run alone: {symbol: (date -> position, rows of open, high, low, last, adv)}.
    """

    def __init__(self, scenario: dict, bars: dict, rules: Rules):
        self.s, self.bars, self.rules = scenario, bars, rules
        self.cash, self.lots, self.out, self.seq, self.last = float(scenario["initial_capital"]), [], [], 0, None
        self.violations = self.negative = self.protected = 0
        self.keep = (1 - scenario["slippage"]) * (1 - rules.costs.sell)
        self.known = (0.0, self.cash, 0.0, 0.0)

    def emit(self, kind: str, d, **values) -> None:
        self.seq += 1
        self.out.append({"scenario_id": self.s["scenario_id"], "kind": kind, "seq": self.seq, "d": d, **values})

    def reject(self, d, low: int, high: int, reason: str) -> None:
        """Places from low to below high."""
        run = self.out[-1] if self.out else {}
        if run.get("kind") == "run" and (run["d"], run["high"], run["reason"]) == (d, low - 1, reason):
            run["high"] = high - 1
        else:
            self.out.append({"scenario_id": self.s["scenario_id"], "kind": "run", "seq": self.seq + 1, "d": d, "low": low, "high": high - 1, "reason": reason})
        self.seq += high - low

    def revalue(self) -> tuple[float, float, float, float]:
        """Market value, equity, open risk at the stops and profit locked in by them."""
        value = risk = locked = 0.0
        for lot in self.lots:
            net = lot.q * lot.stop * self.keep
            lot.risk, lot.locked = max(0.0, lot.cash - net), max(0.0, net - lot.cash)
            value, risk, locked = value + lot.q * lot.mark, risk + lot.risk, locked + lot.locked
        self.known = value, self.cash + value, risk, locked
        return self.known

    def sell(self, lot: _Lot, d, at: int, quote: float, reason: str) -> None:
        c = self.rules.costs
        price = quote * (1 - self.s["slippage"])
        gross = lot.q * price
        tax, other = gross * c.sell_tax, gross * (c.sell - c.sell_tax)
        net = gross - gross * c.sell
        self.cash += net
        self.lots.remove(lot)
        p = lot.plan
        self.emit(
            "trade", d, event_id=p["event_id"], symbol=p["symbol"], signal_date=p["d"], entry_date=p["entry_date"], lot_number=lot.number, exit_observation=at - p["signal_position"], quantity=lot.q, score=p["score"], daily_rank=p["daily_rank"],
            entry_open=lot.open, entry_price=lot.price, entry_gross=lot.gross, entry_cash=lot.cash, buy_fee=lot.fee, buy_slippage=lot.q * lot.open * self.s["slippage"], exit_quote=quote, exit_price=price, proceeds_gross=gross, sell_tax=tax, sell_other_fee=other,
            sell_slippage=lot.q * quote * self.s["slippage"], proceeds_net=net, pnl=net - lot.cash, net_return=net / lot.cash - 1, reason=reason, trailing=bool(lot.active or lot.since), activation_date=lot.since, entry_risk=lot.risk0, locked_before_exit=lot.locked,
            initial_stop=lot.stop0, final_stop=lot.stop, highest=lot.high, break_even=lot.even,
        )

    def at_open(self, d) -> None:
        for lot in self.lots:
            if d in lot.path:
                lot.mark = lot.path[d][1]
        fixed = self.s["exit_style"] == "fixed_take_profit"
        for lot in list(self.lots):
            if d not in lot.path:
                continue
            at, first, *_ = lot.path[d]
            if lot.pending:
                lot.pending, lot.stop = False, max(lot.even, (1 - self.rules.exits.trailing) * lot.high)
                if first <= lot.stop:
                    self.sell(lot, d, at, first, "trailing_gap_exit_on_activation_open")
                    continue
                lot.active, lot.since = True, d
            if first <= lot.stop:
                self.sell(lot, d, at, first, "trailing_gap_stop" if lot.active else "initial_gap_stop")
            elif fixed and first >= lot.goal:
                self.sell(lot, d, at, first, "fixed_target_gap_exit")
        self.revalue()
        self.protected += sum(lot.active and lot.risk > 1e-6 for lot in self.lots)

    def enter_all(self, d, offers: Offers) -> int:
        """The day's plans in order; how many are bought. What no plan's own data can change is told for all places that it holds for."""
        m, i, n, opened = self.rules.limits, 0, len(offers.symbols), 0
        while i < n:
            held = {lot.plan["symbol"] for lot in self.lots}
            to = i + 1
            if opened >= m.new_per_day:
                why, to = "daily_entry_cap_reached", n
            elif len(self.lots) >= m.lots:
                why, to = "portfolio_lot_cap_reached", n
            elif len(held) >= m.symbols and offers.symbols[i] not in held:
                why, to = "distinct_symbol_cap_reached", offers.next_of(held, i)
            else:
                why = self.enter(offers.plan(i), d)
            if why is None:
                opened += 1
            else:
                self.reject(d, i, to, why)
            i = to
        return opened

    def enter(self, plan: dict, d) -> str | None:
        """Buys a lot of the plan, or tells why not."""
        m, x, slip = self.rules.limits, self.rules.exits, self.s["slippage"]
        own = [lot for lot in self.lots if lot.plan["symbol"] == plan["symbol"]]
        single = self.s["structure"] == "single_lot"
        per_symbol = 1 if single else m.lots_per_symbol
        if len(own) >= per_symbol:
            return "single_lot_symbol_already_open" if single else "symbol_lot_cap_reached"
        if plan["bar"] is None:
            return "missing_entry_bar"
        first, adv = plan["bar"]
        why = None if first is not None and math.isfinite(first) and first > 0 else "invalid_next_open"
        if why is None:
            value, equity, risk_now, _ = self.known
            why = None if equity > 0 else "nonpositive_equity"
        if why is None:
            price = first * (1 + slip)
            cash_each, stop = price * (1 + self.rules.costs.buy), price * (1 - x.stop)
            risk_each = cash_each - stop * self.keep
            why = None if risk_each > 0 else "invalid_risk_per_share"
        if why is None:
            room, room_own = m.portfolio_risk * equity - risk_now, m.symbol_risk * equity - sum(lot.risk for lot in own)
            risk_room = min(m.risk_per_lot * equity, room, room_own)
            if risk_room <= 0:
                why = "symbol_risk_cap_reached" if room_own <= room else "portfolio_risk_cap_reached"
        if why is None:
            gross_room, own_room = m.gross_exposure * equity - value, m.symbol_exposure * equity - sum(lot.q * lot.mark for lot in own)
            why = "gross_exposure_cap_reached" if gross_room <= 0 else "symbol_exposure_cap_reached" if own_room <= 0 else None
        if why is None:
            liquid = self.s["adv_fraction"] * adv if adv is not None and math.isfinite(adv) and adv > 0 else None
            why = "adv20_unavailable" if liquid is None else "liquidity_cap_reached" if liquid <= 0 else None
        if why is None:
            sizes = {"risk_size_below_one_share": risk_room / risk_each, "gross_exposure_cap_reached": gross_room / price, "symbol_exposure_cap_reached": own_room / price, "insufficient_cash": self.cash / cash_each, "liquidity_cap_reached": liquid / price}
            sizes = {k: math.floor(v) for k, v in sizes.items()}
            smallest = min(sizes, key=sizes.get)
            q = sizes[smallest]
            why = smallest if q < 1 else None
        if why is not None:
            return why
        if plan["path"] is None:
            raise NoPath
        lot = _Lot()
        lot.plan, lot.path, lot.number, lot.q, lot.open, lot.price = plan, plan["path"], max((o.number for o in own), default=0) + 1, q, first, price
        lot.gross = q * price
        lot.fee = lot.gross * self.rules.costs.buy
        lot.cash = lot.gross + lot.fee
        lot.stop0 = lot.stop = stop
        lot.goal = price * (1 + (x.target if self.s["exit_style"] == "fixed_take_profit" else x.activation))
        lot.even, lot.high, lot.mark = lot.cash / q / self.keep, price, first
        lot.pending, lot.active, lot.since, lot.locked = False, False, None, 0.0
        lot.risk0 = lot.risk = q * risk_each
        self.cash -= lot.cash
        self.negative += self.cash < -1e-6
        self.lots.append(lot)
        after, _, risk_after, _ = self.revalue()
        mine = [o for o in self.lots if o.plan["symbol"] == plan["symbol"]]
        kept = (
            self.cash >= -1e-6 and len(self.lots) <= m.lots and len(mine) <= per_symbol and len({o.plan["symbol"] for o in self.lots}) <= m.symbols
            and risk_after <= m.portfolio_risk * equity + 1 and sum(o.risk for o in mine) <= m.symbol_risk * equity + 1
            and after <= m.gross_exposure * equity + price and sum(o.q * o.mark for o in mine) <= m.symbol_exposure * equity + price and lot.gross <= liquid + price
        )
        self.violations += not kept
        self.emit("decision", d, decision="accepted", quantity=q, entry_risk=lot.risk0, entry_price=price, entry_cash=lot.cash, lot_number=lot.number, **_told(plan))
        return None

    def in_day(self, d) -> None:
        x, fixed = self.rules.exits, self.s["exit_style"] == "fixed_take_profit"
        for lot in list(self.lots):
            if d not in lot.path:
                continue
            at, _, high, low, last = lot.path[d]
            if low <= lot.stop:
                self.sell(lot, d, at, lot.stop, "trailing_intraday_stop" if lot.active else "initial_intraday_stop")
                continue
            if fixed and high >= lot.goal:
                self.sell(lot, d, at, lot.goal, "fixed_take_profit")
                continue
            if not fixed:
                lot.high = max(lot.high, high)
                if lot.active:
                    lot.stop = max(lot.even, (1 - x.trailing) * lot.high)
                elif high >= lot.goal:
                    lot.pending = True
            if at - lot.plan["signal_position"] >= x.horizon:
                self.sell(lot, d, at, last, f"time_exit_observation_{x.horizon}")
                continue
            lot.mark = last

    def close_day(self, d, opened: int) -> None:
        for lot in self.lots:
            if d in lot.path:
                lot.mark = lot.path[d][4]
        value, equity, risk, locked = self.revalue()
        by_value, by_risk = {}, {}
        for lot in self.lots:
            k = lot.plan["symbol"]
            by_value[k], by_risk[k] = by_value.get(k, 0.0) + lot.q * lot.mark, by_risk.get(k, 0.0) + lot.risk
        self.emit("day", d, cash=self.cash, market_value=value, equity=equity, open_risk=risk, locked=locked, open_lots=len(self.lots), open_symbols=len(by_value), protected_lots=sum(lot.active for lot in self.lots), new_lots=opened, max_symbol_value=max(by_value.values(), default=0.0), max_symbol_risk=max(by_risk.values(), default=0.0))

    def day(self, d, offers: Offers) -> None:
        self.at_open(d)
        opened = self.enter_all(d, offers)
        self.in_day(d)
        self.close_day(d, opened)
        self.last = d

    def end(self) -> None:
        if self.lots:
            raise ValueError(f"{self.s['scenario_id']}: {len(self.lots)} lots are open after the last horizon")
        self.emit("integrity", self.last, constraint_violations=self.violations, negative_cash=self.negative, protected_risk=self.protected)

    def run(self, plans: list[dict]) -> list[dict]:
        """The ledger of plans that are at hand, each rejected one in a row of its own."""
        if not plans:
            return self.out
        first, last = min(p["entry_date"] for p in plans), max(p["horizon_end_date"] for p in plans)
        by_day: dict = {}
        for p in sorted(plans, key=lambda p: (-p["score"], p["symbol"], p["event_id"])):
            by_day.setdefault(p["entry_date"], []).append(p)

        def look(p: dict) -> dict:
            dates, rows = self.bars[p["symbol"]]
            at = dates.get(p["entry_date"])
            path = {d: (k, *rows[k][:4]) for d, k in dates.items() if d >= p["entry_date"] and k <= p["signal_position"] + self.rules.exits.horizon}
            return p | {"bar": None if at is None else (rows[at][0], rows[at][4]), "path": path}

        for d in sorted({d for dates, _ in self.bars.values() for d in dates if first <= d <= last}):
            own = by_day.get(d, [])
            self.day(d, Offers([p["symbol"] for p in own], lambda i, own=own: look(own[i])))
        self.end()
        out = []
        for row in self.out:
            out += [row] if row["kind"] != "run" else [_rejected(row, i, by_day[row["d"]][i]) for i in range(row["low"], row["high"] + 1)]
        return out


def _told(plan: dict) -> dict:
    return {"event_id": plan["event_id"], "symbol": plan["symbol"], "signal_date": plan["d"], "entry_date": plan["entry_date"], "score": plan["score"], "daily_rank": plan["daily_rank"]}


def _rejected(run: dict, place: int, plan: dict) -> dict:
    return {"scenario_id": run["scenario_id"], "kind": "decision", "seq": run["seq"] + place - run["low"], "d": run["d"], "decision": "rejected", "reason": run["reason"], "quantity": 0, "entry_risk": 0.0, **_told(plan)}


_OUT_ROWS = 2000


def _lanes(batches: Iterator, lanes: list[list[dict]], rules: Rules, schema) -> Iterator:
    """Advances the portfolios of a lane side by side along its stream: for each day a row of place -1, and its plans by place."""
    import pyarrow as pa

    folios: list[Portfolio] = []
    lane = day = None
    rows: list[tuple] = []  # (batch, row, symbol) of the day's plans

    def look(b, k: int) -> dict:
        p = {c: b.column(c)[k].as_py() for c in ("event_id", "symbol", "d", "signal_position", "entry_date", "score", "daily_rank", "entry_open", "entry_adv", "has_bar", "path")}
        path = p.pop("path")
        return p | {"bar": (p["entry_open"], p["entry_adv"]) if p["has_bar"] else None, "path": None if path is None else {x["d"]: (x["pos"], x["o"], x["h"], x["l"], x["c"]) for x in path}}

    def settle_day() -> None:
        nonlocal rows
        own, rows = rows, []
        offers = Offers([symbol for *_, symbol in own], lambda i: look(*own[i][:2])) if own else _NO_OFFERS
        for f in list(folios):
            try:
                f.day(day, offers)
            except NoPath:
                folios.remove(f)
                short.append({"scenario_id": f.s["scenario_id"], "kind": "short"})

    def taken(least: int) -> Iterator:
        ready = [*short, *[r for f in folios for r in f.out]]
        if len(ready) > least:
            short.clear()
            for f in folios:
                f.out = []
            for i in range(0, len(ready), _OUT_ROWS):
                yield pa.RecordBatch.from_pylist(ready[i : i + _OUT_ROWS], schema=schema)

    def finish() -> Iterator:
        if day is not None:
            settle_day()
            for f in folios:
                f.end()
            yield from taken(0)

    short: list[dict] = []
    for b in batches:
        symbols = b.column("symbol").to_pylist()
        for k, (at, today, place) in enumerate(zip(b.column("lane").to_pylist(), b.column("day").to_pylist(), b.column("place").to_pylist())):
            if at != lane:
                yield from finish()
                lane, day, folios = at, None, [Portfolio(s, {}, rules) for s in lanes[at]]
            if today != day:
                if day is not None:
                    settle_day()
                    yield from taken(_OUT_ROWS)
                day = today
            if place >= 0:
                rows.append((b, k, symbols[k]))
    yield from finish()


_RUN_FIELDS = "low int, high int"


def simulate(scenarios: DataFrame, plans: DataFrame, bars: DataFrame, rules: Rules = Rules(), near: int = 8, counted: bool = False) -> DataFrame:
    """The ledger of every scenario: rows of kind decision, trade, day and integrity, in LEDGER_COLUMNS.

    counted, for summaries: plans that are rejected one after the other for the same reason stay one row, without the columns of a single
    plan, and `plans` is their number, 1 in any other row. Else each has its own row, and there are scenarios times plans of these.

    Lots, cash and caps depend on each other in order, so a scenario goes along all plans in one task; as many tasks as the session has
    cores share the scenarios, and each streams one copy of the plans by day. Tasks hold the bars of open lots alone. The first `near`
    plans of a day that may have an adv20_irr (20 bars before them), and later ones of the same symbols while their lots may be open, bring
    their bars up to the horizon along; scenarios that buy another one are run again with more of them, and with all of them in the end.
    Rejected plans leave Python as runs of places.
    plans: complete execution plans with score and daily_rank. bars: market histories, of which only symbols with plans are used.
    scenarios, a few dozen rows, are collected; plans and what the tasks tell are settled in the checkpoint folder.
    """
    spark = bars.sparkSession
    fields, shape = f"{_EVENT_FIELDS}, {_RUN_FIELDS}", _EVENT_FIELDS + ", plans long" * counted
    schema = to_arrow_schema(StructType.fromDDL(fields))
    fine = F.col("plan_error").isNull()
    order = Window.partitionBy(fine, "entry_date").orderBy(F.desc("score"), "symbol", "event_id")
    every = settled(plans.select("event_id", "symbol", "d", "signal_position", "entry_date", "horizon_end_date", "score", "daily_rank", "plan_error", (F.row_number().over(order) - 1).alias("place"), F.count_if(F.col("entry_position") >= 20).over(order).alias("turn")))
    own = every.filter(fine).drop("plan_error")
    first, last = own.agg(F.min("entry_date"), F.max("horizon_end_date")).first()
    if first is None:
        return spark.createDataFrame([], shape)
    days = settled(bars.filter(F.col("d").between(F.lit(first), F.lit(last))).join(every.select("symbol").distinct(), "symbol", "left_semi").select(F.col("d").alias("day")).distinct())
    bar = bars.select(F.col("symbol").alias("_symbol"), F.col("d").alias("_d"), "pos", F.col("adj_open").alias("o"), F.col("adj_high").alias("h"), F.col("adj_low").alias("l"), F.col("adj_last_price").alias("c"), "adv20_irr")

    def told(grid: list[dict], near: int | None) -> DataFrame:
        """What Python tells of the scenarios, of which those that came to a plan without bars have a row of kind short."""
        n = min(len(grid), max(1, spark.sparkContext.defaultParallelism))
        lanes = [grid[k::n] for k in range(n)]
        keys = ["symbol", "entry_date", "place", "event_id", "d", "signal_position", "score", "daily_rank", "_near"]
        w = Window.partitionBy("symbol").orderBy("signal_position")
        since = F.max(F.when((F.col("turn") <= (near or 0)) & (F.col("signal_position") >= 19), F.col("signal_position"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        chain = F.sum(F.when(F.col("signal_position") - F.lag("signal_position").over(w) <= rules.exits.horizon, 0).otherwise(1)).over(w)
        t = own.withColumn("_since", since).withColumn("_chain", chain)
        t = t.withColumn("_near", F.lit(True) if near is None else F.coalesce(F.col("_since") >= F.min("signal_position").over(Window.partitionBy("symbol", "_chain")), F.lit(False)))
        reach = (F.col("_d") >= F.col("entry_date")) & (F.col("pos") <= F.col("signal_position") + rules.exits.horizon)
        t = t.join(bar, (F.col("symbol") == F.col("_symbol")) & reach & (F.col("_near") | (F.col("_d") == F.col("entry_date"))), "left")
        at_entry = F.col("_d") == F.col("entry_date")
        path = F.struct(F.col("_d").alias("d"), "pos", "o", "h", "l", "c")
        t = t.groupBy(*keys).agg(F.max(F.when(at_entry, F.col("o"))).alias("entry_open"), F.max(F.when(at_entry, F.col("adv20_irr"))).alias("entry_adv"), F.coalesce(F.bool_or(at_entry), F.lit(False)).alias("has_bar"), F.collect_list(F.when(F.col("_d").isNotNull(), path)).alias("path"))
        t = t.withColumn("path", F.when(F.col("_near"), F.col("path"))).drop("_near").withColumn("day", F.col("entry_date"))
        rows = t.unionByName(days.withColumn("place", F.lit(-1)), allowMissingColumns=True).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = rows.repartitionById(n, F.col("lane")).sortWithinPartitions("lane", "day", "place")
        return settled(rows.mapInArrow(lambda batches: _lanes(batches, lanes, rules, schema), fields))

    grid, parts = sorted((r.asDict() for r in scenarios.select("scenario_id", "initial_capital", "slippage", "structure", "exit_style", "adv_fraction").collect()), key=lambda r: r["scenario_id"]), []
    while grid:
        part = told(grid, near)
        short = {r.scenario_id for r in part.filter("kind = 'short'").select("scenario_id").collect()}
        parts.append(part.filter(~F.col("scenario_id").isin(*short)) if short else part)
        grid, near = [r for r in grid if r["scenario_id"] in short], near * 8 if len(parts) < 3 else None
    if not parts:
        return spark.createDataFrame([], shape)
    out = reduce(DataFrame.unionByName, parts)
    if counted:
        run = F.col("kind") == "run"
        own_kind = {"kind": F.when(run, "decision").otherwise(F.col("kind")), "decision": F.when(run, "rejected").otherwise(F.col("decision"))}
        return out.select(*[own_kind.get(c, F.col(c)).alias(c) for c in LEDGER_COLUMNS], F.when(run, F.col("high") - F.col("low") + 1).otherwise(1).cast("long").alias("plans"))
    runs = out.filter("kind = 'run'").select("scenario_id", "seq", F.col("d").alias("_d"), "reason", "low", "high")
    told_of = {"kind": F.lit("decision"), "seq": F.col("seq") + F.col("place") - F.col("low"), "d": F.col("entry_date"), "signal_date": F.col("d"), "quantity": F.lit(0).cast("long"), "entry_risk": F.lit(0.0), "decision": F.lit("rejected")}
    rejected = own.select("entry_date", "place", "event_id", "symbol", "d", "score", "daily_rank").join(runs, (F.col("entry_date") == F.col("_d")) & F.col("place").between(F.col("low"), F.col("high")))
    plain = {"scenario_id", "event_id", "symbol", "entry_date", "score", "daily_rank", "reason"}
    rejected = rejected.select(*[(told_of[f.name] if f.name in told_of else F.col(f.name) if f.name in plain else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(_EVENT_FIELDS)])
    return out.filter("kind <> 'run'").select(*LEDGER_COLUMNS).unionByName(rejected)


def part_of(ledger: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    return ledger.filter(F.col("kind") == kind).select("scenario_id", *columns)


def _decided(ledger: DataFrame, decision: str | None = None) -> Column:
    """Number of plans decided on (so), from a ledger with a row for each or one that is counted."""
    fine = F.col("kind") == "decision" if decision is None else F.col("decision") == decision
    return F.sum(F.when(fine, F.col("plans") if "plans" in ledger.columns else F.lit(1)).otherwise(0))


def decision_breakdown(ledger: DataFrame) -> DataFrame:
    """Decisions of each scenario by their reason; accepted ones have none."""
    return ledger.filter("kind = 'decision'").groupBy("scenario_id", "decision", "reason").agg(_decided(ledger).alias("decisions"))


def exit_breakdown(ledger: DataFrame, top: int = 15) -> DataFrame:
    return ledger.filter("kind = 'trade'").groupBy("reason").agg(F.count(F.lit(1)).alias("trades"), F.avg("net_return").alias("mean_net_return")).orderBy(F.desc("trades"), "reason").limit(top)


def portfolio_integrity(ledger: DataFrame) -> DataFrame:
    k = F.col("kind")
    return ledger.groupBy("scenario_id").agg(
        _decided(ledger).alias("signals_decided"), _decided(ledger, "accepted").alias("accepted_signals"), _decided(ledger, "rejected").alias("rejected_signals"), F.count_if(k == "trade").alias("closed_trades"),
        F.coalesce(F.sum("constraint_violations"), F.lit(0)).alias("entry_constraint_violations"), F.coalesce(F.sum("negative_cash"), F.lit(0)).alias("negative_cash_events"), F.coalesce(F.sum("protected_risk"), F.lit(0)).alias("protected_lot_nonzero_planned_risk_events"),
    )


def performance(ledger: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row for each scenario: returns, risk, drawdown, trades, costs and exposure."""
    day = ledger.filter("kind = 'day'")
    w = Window.partitionBy("scenario_id").orderBy("d")
    day = day.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1.0).withColumn("down", F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1.0).withColumn("gross", _div(F.col("market_value"), F.col("equity"))).withColumn("risk", _div(F.col("open_risk"), F.col("equity")))
    days = day.groupBy("scenario_id").agg(
        F.min("d").alias("first_execution_date"), F.max("d").alias("last_execution_date"), F.max_by("equity", "d").alias("final_equity"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("_ds"),
        F.min("down").alias("maximum_drawdown"), F.avg("gross").alias("average_gross_exposure_fraction"), F.max("gross").alias("maximum_gross_exposure_fraction"), F.avg("open_lots").alias("average_open_lots"), F.max("open_lots").alias("maximum_open_lots"),
        F.max("open_symbols").alias("maximum_open_symbols"), F.max("risk").alias("maximum_planned_open_risk_fraction"), F.max("protected_lots").alias("maximum_protected_lots"),
    )
    r = F.col("net_return")
    trades = ledger.filter("kind = 'trade'").groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("closed_trades"), F.count_if(r > 0).alias("winning_trades"), F.count_if(r < 0).alias("losing_trades"), F.count_if(F.abs(r) <= 1e-12).alias("breakeven_trades"), F.avg(r).alias("mean_net_trade_return"), F.median(r).alias("median_net_trade_return"),
        F.avg(F.when(r > 0, r)).alias("average_winning_trade_return"), F.avg(F.when(r < 0, r)).alias("average_losing_trade_return"), F.coalesce(F.sum(F.when(r > 0, F.col("pnl"))), F.lit(0.0)).alias("gross_profit"), F.coalesce(-F.sum(F.when(r < 0, F.col("pnl"))), F.lit(0.0)).alias("gross_loss_absolute"),
        F.avg("exit_observation").alias("mean_holding_observations"), F.avg(F.date_diff("d", "entry_date")).alias("mean_calendar_holding_days"), F.count_if("trailing").alias("trailing_activated_trades"),
        F.sum("buy_fee").alias("total_buy_fees"), F.sum("sell_tax").alias("total_sell_tax"), F.sum("sell_other_fee").alias("total_sell_non_tax_fees"), F.sum("buy_slippage").alias("total_buy_slippage"), F.sum("sell_slippage").alias("total_sell_slippage"),
    )
    decided = ledger.filter("kind = 'decision'").groupBy("scenario_id").agg(_decided(ledger).alias("selected_signals"), _decided(ledger, "accepted").alias("accepted_signals"), _decided(ledger, "rejected").alias("rejected_signals"))
    t = scenarios.select("scenario_id", "is_primary", "initial_capital", "slippage", "structure", "exit_style").join(days, "scenario_id").join(trades, "scenario_id", "left").join(decided, "scenario_id", "left")
    span = F.greatest(F.lit(1), F.date_diff("last_execution_date", "first_execution_date"))
    t = t.withColumn("calendar_days", span).withColumn("total_return", F.col("final_equity") / F.col("initial_capital") - 1.0).withColumn("cagr", F.pow(F.col("final_equity") / F.col("initial_capital"), 365.2425 / F.col("calendar_days")) - 1.0)
    year = math.sqrt(252)
    return t.withColumns({
        "net_profit": F.col("final_equity") - F.col("initial_capital"), "annualized_volatility": F.col("_s") * year, "sharpe_zero_risk_free": _div(F.col("_m"), F.col("_s")) * year, "sortino_zero_target": _div(F.col("_m"), F.col("_ds")) * year, "calmar_ratio": _div(F.col("cagr"), F.abs("maximum_drawdown")),
        "acceptance_rate": _div(F.col("accepted_signals"), F.col("selected_signals")), "net_win_rate": _div(F.col("winning_trades"), F.col("closed_trades")), "net_payoff_ratio": _div(F.col("average_winning_trade_return"), F.abs("average_losing_trade_return")), "net_profit_factor": _div(F.col("gross_profit"), F.col("gross_loss_absolute")),
    }).drop("_m", "_s", "_ds")
