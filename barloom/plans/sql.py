"""The same queries in DuckDB's SQL, over the given tables: the oracle of the correctness tests."""

from __future__ import annotations


def lit(x: float) -> str:
    return f"{x!r}::DOUBLE"


def rnd(sql: str, **digits: int) -> str:
    """sql with the named columns rounded."""
    inner = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in digits.items())
    return f"SELECT * REPLACE ({inner}) FROM (\n{sql}\n)"


BARS = """
agg AS (SELECT l_suppkey symbol, CAST(l_shipdate AS DATE) d, sum(CAST(round(l_discount * 100.0::DOUBLE) AS BIGINT) - 5) k, sum(CAST(l_quantity AS BIGINT)) v, sum(CAST(round(l_tax * 100.0::DOUBLE) AS BIGINT)) tx FROM lineitem GROUP BY 1, 2),
px AS (SELECT *, round(1000.0::DOUBLE * exp(sum(k) OVER (PARTITION BY symbol ORDER BY d) / 100.0::DOUBLE), 4) c FROM agg),
op AS (SELECT *, coalesce(lag(c) OVER w, c) * (1.0::DOUBLE + CAST(v % 5 - 2 AS DOUBLE) * 0.002::DOUBLE) o, CAST(row_number() OVER w - 1 AS BIGINT) pos FROM px WINDOW w AS (PARTITION BY symbol ORDER BY d)),
bars AS MATERIALIZED (SELECT symbol, d, pos, o, greatest(c, o) * (1.0::DOUBLE + CAST(tx AS DOUBLE) * 0.001::DOUBLE) h, least(c, o) * (1.0::DOUBLE - CAST(tx AS DOUBLE) * 0.001::DOUBLE) l, c, CAST(v AS BIGINT) vol, c * CAST(v AS DOUBLE) tv FROM op)"""


def labels(up: float = 0.15, down: float = -0.15, h: int = 30, name: str = "lab") -> str:
    u, d = lit(1.0 + up), lit(1.0 + down)
    return f"""
{name}_hit AS (SELECT b.symbol, b.pos, min(f.pos) fp FROM bars b JOIN bars f ON f.symbol = b.symbol AND f.pos BETWEEN b.pos + 1 AND b.pos + {h} WHERE f.h >= b.c * {u} OR f.l <= b.c * {d} GROUP BY 1, 2),
{name}_n AS (SELECT symbol, max(pos) mp, max(d) md FROM bars GROUP BY 1),
{name} AS MATERIALIZED (SELECT b.*, CASE WHEN fp IS NOT NULL OR mp - b.pos >= {h} THEN 'labeled' ELSE 'right_censored' END label_status,
  CASE WHEN fp IS NULL THEN CASE WHEN mp - b.pos >= {h} THEN 'vertical' ELSE 'none' END WHEN f.l <= b.c * {d} THEN 'lower' ELSE 'upper' END barrier_touched,
  CASE WHEN fp IS NULL THEN CASE WHEN mp - b.pos >= {h} THEN v.c / b.c - 1.0::DOUBLE END WHEN f.l <= b.c * {d} THEN {lit(down)} ELSE {lit(up)} END event_return,
  coalesce(f.d, v.d, md) event_end_date, CAST(CASE WHEN fp IS NOT NULL THEN fp - b.pos ELSE least(mp - b.pos, {h}) END AS BIGINT) holding,
  CASE WHEN fp IS NULL THEN CASE WHEN mp - b.pos >= {h} THEN CAST(v.c / b.c - 1.0::DOUBLE > 0 AS BIGINT) END WHEN f.l <= b.c * {d} THEN 0 ELSE 1 END AS "label",
  coalesce(f.l <= b.c * {d} AND f.h >= b.c * {u}, false) double_touch, fp IS NOT NULL OR mp - b.pos >= {h} eligible
  FROM bars b JOIN {name}_n n USING (symbol) LEFT JOIN {name}_hit x ON x.symbol = b.symbol AND x.pos = b.pos LEFT JOIN bars f ON f.symbol = b.symbol AND f.pos = x.fp LEFT JOIN bars v ON v.symbol = b.symbol AND v.pos = b.pos + {h})"""


EVENTS = """
ev AS MATERIALIZED (SELECT CAST(symbol AS VARCHAR) || '::' || strftime(d, '%Y-%m-%d') event_id, symbol, d, pos, event_end_date, "label" meta_label, event_return, barrier_touched, holding, c,
  CAST((symbol * 7919 + pos * 104729) % 10007 AS DOUBLE) / 10007.0::DOUBLE score FROM lab WHERE eligible)"""


def _folds(k: int = 5) -> str:
    blocks, prev = [], None
    for i in range(1, k):
        after = f"v.j > {prev}.j AND v.cum > {prev}.cum" if prev else "v.cum > 0"
        blocks.append(f"b{i} AS MATERIALIZED (SELECT v.j, v.cum FROM v{', ' + prev if prev else ''} WHERE {after} AND tot - v.cum >= {k - i} AND v.j < len - {k - i} ORDER BY abs(v.cum - {i} * tot / {k}.0::DOUBLE), v.j LIMIT 1)")
        prev = f"b{i}"
    ends = " UNION ALL ".join(f"SELECT {i} fold_id, {'0' if i == 1 else f'(SELECT j FROM b{i - 1}) + 1'} s, {f'(SELECT j FROM b{i})' if i < k else '(SELECT max(j) FROM v)'} e" for i in range(1, k + 1))
    return f"""
cal AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) - 1 i FROM (SELECT DISTINCT d FROM bars)),
cnt AS MATERIALIZED (SELECT cal.d, cal.i, CAST(coalesce(n, 0) AS BIGINT) n FROM cal LEFT JOIN (SELECT d, count(*) n FROM ev GROUP BY d) x ON x.d = cal.d),
m AS (SELECT greatest(CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT), 31) fi FROM cal),
v AS MATERIALIZED (SELECT i - fi j, n, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) cum, count(*) OVER () len, CAST(sum(n) OVER () AS BIGINT) tot FROM cnt, m WHERE i >= fi),
{", ".join(blocks)},
ends AS ({ends}),
folds AS MATERIALIZED (SELECT CAST(fold_id AS BIGINT) fold_id, (SELECT min(d) FROM cal) train_start_date, tr.d train_end_date, es.d embargo_start_date, ee.d embargo_end_date, vs.d validation_start_date, ve.d validation_end_date,
  CAST(tr.i AS BIGINT) train_end_index, CAST(vs.i AS BIGINT) validation_start_index, CAST(ve.i AS BIGINT) validation_end_index, CAST(e - s + 1 AS BIGINT) validation_days, (SELECT max(tot) FROM v) / {k}.0::DOUBLE target_events,
  (SELECT CAST(sum(n) AS BIGINT) FROM v WHERE j BETWEEN s AND e) actual_events
  FROM ends, m JOIN cal vs ON vs.i = fi + s JOIN cal ve ON ve.i = fi + e JOIN cal tr ON tr.i = fi + s - 31 JOIN cal es ON es.i = fi + s - 30 JOIN cal ee ON ee.i = fi + s - 1),
mem AS MATERIALIZED (SELECT ev.*, fold_id, train_end_date, validation_start_date, validation_end_date, CASE WHEN ev.d <= train_end_date AND event_end_date < validation_start_date THEN 'train' WHEN ev.d <= train_end_date THEN 'purged' WHEN ev.d < validation_start_date THEN 'embargo' ELSE 'validation' END "role"
  FROM ev JOIN folds ON ev.d <= validation_end_date)"""


FOLDS = _folds()


def with_(*parts: str) -> str:
    recursive = any("/*recursive*/" in p for p in parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n"


BL = (BARS, labels())
BE = (*BL, EVENTS)
BF = (*BE, FOLDS)

IDX_OBS = """
day AS (SELECT d, CAST(floor(avg(c) * 10000 + 0.3137::DOUBLE) AS DOUBLE) / 10000 ic, CAST(floor(avg(l) * 10000 + 0.3137::DOUBLE) AS DOUBLE) / 10000 il, CAST(floor(avg(h) * 10000 + 0.3137::DOUBLE) AS DOUBLE) / 10000 ih FROM bars GROUP BY d),
obs AS MATERIALIZED (SELECT b.symbol, b.d, CASE WHEN b.symbol = 7 AND dayofyear(b.d) % 97 = 0 THEN ic + 1.0::DOUBLE ELSE ic END ic, il, ih FROM bars b JOIN day USING (d))"""
IDX = IDX_OBS + """,
idx AS MATERIALIZED (SELECT d, median(ic) ic, median(il) il, median(ih) ih, row_number() OVER (ORDER BY d) i FROM obs GROUP BY d)"""


def ema(name: str, source: str, keys: str, order: str, value: str, spans: dict[str, int]) -> str:
    """Recursive exponential means over rows numbered from 1 in `order`; null before as many rows as the span has."""
    a = {c: (2.0 / (n + 1.0), 1.0 - 2.0 / (n + 1.0)) for c, n in spans.items()}
    first = ", ".join(f"CAST({value} AS DOUBLE) {c}" for c in spans)
    step = ", ".join(f"{lit(keep)} * {name}_r.{c} + {lit(gain)} * x.{value}" for c, (gain, keep) in a.items())
    out = ", ".join(f"CASE WHEN n >= {spans[c]} THEN {c} END {c}" for c in spans)
    k, kx, on = (f"{keys}, ", f"x.{keys}, ", f"x.{keys} = {name}_r.{keys} AND ") if keys else ("", "", "")
    return f"""/*recursive*/
{name}_s AS MATERIALIZED (SELECT {k}{order}, {value}, CAST(row_number() OVER ({f'PARTITION BY {keys} ' if keys else ''}ORDER BY {order}) AS BIGINT) n FROM {source}),
{name}_r AS (SELECT {k}{order}, n, {first} FROM {name}_s WHERE n = 1 UNION ALL SELECT {kx}x.{order}, x.n, {step} FROM {name}_r JOIN {name}_s x ON {on}x.n = {name}_r.n + 1),
{name} AS MATERIALIZED (SELECT {k}{order}, n, {out} FROM {name}_r)"""


def breadth(universe: str = "(SELECT count(DISTINCT symbol) FROM bars)") -> str:
    return f"""
ret AS (SELECT symbol, d, c / lag(c) OVER (PARTITION BY symbol ORDER BY d) - 1 r FROM bars),
bday AS MATERIALIZED (SELECT d, count(*) FILTER (r > 0) positive, count(*) FILTER (r < 0) negative, count(*) FILTER (r = 0) unchanged, count(r) valid, count(DISTINCT symbol) priced FROM ret GROUP BY d),
braw AS MATERIALIZED (SELECT *, valid / CAST({universe} AS DOUBLE) coverage, CASE WHEN valid > 0 THEN (positive - negative) / CAST(valid AS DOUBLE) END raw_breadth FROM bday),
bval AS (SELECT d, raw_breadth FROM braw WHERE raw_breadth IS NOT NULL),
{ema("be", "bval", "", "d", "raw_breadth", {"breadth_ema": 30})},
bsl AS (SELECT *, breadth_ema - lag(breadth_ema, 5) OVER (ORDER BY d) breadth_slope FROM (SELECT braw.*, be.breadth_ema FROM braw LEFT JOIN be USING (d))),
br AS MATERIALIZED (SELECT *, CASE WHEN breadth_ema IS NULL THEN 'warmup_or_missing' WHEN breadth_ema < -0.2::DOUBLE THEN 'broad_decline' WHEN breadth_ema > 0.2::DOUBLE THEN 'broad_advance' WHEN breadth_slope > 0 THEN 'recovery' WHEN breadth_slope < 0 THEN 'deterioration' WHEN breadth_slope = 0 THEN 'transition_flat' ELSE 'warmup_or_missing' END regime FROM bsl)"""


MARKET = IDX + "," + ema("ie", "idx", "", "d", "ic", {"fast": 20, "slow": 60}) + """,
mk0 AS (SELECT idx.*, ln(ic / lag(ic) OVER (ORDER BY d)) lr, ic / lag(ic, 1) OVER (ORDER BY d) - 1 r1, ic / lag(ic, 5) OVER (ORDER BY d) - 1 r5, ic / lag(ic, 20) OVER (ORDER BY d) - 1 r20 FROM idx),
market AS MATERIALIZED (SELECT mk0.d, r1 market_return_1, r5 market_return_5, r20 market_return_20,
  CASE WHEN count(lr) OVER (ORDER BY mk0.d ROWS 19 PRECEDING) = 20 THEN stddev_pop(lr) OVER (ORDER BY mk0.d ROWS 19 PRECEDING) END market_volatility_20,
  (ic - fast) / ic market_ema_20_distance, (ic - slow) / ic market_ema_60_distance, CASE WHEN ih >= il AND ic BETWEEN il AND ih THEN (ih - il) / ic END market_range_fraction,
  CASE WHEN ih > il AND ic BETWEEN il AND ih THEN (ic - il) / (ih - il) WHEN ih = il AND ic = il THEN CASE WHEN r1 > 0 THEN 1.0::DOUBLE WHEN r1 < 0 THEN 0.0::DOUBLE END END market_close_location,
  CASE WHEN count(ic) OVER (ORDER BY mk0.d ROWS 59 PRECEDING) = 60 THEN ic / max(ic) OVER (ORDER BY mk0.d ROWS 59 PRECEDING) - 1 END market_drawdown_60
  FROM mk0 JOIN ie ON ie.d = mk0.d)"""

PIVOTS = """
pv AS (SELECT symbol, d, pos, h, l, max(h) OVER lf lh, max(h) OVER rt rh, max(h) OVER af ah, min(l) OVER lf ll, min(l) OVER rt rl, min(l) OVER af al, count(h) OVER lf nl, count(h) OVER rt nr, lead(pos, 16) OVER w cp, lead(d, 16) OVER w cd FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY d), lf AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), rt AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), af AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 6 FOLLOWING AND 16 FOLLOWING)),
piv AS MATERIALIZED (SELECT symbol, cp confirm, pos AS "pivot", true high, h price, d pivot_date, cd confirm_date FROM pv WHERE nl = 5 AND nr = 5 AND lh <= h AND rh < h AND ah <= h AND cp IS NOT NULL
  UNION ALL SELECT symbol, cp, pos, false, l, d, cd FROM pv WHERE nl = 5 AND nr = 5 AND ll >= l AND rl > l AND al >= l AND cp IS NOT NULL)"""

ZIGZAG = PIVOTS + """,/*recursive*/
pe AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confirm, "pivot", high) n FROM piv),
zz AS (SELECT symbol, n, confirm, CASE WHEN high THEN price END hp, CASE WHEN high THEN pivot_date END hd, CASE WHEN NOT high THEN price END lp, CASE WHEN NOT high THEN pivot_date END ld, high up FROM pe WHERE n = 1
  UNION ALL SELECT z.symbol, z.n, z.confirm, CASE WHEN take AND high THEN price ELSE hp END, CASE WHEN take AND high THEN pivot_date ELSE hd END, CASE WHEN take AND NOT high THEN price ELSE lp END, CASE WHEN take AND NOT high THEN pivot_date ELSE ld END, CASE WHEN take THEN high ELSE up END
  FROM (SELECT e.symbol, e.n, e.confirm, e.high, e.price, e.pivot_date, zz.hp, zz.hd, zz.lp, zz.ld, zz.up,
    CASE WHEN zz.up = e.high THEN CASE WHEN e.high THEN e.price > zz.hp ELSE e.price < zz.lp END
      ELSE CASE WHEN zz.up THEN zz.hp ELSE zz.lp END > 0 AND abs(100.0::DOUBLE * (e.price - CASE WHEN zz.up THEN zz.hp ELSE zz.lp END) / CASE WHEN zz.up THEN zz.hp ELSE zz.lp END) >= 15.0::DOUBLE END take
    FROM zz JOIN pe e ON e.symbol = zz.symbol AND e.n = zz.n + 1) z),
zl AS (SELECT symbol, confirm, arg_max(hp, n) hp, arg_max(hd, n) hd, arg_max(lp, n) lp, arg_max(ld, n) ld, max(n) n FROM (SELECT symbol, confirm, n, struct_pack(x := hp) hp, struct_pack(x := hd) hd, struct_pack(x := lp) lp, struct_pack(x := ld) ld FROM zz) GROUP BY 1, 2),
zs AS MATERIALIZED (SELECT lab.*, zl.hp.x confirmed_high, zl.hd.x confirmed_high_date, zl.lp.x confirmed_low, zl.ld.x confirmed_low_date, (c - zl.lp.x) / c up_dist, (zl.hp.x - c) / c down_dist FROM lab ASOF LEFT JOIN zl ON zl.symbol = lab.symbol AND zl.confirm <= lab.pos)"""
