"""DuckDB SQL for queries whose meaning takes more than a line: written from the definitions, apart from the Spark code."""

from __future__ import annotations

from .inputs import BARS, BLOCKS, FEATURES, LABELLED, PART, REGIME3, TICKS, TRADES, bars_sql, ewm_sql, frame, lag, roll, six, stamp
from .queries import BAD, CASCADES, DETAIL, F2, G, GOOD, HZ, L, LABELS3, MATRIX, PAIRS, PLACED, PP, RM, SQL as PLAIN, TYPES

SQL: dict[str, str] = {}
Z20 = "CASE WHEN z20 < -1 THEN 1 WHEN z20 > 1 THEN -1 ELSE 0 END"
RP = "PARTITION BY hypothesis ORDER BY ts, event_id"

SQL["corr_summary"] = f"""WITH {PAIRS}, x AS (SELECT *, count(*) {frame(60, PP)} AS n, corr(close_a, close_b) {frame(60, PP)} AS c FROM pairs)
SELECT a, b, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS std, round(min(c), 6) + 0.0::DOUBLE AS low, round(max(c), 6) + 0.0::DOUBLE AS high,
CASE WHEN stddev_samp(c) < 0.1 THEN 'STABLE' WHEN stddev_samp(c) < 0.25 THEN 'MODERATE' ELSE 'UNSTABLE' END AS band FROM x WHERE n >= 60 AND c IS NOT NULL AND NOT isnan(c) GROUP BY 1, 2"""

# a chain's stationary weights are sums over the trees that lead to a state: for three states, of three products each
_STATES = range(3)
_P = {(i, j): f"p{i}{j}" for i in _STATES for j in _STATES if i != j}
_TREES = {i: " + ".join(f"{_P[a]} * {_P[b]}" for a, b in (((j, i), (k, i)), ((j, k), (k, i)), ((k, j), (j, i)))) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))}
SQL["steady_state"] = f"""WITH {MATRIX}, m AS (SELECT symbol, {', '.join(f'''coalesce(max(CASE WHEN "from" = '{LABELS3[i]}' THEN to_{LABELS3[j]} END), 0) AS {p}''' for (i, j), p in _P.items())} FROM matrix GROUP BY 1),
t AS (SELECT symbol, {', '.join(f'{v} AS w{i}' for i, v in _TREES.items())} FROM m)
{' UNION ALL '.join(f"SELECT symbol, '{LABELS3[i]}' AS regime, round(w{i} / (w0 + w1 + w2), 6) + 0.0::DOUBLE AS p FROM t" for i in _STATES)}"""

_HYST = PLAIN["hysteresis"]
SQL["hysteresis_stream"] = _HYST
SQL["regime_quality_report"] = _HYST[: _HYST.rindex("SELECT symbol")] + """, f AS (SELECT src.symbol, src.regime, src.c, h.cur FROM h JOIN src USING (symbol, n))
SELECT symbol, count(*) AS bars, round(avg((regime = cur)::INT), 6) AS agreement, round(avg(c), 6) AS mean_confidence, round(avg((c < 0.55)::INT), 6) AS low_confidence, count(DISTINCT cur) AS labels FROM f GROUP BY 1"""

SLOPES = f"""src AS MATERIALIZED (SELECT *, row_number() OVER ({PART}) AS n FROM features), {ewm_sql('e', 'src', {'e20': ('close', 2 / 21), 'e50': ('close', 2 / 51), 'e200': ('close', 2 / 201)})},
lab AS (SELECT src.*, e20, e50, e200, {lag('e200')} - {lag('e200', 6)} AS slope_near, {lag('e200')} - {lag('e200', 21)} AS slope_far, e20 - {lag('e20', 5)} AS slope20 FROM src JOIN e USING (symbol, n))"""
_FOUR = ("TRENDING", "MEAN_REVERTING", "HIGH_VOL", "LOW_VOL")
SQL["regime4"] = f"""WITH RECURSIVE {FEATURES}, {SLOPES},
r AS (SELECT symbol, CASE WHEN coalesce(atr_ratio > 1.4, false) OR coalesce(disorder > 0.55, false) THEN 'HIGH_VOL' WHEN coalesce(atr_ratio < 0.75, false) THEN 'LOW_VOL'
  WHEN (slope_near / close) * (slope_far / close) > 0 AND greatest(abs(slope_near / close), abs(slope_far / close)) > 0.0002 THEN 'TRENDING' ELSE 'MEAN_REVERTING' END AS regime FROM lab),
l(regime) AS (VALUES {', '.join(f"('{x}')" for x in _FOUR)}), s AS (SELECT symbol, count(*) AS n FROM r GROUP BY 1), k AS (SELECT symbol, regime, count(*) AS c FROM r GROUP BY 1, 2)
SELECT s.symbol, l.regime, coalesce(c, 0) AS bars, round(coalesce(c, 0) / n, 6) AS share FROM s CROSS JOIN l LEFT JOIN k ON k.symbol = s.symbol AND k.regime = l.regime"""

LIVE = f"""{F2}, w1 AS (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS down, coalesce(close - {lag('close')}, 0) AS step, {roll('avg', 'atr', 50, 10)} AS a50, row_number() OVER ({PART}) AS n,
  {roll('avg', 'close', 20, 20)} AS bb_mid, {roll('stddev_pop', 'close', 20, 20)} AS sd, {roll('min', 'low', 14, 14)} AS low14, {roll('max', 'high', 14, 14)} AS high14 FROM f2),
src AS MATERIALIZED (SELECT symbol, ts, n, close, atr, tr, bb_mid, sd, 100 * ((close - low14) / nullif(high14 - low14, 0)) AS stoch_k, CASE WHEN a50 <> 0 THEN least(greatest(atr / a50, 0), 99) END AS atr_ratio,
  CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m, greatest(step, 0) AS gain, greatest(-step, 0) AS loss FROM w1),
{ewm_sql('e', 'src', {'sp': ('p', 1 / 14), 'sm': ('m', 1 / 14), 'st': ('tr', 1 / 14), 'g': ('gain', 1 / 14), 'l': ('loss', 1 / 14), 'f': ('close', 2 / 13), 's': ('close', 2 / 27)})},
di AS (SELECT src.*, g, l, f - s AS macd, CASE WHEN n >= 14 THEN 100 * (sp / nullif(st, 0)) END AS plus_di, CASE WHEN n >= 14 THEN 100 * (sm / nullif(st, 0)) END AS minus_di FROM e JOIN src USING (symbol, n)),
dx AS MATERIALIZED (SELECT symbol, n, macd, 100 * (abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)) AS dx FROM di),
{ewm_sql('a', 'dx', {'adx_raw': ('dx', 1 / 14), 'macd_signal': ('macd', 2 / 10)})},
v1 AS (SELECT di.*, macd_signal, CASE WHEN n >= 27 THEN adx_raw END AS adx, CASE WHEN n >= 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END END AS rsi,
  bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower, (close - (bb_mid - 2 * sd)) / nullif((bb_mid + 2 * sd) - (bb_mid - 2 * sd), 0) AS bb_pct FROM di JOIN a USING (symbol, n)),
live AS (SELECT *, CASE WHEN macd > macd_signal AND {lag('macd')} <= {lag('macd_signal')} THEN 1 WHEN macd < macd_signal AND {lag('macd')} >= {lag('macd_signal')} THEN -1 ELSE 0 END AS crossed,
  CASE WHEN atr_ratio >= 1.5 THEN 'HIGH_VOLATILITY' WHEN adx >= 25 AND plus_di > minus_di THEN 'TREND_UP' WHEN adx >= 25 THEN 'TREND_DOWN' ELSE 'RANGE' END AS regime FROM v1)"""

SQL["adx_regime"] = f"""WITH RECURSIVE {LIVE} SELECT symbol, arg_max(regime, ts) AS regime, round(avg(coalesce(adx < 35 AND atr_ratio BETWEEN 0.8 AND 1.5, false)::INT), 6) AS retention FROM live GROUP BY 1"""

SQL["signal_scores"] = f"""WITH RECURSIVE {LIVE},
q AS (SELECT *, (close * 7) % 100 AS p1, (close * 11) % 100 AS p2, (coalesce(rsi < 35, false))::INT + (crossed = 1)::INT + (coalesce(close <= bb_lower * 1.002, false))::INT AS buys,
  (coalesce(rsi > 75, false))::INT + (crossed = -1)::INT + (coalesce(close >= bb_upper * 0.998, false))::INT AS sells FROM live),
s AS (SELECT *, CASE WHEN sells >= 2 THEN -1 WHEN buys >= 2 THEN 1 ELSE 0 END AS signal, least(greatest(coalesce(bb_pct, 0.5), 0), 1) AS pct, coalesce(stoch_k, 50) AS k, least(greatest(coalesce(adx, 0), 0), 50) / 50 * 10 AS trend FROM q),
b AS (SELECT *, coalesce(greatest(35 - rsi, 0), 0) / 35 * 14 + CASE WHEN crossed = 1 THEN 14 WHEN macd > macd_signal THEN 7 ELSE 0 END + (1 - pct) * 11 + trend + greatest(25 - k, 0) / 25 * 10 + greatest(p1 - 50, 0) / 50 * 20 + greatest(p2 - 50, 0) / 50 * 21 AS up,
  coalesce(greatest(rsi - 75, 0), 0) / 25 * 14 + CASE WHEN crossed = -1 THEN 14 WHEN macd < macd_signal THEN 7 ELSE 0 END + pct * 11 + trend + greatest(k - 75, 0) / 25 * 10 + greatest(50 - p1, 0) / 50 * 20 + greatest(50 - p2, 0) / 50 * 21 AS dn FROM s),
c AS (SELECT *, CASE signal WHEN 1 THEN round(least(greatest(up, 0), 100), 1) WHEN -1 THEN round(least(greatest(dn, 0), 100), 1) ELSE 0 END AS score, signal * 15 * CASE symbol WHEN 'error' THEN -0.6 WHEN 'click' THEN 0.4 ELSE 0 END AS tone FROM b)
SELECT symbol, {stamp()}, signal, round(score, 6) + 0.0::DOUBLE AS score,
  CASE WHEN regime <> 'RANGE' AND ((signal = 1 AND p1 > 50 AND p2 > 50) OR (signal = -1 AND p1 < 50 AND p2 < 50)) AND adx >= 20 AND coalesce(atr_ratio, 0) >= 0.8 THEN signal ELSE 0 END AS gated,
  CASE WHEN adx >= 25 AND ((signal = 1 AND stoch_k < 75) OR (signal = -1 AND stoch_k > 25)) THEN signal ELSE 0 END AS confirmed,
  round(0.4 * p1 + 0.4 * p2 + CASE signal WHEN 1 THEN 20 WHEN -1 THEN 0 ELSE 10 END, 6) + 0.0::DOUBLE AS ensemble_prob,
  round(CASE WHEN signal <> 0 THEN least(greatest(score + tone, 0), 100) ELSE 0 END, 6) + 0.0::DOUBLE AS final_score FROM c"""

_SIDES = {
    "stretch_reversion": ("dist < -1.5", "dist > 1.5"), "trend": ("bias = 1", "bias = -1"), "slope_cross": ("slope20 > 0 AND s0 <= 0", "slope20 < 0 AND s0 >= 0"), "breakout": ("close > hi", "close < lo"),
    "rsi_extremes": ("rsi < 30", "rsi > 70"), "slope_distance": ("slope20 > 0 AND d20 > 0", "slope20 < 0 AND d20 < 0"), "momentum": ("mom10 > atr", "mom10 < -atr"), "volatility": ("atr_ratio > 1.2 AND bias = 1", "atr_ratio > 1.2 AND bias = -1"),
}
_BACK = f"OVER ({PART} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
SQL["entry_rules"] = f"""WITH RECURSIVE {FEATURES}, {SLOPES}, st AS (SELECT *, coalesce(close - {lag('close')}, 0) AS step FROM lab),
x AS (SELECT *, CASE WHEN atr <> 0 THEN least(greatest((close - e50) / atr, -10), 10) END AS dist, (close - e20) / nullif(atr, 0) AS d20, CASE WHEN slope_near > 0 AND slope_far > 0 THEN 1 WHEN slope_near < 0 AND slope_far < 0 THEN -1 ELSE 0 END AS bias,
  {lag('slope20')} AS s0, CASE WHEN count(close) {_BACK} >= 20 THEN max(close) {_BACK} END AS hi, CASE WHEN count(close) {_BACK} >= 20 THEN min(close) {_BACK} END AS lo, {roll('avg', 'greatest(step, 0)', 14)} AS ups, {roll('avg', 'greatest(-step, 0)', 14)} AS downs FROM st),
y AS (SELECT *, CASE WHEN downs > 0 THEN 100 - 100 / (1 + ups / downs) END AS rsi FROM x)
SELECT symbol, {', '.join(f'sum(coalesce({up}, false)::INT)::BIGINT AS {n}_long, sum(coalesce({down}, false)::INT)::BIGINT AS {n}_short' for n, (up, down) in _SIDES.items())} FROM y GROUP BY 1"""


def _zsignal(name: str, bucket: str) -> str:
    return f"""{bars_sql('b_' + name, bucket)}, z_{name} AS (SELECT symbol, ts, coalesce((close - {roll('avg', 'close', 20)}) / nullif({roll('stddev_samp', 'close', 20)}, 0), 0) AS z FROM b_{name}),
s_{name} AS (SELECT symbol, CASE WHEN z < -0.3 THEN 1 WHEN z > 0.3 THEN -1 ELSE 0 END AS s FROM z_{name} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 2)"""


def _bucket(width: str) -> str:
    return f"time_bucket(INTERVAL {width}, ts, TIMESTAMP '1970-01-01')"


SQL["mtf_confluence"] = f"""WITH {TICKS}, {_zsignal('m15', _bucket('15 MINUTE'))}, {_zsignal('h1', _bucket('1 HOUR'))}, {_zsignal('h4', _bucket('4 HOUR'))},
a AS (SELECT * FROM s_m15 UNION ALL SELECT * FROM s_h1 UNION ALL SELECT * FROM s_h4), c AS (SELECT symbol, sum((s = 1)::INT)::BIGINT AS ups, sum((s = -1)::INT)::BIGINT AS downs FROM a GROUP BY 1)
SELECT *, CASE WHEN ups >= 2 THEN 1 WHEN downs >= 2 THEN -1 ELSE 0 END AS confluence FROM c"""


def _directed(name: str, width: str) -> str:
    return f"""{bars_sql('b_' + name, _bucket(width))}, t_{name} AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, sign(close - {lag('close')}) AS step, avg((close = open)::INT) OVER (PARTITION BY symbol) AS doji FROM b_{name}),
d_{name} AS (SELECT *, {roll('avg', 'tr', 14)} AS atr, CASE WHEN doji > 0.5 THEN coalesce(step, 0) ELSE sign(close - open) END AS dir FROM t_{name})"""


def _summary(table: str, kind: str) -> str:
    return f"SELECT symbol, count(*) AS windows, round(avg(score) * 100, 6) AS mean_score, {', '.join(f'round(quantile_cont(score, {q / 100}), 6) AS p{q}' for q in (10, 25, 50, 75, 90))}, '{kind}' AS kind FROM {table} GROUP BY 1"


SQL["coherence_disorder"] = f"""WITH {TICKS}, {_directed('fine', '5 MINUTE')}, {_directed('wide', '4 HOUR')}, g AS (SELECT *, {_bucket('4 HOUR')} AS w, {lag('dir')} AS d0 FROM d_fine),
f AS (SELECT symbol, w, count(*) AS n, sum(dir * abs(close - open)) / nullif(sum(abs(close - open)), 0) AS lean, stddev_samp(dir) AS spread, avg(CASE WHEN dir <> 0 AND d0 <> 0 THEN (dir <> d0)::INT END) AS flips, avg(atr) AS fine_atr, sum((dir > 0)::INT) AS ups, sum((dir < 0)::INT) AS downs FROM g GROUP BY 1, 2),
j AS (SELECT f.*, sign(d.close - d.open) AS way, d.atr AS wide_atr FROM f LEFT JOIN d_wide d ON d.symbol = f.symbol AND d.ts = f.w WHERE n >= 2),
c AS (SELECT symbol, 0.6 * coalesce((CASE WHEN way > 0 THEN ups ELSE downs END) / nullif(ups + downs, 0), 0) + 0.4 * greatest(0, 1 - coalesce(spread, 0)) AS score FROM j WHERE way <> 0 AND abs(lean) > 0.05),
o AS (SELECT symbol, 0.40 * coalesce(flips, 0) + 0.25 * coalesce(least(greatest((fine_atr / nullif(wide_atr, 0) - 0.5) / 1.5, 0 * (fine_atr / nullif(wide_atr, 0))), 1 + 0 * (fine_atr / nullif(wide_atr, 0))), 0.5)
  + 0.35 * coalesce((CASE WHEN way > 0 THEN downs WHEN way < 0 THEN ups END) / nullif(ups + downs, 0), 0.5) AS score FROM j)
{_summary('c', 'coherence')} UNION ALL {_summary('o', 'disorder')}"""

SQL["heatmap"] = f"WITH {RM} SELECT asset, " + ", ".join(f"round(max(CASE WHEN hypothesis = '{t}' THEN test_pf END), 6) AS {t}" for t in TYPES) + " FROM res GROUP BY 1"

_STEP = (1 - 0.4) / 3
SQL["expanding_folds"] = f"""WITH {BARS}, x AS (SELECT symbol, (floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY symbol)) / greatest(1, max(floor(epoch(ts))) OVER (PARTITION BY symbol) - min(floor(epoch(ts))) OVER (PARTITION BY symbol)) AS pos FROM bars),
y AS (SELECT symbol, k::INT AS fold, CASE WHEN pos < 0.4::DOUBLE + k * {_STEP!r}::DOUBLE THEN 'train' WHEN pos < 0.4::DOUBLE + (k + 1) * {_STEP!r}::DOUBLE OR (k = 2 AND pos <= 1) THEN 'test' END AS part FROM x CROSS JOIN (VALUES (0), (1), (2)) f(k))
SELECT symbol, fold, part, count(*) AS bars FROM y WHERE part IS NOT NULL GROUP BY 1, 2, 3"""

_OUT = PLAIN["fill_outcomes"]
SQL["outcome_coverage"] = _OUT[: _OUT.rindex(" SELECT s.id")] + ", r AS (" + " UNION ALL ".join(f"SELECT '{h}' AS horizon, o.r FROM s LEFT JOIN o{n} o USING (id)" for h, n in HZ.items()) + f") SELECT horizon, count(*) AS signals, round(avg((r IS NOT NULL)::INT), 6) AS filled, round({G.replace('pnl', 'r')} / nullif({L.replace('pnl', 'r')}, 0), 6) AS pf FROM r GROUP BY 1"


def _ks(rows: str, pairs: str) -> str:
    """From ``rows`` (symbol, g, v): ``ks`` (symbol, ks, p) of each of ``pairs`` (a, b) with ten rows a side."""
    series = " + ".join(f"{2 * (-1) ** (k - 1)}.0 * exp(-{2 * k * k}.0 * x * x)" for k in range(1, 21))
    return f"""k1 AS (SELECT symbol, a, b, v, sum((g = a)::INT) AS x, sum((g = b)::INT) AS y FROM {rows} JOIN ({pairs}) p(a, b) ON g = a OR g = b GROUP BY 1, 2, 3, 4),
k2 AS (SELECT symbol, a, b, sum(x) OVER o AS cx, sum(y) OVER o AS cy, sum(x) OVER e AS n, sum(y) OVER e AS m FROM k1 WINDOW o AS (PARTITION BY symbol, a, b ORDER BY v), e AS (PARTITION BY symbol, a, b)),
k3 AS (SELECT symbol, a, b, max(abs(cx / n - cy / m)) AS ks, sqrt(max(n)::DOUBLE * max(m) / (max(n) + max(m))) AS e FROM k2 WHERE n >= 10 AND m >= 10 GROUP BY 1, 2, 3), k4 AS (SELECT *, (e + 0.12 + 0.11 / e) * ks AS x FROM k3),
ks AS (SELECT symbol, ks, least(greatest({series}, 0), 1) AS p FROM k4)"""


_SEPARATED = f"""a1 AS (SELECT symbol, avg(ks) AS mean_ks, avg((p < 0.05)::INT) AS significant FROM ks GROUP BY 1), b1 AS (SELECT symbol, g, avg(v) AS e FROM rows GROUP BY 1, 2), b2 AS (SELECT symbol, max(e) - min(e) AS spread FROM b1 GROUP BY 1)
SELECT symbol, {six('mean_ks', 'significant', 'spread')}, round(0.5 * mean_ks + 0.3 * least(1, spread / 10) + 0.2 * significant, 6) AS score FROM a1 JOIN b2 USING (symbol)"""
SQL["separability_score"] = f"WITH {TRADES}, rows AS (SELECT hypothesis AS symbol, (asset % 2)::VARCHAR AS g, pnl AS v FROM trades), {_ks('rows', chr(86) + 'ALUES (' + repr('0') + ', ' + repr('1') + ')')}, {_SEPARATED}"
SQL["job_regime_separability"] = f"WITH {LABELLED}, rows AS (SELECT e.event_type AS symbol, l.regime AS g, e.value - 35 AS v FROM events e ASOF JOIN labelled l ON e.event_type = l.symbol AND e.ts >= l.ts), " + _ks("rows", "VALUES ('STRESS', 'COMPRESSED'), ('STRESS', 'STRUCTURED'), ('COMPRESSED', 'STRUCTURED')") + f", {_SEPARATED}"

_W30 = f"OVER ({RP} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
ROLLED = f"{TRADES}, rl AS (SELECT *, CASE WHEN count(pnl) {_W30} >= 30 THEN {G} {_W30} / nullif({L} {_W30}, 0) END AS pf FROM trades)"
DECAY = f"""{ROLLED}, d1 AS (SELECT hypothesis, pf, row_number() OVER ({RP}) AS i, count(*) OVER (PARTITION BY hypothesis) AS m, abs(pf - lag(pf) OVER ({RP})) AS step FROM rl WHERE pf IS NOT NULL),
d2 AS (SELECT *, avg(CASE WHEN i <= greatest(10, floor(m * 0.2::DOUBLE)) THEN pf END) OVER (PARTITION BY hypothesis) AS base FROM d1),
d3 AS (SELECT hypothesis, max(m) AS points, max(base) AS baseline, avg(CASE WHEN i > m * 0.7::DOUBLE THEN pf END) AS final, regr_slope(pf, i) AS slope, stddev_pop(pf) AS sd, avg(pf) AS mean, max(step) AS jump, arg_max(pf, i) AS last,
  avg(CASE WHEN i > m - 5 THEN pf END) AS near5, avg(CASE WHEN i > m - 15 AND i <= m - 5 THEN pf END) AS far10, min(CASE WHEN pf <= base / 2 THEN i END)::INT AS half_life FROM d2 GROUP BY 1),
decay AS (SELECT *, CASE WHEN points < 10 THEN 'INSUFFICIENT_DATA' WHEN jump > 6 * sd THEN 'STRUCTURAL_BREAK' WHEN abs(slope) < 0.002 AND sd / nullif(mean, 0) < 0.15 THEN 'STABLE' WHEN slope > 0.003 THEN 'IMPROVING'
  WHEN slope < -0.003 AND last < 1 THEN CASE WHEN abs(near5 - far10) < 0.05 THEN 'SATURATION' ELSE 'DECAY' END WHEN slope < -0.001 THEN 'DECAY' ELSE 'STABLE' END AS type FROM d3)"""
SQL["edge_decay"] = f"WITH {DECAY} SELECT hypothesis, points, {six('baseline', 'final', 'slope')}, half_life, type FROM decay"

_REC = PLAIN["cascade_recovery"]
RECOVERED = _REC[5 : _REC.rindex(" SELECT hypothesis, start_idx::INT")].strip().removeprefix("WITH ")
SQL["cascade_summary"] = f"""WITH {RECOVERED}, z AS (SELECT r.*, r.back - r.end_idx AS recovery, cs.cum_pnl FROM r JOIN cs ON cs.hypothesis = r.hypothesis AND cs.start_idx = r.start_idx)
SELECT hypothesis, count(*) AS cascades, round(avg(depth), 6) AS avg_depth, round(quantile_cont(depth, 0.5), 6) AS median_depth, round(quantile_cont(depth, 0.9), 6) AS p90_depth, max(depth) AS max_depth, round(min(cum_pnl), 6) AS worst,
round(avg(recovery), 6) AS avg_recovery, round(100.0 * avg((recovery IS NULL)::INT), 6) AS unrecovered_pct FROM z GROUP BY 1"""

TRANSITION_PF = f"""{PLACED}, p1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, island ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY symbol, island ORDER BY ts DESC, event_id DESC) AS z FROM placed),
bl AS (SELECT DISTINCT symbol, island, regime FROM placed), ch AS (SELECT symbol, island, regime AS f, lead(island) OVER w AS nxt, lead(regime) OVER w AS t FROM bl WINDOW w AS (PARTITION BY symbol ORDER BY island)),
sd AS (SELECT f, t, pnl AS b, NULL::DOUBLE AS a FROM p1 JOIN ch ON ch.symbol = p1.symbol AND ch.island = p1.island WHERE z <= 20 AND t IS NOT NULL UNION ALL SELECT f, t, NULL, pnl FROM p1 JOIN ch ON ch.symbol = p1.symbol AND ch.nxt = p1.island WHERE p1.a <= 20),
tp AS (SELECT f, t, {G.replace('pnl', 'b')} / nullif({L.replace('pnl', 'b')}, 0) AS pf_before, {G.replace('pnl', 'a')} / nullif({L.replace('pnl', 'a')}, 0) AS pf_after FROM sd GROUP BY 1, 2)"""
SQL["per_transition_pf"] = f"""WITH {TRANSITION_PF} SELECT f AS "from", t AS "to", {six('pf_before', 'pf_after')}, round(pf_after - pf_before, 6) + 0.0::DOUBLE AS delta, coalesce(pf_after < pf_before, false) AS degrades FROM tp"""

ZONE = f"""{BLOCKS}, zn AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol, island ORDER BY ts) <= 8 AS in_zone FROM islands),
zt AS (SELECT e.event_type AS symbol, e.value - 35 AS pnl, coalesce(z.in_zone, false) AS in_zone FROM events e ASOF LEFT JOIN zn z ON e.event_type = z.symbol AND e.ts >= z.ts),
za AS (SELECT symbol, sum(in_zone::INT)::BIGINT AS n_zone, sum((NOT in_zone)::INT)::BIGINT AS n_stable, {G.replace('pnl > 0', 'in_zone AND pnl > 0')} / greatest({L.replace('pnl < 0', 'in_zone AND pnl < 0')}, 1e-9) AS pf_zone,
  {G.replace('pnl > 0', 'NOT in_zone AND pnl > 0')} / greatest({L.replace('pnl < 0', 'NOT in_zone AND pnl < 0')}, 1e-9) AS pf_stable FROM zt GROUP BY 1)"""
SQL["zone_verdict"] = f"""WITH {ZONE} SELECT symbol, n_zone, n_stable, {six('pf_zone', 'pf_stable')}, CASE WHEN n_zone < 5 OR n_stable < 5 THEN 'INSUFFICIENT' WHEN pf_zone < 0.85 * pf_stable THEN 'DIE_AT_TRANSITIONS' WHEN pf_stable < 1 THEN 'DIE_WITHIN_REGIMES'
WHEN pf_zone < pf_stable THEN 'TRANSITION_SENSITIVE' ELSE 'TRANSITION_RESILIENT' END AS verdict FROM za"""

_PRE = PLAIN["precursor_lookup"]
SQL["early_entry_comparison"] = _PRE[: _PRE.rindex(" SELECT t.event_id")] + """, m AS (SELECT t.event_type AS symbol, t.value AS price, CASE WHEN t.event_id % 2 = 0 THEN 1 ELSE -1 END AS side, (epoch_us(t.ts) - epoch_us(b.ts)) / 3.6e9 AS h, b.close FROM events t ASOF LEFT JOIN b ON t.event_type = b.symbol AND t.ts > b.ts),
k AS (SELECT symbol, CASE WHEN h <= 12 THEN h END AS h, CASE WHEN h <= 12 THEN side * (price - close) END AS gain FROM m)
SELECT symbol, count(*) AS trades, sum((h IS NOT NULL)::INT)::BIGINT AS covered, round(avg((h IS NOT NULL)::INT), 6) AS coverage, round(avg(h), 6) AS avg_hours, round(avg(gain), 6) + 0.0::DOUBLE AS avg_gain, round(avg((gain > 0)::INT), 6) AS better FROM k GROUP BY 1"""

METRICS = f"""{TRADES}, cu AS (SELECT *, sum(pnl) OVER ({RP}) AS cum FROM trades), cd AS (SELECT *, max(cum) OVER ({RP}) - cum AS dd FROM cu),
mt AS (SELECT hypothesis, count(*) AS trades, 100.0 * avg((pnl > 0)::INT) AS win_rate, {G} / greatest({L}, 1e-9) AS pf, max(dd) AS max_drawdown, ({G} - greatest(max(pnl), 0)) / nullif({L}, 0) AS pf_without_best FROM cd GROUP BY 1)"""


def _scenario(pf: str) -> str:
    return f"CASE WHEN trades < 30 THEN 'TOO_FEW' WHEN {pf} >= 1.3 AND pf_without_best >= 1.1 AND max_drawdown <= 500 AND win_rate >= 40 THEN 'PROMOTE' WHEN {pf} >= 1.1 AND pf_without_best >= 1.0 THEN 'EXTEND' WHEN {pf} >= 1.0 THEN 'WATCH' ELSE 'STOP' END"


SQL["scenario_verdict"] = f"WITH {METRICS} SELECT hypothesis, {_scenario('pf')} AS verdict FROM mt"
SQL["scenario_criteria"] = f"WITH {METRICS} SELECT hypothesis, coalesce(trades >= 30, false) AS enough_trades, coalesce(pf >= 1.3, false) AS pf_ok, coalesce(pf_without_best >= 1.1, false) AS pf_without_best_ok, coalesce(max_drawdown <= 500, false) AS drawdown_ok, coalesce(win_rate >= 40, false) AS win_rate_ok FROM mt"
_DAILY = PLAIN["daily_sharpe_sortino"]
_NET = "sum(CASE WHEN pnl - 0.5 > 0 THEN pnl - 0.5 ELSE 0 END) / nullif(sum(CASE WHEN pnl - 0.5 < 0 THEN 0.5 - pnl ELSE 0 END), 0)"
SQL["job_incubation_review"] = f"""WITH {METRICS}, ds AS ({_DAILY}), nt AS (SELECT hypothesis, {G} / nullif({L}, 0) AS gross_pf, {_NET} AS net_pf, max(pnl) AS best FROM trades GROUP BY 1)
SELECT hypothesis, round(gross_pf, 6) AS gross_pf, round(net_pf, 6) AS net_pf, round(best, 6) AS best, round(pf_without_best, 6) + 0.0::DOUBLE AS pf_without_best, trades, round(win_rate, 6) AS win_rate, round(max_drawdown, 6) AS max_drawdown, days, sharpe, sortino, {_scenario('net_pf')} AS verdict
FROM mt JOIN nt USING (hypothesis) JOIN ds USING (hypothesis)"""


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SQL["keyword_sentiment"] = f"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM conversations),
n AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN {_in(GOOD)}))::INT AS n_good, len(list_filter(w, lambda x: x IN {_in(BAD)}))::INT AS n_bad FROM w),
c AS (SELECT *, CASE WHEN n_good > n_bad * 1.3 THEN 'positive' WHEN n_bad > n_good * 1.3 THEN 'negative' ELSE 'neutral' END AS sentiment, least(0.55, greatest(n_good, n_bad) / (n_good + n_bad + 1)) AS confidence FROM n),
b AS (SELECT *, 0.7 * confidence * CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END + 0.15 AS blend FROM c)
SELECT conv_id, turn, n_good, n_bad, sentiment, round(confidence, 6) AS confidence, round(blend, 6) + 0.0::DOUBLE AS blend, CASE WHEN blend > 0.05 THEN 'positive' WHEN blend < -0.05 THEN 'negative' ELSE 'neutral' END AS blend_label FROM b"""

_HIT = "CASE WHEN r.side * (s.close - r.stop) <= 0 THEN 'SL' WHEN r.side * (s.close - r.goal) >= 0 THEN 'TP' WHEN s.before = -r.side THEN 'OPPOSITE' END"
_FREE = "(y.side = 0 OR y.reason IS NOT NULL) AND y.before <> 0 AND y.atr > 0"


def close_only(source: str, sl: str = "2.5", tp: str = "4.0") -> str:
    """From ``source`` (symbol, ts, close, atr, signal), rows with a null left out: ``closed`` trades."""
    return f"""cs1 AS MATERIALIZED (SELECT *, row_number() OVER ({PART}) - 1 AS i, lag(signal) OVER ({PART}) AS before FROM {source} WHERE close IS NOT NULL AND atr IS NOT NULL AND signal IS NOT NULL),
co AS (SELECT symbol, i, 0 AS side, 0.0::DOUBLE AS entry, 0::BIGINT AS at, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS goal, 10000.0::DOUBLE AS capital, NULL::VARCHAR AS reason, 0 AS was, 0::BIGINT AS was_at, 0.0::DOUBLE AS was_entry, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS price FROM cs1 WHERE i = 0
UNION ALL SELECT y.symbol, y.i, CASE WHEN {_FREE} THEN y.before WHEN y.reason IS NOT NULL THEN 0 ELSE y.side END, CASE WHEN {_FREE} THEN y.close ELSE y.entry END, CASE WHEN {_FREE} THEN y.i ELSE y.at END,
  CASE WHEN {_FREE} THEN y.close - y.before * {sl} * y.atr ELSE y.stop END, CASE WHEN {_FREE} THEN y.close + y.before * {tp} * y.atr ELSE y.goal END, y.capital + y.gain, y.reason, y.side, y.at, y.entry, y.gain, y.close
FROM (SELECT x.*, CASE WHEN x.reason IS NOT NULL THEN x.side * (x.close - x.entry) / x.entry * x.capital * 0.1 ELSE 0 END AS gain FROM (SELECT s.symbol, s.i, s.close, s.atr, s.before, r.side, r.entry, r.at, r.stop, r.goal, r.capital, CASE WHEN r.side <> 0 THEN {_HIT} END AS reason
  FROM co r JOIN cs1 s ON s.symbol = r.symbol AND s.i = r.i + 1) x) y),
closed AS (SELECT symbol, was_at AS entry_idx, i AS exit_idx, was AS direction, was_entry AS entry_price, price AS exit_price, pnl, reason FROM co WHERE reason IS NOT NULL)"""


SQL["close_only_trades"] = f"WITH RECURSIVE {FEATURES}, sig AS (SELECT symbol, ts, close, atr, {Z20} AS signal FROM features), {close_only('sig')} SELECT symbol, entry_idx, exit_idx, direction, {six('entry_price', 'exit_price', 'pnl')}, reason FROM closed"

SPREADS = f"""{PAIRS}, sp1 AS (SELECT *, count(*) {frame(60, PP)} AS n, var_pop(close_b) {frame(60, PP)} AS v, covar_pop(close_a, close_b) {frame(60, PP)} AS cv, avg(close_a) {frame(60, PP)} AS ma, avg(close_b) {frame(60, PP)} AS mb FROM pairs),
sp2 AS (SELECT *, CASE WHEN n >= 60 AND v >= 1e-12 THEN cv / v END AS beta FROM sp1), sp3 AS (SELECT *, close_a - (beta * close_b + (ma - beta * mb)) AS spread FROM sp2),
sp4 AS (SELECT *, (spread - CASE WHEN count(spread) {frame(60, PP)} >= 60 THEN avg(spread) {frame(60, PP)} END) / nullif(CASE WHEN count(spread) {frame(60, PP)} >= 60 THEN stddev_samp(spread) {frame(60, PP)} END, 0) AS z FROM sp3),
sp5 AS MATERIALIZED (SELECT a, b, z, spread, row_number() OVER ({PP}) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS m FROM sp4 WHERE z IS NOT NULL)"""
_OUT_OF = "CASE WHEN r.side = 0 THEN NULL WHEN abs(s.z) >= 3.5 THEN 'STOP' WHEN r.side * s.z >= 0 THEN 'REVERT' END"
_IN_AT = "r.side = 0 AND abs(s.z) >= 2 AND abs(s.z) < 3.5"
SQL["pair_trades"] = f"""WITH RECURSIVE {SPREADS}, seed AS (SELECT a, b, -1::BIGINT AS i, 0 AS side, 0::BIGINT AS since, 0.0::DOUBLE AS held, NULL::VARCHAR AS reason, 0 AS was, 0.0::DOUBLE AS pnl FROM sp5 WHERE i = 0),
w AS (SELECT * FROM seed UNION ALL SELECT s.a, s.b, s.i, CASE WHEN {_IN_AT} THEN CASE WHEN s.z > 0 THEN -1 ELSE 1 END WHEN ({_OUT_OF}) IS NOT NULL THEN 0 ELSE r.side END, CASE WHEN {_IN_AT} THEN s.i ELSE r.since END, CASE WHEN {_IN_AT} THEN s.spread ELSE r.held END, {_OUT_OF}, r.side, r.side * (s.spread - r.held)
FROM w r JOIN sp5 s ON s.a = r.a AND s.b = r.b AND s.i = r.i + 1),
x AS (SELECT a, b, since AS entry_idx, i AS exit_idx, was AS direction, pnl, reason FROM w WHERE reason IS NOT NULL UNION ALL SELECT w.a, w.b, since, w.i, side, side * (s.spread - held), 'END' FROM w JOIN sp5 s ON s.a = w.a AND s.b = w.b AND s.i = w.i WHERE w.i = s.m - 1 AND side <> 0)
SELECT a, b, entry_idx, exit_idx, direction, round(pnl, 6) + 0.0::DOUBLE AS pnl, reason FROM x"""

SQL["alert_digest"] = """WITH a AS (SELECT user_id AS asset, ts, CASE WHEN value > 80 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS k, event_type || ' at ' || floor(value)::BIGINT AS message FROM events),
o AS (SELECT asset, substr(message, 1, 60) AS p, k, ts, message FROM a QUALIFY row_number() OVER (PARTITION BY asset, substr(message, 1, 60) ORDER BY k, ts, message) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY k, ts, message) AS r FROM o) SELECT asset, string_agg(CASE WHEN r <= 5 THEN message END, '; ' ORDER BY r) AS digest, count(*) - least(5, count(*)) AS more FROM n GROUP BY 1"""

_STOPPED = "CASE WHEN r.side = 0 THEN NULL WHEN r.sl IS NOT NULL AND (CASE WHEN r.side > 0 THEN s.low <= r.sl ELSE s.high >= r.sl END) THEN 'SL' WHEN r.tp IS NOT NULL AND (CASE WHEN r.side > 0 THEN s.high >= r.tp ELSE s.low <= r.tp END) THEN 'TP' END"
SQL["position_ledger"] = f"""WITH RECURSIVE {FEATURES}, sg AS (SELECT *, {Z20} AS signal FROM features),
b AS MATERIALIZED (SELECT symbol, ts, high, low, close, signal, CASE WHEN signal <> 0 THEN close - signal * 1.5 * atr END AS sl, CASE WHEN signal <> 0 THEN close + signal * 2.0 * atr END AS tp, row_number() OVER ({PART}) AS n FROM sg),
l AS (SELECT symbol, 0::BIGINT AS n, 0 AS side, NULL::DOUBLE AS entry, NULL::TIMESTAMP AS since, NULL::DOUBLE AS sl, NULL::DOUBLE AS tp, NULL::VARCHAR AS reason, 0 AS was, NULL::DOUBLE AS was_entry, NULL::TIMESTAMP AS was_at, NULL::DOUBLE AS price, NULL::TIMESTAMP AS ts FROM b WHERE n = 1
UNION ALL SELECT y.symbol, y.n, CASE WHEN opens THEN signal WHEN hit IS NOT NULL THEN 0 ELSE side END, CASE WHEN opens THEN close ELSE entry END, CASE WHEN opens THEN bar_ts ELSE since END, CASE WHEN opens THEN new_sl WHEN hit IS NOT NULL THEN NULL ELSE sl END, CASE WHEN opens THEN new_tp WHEN hit IS NOT NULL THEN NULL ELSE tp END,
  CASE WHEN hit IS NOT NULL THEN hit WHEN opens AND side <> 0 THEN 'REVERSED' END, side, entry, since, CASE hit WHEN 'SL' THEN sl WHEN 'TP' THEN tp ELSE close END, bar_ts
FROM (SELECT x.*, signal <> 0 AND signal <> (CASE WHEN hit IS NOT NULL THEN 0 ELSE side END) AS opens FROM (SELECT s.symbol, s.n, s.ts AS bar_ts, s.close, s.signal, s.sl AS new_sl, s.tp AS new_tp, r.side, r.entry, r.since, r.sl, r.tp, {_STOPPED} AS hit FROM l r JOIN b s ON s.symbol = r.symbol AND s.n = r.n + 1) x) y)
SELECT symbol, strftime(was_at, '%Y-%m-%d %H:%M:%S') AS entry_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS exit_time, was AS direction, round(was_entry, 6) AS entry_price, round(price, 6) AS exit_price, round(was * (price - was_entry) - 0.001 * (price + was_entry), 6) + 0.0::DOUBLE AS pnl, reason FROM l WHERE reason IS NOT NULL"""

SQL["loss_streak_alerts"] = f"""WITH {TRADES}, a AS (SELECT hypothesis, ts, event_id, pnl, sum((pnl >= 0)::INT) OVER ({RP}) AS run FROM trades), b AS (SELECT *, sum((pnl < 0)::INT) OVER (PARTITION BY hypothesis, run ORDER BY ts, event_id) AS depth FROM a),
c AS (SELECT *, lag(depth) OVER ({RP}) AS before FROM b)
SELECT hypothesis, {stamp()}, CASE WHEN pnl >= 0 THEN 'RECOVERED' WHEN depth >= 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, (CASE WHEN pnl >= 0 THEN before ELSE depth END)::INT AS depth FROM c WHERE (pnl < 0 AND (depth >= 5 OR depth % 2 = 0)) OR (pnl >= 0 AND before >= 2)"""

SQL["alert_throttle"] = f"""WITH RECURSIVE {TRADES}, a AS (SELECT asset::VARCHAR AS asset, hypothesis, CASE WHEN pnl > 20 THEN 'CRITICAL' ELSE 'INFO' END AS severity, ts, 1 + pnl / 100 AS pf FROM trades),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset, hypothesis, severity ORDER BY ts) AS n FROM a),
t AS (SELECT asset, hypothesis, severity, n, ts, pf, ts AS sent_at, pf AS sent_pf, true AS sent FROM k WHERE n = 1
UNION ALL SELECT asset, hypothesis, severity, n, ts, pf, CASE WHEN ok THEN ts ELSE sent_at END, CASE WHEN ok THEN pf ELSE sent_pf END, ok FROM (
  SELECT k.*, t.sent_at, t.sent_pf, (t.sent_pf > 0 AND (t.sent_pf - k.pf) / t.sent_pf > 0.15) OR epoch_us(k.ts) - epoch_us(t.sent_at) >= 3600000000 * CASE k.severity WHEN 'CRITICAL' THEN 2 ELSE 12 END AS ok
  FROM t JOIN k ON k.asset = t.asset AND k.hypothesis = t.hypothesis AND k.severity = t.severity AND k.n = t.n + 1))
SELECT asset, hypothesis, 'edge' AS type, severity, {stamp()}, round(pf, 6) + 0.0::DOUBLE AS pf FROM t WHERE sent"""

_W20 = f"OVER ({RP} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
SQL["rolling_pf_state"] = f"""WITH {TRADES}, a AS (SELECT hypothesis AS symbol, ts, (count(*) {_W20})::INT AS trades, CASE WHEN count(*) {_W20} >= 5 THEN {G} {_W20} / nullif({L} {_W20}, 0) END AS pf FROM trades)
SELECT symbol, {stamp()}, trades, round(pf, 5) AS pf, coalesce(pf < 1 AND trades >= 10, false) AS alert FROM a"""

SQL["staleness_timeout"] = "WITH x AS (SELECT event_type AS symbol, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS last, ts FROM events) SELECT symbol, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, ((epoch_us(ts) - epoch_us(last)) // 1000000)::BIGINT AS silent_for FROM x WHERE epoch_us(ts) - epoch_us(last) > 900000000"

_WN = lambda n: f"OVER ({RP} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_PFN = lambda n: f"CASE WHEN count(pnl) {_WN(n)} >= {n} THEN {G} {_WN(n)} / nullif({L} {_WN(n)}, 0) END AS pf_{n}"


def _status(baseline: str, decay: float) -> str:
    """``status``: each rule's latest profit factors and the status they give."""
    return f"""dg1 AS (SELECT hypothesis, ts, event_id, {', '.join(_PFN(n) for n in (30, 60, 90))} FROM trades), dg2 AS (SELECT hypothesis, count(*) AS trades, {', '.join(f'arg_max(pf_{n}, (ts, event_id)) AS pf_{n}' for n in (30, 60, 90))} FROM dg1 GROUP BY 1),
dg3 AS (SELECT *, list_filter([pf_30, pf_60, pf_90], lambda x: x IS NOT NULL) AS known, {baseline} AS baseline_pf FROM dg2), dg4 AS (SELECT *, CASE WHEN len(known) >= 2 THEN greatest(0, 1 - coalesce(list_stddev_pop(known), 0) / greatest(abs(list_avg(known)), 1e-9)) END AS evenness FROM dg3),
status AS (SELECT *, CASE WHEN trades < 30 THEN 'INSUFFICIENT_DATA' WHEN evenness < 0.2 THEN 'COLLAPSE' WHEN pf_30 > 0 AND pf_30 < pf_60 AND pf_60 < pf_90 AND pf_90 - pf_30 > {decay} THEN 'ACCELERATING_DECAY' WHEN pf_30 > 0 AND pf_30 < 0.6 * baseline_pf THEN 'OOS_DRIFT' ELSE 'NORMAL' END AS degradation_status FROM dg4)"""


SQL["degradation_status"] = f"WITH {TRADES}, {_status('4.5::DOUBLE', 0.05)} SELECT hypothesis, trades, {six('pf_30', 'pf_60', 'pf_90', 'evenness')}, baseline_pf, degradation_status FROM status"

_EARLY = f"(SELECT {G} / nullif({L}, 0) FROM trades t WHERE t.hypothesis = dg2.hypothesis AND day(ts) <= 15)"
SQL["edge_health"] = f"""WITH {TRADES}, {_status(_EARLY, 0.15)}, cs AS (SELECT hypothesis, avg((pf_30 > 1)::INT) AS consistency FROM dg1 GROUP BY 1),
st AS (SELECT hypothesis, (count(*) - coalesce(max(CASE WHEN pnl >= 0 THEN k END), 0))::BIGINT AS streak FROM (SELECT *, row_number() OVER ({RP}) AS k FROM trades) GROUP BY 1),
j AS (SELECT s.hypothesis, pf_30 AS pf, consistency, baseline_pf, pf_30 / nullif(baseline_pf, 0) AS pf_ratio, streak, degradation_status, (degradation_status = 'COLLAPSE')::INT AS critical_notes, (degradation_status IN ('ACCELERATING_DECAY', 'OOS_DRIFT'))::INT AS warning_notes, (degradation_status = 'INSUFFICIENT_DATA')::INT AS info_notes FROM status s JOIN cs USING (hypothesis) JOIN st USING (hypothesis)),
h AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN pf_ratio IS NULL THEN 8 WHEN pf_ratio >= 1 THEN 0 WHEN pf_ratio >= 0.9 THEN 4 WHEN pf_ratio >= 0.75 THEN 10 WHEN pf_ratio >= 0.5 THEN 18 ELSE 25 END
  - CASE WHEN consistency IS NULL THEN 5 WHEN consistency >= 0.75 THEN 0 WHEN consistency >= 0.55 THEN 4 WHEN consistency >= 0.35 THEN 10 WHEN consistency >= 0.2 THEN 15 ELSE 20 END
  - CASE WHEN streak <= 0 THEN 0 WHEN streak <= 2 THEN 3 WHEN streak <= 4 THEN 8 ELSE 15 END - CASE WHEN critical_notes > 0 THEN 15 WHEN warning_notes >= 2 THEN 10 WHEN warning_notes = 1 THEN 5 WHEN info_notes > 0 THEN 2 ELSE 0 END))::INT AS health FROM j)
SELECT hypothesis, {six('pf', 'consistency', 'baseline_pf', 'pf_ratio')}, CASE WHEN pf_ratio IS NULL THEN 'NO_DATA' WHEN pf_ratio >= 0.75 THEN 'HEALTHY' WHEN pf_ratio >= 0.5 THEN 'DEGRADED' ELSE 'BROKEN' END AS status, streak, degradation_status, critical_notes, warning_notes, info_notes, 0 AS anomaly_level, 0 AS transition_level, health,
CASE WHEN health >= 90 THEN 'EXCELLENT' WHEN health >= 75 THEN 'GOOD' WHEN health >= 60 THEN 'WATCH' WHEN health >= 40 THEN 'WARNING' ELSE 'CRITICAL' END AS band FROM h"""

SQL["risk_context"] = """WITH t AS (SELECT event_id, event_id % 3 <> 0 AS wild, event_id % 2 = 0 AS changed, (value - 35) / 40 AS r, event_id % 5 = 0 AS decayed FROM events),
n AS (SELECT *, list_filter([CASE WHEN wild THEN 'wild' END, CASE WHEN wild AND changed THEN 'calm to wild' END, CASE WHEN r < 0.5 THEN 'profit factor below half of its baseline' WHEN r < 0.75 THEN 'profit factor below three quarters of its baseline' END, CASE WHEN decayed THEN 'the edge has decayed' END], lambda x: x IS NOT NULL) AS l,
  (wild AND changed)::INT + (r < 0.5)::INT AS critical_notes, wild::INT + (r >= 0.5 AND r < 0.75)::INT + decayed::INT AS warning_notes FROM t)
SELECT event_id, CASE WHEN changed THEN CASE WHEN wild THEN -0.4 ELSE 0.1 END END::DOUBLE AS expected_pf_delta, array_to_string(l, ' | ') AS notes, 0 AS info_notes, warning_notes, critical_notes, CASE WHEN critical_notes > 0 THEN 'CRITICAL' WHEN warning_notes > 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM n"""


def _decay_type(n: int) -> str:
    """``ty{n}``: each rule's type of decay over windows of n trades, and its half-life."""
    w = f"OVER ({RP} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""ra{n} AS (SELECT *, CASE WHEN count(pnl) {w} >= {n} THEN {G} {w} / nullif({L} {w}, 0) END AS pf FROM trades),
rb{n} AS (SELECT hypothesis, pf, row_number() OVER ({RP}) AS i, count(*) OVER (PARTITION BY hypothesis) AS m, abs(pf - lag(pf) OVER ({RP})) AS step FROM ra{n} WHERE pf IS NOT NULL), rc{n} AS (SELECT *, avg(CASE WHEN i <= greatest(10, floor(m * 0.2::DOUBLE)) THEN pf END) OVER (PARTITION BY hypothesis) AS base FROM rb{n}),
rd{n} AS (SELECT hypothesis, max(m) AS points, regr_slope(pf, i) AS slope, stddev_pop(pf) AS sd, avg(pf) AS mean, max(step) AS jump, arg_max(pf, i) AS last, avg(CASE WHEN i > m - 5 THEN pf END) AS near5, avg(CASE WHEN i > m - 15 AND i <= m - 5 THEN pf END) AS far10, min(CASE WHEN pf <= base / 2 THEN i END)::INT AS half_life FROM rc{n} GROUP BY 1),
ty{n} AS (SELECT hypothesis, half_life, CASE WHEN points < 10 THEN 'INSUFFICIENT_DATA' WHEN jump > 6 * sd THEN 'STRUCTURAL_BREAK' WHEN abs(slope) < 0.002 AND sd / nullif(mean, 0) < 0.15 THEN 'STABLE' WHEN slope > 0.003 THEN 'IMPROVING'
  WHEN slope < -0.003 AND last < 1 THEN CASE WHEN abs(near5 - far10) < 0.05 THEN 'SATURATION' ELSE 'DECAY' END WHEN slope < -0.001 THEN 'DECAY' ELSE 'STABLE' END AS t FROM rd{n})"""


SQL["decay_consensus"] = f"""WITH {TRADES}, {', '.join(_decay_type(n) for n in (30, 60, 90))}, en AS (SELECT *, row_number() OVER ({RP}) AS i, count(*) OVER (PARTITION BY hypothesis) AS n FROM trades),
ep AS (SELECT hypothesis, {G.replace('pnl > 0', 'pnl > 0 AND i <= greatest(10, n // 5)')} / greatest({L.replace('pnl < 0', 'pnl < 0 AND i <= greatest(10, n // 5)')}, 1e-9) AS b, {G.replace('pnl > 0', 'pnl > 0 AND i > n - greatest(10, n * 3 // 10)')} / greatest({L.replace('pnl < 0', 'pnl < 0 AND i > n - greatest(10, n * 3 // 10)')}, 1e-9) AS f FROM en GROUP BY 1)
SELECT hypothesis, a.t AS type_30, a.half_life AS half_life_30, b.t AS type_60, b.half_life AS half_life_60, c.t AS type_90, c.half_life AS half_life_90, CASE WHEN b.t = c.t THEN b.t ELSE a.t END AS consensus, round(ep.b, 6) AS baseline_pf, round(ep.f, 6) AS final_pf, round((ep.f - ep.b) / greatest(ep.b, 1e-9), 6) + 0.0::DOUBLE AS decay_magnitude
FROM ty30 a JOIN ty60 b USING (hypothesis) JOIN ty90 c USING (hypothesis) JOIN ep USING (hypothesis)"""

_AS = PLAIN["adaptive_sizing"]
SQL["sizing_verdict"] = _AS[: _AS.rindex(" SELECT scenario")] + f""", p AS (SELECT scenario, {G.replace('pnl > 0', "period = 'train' AND sized > 0").replace('THEN pnl', 'THEN sized')} / greatest({L.replace('pnl < 0', "period = 'train' AND sized < 0").replace('THEN -pnl', 'THEN -sized')}, 1e-9) AS pf_in, {G.replace('pnl > 0', "period = 'test' AND sized > 0").replace('THEN pnl', 'THEN sized')} / greatest({L.replace('pnl < 0', "period = 'test' AND sized < 0").replace('THEN -pnl', 'THEN -sized')}, 1e-9) AS pf_out FROM s GROUP BY 1)
SELECT scenario, {six('pf_in', 'pf_out')}, round(pf_out / nullif(pf_in, 0), 6) AS degradation_ratio, CASE WHEN pf_out / nullif(pf_in, 0) >= 0.70 THEN 'ROBUST' WHEN pf_out / nullif(pf_in, 0) >= 0.5 THEN 'MODERATE' WHEN pf_in > 0 THEN 'FRAGILE' END AS verdict FROM p"""

_PB = "OVER (PARTITION BY symbol, block ORDER BY ts)"
SQL["period_diagnostics"] = f"""WITH RECURSIVE {LIVE}, es AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER ({PART}) AS n FROM bars), {ewm_sql('ee', 'es', {'ema50': ('close', 2 / 51), 'ema200': ('close', 2 / 201)})},
b0 AS (SELECT bars.*, live.adx, ema50, ema200, floor(epoch(bars.ts)) AS t FROM bars JOIN live USING (symbol, ts) JOIN ee ON ee.symbol = live.symbol AND ee.n = live.n),
b1 AS (SELECT *, least(4, floor((t - min(t) OVER (PARTITION BY symbol)) * 5 / greatest(1, max(t) OVER (PARTITION BY symbol) - min(t) OVER (PARTITION BY symbol))))::INT AS block, sign(close - open) AS sg FROM b0),
b2 AS (SELECT *, CASE WHEN lag(sg) {_PB} IS NULL OR lag(sg) {_PB} <> sg THEN 1 ELSE 0 END AS turn, ema50 - lag(ema50) {_PB} AS s50, ema200 - lag(ema200) {_PB} AS s200 FROM b1), b3 AS (SELECT *, sum(turn) {_PB} AS run FROM b2),
r1 AS (SELECT symbol, block, run, count(*) AS length, sum(close - open) AS move FROM b3 GROUP BY 1, 2, 3), r2 AS (SELECT symbol, block, avg(CASE WHEN length > 1 THEN length END) AS mean_run, max(abs(move)) AS largest_move FROM r1 GROUP BY 1, 2),
o AS (SELECT symbol, block, count(*) AS bars, avg(high - low) AS mean_range, avg(turn) AS reversals, avg((sg = 0)::INT) AS doji, avg(CASE WHEN hour(ts) < 8 THEN volume END) AS volume_asia, avg(CASE WHEN hour(ts) BETWEEN 8 AND 16 THEN volume END) AS volume_london,
  avg(CASE WHEN hour(ts) BETWEEN 13 AND 20 THEN volume END) AS volume_ny, avg(CASE WHEN hour(ts) BETWEEN 13 AND 16 THEN volume END) AS volume_overlap, avg(coalesce(adx > 35, false)::INT) AS adx_above_35, avg(s50) AS ema50_step, avg(s200) AS ema200_step FROM b3 GROUP BY 1, 2)
SELECT symbol, block, bars, {six('mean_range', 'reversals', 'doji', 'volume_asia', 'volume_london', 'volume_ny', 'volume_overlap', 'adx_above_35', 'ema50_step', 'ema200_step', 'mean_run', 'largest_move')} FROM o JOIN r2 USING (symbol, block)"""

SQL["job_nested_filter_selection"] = f"""WITH {FEATURES}, x AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER ({PART}) - 1 AS i, {Z20} AS signal, lead(close, 3) OVER ({PART}) - close AS mv FROM features), y AS (SELECT *, least(2, i * 3 // n)::INT AS fold FROM x),
z AS (SELECT *, min(i) OVER (PARTITION BY symbol, fold) AS a, max(i) OVER (PARTITION BY symbol, fold) AS b FROM y), t AS (SELECT fold, i - a >= (b - a + 1) * (1 - 0.4::DOUBLE) AS test, atr_ratio, signal * mv AS pnl FROM z WHERE signal <> 0 AND mv IS NOT NULL),
base AS (SELECT fold, {G} / nullif({L}, 0) AS bp, count(*) AS n FROM t WHERE NOT test GROUP BY 1), g(place, most) AS (VALUES (0, 1.5::DOUBLE), (1, 1.2::DOUBLE), (2, 1.0::DOUBLE)),
c AS (SELECT fold, place, most, {G} / nullif({L}, 0) AS pf, count(*) AS k FROM t CROSS JOIN g WHERE NOT test AND atr_ratio <= most GROUP BY 1, 2, 3), v AS (SELECT c.*, k / n AS retention, coalesce(k / n >= 0.6 AND pf > bp * (1 + 1e-9::DOUBLE), false) AS valid FROM c JOIN base USING (fold)),
r AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN valid THEN place END NULLS LAST, round(pf, 9) DESC NULLS LAST, place) = 1), te AS (SELECT fold, place, {G} / nullif({L}, 0) AS test_pf FROM t CROSS JOIN g WHERE test AND atr_ratio <= most GROUP BY 1, 2)
SELECT fold, place, most, {six('retention', 'pf', 'test_pf')}, valid FROM r LEFT JOIN te USING (fold, place)"""

_TRADED = SQL["pair_trades"].replace("round(pnl, 6) + 0.0::DOUBLE AS pnl", "pnl")
SQL["job_pairs_research"] = f"""WITH d1 AS (WITH {SPREADS[: SPREADS.rindex(', sp4 AS') if ', sp4 AS' in SPREADS else SPREADS.rindex(chr(10) + 'sp4 AS') - 1]} SELECT a, b, spread AS s, lag(spread) OVER ({PP}) AS x FROM sp3 WHERE spread IS NOT NULL),
d2 AS (SELECT a, b, count(*) AS n, regr_slope(s - x, x) AS slope, regr_sxx(s - x, x) AS sxx, regr_syy(s - x, x) AS syy, regr_sxy(s - x, x) AS sxy FROM d1 WHERE x IS NOT NULL GROUP BY 1, 2), d3 AS (SELECT *, slope / nullif(sqrt(greatest(syy - slope * sxy, 0) / nullif(n - 2, 0) / nullif(sxx, 0)), 0) AS t FROM d2),
tr AS ({_TRADED}), m AS (SELECT a, b, count(*) AS trades, 100.0 * avg((pnl > 0)::INT) AS win_rate, sum(pnl) AS total, {G} / nullif({L}, 0) AS profit_factor FROM tr GROUP BY 1, 2), cs AS ({SQL["corr_summary"]})
SELECT d3.a, d3.b, n, round(slope, 6) + 0.0::DOUBLE AS slope, round(CASE WHEN slope < 0 THEN -ln(2) / slope END, 6) AS half_life, round(t, 6) + 0.0::DOUBLE AS t, coalesce(t < -2.86, false) AS stationary, cs.mean AS mean_corr, cs.band AS corr_band, trades, {six('win_rate', 'total', 'profit_factor')}
FROM d3 LEFT JOIN cs ON cs.a = d3.a AND cs.b = d3.b LEFT JOIN m ON m.a = d3.a AND m.b = d3.b"""

_LAST = f"""WITH {BLOCKS}, lb AS (SELECT symbol, regime AS t, lag(regime) OVER (PARTITION BY symbol ORDER BY island) AS f, island FROM blocks), x AS (SELECT symbol, f, t FROM lb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY island DESC) = 1) SELECT * FROM x"""
SQL["job_behavioural_map"] = f"""WITH c AS ({SQL["cascade_summary"]}), z AS ({SQL["zone_verdict"]}), d AS ({SQL["edge_decay"]}), p AS (SELECT hypothesis, max(p) AS worst_loss_prob, sum(flagged::INT)::BIGINT AS flagged_runs FROM ({PLAIN["conditional_loss_prob"]}) GROUP BY 1),
o AS ({PLAIN["duration_pf_correlation"]}), h AS ({SQL["per_transition_pf"]}), l AS ({_LAST})
SELECT z.symbol, cascades, avg_depth, median_depth, p90_depth, max_depth, worst, avg_recovery, unrecovered_pct, n_zone, n_stable, pf_zone, pf_stable, verdict, d.type AS decay, baseline, final, worst_loss_prob, flagged_runs, o.corr AS duration_corr, l.f AS "from", l.t AS "to", h.delta AS last_change_delta
FROM c JOIN z ON c.hypothesis = z.symbol LEFT JOIN d ON d.hypothesis = z.symbol LEFT JOIN p ON p.hypothesis = z.symbol LEFT JOIN o ON o.symbol = z.symbol LEFT JOIN l ON l.symbol = z.symbol LEFT JOIN h ON h."from" = l.f AND h."to" = l.t"""

_SETS = ("regime", "regime, aligned", "bucket, regime", "bucket", "mr_setup", "")
SQL["job_barrier_separability"] = f"""WITH RECURSIVE {FEATURES}, {SLOPES},
ix AS MATERIALIZED (SELECT *, n - 1 AS idx, {REGIME3} AS regime, {Z20} AS signal, CASE WHEN slope_near > 0 AND slope_far > 0 THEN 1 WHEN slope_near < 0 AND slope_far < 0 THEN -1 ELSE 0 END AS bias,
  coalesce(CASE WHEN atr <> 0 THEN least(greatest((close - e50) / atr, -10), 10) END, 0) AS away FROM lab),
mt AS (SELECT g.*, b.idx AS met, b.close AS c, CASE WHEN CASE WHEN g.signal = 1 THEN b.high >= g.close + 2 * g.atr ELSE b.low <= g.close - 2 * g.atr END THEN 'TP' WHEN CASE WHEN g.signal = 1 THEN b.low <= g.close - 1.5 * g.atr ELSE b.high >= g.close + 1.5 * g.atr END THEN 'SL' END AS hit
  FROM ix g JOIN ix b ON b.symbol = g.symbol AND b.idx BETWEEN g.idx + 1 AND g.idx + 48 WHERE g.signal <> 0),
rs AS (SELECT symbol, idx, any_value(signal) AS signal, any_value(close) AS entry, any_value(atr) AS atr, any_value(regime) AS regime, any_value(bias) AS bias, any_value(away) AS away, arg_min(hit, CASE WHEN hit IS NOT NULL THEN met END) AS hit, arg_max(c, met) AS final FROM mt GROUP BY 1, 2),
tg AS MATERIALIZED (SELECT symbol, regime, bias <> 0 AND bias = signal AS aligned, CASE WHEN abs(away) < 0.5 THEN 'B1' WHEN abs(away) < 1 THEN 'B2' WHEN abs(away) < 1.5 THEN 'B3' WHEN abs(away) < 2 THEN 'B4' ELSE 'B5' END AS bucket,
  abs(away) >= 1 AND sign(away) = -signal AS mr_setup, CASE hit WHEN 'TP' THEN 2 * atr WHEN 'SL' THEN -1.5 * atr ELSE signal * (final - entry) END AS pnl FROM rs),
cuts AS (SELECT symbol, regime, aligned, bucket, mr_setup, grouping(symbol, regime, aligned, bucket, mr_setup)::BIGINT AS level, count(*) AS trades, {G} / nullif({L}, 0) AS pf, 100.0 * avg((pnl > 0)::INT) AS win_rate, sum(pnl) AS total
  FROM tg GROUP BY GROUPING SETS ({', '.join('(symbol' + (', ' + x if x else '') + ')' for x in _SETS)})),
rows AS (SELECT symbol, regime AS g, pnl AS v FROM tg), rg AS (WITH {_ks('rows', "VALUES ('STRESS', 'COMPRESSED'), ('STRESS', 'STRUCTURED'), ('COMPRESSED', 'STRUCTURED')")}, {_SEPARATED}),
sided AS (SELECT symbol, aligned::VARCHAR AS g, pnl AS v FROM tg WHERE regime = 'STRESS'), sk AS (WITH {_ks('sided', "VALUES ('true', 'false')")} SELECT * FROM ks)
SELECT cuts.symbol, regime, aligned, bucket, mr_setup, level, trades, {six('pf', 'win_rate', 'total')}, mean_ks, significant, spread, score, round(sk.ks, 6) AS stress_ks, round(sk.p, 6) AS stress_p FROM cuts LEFT JOIN rg ON rg.symbol = cuts.symbol LEFT JOIN sk ON sk.symbol = cuts.symbol"""

SQL["job_observer_cycle"] = f"""WITH {BLOCKS}, {DECAY}, {_status(_EARLY, 0.15)}, placed AS ({PLACED[PLACED.rindex('placed AS (') + 11 : -1]}), {TRANSITION_PF[len(PLACED) + 2 :]},
cs AS (SELECT hypothesis, avg((pf_30 > 1)::INT) AS consistency FROM dg1 GROUP BY 1),
st AS (SELECT hypothesis, (count(*) - coalesce(max(CASE WHEN pnl >= 0 THEN k END), 0))::BIGINT AS streak FROM (SELECT *, row_number() OVER ({RP}) AS k FROM trades) GROUP BY 1),
q AS (SELECT symbol, regime, quantile_cont(bars, 0.95) AS p95 FROM blocks GROUP BY 1, 2), lb AS (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY island) AS earlier FROM blocks),
nw AS (SELECT lb.symbol, lb.regime, bars <= 8 AS in_zone, CASE WHEN bars <= 8 THEN earlier END AS from_regime, CASE WHEN bars / p95 > 3 THEN 3 WHEN bars / p95 > 2 THEN 2 WHEN bars / p95 > 1.5 THEN 1 ELSE 0 END AS anomaly_level FROM lb JOIN q USING (symbol, regime) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY island DESC) = 1),
j AS (SELECT s.hypothesis AS symbol, nw.regime, nw.in_zone, nw.from_regime, anomaly_level, pf_30 AS pf, consistency, baseline_pf, pf_30 / nullif(baseline_pf, 0) AS pf_ratio, streak, evenness, degradation_status, decay.type AS decay, pf_after - pf_before AS expected_pf_delta
  FROM status s JOIN cs USING (hypothesis) JOIN st USING (hypothesis) LEFT JOIN nw ON nw.symbol = s.hypothesis LEFT JOIN decay ON decay.hypothesis = s.hypothesis LEFT JOIN tp ON tp.f = nw.from_regime AND tp.t = nw.regime),
k AS (SELECT *, CASE WHEN pf_ratio IS NULL THEN 'NO_DATA' WHEN pf_ratio >= 0.75 THEN 'HEALTHY' WHEN pf_ratio >= 0.5 THEN 'DEGRADED' ELSE 'BROKEN' END AS status, CASE WHEN NOT in_zone OR expected_pf_delta IS NULL THEN 0 WHEN expected_pf_delta < -0.5 THEN 3 WHEN expected_pf_delta < 0 THEN 2 ELSE 1 END AS transition_level,
  list_filter([CASE regime WHEN 'STRESS' THEN 'stress: moves are large and turn often' WHEN 'COMPRESSED' THEN 'compressed: moves are small' END, CASE WHEN expected_pf_delta < 0 THEN from_regime || ' to ' || regime END, CASE WHEN pf_ratio < 0.5 THEN 'profit factor below half of its baseline' WHEN pf_ratio < 0.75 THEN 'profit factor below three quarters of its baseline' END, CASE WHEN decay = 'DECAY' THEN 'the edge has decayed' END], lambda x: x IS NOT NULL) AS l,
  (regime = 'COMPRESSED')::INT AS info_notes, (regime = 'STRESS')::INT + coalesce(expected_pf_delta < 0 AND expected_pf_delta >= -0.5, false)::INT + coalesce(pf_ratio >= 0.5 AND pf_ratio < 0.75, false)::INT + coalesce(decay = 'DECAY', false)::INT AS warning_notes, coalesce(expected_pf_delta < -0.5, false)::INT + coalesce(pf_ratio < 0.5, false)::INT AS critical_notes FROM j),
h AS (SELECT *, greatest(0, least(100, 100 + greatest(-25, CASE anomaly_level WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN -5 ELSE -8 END + CASE transition_level WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN -6 ELSE -12 END)
  - CASE WHEN pf_ratio IS NULL THEN 8 WHEN pf_ratio >= 1 THEN 0 WHEN pf_ratio >= 0.9 THEN 4 WHEN pf_ratio >= 0.75 THEN 10 WHEN pf_ratio >= 0.5 THEN 18 ELSE 25 END - CASE WHEN consistency IS NULL THEN 5 WHEN consistency >= 0.75 THEN 0 WHEN consistency >= 0.55 THEN 4 WHEN consistency >= 0.35 THEN 10 WHEN consistency >= 0.2 THEN 15 ELSE 20 END
  - CASE WHEN streak <= 0 THEN 0 WHEN streak <= 2 THEN 3 WHEN streak <= 4 THEN 8 ELSE 15 END - CASE WHEN critical_notes > 0 THEN 15 WHEN warning_notes >= 2 THEN 10 WHEN warning_notes = 1 THEN 5 WHEN info_notes > 0 THEN 2 ELSE 0 END))::INT AS health FROM k)
SELECT symbol, regime, in_zone, from_regime, decay, anomaly_level, transition_level, {six('pf', 'consistency', 'baseline_pf', 'pf_ratio', 'evenness', 'expected_pf_delta')}, status, streak, degradation_status, array_to_string(l, ' | ') AS notes, info_notes, warning_notes, critical_notes,
CASE WHEN critical_notes > 0 THEN 'CRITICAL' WHEN warning_notes > 0 THEN 'WARNING' ELSE 'INFO' END AS severity, health, CASE WHEN health >= 90 THEN 'EXCELLENT' WHEN health >= 75 THEN 'GOOD' WHEN health >= 60 THEN 'WATCH' WHEN health >= 40 THEN 'WARNING' ELSE 'CRITICAL' END AS band, round(avg(health) OVER (), 6) AS mean_health FROM h"""

_LOGGED = {"5min": 300, "30min": 1800, "1h": 3600, "4h": 14400}
_PFS = lambda x: f"{G.replace('pnl', x)} / nullif({L.replace('pnl', x)}, 0)"
_HELD = ", ".join(f"avg((r{n} IS NOT NULL)::INT) AS filled_{h}, {_PFS(f'r{n}')} AS pf_{h}" for h, n in _LOGGED.items())
_CRITERIA = {"enough_trades": "trades >= 30", "pf_ok": "net_pf >= 1.3", "pf_without_best_ok": "pf_without_best >= 1.1", "drawdown_ok": "max_drawdown <= 500", "win_rate_ok": "win_rate >= 40"}
SQL["job_signal_review"] = f"""WITH s AS (SELECT event_id AS id, event_type AS symbol, ts, value AS price, strftime(ts, '%Y%m%d%H%M%S%f') AS moment FROM events),
{', '.join(f"o{n} AS (SELECT s.id, (p.value / nullif(s.price, 0) - 1) * 100 AS r{n} FROM (SELECT *, ts + INTERVAL {n} SECOND AS due FROM s) s ASOF JOIN events p ON s.symbol = p.event_type AND p.ts >= s.due WHERE s.due <= TIMESTAMP '2024-01-28 00:00:00')" for n in _LOGGED.values())},
lg AS MATERIALIZED (SELECT s.*, {', '.join(f'r{n}' for n in _LOGGED.values())} FROM s {' '.join(f'LEFT JOIN o{n} ON o{n}.id = s.id' for n in _LOGGED.values())}),
t AS MATERIALIZED (SELECT symbol, ts, moment, (id % 100) AS score, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * r3600 AS pnl FROM lg WHERE r3600 IS NOT NULL),
cu AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts, moment) AS cum FROM t), dd AS (SELECT symbol, max(top - cum) AS max_drawdown FROM (SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY ts, moment) AS top FROM cu) GROUP BY 1),
m AS (SELECT symbol, {G} / nullif({L}, 0) AS gross_pf, {_NET} AS net_pf, max(pnl) AS best, CASE WHEN {L} > 0 THEN ({G} - greatest(max(pnl), 0)) / {L} END AS pf_without_best, count(*) AS trades, 100.0 * avg((pnl > 0)::INT) AS win_rate, {_PFS('pnl').replace('pnl > 0', 'score >= 50 AND pnl > 0').replace('pnl < 0', 'score >= 50 AND pnl < 0')} AS pf_high_score FROM t GROUP BY 1),
ds AS ({_DAILY.replace(TRADES, 'trades AS (SELECT symbol AS hypothesis, ts, pnl FROM t)')}),
hd AS (SELECT symbol, {_HELD} FROM lg GROUP BY 1), hr AS (SELECT symbol, hour(ts) AS h, {G} / nullif({L}, 0) AS pf FROM t GROUP BY 1, 2), bh AS (SELECT symbol, h::INT AS best_hour, pf AS best_hour_pf FROM hr WHERE pf IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(pf, 9) DESC, h) = 1)
SELECT m.symbol, {six('gross_pf', 'net_pf', 'best', 'pf_without_best')}, trades, {six('win_rate', 'max_drawdown')}, days, sharpe, sortino, {six(*(f'{k}_{h}' for h in _LOGGED for k in ('filled', 'pf')))}, {six('pf_high_score')}, best_hour, {six('best_hour_pf')}, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in _CRITERIA.items())}, {_scenario('net_pf')} AS verdict
FROM m JOIN ds ON ds.hypothesis = m.symbol JOIN dd ON dd.symbol = m.symbol LEFT JOIN hd ON hd.symbol = m.symbol LEFT JOIN bh ON bh.symbol = m.symbol"""

_SEQ = PLAIN["sequential_trades"]
_EARLY_HIT = "CASE WHEN CASE WHEN direction = 1 THEN b.low <= ec - 1.5 * ea ELSE b.high >= ec + 1.5 * ea END THEN 'SL' WHEN CASE WHEN direction = 1 THEN b.high >= ec + 2 * ea ELSE b.low <= ec - 2 * ea END THEN 'TP' END"


def _figures(side: str, p: str) -> str:
    """``m_{side}``: figures of ``p`` of the rows ``two`` of each symbol."""
    return f"""c_{side} AS (SELECT symbol, entry_idx, {p} AS pnl, sum({p}) OVER (PARTITION BY symbol ORDER BY entry_idx) AS cum FROM two), d_{side} AS (SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY entry_idx) - cum AS dd FROM c_{side}),
m_{side} AS (SELECT symbol, count(*) AS {side}_trades, 100.0 * avg((pnl > 0)::INT) AS {side}_win_rate, {G} / greatest({L}, 1e-9) AS {side}_profit_factor, avg(pnl) AS {side}_expectancy, coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0) AS {side}_sharpe, max(dd) AS {side}_max_drawdown, sum(pnl) AS {side}_total FROM d_{side} GROUP BY 1)"""


_MORE = ("win_rate", "profit_factor", "expectancy", "sharpe", "max_drawdown", "total")
_LEADS = {"0-2h": (0, 2), "2-5h": (2, 5), "5-10h": (5, 10), ">10h": (10, 999)}
SQL["early_entry_deltas"] = f"""{_SEQ[: _SEQ.rindex('SELECT ps.symbol') - 1]}, tr AS (SELECT ps.symbol, ps.entry_idx, ps.pnl, sg.direction, ix.ts AS "at" FROM tk JOIN ps ON ps.symbol = tk.symbol AND ps.entry_idx = tk.e JOIN sg ON sg.symbol = ps.symbol AND sg.entry_idx = ps.entry_idx JOIN ix ON ix.symbol = ps.symbol AND ix.idx = ps.entry_idx),
lesser AS (SELECT symbol, ts, idx AS ei, close AS ec, CASE WHEN atr > 0 THEN atr ELSE 0.0001 END AS ea FROM ix WHERE abs(z20) >= 0.5 AND abs(z20) < 1),
fd AS (SELECT tr.*, ei, ec, ea, (epoch_us(tr."at") - epoch_us(l.ts)) / 3.6e9 AS hours FROM tr ASOF JOIN lesser l ON tr.symbol = l.symbol AND tr."at" > l.ts),
em AS (SELECT fd.*, b.idx AS met, b.close AS c, {_EARLY_HIT} AS hit FROM fd JOIN ix b ON b.symbol = fd.symbol AND b.idx BETWEEN ei + 1 AND ei + 48 WHERE hours <= 12),
er AS (SELECT symbol, entry_idx, any_value(pnl) AS pnl, any_value(hours) AS hours, any_value(direction) AS direction, any_value(ec) AS ec, any_value(ea) AS ea, arg_min(hit, CASE WHEN hit IS NOT NULL THEN met END) AS hit, arg_max(c, met) AS final FROM em GROUP BY 1, 2),
two AS MATERIALIZED (SELECT *, CASE hit WHEN 'SL' THEN -1.5 * ea WHEN 'TP' THEN 2 * ea ELSE direction * (final - ec) END AS early FROM er), {_figures('actual', 'pnl')}, {_figures('early', 'early')},
ld AS (SELECT symbol, avg(hours) AS avg_hours, {', '.join(f'sum((hours >= {a} AND hours < {z})::INT)::BIGINT AS "lead {k}"' for k, (a, z) in _LEADS.items())} FROM two GROUP BY 1)
SELECT symbol, {six('avg_hours')}, {', '.join(f'"lead {k}"' for k in _LEADS)}, actual_trades, early_trades, {six(*(f'{x}_{c}' for x in ('actual', 'early') for c in _MORE))}, {', '.join(f'round(early_{c} - actual_{c}, 6) + 0.0::DOUBLE AS delta_{c}' for c in ('expectancy', 'win_rate', 'profit_factor', 'max_drawdown'))} FROM ld JOIN m_actual USING (symbol) JOIN m_early USING (symbol)"""
