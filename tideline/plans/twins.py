"""SQL twins of queries whose SQL is long: recursions with gaps, the feature frame, trade simulation, studies."""

from __future__ import annotations

from itertools import product

from tideline.operators import events, indicators
from tideline.plans.catalog import _A14, _MOVES, _OBV, DAILY, HOURLY, RANKED, RETURNS, SQL, r6
from tideline.plans.inputs import rolling_sql, sql


def num(x: float) -> str:
    """A literal that is read as this double and not as a decimal."""
    return f"{float(x):.17e}"


def gapped_ewm(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """Exponential averages of values with gaps: out, its weight and how many values it has seen."""
    first = ", ".join(f"{x} AS {o}, 1e0 AS {o}_w, ({x} IS NOT NULL)::INT AS {o}_n" for o, (x, _) in columns.items())
    step = ", ".join(f"CASE WHEN s.{x} IS NULL THEN e.{o} WHEN e.{o}_n = 0 THEN s.{x} ELSE (e.{o}_w * {num(1 - a)} * e.{o} + {num(a)} * s.{x}) / (e.{o}_w * {num(1 - a)} + {num(a)}) END, CASE WHEN s.{x} IS NULL THEN e.{o}_w * {num(1 - a)} ELSE 1e0 END, e.{o}_n + (s.{x} IS NOT NULL)::INT" for o, (x, a) in columns.items())
    return f"{name} AS (SELECT symbol, pos, {first} FROM {source} WHERE pos = 0 UNION ALL SELECT s.symbol, s.pos, {step} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.pos = e.pos + 1)"


def span(n: float) -> float:
    return 2.0 / (n + 1.0)


# --- information bars, Supertrend of the second and third kind, Keltner positions ------------------

SQL["info_bars_dollar"] = SQL["info_bars_volume"].replace("volume AS acc", "close * volume AS acc").replace("THEN s.volume ELSE run.acc + s.volume END", "THEN s.close * s.volume ELSE run.acc + s.close * s.volume END").replace(">= 2000", ">= 200000").replace("round(sum(volume), 6) AS measure", "round(sum(close * volume), 6) AS measure")

_P = _MOVES + ", " + gapped_ewm("e", "src", {**{f"ema{s}": ("close", span(s)) for s in (9, 20, 21, 50)}, "w14": ("tr", 1 / 14), "w10": ("tr", 1 / 10)}) + """,
 b AS (SELECT s.symbol, s.pos, s.ts, s.close, s.close - s.m AS before, (s.high + s.low) / 2 + 3.0::DOUBLE * w10 AS up, (s.high + s.low) / 2 - 3.0::DOUBLE * w10 AS dn, e.* EXCLUDE (symbol, pos) FROM src s JOIN e USING (symbol, pos)),
 bb AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS prior FROM b),
 l2 AS (SELECT symbol, pos, dn AS line, 1 AS side FROM bb WHERE pos = 0
        UNION ALL SELECT symbol, pos, line, CASE WHEN above THEN CASE WHEN close > line THEN 1 ELSE -1 END ELSE CASE WHEN close < line THEN -1 ELSE 1 END END FROM
          (SELECT b.symbol, b.pos, b.close, b.prior > l.line AS above, CASE WHEN b.prior > l.line THEN CASE WHEN l.side = 1 THEN greatest(b.dn, l.line) ELSE b.dn END ELSE CASE WHEN l.side = -1 THEN least(b.up, l.line) ELSE b.up END END AS line FROM l2 l JOIN bb b ON b.symbol = l.symbol AND b.pos = l.pos + 1)),
 l3 AS (SELECT symbol, pos, dn AS line, true AS rising FROM bb WHERE pos = 0
        UNION ALL SELECT symbol, pos, CASE WHEN up_ THEN floor_ ELSE roof END, up_ FROM
          (SELECT *, CASE WHEN rising THEN close >= floor_ ELSE close > roof END AS up_ FROM
            (SELECT b.symbol, b.pos, b.close, l.rising, CASE WHEN b.up < l.line OR b.prior > l.line THEN b.up ELSE l.line END AS roof, CASE WHEN b.dn > l.line OR b.prior < l.line THEN b.dn ELSE l.line END AS floor_ FROM l3 l JOIN bb b ON b.symbol = l.symbol AND b.pos = l.pos + 1)))"""
_PRODUCTION = {"ema21_50_ratio": "(ema21 - ema50) / ema50", "ema9_21_ratio": "(ema9 - ema21) / ema21", "ema9_dist": "(close - ema9) / ema9", "keltner_pos_v2": "(close - ema20 + 2 * w14) / (4 * w14 + 1e-9)", "supertrend_dist_v2": "(close - l2.line) / nullif(w14, 0)", "supertrend_v3": "l3.line"}
SQL["supertrend_v2_production"] = sql(_P, "SELECT symbol, ts, round(close, 6) AS close, pos, " + ", ".join(f"round(CASE WHEN pos >= 60 THEN {x} END, 6) + 0.0 AS {n}" for n, x in _PRODUCTION.items()) + " FROM b JOIN l2 USING (symbol, pos) JOIN l3 USING (symbol, pos)", True)
SQL["keltner_v3"] = sql(_P, "SELECT symbol, pos, round((close - ema20 + 2 * w10) / nullif(4 * w10, 0), 6) + 0.0 AS keltner_pos_v3 FROM b", True)

# --- fractional differences ------------------------------------------------------------------------

_LOGS = HOURLY + ", x AS (SELECT symbol, list(ln(close) ORDER BY ts) AS xs FROM bars GROUP BY symbol)"


def ffd_sql(d: float, least: float) -> str:
    w = [float(v) for v in events.ffd_weights(d, least)]
    return f"CASE WHEN pos >= {len(w) - 1} THEN list_inner_product(xs[pos - {len(w) - 2}:pos + 1], [{', '.join(map(num, w))}]) END"


_DS = (0.1, 0.2, 0.3, 0.4, 0.5)
_NAMES = [f"ffd_{str(d).replace('.', '')}" for d in _DS]
SQL["ffd_features"] = sql(_LOGS + ", f AS (SELECT symbol, ts, close, pos, " + ", ".join(f"{ffd_sql(d, 1e-3)} AS {n}" for d, n in zip(_DS, _NAMES, strict=True)) + " FROM bars JOIN x USING (symbol)), z AS (SELECT *, " + ", ".join(f"{n} / nullif({rolling_sql('stddev_samp', n, 200, 50)}, 0) AS {n}_z" for n in _NAMES) + " FROM f)", f"SELECT symbol, ts, pos, {r6('close', *_NAMES, *[n + '_z' for n in _NAMES])} FROM z")
_LEAST = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
SQL["least_ffd"] = sql(_LOGS + ", f AS (" + " UNION ALL ".join(f"SELECT symbol, pos, {d!r}::DOUBLE AS d, ln(close) AS x, {ffd_sql(d, 1e-2)} AS y FROM bars JOIN x USING (symbol)" for d in _LEAST) + """),
 g AS (SELECT *, y - lag(y) OVER w AS step, lag(y) OVER w AS level FROM f WHERE y IS NOT NULL WINDOW w AS (PARTITION BY symbol, d ORDER BY pos)),
 h AS (SELECT *, lag(step) OVER (PARTITION BY symbol, d ORDER BY pos) AS before FROM g),
 s AS (SELECT symbol, d, count(*) AS n, regr_sxx(level, level) AS s11, regr_sxx(before, before) AS s22, regr_sxy(level, before) AS s12, regr_sxy(step, level) AS s1y, regr_sxy(step, before) AS s2y, regr_sxx(step, step) AS syy FROM h WHERE before IS NOT NULL GROUP BY ALL),
 b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
 t AS (SELECT symbol, d, b1 / sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / (s11 * s22 - s12 * s12)) AS statistic FROM b),
 c AS (SELECT symbol, d, count(*) AS n, corr(x, y) AS correlation FROM g GROUP BY ALL HAVING count(*) >= 100),
 j AS (SELECT *, -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n) AS critical FROM t JOIN c USING (symbol, d))""", "SELECT symbol, d, round(statistic, 3) + 0.0 AS statistic, round(critical, 3) AS critical, round(correlation, 3) + 0.0 AS correlation, coalesce(d = min(d) FILTER (statistic < critical) OVER (PARTITION BY symbol), false) AS chosen FROM j")

# --- coarser frames and the whole feature frame ----------------------------------------------------


def htf_ctes(tag: str, unit: str) -> str:
    """The last completed coarser bar's features by bin, on a grid without gaps; bars without trades have no prices."""
    return f"""
 c_{tag} AS (SELECT symbol, time_bucket(INTERVAL {unit}, ts) AS bin, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM hourly GROUP BY ALL),
 g_{tag} AS (SELECT symbol, unnest(generate_series(min(bin), max(bin), INTERVAL {unit})) AS bin FROM c_{tag} GROUP BY symbol),
 f_{tag} AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY bin) - 1)::BIGINT AS pos FROM g_{tag} LEFT JOIN c_{tag} USING (symbol, bin)),
 m_{tag} AS (SELECT *, close - lag(close) OVER w AS m, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM f_{tag} WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
 s_{tag} AS (SELECT *, CASE WHEN m IS NOT NULL THEN greatest(m, 0) END AS g, CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END AS l FROM m_{tag}),
 {gapped_ewm(f"e_{tag}", f"s_{tag}", {"e": ("close", span(20)), "a": ("tr", 1 / 14), "ag": ("g", 1 / 14), "al": ("l", 1 / 14)})},
 h_{tag} AS (SELECT f.symbol, f.bin, f.pos, (close - e) / close AS ed, CASE WHEN a_n >= 14 THEN a END / close AS ap, CASE WHEN ag_n < 14 OR al = 0 THEN 50.0::DOUBLE ELSE 100 - 100 / (1 + ag / al) END AS rs, CASE WHEN close > 0 AND lag(close, 5) OVER w > 0 THEN ln(close / lag(close, 5) OVER w) END AS lr FROM f_{tag} f JOIN e_{tag} USING (symbol, pos) WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
 htf_{tag} AS (SELECT symbol, bin, lag(ed) OVER w AS htf_{tag}_ema20_dist, lag(ap) OVER w AS htf_{tag}_atr_pct, lag(rs) OVER w AS htf_{tag}_rsi14, lag(lr) OVER w AS htf_{tag}_logret5 FROM h_{tag} WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""


def htf_names(tag: str) -> list[str]:
    return [f"htf_{tag}_{n}" for n in ("ema20_dist", "atr_pct", "rsi14", "logret5")]


SQL["htf_features"] = sql(HOURLY + "," + htf_ctes("4h", "4 HOUR"), f"SELECT symbol, bin, {r6(*htf_names('4h'))} FROM htf_4h", True)

_ROLL = rolling_sql
_FEATURES = {f"logret_{k}": f"CASE WHEN close > 0 AND lag(close, {k}) OVER w > 0 THEN ln(close / lag(close, {k}) OVER w) END" for k in indicators.RETURNS}
_FEATURES |= {f"vol_{k}": _ROLL("stddev_samp", "r", k) for k in indicators.VOLS}
_FEATURES |= {
    "skew_50": _ROLL("skewness", "r", 50), "kurt_50": _ROLL("kurtosis", "r", 50),
    "bb_pos": f"(close - ({_ROLL('avg', 'close', 20)})) / nullif(4 * ({_ROLL('stddev_samp', 'close', 20)}), 0)", "bb_width": f"4 * ({_ROLL('stddev_samp', 'close', 20)}) / ({_ROLL('avg', 'close', 20)})",
    "vol_z_50": f"(volume - ({_ROLL('avg', 'volume', 50)})) / nullif(({_ROLL('stddev_samp', 'volume', 50)}), 0)", "vol_change_5": f"volume / nullif(({_ROLL('avg', 'volume', 5)}), 0) - 1",
    "obv_slope_20": f"(obv - lag(obv, 20) OVER w) / nullif(({_ROLL('avg', 'volume', 50)}), 0)", "hl_range_pct": "(high - low) / close", "close_pos_in_range": "(close - low) / nullif(high - low, 0)",
}
for _k in (20, 50, 100):
    _FEATURES |= {f"dist_from_high_{_k}": f"(close - ({_ROLL('max', 'high', _k)})) / close", f"dist_from_low_{_k}": f"(close - ({_ROLL('min', 'low', _k)})) / close"}
_FEATURES |= {"autocorr_20": "CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) >= 20 THEN corr(r, r1) OVER (PARTITION BY symbol ORDER BY ts ROWS 18 PRECEDING) END"}
_MORE = {
    "rsi_14": "rsi_14", "adx_14": "CASE WHEN pos >= 13 THEN adx ELSE 0 END", "plus_di_14": "coalesce(pdi, 0)", "minus_di_14": "coalesce(ndi, 0)", "supertrend_trend": "t.side::DOUBLE", "stochrsi_k": "stochrsi_k", "stochrsi_d": "stochrsi_d",
    "stochrsi_k_minus_d": "stochrsi_k - stochrsi_d", "di_diff": "coalesce(pdi, 0) - coalesce(ndi, 0)", "atr_pct_14": "atr_14 / close", **{f"ema{s}_dist": f"(close - ema{s}) / close" for s in (9, 21, 50, 200)},
    **{f"ema{s}_slope_5": f"(ema{s} - lag(ema{s}, 5) OVER w) / lag(ema{s}, 5) OVER w" for s in (9, 21, 50)}, "keltner_pos": "(close - ema20) / nullif(4 * atr_14, 0)", "supertrend_dist": "(close - CASE WHEN t.side = 1 THEN t.bottom ELSE t.top END) / close",
}
FEATURE_NAMES = [*_FEATURES, "hour_of_day", "day_of_week", *_MORE, *htf_names("4h"), *htf_names("1d")]
_REC = _MOVES[len(HOURLY) :].lstrip(",\n ") + ", " + gapped_ewm("e", "src", {**{f"ema{s}": ("close", span(s)) for s in indicators.EMAS}, "ag": ("g", _A14), "al": ("l", _A14), "atr": ("tr", _A14), "p": ("pm", _A14), "n": ("nm", _A14)}) + """,
 rsi AS (SELECT symbol, pos, CASE WHEN pos < 14 OR al = 0 THEN 50.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM e),
 s1 AS (SELECT symbol, pos, coalesce(CASE WHEN count(*) OVER v >= 14 THEN 100 * (rsi_14 - min(rsi_14) OVER v) / nullif(max(rsi_14) OVER v - min(rsi_14) OVER v, 0) END, 0) AS raw FROM rsi WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING)),
 s2 AS (SELECT symbol, pos, CASE WHEN count(*) OVER v >= 3 THEN avg(raw) OVER v END AS stochrsi_k FROM s1 WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 2 PRECEDING)),
 s3 AS (SELECT symbol, pos, stochrsi_k, CASE WHEN count(stochrsi_k) OVER v >= 3 THEN avg(stochrsi_k) OVER v END AS stochrsi_d FROM s2 WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 2 PRECEDING)),
 di AS (SELECT symbol, pos, CASE WHEN pos >= 13 THEN atr END AS atr_14, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * p / atr END AS pdi, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * n / atr END AS ndi FROM e),
 dx AS (SELECT *, coalesce(100 * abs(pdi - ndi) / nullif(pdi + ndi, 0), 0) AS dx FROM di), """ + gapped_ewm("a", "dx", {"adx": ("dx", _A14)}) + """,
 bands AS (SELECT s.symbol, s.pos, s.close, s.close - s.m AS before, CASE WHEN s.pos >= 13 THEN (s.high + s.low) / 2 + 3 * e.atr END AS up, CASE WHEN s.pos >= 13 THEN (s.high + s.low) / 2 - 3 * e.atr END AS dn FROM src s JOIN e USING (symbol, pos)),
 t AS (SELECT symbol, pos, up AS top, dn AS bottom, 1 AS side FROM bands WHERE pos = 0
       UNION ALL SELECT symbol, pos, top, bottom, CASE WHEN side = 1 AND close < bottom THEN -1 WHEN side = -1 AND close > top THEN 1 ELSE side END FROM
         (SELECT b.symbol, b.pos, b.close, t.side, CASE WHEN t.top IS NULL OR b.up < t.top OR b.before > t.top THEN b.up ELSE t.top END AS top, CASE WHEN t.bottom IS NULL OR b.dn > t.bottom OR b.before < t.bottom THEN b.dn ELSE t.bottom END AS bottom FROM t JOIN bands b ON b.symbol = t.symbol AND b.pos = t.pos + 1))"""
_FRAME = _OBV + ", " + _REC + "," + htf_ctes("4h", "4 HOUR") + "," + htf_ctes("1d", "1 DAY") + ", oo AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS r1 FROM o), wf AS (SELECT symbol, pos, " + ", ".join(f"{x} AS {n}" for n, x in _FEATURES.items()) + " FROM oo WINDOW w AS (PARTITION BY symbol ORDER BY ts)), rf AS (SELECT o.symbol, o.pos, " + ", ".join(f"{x} AS {n}" for n, x in _MORE.items()) + " FROM bars o JOIN e USING (symbol, pos) JOIN rsi USING (symbol, pos) JOIN s3 USING (symbol, pos) JOIN dx USING (symbol, pos) JOIN a USING (symbol, pos) JOIN t USING (symbol, pos) WINDOW w AS (PARTITION BY o.symbol ORDER BY o.pos))"
_BASE = ("open", "high", "low", "close", "volume")
SQL["features_full"] = sql(_FRAME, "SELECT b.symbol, b.ts, b.trades, " + r6(*[f"b.{c}" for c in _BASE], *[f"wf.{n}" for n in _FEATURES], *[f"rf.{n}" for n in _MORE], *htf_names("4h"), *htf_names("1d"), digits=4) + ", hour(b.ts)::INT AS hour_of_day, (isodow(b.ts) - 1)::INT AS day_of_week FROM bars b JOIN wf USING (symbol, pos) JOIN rf USING (symbol, pos) LEFT JOIN htf_4h ON htf_4h.symbol = b.symbol AND htf_4h.bin = time_bucket(INTERVAL 4 HOUR, b.ts) LEFT JOIN htf_1d ON htf_1d.symbol = b.symbol AND htf_1d.bin = time_bucket(INTERVAL 1 DAY, b.ts)", True)
#: No feature may change where only the future does.
SQL["leakage_audit"] = "SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURE_NAMES) + "]) AS \"column\", 0e0 AS max_diff, 0::BIGINT AS null_mismatch"

_DAYS = DAILY + ", bars AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1)::BIGINT AS pos FROM daily)" + _MOVES[len(HOURLY) :]
SQL["regime_inputs"] = sql(_DAYS + ", " + gapped_ewm("e", "src", {"atr": ("tr", _A14), "p": ("pm", _A14), "n": ("nm", _A14)}) + """,
 di AS (SELECT symbol, pos, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * p / atr END AS pdi, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * n / atr END AS ndi FROM e),
 dx AS (SELECT *, coalesce(100 * abs(pdi - ndi) / nullif(pdi + ndi, 0), 0) AS dx FROM di), """ + gapped_ewm("a", "dx", {"adx": ("dx", _A14)}) + """,
 rr AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 r1 AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS rb FROM rr),
 z AS (SELECT symbol, pos, ts, """ + f"{_ROLL('avg', 'r', 3)} AS ret_3, {_ROLL('stddev_samp', 'r', 14)} AS vol_14, CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) >= 10 THEN corr(r, rb) OVER (PARTITION BY symbol ORDER BY ts ROWS 8 PRECEDING) END AS autocorr_10 FROM r1)", "SELECT z.symbol, z.ts, " + r6("ret_3", "vol_14", "autocorr_10", digits=5) + ", round(CASE WHEN pos >= 13 THEN adx ELSE 0 END, 5) AS adx FROM z JOIN a USING (symbol, pos)", True)

# --- rank correlations of features ----------------------------------------------------------------

_POLY = "(1 / (1 + 0.2316419 * t))"
_CDF = f"1 - exp(-t * t / 2) / sqrt(2 * pi()) * ({_POLY} * (0.319381530 + {_POLY} * (-0.356563782 + {_POLY} * (1.781477937 + {_POLY} * (-1.821255978 + {_POLY} * 1.330274429)))))"
_IC = ("logret_1", "vol_10", "vol_z_50", "bb_pos")
SQL["information_table"] = sql(_OBV + ", f AS (SELECT symbol, pos, " + ", ".join(f"{_FEATURES[n]} AS {n}" for n in _IC) + ", " + ", ".join(f"ln(lead(close, {h}) OVER w / close) AS f{h}" for h in (1, 4, 24)) + " FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts)), l AS (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS feature, {h}::INT AS horizon, {n} AS x, f{h} AS y FROM f" for n in _IC for h in (1, 4, 24)) + "), p AS (SELECT symbol, feature, horizon, " + RANKED.format(k="symbol, feature, horizon", x="x") + " AS rx, " + RANKED.format(k="symbol, feature, horizon", x="y") + " AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL), c AS (SELECT symbol, feature, horizon, count(*)::BIGINT AS n, corr(rx, ry) AS ic FROM p GROUP BY ALL HAVING count(*) >= 30), t AS (SELECT *, abs(ic) * sqrt((n - 2) / greatest(1 - ic * ic, 1e-300)) AS t FROM c)", f"SELECT symbol, feature, horizon, n, round(ic, 6) + 0.0 AS ic, round(2 * (1 - ({_CDF})), 6) + 0.0 AS p_value FROM t")

# --- backtest overfitting --------------------------------------------------------------------------

SQL["backtest_overfitting"] = sql(RETURNS + """,
 a AS (SELECT symbol, r AS ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM rets WHERE r IS NOT NULL),
 m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM a GROUP BY symbol)),
 k AS (SELECT symbol, ret, CASE WHEN i < (n % 8) * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE n % 8 + (i - (n % 8) * (n // 8 + 1)) // (n // 8) END AS chunk FROM a, m WHERE i < n),
 q AS (SELECT symbol, chunk, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM k GROUP BY ALL),
 h AS (SELECT x AS split FROM range(256) r(x) WHERE bit_count(x::INT) = 4),
 v AS (SELECT split, symbol, (split >> chunk) & 1 AS inside, sum(s) / sum(n) AS mean, sqrt(greatest(sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 0)) AS sd FROM q, h GROUP BY ALL),
 w AS (SELECT split, symbol, max(mean / sd) FILTER (inside = 1 AND sd > 1e-15) AS is_v, max(mean / sd) FILTER (inside = 0 AND sd > 1e-15) AS oos_v FROM v GROUP BY ALL),
 z AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY oos_v) AS rk, count(*) OVER (PARTITION BY split) AS total FROM w WHERE is_v IS NOT NULL AND oos_v IS NOT NULL),
 b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY split ORDER BY is_v DESC, symbol) = 1),
 l AS (SELECT ln((rk / (total + 1)) / (1 - rk / (total + 1))) AS logit FROM b)""", "SELECT round(avg((logit <= 0)::INT), 6) AS pbo, count(*)::BIGINT AS n_splits, round(avg(logit), 6) + 0.0 AS mean_logit FROM l")

# --- trade simulation bar by bar -------------------------------------------------------------------

_GRID = dict(rsi_len=[7, 14], stoch_len=[9, 14], adx_len=[14], adx_th=[5.0, 15.0], os_th=[40.0, 50.0], k_th=[70.0], d_th=[70.0], fixed_sl=[2.0, 1000.0], trail_sl=[0.0, 1.0], gain_th=[0.5], tp=[0.0, 3.0], max_bars=[0])
_VERTICAL = dict(rsi_len=[14], stoch_len=[14], adx_len=[14], adx_th=[5.0], os_th=[50.0], k_th=[70.0], d_th=[70.0], fixed_sl=[1000.0], trail_sl=[0.0], gain_th=[0.0], tp=[0.0], max_bars=[10])
_STOCH = _MOVES + ", " + gapped_ewm("e", "src", {"g7": ("g", 1 / 7), "l7": ("l", 1 / 7), "g14": ("g", 1 / 14), "l14": ("l", 1 / 14), "atr": ("tr", _A14), "p": ("pm", _A14), "n": ("nm", _A14)}) + """,
 di AS (SELECT symbol, pos, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * p / atr END AS pdi, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * n / atr END AS ndi FROM e),
 dx AS (SELECT *, coalesce(100 * abs(pdi - ndi) / nullif(pdi + ndi, 0), 0) AS dx FROM di), """ + gapped_ewm("a", "dx", {"adx": ("dx", _A14)}) + ", rs AS (" + " UNION ALL ".join(f"SELECT symbol, pos, {n} AS rsi_len, CASE WHEN pos < {n} OR l{n} = 0 THEN 50.0::DOUBLE ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi FROM e" for n in (7, 14)) + "), st AS (" + " UNION ALL ".join(f"SELECT symbol, pos, rsi_len, {n} AS stoch_len, CASE WHEN pos >= {n - 1} AND max(rsi) OVER v > min(rsi) OVER v THEN 100 * (rsi - min(rsi) OVER v) / (max(rsi) OVER v - min(rsi) OVER v) ELSE 0e0 END AS raw FROM rs WINDOW v AS (PARTITION BY symbol, rsi_len ORDER BY pos ROWS {n - 1} PRECEDING)" for n in (9, 14)) + """),
 k1 AS (SELECT *, (lag(raw, 2) OVER v + lag(raw) OVER v + raw) / 3 AS k FROM st WINDOW v AS (PARTITION BY symbol, rsi_len, stoch_len ORDER BY pos)),
 k2 AS (SELECT *, (lag(k, 2) OVER v + lag(k) OVER v + k) / 3 AS d FROM k1 WINDOW v AS (PARTITION BY symbol, rsi_len, stoch_len ORDER BY pos)),
 k3 AS (SELECT k2.*, lag(k) OVER v AS pk, lag(d) OVER v AS pd, CASE WHEN pos >= 13 THEN adx ELSE 0 END AS adx FROM k2 JOIN a USING (symbol, pos) WINDOW v AS (PARTITION BY symbol, rsi_len, stoch_len ORDER BY pos))"""


def trades_ctes(choices: dict, since: str | None = None, pine: bool = False, tag: str = "") -> str:
    """Trades of every symbol and configuration: a state machine that visits each bar."""
    rows = ", ".join("(" + ", ".join([str(i), *map(num, c)]) + ")" for i, c in enumerate(product(*choices.values())))
    up, down = ("pk <= pd AND k > d", "pk >= pd AND k < d") if pine else ("pk < pd AND k > d", "pk > pd AND k < d")
    cut = f"WHERE ts >= TIMESTAMP '{since}'" if since else ""
    return f"""cfg{tag}(config_id, {", ".join(choices)}) AS (VALUES {rows}),
 cut{tag} AS (SELECT symbol, min(pos) AS first, greatest(1, floor(epoch(max(ts) - min(ts)) / 86400))::DOUBLE AS n_days FROM bars {cut} GROUP BY symbol),
 sig{tag} AS MATERIALIZED (SELECT c.config_id, k3.symbol, k3.pos - first AS pos, coalesce({up} AND pk < os_th AND k < k_th AND d < d_th AND adx > adx_th, false) AS buy, coalesce({down} AND pk > 100 - os_th AND k > 100 - k_th AND d > 100 - d_th AND adx > adx_th, false) AS sell FROM cfg{tag} c JOIN k3 ON k3.rsi_len = c.rsi_len AND k3.stoch_len = c.stoch_len JOIN cut{tag} u ON u.symbol = k3.symbol AND k3.pos >= first),
 bar{tag} AS MATERIALIZED (SELECT s.*, b.close, b.high, b.low, fixed_sl / 100 AS fixed, trail_sl / 100 AS trail, gain_th / 100 AS gain, tp / 100 AS take, max_bars FROM sig{tag} s JOIN cut{tag} u USING (symbol) JOIN bars b ON b.symbol = s.symbol AND b.pos = s.pos + first JOIN cfg{tag} c USING (config_id)),
 run{tag} AS (SELECT config_id, symbol, pos, CASE WHEN buy THEN 1 WHEN sell THEN -1 ELSE 0 END AS side, close AS entry, pos AS eidx, CASE WHEN buy THEN high ELSE -low END AS best, false AS armed, NULL::DOUBLE AS pnl, NULL::BIGINT AS dir, NULL::BIGINT AS entry_idx FROM bar{tag} WHERE pos = 0
   UNION ALL SELECT config_id, symbol, pos, CASE WHEN free THEN CASE WHEN buy THEN 1 WHEN sell THEN -1 ELSE 0 END ELSE side END, CASE WHEN free THEN close ELSE entry END, CASE WHEN free THEN pos ELSE eidx END, CASE WHEN free THEN CASE WHEN buy THEN high ELSE -low END ELSE peak END, CASE WHEN free THEN false ELSE arm END, CASE WHEN gone THEN side * (close / entry - 1) - 2 * 0.0003e0 END, CASE WHEN gone THEN side END, CASE WHEN gone THEN eidx END FROM
     (SELECT *, side = 0 OR gone AS free FROM (SELECT *, side <> 0 AND (CASE WHEN side = 1 THEN sell ELSE buy END OR (fixed < 10 AND c <= side * entry * (1 - side * fixed)) OR (take > 0 AND c >= side * entry * (1 + side * take)) OR (trail > 0 AND arm AND c <= peak * (1 - side * trail)) OR (max_bars > 0 AND pos >= eidx + max_bars)) AS gone FROM
       (SELECT b.*, r.side, r.entry, r.eidx, greatest(r.best, CASE WHEN r.side = 1 THEN b.high ELSE -b.low END) AS peak, r.armed OR CASE WHEN r.side = 1 THEN b.high ELSE -b.low END >= r.side * r.entry * (1 + r.side * b.gain) AS arm, r.side * b.close AS c FROM run{tag} r JOIN bar{tag} b ON b.config_id = r.config_id AND b.symbol = r.symbol AND b.pos = r.pos + 1)))),
 trades{tag} AS (SELECT symbol, config_id::BIGINT AS config_id, n_days, pnl, dir, entry_idx, pos AS exit_idx FROM run{tag} JOIN cut{tag} USING (symbol) WHERE pnl IS NOT NULL),
 summary{tag} AS (SELECT symbol, config_id, count(*)::BIGINT AS n_trades, avg((pnl > 0)::INT) AS win_rate, count(*) / max(n_days) AS trades_per_day, avg(pnl) AS mean_pnl, sum(pnl) AS total_pnl, CASE WHEN coalesce(-sum(pnl) FILTER (pnl <= 0), 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl <= 0) ELSE 'inf'::DOUBLE END AS profit_factor, avg((pnl > 0)::INT) * coalesce(avg(pnl) FILTER (pnl > 0), 0) + (1 - avg((pnl > 0)::INT)) * coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS expectancy FROM trades{tag} GROUP BY ALL)"""


_SUMMARY = "symbol, config_id, n_trades, " + r6("win_rate", "trades_per_day", "mean_pnl", "total_pnl", "profit_factor", "expectancy")
_TRADES = _STOCH + ", " + trades_ctes(_GRID)
_TWICE = _TRADES + ", " + trades_ctes(_GRID, "2024-01-15", tag="_late") + """,
 pairs AS (SELECT a.symbol, a.config_id, a.win_rate AS found, b.win_rate AS held, (a.total_pnl > 0 AND b.total_pnl > 0)::INT AS good FROM summary a JOIN summary_late b USING (symbol, config_id)),
 best AS (SELECT *, row_number() OVER (ORDER BY found DESC, symbol, config_id) AS place FROM pairs),
 dec AS (SELECT top::INT AS top, avg(found) AS found, avg(held) AS held, avg(good) AS both_profitable FROM best JOIN (SELECT unnest([10, 25, 100]) AS top) ON place <= top GROUP BY top)"""
SQL["grid_trades"] = sql(_TRADES, f"SELECT symbol, config_id, {r6('n_days', 'pnl')}, dir, entry_idx, exit_idx FROM trades", True)
SQL["grid_summary"] = sql(_TRADES, f"SELECT {_SUMMARY} FROM summary", True)
SQL["vertical_barrier"] = sql(_STOCH + ", " + trades_ctes(_VERTICAL, pine=True), f"SELECT {_SUMMARY} FROM summary", True)
SQL["search_decay"] = sql(_TWICE, f"SELECT top, {r6('found', 'held', 'both_profitable')} FROM dec", True)
SQL["generalization"] = sql(_TWICE + ", base AS (SELECT avg(good) AS by_chance, least(greatest(avg(good), 1e-9), 1 - 1e-9) AS p FROM pairs)", f"SELECT top, {r6('found', 'held', 'both_profitable', 'by_chance')}, round(list_sum(list_transform(range(round(both_profitable * top)::BIGINT, top + 1), lambda k: exp(lgamma(top + 1) - lgamma(k + 1) - lgamma(top - k + 1) + k * ln(p) + (top - k) * ln(1 - p)))), 6) AS p_value FROM dec, base", True)
SQL["input_search"] = sql(_TRADES + """,
 pr AS (SELECT symbol, pos, 1 / (1 + exp(5 * ln(close / lag(close) OVER w))) AS pred, CASE WHEN lead(close) OVER w IS NOT NULL THEN CASE WHEN lead(close) OVER w > close THEN 1.0 ELSE 0.0 END END AS actual FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 fp AS (SELECT t.config_id, t.dir, pr.pred, pr.actual FROM trades t JOIN pr ON pr.symbol = t.symbol AND pr.pos = t.entry_idx),
 bs AS (SELECT config_id, count(*)::BIGINT AS n, avg(abs(pred - 0.5) * 2) AS mean_conviction, avg(((pred >= 0.5) = (dir > 0))::INT) AS agreement FROM fp GROUP BY config_id HAVING count(*) >= 30),
 rk AS (SELECT config_id, actual, """ + RANKED.format(k="config_id", x="pred") + """ AS rk FROM fp WHERE pred IS NOT NULL AND actual IS NOT NULL),
 au AS (SELECT config_id, (sum(rk) FILTER (actual > 0) - sum(actual) * (sum(actual) + 1) / 2) / (sum(actual) * (count(*) - sum(actual))) AS auc FROM rk GROUP BY config_id HAVING count(*) >= 30 AND sum(actual) > 0 AND sum(actual) < count(*))""", f"SELECT config_id, n, {r6('mean_conviction', 'agreement', 'auc')} FROM bs LEFT JOIN au USING (config_id)", True)

SQL["rank_ic"] = sql(RETURNS + ", f AS (SELECT symbol, r AS x, ln(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close) AS y FROM rets), p AS (SELECT symbol, " + RANKED.format(k="symbol", x="x") + " AS rx, " + RANKED.format(k="symbol", x="y") + " AS ry FROM f WHERE x IS NOT NULL AND y IS NOT NULL), c AS (SELECT symbol, count(*)::BIGINT AS n, corr(rx, ry) AS ic FROM p GROUP BY symbol), q AS (SELECT *, abs(ic) * sqrt((n - 2) / greatest(1 - ic * ic, 1e-300)) AS t FROM c)", f"SELECT symbol, n, round(ic, 6) + 0.0 AS ic, round(2 * (1 - ({_CDF})), 6) + 0.0 AS p_value FROM q")
SQL["search_correlation"] = sql(_TWICE + ", v AS (SELECT symbol, config_id, 'win_rate' AS measure, a.win_rate AS x, b.win_rate AS y FROM summary a JOIN summary_late b USING (symbol, config_id) UNION ALL SELECT symbol, config_id, 'n_trades', a.n_trades, b.n_trades FROM summary a JOIN summary_late b USING (symbol, config_id)), p AS (SELECT symbol, measure, " + RANKED.format(k="symbol, measure", x="x") + " AS rx, " + RANKED.format(k="symbol, measure", x="y") + " AS ry FROM v), c AS (SELECT symbol, measure, count(*)::BIGINT AS n, corr(rx, ry) AS ic FROM p GROUP BY symbol, measure HAVING count(*) >= 10), q AS (SELECT *, abs(ic) * sqrt((n - 2) / greatest(1 - ic * ic, 1e-300)) AS t FROM c)", f"SELECT symbol, measure, n, round(ic, 6) + 0.0 AS ic, round(2 * (1 - ({_CDF})), 6) + 0.0 AS p_value FROM q", True)
SQL["alert_rows"] = sql(RETURNS + ", p AS (SELECT symbol, ts, close, 1 / (1 + exp(-20 * r)) AS p FROM rets WHERE r IS NOT NULL)", "SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN p >= 0.7 THEN 'BUY' ELSE 'SELL' END AS action, round(p, 4) AS probability, round(close, 4) AS close_price, 1::BIGINT AS horizon_bars FROM p WHERE p >= 0.7 OR p <= 0.3")
