"""Registered queries of the engine and their SQL twins, by the inventory of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import numeric as N
from tideline.operators import align, bars, events, flow, indicators, labels, models, regime, research, sim, splits, stats
from tideline.plans.inputs import DAILY, HOURLY, TAPE, daily, ewm_sql, funding, hourly, positioned, rolling_sql, rounded, series, spans_to, sql, tape
from tideline.sources import readers
from tideline.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, twin: str | None = None, digits: int = 6):
    """Registers a query; its doubles are rounded, as are those of its twin."""

    def add(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if twin:
            SQL[name] = twin
        return f

    return add


def r6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)


#: Bars of a block in queries whose series are short, so that they have several.
FRAME_BLOCK = 500
#: The types of events, which stand for symbols.
SYMBOLS = ("click", "error", "purchase", "signup", "view")
ret = "CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END"
RETURNS = HOURLY + f", rets AS (SELECT *, {ret} AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
RANKED = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"


# --- the flagship, scans, bars -------------------------------------------------------------------


@query("min_slice_auc", sql(RETURNS + """,
 f AS (SELECT *, -r AS score, CASE WHEN lead(close) OVER w IS NOT NULL THEN CASE WHEN lead(close) OVER w > close THEN 1.0 ELSE 0.0 END END AS y FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 g AS (SELECT *, """ + RANKED.format(k="symbol", x="score") + """ AS rk FROM f WHERE score IS NOT NULL AND y IS NOT NULL)""", """
SELECT symbol, count(*)::BIGINT AS n, round((sum(rk) FILTER (y > 0) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 AS auc FROM g GROUP BY symbol"""))
def min_slice_auc(spark, d):
    r = N.Rolling()
    df = hourly(spark, d)
    df = labels.direction(df.withColumn("score", -r.log_return(F.col("close"), 1)), (1,))
    return stats.auc(df, "score", "label_dir_1", ["symbol"])


@query("scan_period", sql(TAPE, "SELECT symbol, trade_id, round(price, 6) + 0.0 AS price FROM tape WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND price > 110"))
def scan_period(spark, d):
    return tape(spark, d).where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-12' and price > 110").select("symbol", "trade_id", "price")


@query("time_bars_hour", sql(HOURLY, f"SELECT symbol, ts, trades, {r6('open', 'high', 'low', 'close', 'volume')} FROM hourly"))
def time_bars_hour(spark, d):
    return hourly(spark, d)


@query("time_bars_day", sql(DAILY, f"SELECT symbol, ts, trades, {r6('open', 'high', 'low', 'close', 'volume')} FROM daily"))
def time_bars_day(spark, d):
    return daily(spark, d)


COARSE = HOURLY + """,
 coarse AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS bin, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM hourly GROUP BY ALL),
 grid AS (SELECT symbol, unnest(generate_series(min(bin), max(bin), INTERVAL 4 HOUR)) AS bin FROM coarse GROUP BY symbol),
 full4 AS (SELECT g.symbol, g.bin AS ts, open, high, low, close, coalesce(volume, 0) AS volume FROM grid g LEFT JOIN coarse c USING (symbol, bin))"""


@query("resample_4h_grid", sql(COARSE, f"SELECT symbol, ts, {r6('open', 'high', 'low', 'close', 'volume')} FROM full4"))
def resample_4h_grid(spark, d):
    return bars.resample(hourly(spark, d), "4 hours")


@query("bar_gaps", sql(HOURLY, "SELECT symbol, b AS after_ts, ts, (epoch(ts - b) / 3600 - 1)::BIGINT AS missing FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM hourly) WHERE epoch(ts - b) > 3600"))
def bar_gaps(spark, d):
    return bars.gaps(hourly(spark, d))


@query("day_calendar_anti", "SELECT day::DATE AS day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY)) AS day) WHERE day NOT IN (SELECT date_trunc('day', ts) FROM events)")
def day_calendar_anti(spark, d):
    done = readers.table(spark, d, "events").select(F.to_date("ts").alias("day"))
    return readers.unprocessed(readers.days(spark, "2024-01-01", "2024-02-15"), done)


@query("info_bars_volume", sql(HOURLY + """,
 run AS (SELECT symbol, pos, volume AS acc, 0::BIGINT AS bar FROM bars WHERE pos = 0
         UNION ALL SELECT s.symbol, s.pos, CASE WHEN run.acc >= 2000 THEN s.volume ELSE run.acc + s.volume END, CASE WHEN run.acc >= 2000 THEN run.bar + 1 ELSE run.bar END FROM run JOIN bars s ON s.symbol = run.symbol AND s.pos = run.pos + 1),
 full_ AS (SELECT symbol, bar FROM run GROUP BY ALL HAVING max(acc) >= 2000)""", f"""
SELECT symbol, bar AS bar_id, max(ts) AS ts, count(*)::BIGINT AS n_source_bars, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, round(sum(volume), 6) AS volume, round(sum(volume), 6) AS measure
FROM bars JOIN run USING (symbol, pos) JOIN full_ USING (symbol, bar) GROUP BY symbol, bar""", True))
def info_bars_volume(spark, d):
    return bars.info_bars(positioned(spark, d), 2000.0, block=250)


@query("info_bars_dollar")
def info_bars_dollar(spark, d):
    return bars.info_bars(positioned(spark, d), 200_000.0, "dollar", 250)


# --- projections and predicates -----------------------------------------------------------------


@query("projections", sql(RETURNS, """
SELECT symbol, ts, round(greatest(r, 0), 6) + 0.0 AS up, sign(r)::DOUBLE AS side, round(sqrt(abs(r)), 6) + 0.0 AS root, round(1 / (1 + exp(-r * 10)), 6) AS p, round(abs(1 / (1 + exp(-r * 10)) - 0.5) * 2, 6) + 0.0 AS conviction,
 CASE WHEN 1 / (1 + exp(-r * 10)) >= 0.65 THEN 'A' WHEN 1 / (1 + exp(-r * 10)) <= 0.35 THEN 'E' ELSE 'S' END AS bucket,
 CASE WHEN 1 / (1 + exp(-r * 10)) >= 0.6 THEN 'BUY' WHEN 1 / (1 + exp(-r * 10)) <= 0.4 THEN 'SELL' ELSE 'SKIP' END AS action,
 hour(ts)::BIGINT AS hour, (isodow(ts) - 1)::BIGINT AS weekday, year(ts)::BIGINT AS year, strftime(ts, '%Y-%m') AS month, upper(trim(symbol)) AS name, CASE WHEN close >= open THEN 0 ELSE 1 END::BIGINT AS largest FROM rets WHERE r IS NOT NULL"""))
def projections(spark, d):
    r = F.col("r")
    df = hourly(spark, d).withColumn("r", N.Rolling().log_return(F.col("close"), 1)).where("r is not null").withColumn("p", N.sigmoid(r * 10))
    p = F.col("p")
    return df.select("symbol", "ts", N.clipped_below(r).alias("up"), F.signum(r).alias("side"), F.sqrt(F.abs(r)).alias("root"), "p", N.conviction(p).alias("conviction"), N.bucket(p).alias("bucket"), N.action(p, 0.6, 0.4).alias("action"), F.hour("ts").cast("long").alias("hour"), F.weekday("ts").cast("long").alias("weekday"), F.year("ts").cast("long").alias("year"), F.date_format("ts", "yyyy-MM").alias("month"), F.upper(F.trim("symbol")).alias("name"), N.argmax([F.col("close"), F.col("open")]).cast("long").alias("largest"))


@query("json_roundtrip", sql(HOURLY, "SELECT symbol, ts, round(close, 2) AS close_price FROM hourly WHERE trades >= 3"))
def json_roundtrip(spark, d):
    df = hourly(spark, d).where("trades >= 3").select("ts", F.to_json(F.struct("symbol", F.round("close", 2).alias("close_price"))).alias("body"))
    return df.select("ts", F.from_json("body", "symbol string, close_price double").alias("x")).select("x.symbol", "ts", "x.close_price")


@query("warmup_and_tail", sql(HOURLY + ", n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars)", "SELECT symbol, ts, pos FROM n WHERE pos >= 20 AND pos >= n - 300"))
def warmup_and_tail(spark, d):
    df = positioned(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    return df.where("pos >= 20 and pos >= n - 300").select("symbol", "ts", "pos")


# --- windows ------------------------------------------------------------------------------------

_W = {f"logret_{k}": f"CASE WHEN close > 0 AND lag(close, {k}) OVER w > 0 THEN ln(close / lag(close, {k}) OVER w) END" for k in (1, 5, 20, 100)}
_W |= {f"vol_{w}": rolling_sql("stddev_samp", "r", w) for w in (10, 50)}
_W |= {"bb_pos": f"(close - ({rolling_sql('avg', 'close', 20)})) / nullif(4 * ({rolling_sql('stddev_samp', 'close', 20)}), 0)", "bb_width": f"4 * ({rolling_sql('stddev_samp', 'close', 20)}) / ({rolling_sql('avg', 'close', 20)})", "vol_z_50": f"(volume - ({rolling_sql('avg', 'volume', 50)})) / nullif(({rolling_sql('stddev_samp', 'volume', 50)}), 0)", "vol_change_5": f"volume / ({rolling_sql('avg', 'volume', 5)}) - 1", "hl_range_pct": "(high - low) / close", "close_pos_in_range": "(close - low) / nullif(high - low, 0)", "dist_from_high_20": f"(close - ({rolling_sql('max', 'high', 20)})) / close", "dist_from_low_50": f"(close - ({rolling_sql('min', 'low', 50)})) / close", "obv_slope_20": f"(obv - lag(obv, 20) OVER w) / ({rolling_sql('avg', 'volume', 50)})"}
_OBV = RETURNS + ", o AS (SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT *, coalesce(sign(close - lag(close) OVER w), 0) * volume AS sv FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)))"


@query("window_features", sql(_OBV + ", f AS (SELECT symbol, ts, " + ", ".join(f"{e} AS {n}" for n, e in _W.items()) + " FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts))", f"SELECT symbol, ts, {r6(*_W)} FROM f"))
def window_features(spark, d):
    return indicators.window_features(hourly(spark, d), FRAME_BLOCK).select("symbol", "ts", *_W)


@query("moment_windows", sql(RETURNS + ", l AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS r1 FROM rets)", f"""
SELECT symbol, ts, round({rolling_sql('skewness', 'r', 50)}, 4) + 0.0 AS skew_50, round({rolling_sql('kurtosis', 'r', 50)}, 4) + 0.0 AS kurt_50,
 round(CASE WHEN count(r) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) >= 20 THEN corr(r, r1) OVER (PARTITION BY symbol ORDER BY ts ROWS 18 PRECEDING) END, 4) + 0.0 AS autocorr_20 FROM l"""), 4)
def moment_windows(spark, d):
    return indicators.window_features(hourly(spark, d)).select("symbol", "ts", "skew_50", "kurt_50", "autocorr_20")


@query("annual_vol_30", sql(DAILY + ", rets AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM daily)", f"SELECT symbol, ts, round(({rolling_sql('stddev_samp', 'r', 30)}) * sqrt(365) * 100, 4) + 0.0 AS annual_vol FROM rets"), 4)
def annual_vol_30(spark, d):
    return indicators.annual_vol(daily(spark, d)).select("symbol", "ts", "annual_vol")


# --- recursions ---------------------------------------------------------------------------------


@query("ema_spans", sql(HOURLY + ", " + ewm_sql("e", "bars", {f"ema{s}": ("close", 2 / (s + 1)) for s in (9, 21, 50)}), f"SELECT symbol, pos, {r6('ema9', 'ema21', 'ema50')} FROM e", True))
def ema_spans(spark, d):
    spans = (9, 21, 50)
    return indicators.exponential(positioned(spark, d), indicators.averages(spans)).select("symbol", "pos", *[f"ema{s}" for s in spans])


@query("ema_blocked", sql(HOURLY + ", " + ewm_sql("e", "bars", {"ema9": ("close", 0.2)}), f"SELECT symbol, pos, {r6('ema9')} FROM e", True))
def ema_blocked(spark, d):
    """The affine scan over blocks: for one series of any length."""
    return indicators.exponential(positioned(spark, d), {"ema9": ("close", 0.2, 1)}, 64).select("symbol", "pos", "ema9")


_MOVES = HOURLY + """,
 moves AS (SELECT symbol, pos, ts, open, high, low, close, close - lag(close) OVER w AS m, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 src AS (SELECT *, CASE WHEN m IS NOT NULL THEN greatest(m, 0) END AS g, CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END AS l, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS nm FROM moves)"""
_A14 = 1 / 14
_RSI = _MOVES + ", " + ewm_sql("e", "src", {"ag": ("g", _A14), "al": ("l", _A14)}) + ", rsi AS (SELECT symbol, pos, CASE WHEN pos < 14 OR al = 0 THEN 50.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi_14 FROM e)"


@query("rsi_14", sql(_RSI, f"SELECT symbol, pos, {r6('rsi_14')} FROM rsi", True))
def rsi_14(spark, d):
    return indicators.strength(positioned(spark, d), 250).select("symbol", "pos", "rsi_14")


@query("stoch_rsi", sql(_RSI + """,
 s AS (SELECT symbol, pos, coalesce(CASE WHEN count(*) OVER v >= 14 THEN 100 * (rsi_14 - min(rsi_14) OVER v) / nullif(max(rsi_14) OVER v - min(rsi_14) OVER v, 0) END, 0) AS raw FROM rsi WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING)),
 k AS (SELECT symbol, pos, CASE WHEN count(*) OVER v >= 3 THEN avg(raw) OVER v END AS stochrsi_k FROM s WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 2 PRECEDING)),
 d AS (SELECT symbol, pos, stochrsi_k, CASE WHEN count(stochrsi_k) OVER v >= 3 THEN avg(stochrsi_k) OVER v END AS stochrsi_d FROM k WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 2 PRECEDING))""", f"SELECT symbol, pos, {r6('stochrsi_k', 'stochrsi_d', digits=4)} FROM d", True), 4)
def stoch_rsi(spark, d):
    return indicators.in_blocks(indicators.strength(positioned(spark, d), 250), 20, lambda df, r: indicators.stochastic(df, "rsi_14", r=r), 64).select("symbol", "pos", "stochrsi_k", "stochrsi_d")


@query("atr_adx", sql(_MOVES + ", " + ewm_sql("e", "src", {"atr": ("tr", _A14), "p": ("pm", _A14), "n": ("nm", _A14)}) + """,
 di AS (SELECT symbol, pos, CASE WHEN pos >= 13 THEN atr END AS atr_14, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * p / atr END AS pdi, CASE WHEN pos >= 13 AND atr <> 0 THEN 100 * n / atr END AS ndi FROM e),
 dx AS (SELECT *, coalesce(100 * abs(pdi - ndi) / nullif(pdi + ndi, 0), 0) AS dx FROM di), """ + ewm_sql("a", "dx", {"adx": ("dx", _A14)}), f"""
SELECT dx.symbol, dx.pos, round(atr_14, 6) AS atr_14, round(CASE WHEN pos >= 13 THEN adx ELSE 0 END, 6) AS adx_14, round(coalesce(pdi, 0), 6) AS plus_di_14, round(coalesce(ndi, 0), 6) AS minus_di_14 FROM dx JOIN a USING (symbol, pos)""", True))
def atr_adx(spark, d):
    return indicators.strength(positioned(spark, d), 250).select("symbol", "pos", "atr_14", "adx_14", "plus_di_14", "minus_di_14")


@query("supertrend_v1", sql(_MOVES + ", " + ewm_sql("e", "src", {"atr": ("tr", _A14)}) + """,
 bands AS (SELECT s.symbol, s.pos, s.close, s.close - s.m AS before, CASE WHEN s.pos >= 13 THEN (s.high + s.low) / 2 + 3 * e.atr END AS up, CASE WHEN s.pos >= 13 THEN (s.high + s.low) / 2 - 3 * e.atr END AS dn FROM src s JOIN e USING (symbol, pos)),
 t AS (SELECT symbol, pos, up AS top, dn AS bottom, 1 AS side FROM bands WHERE pos = 0
       UNION ALL SELECT symbol, pos, top, bottom, CASE WHEN side = 1 AND close < bottom THEN -1 WHEN side = -1 AND close > top THEN 1 ELSE side END FROM
         (SELECT b.symbol, b.pos, b.close, t.side, CASE WHEN t.top IS NULL OR b.up < t.top OR b.before > t.top THEN b.up ELSE t.top END AS top, CASE WHEN t.bottom IS NULL OR b.dn > t.bottom OR b.before < t.bottom THEN b.dn ELSE t.bottom END AS bottom FROM t JOIN bands b ON b.symbol = t.symbol AND b.pos = t.pos + 1))""", """
SELECT symbol, pos, side::DOUBLE AS supertrend_trend, round(CASE WHEN side = 1 THEN bottom ELSE top END, 4) + 0.0 AS supertrend_line FROM t""", True), 4)
def supertrend_v1(spark, d):
    return indicators.recursive(positioned(spark, d), FRAME_BLOCK).select("symbol", "pos", "supertrend_trend", "supertrend_line")


@query("supertrend_v2_production")
def supertrend_v2(spark, d):
    df = indicators.production_ratios(positioned(spark, d), FRAME_BLOCK)
    return df.drop("open", "high", "low", "volume", "trades")


@query("keltner_v3")
def keltner_v3(spark, d):
    return indicators.keltner_v3(positioned(spark, d), FRAME_BLOCK).select("symbol", "pos", "keltner_pos_v3")


_CUSUM_SRC = RETURNS + f""",
 dev AS (SELECT symbol, pos, ts, close, {rolling_sql('stddev_samp', 'r', 100, 50)} AS s, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM rets),
 src AS (SELECT symbol, pos, d, 2.0 * lag(s) OVER (PARTITION BY symbol ORDER BY ts) AS h FROM dev),
 c AS (SELECT symbol, pos, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS ev FROM src WHERE pos = 0
       UNION ALL SELECT symbol, pos, CASE WHEN ev = 1 AND NOT fell THEN 0.0 ELSE u END, CASE WHEN ev = 1 AND fell THEN 0.0 ELSE v END, ev FROM
         (SELECT symbol, pos, u, v, coalesce(h > 0 AND v < -h, false) AS fell, CASE WHEN h > 0 AND (v < -h OR u > h) THEN 1 ELSE 0 END AS ev FROM
           (SELECT s.symbol, s.pos, s.h, greatest(0.0, c.up + s.d) AS u, least(0.0, c.dn + s.d) AS v FROM c JOIN src s ON s.symbol = c.symbol AND s.pos = c.pos + 1)))"""


@query("cusum_events", sql(_CUSUM_SRC, """
SELECT symbol, pos, ev::BIGINT AS cusum_event, pos - max(CASE WHEN ev = 1 THEN pos END) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bars_since_event,
 CASE WHEN count(*) OVER v >= 20 THEN sum(ev) OVER v END::BIGINT AS event_intensity_100 FROM c WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS 99 PRECEDING)""", True))
def cusum_events(spark, d):
    return events.cusum_features(positioned(spark, d), block=250).select("symbol", "pos", F.col("cusum_event").cast("long"), "bars_since_event", "event_intensity_100") 


_FFD = list(events.ffd_weights(0.4, 1e-2))


@query("frac_diff", sql(HOURLY + f", w AS (SELECT unnest(range({len(_FFD)}))::BIGINT AS k, unnest({[float(v) for v in _FFD]!r}) AS w)", f"""
SELECT b.symbol, b.pos, round(sum(w.w * ln(x.close)), 6) + 0.0 AS ffd_04 FROM bars b JOIN w ON b.pos >= {len(_FFD) - 1} JOIN bars x ON x.symbol = b.symbol AND x.pos = b.pos - {len(_FFD) - 1} + w.k GROUP BY b.symbol, b.pos"""))
def frac_diff(spark, d):
    return events.ffd_features(positioned(spark, d), (0.4,), 1e-2, 250).where("ffd_04 is not null").select("symbol", "pos", "ffd_04")


@query("ffd_features")
def ffd_features(spark, d):
    return events.ffd_features(positioned(spark, d), least=1e-3, block=250).drop("open", "high", "low", "volume", "trades")


@query("least_ffd", digits=3)
def least_ffd(spark, d):
    return events.least_ffd(hourly(spark, d), (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), 1e-2)


@query("features_full", digits=4)
def features_full(spark, d):
    return indicators.features(positioned(spark, d), block=FRAME_BLOCK).drop("pos")


@query("htf_features")
def htf_features(spark, d):
    return indicators.higher_frame(hourly(spark, d), "4 hours", "4h", 50)


# --- joins --------------------------------------------------------------------------------------

_FUND = HOURLY + ", fund AS (SELECT symbol, time_bucket(INTERVAL 8 HOUR, ts) AS t, avg(price) / 1e6 AS fundingRate FROM tape GROUP BY ALL)"


@query("asof_funding", sql(_FUND, "SELECT h.symbol, h.ts, round(f.fundingRate * 1e6, 9) AS rate FROM hourly h ASOF LEFT JOIN fund f ON h.symbol = f.symbol AND h.ts >= f.t"), 9)
def asof_funding(spark, d):
    return align.asof(hourly(spark, d).select("symbol", "ts"), funding(spark, d), ["fundingRate"], right_ts="fundingTime").select("symbol", "ts", (F.col("fundingRate") * 1e6).alias("rate"))


@query("asof_trades", sql(HOURLY, "SELECT t.symbol, t.trade_id, t.ts, round(h.close, 6) AS close FROM tape t ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 1 HOUR AS known, close FROM hourly) h ON t.symbol = h.symbol AND t.ts >= h.known"))
def asof_trades(spark, d):
    known = hourly(spark, d).select("symbol", (F.col("ts") + F.expr("interval 1 hour")).alias("known"), "close")
    return align.asof(tape(spark, d).select("symbol", "trade_id", "ts"), known, ["close"], right_ts="known")


@query("asof_next_day", sql(HOURLY + ", dly AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS known, last(close ORDER BY ts) AS day_close FROM hourly GROUP BY symbol, date_trunc('day', ts))", "SELECT h.symbol, h.ts, round(x.day_close, 6) AS day_close FROM hourly h ASOF LEFT JOIN dly x ON h.symbol = x.symbol AND h.ts >= x.known"))
def asof_next_day(spark, d):
    h = hourly(spark, d)
    days = h.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("day_close"))
    return align.asof_next_day(h.select("symbol", "ts"), days, ["day_close"])


_TWO = DAILY + ", perp AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, avg(l_extendedprice) AS close FROM lineitem GROUP BY ALL), spot AS (SELECT ts, avg(close) AS close FROM daily GROUP BY ts)"


def _two(spark, d):
    perp = readers.table(spark, d, "lineitem").groupBy(bars.floor_to("l_shipdate", "day").alias("ts")).agg(F.avg("l_extendedprice").alias("close"))
    spot = daily(spark, d).groupBy("ts").agg(F.avg("close").alias("close"))
    return spot, perp


@query("spot_perp_basis", sql(_TWO, "SELECT ts, round(s.close, 7) AS close_spot, round(p.close, 7) AS close_perp, round(p.close / s.close - 1, 7) + 0.0 AS basis, round(abs(p.close / s.close - 1) * 100, 7) AS abs_pct FROM spot s JOIN perp p USING (ts)"), 7)
def spot_perp_basis(spark, d):
    df = align.side_by_side(*_two(spark, d), ["ts"], ("_spot", "_perp"))
    return df.withColumn("basis", F.col("close_perp") / F.col("close_spot") - 1).withColumn("abs_pct", F.abs("basis") * 100)


@query("basis_zscore", sql(_TWO + ", b AS (SELECT 'x' AS symbol, ts, p.close / s.close - 1 AS basis FROM spot s JOIN perp p USING (ts))", f"SELECT ts, round((basis - ({rolling_sql('avg', 'basis', 168)})) / nullif(({rolling_sql('stddev_samp', 'basis', 168)}), 0), 4) + 0.0 AS basis_z FROM b"), 4)
def basis_zscore(spark, d):
    spot, perp = _two(spark, d)
    df = align.side_by_side(spot, perp, ["ts"], ("_spot", "_perp")).select(F.lit("x").alias("symbol"), "ts", (F.col("close_perp") / F.col("close_spot") - 1).alias("basis"))
    return flow.basis_zscore(df).select("ts", "basis_z")


@query("joined_inputs", sql(_FUND + """,
 fl AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(quantity) FILTER (NOT is_buyer_maker) AS b, sum(quantity) FILTER (is_buyer_maker) AS s FROM tape GROUP BY ALL)""", """
SELECT h.symbol, h.ts, round(h.close, 9) AS close, round(coalesce(b, 0) - coalesce(s, 0), 6) + 0.0 AS net_taker_flow, round(f.fundingRate * 1e6, 9) AS rate FROM hourly h LEFT JOIN fl ON fl.symbol = h.symbol AND fl.ts = h.ts ASOF LEFT JOIN fund f ON h.symbol = f.symbol AND h.ts >= f.t"""), 9)
def joined_inputs(spark, d):
    fl = flow.hourly_flow(tape(spark, d)).select("symbol", "ts", "net_taker_flow")
    df = flow.joined(hourly(spark, d).select("symbol", "ts", "close"), None, funding(spark, d), None, fl)
    return df.select("symbol", "ts", "close", "net_taker_flow", (F.col("fundingRate") * 1e6).alias("rate"))


# --- flow and statistics ------------------------------------------------------------------------


@query("hourly_flow", sql(TAPE, """
SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::BIGINT AS trade_count, count(*) FILTER (NOT is_buyer_maker)::BIGINT AS buy_trade_count, round(coalesce(sum(quantity) FILTER (NOT is_buyer_maker), 0), 4) AS taker_buy_vol,
 round(coalesce(sum(quantity * price) FILTER (is_buyer_maker), 0), 4) AS taker_sell_notional, round(sum(price * quantity) / sum(quantity), 11) AS vwap, round(last(price ORDER BY ts, trade_id), 11) AS price_close,
 round((coalesce(sum(quantity) FILTER (NOT is_buyer_maker), 0) - coalesce(sum(quantity) FILTER (is_buyer_maker), 0)) / sum(quantity), 11) + 0.0 AS ofi, round((2 * count(*) FILTER (NOT is_buyer_maker) - count(*)) / count(*)::DOUBLE, 11) + 0.0 AS trade_count_imbalance FROM tape GROUP BY ALL"""), 11)
def hourly_flow(spark, d):
    return flow.hourly_flow(tape(spark, d)).select("symbol", "ts", "trade_count", "buy_trade_count", F.round("taker_buy_vol", 4).alias("taker_buy_vol"), F.round("taker_sell_notional", 4).alias("taker_sell_notional"), "vwap", "price_close", "ofi", "trade_count_imbalance")


@query("hourly_interest", sql(TAPE + ", m AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS t, sum(quantity) AS oi, avg(price) AS ratio FROM tape GROUP BY ALL)", "SELECT date_trunc('hour', t)::TIMESTAMP AS ts, round(last(oi ORDER BY t), 9) AS oi, round(avg(ratio), 9) AS ratio FROM m GROUP BY date_trunc('hour', t)"), 9)
def hourly_interest(spark, d):
    five = F.expr("date_trunc('hour', ts) + make_interval(0, 0, 0, 0, 0, cast(floor(minute(ts) / 5) * 5 as int))").cast("timestamp_ntz")
    m = tape(spark, d).groupBy(five.alias("create_time")).agg(F.sum("quantity").alias("oi"), F.avg("price").alias("ratio"))
    return flow.hourly_interest(m, ["oi"], ["ratio"])


@query("describe_series", sql(RETURNS + ", z AS (SELECT *, epoch(ts - min(ts) OVER (PARTITION BY symbol)) / 86400 AS day FROM rets)", """
SELECT symbol, count(r)::BIGINT AS n, round(avg(r), 4) + 0.0 AS mean, round(stddev_samp(r), 4) AS std, round(skewness(r), 4) + 0.0 AS skew, round(kurtosis(r), 4) + 0.0 AS kurt, round(min(r), 4) AS least, round(max(r), 4) AS most, round(median(r), 4) + 0.0 AS median, round(stddev_samp(volume) / avg(volume), 4) AS volume_cv, round(regr_slope(volume, day), 4) + 0.0 AS volume_slope, min(ts) AS first_ts, max(ts) AS last_ts FROM z GROUP BY symbol"""), 4)
def describe_series(spark, d):
    return stats.describe(hourly(spark, d))


@query("yearly_breakdown", sql(DAILY + ", r AS (SELECT symbol, year(ts)::BIGINT AS year, ln(close / lag(close) OVER (PARTITION BY symbol, year(ts) ORDER BY ts)) AS r FROM daily)", "SELECT symbol, year, count(*)::BIGINT AS n, round(avg(r), 4) + 0.0 AS mean, round(stddev_samp(r), 4) AS std, round(sum(r), 4) + 0.0 AS total FROM r GROUP BY symbol, year HAVING count(*) >= 30"), 4)
def yearly_breakdown(spark, d):
    return stats.yearly(daily(spark, d)).withColumn("year", F.col("year").cast("long"))


@query("autocorrelations", sql(RETURNS + ", x AS (SELECT *, " + ", ".join(f"lag(r, {i}) OVER w AS r{i}" for i in range(1, 11)) + " FROM rets WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)), c AS (SELECT symbol, count(*)::BIGINT AS n, " + ", ".join(f"corr(r, r{i}) AS c{i}, corr(abs(r), abs(r{i})) AS a{i}" for i in range(1, 11)) + " FROM x GROUP BY symbol)", "SELECT symbol, n, " + ", ".join(f"round(c{i}, 4) + 0.0 AS acf_r_{i}, round(a{i}, 4) + 0.0 AS acf_abs_{i}" for i in (1, 2, 10)) + ", round(n * (n + 2) * (" + " + ".join(f"c{i} * c{i} / (n - {i})" for i in range(1, 11)) + "), 4) AS ljung_box FROM c"), 4)
def autocorrelations(spark, d):
    df = hourly(spark, d).withColumn("r", N.Rolling().log_return(F.col("close"), 1))
    return stats.autocorrelations(df, "r").select("symbol", "n", *[f"acf_{k}_{i}" for i in (1, 2, 10) for k in ("r", "abs")], "ljung_box")


@query("rank_ic", sql(RETURNS + ", f AS (SELECT symbol, r AS x, ln(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close) AS y FROM rets), p AS (SELECT symbol, " + RANKED.format(k="symbol", x="x") + " AS rx, " + RANKED.format(k="symbol", x="y") + " AS ry FROM f WHERE x IS NOT NULL AND y IS NOT NULL)", "SELECT symbol, count(*)::BIGINT AS n, round(corr(rx, ry), 6) + 0.0 AS ic FROM p GROUP BY symbol"))
def rank_ic(spark, d):
    r = N.Rolling()
    df = hourly(spark, d).withColumn("x", r.log_return(F.col("close"), 1)).withColumn("y", F.log(r.lead(F.col("close"), 1) / F.col("close")))
    return stats.spearman(df, "x", "y", ["symbol"])


@query("information_table")
def information_table(spark, d):
    df = indicators.window_features(hourly(spark, d))
    return stats.information_table(df, ["logret_1", "vol_10", "vol_z_50", "bb_pos"], (1, 4, 24), 30)


@query("monthly_auc", sql(RETURNS + ", f AS (SELECT strftime(ts, '%Y-%m') AS month, -r AS s, CASE WHEN lead(close) OVER w > close THEN 1.0 WHEN lead(close) OVER w IS NOT NULL THEN 0.0 END AS y FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g AS (SELECT month, y, " + RANKED.format(k="month", x="s") + " AS rk FROM f WHERE s IS NOT NULL AND y IS NOT NULL)", "SELECT month, count(*)::BIGINT AS n, round((sum(rk) FILTER (y > 0) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM g GROUP BY month HAVING count(*) >= 30 AND sum(y) > 0 AND sum(y) < count(*)"))
def monthly_auc(spark, d):
    df = labels.direction(hourly(spark, d), (1,)).withColumn("s", -N.Rolling().log_return(F.col("close"), 1)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return stats.auc(df, "s", "label_dir_1", ["month"], 30)


@query("contingency", sql(HOURLY + ", x AS (SELECT symbol, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS side FROM hourly), o AS (SELECT symbol, side, count(*)::DOUBLE AS o FROM x GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY symbol) AS a, sum(o) OVER (PARTITION BY side) AS b, sum(o) OVER () AS t FROM o), c AS (SELECT sum(o * o / (a * b / t)) - max(t) AS chi2, max(t) AS t FROM m)", "SELECT round(chi2, 6) AS chi2, round(sqrt(chi2 / t), 6) AS cramers_v FROM c"))
def contingency(spark, d):
    df = hourly(spark, d).withColumn("side", F.when(F.col("close") >= F.col("open"), "up").otherwise("down"))
    return stats.contingency(df, "symbol", "side")


@query("quartile_buckets", sql(RETURNS + ", e AS (SELECT quantile_cont(r, [0.25, 0.5, 0.75]) AS q FROM rets WHERE pos < 400)", "SELECT symbol, pos, CASE WHEN r IS NOT NULL THEN (r >= q[1])::INT + (r >= q[2])::INT + (r >= q[3])::INT END::BIGINT AS quarter FROM rets, e"))
def quartile_buckets(spark, d):
    df = positioned(spark, d).withColumn("r", N.Rolling().log_return(F.col("close"), 1))
    return models.quartiles(df, "r", F.col("pos") < 400).select("symbol", "pos", F.col("r_quarter").cast("long").alias("quarter"))


@query("top_and_pivot", sql(HOURLY, "SELECT hour(ts)::BIGINT AS hour, " + ", ".join(f"coalesce(count(*) FILTER (symbol = '{s}'), 0)::BIGINT AS {s}" for s in SYMBOLS) + " FROM hourly GROUP BY 1"))
def top_and_pivot(spark, d):
    return hourly(spark, d).groupBy(F.hour("ts").cast("long").alias("hour")).pivot("symbol", list(SYMBOLS)).agg(F.count(F.lit(1))).fillna(0)


@query("top_k", sql(HOURLY, "SELECT symbol, ts, round(volume, 6) AS volume FROM hourly ORDER BY volume DESC, symbol, ts LIMIT 25"))
def top_k(spark, d):
    """A top-k report: the limit is the feature."""
    return hourly(spark, d).orderBy(F.desc("volume"), "symbol", "ts").limit(25).select("symbol", "ts", "volume")


@query("union_distinct", sql(HOURLY + ", " + DAILY, "SELECT symbol, count(DISTINCT ts)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT symbol, ts FROM hourly UNION ALL SELECT symbol, ts FROM daily) GROUP BY symbol"))
def union_distinct(spark, d):
    both = hourly(spark, d).select("symbol", "ts").unionByName(daily(spark, d).select("symbol", "ts"))
    return both.groupBy("symbol").agg(F.count_distinct("ts").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- labels, splits, weights --------------------------------------------------------------------


@query("labels_direction", sql(HOURLY, "SELECT symbol, ts, " + ", ".join(f"round(ln(lead(close, {n}) OVER w / close), 6) + 0.0 AS fwdret_{n}, CASE WHEN lead(close, {n}) OVER w IS NOT NULL THEN CASE WHEN lead(close, {n}) OVER w > close THEN 1.0 ELSE 0.0 END END::DOUBLE AS label_dir_{n}" for n in (1, 5, 20)) + " FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY ts)"))
def labels_direction(spark, d):
    return labels.direction(hourly(spark, d), (1, 5, 20)).select("symbol", "ts", *[f"{k}_{n}" for n in (1, 5, 20) for k in ("fwdret", "label_dir")])


@query("label_ends", sql(HOURLY, "SELECT symbol, ts, coalesce(lead(ts, 10) OVER (PARTITION BY symbol ORDER BY ts), max(ts) OVER (PARTITION BY symbol)) AS t1 FROM hourly"))
def label_ends(spark, d):
    return labels.label_ends(hourly(spark, d), 10).select("symbol", "ts", "t1")


def signal_events(spark, d):
    """Every bar as a signal, buys and sells in turn."""
    return positioned(spark, d).select("symbol", "pos", F.col("close").alias("entry_price"), F.when(F.col("pos") % 2 == 0, "Buy ").otherwise("sell").alias("signal"), ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("atr_pct"))


@query("triple_barrier", sql(HOURLY + """,
 ev AS (SELECT symbol, pos, close AS entry, pos % 2 = 0 AS long, greatest(2 * (high - low) / close * 100, 1.0) / 100 AS w FROM bars),
 path AS (SELECT e.*, b.pos - e.pos AS k, CASE WHEN long THEN b.high >= entry * (1 + w) ELSE b.low <= entry * (1 - w) END AS won, CASE WHEN long THEN b.low <= entry * (1 - w) ELSE b.high >= entry * (1 + w) END AS lost, CASE WHEN long THEN b.close / entry - 1 ELSE 1 - b.close / entry END AS ret FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.pos BETWEEN e.pos + 1 AND e.pos + 10),
 got AS (SELECT symbol, pos, min(k) FILTER (won OR lost) AS hit, count(*) AS seen, max(ret) FILTER (k = 10) AS last_ret FROM path GROUP BY ALL),
 j AS (SELECT ev.symbol, ev.pos, ev.w, hit, seen, last_ret, p.won, p.lost FROM ev LEFT JOIN got USING (symbol, pos) LEFT JOIN path p ON p.symbol = ev.symbol AND p.pos = ev.pos AND p.k = got.hit),
 o AS (SELECT *, CASE WHEN hit IS NOT NULL THEN CASE WHEN won AND lost THEN 'lower_ambiguous' WHEN lost THEN 'lower' ELSE 'upper' END WHEN seen = 10 THEN 'time' ELSE 'no_data' END AS outcome FROM j),
 t AS (SELECT *, CASE outcome WHEN 'upper' THEN w WHEN 'time' THEN last_ret WHEN 'no_data' THEN NULL ELSE -w END AS ret FROM o)""", """
SELECT symbol, pos, outcome, round(ret, 6) + 0.0 AS ret, CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END::BIGINT AS label, CASE WHEN outcome = 'time' THEN 10 ELSE hit END::BIGINT AS bars_to_exit FROM t"""))
def triple_barrier(spark, d):
    got = labels.triple_barrier(signal_events(spark, d), positioned(spark, d))
    return got.select("symbol", "pos", "outcome", "ret", F.col("label").cast("long"), F.col("bars_to_exit").cast("long"))


_ONE = RETURNS + ", one AS (SELECT symbol, pos, ts, r AS logret FROM rets), n AS (SELECT symbol, count(*) AS n FROM one GROUP BY symbol)"
_SPANS = _ONE + ", spans AS (SELECT symbol, pos AS s, least(pos + 5, n - 1) AS e FROM one JOIN n USING (symbol)), conc AS (SELECT o.symbol, o.pos, any_value(o.logret) AS logret, count(s.s)::BIGINT AS n_concurrent FROM one o LEFT JOIN spans s ON o.symbol = s.symbol AND o.pos BETWEEN s.s AND s.e GROUP BY o.symbol, o.pos), u AS (SELECT s.symbol, s.s AS start, s.e AS end_, avg(1.0 / c.n_concurrent) AS u, abs(sum(coalesce(c.logret, 0) / c.n_concurrent)) AS w FROM spans s JOIN conc c ON c.symbol = s.symbol AND c.pos BETWEEN s.s AND s.e GROUP BY ALL), x AS (SELECT *, sum(u) OVER (PARTITION BY symbol ORDER BY start, end_ ROWS UNBOUNDED PRECEDING) AS x, sum(u) OVER (PARTITION BY symbol) AS t FROM u)"


@query("concurrency", sql(_SPANS, "SELECT symbol, pos, n_concurrent FROM conc"))
def concurrency(spark, d):
    b = series(spark, d)
    return splits.concurrency(spans_to(b, 5), b, "symbol").select("symbol", "pos", "n_concurrent")


@query("uniqueness_decay", sql(_SPANS, "SELECT symbol, start, end_ AS \"end\", round(u, 6) AS uniqueness, round(greatest(1 - (1 - 0.5) / t * (t - x), 0), 6) AS decay FROM x"))
def uniqueness_decay(spark, d):
    b = series(spark, d)
    return splits.time_decay(splits.average_uniqueness(spans_to(b, 5), b, "symbol"), 0.5, key="symbol").select("symbol", "start", "end", "uniqueness", "decay")


@query("return_weights", sql(_SPANS, "SELECT symbol, start, round(w / avg(w) OVER (PARTITION BY symbol), 6) AS weight FROM u"))
def return_weights(spark, d):
    b = series(spark, d)
    return splits.return_weights(spans_to(b, 5), b, key="symbol").select("symbol", "start", "weight")


@query("recency_weights", sql(_ONE + ", a AS (SELECT symbol, pos, exp(-ln(2) * floor(epoch(max(ts) OVER v - ts) / 86400) / 180) AS w, pow(0.5, (max(pos) OVER v - pos) / 4320.0) AS by_bars FROM one WINDOW v AS (PARTITION BY symbol))", "SELECT symbol, pos, round(w / avg(w) OVER (PARTITION BY symbol), 6) AS by_days, round(by_bars, 6) AS by_bars FROM a"))
def recency_weights(spark, d):
    df = splits.recency_by_days(positioned(spark, d).select("symbol", "pos", "ts"), key="symbol").withColumnRenamed("weight", "by_days")
    return splits.recency_by_bars(df, key="symbol").select("symbol", "pos", "by_days", F.col("weight").alias("by_bars"))


def ends_of(spark, d):
    return spans_to(series(spark, d), 10, "pos")


_ENDS = _ONE + """, e AS (SELECT symbol, pos, least(pos + 10, n - 1) AS t1 FROM one JOIN n USING (symbol)),
 f AS (SELECT symbol, k, k * (n // 5) + least(k, n % 5) AS a, (k + 1) * (n // 5) + least(k + 1, n % 5) AS b, n FROM n, (SELECT unnest(range(5)) AS k)),
 l AS (SELECT f.*, max(t1) AS te FROM f JOIN e ON e.symbol = f.symbol AND pos >= a AND pos < b GROUP BY ALL)"""


@query("purged_kfold", sql(_ENDS, "SELECT e.symbol, k::BIGINT AS split_id, pos, CASE WHEN pos >= a AND pos < b THEN 'test' ELSE 'train' END AS role FROM e JOIN l ON l.symbol = e.symbol WHERE (pos >= a AND pos < b) OR (pos < a AND t1 < a) OR (pos >= b AND pos >= te + 1 + floor(l.n * 0.01))"))
def purged_kfold(spark, d):
    return splits.purged_kfold(ends_of(spark, d), None, 5, 0.01, "symbol").withColumn("split_id", F.col("split_id").cast("long"))


@query("cpcv_splits", sql(_ENDS + ", c AS (SELECT x.k AS k1, y.k AS k2, row_number() OVER (ORDER BY x.k, y.k) - 1 AS s FROM range(5) x(k) JOIN range(5) y(k) ON x.k < y.k), m AS (SELECT s, k1 AS k FROM c UNION ALL SELECT s, k2 FROM c), g AS (SELECT e.symbol, s, pos, bool_or(pos >= a AND pos < b) AS test, bool_or((pos <= te AND t1 >= a) OR (pos > te AND pos <= te + floor(l.n * 0.01))) AS near FROM e JOIN l ON l.symbol = e.symbol JOIN m USING (k) GROUP BY e.symbol, s, pos)", "SELECT symbol, s::BIGINT AS split_id, pos, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM g WHERE test OR NOT near"))
def cpcv_splits(spark, d):
    return splits.cpcv(ends_of(spark, d), None, 5, 2, 0.01, "symbol").withColumn("split_id", F.col("split_id").cast("long"))


@query("embargo_times", sql(_ONE, "SELECT o.symbol, o.ts, coalesce(o2.ts, m.last) AS until FROM one o JOIN n USING (symbol) JOIN (SELECT symbol, max(ts) AS last FROM one GROUP BY symbol) m USING (symbol) LEFT JOIN one o2 ON o2.symbol = o.symbol AND o2.pos = o.pos + floor(n * 0.05)"))
def embargo_times(spark, d):
    return splits.embargo_times(positioned(spark, d).select("symbol", "pos", "ts"), 0.05, "symbol").select("symbol", "ts", "until")


@query("walk_forward_roles", sql(_ONE + ", f AS (SELECT symbol, k, floor(n * 0.4)::BIGINT + k * ((n - floor(n * 0.4)::BIGINT) // 5) AS a, CASE WHEN k = 4 THEN n ELSE floor(n * 0.4)::BIGINT + (k + 1) * ((n - floor(n * 0.4)::BIGINT) // 5) END AS b FROM n, (SELECT unnest(range(5)) AS k))", "SELECT o.symbol, k::BIGINT AS fold, pos, CASE WHEN pos >= a AND pos < b THEN 'test' ELSE 'train' END AS role FROM one o JOIN f ON f.symbol = o.symbol WHERE (pos >= a AND pos < b) OR pos < a - 20"))
def walk_forward_roles(spark, d):
    df = series(spark, d).select("symbol", "pos")
    return splits.walk_forward(df, splits.growing_folds_of(df, "symbol"), 10, "symbol").select("symbol", F.col("fold").cast("long"), "pos", "role")


@query("expanding_folds", sql(_ONE + ", f AS (SELECT symbol, k::BIGINT AS fold, (n * (0.5 + k * ((0.9 - 0.5) / 5)::DOUBLE))::DOUBLE AS a, (n * (0.5 + (k + 1) * ((0.9 - 0.5) / 5)::DOUBLE))::DOUBLE AS b FROM n, (SELECT unnest(range(5)) AS k))", "SELECT symbol, fold, floor(a)::BIGINT AS a, floor(b)::BIGINT AS b FROM f WHERE floor(a) >= 100 AND floor(b) - floor(a) >= 10"))
def expanding_folds(spark, d):
    return splits.expanding_folds_of(positioned(spark, d), "symbol", least_train=100, least_test=10).withColumn("fold", F.col("fold").cast("long"))


@query("sequential_bootstrap")
def sequential_bootstrap(spark, d):
    return splits.bootstrap_replicates(spans_to(series(spark, d), 5), 50, [0, 1, 2])


# --- simulation, search, models -----------------------------------------------------------------


def small_grid(spark) -> DataFrame:
    return sim.grid(spark, rsi_len=[7, 14], stoch_len=[9, 14], adx_len=[14], adx_th=[5.0, 15.0], os_th=[40.0, 50.0], k_th=[70.0], d_th=[70.0], fixed_sl=[2.0, 1000.0], trail_sl=[0.0, 1.0], gain_th=[0.5], tp=[0.0, 3.0])


@query("grid_trades")
def grid_trades(spark, d):
    return sim.run_grid(hourly(spark, d), small_grid(spark))


@query("grid_summary")
def grid_summary(spark, d):
    return sim.summary(grid_trades(spark, d), ["symbol", "config_id"])


@query("vertical_barrier")
def vertical_barrier(spark, d):
    g = sim.grid(spark, rsi_len=[14], stoch_len=[14], adx_len=[14], adx_th=[5.0], os_th=[50.0], k_th=[70.0], d_th=[70.0], fixed_sl=[1000.0], trail_sl=[0.0], gain_th=[0.0], tp=[0.0], max_bars=[10.0])
    return sim.summary(sim.run_grid(hourly(spark, d), g, cross="pine"), ["symbol", "config_id"])


@query("search_decay")
def search_decay(spark, d):
    """Best configurations of the whole period, again on its second half."""
    g = small_grid(spark)
    whole = sim.summary(sim.run_grid(hourly(spark, d), g), ["symbol", "config_id"])
    late = sim.summary(sim.run_grid(hourly(spark, d), g, since="2024-01-15"), ["symbol", "config_id"])
    return sim.decay(whole, late)


def returns_by_symbol_hour(spark, d):
    df = hourly(spark, d).withColumn("r", N.Rolling().log_return(F.col("close"), 1)).where("r is not null")
    numbered = df.withColumn("obs_no", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    return numbered.select(F.col("symbol").alias("strategy_id"), F.col("obs_no").cast("long"), F.col("r").alias("ret"))


@query("backtest_overfitting")
def backtest_overfitting(spark, d):
    df = returns_by_symbol_hour(spark, d)
    shortest = df.groupBy("strategy_id").agg(F.max("obs_no").alias("m")).agg(F.min("m").alias("m"))
    return stats.overfitting(df.crossJoin(F.broadcast(shortest)).where("obs_no <= m").drop("m"), 8)


@query("regime_inputs", digits=5)
def regime_inputs(spark, d):
    return indicators.regime_inputs(daily(spark, d)).select("symbol", "ts", "ret_3", "vol_14", "adx", "autocorr_10")


def regime_fits(spark, d):
    """Fits of every symbol's days with two to five states, both kinds of covariance."""
    rows = stored(indicators.regime_inputs(daily(spark, d)))
    return rows, stored(regime.compare(rows, ["ret_3", "vol_14"], [2, 3, 4, 5], restarts=2, iterations=60, covariances=("diag", "full")))


@query("regime_compare")
def regime_compare(spark, d):
    return regime_fits(spark, d)[1].select("symbol", "k", "seed", "covariance", "healthy", "loglik", "test_loglik", "bic", "aic")


@query("regime_decode")
def regime_decode(spark, d):
    rows, fits = regime_fits(spark, d)
    return regime.decode_each(rows, ["ret_3", "vol_14"], regime.best_of(fits), hindsight=True).drop("filtered_probs")


def out_of_fold(spark, d) -> tuple[DataFrame, str]:
    f, label = ["logret_1", "logret_5", "vol_10", "bb_pos", "hl_range_pct"], "label_dir_1"
    df = labels.direction(indicators.window_features(positioned(spark, d)), (1,)).where(f"{label} is not null").select("symbol", "pos", label, *f)
    df = stored(splits.recency_by_bars(df, key="symbol"))
    folds = splits.walk_forward(df.select("symbol", "pos"), splits.growing_folds_of(df, "symbol", 3), 1, "symbol")
    return models.out_of_fold(df, folds, f, label, [0, 1], on=("symbol", "pos"), iterations=5, depth=4), label


@query("model_walk_forward")
def model_walk_forward(spark, d):
    return models.fold_aucs(*out_of_fold(spark, d))


@query("oof_predictions", sql(_ONE + ", f AS (SELECT symbol, k, floor(m * 0.4)::BIGINT + k * ((m - floor(m * 0.4)::BIGINT) // 3) AS a, CASE WHEN k = 2 THEN m ELSE floor(m * 0.4)::BIGINT + (k + 1) * ((m - floor(m * 0.4)::BIGINT) // 3) END AS b FROM (SELECT symbol, n - 1 AS m FROM n), (SELECT unnest(range(3)) AS k))", "SELECT o.symbol, o.pos, k::BIGINT AS fold, true AS a_probability FROM one o JOIN f ON f.symbol = o.symbol WHERE pos >= a AND pos < b"))
def oof_predictions(spark, d):
    """A prediction of each row of each fold's test, by models of rows before it."""
    return out_of_fold(spark, d)[0].select("symbol", "pos", F.col("fold").cast("long"), F.col("pred").between(0, 1).alias("a_probability"))


@query("sequence_windows", sql(HOURLY, "SELECT symbol, ts, 20::BIGINT AS n, round(lag(close, 19) OVER w, 6) AS first_close, round(close, 6) AS last_close FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY pos >= 19"))
def sequence_windows(spark, d):
    return models.windows(hourly(spark, d), 20).select("symbol", "ts", F.size("x").cast("long").alias("n"), F.col("x")[0]["close"].alias("first_close"), F.col("x")[19]["close"].alias("last_close"))


@query("leakage_audit")
def leakage_audit(spark, d):
    """Every feature before a cut must stay as it was when all after it is replaced."""
    b = positioned(spark, d)
    noise = F.pmod(F.xxhash64("symbol", "pos"), F.lit(1000)) / 10.0 + 50
    broken = b.withColumns({c: F.when(F.col("pos") >= 400, noise).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    x, y = (indicators.features(t.drop("pos")) for t in (b, broken))
    before = b.where("pos < 400").select("symbol", "ts")
    return models.largest_difference(x.join(before, ["symbol", "ts"]), y, indicators.feature_names(x), ["symbol", "ts"])


# --- studies ------------------------------------------------------------------------------------


@query("paths_by_confidence", sql(HOURLY + """,
 ev AS (SELECT symbol, pos, close AS entry, trades AS score FROM bars),
 q AS (SELECT quantile_cont(score, 0.25) AS lo, quantile_cont(score, 0.75) AS hi FROM ev),
 b AS (SELECT ev.*, CASE WHEN score >= hi THEN 'top' WHEN score <= lo THEN 'bottom' ELSE 'middle' END AS bucket FROM ev, q)""", """
SELECT bucket, (x.pos - b.pos)::BIGINT AS bar_no, round(avg(x.close / b.entry - 1), 6) + 0.0 AS mean_return, count(*)::BIGINT AS n FROM b JOIN bars x ON x.symbol = b.symbol AND x.pos BETWEEN b.pos + 1 AND b.pos + 20 GROUP BY ALL"""))
def paths_by_confidence(spark, d):
    b = positioned(spark, d)
    ev = b.select("symbol", "pos", F.col("close").alias("entry_price"), F.col("trades").alias("score"))
    return research.paths_by_confidence(ev, b).withColumn("bar_no", F.col("bar_no").cast("long"))


@query("bootstrap_gap")
def bootstrap_gap(spark, d):
    df = hourly(spark, d).withColumn("r", N.Rolling().log_return(F.col("close"), 1)).select("symbol", "ts", "r")
    return research.bootstrap_gap(df, "r", "symbol", "click", "view")


@query("effective_size", sql(_SPANS, "SELECT u.symbol, count(*)::BIGINT AS n, round(sum(u), 6) AS effective_n, round(any_value(c.m), 6) AS mean_concurrency FROM u JOIN (SELECT symbol, avg(n_concurrent) AS m FROM conc WHERE n_concurrent > 0 GROUP BY symbol) c USING (symbol) GROUP BY u.symbol"))
def effective_size(spark, d):
    b = series(spark, d)
    return research.effective_size(spans_to(b, 5), b)


@query("weight_schemes", sql(_SPANS, "SELECT symbol, start, end_ AS \"end\", 1.0::DOUBLE AS A, round(u, 6) AS B, round(w / avg(w) OVER (PARTITION BY symbol), 6) AS C, round(u * greatest(1 - (1 - 0.5) / t * (t - x), 0), 6) AS D, round(u * pow(0.5, (max(start) OVER (PARTITION BY symbol) - start) / 4320.0), 6) AS E FROM x"))
def weight_schemes(spark, d):
    b = series(spark, d)
    return research.weight_schemes(spans_to(b, 5), b)


@query("purge_by_exit", "SELECT symbol, pos FROM (" + SQL["triple_barrier"] + ") WHERE pos + bars_to_exit < 300")
def purge_by_exit(spark, d):
    """Signals whose own trades, by their barriers, end before a test begins."""
    rows = positioned(spark, d)
    return research.purge_by_exit(labels.triple_barrier(signal_events(spark, d), rows), 300).select("symbol", "pos")


@query("input_search")
def input_search(spark, d):
    """Entries of a small grid, scored by a plain mean-reversion probability; however often a day they fire."""
    b = positioned(spark, d)
    r = N.Rolling()
    pred = labels.direction(b, (1,)).withColumn("pred", N.sigmoid(-r.log_return(F.col("close"), 1) * 5)).select("symbol", "pos", "pred", F.col("label_dir_1").alias("actual"))
    fired = grid_trades(spark, d).select("symbol", "config_id", F.col("entry_idx").alias("pos"), "dir", "n_days")
    return research.input_search(fired, pred, 30, per_day=None)


@query("generalization")
def generalization(spark, d):
    g = small_grid(spark)
    whole = sim.summary(sim.run_grid(hourly(spark, d), g), ["symbol", "config_id"])
    late = sim.summary(sim.run_grid(hourly(spark, d), g, since="2024-01-15"), ["symbol", "config_id"])
    return research.generalization(whole, late)


@query("leakage_comparison")
def leakage_comparison(spark, d):
    f = ["logret_1", "logret_20", "vol_10", "bb_pos"]
    df = labels.direction(indicators.window_features(positioned(spark, d)), (20,)).select("symbol", "pos", "label_dir_20", *f).where("label_dir_20 is not null")
    return research.leakage_comparison(stored(df), f, "label_dir_20", 20, 3, iterations=5, depth=3)


@query("pearson_series", sql(_TWO, "SELECT round(corr(s.close, p.close), 6) + 0.0 AS r, count(*)::BIGINT AS n FROM spot s JOIN perp p USING (ts)"))
def pearson_series(spark, d):
    df = align.side_by_side(*_two(spark, d), ["ts"], ("_spot", "_perp"))
    return df.agg(F.corr("close_spot", "close_perp").alias("r"), F.count("*").alias("n"))


@query("tail_thresholds", sql(RETURNS, "SELECT round(quantile_cont(r, 1 - 2.0 / 24 / 2), 6) + 0.0 AS buy, round(quantile_cont(r, 2.0 / 24 / 2), 6) + 0.0 AS sell FROM rets WHERE r IS NOT NULL"))
def tail_thresholds(spark, d):
    return models.tail_thresholds(hourly(spark, d).withColumn("pred", N.Rolling().log_return(F.col("close"), 1)))


@query("purge_overlaps", sql(_SPANS + ", t AS (SELECT DISTINCT symbol, s AS a, e AS b FROM spans JOIN n USING (symbol) WHERE s >= n // 3 + 20 * (ascii(symbol) % 5) AND s < n // 3 + 20 * (ascii(symbol) % 5) + 40)", 'SELECT symbol, s AS "start", e AS "end" FROM spans WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.symbol = spans.symbol AND s <= b AND a <= e)'))
def purge_overlaps(spark, d):
    """Each series has test spans of its own, at other places than the others'."""
    b = series(spark, d)
    spans = spans_to(b, 5)
    first = F.floor(F.col("n") / 3) + 20 * (F.ascii("symbol") % 5)
    tests = spans.join(b.groupBy("symbol").agg(F.count("*").alias("n")), "symbol").where((F.col("start") >= first) & (F.col("start") < first + 40))
    return splits.purge(spans, tests.select("symbol", "start", "end").distinct(), "start", "end", "symbol", width=100)


@query("forward_path", sql(HOURLY, "SELECT e.symbol, e.pos, (b.pos - e.pos)::BIGINT AS bar_no, round(b.close / e.close - 1, 6) + 0.0 AS gain FROM bars e JOIN bars b ON b.symbol = e.symbol AND b.pos BETWEEN e.pos + 1 AND e.pos + 5"))
def forward_path(spark, d):
    b = positioned(spark, d)
    ev = b.select("symbol", "pos", F.col("close").alias("entry"))
    return align.forward_path(ev, b, 5).select("symbol", "pos", F.col("bar_no").cast("long"), (F.col("bar.close") / F.col("entry") - 1).alias("gain"))


@query("htf_return_4h", sql(COARSE + ", h AS (SELECT symbol, ts, CASE WHEN close > 0 AND lag(close, 5) OVER w > 0 THEN ln(close / lag(close, 5) OVER w) END AS l FROM full4 WINDOW w AS (PARTITION BY symbol ORDER BY ts)), s AS (SELECT symbol, ts, lag(l) OVER (PARTITION BY symbol ORDER BY ts) AS l FROM h)", "SELECT b.symbol, b.ts, round(s.l, 6) + 0.0 AS htf_4h_logret5 FROM hourly b LEFT JOIN s ON s.symbol = b.symbol AND s.ts = time_bucket(INTERVAL 4 HOUR, b.ts)"))
def htf_return_4h(spark, d):
    b = hourly(spark, d)
    return b.withColumn("bin", bars.floor_to("ts", "4 hours")).join(indicators.higher_frame(b, "4 hours", "4h"), ["symbol", "bin"], "left").select("symbol", "ts", "htf_4h_logret5")


@query("seeded_sample", sql(TAPE, "SELECT symbol, trade_id, round(price, 6) AS price FROM tape ORDER BY md5('7/' || trade_id), trade_id LIMIT 100"))
def seeded_sample(spark, d):
    """A sampling operator: the limit is the feature."""
    return research.sample(tape(spark, d), 100, 7, "trade_id").select("symbol", "trade_id", "price")


@query("effective_inner_split", sql(_ONE, "SELECT symbol, pos, CASE WHEN pos < min(pos) OVER w + (max(pos) OVER w - min(pos) OVER w) * 0.85 THEN 'fit' ELSE 'stop' END AS \"inner\" FROM one WINDOW w AS (PARTITION BY symbol)"))
def effective_inner_split(spark, d):
    return research.inner_split(positioned(spark, d).select("symbol", "pos"))
