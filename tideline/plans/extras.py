"""Registered queries of scans, sinks, guards, models and streams, with their SQL twins."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import numeric as N
from tideline.functions import tables
from tideline.operators import covariance, indicators, labels, models, regime, research, sim, splits, stats
from tideline.plans.catalog import DAILY, HOURLY, RETURNS, SQL, QUERIES, SYMBOLS, grid_trades, query, r6, small_grid
from tideline.plans.inputs import TAPE, daily, hourly, positioned, rounded, series, sql, tape
from tideline.plans.twins import _FRAME, _STOCH, _SUMMARY, _TRADES, trades_ctes
from tideline.sources import readers, sinks
from tideline.sources.shared import shared_folder, stored
from tideline.streaming import live

__all__ = ["QUERIES", "SQL", "rounded"]


def place(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans and sinks -------------------------------------------------------------------------------


@query("csv_bars", sql(HOURLY, f"SELECT symbol, ts, {r6('open', 'high', 'low', 'close', 'volume')}, trades FROM hourly"))
def csv_bars(spark, d):
    """Bars written over as CSV with a header, and scanned by a declared schema."""
    path = place(spark, "csv")
    for _ in range(2):
        sinks.overwrite(hourly(spark, d), path, "csv")
    return readers.read_bars_csv(spark, path, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, trades long")


@query("days_appended", sql(TAPE, "SELECT ts::DATE AS day, count(*)::BIGINT AS n, round(sum(quantity), 6) AS quantity FROM tape GROUP BY ALL"))
def days_appended(spark, d):
    """Days appended in two runs, the second repeating what the first had done; days done are left out by what was marked."""
    per_day = stored(tape(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity")))
    path, done = place(spark, "days"), place(spark, "done")
    first = per_day.where("day < date'2024-01-20'")
    sinks.append_days(first, path)
    sinks.mark_done(first, done)
    sinks.append_days(per_day.where("day = date'2024-01-19'"), path)
    left = readers.unprocessed(per_day, spark.read.parquet(done))
    sinks.append_days(left.select(*per_day.columns), path)
    sinks.mark_done(left, done)
    return spark.read.parquet(path).select(*per_day.columns).join(spark.read.parquet(done), "day", "left_semi")


@query("zipped_days", sql(TAPE, "SELECT symbol, trade_id, round(price, 4) AS price FROM tape"))
def zipped_days(spark, d):
    """Each day's trades as a zipped CSV file, read again; a day's file is made and read in one task, as a file is."""

    def pack(pdf):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("trades.csv", pdf[["symbol", "trade_id", "price"]].to_csv(index=False))
        return pd.DataFrame({"day": pdf["day"].iloc[:1], "content": [held.getvalue()]})

    rows = tape(spark, d).select(F.to_date("ts").alias("day"), "symbol", "trade_id", F.round("price", 4).alias("price"))
    files = stored(rows.groupBy("day").applyInPandas(pack, "day date, content binary"))
    return readers.unzipped(files, "symbol string, trade_id bigint, price double")


@query("days_streamed", SQL["days_appended"])
def days_streamed(spark, d):
    """Files of days as a stream: a run that fails after its first batch was written, and one that goes on; two days come again later with all their trades."""
    source, path = place(spark, "day-files"), place(spark, "days-etl")
    rows = tape(spark, d).select("trade_id", "ts", "quantity", F.to_date("ts").alias("day"))
    early = F.col("day").isin("2024-01-03", "2024-01-04") & (F.col("trade_id") % 2 == 0)
    for part in (early, F.col("day") < "2024-01-16", F.col("day") >= "2024-01-16"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{source}/files")
    tries = []

    def per_day(batch):
        tries.append(1)
        if len(tries) == 2:
            raise OSError("the second batch fails once")
        return batch.groupBy("day").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))

    for _ in range(2):
        files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/files")
        query = sinks.stream_days(files, f"{path}/rows", per_day, f"{path}/checkpoint")
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if len(tries) != 2:
                raise
    return sinks.streamed_days(spark, f"{path}/rows").select("day", "n", "quantity")


@query("udtf_info_bars", SQL["info_bars_volume"])
def udtf_info_bars(spark, d):
    """Information bars from SQL."""
    tables.register(spark)
    hourly(spark, d).createOrReplaceTempView("_tideline_bars")
    return spark.sql("SELECT symbol, bar_id, ts, n_source_bars, open, high, low, close, volume, measure FROM info_bars(TABLE(SELECT symbol, ts, open, high, low, close, volume FROM _tideline_bars) PARTITION BY symbol ORDER BY (ts), 2000.0D)")


@query("udtf_triple_barrier", SQL["triple_barrier"])
def udtf_triple_barrier(spark, d):
    """Outcomes of signals from SQL."""
    from tideline.plans.catalog import signal_events

    tables.register(spark)
    signal_events(spark, d).join(positioned(spark, d).select("symbol", "pos", "high", "low", "close"), ["symbol", "pos"]).createOrReplaceTempView("_tideline_signals")
    return spark.sql("SELECT * FROM triple_barrier(TABLE(SELECT symbol, pos, high, low, close, signal, atr_pct FROM _tideline_signals) PARTITION BY symbol ORDER BY (pos), 10)")


_HY = TAPE + """,
 v AS (SELECT symbol, ts::DATE AS day, ts, last(ln(price) ORDER BY trade_id) AS p FROM tape WHERE price > 0 GROUP BY symbol, ts),
 s AS (SELECT *, lag(ts) OVER w AS a, p - lag(p) OVER w AS step FROM v WINDOW w AS (PARTITION BY symbol, day ORDER BY ts)),
 n AS (SELECT day, count(*) FILTER (symbol = 'click')::BIGINT AS n_x, count(*) FILTER (symbol = 'view')::BIGINT AS n_y FROM v GROUP BY day),
 c AS (SELECT x.day, sum(x.step * y.step) AS c FROM s x JOIN s y ON x.day = y.day AND x.symbol = 'click' AND y.symbol = 'view' AND x.a < y.ts AND y.a < x.ts GROUP BY x.day)"""


@query("async_covariance", sql(_HY, "SELECT day, n_x, n_y, round(coalesce(c, 0), 6) + 0.0 AS covariance FROM n LEFT JOIN c USING (day) WHERE n_x > 0 AND n_y > 0"))
def async_covariance(spark, d):
    """Covariance of clicks' and views' log prices on each day, whose times don't meet."""
    t = tape(spark, d).where("price > 0").select("symbol", F.to_date("ts").alias("day"), "ts", "trade_id", F.log("price").alias("price"))
    return covariance.hayashi_yoshida(t.where("symbol = 'click'"), t.where("symbol = 'view'"), key="day")


@query("log_appended", sql(TAPE, "SELECT symbol, trade_id, round(price, 4) AS price FROM tape"))
def log_appended(spark, d):
    """A CSV log that two batches append to; every file has a header of its own."""
    path, rows = place(spark, "log"), tape(spark, d).select("symbol", "trade_id", F.round("price", 4).alias("price"))
    for part in (0, 1):
        sinks.append_log(rows.where(F.col("trade_id") % 2 == part), path)
    return readers.read_bars_csv(spark, path, "symbol string, trade_id long, price double")


def raw_klines(spark, d) -> DataFrame:
    """Hourly bars in the shape of kline rows: milliseconds, numbers as text."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return hourly(spark, d).select("symbol", ms("ts").alias("open_time"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")], (ms("ts") + 3_599_999).alias("close_time"), F.col("volume").cast("string").alias("quote_volume"), F.col("trades").cast("long"))


@query("klines_clean", sql(HOURLY, f"SELECT symbol, ts, {r6('open', 'high', 'low')}, CASE WHEN trades <> 4 THEN round(close, 6) END AS close, {r6('volume')}, round(volume, 6) AS quote_volume, trades FROM hourly WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25 00:00:00'"))
def klines_clean(spark, d):
    """Repeated rows are one, bad numbers null, and bars that close later are not there yet."""
    raw = raw_klines(spark, d).withColumn("close", F.when(F.col("trades") != 4, F.col("close")).otherwise("n/a"))
    return readers.clean_klines(raw.union(raw), 1_706_140_800_000, ("symbol",))


@query("funding_clean", sql(HOURLY, "SELECT symbol, ts AS \"fundingTime\", round(close / 1000, 6) AS \"fundingRate\", CASE WHEN trades <> 4 THEN round(open, 6) END AS \"markPrice\" FROM hourly"))
def funding_clean(spark, d):
    raw = hourly(spark, d).select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("fundingTime"), (F.col("close") / 1000).cast("string").alias("fundingRate"), F.when(F.col("trades") != 4, F.col("open").cast("string")).otherwise("").alias("markPrice"))
    return readers.funding_rows(raw.union(raw), ("symbol",))


def paged(spark, d, **options) -> DataFrame:
    """Each symbol's klines from a paged service, which a folder of JSON lines stands in for."""
    spark.dataSource.register(readers.PagedSource)
    fields = F.concat_ws(",", F.col("open_time"), *[F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in ("open", "high", "low", "close", "volume")], F.col("close_time"), F.concat(F.lit('"'), F.col("quote_volume"), F.lit('"')), F.col("trades"), F.lit('"0"'), F.lit('"0"'), F.lit('"0"'))
    path = place(spark, "service")
    raw_klines(spark, d).select("symbol", F.concat(F.lit("["), fields, F.lit("]")).alias("value")).write.partitionBy("symbol").text(path)
    out = None
    for s in SYMBOLS:
        rows = spark.read.format("paged_klines").options(path=f"{path}/symbol={s}", start="1704067200000", end="1706745600000", step="3600000", **options).load()
        rows = readers.clean_klines(rows.withColumn("symbol", F.lit(s)), None, ("symbol",))
        out = rows if out is None else out.unionByName(rows)
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume", "trades")


@query("paged_forward", SQL["csv_bars"])
def paged_forward(spark, d):
    """Pages of 100 forward from a cursor, in three slices of time, each request failing twice before it answers."""
    return paged(spark, d, page_limit="100", slices="3", failures="2", backoff="0")


@query("paged_backward", SQL["csv_bars"])
def paged_backward(spark, d):
    return paged(spark, d, page_limit="70", direction="backward")


@query("kept_or_fetched", sql(HOURLY, f"SELECT symbol, ts, {r6('open', 'high', 'low', 'close', 'volume')} FROM hourly WHERE ts >= TIMESTAMP '2024-01-10'"))
def kept_or_fetched(spark, d):
    """Fetched once and kept; the second time what is kept is read, from a date on."""
    path, columns, calls = place(spark, "cache"), ["symbol", "ts", "open", "high", "low", "close", "volume"], []

    def fetch():
        calls.append(1)
        if len(calls) > 1:
            raise ValueError("what is kept was not used")
        return hourly(spark, d)

    readers.kept_or_fetched(spark, path, "2024-01-10", columns, fetch)
    return readers.kept_or_fetched(spark, path, "2024-01-10", columns, fetch)


@query("tensor_roundtrip", sql(HOURLY, "SELECT symbol, count(*)::BIGINT AS windows, round(sum(c), 4) AS total FROM (SELECT symbol, pos, sum(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS c FROM bars) WHERE pos >= 19 GROUP BY symbol"), 4)
def tensor_roundtrip(spark, d):
    """Windows as array columns in Parquet, read again."""
    kept = stored(models.windows(hourly(spark, d), 20))
    return kept.groupBy("symbol").agg(F.count("*").alias("windows"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["close"])).alias("total"))


@query("repeated_columns", sql(HOURLY, f"SELECT symbol, ts, {r6('close')} FROM hourly"))
def repeated_columns(spark, d):
    """Columns that a join of files has doubled (a name with .1 behind it) go."""
    df = hourly(spark, d).select("symbol", "ts", "close", F.col("close").alias("close.1"), F.col("ts").alias("ts.1"))
    return readers.without_repeated(df)


# --- projections, labels, guards -------------------------------------------------------------------


@query("centred_features", sql(_FRAME, "SELECT symbol, pos, round((adx_14 - 25) / 25, 6) + 0.0 AS adx_centred, round((rsi_14 - 50) / 50, 6) + 0.0 AS rsi_centred FROM rf", True))
def centred_features(spark, d):
    df = indicators.strength(positioned(spark, d))
    return df.select("symbol", "pos", N.centred(F.col("adx_14"), 25).alias("adx_centred"), N.centred(F.col("rsi_14"), 50).alias("rsi_centred"))


@query("triple_barrier_5", SQL["triple_barrier"].replace("e.pos + 10", "e.pos + 5").replace("k = 10", "k = 5").replace("seen = 10", "seen = 5").replace("THEN 10 ELSE hit", "THEN 5 ELSE hit"))
def triple_barrier_5(spark, d):
    from tideline.plans.catalog import signal_events

    got = labels.triple_barrier(signal_events(spark, d), positioned(spark, d), 5)
    return got.select("symbol", "pos", "outcome", "ret", F.col("label").cast("long"), F.col("bars_to_exit").cast("long"))


@query("class_weights", sql(HOURLY + ", l AS (SELECT CASE WHEN lead(close) OVER w > close THEN 1.0 WHEN lead(close) OVER w IS NOT NULL THEN 0.0 END AS y FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY ts)), c AS (SELECT count(*) FILTER (y = 0) / greatest(count(*) FILTER (y = 1), 1) AS s FROM l)", "SELECT y::DOUBLE AS y, count(*)::BIGINT AS n, round(any_value(CASE WHEN y = 1 THEN s ELSE 1 END), 6) AS weight FROM l, c WHERE y IS NOT NULL GROUP BY y"))
def class_weights(spark, d):
    df = labels.direction(hourly(spark, d), (1,)).select(F.col("label_dir_1").alias("y")).where("y is not null")
    return models.class_weight(df, "y").groupBy("y").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


@query("signal_agreement", sql(HOURLY + ", s AS (SELECT symbol, pos % 2 = 0 AS raw_long, close >= open AS made_long, CASE WHEN lead(close) OVER w IS NOT NULL THEN (lead(close) OVER w > close) = (pos % 2 = 0) END AS won FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))", "SELECT symbol, count(*)::BIGINT AS n, count(*) FILTER (raw_long)::BIGINT AS n_long, round(avg(won::INT), 6) AS win_rate, round(avg((raw_long = made_long)::INT), 6) AS agreement FROM s GROUP BY symbol"))
def signal_agreement(spark, d):
    """Counts of signals, how often they won, and how often what was made agrees with what was signalled."""
    df = labels.direction(positioned(spark, d), (1,))
    raw, made = F.col("pos") % 2 == 0, F.col("close") >= F.col("open")
    won = F.when(F.col("label_dir_1").isNotNull(), ((F.col("label_dir_1") > 0) == raw).cast("double"))
    return stats.agreement(df.select("symbol", raw.alias("raw_long"), made.alias("made_long"), won.alias("won")), ["symbol"])


@query("aligned_rows", sql(HOURLY, "SELECT symbol, count(*)::BIGINT AS n FROM hourly GROUP BY symbol"))
def aligned_rows(spark, d):
    """Two frames of the same bars, checked to have the same rows before they are put side by side."""
    a, b = positioned(spark, d).select("symbol", "ts", "close"), indicators.window_features(hourly(spark, d)).select("symbol", "ts", "logret_1")
    research.assert_aligned(a, b, ["symbol", "ts"])
    return a.join(b, ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("n"))


@query("latest_row", sql(RETURNS + ", f AS (SELECT symbol, ts, close, r AS logret_1, (high - low) / close AS hl_range_pct FROM rets)", f"SELECT symbol, ts, {r6('close', 'logret_1', 'hl_range_pct')} FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"))
def latest_row(spark, d):
    """What a live decision is made of: the last row of each symbol, refused if a feature of it is missing."""
    df = indicators.window_features(hourly(spark, d))
    return research.latest_complete(df, ["logret_1", "hl_range_pct"]).select("symbol", "ts", "close", "logret_1", "hl_range_pct")


@query("prediction_distribution", sql(RETURNS + ", p AS (SELECT symbol, 1 / (1 + exp(5 * r)) AS pred FROM rets WHERE r IS NOT NULL)", "SELECT symbol, count(*)::BIGINT AS n, round(min(pred), 6) AS least, round(max(pred), 6) AS most, round(avg(pred), 6) AS mean, round(stddev_samp(pred), 6) AS std FROM p GROUP BY symbol"))
def prediction_distribution(spark, d):
    df = series(spark, d).where("logret is not null").withColumn("pred", N.sigmoid(F.col("logret") * -5))
    return stats.distribution(df, "pred", ["symbol"])


# --- searches --------------------------------------------------------------------------------------

_EXITS = dict(rsi_len=[14], stoch_len=[14], adx_len=[14], adx_th=[5.0], os_th=[50.0], k_th=[70.0], d_th=[70.0], **sim.EXITS, max_bars=[0])


@query("exit_sweep", sql(_STOCH + ", " + trades_ctes(_EXITS), f"SELECT {_SUMMARY} FROM summary", True))
def exit_sweep(spark, d):
    """One way to enter, all 540 ways to leave."""
    g = sim.grid(spark, **{k: list(map(float, v)) for k, v in _EXITS.items()})
    return sim.summary(sim.run_grid(hourly(spark, d), g), ["symbol", "config_id"])


_BOTH = _STOCH + ", " + trades_ctes(_EXITS) + ", " + trades_ctes(_EXITS, "2024-01-15", tag="_late")


@query("exit_study", sql(_BOTH, f"SELECT a.symbol, a.config_id, a.n_trades, b.n_trades AS later_trades, {r6('a.win_rate', 'a.profit_factor')}, round(b.win_rate, 6) AS later_win_rate, round(b.profit_factor, 6) AS later_profit_factor, a.profit_factor > 1 AND b.profit_factor > 1 AS both_profitable FROM summary a JOIN summary_late b USING (symbol, config_id) WHERE a.n_trades >= 60 AND b.n_trades >= 20", True))
def exit_study(spark, d):
    """Exits that trade enough in the whole period and in its second half: what they made in both."""
    g, bars = sim.grid(spark, **{k: list(map(float, v)) for k, v in _EXITS.items()}), stored(hourly(spark, d))
    keys = ["symbol", "config_id"]
    return research.exit_study(sim.summary(sim.run_grid(bars, g), keys), sim.summary(sim.run_grid(bars, g, since="2024-01-15"), keys), 60, 20)


_RATE = (2.0, 4.5)


@query("gated_grid", sql(_TRADES + f", ok AS (SELECT symbol, config_id FROM sig JOIN cut USING (symbol) GROUP BY symbol, config_id HAVING (sum(buy::INT) + sum(sell::INT)) / max(n_days) BETWEEN {_RATE[0]} AND {_RATE[1]})", f"SELECT {_SUMMARY} FROM summary SEMI JOIN ok USING (symbol, config_id) WHERE n_trades >= 40 AND trades_per_day BETWEEN 1.0 AND 4.0", True))
def gated_grid(spark, d):
    """Keys with too few or too many signals a day are pruned before they are simulated, results by trades afterwards."""
    trades = sim.run_grid(hourly(spark, d), small_grid(spark), _RATE)
    return sim.qualified(sim.summary(trades, ["symbol", "config_id"]), 40, (1.0, 4.0))


@query("search_correlation", SQL["search_correlation"])
def search_correlation(spark, d):
    """Rank correlation of the configurations' results in the whole period and in its second half."""
    g = small_grid(spark)
    whole = sim.summary(sim.run_grid(hourly(spark, d), g), ["symbol", "config_id"])
    late = sim.summary(sim.run_grid(hourly(spark, d), g, since="2024-01-15"), ["symbol", "config_id"])
    return research.search_correlation(whole, late)


@query("alert_rows", SQL["alert_rows"])
def alert_rows(spark, d):
    """Alerts as JSON, read back."""
    scored = live.scored(series(spark, d).where("logret is not null"), lambda df: df.withColumn("probability", N.sigmoid(F.col("logret") * 20)), 0.7, 0.3)
    body = F.from_json("body", "symbol string, timestamp string, action string, probability double, close_price double, horizon_bars long")
    return sinks.alerts(scored).select(body.alias("b")).select("b.symbol", "b.timestamp", "b.action", "b.probability", F.round("b.close_price", 4).alias("close_price"), "b.horizon_bars")


@query("strategy_returns", sql(_TRADES + ", c AS (SELECT config_id, count(*) AS n FROM trades GROUP BY config_id HAVING count(*) >= 200), m AS (SELECT min(n) AS shortest FROM c)", "SELECT config_id AS strategy_id, obs_no, round(pnl, 6) + 0.0 AS ret FROM (SELECT config_id, pnl, row_number() OVER (PARTITION BY config_id ORDER BY symbol, entry_idx) - 1 AS obs_no FROM trades SEMI JOIN c USING (config_id)), m WHERE obs_no < shortest", True))
def strategy_returns(spark, d):
    return sim.return_matrix(stored(grid_trades(spark, d)), 200)


@query("deflated_sharpe")
def deflated_sharpe(spark, d):
    """Of each symbol's hourly returns taken as trials of one search."""
    return stats.deflated_table(series(spark, d).where("logret is not null"), "logret", ["symbol"])


# --- regimes ---------------------------------------------------------------------------------------


@query("regime_report")
def regime_report(spark, d):
    from tideline.plans.catalog import regime_fits

    return regime.report_rows(regime.best_of(regime_fits(spark, d)[1]))


@query("regime_hourly")
def regime_hourly(spark, d):
    """A day's regime on the next day's bars, both of the orders' tape."""
    from tideline.plans.catalog import regime_fits
    from tideline.operators import bars

    rows, fits = regime_fits(spark, d)
    decoded = regime.decode_each(rows.select("symbol", "ts", "ret_3", "vol_14"), ["ret_3", "vol_14"], regime.best_of(fits))
    six = bars.time_bars(readers.order_tape(readers.table(spark, d, "orders")), "6 hours").select("symbol", "ts", "close")
    return regime.on_hourly(six, decoded)


@query("regime_agreement")
def regime_agreement(spark, d):
    """How often the filtered state is the one that hindsight gives."""
    from tideline.plans.catalog import regime_fits

    rows, fits = regime_fits(spark, d)
    decoded = regime.decode_each(rows.select("symbol", "ts", "ret_3", "vol_14"), ["ret_3", "vol_14"], regime.best_of(fits), hindsight=True)
    return decoded.groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("filtered_state") == F.col("smoothed_state")).cast("double")).alias("agreement"))


# --- models ----------------------------------------------------------------------------------------

_F = ["logret_1", "logret_5", "logret_20", "vol_10", "vol_50", "bb_pos", "hl_range_pct", "vol_z_50"]


def learnt(spark, d) -> DataFrame:
    df = labels.direction(indicators.window_features(positioned(spark, d)), (5,)).where("label_dir_5 is not null")
    return stored(df.select("symbol", "ts", "pos", "label_dir_5", *_F))


@query("frozen_holdout")
def frozen_holdout(spark, d):
    """Trained before a date with early stopping on its own last part; the rest is looked at once."""
    return models.frozen_holdout(learnt(spark, d), _F, "label_dir_5", "2024-01-22", seeds=[0, 1], iterations=10, depth=3)


@query("feature_importances")
def feature_importances(spark, d):
    fitted = models.fit_seeds(learnt(spark, d).where("ts < timestamp_ntz'2024-01-22'"), _F, "label_dir_5", [0, 1], iterations=5, depth=3)
    return spark.createDataFrame(models.importances(fitted, _F), "feature string, importance double")


@query("ablation")
def ablation(spark, d):
    df = learnt(spark, d)
    folds = splits.walk_forward(df.select("symbol", "pos"), splits.growing_folds_of(df, "symbol", 2), 5, "symbol")
    return research.ablation(df, folds, {"all": _F, "returns": _F[:3], "volatility": _F[3:5]}, "label_dir_5", on=("symbol", "pos"), iterations=4, depth=3)


@query("model_saved", sql(HOURLY + ", l AS (SELECT symbol, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS f FROM hourly)", "SELECT count(*)::BIGINT AS n, 0e0 AS max_diff FROM l WHERE f IS NOT NULL"))
def model_saved(spark, d):
    """Models and their settings saved, loaded and applied: predictions are as before."""
    df, path = learnt(spark, d), place(spark, "models")
    fitted = models.fit_seeds(df, _F, "label_dir_5", [3], iterations=3, depth=3)
    models.save(fitted, path, spark, features=_F, label="label_dir_5")
    again, config = models.load(path, spark)
    keys = ["symbol", "pos"]
    both = models.predict(fitted, df, _F, "a").select(*keys, "a").join(models.predict(again, df, config["features"], "b").select(*keys, "b"), keys)
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"))


# --- streams ---------------------------------------------------------------------------------------


@query("live_bars", sql(TAPE + ", late AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM tape), h AS (SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, trade_id) AS close, sum(quantity) AS volume FROM tape GROUP BY ALL)", f"SELECT symbol, ts, {r6('open', 'high', 'low', 'close', 'volume')} FROM h, late WHERE ts + INTERVAL 1 HOUR <= mark"))
def live_bars(spark, d):
    """Bars of a stream of trades: those that the watermark has closed."""
    return live.run_once(live.closed_bars(live.trades(spark, d)), place(spark, "live")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("live_parity", sql(HOURLY + ", c AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in live.COLUMNS) + "]) AS col)", "SELECT col AS \"column\", 0e0 AS max_diff, 0::BIGINT AS null_mismatch, (SELECT count(*) FROM hourly WHERE ts >= TIMESTAMP '2024-01-20')::BIGINT AS n FROM c"))
def live_parity(spark, d):
    """The feature frame of a stream, from keyed state that a table filled before, against the batch frame: largest differences. The stream comes in three triggers and is stopped and started again after two."""
    bars = stored(hourly(spark, d))
    got = live_frame(spark, bars, place(spark, "parity"))
    batch = indicators.features(bars).join(live_part(bars).select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    diff = models.largest_difference(batch, got, live.COLUMNS, ["symbol", "ts"])
    return diff.crossJoin(F.broadcast(batch.join(got.select("symbol", "ts"), ["symbol", "ts"]).agg(F.count("*").alias("n"))))


def live_part(bars: DataFrame) -> DataFrame:
    return bars.where("ts >= timestamp_ntz'2024-01-20'")


def live_frame(spark, bars: DataFrame, path: str) -> DataFrame:
    """Live features of the bars from the 20th of January on: days 20 to 24 in two files, a stop, then the rest in two more."""
    before = bars.where("ts < timestamp_ntz'2024-01-20'")
    day = F.datediff("ts", F.lit("2024-01-20").cast("timestamp_ntz"))
    for run in (((0, 2), (2, 5)), ((5, 1_000_000),)):
        for first, end in run:
            live.add_bars(live_part(bars).where((day >= first) & (day < end)), f"{path}/bars")
        out = live.run_once(live.live_features(live.bars_in(spark, f"{path}/bars"), before), path)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("live_alerts", sql(HOURLY, "SELECT count(*)::BIGINT AS n, 0::BIGINT AS differing, true AS fired FROM hourly WHERE ts >= TIMESTAMP '2024-01-20'"))
def live_alerts(spark, d):
    """Bars of the live frame scored by a saved and loaded model, against the same model over the batch frame: actions that differ, and whether alerts were fired."""
    bars = stored(hourly(spark, d))
    frame = stored(labels.direction(indicators.features(bars), (5,)))
    path, columns = place(spark, "alerts"), [*_F, "rsi_14", "ema9_dist", "atr_pct_14"]
    past = frame.where("ts < timestamp_ntz'2024-01-20' and label_dir_5 is not null")
    models.save(models.fit_seeds(past, columns, "label_dir_5", [3], iterations=5, depth=3), f"{path}/model", spark, features=columns)
    fitted, config = models.load(f"{path}/model", spark)
    score = live.model_score(fitted, config["features"])
    got = live.scored(live_frame(spark, bars, path), score, 0.52, 0.48).select("symbol", "ts", F.col("action").alias("live"))
    want = live.scored(live_part(frame), score, 0.52, 0.48).select("symbol", "ts", F.col("action").alias("batch"))
    return got.join(want, ["symbol", "ts"]).agg(F.count("*").alias("n"), F.sum((F.col("live") != F.col("batch")).cast("long")).alias("differing"), F.bool_or(F.col("live") != "SKIP").alias("fired"))
