"""The live twin: closed bars from a stream of trades, keyed recursive state, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.numeric import action, sigmoid
from tideline.operators import models
from tideline.sources import readers
from tideline.sources.sinks import alerts, post_each
from tideline.streaming import frame


def closed_bars(trades: DataFrame, late: str = "10 minutes", unit: str = "1 hour") -> DataFrame:
    """Bars of windows that the watermark has passed; append mode emits each once. NTZ times are cast, as watermarks need TIMESTAMP."""
    t = trades.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    t = t.dropDuplicatesWithinWatermark(["symbol", "trade_id"])
    order = F.struct("at", "trade_id")
    bars = t.groupBy("symbol", F.window("at", unit).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def trades(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of trades."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return readers.tape(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"))


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table; a second run goes on where this one stopped."""
    with declared_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


COLUMNS = frame.names()
FEATURES = "symbol string, ts timestamp, close double, " + ", ".join(f"`{c}` double" for c in COLUMNS)


def add_bars(bars: DataFrame, path: str) -> None:
    """Bars appended to a folder that a stream reads, as one file."""
    bars.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def bars_in(spark: SparkSession, path: str) -> DataFrame:
    """A folder of bars as a stream, a file a trigger."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


@contextmanager
def declared_state(spark: SparkSession) -> Iterator[None]:
    """Declared state variables need the RocksDB store; a query keeps what is set when it starts."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class FrameState(StatefulProcessor):
    """A symbol's state: one row of numbers, and a list of its last bars."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "v array<double>")
        self.bars = handle.getListState("bars", "v array<double>")

    def held(self) -> frame.Frame:
        if not self.numbers.exists():
            return frame.Frame()
        return frame.Frame.taken_up(list(self.numbers.get()[0]), np.array([list(r[0]) for r in self.bars.get()], float).reshape(-1, 6))

    def keep(self, held: frame.Frame) -> None:
        self.numbers.update((held.numbers(),))
        self.bars.put([(r,) for r in held.rows().tolist()])

    def pushed(self, held: frame.Frame, rows: pd.DataFrame, key: str) -> pd.DataFrame:
        out = []
        for r in rows.sort_values("ts").itertuples():
            got = held.push(r.ts.to_pydatetime(), float(r.high), float(r.low), float(r.close), float(r.volume))
            if got is not None:
                out.append((key, r.ts, float(r.close), *[got[c] for c in COLUMNS]))
        return pd.DataFrame(out, columns=["symbol", "ts", "close", *COLUMNS])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held = self.held()
        for r in initialState.sort_values("ts").itertuples():
            held.push(r.ts.to_pydatetime(), float(r.high), float(r.low), float(r.close), float(r.volume))
        self.keep(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        made = self.pushed(held, pd.concat(list(rows)), key[0])  # a trigger's rows
        self.keep(held)
        yield made

    def close(self) -> None:
        pass


def live_features(bars: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The whole feature frame of a stream of closed bars (symbol, ts, high, low, close, volume), from declared keyed state.

    history: a table of bars before the stream, from which each symbol's state is
    filled before its first live bar is looked at; it must reach back as far as the
    recursions are to agree with a batch, KEEP bars at least. A query that is started
    again goes on from its state and doesn't read it anew. A bar that is not after
    the last one of its symbol is left out, so each counts once. Start the query
    within declared_state.
    """
    columns = ["symbol", "ts", "high", "low", "close", "volume"]
    before = None if history is None else history.select("symbol", F.col("ts").cast("timestamp").alias("ts"), *columns[2:]).groupBy("symbol")
    return bars.select(*columns).groupBy("symbol").transformWithStateInPandas(FrameState(), FEATURES, "Append", "None", before)


def slope(features: DataFrame) -> DataFrame:
    """A transparent stand-in for a model: the slope of the averages against the range, from columns of the frame."""
    gap = F.col("ema21_dist") - F.col("ema9_dist")  # (ema9 - ema21) / close
    return features.withColumn("probability", sigmoid(gap / F.col("atr_pct_14")))


def model_score(fitted: list, columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Scoring by loaded models (models.load) over columns of the frame."""
    return lambda features: models.predict(fitted, features, columns, "_score").withColumnRenamed("_score", "probability")


def scored(features: DataFrame, score: Callable[[DataFrame], DataFrame] = slope, buy: float = 0.6, sell: float = 0.4) -> DataFrame:
    """features with probability and action."""
    return score(features).withColumn("action", action(F.col("probability"), buy, sell))


def run_alerts(features: DataFrame, send: Callable[[str], None], checkpoint: str, once: bool = True, score: Callable[[DataFrame], DataFrame] = slope, buy: float = 0.6, sell: float = 0.4) -> StreamingQuery:
    """Scores each batch of the live frame and sends its alerts; the checkpoint remembers what has been sent."""
    deliver = post_each(send)
    writer = features.writeStream.foreachBatch(lambda df, i: deliver(alerts(scored(df, score, buy, sell)), i)).option("checkpointLocation", checkpoint).outputMode("append")
    with declared_state(features.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()
