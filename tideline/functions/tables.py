"""Table functions for SQL: FROM info_bars(TABLE(bars) PARTITION BY symbol ORDER BY (ts), 2000.0D).

Each keeps what it needs of a partition's rows in order: the open bar, or the events
of the last few bars. They are for queries in SQL; the DataFrame operators of the same
names run long series in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _needs(table: AnalyzeArgument, *names: str) -> None:
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE(...)")
    missing = [n for n in names if n not in table.dataType.fieldNames()]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def _made(**columns: T.DataType) -> AnalyzeResult:
    """A result's schema; analysis has no session, so no DDL."""
    return AnalyzeResult(T.StructType([T.StructField(n, t) for n, t in columns.items()]))


@udtf
class InfoBars:
    """Bars that close where the volume (or with 'dollar' close times volume) since the last close reaches threshold."""

    def __init__(self):
        self.bar, self.bar_id = None, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, threshold: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        _needs(table, "symbol", "ts", "open", "high", "low", "close", "volume")
        prices = dict.fromkeys(("open", "high", "low", "close", "volume", "measure"), T.DoubleType())
        return _made(symbol=table.dataType["symbol"].dataType, bar_id=T.LongType(), ts=table.dataType["ts"].dataType, **prices, n_source_bars=T.LongType())

    def eval(self, row, threshold: float, kind: str = "volume") -> Iterator[tuple]:
        m = (row["volume"] if kind == "volume" else row["close"] * row["volume"]) if row["volume"] is not None and row["close"] is not None else 0.0
        if self.bar is None:
            self.bar = [row["open"], row["high"], row["low"], row["close"], 0.0, 0.0, 0]
        b = self.bar
        b[1] = max((v for v in (b[1], row["high"]) if v is not None), default=None)
        b[2] = min((v for v in (b[2], row["low"]) if v is not None), default=None)
        b[3], b[4], b[5], b[6] = row["close"], b[4] + (row["volume"] or 0.0), b[5] + m, b[6] + 1
        if b[5] >= threshold:
            yield (row["symbol"], self.bar_id, row["ts"], *b)
            self.bar, self.bar_id = None, self.bar_id + 1

    def terminate(self) -> Iterator[tuple]:
        return iter(())


@udtf
class TripleBarrier:
    """Outcome of each signal (a row whose signal is Buy or Sell, in any case): the first bar of the next n whose high or low passes a barrier, or the last one's close.

    The barriers are as far away as twice atr_pct, at least floor_pct percent.
    """

    def __init__(self):
        self.open: list[list] = []  # symbol, pos, entry, long, width, bars seen

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument, floor_pct: AnalyzeArgument | None = None) -> AnalyzeResult:
        _needs(table, "symbol", "pos", "high", "low", "close", "signal", "atr_pct")
        return _made(symbol=table.dataType["symbol"].dataType, pos=T.LongType(), outcome=T.StringType(), ret=T.DoubleType(), label=T.LongType(), bars_to_exit=T.LongType())

    def eval(self, row, n: int, floor_pct: float = 1.0) -> Iterator[tuple]:
        left = []
        for e in self.open:
            symbol, pos, entry, long, width, seen = e
            e[5] = seen + 1
            above, below = row["high"] >= entry * (1 + width), row["low"] <= entry * (1 - width)
            won, lost = (above, below) if long else (below, above)
            if won or lost:
                outcome = "lower_ambiguous" if won and lost else "lower" if lost else "upper"
                yield self.told(symbol, pos, outcome, -width if lost else width, e[5])
            elif e[5] == n:
                yield self.told(symbol, pos, "time", row["close"] / entry - 1 if long else 1 - row["close"] / entry, n)
            else:
                left.append(e)
        self.open = left
        side = (row["signal"] or "").strip().lower()
        if side in ("buy", "sell"):
            self.open.append([row["symbol"], row["pos"], row["close"], side == "buy", max(2 * row["atr_pct"], floor_pct) / 100, 0])

    def terminate(self) -> Iterator[tuple]:
        for symbol, pos, *_ in self.open:
            yield self.told(symbol, pos, "no_data", None, None)

    @staticmethod
    def told(symbol: str, pos: int, outcome: str, ret: float | None, bars: int | None) -> tuple:
        return symbol, pos, outcome, ret, None if ret is None else int(ret > 0), bars


def register(spark: SparkSession) -> None:
    """The functions by their SQL names."""
    spark.udtf.register("info_bars", InfoBars)
    spark.udtf.register("triple_barrier", TripleBarrier)
