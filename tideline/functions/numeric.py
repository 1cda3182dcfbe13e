"""Column expressions with the conventions of research frames: missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: str = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


class Rolling:
    """Functions over the last rows of a series: null until a frame has enough values."""

    def __init__(self, key: str = "symbol", order: str = "ts"):
        self.over = ordered(key, order)

    def frame(self, w: int) -> WindowSpec:
        return self.over.rowsBetween(1 - w, 0)

    def gated(self, x: Column, w: int, value: Column, least: int | None = None) -> Column:
        return F.when(F.count(x).over(self.frame(w)) >= (w if least is None else least), value)

    def mean(self, x: Column, w: int, least: int | None = None) -> Column:
        return self.gated(x, w, F.avg(x).over(self.frame(w)), least)

    def std(self, x: Column, w: int, least: int | None = None) -> Column:
        return self.gated(x, w, F.stddev_samp(x).over(self.frame(w)), least)

    def sum(self, x: Column, w: int, least: int | None = None) -> Column:
        return self.gated(x, w, F.sum(x).over(self.frame(w)), least)

    def max(self, x: Column, w: int) -> Column:
        return self.gated(x, w, F.max(x).over(self.frame(w)))

    def min(self, x: Column, w: int) -> Column:
        return self.gated(x, w, F.min(x).over(self.frame(w)))

    def skew(self, x: Column, w: int) -> Column:
        n = F.count(x).over(self.frame(w)).cast("double")
        return self.gated(x, w, F.skewness(x).over(self.frame(w)) * F.sqrt(n * (n - 1)) / (n - 2))

    def kurt(self, x: Column, w: int) -> Column:
        n = F.count(x).over(self.frame(w)).cast("double")
        return self.gated(x, w, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(self.frame(w)) + 6))

    def zscore(self, x: Column, w: int) -> Column:
        return (x - self.mean(x, w)) / nullif0(self.std(x, w))

    def autocorr(self, x: Column, before: Column, w: int) -> Column:
        """Correlation of x with before, its value a row earlier, over the w - 1 pairs in the frame."""
        return self.gated(x, w, correlation(x, before, self.over.rowsBetween(2 - w, 0)))

    def lag(self, x: Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.over)

    def lead(self, x: Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.over)

    def diff(self, x: Column, k: int = 1) -> Column:
        return x - self.lag(x, k)

    def log_return(self, x: Column, k: int = 1) -> Column:
        before = self.lag(x, k)
        return F.when((x > 0) & (before > 0), F.log(x / before))

    def cumulative(self, x: Column) -> Column:
        return F.sum(x).over(self.over.rowsBetween(Window.unboundedPreceding, 0))

    def filled(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.over.rowsBetween(Window.unboundedPreceding, 0))

    def position(self) -> Column:
        return (F.row_number().over(self.over) - 1).cast("long")


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's, of pairs without nulls; null where a side is constant, for which F.corr is an error."""
    both = x.isNotNull() & y.isNotNull()
    placed = lambda c: c if over is None else c.over(over)
    spread = placed(F.stddev_pop(F.when(both, x))) * placed(F.stddev_pop(F.when(both, y)))
    return placed(F.covar_pop(x, y)) / nullif0(spread)


def nullif0(x: Column) -> Column:
    return F.when(x != 0, x)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clipped_below(x: Column, least: float = 0.0) -> Column:
    """Null stays null; greatest alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def centred(x: Column, middle: float) -> Column:
    """x as a share of its neutral value above or below it."""
    return (x - middle) / middle


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(values: list[Column]) -> Column:
    """Place (from 0) of the first largest."""
    a = F.array(*values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def bucket(probability: Column, high: float = 0.65, low: float = 0.35) -> Column:
    return F.when(probability >= high, "A").when(probability <= low, "E").when(probability.isNotNull(), "S")


def action(probability: Column, buy: Column | float, sell: Column | float) -> Column:
    return F.when(probability >= buy, "BUY").when(probability <= sell, "SELL").otherwise("SKIP")


def conviction(probability: Column) -> Column:
    return F.abs(probability - 0.5) * 2


def digitize(x: Column, edges: list[Column]) -> Column:
    """How many edges are at or below x."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
