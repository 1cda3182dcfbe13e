"""The feature frame bar by bar: what a keyed state holds, and what it gives for each closed bar.

Recursive indicators are kept as numbers, windows as the last KEEP bars in a ring of
arrays; nothing grows with the length of the stream, and all of it can be put down as
plain numbers (Frame.numbers, Frame.rows) and taken up again. The batch frame
(operators.indicators) is the definition; a registered query compares both.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np

from tideline.operators.indicators import EMAS, RETURNS, VOLS
from tideline.operators.recursions import span_alpha

#: Bars that the longest window looks back on.
KEEP = 220
HTF = ("ema20_dist", "atr_pct", "rsi14", "logret5")
NAN = float("nan")


class Ewm:
    """One exponential average: a missing value carries it on and lets its weight decay."""

    def __init__(self, alpha: float, least: int = 1):
        self.alpha, self.least, self.y, self.weight, self.seen = alpha, least, NAN, 1.0, 0

    def push(self, v: float) -> float:
        keep = 1.0 - self.alpha
        if v == v:
            self.y = v if self.seen == 0 else (self.weight * keep * self.y + self.alpha * v) / (self.weight * keep + self.alpha)
            self.weight, self.seen = 1.0, self.seen + 1
        else:
            self.weight *= keep
        return self.y if self.seen >= self.least else NAN

    def dump(self) -> list[float]:
        return [self.y, self.weight, float(self.seen)]

    def load(self, take: Callable[[int], list[float]]) -> None:
        self.y, self.weight, seen = take(3)
        self.seen = int(seen)


def dump_last(values: deque) -> list[float]:
    """A short deque, oldest first, behind its length and filled up to its limit."""
    return [float(len(values)), *values, *[NAN] * (values.maxlen - len(values))]


def load_last(values: deque, take: Callable[[int], list[float]]) -> None:
    n = int(take(1)[0])
    values.clear()
    values.extend(take(values.maxlen)[:n])


class Strength:
    """RSI and average true range of a series that may have gaps."""

    def __init__(self, n: int = 14):
        self.gain, self.loss, self.width, self.close = Ewm(1 / n, n), Ewm(1 / n, n), Ewm(1 / n, n), NAN

    def push(self, high: float, low: float, close: float) -> tuple[float, float]:
        move = close - self.close
        gain, loss = (self.gain.push(max(move, 0.0)), self.loss.push(max(-move, 0.0))) if move == move else (self.gain.push(NAN), self.loss.push(NAN))
        with np.errstate(invalid="ignore"):
            width = self.width.push(float(np.fmax(np.fmax(high - low, abs(high - self.close)), abs(low - self.close))))
        self.close = close
        rsi = 100 - 100 / (1 + gain / loss) if gain == gain and loss == loss and loss != 0 else 50.0
        return rsi, width

    def dump(self) -> list[float]:
        return [*self.gain.dump(), *self.loss.dump(), *self.width.dump(), self.close]

    def load(self, take: Callable[[int], list[float]]) -> None:
        for average in (self.gain, self.loss, self.width):
            average.load(take)
        (self.close,) = take(1)


class Coarse:
    """Features of the last completed bar of a coarser frame, on a grid without gaps."""

    def __init__(self, hours: int):
        self.hours, self.bin, self.bar, self.made = hours, None, None, (NAN,) * 4
        self.average, self.strength, self.closes = Ewm(span_alpha(20)), Strength(), deque(maxlen=6)

    def floor(self, ts: datetime) -> datetime:
        day = ts.replace(hour=0, minute=0, second=0, microsecond=0)
        return day + timedelta(hours=ts.hour // self.hours * self.hours)

    def complete(self, high: float, low: float, close: float) -> None:
        average, (rsi, width) = self.average.push(close), self.strength.push(high, low, close)
        self.closes.append(close)
        before = self.closes[0] if len(self.closes) == 6 else NAN
        move = float(np.log(close / before)) if close > 0 and before > 0 else NAN
        self.made = ((close - average) / close, width / close, rsi, move)

    def push(self, ts: datetime, high: float, low: float, close: float) -> tuple[float, ...]:
        at = self.floor(ts)
        if self.bin is None:
            self.bin, self.bar = at, [high, low, close]
        elif at == self.bin:
            self.bar = [max(self.bar[0], high), min(self.bar[1], low), close]
        else:
            self.complete(*self.bar)
            step = timedelta(hours=self.hours)
            gap = self.bin + step
            while gap < at:  # bins without bars count, without prices
                self.complete(NAN, NAN, NAN)
                gap += step
            self.bin, self.bar = at, [high, low, close]
        return self.made

    def dump(self) -> list[float]:
        bin_ = NAN if self.bin is None else seconds(self.bin)
        return [bin_, *(self.bar or (NAN,) * 3), *self.made, *self.average.dump(), *self.strength.dump(), *dump_last(self.closes)]

    def load(self, take: Callable[[int], list[float]]) -> None:
        bin_, *bar = take(4)
        self.bin, self.bar = (None, None) if bin_ != bin_ else (moment(bin_), bar)
        self.made = tuple(take(4))
        self.average.load(take)
        self.strength.load(take)
        load_last(self.closes, take)


EPOCH = datetime(1970, 1, 1)


def seconds(ts: datetime) -> float:
    return (ts - EPOCH) / timedelta(seconds=1)


def moment(at: float) -> datetime:
    return EPOCH + timedelta(seconds=at)


def std(x: np.ndarray) -> float:
    return float(np.std(x, ddof=1))


class Frame:
    """Keyed state of one symbol."""

    def __init__(self):
        self.n, self.last, self.obv = 0, None, 0.0
        self.ring, self.end = np.empty((6, 2 * KEEP)), 0  # high, low, close, volume, log return, obv
        self.emas = {s: Ewm(span_alpha(s)) for s in EMAS}
        self.ema_values: deque = deque(maxlen=6)
        self.strength, self.plus, self.minus, self.dx = Strength(), Ewm(1 / 14, 14), Ewm(1 / 14, 14), Ewm(1 / 14, 14)
        self.top = self.bottom = NAN
        self.side = 1
        self.rsis, self.raws, self.ks = deque(maxlen=14), deque(maxlen=3), deque(maxlen=3)
        self.coarse = {"4h": Coarse(4), "1d": Coarse(24)}

    def numbers(self) -> list[float]:
        """The state without its bars."""
        return [float(self.n), NAN if self.last is None else seconds(self.last), self.obv, self.top, self.bottom, float(self.side), *[v for e in self.emas.values() for v in e.dump()], *self.strength.dump(), *self.plus.dump(), *self.minus.dump(), *self.dx.dump(), *dump_last(self.rsis), *dump_last(self.raws), *dump_last(self.ks), float(len(self.ema_values)), *[v for e in self.ema_values for v in e.values()], *[v for c in self.coarse.values() for v in c.dump()]]

    def rows(self) -> np.ndarray:
        """The last bars, oldest first, a row each."""
        return self.ring[:, max(0, self.end - KEEP) : self.end].T

    @classmethod
    def taken_up(cls, numbers: list[float], rows: np.ndarray) -> Frame:
        out, at = cls(), 0

        def take(k: int) -> list[float]:
            nonlocal at
            at += k
            return list(numbers[at - k : at])

        n, last, out.obv, out.top, out.bottom, side = take(6)
        out.n, out.side, out.last = int(n), int(side), None if last != last else moment(last)
        for e in (*out.emas.values(), out.strength, out.plus, out.minus, out.dx):
            e.load(take)
        for values in (out.rsis, out.raws, out.ks):
            load_last(values, take)
        for _ in range(int(take(1)[0])):
            out.ema_values.append(dict(zip(out.emas, take(len(out.emas)), strict=True)))
        for c in out.coarse.values():
            c.load(take)
        out.end = len(rows)
        out.ring[:, : out.end] = np.asarray(rows, float).reshape(-1, 6).T
        return out

    def add(self, *values: float) -> np.ndarray:
        """One more bar in the ring; the last KEEP bars, a row for each kind."""
        if self.end == 2 * KEEP:
            self.ring[:, :KEEP] = self.ring[:, KEEP:]
            self.end = KEEP
        self.ring[:, self.end] = values
        self.end += 1
        return self.ring[:, max(0, self.end - KEEP) : self.end]

    def push(self, ts: datetime, high: float, low: float, close: float, volume: float) -> dict[str, float] | None:
        """The features of a new bar; None for one that is not after the last: each bar counts once."""
        if self.last is not None and ts <= self.last:
            return None
        before = self.ring[:, self.end - 1].tolist() if self.end else None
        out: dict[str, float] = {}

        def gated(name: str, x: np.ndarray, w: int, f) -> None:
            part = x[-w:]
            out[name] = float(f(part)) if len(part) == w and not np.isnan(part).any() else NAN

        # Recursions.
        ema = {s: e.push(close) for s, e in self.emas.items()}
        rise, fall = (high - before[0], before[1] - low) if before else (NAN, NAN)
        rsi, width = self.strength.push(high, low, close)
        plus, minus = self.plus.push(rise if rise > fall and rise > 0 else 0.0), self.minus.push(fall if fall > rise and fall > 0 else 0.0)
        usable = width if width == width and width != 0 else NAN
        up, down = 100 * plus / usable, 100 * minus / usable
        total = up + down
        dx = 100 * abs(up - down) / total if total == total and total != 0 else 0.0
        adx = self.dx.push(dx)
        zero = lambda v: v if v == v else 0.0
        high_band, low_band = (high + low) / 2 + 3.0 * width, (high + low) / 2 - 3.0 * width
        if self.n == 0 or self.top != self.top:
            self.top, self.bottom = high_band, low_band
        else:
            top, bottom = self.top, self.bottom
            self.top = high_band if high_band < top or before[2] > top else top
            self.bottom = low_band if low_band > bottom or before[2] < bottom else bottom
        if self.side == 1 and close < self.bottom:
            self.side = -1
        elif self.side == -1 and close > self.top:
            self.side = 1
        line = self.bottom if self.side == 1 else self.top
        self.rsis.append(rsi)
        low_rsi, high_rsi = min(self.rsis), max(self.rsis)
        self.raws.append((rsi - low_rsi) / (high_rsi - low_rsi) * 100 if len(self.rsis) == 14 and high_rsi != low_rsi else 0.0)
        k = sum(self.raws) / 3 if len(self.raws) == 3 else NAN
        self.ks.append(k)
        d = sum(self.ks) / 3 if len(self.ks) == 3 else NAN
        self.ema_values.append(ema)
        earlier = self.ema_values[0] if len(self.ema_values) == 6 else None
        out |= {"rsi_14": rsi, "adx_14": zero(adx), "plus_di_14": zero(up), "minus_di_14": zero(down), "supertrend_trend": float(self.side), "stochrsi_k": k, "stochrsi_d": d, "stochrsi_k_minus_d": k - d, "di_diff": zero(up) - zero(down), "atr_pct_14": width / close, "keltner_pos": (close - ema[20]) / (4 * width) if width else NAN, "supertrend_dist": (close - line) / close}
        out |= {f"ema{s}_dist": (close - ema[s]) / close for s in (9, 21, 50, 200)}
        out |= {f"ema{s}_slope_5": (ema[s] - earlier[s]) / earlier[s] if earlier else NAN for s in (9, 21, 50)}
        # Windows.
        move = float(np.log(close / before[2])) if before and close > 0 and before[2] > 0 else NAN
        self.obv += float(np.sign(close - before[2])) * volume if before else 0.0
        highs, lows, closes, volumes, moves, obvs = self.add(high, low, close, volume, move, self.obv)
        for n in RETURNS:
            past = closes[-1 - n] if len(closes) > n else NAN
            out[f"logret_{n}"] = float(np.log(close / past)) if past > 0 and close > 0 else NAN
        for w in VOLS:
            gated(f"vol_{w}", moves, w, std)
        m = moves[-50:]
        if len(m) == 50 and not np.isnan(m).any():
            c = m - m.mean()
            s2, s3, s4, n = (c**2).mean(), (c**3).mean(), (c**4).mean(), 50.0
            out["skew_50"] = float(s3 / s2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)) if s2 > 0 else NAN
            out["kurt_50"] = float((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (s4 / s2**2 - 3) + 6)) if s2 > 0 else NAN
        else:
            out["skew_50"] = out["kurt_50"] = NAN
        share = lambda a, b: a / b if b == b and b != 0 else NAN
        gated("_mean", closes, 20, np.mean)
        gated("_std", closes, 20, std)
        out["bb_pos"], out["bb_width"] = share(close - out["_mean"], 4 * out["_std"]), 4 * out["_std"] / out["_mean"]
        gated("_v5", volumes, 5, np.mean)
        gated("_v50", volumes, 50, np.mean)
        gated("_s50", volumes, 50, std)
        out["vol_z_50"], out["vol_change_5"] = share(volume - out["_v50"], out["_s50"]), share(volume, out["_v5"]) - 1
        out["obv_slope_20"] = share(obvs[-1] - obvs[-21], out["_v50"]) if len(obvs) > 20 else NAN
        out["hl_range_pct"], out["close_pos_in_range"] = (high - low) / close, share(close - low, high - low)
        for w in (20, 50, 100):
            gated(f"dist_from_high_{w}", highs, w, lambda x: (close - x.max()) / close)
            gated(f"dist_from_low_{w}", lows, w, lambda x: (close - x.min()) / close)
        pairs = moves[-20:]
        good = len(pairs) == 20 and not np.isnan(pairs).any() and pairs[1:].std() > 0 and pairs[:-1].std() > 0
        out["autocorr_20"] = float(np.corrcoef(pairs[1:], pairs[:-1])[0, 1]) if good else NAN
        out["hour_of_day"], out["day_of_week"] = float(ts.hour), float(ts.weekday())
        for tag, frame in self.coarse.items():
            out |= {f"htf_{tag}_{n}": v for n, v in zip(HTF, frame.push(ts, high, low, close), strict=True)}
        self.n, self.last = self.n + 1, ts
        return {name: v for name, v in out.items() if name[0] != "_"}


def names() -> list[str]:
    """The features, as one bar gives them."""
    return list(Frame().push(datetime(2024, 1, 1), 2.0, 1.0, 1.5, 1.0))
