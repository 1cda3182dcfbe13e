"""Recursive scans. Each kernel is numpy over one series; per_symbol applies it to every symbol.

Long series run in blocks on many machines: operators.scans has exponential averages
as maps that compose, and the other recursions by speculation, for which the kernels
here can start from a state and give their states.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ewm(x: np.ndarray, alpha: float, least: int = 1) -> np.ndarray:
    """y0 = x0, y = a x + (1 - a) y; a missing value carries y on and lets the past's weight decay; null until least values."""
    keep, y, weight, seen = 1.0 - alpha, np.nan, 1.0, 0
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        if v == v:
            y = v if seen == 0 else (weight * keep * y + alpha * v) / (weight * keep + alpha)
            weight, seen = 1.0, seen + 1
        else:
            weight *= keep
        if seen >= least:
            out[i] = y
    return out


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def wilder(x: np.ndarray, n: int, gated: bool = True) -> np.ndarray:
    return ewm(x, 1.0 / n, n if gated else 1)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


def rsi(close: np.ndarray, n: int, zero_loss: str = "neutral") -> np.ndarray:
    """zero_loss: 'neutral' gives 50 where there was no loss (and before there is an average), 'pine' the script's rs = 100."""
    move = np.diff(close, prepend=np.nan)
    up, down = (np.where(np.isnan(move), np.nan, np.maximum(s * move, 0)) for s in (1, -1))
    gain, loss = wilder(up, n), wilder(down, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = gain / np.where(loss == 0, np.nan, loss)
        if zero_loss == "pine":
            strength = np.where(loss == 0, 100.0, strength)
        value = 100 - 100 / (1 + strength)
    return np.where(np.isnan(value), 50.0, value)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(adx, +di, -di); missing values are 0."""
    rise, fall = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        plus, minus = np.where((rise > fall) & (rise > 0), rise, 0.0), np.where((fall > rise) & (fall > 0), fall, 0.0)
        width = wilder(true_range(high, low, close), n)
        width = np.where(width == 0, np.nan, width)
        di = [100 * wilder(m, n) / width for m in (plus, minus)]
        total = di[0] + di[1]
        dx = 100 * np.abs(di[0] - di[1]) / np.where(total == 0, np.nan, total)
        strength = wilder(np.where(np.isnan(dx), 0.0, dx), n)
    return tuple(np.nan_to_num(v) for v in (strength, *di))


def supertrend_bands(high, low, close, width, factor: float = 3.0, state=None) -> tuple[np.ndarray, np.ndarray]:
    """(trend, line), first kind: two ratcheted bands and a flag; bands loosen only after a close beyond them."""
    return bands_run(high, low, close, width, factor, state)[:2]


def bands_run(high, low, close, width, factor: float = 3.0, state=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """supertrend_bands from a state (top, bottom, side, last close), and the states after each row."""
    middle = (high + low) / 2
    up, down = (middle + factor * width).tolist(), (middle - factor * width).tolist()
    c, n = close.tolist(), len(close)
    trend, line, states = np.ones(n), np.full(n, np.nan), np.empty((n, 4))
    top, bottom, side, last = (float("nan"), float("nan"), 1, None) if state is None else (*state[:2], int(state[2]), state[3])
    for i in range(n):
        if last is None or top != top:
            top, bottom = up[i], down[i]
        else:
            was_top, was_bottom = top, bottom
            top = up[i] if up[i] < was_top or last > was_top else was_top
            bottom = down[i] if down[i] > was_bottom or last < was_bottom else was_bottom
        if side == 1 and c[i] < bottom:
            side = -1
        elif side == -1 and c[i] > top:
            side = 1
        last = c[i]
        trend[i], line[i] = side, bottom if side == 1 else top
        states[i] = top, bottom, side, last
    return trend, line, states


def supertrend_line(high, low, close, n: int = 10, factor: float = 3.0) -> np.ndarray:
    """Second kind: one line, its side chosen by the last close against the last line."""
    return line_run(high, low, close, wilder(true_range(high, low, close), n, gated=False), factor)[0]


def line_run(high, low, close, width, factor: float = 3.0, state=None) -> tuple[np.ndarray, np.ndarray]:
    """supertrend_line from a state (line, side, last close), and the states after each row."""
    middle = (high + low) / 2
    up, down = (middle + factor * width).tolist(), (middle - factor * width).tolist()
    out, states = np.empty(len(close)), np.empty((len(close), 3))
    line, side, before = (None, 1, None) if state is None else (state[0], int(state[1]), state[2])
    for i, now in enumerate(close.tolist()):
        if line is None:
            line = down[i]
        else:
            above = before > line
            last = line
            line = (max(down[i], last) if side == 1 else down[i]) if above else (min(up[i], last) if side == -1 else up[i])
            side = (1 if now > line else -1) if above else (-1 if now < line else 1)
        before, out[i] = now, line
        states[i] = line, side, now
    return out, states


def supertrend_switch(high, low, close, n: int = 10, factor: float = 3.0) -> np.ndarray:
    """Third kind: both bands are ratcheted against one line, and a close beyond the held one switches."""
    return switch_run(high, low, close, wilder(true_range(high, low, close), n, gated=False), factor)[0]


def switch_run(high, low, close, width, factor: float = 3.0, state=None) -> tuple[np.ndarray, np.ndarray]:
    """supertrend_switch from a state (line, rising, last close), and the states after each row."""
    middle = (high + low) / 2
    up, down = (middle + factor * width).tolist(), (middle - factor * width).tolist()
    out, states = np.empty(len(close)), np.empty((len(close), 3))
    line, rising, before = (None, True, None) if state is None else (state[0], state[1] > 0, state[2])
    for i, now in enumerate(close.tolist()):
        u, d = up[i], down[i]
        if line is None:
            line = d
        else:
            roof, floor = (u if u < line or before > line else line), (d if d > line or before < line else line)
            rising = now >= floor if rising else now > roof
            line = floor if rising else roof
        before, out[i] = now, line
        states[i] = line, float(rising), now
    return out, states


def cusum_events(x: np.ndarray, threshold: np.ndarray | float) -> np.ndarray:
    """Flags of a symmetric CUSUM over differences; the falling side is looked at first and only the side that fires starts anew."""
    return cusum_run(x, threshold)[0]


def cusum_run(x: np.ndarray, threshold: np.ndarray | float, state=None) -> tuple[np.ndarray, np.ndarray]:
    """cusum_events from a state (up, down, last value), and the states after each row."""
    bars = np.broadcast_to(np.asarray(threshold, float), x.shape).tolist()
    up, down, last = (0.0, 0.0, np.nan) if state is None else state
    out, states = np.zeros(len(x), bool), np.empty((len(x), 3))
    steps = np.diff(x, prepend=last).tolist()
    for i, (step, h, now) in enumerate(zip(steps, bars, x.tolist(), strict=True)):
        if step == step:
            up, down = max(0.0, up + step), min(0.0, down + step)
            if h > 0:
                if down < -h:
                    down, out[i] = 0.0, True
                elif up > h:
                    up, out[i] = 0.0, True
        states[i] = up, down, now
    return out, states


def fill_run(values: np.ndarray, threshold: float, state=None) -> tuple[np.ndarray, np.ndarray]:
    """Where a sum since the last close reaches threshold and starts from nothing; and the sums (as states) after each row. A missing value is nothing."""
    out, states = np.zeros(len(values), bool), np.empty((len(values), 1))
    total = 0.0 if state is None else float(state[0])
    for i, v in enumerate(np.nan_to_num(values).tolist()):
        total += v
        if total >= threshold:
            out[i], total = True, 0.0
        states[i] = total
    return out, states


def per_symbol(df: DataFrame, kernel: Callable[[pd.DataFrame], dict[str, np.ndarray]], new: dict[str, str], key: str | list[str] = "symbol", order: str = "ts") -> DataFrame:
    """df with the columns that kernel makes of each key's rows in order; NaN leaves as null. All kernels of a query go in one call: one hop to Python."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new]
    kept = [f.name for f in df.schema.fields if f.name not in new]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        made = kernel(pdf)
        out = pdf[kept].copy()
        for name, kind in new.items():
            values = pd.Series(np.asarray(made[name]))
            if kind in ("double", "float"):
                values = values.astype("object").where(values.notna(), None) if values.isna().any() else values
            out[name] = values
        return out

    return df.groupBy(key).applyInPandas(run, ", ".join([*fields, *[f"`{n}` {k}" for n, k in new.items()]]))
