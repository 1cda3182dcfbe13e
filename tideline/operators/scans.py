"""Scans of long series in blocks of positions, so that no task holds a series.

halos() gives each block the rows before it that windows look back on.
affine_scan() runs exponential averages: a block is a map of (value, gap, count),
maps are composed in order, and each block is then run from its true start.
speculative_scan() runs recursions that don't compose: every block is run from
nothing, then from where the block before it ended, until no end changes any more.
Most recursions forget where they began: from the bar on where both runs of a block
agree, the first one stands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.shared import stored

#: Rows of a series in a block.
BLOCK = 4_096
#: Rounds of speculation that run in blocks; what still changes then is run in order.
ROUNDS = 8


def with_block(df: DataFrame, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(pos) / block))


def halos(df: DataFrame, halo: int, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """Rows by _block; the last halo rows before a block are in it too, marked by _halo, to be dropped after the windows."""
    own = F.floor(F.col(pos) / block)
    return df.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col(pos) + halo) / block)))).withColumn("_halo", F.col("_block") != own)


def without_halos(df: DataFrame) -> DataFrame:
    return df.where("not _halo").drop("_halo")


def _ddl(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]


# --- affine -----------------------------------------------------------------------------------------


def ewm_of(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def ewm_from(x: np.ndarray, alpha: float, least: int, y: float, gap: int, seen: int) -> np.ndarray:
    """An exponential average carried on from y, after gap missing values, seen values before. A long gap's weight is nothing."""
    lead = np.concatenate([[y], np.full(min(gap, int(800 / -np.log(max(1 - alpha, 1e-300))) + 1), np.nan)]) if seen else np.zeros(0)
    out = ewm_of(np.concatenate([lead, x]), alpha)[len(lead) :]
    return np.where(seen + np.cumsum(~np.isnan(x)) >= least, out, np.nan)


def ewm_map(x: np.ndarray, alpha: float) -> tuple[float, ...]:
    """What a block does to an average: (values, rows before the first, the first, how much of a change at the first is left at the end, the end if run from nothing, missing values at the end)."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return 0.0, float(len(x)), 0.0, 1.0, np.nan, float(len(x))
    kept = (1 - alpha) ** np.diff(at).astype(float)
    return float(len(at)), float(at[0]), float(x[at[0]]), float(np.prod(kept / (kept + alpha))), float(ewm_of(x, alpha)[-1]), float(len(x) - 1 - at[-1])


def composed(maps: np.ndarray, alpha: float) -> np.ndarray:
    """(value, gap, count) that each block starts with, from the maps of the blocks in order."""
    out = np.empty((len(maps), 3))
    y, gap, seen = np.nan, 0.0, 0.0
    for i, (n, before, first, left, end, trail) in enumerate(maps.tolist()):
        out[i] = y, gap, seen
        if not n:
            gap += trail
            continue
        if seen:
            w = (1 - alpha) ** (gap + before + 1)
            y = end + left * ((w * y + alpha * first) / (w + alpha) - first)
        else:
            y = end
        gap, seen = trail, seen + n
    return out


def affine_scan(df: DataFrame, averages: dict[str, tuple[str, float, int]], key: str = "symbol", pos: str = "pos") -> DataFrame:
    """df with exponential averages (out -> (value, alpha, least values)) over any number of blocks; df has _block and is read twice.

    A missing value carries an average on and lets its weight decay. Only the maps,
    a row a block, are gathered by key.
    """
    specs = list(averages.items())
    by = [key, "_block"]
    kind = df.schema[key].dataType.simpleString()
    used = list(dict.fromkeys(v for v, _, _ in averages.values()))

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        flat = [m for _, (v, a, _) in specs for m in ewm_map(pdf[v].to_numpy(float), a)]
        return pd.DataFrame({key: pdf[key].iloc[:1], "_block": pdf["_block"].iloc[:1], "m": [flat]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        m = np.array(pdf["m"].tolist()).reshape(len(pdf), len(specs), 6)
        states = np.concatenate([composed(m[:, i], a) for i, (_, (_, a, _)) in enumerate(specs)], axis=1)
        return pd.DataFrame({key: pdf[key], "_block": pdf["_block"], "s": states.tolist()})

    def run(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        s = np.array(start["s"].iloc[0], float).reshape(len(specs), 3)
        made = {out: ewm_from(pdf[v].to_numpy(float), a, least, s[i, 0], int(s[i, 1]), int(s[i, 2])) for i, (out, (v, a, least)) in enumerate(specs)}
        return pdf.assign(**{k: nulled(x) for k, x in made.items()})

    found = df.select(*by, pos, *used).groupBy(*by).applyInPandas(maps, f"`{key}` {kind}, _block long, m array<double>")
    starts = found.groupBy(key).applyInPandas(chain, f"`{key}` {kind}, _block long, s array<double>")
    return df.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(run, ", ".join([*_ddl(df), *[f"`{o}` double" for o in averages]]))


def nulled(x: np.ndarray) -> pd.Series:
    s = pd.Series(x)
    return s.astype("object").where(s.notna(), None).to_numpy() if s.isna().any() else x


# --- speculative --------------------------------------------------------------------------------------

#: (rows of a block in order, state it starts with or None) -> (new columns, states after each row)
Kernel = Callable[[pd.DataFrame, "np.ndarray | None"], tuple[dict[str, np.ndarray], np.ndarray]]


def agree_from(a: np.ndarray, b: np.ndarray) -> int:
    """The first row from which on two runs' states are the same; the number of rows if they never are."""
    same = np.all((a == b) | (np.isnan(a) & np.isnan(b)), axis=1)
    return int(len(same) - np.argmin(same[::-1])) if not same.all() else 0


def speculative_scan(df: DataFrame, kernel: Kernel, new: dict[str, str], key: str = "symbol", pos: str = "pos", rounds: int = ROUNDS, replayed: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """df with the columns that kernel makes of each key's rows in order; df has _block and is read once a round, so it should be a stored table, or source
    one with the same rows and what the kernel reads.

    A round runs those blocks anew whose start has changed. If after all rounds some
    still do (a recursion that never forgets), these keys are finished in order, one
    task a key, from their first such block on. replayed: a column with how many rows
    of its block had to be run again.
    """
    by = [key, "_block"]
    kind = df.schema[key].dataType.simpleString()
    state = f"`{key}` {kind}, _block long, s array<double>"

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(pos, kind="stable")

    def given(start: pd.DataFrame) -> np.ndarray | None:
        s = start["s"].iloc[0] if len(start) else None
        return None if s is None or not len(s) else np.array(s, float)

    def ended(pdf: pd.DataFrame, s: np.ndarray | None) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "_block": pdf["_block"].iloc[:1], "s": [kernel(pdf, s)[1][-1].tolist()]})

    source = df if source is None else source
    over = Window.partitionBy(key).orderBy("_block")  # a row a block
    ends = stored(source.groupBy(*by).applyInPandas(lambda pdf: ended(ordered(pdf), None), state).withColumn("_moved", F.lit(True)))
    for _ in range(rounds):
        changed = ends.select(*by, F.lag("s").over(over).alias("s"), F.lag("_moved").over(over).alias("_m")).where("_m").drop("_m")
        again = source.join(changed.select(*by), by, "left_semi").groupBy(*by).cogroup(changed.groupBy(*by)).applyInPandas(lambda pdf, s: ended(ordered(pdf), given(s)), state)
        ends = stored(ends.join(again.select(*by, F.col("s").alias("_new")), by, "left").select(*by, F.coalesce("_new", "s").alias("s"), (F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("s"))).alias("_moved")))
        if ends.where("_moved").isEmpty():
            break
    else:
        ends = stored(_in_order(source, ends, kernel, key, pos, state))
    starts = ends.select(*by, F.lag("s").over(Window.partitionBy(key).orderBy("_block")).alias("s"))

    def run(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        s = given(start)
        made, states = kernel(pdf, s)
        out = {k: nulled(np.asarray(made[k], float)) if t == "double" else made[k] for k, t in new.items()}
        if replayed:
            out[replayed] = 0 if s is None else agree_from(states, kernel(pdf, None)[1])
        return pdf.assign(**out)

    more = [f"`{k}` {t}" for k, t in new.items()] + ([f"`{replayed}` long"] if replayed else [])
    return df.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(run, ", ".join([*_ddl(df), *more]))


def _in_order(df: DataFrame, ends: DataFrame, kernel: Kernel, key: str, pos: str, state: str) -> DataFrame:
    """Ends of the blocks of keys that haven't settled, run one after the other."""
    by = [key, "_block"]
    over = Window.partitionBy(key).orderBy("_block")
    first = ends.select(*by, F.lag("s").over(over).alias("s"), F.lag("_moved").over(over).alias("_m")).where("_m").groupBy(key).agg(F.min_by("s", "_block").alias("_s"), F.min("_block").alias("_first"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = np.array(pdf["_s"].iloc[0], float), []
        for b, rows in pdf.sort_values(pos, kind="stable").groupby("_block", sort=True):
            s = kernel(rows, s)[1][-1]
            out.append((rows[key].iloc[0], b, s.tolist()))
        return pd.DataFrame(out, columns=[key, "_block", "s"])

    done = df.join(first, key).where("_block >= _first").groupBy(key).applyInPandas(finish, state)
    return ends.join(done.select(*by, F.col("s").alias("_new")), by, "left").select(*by, F.coalesce("_new", "s").alias("s"))
