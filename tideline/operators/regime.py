"""Regimes: Gaussian hidden Markov models with diagonal or full covariances, and their causal decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.align import asof_next_day

FLOOR = 1e-300


@dataclass
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    variances: np.ndarray  # a row of variances for each state, or a matrix for each
    loglik: float = float("-inf")

    @property
    def k(self) -> int:
        return len(self.start)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means[None]
        if self.variances.ndim == 3:
            solved = np.einsum("kij,nkj->nki", np.linalg.inv(self.variances), d)
            return -0.5 * (np.linalg.slogdet(2 * np.pi * self.variances)[1][None] + (d * solved).sum(axis=2))
        return -0.5 * (np.log(2 * np.pi * self.variances).sum(axis=1)[None] + (d * d / self.variances[None]).sum(axis=2))


def n_params(k: int, d: int, full: bool = False) -> int:
    return (k - 1) + k * (k - 1) + k * d + (k * d * (d + 1) // 2 if full else k * d)


def forward(model: Hmm, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered state probabilities and the log-likelihood; nothing of the future enters a row."""
    loge = model.log_emissions(x)
    top = loge.max(axis=1, keepdims=True)
    e = np.exp(loge - top)
    out, total = np.empty_like(e), 0.0
    guess = model.start
    for t in range(len(x)):
        guess = np.maximum(guess if t == 0 else out[t - 1] @ model.trans, FLOOR)
        joint = guess * e[t]
        s = joint.sum()
        out[t] = joint / s if s > 0 else guess / guess.sum()
        total += np.log(max(s, FLOOR)) + top[t, 0]
    return out, float(total)


def backward(model: Hmm, x: np.ndarray) -> np.ndarray:
    loge = model.log_emissions(x)
    e = np.exp(loge - loge.max(axis=1, keepdims=True))
    out = np.ones_like(e)
    for t in range(len(x) - 2, -1, -1):
        v = model.trans @ (e[t + 1] * out[t + 1])
        out[t] = v / max(v.sum(), FLOOR)
    return out


def smoothed(model: Hmm, x: np.ndarray) -> np.ndarray:
    """With hindsight: for reports only, never for a live row."""
    p = forward(model, x)[0] * backward(model, x)
    return p / np.maximum(p.sum(axis=1, keepdims=True), FLOOR)


def viterbi(model: Hmm, x: np.ndarray) -> np.ndarray:
    loge, lt = model.log_emissions(x), np.log(np.maximum(model.trans, FLOOR))
    score, back = np.log(np.maximum(model.start, FLOOR)) + loge[0], np.zeros((len(x), model.k), int)
    for t in range(1, len(x)):
        step = score[:, None] + lt
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + loge[t]
    path = [int(score.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def healthy(model: Hmm, x: np.ndarray, least: float = 0.01) -> bool:
    parts = (model.start, model.trans, model.means, model.variances)
    if not all(np.isfinite(p).all() for p in parts) or abs(model.trans.sum(axis=1) - 1).max() > 1e-3:
        return False
    return np.bincount(viterbi(model, x), minlength=model.k).min() >= least * len(x)


def fit(x: np.ndarray, k: int, seed: int, iterations: int = 500, tolerance: float = 1e-4, full: bool = False) -> Hmm:
    """Baum-Welch from k random rows as means."""
    rng = np.random.default_rng(seed)
    spread = np.tile(np.cov(x.T).reshape(x.shape[1], -1) + 1e-6 * np.eye(x.shape[1]), (k, 1, 1)) if full else np.tile(x.var(axis=0) + 1e-6, (k, 1))
    model = Hmm(np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), x[rng.choice(len(x), k, replace=False)].copy(), spread)
    model.trans /= model.trans.sum(axis=1, keepdims=True)
    before = -np.inf
    for _ in range(iterations):
        alpha, loglik = forward(model, x)
        beta = backward(model, x)
        gamma = alpha * beta
        gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), FLOOR)
        loge = model.log_emissions(x)
        e = np.exp(loge - loge.max(axis=1, keepdims=True))
        pair = alpha[:-1, :, None] * model.trans[None] * (e[1:] * beta[1:])[:, None, :]
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), FLOOR)
        weight = np.maximum(gamma.sum(axis=0), FLOOR)[:, None]
        means = gamma.T @ x / weight
        if full:
            d = x[:, None, :] - means[None]
            spread = np.einsum("nk,nki,nkj->kij", gamma, d, d) / weight[:, :, None] + 1e-8 * np.eye(x.shape[1])
        else:
            spread = np.maximum(gamma.T @ (x * x) / weight - means**2, 1e-8)
        model = Hmm(gamma[0], pair.sum(axis=0) / np.maximum(pair.sum(axis=(0, 2))[:, None], FLOOR), means, spread, loglik)
        if abs(loglik - before) < tolerance:
            break
        before = loglik
    return model


FITS = "k int, seed int, covariance string, healthy boolean, loglik double, test_loglik double, bic double, aic double, start array<double>, trans array<array<double>>, means array<array<double>>, variances array<array<array<double>>>"


def compare(rows: DataFrame, columns: list[str], ks: list[int], restarts: int = 3, test_share: float = 0.2, seed: int = 42, iterations: int = 200, covariances: tuple[str, ...] = ("diag",), key: str = "symbol") -> DataFrame:
    """(key, FITS) of each series, number of states, restart and kind of covariance, each in a task of its own. rows: daily series, each small enough for a task, ordered by ts."""
    spark = rows.sparkSession
    tasks = spark.createDataFrame([(k, seed + i, c) for k in ks for i in range(restarts) for c in covariances], "k int, seed int, covariance string")
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        k, full = int(first["k"]), first["covariance"] == "full"
        x = pdf.sort_values("ts", kind="stable")[columns].to_numpy(float)
        cut = int(len(x) * (1 - test_share))
        train, test = x[:cut], x[cut:]
        if len(train) < 2 * k:
            return pd.DataFrame(columns=[key, *[f.split()[0] for f in FITS.split(", ")]])
        m = fit(train, k, int(first["seed"]), iterations, full=full)
        p = n_params(k, train.shape[1], full)
        matrices = m.variances if full else [np.diag(v) for v in m.variances]
        return pd.DataFrame({key: [first[key]], "k": [k], "seed": [first["seed"]], "covariance": [first["covariance"]], "healthy": [healthy(m, train)], "loglik": [m.loglik], "test_loglik": [forward(m, test)[1] if len(test) else 0.0], "bic": [-2 * m.loglik + p * np.log(len(train))], "aic": [-2 * m.loglik + 2 * p], "start": [m.start.tolist()], "trans": [m.trans.tolist()], "means": [m.means.tolist()], "variances": [[np.asarray(v).tolist() for v in matrices]]})

    series = rows.select(key, "ts", *columns).dropna()
    return series.crossJoin(F.broadcast(tasks)).groupBy(key, "k", "seed", "covariance").applyInPandas(run, f"`{key}` {kind}, {FITS}")


def best_of(results: DataFrame, key: str = "symbol") -> DataFrame:
    """The healthy fit of least BIC of each series."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("bic", "k", "seed", "covariance"))
    return results.where("healthy").withColumn("_n", place).where("_n = 1").drop("_n")


def model_of(row) -> Hmm:
    """A model of a row of FITS."""
    matrices = np.array([[list(r) for r in m] for m in row["variances"]], float)
    spread = matrices if row["covariance"] == "full" else np.array([np.diag(m) for m in matrices])
    return Hmm(np.array(list(row["start"]), float), np.array([list(r) for r in row["trans"]], float), np.array([list(r) for r in row["means"]], float), spread, row["loglik"])


def labels(means: np.ndarray, spread: float | None = None) -> list[str]:
    """Names of states by mean return (first column) and volatility (second) against their medians."""
    ret, vol = means[:, 0], means[:, 1]
    mid, width = np.median(ret), np.median(vol)
    spread = float(ret.std()) if spread is None else spread
    # 0.15 and 1e-9 are fixed values.
    side = ["chop" if abs(r) < 0.15 * spread + 1e-9 else "bull" if r > mid else "bear" if r < mid else "flat" for r in ret]
    return [f"{s}_{'high' if v > width else 'low'}-vol" for s, v in zip(side, vol, strict=True)]


def report(model: Hmm) -> pd.DataFrame:
    """Means, deviations, expected stay and long-run share of each state."""
    values, vectors = np.linalg.eig(model.trans.T)
    share = np.real(vectors[:, np.argmin(abs(values - 1))])
    stay = np.diag(model.trans)
    return pd.DataFrame({"state": range(model.k), "mean": model.means.tolist(), "std": np.sqrt(model.variances if model.variances.ndim == 2 else np.array([np.diag(v) for v in model.variances])).tolist(), "duration": 1 / np.maximum(1 - stay, 1e-12), "stationary": share / share.sum()})


def report_rows(best: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, state, label, mean, std, transition, duration, stationary): report of each series' model, with its transition row."""
    kind = best.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                m = model_of(row)
                got = report(m)
                yield got.assign(**{key: row[key]}, label=labels(m.means), transition=m.trans.tolist())[[key, "state", "label", "mean", "std", "transition", "duration", "stationary"]]

    return best.mapInPandas(run, f"`{key}` {kind}, state int, label string, mean array<double>, std array<double>, transition array<double>, duration double, stationary double")


def decode_each(daily: DataFrame, columns: list[str], best: DataFrame, hindsight: bool = False, key: str = "symbol") -> DataFrame:
    """(key, ts, columns, filtered_probs, filtered_state, filtered_state_label[, smoothed_state]): each series by its own model. Rows with nulls in columns are left out."""
    rows = daily.select(key, "ts", *columns).dropna(subset=columns)
    more = "filtered_probs array<double>, filtered_state int, filtered_state_label string" + ", smoothed_state int" * hindsight
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], more])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*rows_columns, *[x.split()[0] for x in more.split(", ")]])
        m = model_of(b.iloc[0])
        a = a.sort_values("ts", kind="stable")
        x = a[columns].to_numpy(float)
        p, names = forward(m, x)[0], labels(m.means)
        state = p.argmax(axis=1)
        out = a.assign(filtered_probs=list(p), filtered_state=state, filtered_state_label=[names[s] for s in state])
        return out.assign(smoothed_state=smoothed(m, x).argmax(axis=1)) if hindsight else out

    rows_columns = rows.columns
    # Renamed, as both sides come from the same series.
    models = best.select(F.col(key).alias("_key"), *[f.split()[0] for f in FITS.split(", ")])
    return rows.groupBy(key).cogroup(models.groupBy("_key")).applyInPandas(run, schema)


def on_hourly(hourly: DataFrame, decoded: DataFrame) -> DataFrame:
    """A day's regime on hourly bars from the next midnight on."""
    values = [c for c in decoded.columns if c.startswith("filtered_")]
    return asof_next_day(hourly, decoded.withColumn("date", F.to_date("ts")), values)
