"""Kernels against plain loops and published properties."""

import numpy as np
import pandas as pd
import pytest

from tideline.operators import events, regime, sim, splits, stats
from tideline.operators import recursions as R


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(size=n))
    return close + rng.uniform(0, 1, n), close - rng.uniform(0, 1, n), close


def test_ewm_equals_pandas_with_gaps():
    x = np.random.default_rng(1).normal(size=300)
    x[[0, 1, 50, 51, 52, 200]] = np.nan
    for alpha, least in ((0.2, 1), (1 / 14, 14)):
        expected = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        np.testing.assert_allclose(R.ewm(x, alpha, least), expected, rtol=1e-12)


def test_rsi_without_losses():
    up = np.arange(1.0, 40)
    assert R.rsi(up, 14)[-1] == 50
    assert R.rsi(up, 14, "pine")[-1] == pytest.approx(100 - 100 / 101)


def test_indicators_see_no_future():
    high, low, close = walk(300)
    kernels = [lambda h, lo, c: R.adx(h, lo, c, 14)[0], lambda h, lo, c: R.supertrend_bands(h, lo, c, R.wilder(R.true_range(h, lo, c), 14))[1], R.supertrend_line, R.supertrend_switch, lambda h, lo, c: R.rsi(c, 14)]
    for f in kernels:
        full, part = f(high, low, close), f(high[:200], low[:200], close[:200])
        np.testing.assert_array_equal(full[:200], part)


def test_supertrend_line_is_on_the_right_side():
    high, low, close = walk(500, 3)
    trend, line = R.supertrend_bands(high, low, close, R.wilder(R.true_range(high, low, close), 14))
    ok = ~np.isnan(line)
    assert set(np.unique(trend)) <= {1.0, -1.0} and ok[20:].all()


def test_cusum():
    flat = np.zeros(500)
    assert not R.cusum_events(flat, 0.5).any()
    jumps = flat.copy()
    jumps[100:] += 1
    jumps[300:] -= 2
    assert R.cusum_events(jumps, 0.5).sum() >= 2
    assert 5 <= R.cusum_events(np.linspace(0, 10, 1000), 1.0).sum() <= 15
    assert not R.cusum_events(jumps, np.full(500, np.nan)).any()


def test_info_bars_restart_and_drop_the_tail():
    volume = np.random.default_rng(2).lognormal(size=5000)
    closed, _ = R.fill_run(volume, volume.sum() / 100)
    ids = np.cumsum(closed) - closed
    ids[ids == closed.sum()] = -1
    expected, acc, bar = np.full(5000, -1), 0.0, 0
    start = 0
    for i, v in enumerate(volume):
        acc += v
        if acc >= volume.sum() / 100:
            expected[start : i + 1] = bar
            acc, bar, start = 0.0, bar + 1, i + 1
    np.testing.assert_array_equal(ids, expected)
    assert 80 <= ids.max() + 1 <= 100


def test_ffd_weights_and_difference():
    np.testing.assert_allclose(events.ffd_weights(1.0), [-1, 1])
    np.testing.assert_allclose(events.ffd_weights(0.0), [1])
    assert [len(events.ffd_weights(d)) for d in (0.1, 0.2, 0.5)] == [503, 497, 200]
    x = np.cumsum(np.random.default_rng(0).normal(size=500))
    np.testing.assert_allclose(events.frac_diff(x, 1.0)[1:], np.diff(x))
    w = events.ffd_weights(0.4, 1e-3)
    y = events.frac_diff(x, 0.4, 1e-3)
    assert y[len(w) + 5] == pytest.approx(float(w @ x[6 : len(w) + 6]))
    x[100] = np.nan
    assert np.isnan(events.frac_diff(x, 1.0)[[100, 101]]).all() and not np.isnan(events.frac_diff(x, 1.0)[102])


def test_adf_tells_walks_from_noise():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=2000)
    assert events.adf_statistic(noise) < events.adf_critical(2000) < events.adf_statistic(np.cumsum(noise))


def test_folds():
    assert splits.block_bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]
    assert [b - a for _, a, b in splits.growing_folds(1003)] == [120, 120, 120, 120, 122]
    assert [a for _, a, _ in splits.expanding_folds(10_000)] == [5000, 5800, 6600, 7400, 8200]


def test_sequential_bootstrap_beats_plain_draws():
    rng = np.random.default_rng(0)
    start = rng.integers(0, 185, 100)
    end = start + 14

    def unique(draws):
        c = np.zeros(200)
        for i in draws:
            c[start[i] : end[i] + 1] += 1
        return np.mean([np.mean(1 / c[start[i] : end[i] + 1]) for i in draws])

    assert unique(splits.sequential_bootstrap(start, end, 200, 50, 1)) > np.mean([unique(rng.integers(0, 100, 50)) for _ in range(20)])


def test_sharpe_corrections():
    values = [stats.expected_max_sharpe(n) for n in (2, 10, 1000, 129_600)]
    assert values == sorted(values)
    assert stats.deflated_sharpe(0.05, 100_000, 1000, variance=1e-4) < stats.deflated_sharpe(0.05, 2, 1000, variance=1e-4)
    assert stats.binomial_tail(0, 10, 0.5) == 1
    assert stats.binomial_tail(8, 10, 0.5) == pytest.approx(56 / 1024)


def bar_by_bar(close, high, low, buy, sell, fixed, trail, gain, tp):
    """A slow walk over every bar."""
    side, out = 0, []
    for i in range(len(close)):
        if side:
            ext = high[i] if side > 0 else low[i]
            best = max(best, ext) if side > 0 else min(best, ext)
            armed = armed or (ext >= entry * (1 + gain) if side > 0 else ext <= entry * (1 - gain))
            gone = close[i] / entry - 1 if side > 0 else 1 - close[i] / entry
            stop = close[i] <= entry * (1 - fixed) if side > 0 else close[i] >= entry * (1 + fixed)
            target = tp > 0 and (close[i] >= entry * (1 + tp) if side > 0 else close[i] <= entry * (1 - tp))
            give = trail > 0 and armed and (close[i] <= best * (1 - trail) if side > 0 else close[i] >= best * (1 + trail))
            if (sell[i] if side > 0 else buy[i]) or (fixed < 10 and stop) or target or give:
                out.append((round(gone - 2 * sim.FEE, 12), side, since, i))
                side = 0
        if not side and (buy[i] or sell[i]):
            side, entry, since, armed = (1 if buy[i] else -1), close[i], i, False
            best = high[i] if side > 0 else low[i]
    return out


@pytest.mark.parametrize("risk", [(1000, 0, 0, 0), (2, 0, 0, 0), (2, 1, 0.5, 0), (1000, 1, 0.5, 3), (3, 2, 0, 1)])
def test_simulator_equals_a_walk_over_every_bar(risk):
    high, low, close = walk(3000, 9)
    high, low, close = high + 200, low + 200, close + 200
    rng = np.random.default_rng(4)
    buy, sell = rng.random(3000) < 0.02, rng.random(3000) < 0.02
    got = sim.simulate(close, high, low, buy, sell, *map(float, risk))
    expected = bar_by_bar(close, high, low, buy, sell, risk[0] / 100, risk[1] / 100, risk[2] / 100, risk[3] / 100)
    assert [(round(r.pnl, 12), r.dir, r.entry_idx, r.exit_idx) for r in got.itertuples()] == expected


def test_vertical_barrier_and_open_trades():
    close = np.full(30, 100.0)
    buy = np.zeros(30, bool)
    buy[[3, 25]] = True
    got = sim.simulate(close, close, close, buy, np.zeros(30, bool), max_bars=10)
    assert got[["entry_idx", "exit_idx"]].values.tolist() == [[3, 13]]


def two_regimes(n=600):
    rng = np.random.default_rng(0)
    state = (np.arange(n) // 100) % 2
    return np.column_stack([np.where(state, 1.0, -1.0) + rng.normal(size=n) * 0.3, np.where(state, 2.0, 0.5) + rng.normal(size=n) * 0.1]), state


def test_hmm_finds_regimes_and_filters_causally():
    x, state = two_regimes()
    m = regime.fit(x, 2, 42, 50)
    p, _ = regime.forward(m, x)
    guess = p.argmax(axis=1)
    assert max((guess == state).mean(), (guess != state).mean()) > 0.95
    np.testing.assert_allclose(p[:300], regime.forward(m, x[:300])[0])
    np.testing.assert_allclose(p.sum(axis=1), 1)
    assert (regime.smoothed(m, x).argmax(axis=1) == guess).mean() > 0.97
    assert regime.healthy(m, x) and (regime.viterbi(m, x) == guess).mean() > 0.97
    assert regime.n_params(3, 2) == 2 + 6 + 6 + 6 and regime.n_params(3, 2, True) == 2 + 6 + 6 + 9
    assert regime.report(m)["stationary"].sum() == pytest.approx(1)
    assert len(regime.labels(m.means)) == 2


def test_hmm_with_full_covariances():
    rng = np.random.default_rng(3)
    state = np.repeat([0, 1, 0, 1], 150)
    corr = np.array([[1.0, 0.9], [0.9, 1.0]])
    x = np.where(state[:, None] == 0, rng.multivariate_normal([0, 0], corr, 600), rng.multivariate_normal([0, 0], np.diag([1.0, 1.0]) * [[1, 0], [0, 1]] - 0.9 * (1 - np.eye(2)), 600))
    full, diagonal = (max((regime.fit(x, 2, s, 60, full=f) for s in range(3)), key=lambda m: m.loglik) for f in (True, False))
    assert full.variances.shape == (2, 2, 2) and full.loglik > diagonal.loglik + 50
    guess = regime.viterbi(full, x)
    assert max((guess == state).mean(), (guess != state).mean()) > 0.9
    p, total = regime.forward(full, x)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    d = x - full.means[0]
    plain = -0.5 * (np.log(np.linalg.det(2 * np.pi * full.variances[0])) + np.einsum("ni,ij,nj->n", d, np.linalg.inv(full.variances[0]), d))
    np.testing.assert_allclose(full.log_emissions(x)[:, 0], plain)


def test_means_of_windows():
    x = np.arange(7.0) ** 2
    np.testing.assert_allclose(sim.mean_of(x, 3)[2:], [(x[i] + x[i - 1] + x[i - 2]) / 3 for i in range(2, 7)])
    assert np.isnan(sim.mean_of(x, 3)[:2]).all() and np.isnan(sim.mean_of(x[:2], 3)).all()


def test_requests_are_made_again():
    from tideline.sources import readers

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return [1]

    assert readers.retried(flaky, 5, 0.0) == [1] and len(calls) == 3
    with pytest.raises(OSError):
        readers.retried(lambda: (_ for _ in ()).throw(OSError("down")), 2, 0.0)


def test_coarser_live_bars_skip_gaps():
    from datetime import datetime

    from tideline.streaming import frame

    c = frame.Coarse(4)
    assert all(np.isnan(v) for v in c.push(datetime(2024, 1, 1, 1), 2.0, 1.0, 1.5))
    first = c.push(datetime(2024, 1, 1, 5), 3.0, 2.0, 2.5)
    assert first[0] == 0.0 and first[2] == 50.0
    after_gap = c.push(datetime(2024, 1, 1, 21), 3.0, 2.0, 2.5)
    assert np.isnan(after_gap[0]) and after_gap[2] == 50.0  # the bin before has no trades
    assert len(frame.names()) == 58


def test_uniform_numbers_depend_on_row_and_draw_only():
    from tideline.operators import research

    rows = np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    u = research.uniform(rows, 50, 1)
    np.testing.assert_array_equal(u[10:20], research.uniform(rows[10:20], 50, 1))
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.05 and (u != research.uniform(rows, 50, 2)).all()
    times = np.searchsorted(np.array(research.POISSON), u, side="right")
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.05
