"""Engine operators on small frames."""

import json
import zipfile
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import align, events, indicators, labels, models, splits, stats
from tideline.operators import bars as B
from tideline.sources import readers, sinks
from tideline.streaming import live

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in ("a", "b"):
        close = 100 + np.cumsum(rng.normal(size=400))
        for i, c in enumerate(close.tolist()):
            if i % 97 != 50:
                rows.append((s, T0 + timedelta(hours=i), c - 0.1, c + 1, c - 1, c, float(1 + i % 7)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").cache()


def frame(df, *order):
    return df.orderBy(*order).toPandas()


def test_rolling_features_match_pandas(bars):
    got = frame(indicators.window_features(bars).where("symbol = 'a'"), "ts")
    c = got["close"]
    r = np.log(c / c.shift(1))
    np.testing.assert_allclose(got["vol_20"].astype(float), r.rolling(20).std(), rtol=1e-8)
    np.testing.assert_allclose(got["skew_50"].astype(float), r.rolling(50).skew(), rtol=1e-6)
    np.testing.assert_allclose(got["kurt_50"].astype(float), r.rolling(50).kurt(), rtol=1e-6)
    auto = r.rolling(20).apply(lambda x: pd.Series(x).autocorr(1))
    np.testing.assert_allclose(got["autocorr_20"].astype(float), auto, rtol=1e-6)


def test_htf_shows_only_completed_bars(bars):
    got = frame(indicators.features(bars).where("symbol = 'a'"), "ts").set_index("ts")
    b = frame(bars.where("symbol = 'a'"), "ts").set_index("ts")
    four = b["close"].resample("4h").last()
    expected = np.log(four / four.shift(5)).shift(1).reindex(b.index, method="ffill")
    np.testing.assert_allclose(got["htf_4h_logret5"].astype(float), expected, rtol=1e-9)
    assert len(indicators.feature_names(indicators.features(bars))) == 58


def test_features_do_not_see_the_future(bars):
    cut = T0 + timedelta(hours=300)
    broken = bars.withColumns({c: F.when(F.col("ts") >= F.lit(cut), F.lit(7.0) + F.rand(1)).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    x, y = indicators.features(bars).where(F.col("ts") < F.lit(cut)), indicators.features(broken)
    diff = models.largest_difference(x, y, indicators.feature_names(x), ["symbol", "ts"]).toPandas()
    assert diff["max_diff"].max() < 1e-9 and diff["null_mismatch"].sum() == 0


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([("a", t, t) for t in (1, 2, 3, 9)], "symbol string, ts int, n int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 3, None), ("b", 1, "z")], "symbol string, ts int, v string")
    got = align.asof(left, right, ["v"]).orderBy("ts").collect()
    assert [r["v"] for r in got] == [None, "x", None, None]
    strict = align.asof(left, right, ["v"], exact=False).orderBy("ts").collect()
    assert [r["v"] for r in strict] == [None, None, "x", None]


def test_asof_empty_sides(spark):
    left = spark.createDataFrame([("a", 1)], "symbol string, ts int")
    right = spark.createDataFrame([], "symbol string, ts int, v string")
    assert align.asof(left, right, ["v"]).collect()[0]["v"] is None
    assert align.asof(left.limit(0), right, ["v"]).count() == 0


def test_triple_barrier_outcomes(spark):
    path = [(100, 100, 100), (103, 99.5, 102), (101, 90, 95)] + [(100.5, 99.5, 100.2)] * 12
    bars = spark.createDataFrame([("s", i, T0 + timedelta(hours=i), c * 1.0, h * 1.0, lo * 1.0, c * 1.0) for i, (h, lo, c) in enumerate(path)], "symbol string, pos long, ts timestamp_ntz, open double, high double, low double, close double")
    ev = spark.createDataFrame([("s", 0, 100.0, 1.0, "buy"), ("s", 1, 102.0, 1.0, " SELL "), ("s", 3, 100.2, 1.0, "Buy"), ("s", 13, 100.2, 1.0, "Buy")], "symbol string, pos long, entry_price double, atr_pct double, signal string")
    got = {r["pos"]: r for r in labels.triple_barrier(ev, bars).collect()}
    assert (got[0]["outcome"], got[0]["label"], got[0]["bars_to_exit"]) == ("upper", 1, 1)
    assert (got[1]["outcome"], got[1]["label"]) == ("upper", 1)
    assert (got[3]["outcome"], got[3]["bars_to_exit"]) == ("time", 10)
    assert (got[13]["outcome"], got[13]["label"]) == ("no_data", None)


def naive_kfold(end, k, embargo):
    n, out = len(end), set()
    for s, (a, b) in enumerate(splits.block_bounds(n, k)):
        last = max(end[a:b])
        out |= {(s, p, "test") for p in range(a, b)} | {(s, p, "train") for p in range(n) if (p < a and end[p] < a) or (p >= b and p >= last + 1 + int(n * embargo))}
    return out


def test_purged_kfold_and_embargo(spark):
    end = [min(i + 10, 199) for i in range(200)]
    spans = spark.createDataFrame(list(enumerate(end)), "pos long, end long")
    sizes = []
    for e in (0.0, 0.01, 0.05):
        got = {tuple(r) for r in splits.purged_kfold(spans, 200, 5, e).collect()}
        assert got == naive_kfold(end, 5, e)
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]
    with pytest.raises(ValueError):
        splits.purged_kfold(spans, 200, 1)
    for combo in range(10):
        rows = [r for r in splits.cpcv(spans, 200, 5, 2, 0.01).where(F.col("split_id") == combo).collect()]
        test = {r["pos"] for r in rows if r["role"] == "test"}
        assert all(not test & set(range(r["pos"], end[r["pos"]] + 1)) for r in rows if r["role"] == "train")


def test_weights(spark):
    spans = [(10 * i, 10 * i + 9) for i in range(10)] + [(0, 9)] * 4
    bars = spark.createDataFrame([(i, 0.01) for i in range(100)], "pos long, logret double")
    df = spark.createDataFrame(spans, "start long, end long")
    u = splits.average_uniqueness(df, bars).toPandas()
    assert np.allclose(u[u["start"] == 0]["uniqueness"], 0.2) and np.allclose(u[u["start"] > 0]["uniqueness"], 1)
    assert splits.return_weights(df, bars).agg(F.avg("weight")).first()[0] == pytest.approx(1)
    ones = spark.createDataFrame([(i, i, 1.0) for i in range(100)], "start long, end long, uniqueness double")
    for c, low in ((1.0, 1.0), (0.0, 0.01), (-0.5, 0.0)):
        w = frame(splits.time_decay(ones, c), "start")["decay"]
        assert w.iloc[-1] == pytest.approx(1) and w.iloc[0] == pytest.approx(low, abs=1e-9)
    assert (frame(splits.time_decay(ones, -0.5), "start")["decay"] == 0).sum() > 10


def test_running_sums_in_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("v"))
    got = frame(splits.running_sum(df, "v", "x", ["pos"], block=64), "pos")
    assert got["x"].tolist() == np.cumsum(np.arange(1000) % 7).tolist()


def test_purge_overlaps(spark):
    train = spark.createDataFrame([(0, 5), (4, 8), (9, 12), (20, 30), (13, 14)], "t0 long, t1 long")
    test = spark.createDataFrame([(10, 12), (22, 25)], "t0 long, t1 long")
    assert sorted(map(tuple, splits.purge(train, test).collect())) == [(0, 5), (4, 8), (13, 14)]


def test_overfitting_on_noise_and_skill(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(600, 20)) * 0.01
    made = lambda m: spark.createDataFrame(pd.DataFrame({"strategy_id": np.tile(np.arange(20), 600), "obs_no": np.repeat(np.arange(600), 20), "ret": m.ravel()}))
    assert 0.2 < stats.overfitting(made(noise), 8).first()["pbo"] < 0.9
    skilled = noise.copy()
    skilled[:, 7] += 0.005
    assert stats.overfitting(made(skilled), 8).first()["pbo"] < 0.2


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("x", 0.1, 0.0), ("x", 0.1, 1.0), ("x", 0.9, 1.0), ("x", None, 1.0), ("y", 0.5, 1.0)], "k string, s double, l double")
    got = stats.auc(df, "s", "l", ["k"]).collect()
    assert len(got) == 1 and got[0]["auc"] == pytest.approx(0.75) and got[0]["n"] == 3


def test_spearman_p_value(spark):
    df = spark.createDataFrame([("k", float(i), float(i * i)) for i in range(20)], "k string, x double, y double")
    r = stats.spearman(df, "x", "y", ["k"]).first()
    assert r["ic"] == pytest.approx(1) and r["p_value"] < 1e-6


def test_paged_source(spark, tmp_path):
    rows = [[i * 60_000, "1", "2", "0.5", "x" if i == 3 else "1.5", "7", i * 60_000 + 59_999, "9", 4, "0", "0", "0"] for i in range(25)]
    path = tmp_path / "klines.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(readers.PagedSource)
    for direction in ("forward", "backward"):
        raw = spark.read.format("paged_klines").options(path=str(path), start=0, end=25 * 60_000, step=60_000, page_limit=4, slices=3, direction=direction).load()
        assert raw.count() == 25
        clean = readers.clean_klines(raw, now_ms=20 * 60_000)
        assert clean.count() == 20 and clean.where("close is null").count() == 1


def test_zipped_days_and_failures(spark, tmp_path):
    for day in (1, 2):
        with zipfile.ZipFile(tmp_path / f"d{day}.zip", "w") as z:
            z.writestr("x.csv", "a,b\n" + "\n".join(f"{i},{i * day}" for i in range(3)) + "\n")
    got = readers.read_zipped_csv(spark, f"file://{tmp_path}/*.zip", "a bigint, b bigint")
    assert got.count() == 6 and got.agg(F.sum("b")).first()[0] == 9

    def fetch(day):
        if day.day == 2:
            raise readers.Unavailable
        if day.day == 3:
            raise OSError
        return b"x"

    done = readers.fetched(readers.days(spark, "2024-01-01", "2024-01-03"), fetch).orderBy("day").collect()
    assert [(r.day, r.status, r.content) for r in done] == [(date(2024, 1, 1), "data", b"x"), (date(2024, 1, 2), "none", None), (date(2024, 1, 3), "failed", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, v int")
    sinks.append_days(df, f"file://{tmp_path}/t")
    sinks.append_days(df.where("day = '2024-01-02'").withColumn("v", F.lit(5)), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").agg(F.sum("v")).first()[0] == 6
    sinks.overwrite(df, f"file://{tmp_path}/c", "csv")
    assert readers.read_bars_csv(spark, f"file://{tmp_path}/c", "day string, v int").count() == 2
    sinks.save_config(str(tmp_path / "c.json"), a=1)
    assert sinks.load_config(str(tmp_path / "c.json")) == {"a": 1}
    assert "day" in sinks.report(df, "title")


def test_cusum_features_and_ffd(bars):
    got = frame(events.cusum_features(bars).where("symbol = 'a'"), "ts")
    assert got["cusum_event"].sum() > 0 and got["bars_since_event"].min() >= 1
    assert got["event_intensity_100"].iloc[:19].isna().all()
    chosen = events.least_ffd(bars, (0.0, 0.5, 1.0), 1e-2).where("chosen").collect()
    assert {r["symbol"] for r in chosen} == {"a", "b"}


def test_grid_resample_keeps_gaps(bars):
    got = frame(B.resample(bars.where("symbol = 'a'"), "hour"), "ts")
    assert len(got) == 400 and got["close"].isna().sum() == 4 and (got[got["close"].isna()]["volume"] == 0).all()
    assert B.gaps(bars.where("symbol = 'a'")).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("s", T0 + timedelta(minutes=10 * i), i, 100 + 20 * float(np.sin(i / 80)) + 0.1 * float(rng.normal()), 1.0) for i in range(600)]
    tape = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id long, price double, quantity double")
    for k in range(3):
        tape.where((F.col("trade_id") % 200 >= 0) & (F.col("trade_id") >= k * 200) & (F.col("trade_id") < (k + 1) * 200)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tape")
    stream = spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/tape")
    q = live.closed_bars(stream).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(180)
    got = frame(spark.table("closed"), "ts")
    expected = frame(B.time_bars(tape, "hour"), "ts")
    n = len(got)
    assert 90 <= n < len(expected)
    np.testing.assert_allclose(got["close"], expected["close"][:n])
    bars = expected.drop(columns=["trades"])
    history = spark.createDataFrame(bars.iloc[:40])
    sent, features = [], None
    for run in (((40, 55), (55, 70)), ((70, 90),)):  # a stop in between
        for first, end in run:
            live.add_bars(spark.createDataFrame(bars.iloc[first:end]), f"{tmp_path}/bars")
        features = live.live_features(live.bars_in(spark, f"{tmp_path}/bars"), history)
        q = live.run_alerts(features, sent.append, f"{tmp_path}/c2", buy=0.55, sell=0.45)
        q.awaitTermination(180)
    batch = frame(indicators.recursive(spark.createDataFrame(bars)), "ts").iloc[40:90]
    p = 1 / (1 + np.exp(-(batch["ema9"] - batch["ema21"]) / batch["atr_14"].astype(float)))
    expected_alerts = ((p >= 0.55) | (p <= 0.45)).sum()
    assert len(sent) == expected_alerts > 0
    assert {"symbol", "timestamp", "action", "probability", "close_price", "horizon_bars"} <= json.loads(sent[0]).keys()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_frame_state_is_plain_numbers():
    rng, one, two = np.random.default_rng(4), live.frame.Frame(), live.frame.Frame()
    close = 100 + np.cumsum(rng.normal(size=700))
    for i, c in enumerate(close.tolist()):
        if i % 50 == 49:
            continue
        at = T0 + timedelta(hours=i)
        a = one.push(at, c + 1, c - 1, c, 2.0 + i % 3)
        b = two.push(at, c + 1, c - 1, c, 2.0 + i % 3)
        np.testing.assert_array_equal(list(a.values()), list(b.values()))
        if i % 7 == 0:  # put down and taken up
            two = live.frame.Frame.taken_up(two.numbers(), two.rows().copy())
    assert one.push(at, 1.0, 1.0, 1.0, 1.0) is None


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame(pd.DataFrame({"pos": range(400), "x0": x[:, 0], "x1": x[:, 1], "y": (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)}))
    folds = splits.walk_forward(df.select("pos"), splits.growing_folds(400, 2), 5)
    pred = models.out_of_fold(models.class_weight(df, "y"), folds, ["x0", "x1"], "y", [0, 1], iterations=3, depth=2)
    assert models.fold_aucs(pred, "y").agg(F.min("auc")).first()[0] > 0.8
    t = models.tail_thresholds(pred).first()
    assert t["sell"] < t["buy"]
    shuffled = splits.shuffled_kfold(df, 5, 1, "y").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in shuffled)[0] >= 78


def test_every_query_has_a_name_of_its_own_and_twins_belong_to_queries():
    from tideline.plans.catalog import QUERIES, SQL

    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 60


def test_splits_and_weights_of_every_series(spark):
    """Keyed results are those of each series alone."""
    rng = np.random.default_rng(5)
    sizes = {"a": 40, "b": 57, "c": 9}
    bars = spark.createDataFrame([(s, i, float(rng.normal())) for s, n in sizes.items() for i in range(n)], "symbol string, pos long, logret double").cache()
    spans = spark.createDataFrame([(s, i, min(i + int(rng.integers(0, 6)), n - 1)) for s, n in sizes.items() for i in range(0, n, 2)], "symbol string, start long, end long").cache()
    ends = spans.select("symbol", F.col("start").alias("pos"), "end")
    decayed = splits.time_decay(splits.average_uniqueness(spans, bars, "symbol"), 0.3, key="symbol").toPandas()
    weights = splits.return_weights(spans, bars, key="symbol").toPandas()
    folds = {tuple(r) for r in splits.purged_kfold(ends, None, 4, 0.1, "symbol").collect()}
    for s in sizes:
        one, b = spans.where(F.col("symbol") == s).drop("symbol"), bars.where(F.col("symbol") == s).drop("symbol")
        mine = splits.time_decay(splits.average_uniqueness(one, b), 0.3).toPandas().sort_values(["start", "end"])
        got = decayed[decayed["symbol"] == s].sort_values(["start", "end"])
        np.testing.assert_allclose(got[["uniqueness", "decay"]], mine[["uniqueness", "decay"]])
        w = splits.return_weights(one, b).toPandas().sort_values(["start", "end"])
        np.testing.assert_allclose(weights[weights["symbol"] == s].sort_values(["start", "end"])["weight"], w["weight"])
        n = one.count()
        alone = {(s, *r) for r in splits.purged_kfold(one.select(F.col("start").alias("pos"), "end"), n, 4, 0.1).collect()} if n >= 4 else set()
        assert {f for f in folds if f[0] == s} == alone


def test_shuffled_folds_are_even_in_every_group(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("symbol"), F.col("id").alias("pos"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    got = splits.shuffled_kfold(rows, 4, 3, "y", "symbol").groupBy("symbol", "y", "fold").count().toPandas()
    assert got["count"].sum() == 1000 and set(got["fold"]) == {0, 1, 2, 3}
    spread = got.groupby(["symbol", "y"])["count"].agg(lambda c: c.max() - c.min())
    assert (spread <= 1).all()


def test_bootstrap_draws_equal_rows_apart(spark):
    from tideline.operators import research

    df = spark.createDataFrame([("a", 1.0)] * 200 + [("a", 3.0)] * 200 + [("b", 1.0)] * 400, "g string, v double")
    r = research.bootstrap_gap(df, "v", "g", "a", "b").first()
    # The mean of 400 values of deviation 1 has one of 0.05.
    assert abs(r["gap"] - 1) < 0.03 and 0.14 < r["high"] - r["low"] < 0.26


def test_doubled_columns_go(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a` int, `a.1` int, `b.2` int, `c.x` int")
    assert readers.without_repeated(df).columns == ["a", "b.2", "c.x"]


def test_shared_tables_need_a_shared_folder(spark, monkeypatch):
    from tideline.sources import shared

    class Context:
        master = "spark://host:7077"
        applicationId = "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_early_stopping_and_saved_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    df = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=500, freq="h"), "x0": x[:, 0], "x1": x[:, 1], "y": (x[:, 0] + 0.5 * rng.normal(size=500) > 0).astype(float)})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = models.frozen_holdout(df, ["x0", "x1"], "y", "2024-01-17", [0], iterations=4, depth=2).first()
    assert r["n_train"] == 384 and r["auc"] > 0.8 and 0 <= r["least"] < r["mean"] < r["most"] <= 1
    fitted = models.fit_seeds(df, ["x0", "x1"], "y", [1], iterations=2, depth=2)
    models.save(fitted, f"file://{tmp_path}/m", spark, features=["x0", "x1"])
    again, config = models.load(f"file://{tmp_path}/m", spark)
    assert config == {"features": ["x0", "x1"], "models": 1} and len(again) == 1
