"""Table functions, the day stream, and covariances of tapes without common times."""

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tideline.functions import tables
from tideline.operators import covariance, research, sim
from tideline.plans import catalog
from tideline.sources import sinks

SF = "/root/testdata/sf0.01"



def pairs(x, y):
    """By all pairs of intervals; x, y: sorted (time, value)."""
    return sum((v1 - v0) * (w1 - w0) for (a, v0), (b, v1) in zip(x, x[1:], strict=False) for (c, w0), (d, w1) in zip(y, y[1:], strict=False) if a < d and c < b)


@pytest.mark.parametrize("width", [2, 3_600])
def test_covariance_of_tapes_equals_all_pairs(spark, width):
    rng = np.random.default_rng(6)
    made = {}
    for key, (n, m, start, stop) in {"k": (60, 45, 0, 300), "apart": (10, 10, 400, 500), "single": (1, 9, 0, 50), "same": (30, 30, 0, 40)}.items():
        x = {int(t): float(v) for t, v in zip(rng.choice(300, n, replace=key == "same"), rng.normal(size=n), strict=True)}
        y = {int(t): float(v) for t, v in zip(rng.integers(start, stop, m), rng.normal(size=m), strict=True)}
        made[key] = (sorted(x.items()), sorted(y.items()))
    schema = "symbol string, ts long, trade_id long, price double"
    rows = lambda i: [(k, t, 5, v) for k, s in made.items() for t, v in s[i]] + [(k, s[i][0][0], 4, 99.0) for k, s in made.items()] + [("k", None, 1, 1.0), ("k", 3, 9, None), (None, 1, 1, 1.0), (f"only{i}", 1, 1, 1.0)]
    got = {r.symbol: r for r in covariance.hayashi_yoshida(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema), width=width).collect()}
    assert set(got) == set(made)
    for k, (x, y) in made.items():
        assert (got[k].n_x, got[k].n_y) == (len(x), len(y)) and got[k].covariance == pytest.approx(pairs(x, y), abs=1e-9), k


def test_table_functions_check_their_input(spark):
    tables.register(spark)
    spark.createDataFrame([("a", 1)], "symbol string, ts int").createOrReplaceTempView("_poor")
    with pytest.raises(Exception, match="columns are missing"):
        spark.sql("SELECT * FROM info_bars(TABLE(SELECT * FROM _poor) PARTITION BY symbol ORDER BY (ts), 2.0D)").collect()


def test_information_bars_from_sql(spark):
    tables.register(spark)
    rows = [(s, i, 1.0, 2.0 + i, 0.5, 1.5, float(v)) for s in "ab" for i, v in enumerate([3, 4, 5, 1, 1, 1])]
    spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double").createOrReplaceTempView("_some")
    got = spark.sql("SELECT symbol, bar_id, ts, n_source_bars, high, volume FROM info_bars(TABLE(SELECT * FROM _some) PARTITION BY symbol ORDER BY (ts), 7.0D)")
    assert sorted(map(tuple, got.collect())) == [(s, *r) for s in "ab" for r in [(0, 1, 2, 3.0, 7.0), (1, 4, 3, 6.0, 7.0)]]
    assert spark.sql("SELECT * FROM info_bars(TABLE(SELECT * FROM _some WHERE false) PARTITION BY symbol ORDER BY (ts), 7.0D)").count() == 0


def test_a_day_stream_that_failed_goes_on(spark, tmp_path):
    path, fails = str(tmp_path), [True]
    for day, n in ((1, 2), (2, 0), (3, 4), (1, 3)):  # a day without data; a day that comes again
        rows = [(f"2024-01-0{day}", k) for k in range(n)] or [(f"2024-01-0{day}", None)]
        spark.createDataFrame(rows, "day string, trade long").coalesce(1).write.mode("append").parquet(f"{path}/in")

    def make(batch):
        out = batch.groupBy("day").agg(F.count("trade").alias("n"))
        if fails and out.where("day = '2024-01-03'").count():
            fails.clear()
            out.write.mode("overwrite").parquet(f"{path}/rows/batch=2")  # written, then lost before it was committed
            raise OSError("gone")
        return out

    for k in range(2):
        files = spark.readStream.schema("day string, trade long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = sinks.stream_days(files, f"{path}/rows", make, f"{path}/c")
        if k == 0:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination(120)
        else:
            query.awaitTermination(120)
    assert sorted(map(tuple, sinks.streamed_days(spark, f"{path}/rows").collect())) == [("2024-01-01", 3), ("2024-01-02", 0), ("2024-01-03", 4)]


def test_grids_made_by_spark(spark):
    choices = {"rsi_len": [7, 14], "os_th": [1, 2, 3], "fixed_sl": [5]}
    assert sorted(map(tuple, sim.whole_grid(spark, choices).collect())) == sorted(map(tuple, sim.grid(spark, **choices).collect()))
    whole = sim.whole_grid(spark)
    assert whole.agg(F.count_distinct("config_id"), F.max("config_id")).first() == (129_600, 129_599)


def test_input_search_returns_every_configuration_with_enough_entries(spark):
    often = catalog.grid_trades(spark, SF).groupBy("config_id").count().where("count >= 30")
    got = catalog.input_search(spark, SF)
    assert sorted(map(tuple, got.select("config_id", "n").collect())) == sorted(map(tuple, often.collect()))
    fired = spark.createDataFrame([("s", c, pos, 1, 1.0) for c, n in ((0, 40), (1, 60)) for pos in range(n)], "symbol string, config_id long, pos long, dir int, n_days double")
    pred = spark.createDataFrame([("s", pos, 0.6, float(pos % 2)) for pos in range(60)], "symbol string, pos long, pred double, actual double")
    assert {r.config_id for r in research.input_search(fired, pred, 30, (15.0, 50.0)).collect()} == {0}
    assert {r.config_id for r in research.input_search(fired, pred, 30, None).collect()} == {0, 1}


def test_searches_over_two_periods(spark):
    rng = np.random.default_rng(2)
    rows = [(s, c, int(rng.integers(50, 300)), float(rng.random()), float(rng.choice([0.5, 1.5]))) for s in "ab" for c in range(40)]
    schema = "symbol string, config_id long, n_trades long, win_rate double, profit_factor double"
    first = spark.createDataFrame(rows, schema)
    later = [(s, c, n // 4, w if s == "a" else -w, p) for s, c, n, w, p in rows]
    got = {(r.symbol, r.measure): r for r in research.search_correlation(first, spark.createDataFrame(later, schema)).collect()}
    assert got["a", "win_rate"].ic == pytest.approx(1) and got["b", "win_rate"].ic == pytest.approx(-1) and got["a", "n_trades"].n == 40
    kept = research.exit_study(first, spark.createDataFrame(later, schema), 100, 30).collect()
    want = {(s, c): p > 1 for s, c, n, w, p in rows if n >= 100 and n // 4 >= 30}
    assert {(r.symbol, r.config_id): r.both_profitable for r in kept} == want
