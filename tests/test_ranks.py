"""Ranks and quantiles of slices against pandas on whole keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import models, ranks, stats


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    rows = [("big", float(v), float(y)) for v, y in zip(np.round(rng.normal(size=3_000), 2), rng.integers(0, 2, 3_000), strict=True)]
    rows += [("big", 0.25, 1.0)] * 2_000  # a tie across whole slices
    rows += [("same", 5.0, float(i % 2)) for i in range(50)] + [("one", -1.5, 1.0), (None, 3.0, 0.0), (None, 1.0, 1.0)]
    return pd.DataFrame(rows, columns=["k", "v", "y"]), spark.createDataFrame(rows, "k string, v double, y double").repartition(4).cache()


@pytest.mark.parametrize("slices", [2, 64])
def test_average_ranks(values, slices):
    table, df = values
    want = table.assign(k=table["k"].fillna("?")).groupby("k")["v"].rank().to_numpy()
    got = ranks.rank_in(df.fillna("?", ["k"]), "v", "r", ["k"], slices).toPandas()
    assert len(got) == len(table)
    key = ["k", "v", "r"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), table.assign(k=table["k"].fillna("?"), r=want)[key].sort_values(key).reset_index(drop=True))
    assert ranks.rank_in(df, "v", "r", ["k"], slices).where("k is null").count() == 2


@pytest.mark.parametrize("slices", [2, 256])
def test_quantiles_by_slices(spark, values, slices):
    table, df = values
    shares = {"least": 0.0, "a": 0.1, "median": 0.5, "b": 0.9137, "most": 1.0}
    got = ranks.quantiles(df.unionByName(spark.createDataFrame([("big", None, 0.0), ("big", float("nan"), 0.0), ("none", None, 0.0)], df.schema)), "v", shares, ["k"], slices)
    found = {r.k: r for r in got.collect()}
    assert set(found) == {"big", "same", "one", None}
    for k, part in table.assign(k=table["k"].fillna("?")).groupby("k"):
        for name, s in shares.items():
            assert found[None if k == "?" else k][name] == pytest.approx(part["v"].quantile(s), abs=1e-12), (k, name)
    whole = ranks.quantiles(df, "v", {"q": 0.3}).first()
    assert whole.q == pytest.approx(table["v"].quantile(0.3), abs=1e-12)
    assert ranks.quantiles(df.limit(0), "v", {"q": 0.3}).first().q is None


def test_a_single_key_is_ranked_in_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("x").alias("k"), (F.xxhash64("id") % 5_003).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranks.value_ranks(df, "v", ["k"])
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2
        assert found.agg(F.sum("_n")).first()[0] == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_auc_and_correlation_of_ties(values):
    table, df = values
    part = table[table["k"] == "big"]
    pos, neg = part[part.y > 0]["v"].to_numpy(), part[part.y == 0]["v"].to_numpy()
    want = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    got = {r.k: r for r in stats.auc(df, "v", "y", ["k"]).collect()}
    assert got["big"].auc == pytest.approx(want, abs=1e-12) and got["same"].auc == pytest.approx(0.5) and "one" not in got
    ic = {r.k: r.ic for r in stats.spearman(df, "v", "y", ["k"]).collect()}
    assert ic["big"] == pytest.approx(part["v"].rank().corr(part["y"].rank()), abs=1e-12)


def test_quartiles_without_training_rows(values):
    _, df = values
    assert models.quartiles(df, "v", F.lit(False)).count() == df.count()
