"""Boosted trees over folds and seeds, thresholds, ablation, parity of feature frames."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.ranks import quantiles
from tideline.operators.stats import auc
from tideline.sources.shared import stored


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls become a value outside all features' ranges, which trees split off."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.fillna(-1e9, subset=features))


def class_weight(train: DataFrame, label: str) -> DataFrame:
    """weight of positives n0 / max(n1, 1), times the weight that is there."""
    counts = train.agg((F.sum((F.col(label) == 0).cast("double")) / F.greatest(F.sum((F.col(label) == 1).cast("double")), F.lit(1.0))).alias("_s"))
    base = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    return train.crossJoin(F.broadcast(counts)).withColumn("weight", base * F.when(F.col(label) == 1, F.col("_s")).otherwise(1.0)).drop("_s")


def fit_seeds(train: DataFrame, features: list[str], label: str, seeds: list[int], iterations: int = 20, depth: int = 4, step: float = 0.1) -> list[Model]:
    data = assembled(train, features)
    weight = {"weightCol": "weight"} if "weight" in train.columns else {}
    data.cache()
    try:
        return [GBTClassifier(featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=s, **weight).fit(data) for s in seeds]
    finally:
        data.unpersist()


def predict(models: list[Model], df: DataFrame, features: list[str], out: str = "pred") -> DataFrame:
    """The mean probability of all models."""
    data = assembled(df, features)
    for i, m in enumerate(models):
        data = m.transform(data.drop("rawPrediction", "prediction", "probability")).withColumn(f"_p{i}", vector_to_array("probability")[1])
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return data.withColumn(out, mean).drop("features", "rawPrediction", "prediction", "probability", *[f"_p{i}" for i in range(len(models))])


def out_of_fold(df: DataFrame, folds: DataFrame, features: list[str], label: str, seeds: list[int], on: tuple[str, ...] = ("pos",), **settings) -> DataFrame:
    """Predictions of each fold's test rows by models of its train rows. folds: (fold, role) per row of df."""
    folds = stored(folds)
    rows = stored(df.join(folds, list(on)).where(F.col(label).isNotNull()))
    out = None
    for (fold,) in sorted(folds.select("fold").distinct().collect()):  # a handful of folds, each a training job
        part = rows.where(F.col("fold") == fold)
        models = fit_seeds(part.where("role = 'train'"), features, label, seeds, **settings)
        got = predict(models, part.where("role = 'test'"), features)
        out = got if out is None else out.unionByName(got)
    return out


def fold_aucs(predictions: DataFrame, label: str, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    return auc(predictions, "pred", label, list(keys))


def tail_thresholds(predictions: DataFrame, per_day: float = 2.0, bars_per_day: float = 24.0) -> DataFrame:
    """(buy, sell) quantiles that give per_day signals a day, half on each side."""
    tail = per_day / bars_per_day / 2
    return quantiles(predictions, "pred", {"buy": 1 - tail, "sell": tail})


def quartiles(df: DataFrame, value: str, train: F.Column) -> DataFrame:
    """df with the quarter (0 to 3) of value; edges are of train rows only."""
    edges = quantiles(df.where(train), value, {"a": 0.25, "b": 0.5, "c": 0.75}).select(F.array("a", "b", "c").alias("_e"))
    quarter = sum((F.when(F.col(value) >= F.col("_e")[i], 1).otherwise(0) for i in range(3)), F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn(f"{value}_quarter", F.when(F.col(value).isNotNull(), quarter)).drop("_e")


def importances(models: list[Model], features: list[str], top: int = 15) -> list[tuple[str, float]]:
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(features))]
    return sorted(zip(features, mean, strict=True), key=lambda x: (-x[1], x[0]))[:top]


def largest_difference(a: DataFrame, b: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
    """Per column: the largest difference and how often only one side is null. For leakage audits, parity, and matching formulas."""
    x, y = (d.select(*on, *[F.col(c).cast("double").alias(f"{t}{c}") for c in columns]) for d, t in ((a, "a_"), (b, "b_")))
    both = x.join(y, on)
    one = both.agg(*[F.struct(F.coalesce(F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))), F.lit(0.0)).alias("d"), F.sum((F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull()).cast("long")).alias("n")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.d").alias("max_diff"), F.col(f"`{c}`.n").alias("null_mismatch")) for c in columns])).alias("x")).select("x.*")


def windows(bars: DataFrame, n: int = 60, columns: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Each bar with the last n bars as an array of structs; bars without n before them are left out."""
    from pyspark.sql import Window

    over = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)
    return bars.withColumn("x", F.collect_list(F.struct(*columns)).over(over)).where(F.size("x") == n).select("symbol", "ts", "x")


def fit_stopping(train: DataFrame, stop: DataFrame, features: list[str], label: str, seed: int, iterations: int, depth: int, step: float = 0.1) -> Model:
    """A boosted model of as many trees as give the best AUC on the rows of stop, of all the prefixes of one fit."""
    whole = fit_seeds(train, features, label, [seed], iterations, depth, step)[0]
    rows = assembled(stop, features)
    margins = []
    for tree in whole.trees:  # a score is the weighted sum of the trees' predictions; a column for each tree
        rows = tree.transform(rows.drop("prediction")).withColumnRenamed("prediction", f"_t{len(margins)}")
        margins.append(f"_t{len(margins)}")
    weights = whole.treeWeights
    prefixes = [sum((F.col(m) * w for m, w in zip(margins[:k], weights[:k], strict=True)), F.lit(0.0)) for k in range(1, len(margins) + 1)]
    long = rows.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), p.alias("s")) for k, p in enumerate(prefixes, 1)])).alias("p")).select("y", "p.*")
    best = auc(long, "s", "y", ["k"]).orderBy(F.desc("auc"), "k").limit(1).collect()  # one row
    trees = best[0]["k"] if best else iterations
    return whole if trees == iterations else fit_seeds(train, features, label, [seed], trees, depth, step)[0]


def frozen_holdout(df: DataFrame, features: list[str], label: str, cut: str, seeds: list[int], iterations: int = 20, depth: int = 4, inner: float = 0.85) -> DataFrame:
    """One row (n_train, n, auc, least, most, mean, std): models of the rows before cut, each stopped early on the last part of these, are tried once on the rest."""
    from tideline.operators.stats import distribution

    early = F.col("ts") < F.lit(cut).cast("timestamp_ntz")
    past, held = df.where(early), df.where(~early)
    bounds = quantiles(past.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")), "t", {"t": inner}).first()
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) < bounds["t"]
    fitted = [fit_stopping(past.where(at), past.where(~at), features, label, s, iterations, depth) for s in seeds]
    scored = stored(predict(fitted, held, features).select(F.col("pred"), F.col(label).alias("y"), F.lit(1).alias("all")))
    parts = auc(scored, "pred", "y", ["all"]).join(distribution(scored, "pred", ["all"]).drop("n"), "all").drop("all")
    return parts.crossJoin(F.broadcast(past.agg(F.count("*").alias("n_train"))))


def save(models: list[Model], path: str, spark: SparkSession, **config: object) -> None:
    """Models in folders of their own beside a table of one JSON row."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/model-{i}")
    spark.createDataFrame([(json.dumps({"models": len(models), **config}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(path: str, spark: SparkSession) -> tuple[list[Model], dict]:
    config = json.loads(spark.read.text(f"{path}/config").first()["value"])
    return [GBTClassificationModel.load(f"{path}/model-{i}") for i in range(config["models"])], config
