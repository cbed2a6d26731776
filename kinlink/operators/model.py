"""Two stages of gradient-boosted trees with out-of-fold scores, and isotonic calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_: str, k: int, seed: int = 42) -> Column:
    """All pairs of one left record are in one fold."""
    return F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(k)).cast("int")


def sample_weights(df: DataFrame, y: str = "y", keep_rank: int = 15, share: float = 0.1, seed: int = 3) -> DataFrame:
    """All positives and close negatives (brank), and a share of the others, weighted up to stand for all."""
    close = (F.col(y) == 1) | (F.col("brank") < keep_rank)
    draw = F.pmod(F.xxhash64("l_id", "r_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.withColumn("weight", F.when(close, 1.0).otherwise(1.0 / share)).filter(close | draw)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """One vector of all features; unknown ones are -1 with a flag of their own, since trees here take no missing values."""
    df = df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features} | {f"_{c}_known": F.col(c).isNotNull().cast("double") for c in features})
    cols = [f"_{c}" for c in features] + [f"_{c}_known" for c in features]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).drop(*cols)


def trees(rounds: int, depth: int, seed: int) -> GBTClassifier:
    return GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.7", maxBins=64, minInstancesPerNode=5, seed=seed)


def train_folds(df: DataFrame, features: list[str], k: int = 3, rounds: int = 40, depth: int = 6) -> list[GBTClassificationModel]:
    """Model i has not seen fold i.  df has y, weight, l_id and the features."""
    data = assembled(df.withColumn("_fold", fold("l_id", k)), features).select("features", F.col("y").cast("double").alias("y"), "weight", "_fold").persist()
    try:
        return [trees(rounds, depth, 7 + i).fit(data.filter(F.col("_fold") != i).drop("_fold")) for i in range(k)]
    finally:
        data.unpersist()


def train_classes(df: DataFrame, features: list[str], k: int = 3, rounds: int = 40, depth: int = 6) -> list[GBTClassificationModel]:
    """As ``train_folds``, on classes of rows of equal features, y and fold, which weigh as much as their rows do together.

    A row is counted before anything is kept, so what is kept grows with the classes.  A leaf
    needs as much weight as the least rows of ``trees`` have on average; rounds draw classes, not rows.
    """
    classes = df.groupBy(*features, "y", fold("l_id", k).alias("_fold")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("_n"))
    data = assembled(classes, features).select("features", F.col("y").cast("double").alias("y"), "weight", "_fold", "_n").persist()
    try:
        total = {r["_fold"]: r["n"] for r in data.groupBy("_fold").agg(F.sum("_n").alias("n")).collect()}
        found = []
        for i in range(k):
            model = trees(rounds, depth, 7 + i)
            least = model.getMinInstancesPerNode() / max(1, sum(n for f, n in total.items() if f != i))
            model = model.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(least, 0.49))
            found.append(model.fit(data.filter(F.col("_fold") != i).drop("_fold", "_n")))
        return found
    finally:
        data.unpersist()


def fold_scores(df: DataFrame, models: list, features: list[str], name: str = "p1") -> DataFrame:
    """As ``out_of_fold``, in one pass over df, whose rows stay where they are."""
    data = assembled(df, features).withColumn("_fold", fold("l_id", len(models)))
    for i, m in enumerate(models):
        data = _probability(m, data, f"_p{i}")
    own = F.coalesce(*(F.when(F.col("_fold") == i, F.col(f"_p{i}")) for i in range(len(models))))
    return data.withColumn(name, own).drop("_fold", "features", *(f"_p{i}" for i in range(len(models))))


def _probability(model, data: DataFrame, name: str) -> DataFrame:
    cols = [c for c in data.columns]
    return model.transform(data).select(*cols, vector_to_array("probability")[1].alias(name))


def out_of_fold(df: DataFrame, models: list, features: list[str], name: str = "p1") -> DataFrame:
    """df with each row's score by the model that has not seen its left record."""
    data = assembled(df, features).withColumn("_fold", fold("l_id", len(models)))
    parts = [_probability(m, data.filter(F.col("_fold") == i), name) for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts).drop("_fold", "features")


def mean_score(df: DataFrame, models: list, features: list[str], name: str = "p1") -> DataFrame:
    """df with the mean score of all models, for rows that none has seen."""
    data = assembled(df, features)
    for i, m in enumerate(models):
        data = _probability(m, data, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return data.withColumn(name, mean).drop("features", *(f"_p{i}" for i in range(len(models))))


def importance(models: list, features: list[str]) -> dict[str, float]:
    """Mean importance over folds; a feature's flag counts with it."""
    n = len(features)
    total = dict.fromkeys(features, 0.0)
    for m in models:
        for i, v in zip(m.featureImportances.indices, m.featureImportances.values):
            total[features[int(i) % n]] += float(v) / len(models)
    return total


def fit_isotonic(df: DataFrame, score: str = "p", y: str = "y") -> IsotonicRegressionModel:
    data = df.select(F.col(score).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_c").fit(data)


def calibrate(df: DataFrame, model: IsotonicRegressionModel, score: str = "p") -> DataFrame:
    """score replaced by its calibrated value, clipped outside of what was seen."""
    out = model.transform(df.withColumn("_x", F.col(score).cast("double")))
    return out.withColumn(score, F.col("_c")).drop("_x", "_c")


def save(models: list, path: str) -> None:
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{i}")


def load(path: str, k: int) -> list[GBTClassificationModel]:
    return [GBTClassificationModel.load(f"{path}/{i}") for i in range(k)]


__all__ = ["assembled", "calibrate", "fit_isotonic", "fold", "fold_scores", "importance", "load", "mean_score", "out_of_fold", "sample_weights", "save", "train_classes", "train_folds"]
