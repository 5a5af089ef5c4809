"""Models (N-03 to N-07, A-35): logistic regression by moments, boosted and random trees, with the training contract's checks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .aggregates import score_metrics


def fingerprint(version: str, features: list[str]) -> str:
    """Identity of a feature contract."""
    return hashlib.sha256(json.dumps({"features": features, "version": version}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """N-05: n / (classes * n of class), so that every class weighs the same. Classes are few: their counts are broadcast after a look at their number."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total, k = (counts.agg(F.sum("_c"), F.count(F.lit(1))).first()[i] for i in (0, 1))
    table = counts.select(F.col(label).alias("_of"), (F.lit(total) / (F.lit(k) * F.col("_c"))).alias(name))
    return df.join(F.broadcast(table) if k <= 10_000 else table, F.col(label) == F.col("_of")).drop("_of")


@dataclass
class Logistic:
    """Coefficients of standardised features, the intercept first."""

    features: list[str]
    mean: list[float]
    deviation: list[float]
    weights: list[float]

    def standardised(self) -> list[Column]:
        return [(F.col(f).cast("double") - m) / s for f, m, s in zip(self.features, self.mean, self.deviation, strict=True)]

    def predict(self, df: DataFrame, name: str = "score") -> DataFrame:
        z = sum((w * x for w, x in zip(self.weights[1:], self.standardised(), strict=True)), F.lit(self.weights[0]))
        return df.withColumn(name, 1 / (1 + F.exp(-z)))


def logistic(df: DataFrame, features: list[str], label: str, penalty: float = 1.0, most_steps: int = 30, tolerance: float = 1e-10) -> Logistic:
    """N-03: penalised logistic regression on standardised features, by reweighted least squares.

    Each step is one aggregation to the moments of the weighted features, (p + 1)(p + 4) / 2 sums, which the driver
    solves; rows stay where they are. The intercept is not penalised; features of no spread are divided by 1. Rows with
    a null label or feature take no part.
    """
    rows = df.select(F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    about = rows.agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)]).first()
    model = Logistic(features, [about[f"m{k}"] or 0.0 for k in range(len(features))], [about[f"s{k}"] or 1.0 for k in range(len(features))], [0.0] * (len(features) + 1))
    x = [F.lit(1.0), *model.standardised()]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    ridge = np.diag([0.0] + [penalty] * len(features))
    for _ in range(most_steps):
        scored = model.predict(rows, "_p")
        curve = F.col("_p") * (1 - F.col("_p"))
        sums = scored.agg(*[F.sum(curve * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs], *[F.sum((F.col("_y") - F.col("_p")) * x[i]).alias(f"g{i}") for i in range(len(x))]).first()
        if sums["g0"] is None:
            break
        h = np.zeros((len(x), len(x)))
        for i, j in pairs:
            h[i, j] = h[j, i] = sums[f"h{i}_{j}"]
        w = np.array(model.weights)
        step = np.linalg.solve(h + ridge + 1e-12 * np.eye(len(x)), np.array([sums[f"g{i}"] for i in range(len(x))]) - ridge @ w)
        model.weights = (w + step).tolist()
        if np.abs(step).max() < tolerance:
            break
    return model


def one_against_rest(df: DataFrame, features: list[str], label: str, classes: list[str], edges: list[list[float]] | None = None, weight: str | None = None, **options) -> dict[str, boosting.Boosted]:
    """N-05: a boosted model for each class, missing values as their own bin."""
    edges = edges if edges is not None else boosting.quantile_edges(df, features)
    return {c: boosting.fit(df.withColumn("_is", F.when(F.col(label).isNotNull(), (F.col(label) == c).cast("int"))), features, "_is", edges, weight=weight, **options) for c in classes}


def most_likely(df: DataFrame, models: dict[str, boosting.Boosted], name: str = "predicted") -> DataFrame:
    """The class whose model scores highest, ties alphabetical, with its share of all scores."""
    out = df
    for k, (_, m) in enumerate(sorted(models.items())):
        out = m.predict(out, f"_s{k}")
    scores = [F.col(f"_s{k}") for k in range(len(models))]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    label = F.coalesce(*[F.when(s == best, F.lit(c)) for s, c in zip(scores, sorted(models), strict=True)])
    return out.withColumns({name: label, "confidence": F.try_divide(best, sum(scores[1:], scores[0]))}).drop(*[f"_s{k}" for k in range(len(models))])


def forest(features: list[str], label: str, weight: str | None = None, trees: int = 60, seed: int = 0) -> Pipeline:
    """N-05: a random forest over median-imputed features."""
    filled = [f"_{c}" for c in features]
    prepare = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x")]
    return Pipeline(stages=[*prepare, RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=seed, **({"weightCol": weight} if weight else {}))])


def infer(scored: DataFrame, trust: str, trained_on: str, version: str, features: list[str]) -> DataFrame:
    """N-06: predictions with their trust state; refused if the features are not those of training."""
    if fingerprint(version, features) != trained_on:
        raise ValueError("the model was trained on other features")
    return scored.withColumn("trust", F.lit(trust)).withColumn("may_decide", F.lit(trust == "VALIDATED_MODEL"))


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], label: str, edges: dict[str, list[float]] | None = None, **options) -> DataFrame:
    """A-35: AUC with all feature groups and without each in turn: left_out (null for none), auc, average_precision. A handful of fits, driven from here."""
    out = None
    for left_out in [None, *groups]:
        features = [c for g, cs in groups.items() if g != left_out for c in cs]
        model = boosting.fit(train, features, label, [edges[f] for f in features] if edges else None, **options)
        row = score_metrics(model.predict(test, "_score"), label, "_score").select(F.lit(left_out).cast("string").alias("left_out"), "auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    return out
