"""Calibrated confidence: Platt curves by group, and how far confidence is from accuracy."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import logit, sigmoid

# Fixed values.
LEAST_SAMPLES, LEAST_GROUP = 20, 40


def group_key(e: Column) -> Column:
    names = F.when(F.size(F.coalesce(e["detectors"], F.array().cast("array<string>"))) > 0, e["detectors"]).otherwise(F.array(e["source"]))
    return F.concat(F.array_join(F.array_sort(names), "+"), F.lit("|"), e["type"])


@dataclass
class Calibrator:
    """Curves (slope, intercept) by group; groups without one keep their scores."""

    slope: float = 1.0
    intercept: float = 0.0
    fitted: bool = False
    groups: dict[str, tuple[float, float]] = field(default_factory=dict)
    min_group_samples: int = LEAST_GROUP

    def curves(self) -> Column:
        """The curves as one literal map; detectors times kinds bound it."""
        if not self.groups:
            return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<slope:double,intercept:double>>"))
        return F.create_map(*[x for k, (a, b) in self.groups.items() for x in (F.lit(k), F.struct(F.lit(a).alias("slope"), F.lit(b).alias("intercept")))])

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.slope, self.intercept, self.fitted, self.min_group_samples, json.dumps({k: list(v) for k, v in self.groups.items()}))]
        spark.createDataFrame(row, "slope double, intercept double, fitted boolean, min_group_samples int, groups string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibrator:
        """What `save` wrote; without a file, a calibrator that changes nothing."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return cls()
        r = spark.read.schema("slope double, intercept double, fitted boolean, min_group_samples int, groups string").json(path).first()
        return cls(r["slope"], r["intercept"], r["fitted"], {k: tuple(v) for k, v in json.loads(r["groups"]).items()}, r["min_group_samples"])


def apply(entities: Column, calibrator: Calibrator) -> Column:
    curves = calibrator.curves()

    def one(e):
        key = group_key(e)
        c = F.try_element_at(curves, key)
        has = c.isNotNull()
        on = has if calibrator.fitted else F.lit(False)
        score = F.when(on, sigmoid(c["slope"] * logit(e["score"]) + c["intercept"])).otherwise(e["score"])
        e = e.withField("raw_score", F.round(e["score"], 4)).withField("score", score).withField("calibration_group", key)
        return e.withField("calibrated", F.lit(calibrator.fitted)).withField("group_calibrated", has)

    return F.transform(entities, one)


def histogram(samples: DataFrame, *keys: str) -> DataFrame:
    """(score, correct, ...) -> counts of equal scores: what the fits read, far smaller than the samples."""
    s = samples.select(*keys, F.round("score", 6).alias("score"), F.col("correct").cast("double").alias("correct"))
    return s.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("correct").alias("right"))


def fit_groups(samples: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """(score, correct, group) -> (group, n, slope, intercept) of groups with enough samples."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, right = pdf["n"].sum(), pdf["right"].sum()
        if n < max(least, LEAST_SAMPLES):
            return pd.DataFrame(columns=["group", "n", "slope", "intercept"])
        if right in (0, n):
            rate = min(max(right / n, 0.02), 0.98)
            curve = (0.0, float(np.log(rate / (1 - rate))))
        else:
            p = pdf["score"].clip(1e-6, 1 - 1e-6).to_numpy()
            curve = platt(np.log(p / (1 - p)), pdf["n"].to_numpy(float), pdf["right"].to_numpy(float))
        return pd.DataFrame([(pdf["group"].iloc[0], int(n), *curve)], columns=["group", "n", "slope", "intercept"])

    return histogram(samples, "group").groupBy("group").applyInPandas(one, "group string, n long, slope double, intercept double")


def platt(x: np.ndarray, n: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, ridge 1 on the slope, by Newton's method: n samples at each x, `right` of them correct."""
    w = np.zeros(2)
    m = np.stack((x, np.ones_like(x)), axis=1)
    ridge = np.diag([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(m @ w)))
        grad = m.T @ (n * p - right) + ridge @ w
        step = np.linalg.solve((m * (n * p * (1 - p))[:, None]).T @ m + ridge + 1e-12 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def fit_global(samples: DataFrame) -> DataFrame:
    """(slope, intercept, fitted, n): one curve for all samples; unfitted below 20 samples or with one outcome."""
    whole = samples.select("score", "correct").withColumn("group", F.lit("all"))
    curve = fit_groups(whole, LEAST_SAMPLES).select("slope", "intercept", "n")
    both = samples.agg((F.min(F.col("correct").cast("int")) != F.max(F.col("correct").cast("int"))).alias("both"))
    fitted = F.coalesce("both", F.lit(False)) & F.col("n").isNotNull()
    return both.join(curve, how="left", on=F.lit(True)).select(F.when(fitted, F.col("slope")).otherwise(1.0).alias("slope"), F.when(fitted, F.col("intercept")).otherwise(0.0).alias("intercept"), fitted.alias("fitted"), F.coalesce("n", F.lit(0)).alias("n"))


def fit(samples: DataFrame) -> Calibrator:
    g = fit_global(samples).first()
    if not g["fitted"]:
        return Calibrator()
    return Calibrator(g["slope"], g["intercept"], True, {r["group"]: (r["slope"], r["intercept"]) for r in fit_groups(samples).collect()})


def _bin(score: Column, bins: int) -> Column:
    """Bins (lo, hi]: from 1; a score of 0 is in none."""
    edges = [i / bins for i in range(bins + 1)]
    return F.coalesce(*[F.when((score > lo) & (score <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1)])


def reliability_bins(samples: DataFrame, bins: int = 10) -> DataFrame:
    """All bins, empty ones too: bin_lower, bin_upper, count, mean_confidence, accuracy."""
    spark = samples.sparkSession
    counted = samples.withColumn("bin", _bin(F.col("score"), bins)).groupBy("bin").agg(F.count("*").alias("count"), F.avg("score").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), ((F.col("id") - 1) / bins).alias("bin_lower"), (F.col("id") / bins).alias("bin_upper"))
    return every.join(counted, "bin", "left").select("bin_lower", "bin_upper", *[F.coalesce(c, F.lit(0)).alias(c) if c == "count" else F.coalesce(c, F.lit(0.0)).alias(c) for c in ("count", "mean_confidence", "accuracy")])


def calibration_error(samples: DataFrame, bins: int = 10) -> DataFrame:
    """One row (n, ece); without samples 0."""
    b = samples.withColumn("bin", _bin(F.col("score"), bins)).groupBy("bin").agg(F.count("*").alias("k"), F.abs(F.avg(F.col("correct").cast("double")) - F.avg("score")).alias("gap"))
    total = F.sum("k")
    return b.agg(F.coalesce(total, F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("k") * F.col("gap"))) / total, F.lit(0.0)).alias("ece"))


def compare(samples: DataFrame, calibrator: Calibrator) -> DataFrame:
    """n, empirical precision, and the calibration error before, with the global and with the grouped curves."""
    curves = F.try_element_at(calibrator.curves(), F.col("group"))
    z = logit(F.col("score"))
    grouped = F.when(curves.isNotNull() & F.lit(calibrator.fitted), sigmoid(curves["slope"] * z + curves["intercept"])).otherwise(F.col("score"))
    whole = sigmoid(z * calibrator.slope + calibrator.intercept) if calibrator.fitted else F.col("score")
    out = samples.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("precision"))
    for name, score in (("ece_raw", F.col("score")), ("ece_global", whole), ("ece_grouped", grouped)):
        out = out.crossJoin(calibration_error(samples.select(score.alias("score"), "correct")).select(F.col("ece").alias(name)))  # one row each
    return out
