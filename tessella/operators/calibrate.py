"""From confidence features to the probability that the best item is right."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.confidence import FEATURES, feature_names
from tessella.operators.search import ship
from tessella.operators.stats import logistic


def standardise(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, dict]:
    """Columns minus their mean over (population standard deviation + 1e-9), and the numbers used."""
    s = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first().asDict()
    return rows.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] + 1e-9) for c in columns}), s


def fold_of(group: str, folds: int):
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(group)), F.lit(folds))


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: knots and values."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order].astype(float), w[order].astype(float)
    u, inv = np.unique(x, return_inverse=True)
    sums, weights = np.bincount(inv, y * w), np.bincount(inv, w)
    blocks: list[list[float]] = []
    for s, n in zip(sums, weights, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return u, np.concatenate([np.full(int(k), s / n) for s, n, k in blocks])


def sigmoid_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: a, b of 1 / (1 + exp(a x + b)), with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    both = logistic(np.concatenate([x, x])[:, None], np.concatenate([np.ones(len(x)), np.zeros(len(x))]), 1e-9, np.concatenate([t, 1 - t]))
    return -float(both[1]), -float(both[0])


@dataclass
class Calibrator:
    """Balanced logistic regression on standardised features in item-disjoint folds; each fold's model is calibrated on the fold it hasn't seen.

    Isotonic from 1000 rows, else sigmoid. Labelled photos are evaluation data: folds are fitted in parallel, one task each, and more than `most`
    rows are an error, as every task gets all of them.
    """

    include_quality: bool = True
    names: list[str] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    models: list[dict] = field(default_factory=list)

    SCHEMA = "names ARRAY<STRING>, mean ARRAY<DOUBLE>, std ARRAY<DOUBLE>, models ARRAY<STRUCT<coef: ARRAY<DOUBLE>, knots: ARRAY<DOUBLE>, values: ARRAY<DOUBLE>, a: DOUBLE, b: DOUBLE>>"

    def fit(self, rows: DataFrame, label: str = "y", group: str | None = "item_id", columns: tuple[str, ...] | None = None, most: int = 500_000) -> Calibrator:
        spark = rows.sparkSession
        ship(spark)
        self.names = list(columns or feature_names(self.include_quality))
        z, s = standardise(rows, self.names)
        self.mean, self.std = [s[f"m_{c}"] for c in self.names], [s[f"s_{c}"] + 1e-9 for c in self.names]
        n = rows.count()
        if n > most:
            raise ValueError(f"{n} labelled rows: more than {most} don't fit the tasks; draw some of them first")
        groups = rows.select(group).distinct().count() if group else 0
        folds = min(5, groups) if groups >= 5 else 3
        by = fold_of(group, folds) if groups >= 5 else F.pmod(F.xxhash64(*self.names), F.lit(folds))
        table = z.withColumn("fold", by.cast("int")).withColumn("y", F.col(label).cast("int")).select("fold", "y", *self.names)
        held = spark.sparkContext.broadcast(table.toPandas())  # labelled photos times 18 numbers
        names, isotonic = self.names, n >= 1000

        def one(frames):
            data = held.value
            for f in frames:
                out = []
                for k in f["id"]:
                    train, test = data[data["fold"] != k], data[data["fold"] == k]
                    if train["y"].nunique() < 2 or not len(test):
                        continue
                    y = train["y"].to_numpy(float)
                    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
                    coef = logistic(train[names].to_numpy(float), y, 1.0, weight)
                    score = coef[0] + test[names].to_numpy(float) @ coef[1:]
                    yt = test["y"].to_numpy(float)
                    if isotonic:
                        knots, values = pool(score, yt, np.ones(len(yt)))
                        out.append((k, coef.tolist(), knots.tolist(), values.tolist(), 0.0, 0.0))
                    else:
                        out.append((k, coef.tolist(), [], [], *sigmoid_fit(score, yt)))
                yield pd.DataFrame(out, columns=["k", "coef", "knots", "values", "a", "b"])

        schema = "k long, coef array<double>, knots array<double>, values array<double>, a double, b double"
        found = spark.range(folds).repartition(folds).mapInPandas(one, schema).orderBy("k").collect()  # one row for each fold
        self.models = [{"coef": r.coef, "knots": r.knots, "values": r["values"], "a": r.a, "b": r.b} for r in found]
        if not self.models:
            raise ValueError("calibration needs both outcomes")
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.std)
        out = np.zeros(len(x))
        for m in self.models:
            score = m["coef"][0] + z @ np.array(m["coef"][1:])
            out += np.interp(score, m["knots"], m["values"]) if m["knots"] else 1 / (1 + np.exp(np.clip(m["a"] * score + m["b"], -700, 700)))
        return out / len(self.models)

    def predict(self, rows: DataFrame, out: str = "p_match") -> DataFrame:
        ship(rows.sparkSession)
        own = self

        @F.pandas_udf("double")
        def p(*columns: pd.Series) -> pd.Series:
            return pd.Series(own.probability(np.stack([c.to_numpy(float) for c in columns], axis=1)))

        return rows.withColumn(out, p(*[F.col(c) for c in self.names]))

    def coefficients(self) -> list[tuple[str, float]]:
        """Mean over the folds, largest first."""
        mean = np.mean([m["coef"][1:] for m in self.models], axis=0)
        return sorted(zip(self.names, map(float, mean), strict=True), key=lambda t: -abs(t[1]))

    def state(self) -> dict:
        return {"names": self.names, "mean": self.mean, "std": self.std, "models": [(m["coef"], m["knots"], m["values"], m["a"], m["b"]) for m in self.models]}

    @classmethod
    def of(cls, state: dict) -> Calibrator:
        return cls(len(state["names"]) == len(FEATURES), state["names"], state["mean"], state["std"], [dict(m) for m in state["models"]])


def training_rows(lookups: DataFrame, absent: DataFrame) -> DataFrame:
    """Positives are queries whose best item was right, negatives queries for items that aren't there; y is 1 and 0."""
    pos = lookups.where("top1 = item_id").withColumn("y", F.lit(1))
    return pos.unionByName(absent.withColumn("y", F.lit(0)), allowMissingColumns=True)


def fit_both(rows: DataFrame, group: str = "item_id") -> tuple[Calibrator, Calibrator, DataFrame]:
    """With and without the photo's own features, and the scores of correct matches for the conformal step."""
    full, plain = Calibrator(True).fit(rows, group=group), Calibrator(False).fit(rows, group=group)
    return full, plain, full.predict(rows.where("y = 1")).select(F.col("p_match").alias("score"))
