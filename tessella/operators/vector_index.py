"""Preparing an index: PCA whitening and view capping."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.search import ship


@dataclass
class Whitening:
    """(x - mean) times the leading components, each scaled to unit variance, then unit length."""

    dim: int
    eps: float = 1e-3
    mean: np.ndarray | None = None
    components: np.ndarray | None = None
    scale: np.ndarray | None = None

    SCHEMA = "mean ARRAY<DOUBLE>, components ARRAY<ARRAY<DOUBLE>>, scale ARRAY<DOUBLE>"

    def fit(self, views: DataFrame) -> Whitening:
        """Moments are summed in the tasks, D * D numbers from each; the eigenvectors of the covariance are found on the driver."""
        ship(views.sparkSession)

        def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, ss = 0, None, None
            for f in frames:
                if len(f):
                    x = np.stack(f["emb"].to_numpy()).astype(np.float64)
                    n, s, ss = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if ss is None else ss + x.T @ x
            if n:
                yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

        rows = views.select("emb").mapInPandas(moments, "n long, s array<double>, ss array<double>").toLocalIterator()
        n, s, ss = 0, 0.0, 0.0
        for r in rows:
            n, s, ss = n + r.n, s + np.array(r.s), ss + np.array(r.ss)
        if not n:
            raise ValueError("whitening needs vectors")
        self.mean = s / n
        d = len(self.mean)
        cov = ss.reshape(d, d) - n * np.outer(self.mean, self.mean)
        eig, vec = np.linalg.eigh(cov / max(n - 1, 1))
        k = min(self.dim, d, n)
        self.components = vec[:, ::-1][:, :k].T.copy()
        top = np.maximum(eig[::-1][:k], 0.0)
        self.scale = 1.0 / np.sqrt(top + self.eps * top.max())
        return self

    def transform(self, views: DataFrame) -> DataFrame:
        if self.components is None:
            raise RuntimeError("whitening is not fitted")
        ship(views.sparkSession)
        state = views.sparkSession.sparkContext.broadcast((self.mean, (self.components * self.scale[:, None]).T))  # D * k numbers

        def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mean, by = state.value
            for f in frames:
                if len(f):
                    y = (np.stack(f["emb"].to_numpy()).astype(np.float64) - mean) @ by
                    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
                    f = f.assign(emb=list(y.astype(np.float32)))
                yield f

        return views.mapInPandas(project, views.schema)

    def state(self) -> dict:
        return {"mean": self.mean.tolist(), "components": self.components.tolist(), "scale": self.scale.tolist()}

    @classmethod
    def of(cls, state: dict) -> Whitening:
        out = cls(len(state["scale"]))
        out.mean, out.components, out.scale = (np.array(state[k], float) for k in ("mean", "components", "scale"))
        return out


def chosen(x: np.ndarray, k: int) -> list[int]:
    """Rows kept of one item's views: the one nearest the centroid, then again and again the one whose nearest kept view is farthest."""
    if len(x) <= k:
        return list(range(len(x)))
    middle = x.mean(axis=0)
    kept = [int(np.argmax(x @ (middle / (np.linalg.norm(middle) + 1e-12))))]
    near = x @ x[kept[0]]
    near[kept[0]] = np.inf
    while len(kept) < k:
        kept.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[kept[-1]])
        near[kept[-1]] = np.inf
    return kept


def cap_views(views: DataFrame, k: int = 4) -> DataFrame:
    """At most k diverse views of each item; items with no more keep all. An item's views (photographs of one product) fit a task."""
    ship(views.sparkSession)

    def cap(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("view_id", kind="stable")
        return f.iloc[sorted(chosen(np.stack(f["emb"].to_numpy()).astype(np.float64), k))]

    return views.groupBy("item_id").applyInPandas(cap, views.schema)


def moments_sql(views: DataFrame) -> DataFrame:
    """The number of views and items: what an index report shows."""
    return views.agg(F.count(F.lit(1)).alias("views"), F.countDistinct("item_id").alias("items"))
