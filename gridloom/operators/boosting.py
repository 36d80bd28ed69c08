"""Gradient-boosted trees on histograms, with row weights and missing values, trained fold by fold.

Folds are groups, so they train in parallel; a fold's rows must fit one task (candidates are
few next to pixels). Trees grow leaf by leaf; a missing value takes the side of larger gain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """The reference's model; ``bins`` counts the ends of the quantiles, so 256 are the library's 255 bins."""

    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    penalty: float = 1.0
    bins: int = 256
    least: int = 20


class Booster:
    """Binary classifier; ``probability`` after ``fit``."""

    def __init__(self, settings: Settings = Settings()):
        self.settings = settings

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.int64)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), self.settings.bins, np.searchsorted(edges, x[:, j], side="left"))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Booster:
        s = self.settings
        self.edges = [np.unique(np.nanquantile(x[:, j], np.linspace(0, 1, s.bins)[1:-1])) if np.isfinite(x[:, j]).any() else np.zeros(1) for j in range(x.shape[1])]
        binned = self._binned(x)
        mean = float(np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6))
        self.start, self.trees = float(np.log(mean / (1 - mean))), []
        raw = np.full(len(y), self.start)
        for _ in range(s.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            raw += self._apply(tree, binned)
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple:
        s, best = self.settings, (0.0,)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g**2 / (total_h + s.penalty)
        for j in range(binned.shape[1]):
            b = binned[rows, j]
            gs, hs, ns = (np.bincount(b, weights=w, minlength=s.bins + 1) for w in (g[rows], h[rows], np.ones(len(rows))))
            left_g, left_h, left_n = np.cumsum(gs[:-1]), np.cumsum(hs[:-1]), np.cumsum(ns[:-1])
            for missing_left in (False, True):
                lg, lh, ln = left_g + gs[-1] * missing_left, left_h + hs[-1] * missing_left, left_n + ns[-1] * missing_left
                gain = lg**2 / (lh + s.penalty) + (total_g - lg) ** 2 / (total_h - lh + s.penalty) - base
                gain[(ln < s.least) | (len(rows) - ln < s.least)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-12:
                    best = (float(gain[at]), j, at, missing_left)
        return best

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """Nodes (feature, bin, missing left, left, right) or (value,)."""
        s = self.settings
        nodes: list = [None]
        open_ = [(0, np.arange(len(g)), self._split(binned, g, h, np.arange(len(g))))]
        leaves = 1
        while leaves < s.leaves:
            i = max(range(len(open_)), key=lambda k: open_[k][2][0])
            node, rows, split = open_[i]
            if split[0] <= 0:
                break
            open_.pop(i)
            _, j, at, missing_left = split
            b = binned[rows, j]
            left = np.where(b == s.bins, missing_left, b <= at)
            nodes[node] = (j, at, missing_left, len(nodes), len(nodes) + 1)
            for part in (rows[left], rows[~left]):
                open_.append((len(nodes), part, self._split(binned, g, h, part)))
                nodes.append(None)
            leaves += 1
        for node, rows, _ in open_:
            nodes[node] = (-s.rate * g[rows].sum() / (h[rows].sum() + s.penalty),)
        return nodes

    def _apply(self, tree: list, binned: np.ndarray) -> np.ndarray:
        out = np.empty(len(binned))
        stack = [(0, np.arange(len(binned)))]
        while stack:
            node, rows = stack.pop()
            if len(tree[node]) == 1:
                out[rows] = tree[node][0]
                continue
            j, at, missing_left, left, right = tree[node]
            b = binned[rows, j]
            go = np.where(b == self.settings.bins, missing_left, b <= at)
            stack += [(left, rows[go]), (right, rows[~go])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._apply(t, binned) for t in self.trees))))


def average_precision(y: np.ndarray, score: np.ndarray, weight: np.ndarray) -> float:
    """Step sum of precision over recall, equal scores together."""
    order = np.argsort(-score, kind="stable")
    tp, n = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    last = np.append(np.diff(score[order]) != 0, True)
    tp, n = tp[last], n[last]
    return float(np.sum(np.diff(tp, prepend=0.0) * tp / n) / tp[-1]) if len(tp) and tp[-1] else 0.0


def permutation_importance(df: DataFrame, fold: str, features: Sequence[str], label: str, weight: str, repeats: int = 5, seed: int = 0, settings: Settings = Settings()) -> DataFrame:
    """(feature, mean, least, most): fall of the weighted average precision over folds when a feature of the held-out rows is shuffled."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    rows = df.select(F.col(fold).alias("__own"), F.col(label).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"), *[F.col(f).cast("double").alias(f) for f in features])
    each = rows.withColumn("__fold", F.explode(F.array(*[F.lit(f) for f in folds])))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__own", "__y", "__w", *features])
        held = (group["__own"] == group["__fold"]).to_numpy()
        x, y, w = group[list(features)].to_numpy(dtype=float), group["__y"].to_numpy(), group["__w"].to_numpy()
        if held.all() or not held.any():
            return pd.DataFrame({"feature": [], "fall": []})
        model, rng = Booster(settings).fit(x[~held], y[~held], w[~held]), np.random.default_rng(seed)
        whole, out = average_precision(y[held], model.probability(x[held]), w[held]), []
        for j, name in enumerate(features):
            falls = []
            for _ in range(repeats):
                moved = x[held].copy()
                moved[:, j] = rng.permutation(moved[:, j])
                falls.append(whole - average_precision(y[held], model.probability(moved), w[held]))
            out.append({"feature": name, "fall": float(np.mean(falls))})
        return pd.DataFrame(out)

    falls = each.groupBy("__fold").applyInPandas(run, "feature string, fall double")
    return falls.groupBy("feature").agg(F.avg("fall").alias("mean"), F.min("fall").alias("least"), F.max("fall").alias("most"))


def leave_one_out(df: DataFrame, fold: str, key: str, features: Sequence[str], label: str, weight: str, settings: Settings = Settings()) -> DataFrame:
    """(key, fold, prob): each fold's rows scored by a model of all other folds.

    Every row is sent to each fold's task once; folds are few (quadrants).
    """
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    rows = df.select(key, F.col(fold).alias("__own"), F.col(label).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"), *[F.col(f).cast("double").alias(f) for f in features])
    each = rows.withColumn("__fold", F.explode(F.array(*[F.lit(f) for f in folds])))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held = (group["__own"] == group["__fold"]).to_numpy()
        x = group[list(features)].to_numpy(dtype=float)
        y, w = group["__y"].to_numpy(), group["__w"].to_numpy()
        if held.all() or not held.any():
            return pd.DataFrame({key: group[key][held], fold: group["__own"][held], "prob": np.nan})
        prob = Booster(settings).fit(x[~held], y[~held], w[~held]).probability(x[held])
        return pd.DataFrame({key: group[key][held], fold: group["__own"][held], "prob": prob})

    kinds = dict(df.dtypes)
    return each.groupBy("__fold").applyInPandas(run, f"{key} {kinds[key]}, {fold} {kinds[fold]}, prob double")
