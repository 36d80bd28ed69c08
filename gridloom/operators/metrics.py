"""Rates, rank statistics, resampling and threshold search over evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def share(a: Column, b: Column) -> Column:
    """a / b, not a number when both are 0, as floating-point division has it."""
    return F.when((a == 0) & (b == 0), float("nan")).otherwise(a / b)


def prf(tp: Column, predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 with zero guards."""
    p, r = ratio(tp, predicted), ratio(tp, truth)
    return p, r, ratio(2 * p * r, p + r)


def mann_whitney(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """One row, auc: share of (positive, negative) pairs in order, ties half; NULL when a group is empty.

    Values are counted first, so the ordered window runs over distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = F.sum("n").over(Window.orderBy("v")) - F.col("n")
    won = counts.select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("won"))
    return won.agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def roc_auc(df: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """One row, auc, with row weights."""
    w = F.lit(1.0) if weight is None else weight
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(w * F.col(label)).alias("p"), F.sum(w * (1 - F.col(label))).alias("n"))
    below = F.sum("n").over(Window.orderBy("s")) - F.col("n")
    won = counts.select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("won"))
    return won.agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, ap: sum of recall steps times precision, ties grouped."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    falling = Window.orderBy(F.col("s").desc())
    steps = counts.select("p", (F.col("p") * F.sum("p").over(falling) / F.sum("n").over(falling)).alias("part"))
    return steps.agg((F.sum("part") / F.nullif(F.sum("p"), F.lit(0))).alias("ap"))


def ranked(df: DataFrame, by: str, score: str, label: str, weight: str) -> DataFrame:
    """(by, auc, ap, auc_weighted) of each group; windows run over a group's distinct scores."""
    w, y = F.col(weight), F.col(label)
    counts = df.groupBy(by, F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"), F.sum(w * y).alias("wp"), F.sum(w * (1 - y)).alias("wn"))
    up, down = Window.partitionBy(by).orderBy("s"), Window.partitionBy(by).orderBy(F.col("s").desc())
    each = counts.withColumns({"below": F.sum("n").over(up) - F.col("n"), "wbelow": F.sum("wn").over(up) - F.col("wn"), "tp": F.sum("p").over(down), "all": F.sum(F.col("p") + F.col("n")).over(down)})
    auc = lambda p, n, below: F.sum(F.col(p) * (F.col(below) + F.col(n) / 2)) / F.nullif(F.sum(p) * F.sum(n), F.lit(0))
    return each.groupBy(by).agg(auc("p", "n", "below").alias("auc"), (F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.nullif(F.sum("p"), F.lit(0))).alias("ap"), auc("wp", "wn", "wbelow").alias("auc_weighted"))


def errors(difference: Column) -> list[Column]:
    """Aggregates of an error: n, bias, median and mean absolute, RMSE, percent within 1 and 2."""
    size = F.abs(difference)
    return [
        F.count(difference).alias("n"), F.avg(difference).alias("bias"), F.median(size).alias("median_abs"), F.avg(size).alias("mean_abs"), F.sqrt(F.avg(difference * difference)).alias("rmse"),
        (100 * F.avg((size <= 1).cast("double"))).alias("within_1"), (100 * F.avg((size <= 2).cast("double"))).alias("within_2"),
    ]


def resamples(df: DataFrame, tile: str, draws: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(rep, sums): block bootstrap; ``draws`` is (rep, tile), ``df`` the sums per tile."""
    return draws.join(df, tile).groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums])


def interval(value: str) -> list[Column]:
    """95 % interval by linear percentiles, NULLs left out."""
    return [F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high")]


def sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """(threshold, groups, f1) for every threshold: each row is sent to the thresholds it passes."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    counted = df.select(*groups, score, label, grid).groupBy("threshold", *groups).agg(
        F.count_if((F.col(score) >= F.col("threshold")) & (F.col(label) == 1)).alias("tp"), F.count_if(F.col(score) >= F.col("threshold")).alias("predicted"), F.sum(label).alias("truth")
    )
    return counted.select("threshold", *groups, prf(F.col("tp"), F.col("predicted"), F.col("truth"))[2].alias("f1"))


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by falling size, each to the emptiest fold; ties by smaller group and fold.

    Only one count for each group comes to the driver.
    """
    sizes = df.groupBy(group).count().orderBy(F.col("count").desc(), group).collect()
    filled, out = [0] * folds, []
    for row in sizes:
        fold = min(range(folds), key=lambda f: (filled[f], f))
        filled[fold] += row["count"]
        out.append((row[group], fold))
    return df.sparkSession.createDataFrame(out, df.select(group).schema.add("fold", IntegerType()))


def dealt_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold, n): groups by falling size, dealt to the folds in turn; the window runs over one row for each group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col(group).asc_nulls_last()))
    return sizes.select(group, ((turn - 1) % folds).cast("int").alias("fold"), "n")


def pixel_scores(df: DataFrame, keep: Column, totals: DataFrame, by: str = "quadrant") -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) from candidates' scored_px and fp_px; ``totals`` (by, truth) has all scored pixels."""
    part = lambda c: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0)).cast("long")
    sums = df.groupBy(by).agg(part("scored_px").alias("tp"), part("fp_px").alias("fp")).join(totals, by)
    p, r, f1 = prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("truth"))
    return sums.select(by, "tp", "fp", (F.col("truth") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def greedy_rule(scores: Sequence[tuple[float, float]], start: float, gain: float = 1e-6) -> tuple[float | None, float]:
    """(rule, score): rules in order, each taken only if it beats the best so far by more than ``gain``; None is no rule."""
    rule, best = None, start
    for own, score in scores:
        if score > best + gain:
            rule, best = own, score
    return rule, best
