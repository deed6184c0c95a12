"""Scores, calibration, bootstrap and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.exprs import brier, correct, log_loss, mulberry


def scores(y: str = "y", p: str = "p") -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg(log_loss(F.col(y), F.col(p))).alias("log_loss"),
        F.avg(brier(F.col(y), F.col(p))).alias("brier"),
        F.avg(correct(F.col(y), F.col(p))).alias("accuracy"),
        F.avg(p).alias("predicted"),
        F.avg(y).alias("actual"),
    ]


def bins_of_equal_count(df: DataFrame, p: str, tie: str, bins: int = 10) -> DataFrame:
    """bin: rows in the order of p in chunks of ceil(n / bins), the last may be short.

    Ranks come from counts in cells of p, so that no task sorts all rows: only rows of one cell are sorted together.
    """
    cells = df.withColumn("_cell", F.floor(F.col(p) * 4096))
    sizes = cells.groupBy("_cell").agg(F.count("*").alias("_k"))
    start = F.coalesce(F.sum("_k").over(Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_cell", start.alias("_start"), F.sum("_k").over(Window.partitionBy(F.lit(0))).alias("_n"))
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_cell").orderBy(p, tie)) - 1
    return cells.join(starts, "_cell").withColumn("bin", F.floor(rank / F.ceil(F.col("_n") / bins)).cast("long")).drop("_cell", "_start", "_n")


def weighted_moments(x: str, y: str, w: str) -> list[Column]:
    """One pass: RMSE, MAE and correlation of x and y under weights w."""
    sw, sx, sy = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxx, syy, sxy = (F.sum(F.col(w) * F.col(a) * F.col(b)) for a, b in ((x, x), (y, y), (x, y)))
    e = F.col(x) - F.col(y)
    cov, vx, vy = sxy * sw - sx * sy, sxx * sw - sx * sx, syy * sw - sy * sy
    return [F.sqrt(F.try_divide(F.sum(F.col(w) * e * e), sw)).alias("rmse"), F.try_divide(F.sum(F.col(w) * F.abs(e)), sw).alias("mae"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("correlation")]


def pearson(x: str, y: str) -> Column:
    """Correlation of the pairs without nulls; null under three pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n = F.count(F.when(both, 1))
    cov = F.sum(a * b) * n - F.sum(a) * F.sum(b)
    va, vb = F.sum(a * a) * n - F.sum(a) * F.sum(a), F.sum(b * b) * n - F.sum(b) * F.sum(b)
    return F.when((n >= 3) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def cluster_bootstrap(df: DataFrame, cluster: str, delta: str, iterations: int, seed: int) -> DataFrame:
    """Mean of delta in each of `iterations` resamples of whole clusters: iteration, mean_delta.

    Clusters are summed first; draw d of iteration i is number i * clusters + d + 1 of one seeded generator, so all draws are
    independent of each other and of partitioning. Work: iterations x clusters rows of two numbers, which meet the cluster
    sums by an equi-join on the drawn rank.
    """
    sums = df.groupBy(cluster).agg(F.sum(delta).alias("total"), F.count(delta).alias("k"))
    ranked = sums.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(cluster)) - 1).alias("rank"), "total", "k")
    n = ranked.count()
    draws = df.sparkSession.range(iterations * n).select(F.floor(F.col("id") / max(n, 1)).alias("iteration"), F.floor(mulberry(F.lit(seed).cast("long"), F.col("id") + 1) * n).cast("long").alias("rank"))
    return draws.join(ranked, "rank").groupBy("iteration").agg((F.sum("total") / F.sum("k")).alias("mean_delta"))


def index_percentile(values: Column, q: float) -> Column:
    """The element at floor(n * q) of the sorted values."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.floor(F.size(s) * q), F.size(s) - 1).cast("int"))
