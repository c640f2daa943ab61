"""Validation grouped by paper, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reports import grouped_median, join_by_value, running_counts
from .storage import stored


def group_fold(group: Column, k: int, seed: int = 42) -> Column:
    """A fold per group from the first 8 hex digits of its hash: no shuffle, no window."""
    return (F.conv(F.substring(F.md5(F.concat(group.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % k).cast("int")


def split_summary(df: DataFrame, y: str, group: str, split: str = "split", digits: int = 6) -> DataFrame:
    """Per side of a split: rows, groups, mean and median of the target."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("papers"), F.round(F.avg(y), digits).alias("mean"), F.median(y).alias("median"))


def shared_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups on both sides of a split: none, if it is sound."""
    side = lambda name: df.where(F.col(split) == name).select(group)
    return side("test").intersect(side("train"))


def parity_bounds(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: the least and the most of observed and predicted values."""
    return df.agg(F.least(F.min(y), F.min(p)).alias("lower"), F.greatest(F.max(y), F.max(p)).alias("upper"))


def fold_count(df: DataFrame, group: str, k: int) -> int:
    """min(k, groups); an error where there are fewer than two groups."""
    n = df.select(group).distinct().limit(k).count()
    if n < 2:
        raise ValueError(f"folds by {group} need two groups at least, there are {n}")
    return min(k, n)


def group_holdout(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split: whole groups in hash order, the first ceil(share * n) of them are test; null is a group of its own.

    Groups are ranked within 4,096 ranges of their hash, and a small table of the ranges says how many lie before each.
    """
    own = F.coalesce(F.col("_group").cast("string"), F.lit("\0"))
    groups = df.select(F.col(group).alias("_group")).distinct().select("_group", F.md5(F.concat(own, F.lit(f":{seed}"))).alias("h"))
    groups = groups.withColumn("range", F.substring("h", 1, 3))
    ranges = groups.groupBy("range").agg(F.count(F.lit(1)).alias("own"))
    ranges = ranges.select("range", (F.sum("own").over(W.orderBy("range")) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy()).alias("n"))  # 4,096 rows at most
    place = F.col("before") + F.row_number().over(W.partitionBy("range").orderBy("h", "_group"))
    ranked = groups.join(F.broadcast(ranges), "range").select("_group", F.when(place <= F.ceil(F.col("n") * share), "test").otherwise("train").alias("split"))
    return df.join(ranked, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def balanced_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """(group, size, fold): whole groups dealt by size, the largest first, to and fro over the folds, so that folds differ by no more
    rows than the largest group has. Groups of one size go in hash order; null is a group of its own.

    Ranks come from counts: of groups by size (few sizes: n groups of different sizes have n * n / 2 rows), and within a size by range of
    the hash; only within a range are groups ordered.
    """
    own = F.coalesce(F.col(group).cast("string"), F.lit("\0"))
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_h", F.md5(F.concat(own, F.lit(f":{seed}"))))
    groups = stored(groups.withColumn("_range", F.substring("_h", 1, 3)), "sizes")
    ranges = groups.groupBy("size", "_range").agg(F.count(F.lit(1)).alias("_own"))
    sizes = ranges.groupBy("size").agg(F.sum("_own").alias("_all"))
    sizes = sizes.select(F.col("size").alias("_size"), (F.sum("_all").over(W.orderBy(F.desc("size"))) - F.col("_all")).alias("_larger"))
    within = F.sum("_own").over(W.partitionBy("size").orderBy("_range")) - F.col("_own")  # 4,096 rows a size at most
    ranges = ranges.select("size", "_range", within.alias("_before")).join(sizes, F.col("size") == F.col("_size")).select("size", "_range", (F.col("_larger") + F.col("_before")).alias("_first"))
    place = F.col("_first") + F.row_number().over(W.partitionBy("size", "_range").orderBy("_h", group)) - 1
    turn, at = F.floor(place / k) % 2, place % k
    return groups.join(ranges, ["size", "_range"]).select(group, "size", F.when(turn == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def median_baseline(df: DataFrame, y: str, fold: str, k: int, exact: bool = True) -> DataFrame:
    """Per fold the median of the target outside it, exact or by percentile_approx. A row counts for each fold but its own; equal targets
    of a fold are counted before."""
    if not exact:
        one = df.agg(*(F.percentile_approx(F.when(F.col(fold) != i, F.col(y)), 0.5).alias(f"m{i}") for i in range(k)))
        return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("fold"), F.col(f"m{i}").alias("median_baseline")) for i in range(k)))).alias("r")).select("r.*")
    others = F.explode(F.array(*(F.lit(i) for i in range(k)))).alias("_out")
    rows = df.select(F.col(fold).alias("_fold"), F.col(y).alias("_y"), others).where(F.col("_fold") != F.col("_out"))
    medians = grouped_median(rows, ["_out"], "_y", "median_baseline")
    folds = df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    return folds.join(F.broadcast(medians), F.col("fold") == F.col("_out"), "left").select("fold", "median_baseline")  # k rows


FEW = 100_000  # rows of means that are broadcast


def oof_group_mean(df: DataFrame, y: str, fold: str, by: str, name: str = "predicted") -> DataFrame:
    """df with an out-of-fold prediction: the mean target of the rows of like `by` in the other folds, null where there are none. df should
    be a written table: it is read twice. Means are broadcast where there are few of them, as kinds may be hot."""
    sums = df.groupBy(by, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))  # a row for each kind and fold
    rest = lambda c: F.sum(c).over(W.partitionBy(by)) - F.col(c)
    means = stored(sums.select(F.col(by).alias("_by"), F.col(fold).alias("_fold"), (rest("s") / F.nullif(rest("n"), F.lit(0))).alias(name)), "means")
    means = F.broadcast(means) if means.count() <= FEW else means
    return df.join(means, F.col(by).eqNullSafe(F.col("_by")) & (F.col(fold) == F.col("_fold")), "left").drop("_by", "_fold")


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    e, yc = F.col(y) - F.col(p), F.col(y)
    sst = F.var_pop(yc) * F.count(yc)  # around the mean: sums of squares of large targets would cancel
    return df.groupBy(*(by or [])).agg(
        F.count(yc).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2")
    )


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: the correlation of the ranks, ties averaged, of rows that have both; null where either does not vary.

    Distinct pairs with their numbers of rows are written once; ranks are centred, so that sums stay exact. A value that stands in many
    pairs gets its rank by broadcast.
    """
    both = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    pairs = stored(both, "pairs")
    rank = lambda c: running_counts(pairs, c, "n").select(F.col("v").alias("_v"), F.col("rows").alias("_rows"), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))
    rows = join_by_value(join_by_value(pairs, "y", rank("y"), "_v", "_rows"), "p", rank("p"), "_v", "_rows")
    rows = rows.join(F.broadcast(pairs.agg(((F.sum("n") + 1) / 2).alias("mean"))))  # one row
    a, b, n = F.col("ry") - F.col("mean"), F.col("rp") - F.col("mean"), F.col("n")
    return rows.agg((F.sum(n * a * b) / F.nullif(F.sqrt(F.sum(n * a * a) * F.sum(n * b * b)), F.lit(0.0))).alias("spearman"))


def residual_histogram(df: DataFrame, residual: str) -> DataFrame:
    """Bins between least and most residual: min(12, max(5, n div 5))."""
    r = F.col(residual)
    facts = df.agg(F.min(r).alias("low"), F.max(r).alias("high"), F.least(F.lit(12), F.greatest(F.lit(5), F.expr("count(1) div 5"))).cast("int").alias("bins"))
    rows = df.select(r.alias("r")).join(F.broadcast(facts))  # one row
    bin_ = F.least(F.floor((F.col("r") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * F.col("bins")) + 1, F.col("bins"))
    return rows.groupBy(F.coalesce(bin_, F.lit(1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def prediction_table(df: DataFrame, ids: list[str], y: str, p: str) -> DataFrame:
    return df.select(*ids, F.col(y).alias("observed"), F.col(p).alias("predicted"), F.abs(F.col(y) - F.col(p)).alias("absolute_error"))
