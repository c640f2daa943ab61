"""Grouped splits, baselines and metrics over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import splits as S
from mensura.operators.storage import stored
from mensura.plans import fixtures as X
from mensura.plans.measure_queries import _strict
from mensura.plans.report_queries import strict_measurements

K = 5


def labelled(spark, d):
    """Labelled rows with their fold and an out-of-fold prediction. Texts are parsed once and what is needed of them is written."""
    rows = strict_measurements(spark, d).where("capacitance_F_g IS NOT NULL").withColumn("fold", S.group_fold(F.col("source_file"), K))
    rows = stored(rows.select("source_file", "electrode_id", "measurement_id", "current_density__unit", "capacitance_F_g", "fold"), "labelled")
    return S.oof_group_mean(rows, "capacitance_F_g", "fold", "current_density__unit")


def group_folds(spark, d):
    return labelled(spark, d).select("source_file", "fold").distinct()


def balanced_folds(spark, d):
    """Papers dealt by their number of rows."""
    return S.balanced_folds(labelled(spark, d), "source_file", K)


def stricter_folds(spark, d):
    """Groups of paper and electrode."""
    return X.electrodes(spark, d).select("electrode_id", S.group_fold(F.concat_ws(":", "source_file", "electrode_id"), K).alias("fold"))


def holdout(spark, d):
    return S.split_summary(S.group_holdout(labelled(spark, d), "source_file"), "capacitance_F_g", "source_file")


def disjoint(spark, d):
    """Papers on both sides of the split: none."""
    return S.shared_groups(S.group_holdout(labelled(spark, d), "source_file"), "source_file").agg(F.count(F.lit(1)).alias("shared"))


def median_baseline(spark, d):
    return S.median_baseline(labelled(spark, d), "capacitance_F_g", "fold", K)


def metrics_by_fold(spark, d):
    out = S.regression_metrics(labelled(spark, d), "capacitance_F_g", "predicted", ["fold"])
    return out.select("fold", "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")))


def cv_summary(spark, d):
    out = S.regression_metrics(labelled(spark, d), "capacitance_F_g", "predicted", ["fold"])
    return out.agg(*(F.round(f(c), 6).alias(f"{c}_{n}") for c in ("mae", "rmse", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def spearman(spark, d):
    return S.spearman(labelled(spark, d), "capacitance_F_g", "predicted").select(F.round("spearman", 6).alias("spearman"))


def residual_hist(spark, d):
    return S.residual_histogram(labelled(spark, d).withColumn("r", F.col("capacitance_F_g") - F.col("predicted")), "r")


def top_errors(spark, d):
    rows = S.prediction_table(labelled(spark, d), ["electrode_id", "measurement_id", "fold"], "capacitance_F_g", "predicted")
    return rows.orderBy(F.desc("absolute_error"), "electrode_id", "measurement_id", "observed").limit(15)


def parity_bounds(spark, d):
    return S.parity_bounds(labelled(spark, d), "capacitance_F_g", "predicted")


QUERIES = {f.__name__: f for f in (group_folds, balanced_folds, stricter_folds, holdout, disjoint, median_baseline, metrics_by_fold, cv_summary, spearman, residual_hist, top_errors, parity_bounds)}

_FOLD = "CAST(CAST('0x' || substring(md5({g} || ':42'), 1, 8) AS BIGINT) % 5 AS INT)"
_L = f"""f AS (SELECT *, {_FOLD.format(g='source_file')} AS fold, capacitance_F_g AS y FROM (SELECT *, {_strict(('gravimetric_capacitance',))} FROM m) WHERE capacitance_F_g IS NOT NULL),
l AS (SELECT *, (sum(y) OVER u - sum(y) OVER uf) / nullif(count(y) OVER u - count(y) OVER uf, 0) AS predicted FROM f WINDOW u AS (PARTITION BY current_density__unit), uf AS (PARTITION BY current_density__unit, fold))"""
_G = "g AS (SELECT source_file, CASE WHEN row_number() OVER (ORDER BY md5(source_file || ':42'), source_file) <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT source_file FROM l))"
_M = "count(*) AS n, avg(abs(y - predicted)) AS mae, sqrt(avg((y - predicted) ^ 2)) AS rmse, 1 - sum((y - predicted) ^ 2) / (var_pop(y) * count(y)) AS r2"


def _sql(body, *more):
    return X.sql("").rstrip() + "".join(f", {m}" for m in (_L, *more)) + " " + body


SQL = {
    "group_folds": _sql("SELECT DISTINCT source_file, fold FROM l"),
    "balanced_folds": _sql("SELECT source_file, size, CAST(CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS INT) AS fold FROM (SELECT source_file, size, row_number() OVER (ORDER BY size DESC, md5(source_file || ':42'), source_file) - 1 AS place FROM (SELECT source_file, count(*) AS size FROM l GROUP BY 1))"),
    "stricter_folds": X.sql(f"SELECT electrode_id, {_FOLD.format(g='source_file || ' + chr(39) + ':' + chr(39) + ' || CAST(electrode_id AS VARCHAR)')} AS fold FROM e"),
    "holdout": _sql("SELECT split, count(*) AS n, count(DISTINCT source_file) AS papers, round(avg(y), 6) AS mean, median(y) AS median FROM l JOIN g USING (source_file) GROUP BY split", _G),
    "disjoint": _sql("SELECT count(*) AS shared FROM (SELECT source_file FROM g WHERE split = 'test' INTERSECT SELECT source_file FROM g WHERE split = 'train')", _G),
    "median_baseline": _sql(" UNION ALL ".join(f"SELECT CAST({i} AS INT) AS fold, median(y) FILTER (WHERE fold <> {i}) AS median_baseline FROM l" for i in range(K))),
    "metrics_by_fold": _sql("SELECT fold, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM (SELECT fold, " + _M + " FROM l GROUP BY fold)"),
    "cv_summary": _sql("SELECT " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("mae", "rmse", "r2") for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM (SELECT fold, " + _M + " FROM l GROUP BY fold)"),
    "spearman": _sql("SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS a, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS b FROM l)"),
    "residual_hist": _sql("SELECT CAST(least(floor((r - lo) / (hi - lo) * bins) + 1, bins) AS INT) AS bin, count(*) AS n FROM (SELECT y - predicted AS r, min(y - predicted) OVER () AS lo, max(y - predicted) OVER () AS hi, least(12, greatest(5, count(*) OVER () // 5)) AS bins FROM l) GROUP BY 1"),
    "top_errors": _sql("SELECT electrode_id, measurement_id, fold, y AS observed, predicted, abs(y - predicted) AS absolute_error FROM l ORDER BY absolute_error DESC, electrode_id, measurement_id, observed LIMIT 15"),
    "parity_bounds": _sql("SELECT least(min(y), min(predicted)) AS lower, greatest(max(y), max(predicted)) AS upper FROM l"),
}
