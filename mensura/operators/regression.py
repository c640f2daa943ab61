"""Preparation of features and boosted trees on pyspark.ml, and what is said of any model's predictions.

Penalised trees, grown side by side for all folds and settings, are in boosting.py; the pipeline here is for users of pyspark.ml's own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .splits import regression_metrics, spearman

#: The settings of the three models (trees, step, depth, rows a leaf, share of rows).
PRESETS = {
    "strict": {"maxIter": 400, "stepSize": 0.03, "maxDepth": 3, "minInstancesPerNode": 3, "subsamplingRate": 0.8},
    "gcd": {"maxIter": 250, "stepSize": 0.03, "maxDepth": 2, "minInstancesPerNode": 3, "subsamplingRate": 0.8},
    "lenient": {"maxIter": 400, "stepSize": 0.03, "maxDepth": 2, "minInstancesPerNode": 4, "subsamplingRate": 0.8},
}
WIDEST = 10_000  # values of a category that the vector has a place for


def split_dtypes(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns, by type; columns that are neither are left out."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = [(c, t) for c, t in df.dtypes if cols is None or c in cols]
    return [c for c, t in types if t in numeric or t.startswith("decimal")], [c for c, t in types if t in ("string", "boolean")]


def _facts(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """The numeric columns that have a value, and the most frequent value of each categorical one, the least of equals; all in one
    aggregate, of which one row comes to the driver."""
    if not numeric and not categorical:
        return [], {}
    row = df.agg(*(F.count(c).alias(c) for c in numeric), *(F.mode(F.col(c).cast("string"), True).alias(c) for c in categorical)).first()
    return [c for c in numeric if row[c]], {c: "" if row[c] is None else row[c] for c in categorical}


def preprocess(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], rare: int = 1) -> list:
    """Stages from raw columns to the vector `features`: medians and missing flags, modes and one-hot codes.

    Numeric columns without any value give no feature. Categories seen fewer than `rare` times, or never, share a code,
    however many there are; more frequent ones than WIDEST are an error, as each takes a place in the vector.
    """
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    numeric, modes = _facts(df, numeric, categorical)
    new = [f"CAST(`{c}` AS DOUBLE) AS `n_{c}`" for c in numeric] + [f"CAST(`{c}` IS NULL AS DOUBLE) AS `miss_{c}`" for c in numeric]
    new += [f"coalesce(CAST(`{c}` AS STRING), {quoted(m)}) AS `c_{c}`" for c, m in modes.items()]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(new)} FROM __THIS__")]
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=[f"n_{c}" for c in numeric], outputCols=[f"i_{c}" for c in numeric]))
    if categorical:
        if rare > 1:
            pooled = []
            for c in categorical:
                # what the encoder may know: values seen often enough; their number bounds the width of the vector anyway
                seen = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {int(rare)} AND v IS NOT NULL")
                values = [r.v for r in seen.limit(WIDEST + 1).collect()]
                if len(values) > WIDEST:
                    raise ValueError(f"{c}: more than {WIDEST} frequent values; it is no category")
                known = f"`c_{c}` IN ({', '.join(map(quoted, [*values, modes[c]]))})"
                pooled.append(f"CASE WHEN {known} THEN `c_{c}` ELSE '__rare__' END AS `r_{c}`")
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(pooled)} FROM __THIS__"))
        source = "r" if rare > 1 else "c"
        stages.append(StringIndexer(inputCols=[f"{source}_{c}" for c in categorical], outputCols=[f"x_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"x_{c}" for c in categorical], outputCols=[f"h_{c}" for c in categorical], handleInvalid="keep", dropLast=False))
    inputs = [f"i_{c}" for c in numeric] + [f"miss_{c}" for c in numeric] + [f"h_{c}" for c in categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def gbt_pipeline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, preset: str = "strict", rare: int = 1, seed: int = 42, **settings) -> Pipeline:
    """Preprocessing and boosted trees; settings override the preset's. A node looks at four fifths of the features."""
    trees = GBTRegressor(labelCol=y, featuresCol="features", predictionCol="predicted", seed=seed, featureSubsetStrategy="0.8", **{**PRESETS[preset], **settings})
    return Pipeline(stages=[*preprocess(df, numeric, categorical, rare), trees])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with predicted, never below zero."""
    return model.transform(df).select(*df.columns, F.greatest(F.lit(0.0), F.col("predicted")).alias("predicted"))


def holdout_metrics(df: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], y: str, split: str = "split") -> DataFrame:
    """Metrics on the test rows: the median of the training rows and each model. models: name -> what adds `predicted` to rows."""
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    base = test.join(F.broadcast(train.agg(F.median(y).cast("double").alias("predicted"))))  # one row
    rows = [regression_metrics(base, y, "predicted").withColumn("model", F.lit("median baseline"))]
    rows += [regression_metrics(scored(test), y, "predicted").withColumn("model", F.lit(name)) for name, scored in models.items()]
    return reduce(DataFrame.unionByName, rows).select("model", "n", "mae", "rmse", "r2")


def target_metrics(oof: DataFrame, y: str, target: str, unit: str, features: int, group: str = "source_file") -> DataFrame:
    """One row: out-of-fold metrics, the baseline's error and whether the model is below it; exploratory under 30 rows."""
    own = regression_metrics(oof, y, "predicted")
    base = regression_metrics(oof, y, "median_baseline").select(F.col("mae").alias("baseline_mae"))
    papers = oof.agg(F.count_distinct(group).alias("papers"))
    out = own.join(base).join(papers).join(spearman(oof, y, "predicted"))  # one row each
    beats, few = F.col("mae") < F.col("baseline_mae"), F.col("n") < 30
    return out.select(F.lit(target).alias("target"), F.lit(unit).alias("unit"), "n", "papers", F.lit(features).alias("features"), "mae", "rmse", "r2", "spearman", "baseline_mae", beats.alias("beats_baseline"), few.alias("exploratory"))


def feature_importance(model: PipelineModel, transformed: DataFrame, top: int | None = None) -> DataFrame:
    """Importance by the name of the vector's slot, most first; the names come from the vector's metadata."""
    trees = model.stages[-1]
    groups = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for attrs in groups.values() for a in attrs}
    rows = [(names.get(i, f"slot {i}"), float(v)) for i, v in enumerate(trees.featureImportances.toArray())]
    out = transformed.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out if top is None else out.limit(top)


def permutation_importance(scored: Callable[[DataFrame], DataFrame], df: DataFrame, cols: Sequence[str], y: str, seed: int = 42) -> DataFrame:
    """How much the mean absolute error grows when one column is dealt to other rows, most first. scored adds `predicted` to rows.

    Values move within blocks of about a million rows: rows are numbered per block in two seeded orders and joined by block
    and number, so no task holds more than one block. df should be a written table, read alike every time.
    """
    blocks = df.count() // 1_000_000 + 1
    rows = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
    whole = scored(df).agg(F.avg(F.abs(F.col(y) - F.col("predicted"))).alias("whole"))
    out = []
    for i, c in enumerate(cols):
        left = rows.drop(c).withColumn("_n", F.row_number().over(W.partitionBy("_block").orderBy("_id")))
        right = rows.select("_block", c, F.row_number().over(W.partitionBy("_block").orderBy(F.xxhash64("_id", F.lit(seed + i)))).alias("_n"))
        dealt = scored(left.join(right, ["_block", "_n"]).select(*df.columns))
        out.append(dealt.agg(F.lit(c).alias("feature"), F.avg(F.abs(F.col(y) - F.col("predicted"))).alias("mae")))
    return reduce(DataFrame.unionByName, out).join(whole).select("feature", (F.col("mae") - F.col("whole")).alias("loss")).orderBy(F.desc("loss"), "feature")
