"""Boosted trees: validation by paper, saving, importance; and the sources' errors."""

import pytest
from pyspark.sql import functions as F

from mensura.operators import regression as G
from mensura.operators.storage import scratch
from mensura.sources.models import load_model, save_model
from mensura.sources.tables import require_columns, union_files

FEW = {"maxIter": 3}


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("p"), F.col("id") % 20).alias("source_file"), (F.col("id") % 4).cast("int").alias("fold"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 10).cast("double")).alias("x"), F.lit(1.0).alias("flat"),
        F.when(F.col("id") % 5 > 0, F.when(F.col("id") == 1, "once").otherwise(F.concat(F.lit("k'"), F.col("id") % 2))).alias("kind"))
    path = scratch(spark, "frame")
    rows.withColumn("y", F.coalesce(F.col("x") * 10, F.lit(45.0))).write.parquet(path)
    return spark.read.parquet(path)


def test_saved_model_predicts_alike(spark, data):
    model = G.gbt_pipeline(data, ["x", "flat"], ["kind"], "y", **FEW).fit(data)
    path = scratch(spark, "model")
    save_model(spark, model, path, {"target": "y"})
    again, facts = load_model(spark, path)
    assert facts == {"target": "y"}
    new = data.limit(5).withColumn("kind", F.lit("never seen"))
    assert G.predict(again, new).collect() == G.predict(model, new).collect()
    ranked = G.feature_importance(again, again.transform(data)).collect()
    assert ranked[0].feature.endswith("_x")
    loss = {r.feature: r.loss for r in G.permutation_importance(lambda df: G.predict(again, df), data, ["x", "flat"], "y").collect()}
    assert loss["x"] > 1 and abs(loss["flat"]) < 1e-9


def test_columns_without_values_are_left_out(data):
    empty = data.withColumn("none", F.lit(None).cast("double"))
    model = G.gbt_pipeline(empty, ["x", "none"], ["kind"], "y", rare=2, **FEW).fit(empty)
    assert G.predict(model, empty).count() == 300


def test_columns(spark):
    one, two = spark.createDataFrame([("a", None)], "p string, q string"), spark.createDataFrame([("b",)], "p string")
    with pytest.raises(ValueError, match="r, s"):
        require_columns(one, ["p", "r", "s"])
    assert sorted(map(tuple, union_files([one, two]).collect())) == [("a", ""), ("b", "")]
    assert G.split_dtypes(spark.range(1).select("id", F.lit("x").alias("t"))) == (["id"], ["t"])
