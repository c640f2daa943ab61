"""Hand literals for the scalar functions, and properties of the records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.functions import features as FE
from mensura.functions import measures as M
from mensura.functions import rules as R
from mensura.functions.catalog import feature_catalog
from mensura.operators import records as N
from mensura.operators import reports as P
from mensura.operators import splits as S


def values(spark, cells, make):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", make(F.col("c")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_parse(spark):
    cells = ["~160", "around 280", "1.0 ± 0.1", "3–5", "micrometer-sized", "Ti3C2Tx", None, "", "over 200", "1,250", "-4e2", "5 to 20"]
    assert values(spark, cells, M.parse_lenient) == [160, 280, 1, 4, None, None, None, None, 200, 1, -400, 5]
    assert values(spark, cells, M.parse_strict) == [160, 280, 1, 4, None, 3, None, None, 200, 1250, -400, 12.5]
    assert values(spark, ["over 200", "exceeding 100", "5–100", "7"], lambda c: M.parse_strict(c, "reject", "reject")) == [None, None, None, 7]


def test_parser_examples(spark):
    assert [tuple(r) for r in M.parser_examples(spark).collect()] == [("~160", 160), ("around 280", 280), ("1.0 ± 0.1", 1), ("3–5", 4), ("micrometer-sized", None), ("Ti3C2Tx", None)]


def test_units(spark):
    assert values(spark, ["F g−1", "µg cm−2", "μm", None, "m²/g", "mV·s−1"], M.unit_key) == ["fg-1", "µgcm-2", "µm", "", "m2/g", "mv·s-1"]
    assert values(spark, ["mV·s−1"], lambda c: M.unit_key(c, strip_dot=True)) == ["mvs-1"]
    assert values(spark, ["200 nm to 2 µm", "500"], lambda c: M.flake_size_strict(c, F.lit("nm"))) == [1.1, 0.5]


def test_verdict(spark):
    f = ["Ti₃C₂Tₓ (primary); Ti₂CTₓ (secondary)", "Ti₃C₂Tₓ / MoO₃", "V2C; Ti3C2", "", "Nb2C"]
    assert values(spark, f, R.check_primary) == [True, True, False, None, False]
    cells = ["Not reported (smaller than Cl-MXene)", "n/a", "none", "LiF", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    assert [r["c"] for r in R.scrub_placeholders(df, ["c"]).orderBy("i").collect()] == ["", "", "", "LiF", ""]
    assert values(spark, ["ﬁ Ti₃", "Å"], R.normalise_text_full) == ["fi ti3", "å"]
    for preset, want in (("parity", [True, False, True]), ("fixed", [True, True, True])):
        assert values(spark, ["sulphuric acid", "sulfuric acid", "H₂SO₄"], lambda c, p=preset: R.check_any(c, R.ELECTROLYTE[p])) == want
    for row in [(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (True, False, None)]:
        got = spark.createDataFrame([row], "a boolean, b boolean, c boolean").select(R.overall([F.col(x) for x in "abc"]).alias("v")).first()["v"]
        assert got == ("AMBIGUOUS" if None in row else "PASS" if all(row) else "FAIL")


@pytest.mark.parametrize(("cell", "strict", "lenient"), [(None, "unknown", "missing"), ("1", "single_layer", "mixed_or_other"), ("5", "few_layer", "mixed_or_other"), ("Delaminated", "delaminated", "delaminated"), ("monolayer", "single_or_few", "single"), ("two-layer", "few_layer", "double")])
def test_layers(spark, cell, strict, lenient):
    assert values(spark, [cell], FE.layer_class) == [strict]
    assert values(spark, [cell], FE.layer_category) == [lenient]


def test_field_map_last_wins(spark):
    df = spark.range(1).select(F.array(*(N.item(k, F.lit(v), F.lit(None), F.lit(None)) for k, v in (("a", "1"), ("b", "2"), ("a", "3")))).alias("f"))
    got = df.select(*N.flatten_fields(N.field_map(F.col("f")), ["a", "b", "c"], "none")).first()
    assert tuple(got) == ("3", "2", None)


def test_folds_partition_groups(spark):
    df = spark.range(500).selectExpr("cast(id % 40 as string) as g", "cast(id as double) as y").withColumn("fold", S.group_fold(F.col("g"), 4))
    assert df.select("g", "fold").distinct().count() == 40
    assert {r["fold"] for r in df.select("fold").distinct().collect()} <= {0, 1, 2, 3}
    split = S.group_holdout(df, "g").select("g", "split").distinct()
    assert split.count() == 40 and split.where("split = 'test'").count() == 8


def test_holdout_keeps_null_groups(spark):
    """Null is a group of its own; the first fifth of the groups, rounded up, are test."""
    df = spark.range(900).selectExpr("CASE WHEN id % 30 > 0 THEN cast(id % 30 as string) END AS g", "id")
    out = S.group_holdout(df, "g")
    assert out.count() == 900 and out.columns == ["g", "id", "split"]
    by = {(r["g"], r["split"]) for r in out.select("g", "split").distinct().collect()}
    assert len(by) == 30 and sum(s == "test" for _, s in by) == 6


def test_fold_count(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "g string")
    assert S.fold_count(df, "g", 5) == 3 and S.fold_count(df, "g", 2) == 2
    with pytest.raises(ValueError, match="two groups"):
        S.fold_count(df.where("g = 'a'"), "g", 5)


def test_ranks_and_medians_over_ranges(spark):
    """Ties are averaged and nulls left out, whatever ranges the values fall into."""
    values = [None, 3.5, 3.5, 3.5, -1.0, 7.0, 7.0, 0.0, 1e9, None, *map(float, range(100, 400))]
    df = spark.createDataFrame([(v,) for v in values], "y double")
    known = sorted(v for v in values if v is not None)
    got = {(r["y"], r["r"]) for r in P.average_rank(df, "y", "r").collect()}
    assert got == {(v, None if v is None else sum(x < v for x in known) + (known.count(v) + 1) / 2) for v in values}
    assert P.upper_median(df, "y").first()["upper_median"] == known[len(known) // 2]
    assert P.upper_median(df.limit(0), "y").first()["upper_median"] is None
    assert [r["r"] for r in P.average_rank(df.where("y IS NULL"), "y", "r").collect()] == [None, None]


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text('level,feature,category,tier,description,preferred_unit,literature_basis\nelectrode,binder,fabrication,core,"What binds, if any",,"a; b"\n')
    assert tuple(feature_catalog(spark, str(tmp_path / "c.csv")).first()) == ("electrode", "binder", "fabrication", "core", "What binds, if any", None, "a; b")
    assert feature_catalog(spark).count() == 110


def test_spearman(spark):
    """Against ranks and their correlation worked out plainly; ties, nulls and a constant."""
    rows = [(float(i % 7), float((i * i) % 11)) for i in range(60)] + [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "y double, p double")
    both = [r for r in rows if None not in r]
    rank = lambda values: [sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values]
    a, b = (np.array(rank([r[i] for r in both])) for i in (0, 1))
    assert S.spearman(df, "y", "p").first()["spearman"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert S.spearman(df.withColumn("p", F.lit(1.0)), "y", "p").first()["spearman"] is None
    assert S.spearman(df.limit(0), "y", "p").first()["spearman"] is None


def test_medians_by_selection(spark):
    """Groups of all kinds, one hot in rows and one hot in a value, through brackets as narrow as may be."""
    import random
    import statistics

    from mensura.operators.reports import grouped_median

    draw = random.Random(1)
    rows = [("hot", draw.choice([7.0, draw.gauss(0, 1e6), draw.random()])) for _ in range(3000)] + [("even", float(i)) for i in range(50)] + [("one", 4.0), (None, 1.0), (None, 2.5), ("void", None)]
    rows += [("same", 3.0)] * 400 + [("skew", 10.0 ** draw.uniform(-300, 300)) for _ in range(501)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    want = {g: statistics.median(v) for g, v in want.items()}
    for inside in (1_000_000, 20, 1):
        assert {r["g"]: r["median"] for r in grouped_median(df, ["g"], "v", accuracy=100, inside=inside).collect()} == want
    assert [r["median"] for r in grouped_median(df.where("g = 'even'"), [], "v", inside=5).collect()] == [24.5]
    assert grouped_median(df.where("g = 'void'"), ["g"], "v").collect() == []


def test_ranks_with_a_hot_value(spark):
    """Half of all rows share a value: it goes by broadcast, and the rows are not sent to one task."""
    from mensura.operators.reports import average_rank
    from mensura.operators.storage import stored

    df = stored(spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 5.0).when(F.col("id") % 7 > 0, (F.col("id") % 97).cast("double")).alias("v")), "hot")
    out = average_rank(df, "v", "rank")
    values = sorted(r["v"] for r in df.collect() if r["v"] is not None)
    want = {v: (values.index(v) + 1 + len(values) - values[::-1].index(v)) / 2 for v in set(values)}
    got = out.collect()
    assert len(got) == 4000 and all(r["rank"] == want.get(r["v"]) for r in got)
    text = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text


def test_balanced_folds(spark):
    from mensura.operators.splits import balanced_folds

    rows = [(f"p{i}",) for i in range(60) for _ in range(1 + i * i % 41)] + [(None,)] * 13 + [("big",)] * 200
    out = balanced_folds(spark.createDataFrame(rows, "paper string"), "paper", 4).collect()
    sizes = [sum(r["size"] for r in out if r["fold"] == k) for k in range(4)]
    assert len(out) == 62 and sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 200
    small = balanced_folds(spark.createDataFrame([r for r in rows if r != ("big",)], "paper string"), "paper", 4).collect()
    sizes = [sum(r["size"] for r in small if r["fold"] == k) for k in range(4)]
    assert max(sizes) - min(sizes) <= 41


def test_profiles(spark):
    """Sketches kept in parts and merged are near the exact counts; neither copies rows for each column."""
    from mensura.operators import reports as P

    df = spark.range(20_000).select((F.col("id") % 10).alias("run"), F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("double").alias("few"), F.when(F.col("id") < 0, 1).alias("none"), F.array("id").alias("list"))
    cols = ["many", "few", "none", "list"]
    exact = {r["column"]: r for r in P.column_audit(df, cols).collect()}
    near = {r["column"]: r for r in P.merged_profile(P.column_profile(df, cols, ["run"])).collect()}
    assert [exact[c]["n_distinct"] for c in cols] == [20_000, 3, 0, 20_000]
    for c in cols:
        assert near[c]["filled"] == exact[c]["filled"] and near[c]["missing_pct"] == exact[c]["missing_pct"]
        assert abs(near[c]["n_distinct"] - exact[c]["n_distinct"]) <= 0.05 * exact[c]["n_distinct"]
    assert P.distinct_count(df, "few").first()[0] == 3 and abs(P.distinct_count(df, "many", exact=False).first()[0] - 20_000) < 1000
    for plan in (P.column_audit(df, cols), P.column_profile(df, cols)):
        assert "Expand" not in plan._jdf.queryExecution().toString()
    assert P.drop_uninformative(df.withColumn("flat", F.lit(2)), [*cols[:3], "flat"]).columns == ["run", "many", "few", "list"]


def test_errors_of_large_targets(spark):
    from mensura.operators.splits import regression_metrics

    df = spark.range(100).select((1e9 + F.col("id") * 0.001).alias("y"), (1e9 + F.col("id") * 0.001 + F.when(F.col("id") % 2 == 0, 1e-4).otherwise(-1e-4)).alias("p"))
    assert abs(regression_metrics(df, "y", "p").first()["r2"] - 0.999988) < 1e-6
