"""Penalised trees against plain ones by definition, side by side against alone, Shapley values against all subsets."""

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.operators import boosting as B
from mensura.operators import regression as G
from mensura.operators.storage import stored
from mensura.plans import model_queries as Q

WHOLE = {"rows": 1.0, "columns": 1.0}


def plain_score(g, n, s):
    return max(abs(g) - s["l1"], 0) ** 2 / (n + s["l2"]) if n + s["l2"] else 0.0


def plain_value(g, n, s):
    return -math.copysign(max(abs(g) - s["l1"], 0), g) / (n + s["l2"]) if n + s["l2"] else 0.0


def plain_tree(rows, numeric, categorical, s, depth):
    """rows: (features, gradient). A split is tried at every value, with missing ones on either side."""
    g, n = sum(r[1] for r in rows), len(rows)
    best = (1e-9, None)
    for f in numeric if depth else ():
        known = sorted({r[0][f] for r in rows if r[0][f] is not None} | ALL[f])
        for missing, t in itertools.product((False, True), known):
            left = [r for r in rows if (missing if r[0][f] is None else r[0][f] <= t)]
            best = tried(best, rows, left, g, n, s, ("n", f, t, missing))
    for f in categorical if depth else ():
        for v in [None, *sorted({x for x in ALL[f]})]:
            best = tried(best, rows, [r for r in rows if r[0][f] == v], g, n, s, ("c", f, v, False))
    if best[1] is None:
        return s["step"] * plain_value(g, n, s)
    kind, f, t, missing = best[1]
    goes = lambda x: (missing if x[f] is None else x[f] <= t) if kind == "n" else x[f] == t
    sides = [[r for r in rows if goes(r[0]) is side] for side in (True, False)]
    return goes, *(plain_tree(side, numeric, categorical, s, depth - 1) for side in sides)


def tried(best, rows, left, g, n, s, what):
    lg, ln = sum(r[1] for r in left), len(left)
    if ln < max(1, s["least"]) or n - ln < max(1, s["least"]):
        return best
    gain = (plain_score(lg, ln, s) + plain_score(g - lg, n - ln, s) - plain_score(g, n, s)) / 2 - s["gamma"]
    return (gain, what) if gain > best[0] + 1e-9 else best


def plain_predict(tree, x):
    while isinstance(tree, tuple):
        tree = tree[1] if tree[0](x) else tree[2]
    return tree


def plain_fit(rows, numeric, categorical, s):
    base = sum(y for _, y in rows) / len(rows)
    predicted, trees = [base] * len(rows), []
    for _ in range(s["trees"]):
        trees.append(plain_tree([(x, p - y) for (x, y), p in zip(rows, predicted, strict=True)], numeric, categorical, s, s["depth"]))
        predicted = [p + plain_predict(trees[-1], x) for (x, _), p in zip(rows, predicted, strict=True)]
    return predicted


ALL = {}


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(9)
    rows = []
    for i in range(240):
        x = {"a": draw.choice([None, 1.0, 2.0, 3.0, 5.0, 8.0]), "b": draw.choice([0.0, 10.0, 20.0, None, None]), "c": draw.choice([None, "k'", "l", "m", "l"])}
        y = (x["a"] or 4) * 7 + (30 if x["c"] == "l" else 0) + (x["b"] or 3) * draw.random() + draw.random() * 5
        rows.append((i, f"p{i % 12}", x["a"], x["b"], x["c"], float("nan") if i == 3 and x["b"] is None else None, round(y, 3), i % 12 % 4))
    for c, j in (("a", 2), ("b", 3), ("c", 4)):
        ALL[c] = {r[j] for r in rows if r[j] is not None}
    df = spark.createDataFrame(rows, "id int, paper string, a double, b double, c string, none double, y double, fold int")
    return stored(df.repartition(3), "boosting")


def pairs(data, where=None):
    return [({c: r[c] for c in "abc"}, r["y"], r["id"]) for r in sorted((data if where is None else data.where(where)).collect(), key=lambda r: r["id"])]


@pytest.mark.parametrize("setting", [{}, {"l1": 40.0}, {"l2": 60.0}, {"gamma": 300.0}, {"least": 50}, {"depth": 1, "step": 1.0}, {"depth": 3, "l1": 5.0, "l2": 3.0, "gamma": 2.0}])
def test_by_definition(data, setting):
    s = B.setting_of("strict", **WHOLE, **({"trees": 4, "step": 0.5, "depth": 2, "l1": 0.0, "l2": 0.0, "least": 1} | setting))
    model = B.fit(data, ["a", "b", "none"], ["c"], "y", **s)
    assert "none" not in model.bins.names  # nothing but nulls and a value that is no number
    want = plain_fit([(x, y) for x, y, _ in pairs(data)], ["a", "b"], ["c"], s)
    got = [r["predicted"] for r in B.predict(model, data, floor=None).orderBy("id").collect()]
    assert got == pytest.approx(want, abs=1e-4)


def test_penalties_change_splits_as_the_formula_says(spark):
    """Two groups of gradients: the split is kept until the penalty passes the gain."""
    rows = [(float(i % 2), 10.0 if i % 2 else 0.0) for i in range(40)]
    df = stored(spark.createDataFrame(rows, "x double, y double"), "two")
    one = lambda **s: B.fit(df, ["x"], [], "y", trees=1, step=1.0, depth=1, **WHOLE, **({"l1": 0.0, "l2": 0.0, "gamma": 0.0} | s))
    # sides of 20 rows with gradient sums of 100 and -100; the gain is (100^2 / 20) * 2 / 2 = 500
    assert one().gain[0, 0] == pytest.approx(500) and one(gamma=499.0).feature[0, 0] == 0 and one(gamma=501.0).feature[0, 0] == -1
    assert one(l2=5.0).gain[0, 0] == pytest.approx(100**2 / 25) and one(l2=5.0).value[0, 1:].tolist() == pytest.approx([-100 / 25, 100 / 25])
    assert one(l1=40.0).value[0, 1:].tolist() == pytest.approx([-60 / 20, 60 / 20]) and one(l1=101.0).feature[0, 0] == -1
    assert one(least=21).feature[0, 0] == -1


def test_side_by_side_as_alone(spark, data):
    numeric, categorical = ["a", "b"], ["c"]
    bins = B.fit_bins(data, numeric, categorical)
    settings = [B.setting_of("strict", trees=5), B.setting_of("lenient", trees=3, depth=4, least=1), B.setting_of("gcd", trees=7, rows=0.65)]
    other = B.Frame(stored(data.where("id < 150").withColumnRenamed("y", "z"), "other"), bins, "z", "fold")
    frames, models = [B.Frame(data, bins, "y", "fold"), other], [B.Model(f, s, out) for f in (0, 1) for s in settings for out in (None, 0, 2)]
    together, errors = B.fit_all(frames, models)
    for m, model, error in zip(models[::4], together[::4], errors[::4], strict=True):
        (alone,), (other_error,) = B.fit_all([frames[m.frame]], [B.Model(0, m.setting, m.out)])
        assert json.loads(alone.to_json()) == json.loads(model.to_json()) and other_error == pytest.approx(error)
    again, _ = B.fit_all([B.Frame(stored(data.repartition(11), "dealt"), bins, "y", "fold")], [models[1]])
    assert json.loads(again[0].to_json()) == json.loads(together[1].to_json())  # however rows are dealt
    each, each_errors = B.fit_each(frames, models)
    assert [json.loads(t.to_json()) for t in each] == [json.loads(t.to_json()) for t in together]  # by levels over all rows or within a task
    assert each_errors == [pytest.approx(e) for e in errors]
    few, _ = B.fit_each(frames, models[:1], most_rows=60)
    assert 10 < few[0].rows[0, 0] < 80  # of a sample, of which 0.8 are drawn for a tree


def test_folds_beat_the_median_and_stay_apart(data):
    setting = B.setting_of("strict", trees=12, step=0.4)
    bins = B.fit_bins(data, ["a", "b"], ["c"], rare=2)
    oof = B.oof_predict_all({"y": (data, bins, 4)}, "fold", setting)["y"]
    row = G.target_metrics(oof, "y", "y", "u", 3, "paper").first()
    assert row.n == 240 and row.papers == 12 and row.beats_baseline and not row.exploratory
    _, errors = B.fit_each([B.Frame(data, bins, "y", "fold")], [B.Model(0, setting, k) for k in range(4)])
    by_fold = {r["fold"]: (r["e"], r["n"]) for r in oof.groupBy("fold").agg(F.sum("absolute_error").alias("e"), F.count("*").alias("n")).collect()}
    assert [by_fold[k] for k in range(4)] == [pytest.approx(e, rel=1e-6) for e in errors]
    changed = stored(data.withColumn("y", F.when(F.col("fold") == 1, F.col("y") + 1000).otherwise(F.col("y"))), "changed")
    one = lambda df: B.fit_all([B.Frame(df, bins, "y", "fold")], [B.Model(0, B.setting_of(trees=5, rows=1.0), 1)])[0][0].value
    assert np.allclose(one(data), one(changed), atol=1e-4)  # what is left out is not learnt from


def test_search(data):
    bins = B.fit_bins(data, ["a", "b"], ["c"])
    settings = B.drawn_settings(6, grid={"trees": (2, 4, 8), "depth": (1, 2), "step": (0.1, 0.3)})
    assert len({json.dumps(s) for s in settings}) == 6 and settings == B.drawn_settings(6, grid={"trees": (2, 4, 8), "depth": (1, 2), "step": (0.1, 0.3)})
    model, best, tried_, (extra,) = B.search(data, bins, "y", 4, "paper", settings, extra=[B.setting_of(trees=3)])
    assert best == min(tried_, key=lambda t: t[1])[0] and len(tried_) == 6 and all(share == 1 for *_, share in tried_)
    assert json.loads(model.to_json())["value"] == json.loads(B.fit_all([B.Frame(data.withColumn("_part", F.col("fold")), bins, "y", "_part")], [B.Model(0, best)])[0][0].to_json())["value"]
    assert len(extra.feature) == 3
    _, halved, tried_, _ = B.search(data, bins, "y", 4, "paper", settings, papers=(0.5, 1.0))
    assert sorted(share for *_, share in tried_) == [0.5] * 3 + [1.0] * 3
    assert halved == min((t for t in tried_ if t[2] == 1), key=lambda t: t[1])[0]
    with pytest.raises(ValueError, match="no such setting"):
        B.setting_of(maxIter=3)


def test_shapley_values(spark):
    draw = random.Random(4)
    rows = [tuple(draw.choice([None, 0.0, 1.0, 2.0]) for _ in range(4)) + (draw.choice(["u", "v", None]),) for _ in range(300)]
    rows = [(*r, (r[0] or 0) * (r[1] or 1) * 9 + (r[2] or 2) ** 2 + (7 if r[4] == "u" else 0) * (r[3] or 0) + draw.random()) for r in rows]
    df = stored(spark.createDataFrame(rows, "a double, b double, c double, d double, e string, y double"), "shap")
    model = B.fit(df, list("abcd"), ["e"], "y", trees=12, step=0.3, depth=4, least=1)
    explained = B.explain(model, df).collect()
    names = model.bins.names

    def known_by(tree, node, x, known):
        """What a tree says where only some features are known."""
        f = model.feature[tree][node]
        if f < 0:
            return model.value[tree][node]
        below = [known_by(tree, 2 * node + k, x, known) for k in (1, 2)]
        if names[f] in known:
            return below[0] if model.sides(x, tree, np.array([node]))[0] else below[1]
        return sum(b * model.rows[tree][2 * node + k] for k, b in zip((1, 2), below, strict=True)) / model.rows[tree][node]

    game = lambda x, known: model.base + sum(known_by(t, 0, x, known) for t in range(12))
    for r in explained[:25]:
        x = model.bins.of(pd.DataFrame([{n: r[n] for n in names}]))
        assert r["base_value"] + sum(r["phi"].values()) == pytest.approx(r["predicted"]) == pytest.approx(model.predict(x)[0])
        for n in names:
            others, value = [m for m in names if m != n], 0.0
            for k in range(5):
                for known in itertools.combinations(others, k):
                    value += math.factorial(k) * math.factorial(4 - k) / math.factorial(5) * (game(x, {*known, n}) - game(x, set(known)))
            assert r["phi"][n] == pytest.approx(value, abs=1e-9)
    ranked = B.mean_attributions(B.explain(model, df)).collect()
    assert {r["feature"] for r in ranked} == set(names) and [r["mean_abs"] for r in ranked] == sorted((r["mean_abs"] for r in ranked), reverse=True)


def test_saved_model_predicts_alike(spark, data, tmp_path):
    model = B.fit(data, ["a", "b"], ["c"], "y", trees=5)
    B.save_trees(spark, model, str(tmp_path), {"target": "y"})
    again = B.load_trees(spark, str(tmp_path))
    assert again.facts == {"target": "y"} and again.setting == model.setting
    new = data.limit(20).withColumn("c", F.lit("never seen"))
    assert str(B.predict(again, new).collect()) == str(B.predict(model, new).collect())  # a value is no number
    shares = B.importance(again)
    assert sum(v for _, v in shares) == pytest.approx(1) and {n.split("=")[0] for n, _ in shares} <= {"a", "b", "c"}
    loss = {r.feature: r.loss for r in G.permutation_importance(lambda df: B.predict(again, df), data.withColumn("flat", F.lit(1)), ["a", "flat"], "y").collect()}
    assert loss["a"] > 0.1 and abs(loss["flat"]) < 1e-9


def test_corners(spark, data):
    with pytest.raises(ValueError, match="no feature"):
        B.fit(data, ["none"], [], "y")
    with pytest.raises(ValueError, match="no category"):
        B.fit_bins(spark.range(3000).select(F.col("id").cast("string").alias("c")), [], ["c"])
    few = B.fit_bins(data.union(data.limit(1).withColumn("c", F.lit("once"))), [], ["c"], rare=2)
    assert few.categorical["c"] == sorted(ALL["c"])
    rows = stored(data.withColumn("y", F.when(F.col("id") % 3 == 0, F.col("y"))), "some")  # rows without a target are left out
    assert B.fit(rows, ["a"], [], "y", trees=1, **WHOLE).rows[0, 0] == 80
    hot = stored(spark.range(500).select(F.lit(1.0).alias("x"), F.lit("t").alias("c"), F.lit(2.5).alias("y")), "alike")  # all rows alike
    assert {r["predicted"] for r in B.predict(B.fit(hot, ["x"], ["c"], "y", trees=3), hot).collect()} == {2.5}


def test_queries_ask_for_the_whole_job(spark, monkeypatch):
    """Every model that the registered queries hand on; a tree each is grown instead."""
    sf, asked = "/root/testdata/sf0.001", []

    def spied(whole):
        def fitter(frames, models, *more):
            asked.append((list(frames), list(models)))
            return whole(frames, [B.Model(m.frame, m.setting | {"trees": 1}, m.out) for m in models], *more)

        return fitter

    for name in ("fit_all", "fit_each"):
        monkeypatch.setattr(B, name, spied(getattr(B, name)))
    got = {r.target: r for r in Q.gbt_by_target(spark, sf).collect()}
    assert got.keys() == {"gravimetric_capacitance_F_g", "volumetric_capacitance_F_cm3", "areal_capacitance_mF_cm2"} and all(r.n for r in got.values())
    (frames, models), = asked
    assert [(m.frame, m.out) for m in models] == [(0, k) for k in range(5)] + [(1, k) for k in range(5)] + [(2, k) for k in range(4)]
    assert all(m.setting == B.PRESETS["lenient"] for m in models)
    assert all(len(f.bins.names) >= 15 and {"concentration_basis", "layer_category", "measurement_mode"} & set(f.bins.categorical) for f in frames)
    asked.clear()
    assert Q.gbt_holdout(spark, sf).count() == 3
    (frames, models), = asked
    assert {*Q.PHYSICAL, "scan_rate_mV_s", *Q.CATEGORICAL} == set(frames[0].bins.names)
    searched = [m.setting for m in models if m.out == 0]
    assert len(searched) == 20 and len({json.dumps(s) for s in searched}) == 20 and all(s[k] in B.GRID[k] for s in searched for k in B.GRID)
    assert len(models) == 20 * 5 + 20 + 1 and models[-1].setting == B.PRESETS["strict"]
    asked.clear()
    assert Q.gbt_gcd(spark, sf).count() == 2 and asked[0][1][0].setting == B.PRESETS["gcd"] and "current_density_A_g" in asked[0][0][0].bins.names


def test_copies_cost_no_vectors_and_sums_stay_exact():
    """A block keeps bins, sides and predictions by vector of bins, not by row; sums by joint codes are those by row."""
    draw = np.random.default_rng(3)
    binned = draw.integers(0, 4, (60_000, 6)).astype(np.uint16)
    target, part, hashes = draw.integers(0, 900, 60_000) + 0.125, np.zeros(60_000, np.int32), draw.integers(0, 2**62, 60_000).astype(np.uint64)
    block = B._packed(B.Rows(binned, target, part, hashes), 0, 1, 2.0**20)
    assert block.columns.shape == (6, 4**6) and block.predicted.shape == (1, 4**6) and sorted(f for features, _, _ in block.codes for f in features) == list(range(6))
    models, growing = [B.Model(0, B.setting_of("lenient", rows=1.0))], B._Growing.blank(1, 7)
    growing.feature[0, 0], growing.bin[0, 0], growing.missing[0, 0] = 2, 1, True
    (table,) = B._table(block, models, [0], growing, 1, 0, 42, block.scale, [(6, np.arange(0, 28, 4))])
    for side, rows in enumerate((binned[:, 2] <= 1, binned[:, 2] > 1)):
        for f in range(6):
            for b in range(4):
                hit = rows & (binned[:, f] == b)
                assert table[side, 4 * f + b].tolist() == [-int((target[hit] * 2**20).sum()), hit.sum()]
    large = np.array([2**60, 2**60 + 1, 5, -(2**59) - 3])
    assert B._added_up(np.array([0, 0, 1, 1]), large, 2).tolist() == [2**61 + 1, 2 - 2**59]


def test_a_large_table_is_fitted_whole(spark, monkeypatch):
    """More labelled rows than were once sampled: in a task, by levels, and with a vector that most rows share."""
    n = 1_300_000
    df = spark.range(n).select(F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(7).cast("double").alias("x"), (F.col("id") % 50 * 3.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold"), "id")
    df = stored(df, "large")
    frame, setting = B.Frame(df, B.fit_bins(df, ["x"], []), "y", "fold"), B.setting_of("lenient", trees=2, rows=1.0)
    models = [B.Model(0, setting), B.Model(0, setting | {"rows": 0.8}, 1)]
    each, errors = B.fit_each([frame], models)
    assert each[0].rows[:, 0].tolist() == [n, n] and errors[1][1] == len(range(1, n, 3))
    assert each[1].rows[0, 0] == pytest.approx(0.8 * (n - errors[1][1]), rel=0.01)
    monkeypatch.setattr(B, "TASK_BYTES", 10_000_000)
    called, fit_all = [], B.fit_all
    monkeypatch.setattr(B, "fit_all", lambda *a: called.append(len(a[1])) or fit_all(*a))
    levels, level_errors = B.fit_each([frame], models)
    assert called == [2] and [t.to_json() for t in levels] == [t.to_json() for t in each] and level_errors == [pytest.approx(e) for e in errors]
    sizes = B._rows(frame, 8).map(lambda r: len(r.target)).collect()
    assert len(sizes) == 8 and max(sizes) < n / 4  # though one vector has three quarters of the rows


@pytest.mark.parametrize("name", ["gbt_by_target", "gbt_cv_folds", "gbt_final", "gbt_holdout", "gbt_importance", "gbt_permutation", "gbt_shapley"])
def test_queries_fit_on_all_rows_of_tables_beyond_a_task(spark, monkeypatch, name):
    """With tables too large for a task, every model of a query is grown on all rows of its frame, as in a task."""
    for preset in B.PRESETS:
        monkeypatch.setitem(B.PRESETS, preset, B.PRESETS[preset] | {"trees": 1, "rows": 1.0})
    monkeypatch.setattr(B, "GRID", B.GRID | {"trees": (1,), "rows": (1.0,)})
    asked, fit_all = [], B.fit_all

    def spied(frames, models, *more):
        asked.append((frames, models, *fit_all(frames, models, *more)))
        return asked[-1][2:]

    monkeypatch.setattr(B, "fit_all", spied)
    monkeypatch.setattr(B, "TASK_BYTES", 0)
    assert Q.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    monkeypatch.setattr(B, "TASK_BYTES", 1 << 40)
    (frames, models, trees, errors), = asked
    for i, frame in enumerate(frames):
        n = {r["part"]: r["n"] for r in frame.df.where(F.col(frame.target).isNotNull()).groupBy(F.col(frame.part).alias("part")).agg(F.count("*").alias("n")).collect()}
        whole = sum(v for part, v in n.items() if part >= 0)
        for model, tree, (_, tested) in zip(models, trees, errors, strict=True):
            if model.frame == i:
                left = n.get(model.out, 0)
                assert tree.rows[0, 0] == whole - left > 0 and tested == left
    each, each_errors = B.fit_each(frames, models)
    grown = lambda ts: [{k: v for k, v in json.loads(t.to_json()).items() if k != "facts"} for t in ts]
    assert grown(each) == grown(trees) and each_errors == [pytest.approx(e) for e in errors]
