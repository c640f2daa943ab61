"""Boosted trees over the measurements, validated by paper: the documented features, presets, search and folds, whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.functions import features as E
from mensura.functions import measures as M
from mensura.operators import boosting as B
from mensura.operators import regression as G
from mensura.operators import reports as P
from mensura.operators import splits as S
from mensura.operators.storage import scratch, stored
from mensura.plans import fixtures as X

#: Target -> (unit, folds).
TARGETS = {"gravimetric_capacitance_F_g": ("F g-1", 5), "volumetric_capacitance_F_cm3": ("F cm-3", 5), "areal_capacitance_mF_cm2": ("mF cm-2", 4)}
K = 5
SETTINGS = 20
CAPACITANCE = "capacitance_F_g"
#: Descriptors, categories, and for each condition the rows that a descriptor must have.
PHYSICAL = ["interlayer_spacing_nm", "flake_size_um", "porosity_pct", "pore_diameter_nm", "electrode_thickness_um", "mass_loading_mg_cm2", "ssa_m2_g"]
CATEGORICAL = ["role", "layer_class", "material_family", "electrolyte_type"]
CONDITIONS = {"cv": ("scan_rate_mV_s", 10), "gcd": ("current_density_A_g", 8)}
IDS = ["source_file", "electrode_id", "measurement_id"]


def lenient_frames(spark, d) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """For each target its labelled rows with the 25 features, less those that tell nothing there; numeric and categorical ones."""
    rows = stored(X.both(spark, d, lambda df: E.engineered_features(M.normalize_lenient(df))).select(*IDS, *E.FEATURE_VIEW, *TARGETS), "features")
    out = {}
    for target in TARGETS:
        own = P.drop_uninformative(rows.where(F.col(target).isNotNull()).select(*IDS, *E.FEATURE_VIEW, target), E.FEATURE_VIEW)
        out[target] = (own, *G.split_dtypes(own, [c for c in E.FEATURE_VIEW if c in own.columns]))
    return out


def condition_frame(spark, d, kind: str) -> tuple[DataFrame, list[str], list[str]]:
    """Strict rows with target and condition, split by paper, with the folds of the training papers (-1: test); descriptors that
    are known often enough, and the condition; the categories."""
    condition, least = CONDITIONS[kind]
    rows = E.strict_features(X.both(spark, d, M.normalize_strict))
    rows = P.condition_subset(rows, CAPACITANCE, condition, [*IDS, "paper_group", *PHYSICAL, *CATEGORICAL])
    rows = S.group_holdout(rows, "paper_group").withColumn("fold", F.when(F.col("split") == "train", S.group_fold(F.col("paper_group"), K)).otherwise(-1))
    rows = stored(rows, f"frame-{kind}")
    return rows, [*P.min_coverage_features(rows, PHYSICAL, least), condition], CATEGORICAL


def gbt_by_target(spark, d):
    """Out-of-fold metrics of each target beside the median's: 14 models, a task each, or by levels side by side where a table is too large for a task."""
    frames = lenient_frames(spark, d)
    oof = B.evaluate_frames(frames, {t: k for t, (_, k) in TARGETS.items()}, "source_file", stored, fitter=B.fit_each)
    rows = [G.target_metrics(oof[t], t, t, unit, len(frames[t][1]) + len(frames[t][2])) for t, (unit, _) in TARGETS.items()]
    return reduce(DataFrame.unionByName, rows)


def gbt_final(spark, d):
    """The largest importances in each target's model of all rows."""
    frames = lenient_frames(spark, d)
    ready = [B.Frame(stored(df.withColumn("all", F.lit(0)), f"final-{t}"), B.fit_bins(df, numeric, categorical, 2), t, "all") for t, (df, numeric, categorical) in frames.items()]
    models, _ = B.fit_each(ready, [B.Model(i, B.setting_of("lenient")) for i in range(len(ready))])
    rows = [(t, *r) for t, m in zip(frames, models, strict=True) for r in B.importance(m)[:20]]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


def gbt_holdout(spark, d):
    """Test papers, measured by CV: the median, the preset, and the best of twenty drawn settings, searched over folds of the training
    papers: 121 models, grown in the same ways."""
    data, numeric, categorical = condition_frame(spark, d, "cv")
    train = data.where("split = 'train'")
    bins = B.fit_bins(train, numeric, categorical)
    tuned, _, _, (plain,) = B.search(data, bins, CAPACITANCE, K, "paper_group", B.drawn_settings(SETTINGS), extra=[B.setting_of("strict")])
    return G.holdout_metrics(data, {"preset": lambda df: B.predict(plain, df), "tuned": lambda df: B.predict(tuned, df)}, CAPACITANCE)


def _trained(spark, d, kind: str, preset: str, fitter=B.fit_each):
    data, numeric, categorical = condition_frame(spark, d, kind)
    frame = B.Frame(data, B.fit_bins(data.where("split = 'train'"), numeric, categorical), CAPACITANCE, "fold")
    return data, numeric + categorical, fitter([frame], [B.Model(0, B.setting_of(preset))])[0][0]


def gbt_gcd(spark, d):
    """Test papers, measured by GCD: the median and the smaller preset, whose trees grow by levels over all rows."""
    data, _, model = _trained(spark, d, "gcd", "gcd", B.fit_all)
    return G.holdout_metrics(data, {"preset": lambda df: B.predict(model, df)}, CAPACITANCE)


def gbt_cv_folds(spark, d):
    """The preset over folds of all papers, measured by CV: errors of each fold."""
    data, numeric, categorical = condition_frame(spark, d, "cv")
    data = stored(data.withColumn("fold", S.group_fold(F.col("paper_group"), K)), "cv-folds")
    oof = B.oof_predict_all({CAPACITANCE: (data, B.fit_bins(data, numeric, categorical), K)}, "fold", B.setting_of("strict"), fitter=B.fit_each)[CAPACITANCE]
    return S.regression_metrics(oof, CAPACITANCE, "predicted", ["fold"]).orderBy("fold")


def gbt_importance(spark, d):
    """The 25 largest importances in the CV model of the training papers, saved and loaded again."""
    data, features, model = _trained(spark, d, "cv", "strict")
    path = scratch(spark, "model")
    B.save_trees(spark, model, path, {"features": features, "target": CAPACITANCE, "unit": "F g-1"})
    rows = B.importance(B.load_trees(spark, path))[:25]
    return spark.createDataFrame(rows, "feature string, importance double")


def gbt_permutation(spark, d):
    """How much the test papers' error grows when a column is dealt to other rows."""
    data, features, model = _trained(spark, d, "cv", "strict")
    return G.permutation_importance(lambda df: B.predict(model, df), data.where("split = 'test'"), features, CAPACITANCE)


def gbt_shapley(spark, d):
    """Shapley values of the CV model over the test papers: mean size by feature."""
    data, _, model = _trained(spark, d, "cv", "strict")
    return B.mean_attributions(B.explain(model, data.where("split = 'test'")))


QUERIES = {f.__name__: f for f in (gbt_by_target, gbt_final, gbt_holdout, gbt_gcd, gbt_cv_folds, gbt_importance, gbt_permutation, gbt_shapley)}
SQL: dict[str, str] = {}  # fitted models have no SQL form
