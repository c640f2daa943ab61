"""Reports, filters, joins and set operations over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import measures as M
from mensura.functions.catalog import feature_catalog
from mensura.operators import reports as P
from mensura.operators.storage import stored
from mensura.plans import fixtures as X
from mensura.plans.measure_queries import _TARGETS, _strict

AUDITED = {"interlayer_spacing": "interlayer_spacing_nm", "flake_size": "flake_size_um", "porosity": "porosity_pct", "mass_loading": "mass_loading_mg_cm2"}
COLS = ["doi", "mxene_formula", "synthesis_method", "electrolyte", "layer_no", "interlayer_spacing", "flake_size", "porosity"]


#: Of one electrode: the test, its conditions and the results, each with its unit.
_MEASURED = ("scan_rate", "current_density", "gravimetric_capacitance", "volumetric_capacitance", "areal_capacitance")
KEYS = ["source_file", "electrode_id", "test_type", *(c for f in _MEASURED for c in (f, f"{f}__unit"))]


def strict_measurements(spark, d):
    return M.normalize_strict(X.measurements(spark, d))


def coverage(spark, d):
    return P.coverage(X.electrodes(spark, d), COLS)


def column_audit(spark, d):
    return P.column_audit(X.electrodes(spark, d), COLS)


def profiles(spark, d):
    """Profiles kept for each year of the papers, and merged: the sketch is right to some percent, and exact where values are few."""
    rows = X.electrodes(spark, d)
    kept = stored(P.column_profile(rows, COLS, ["year"]), "profiles")
    sure = P.column_audit(rows, COLS).withColumnRenamed("n_distinct", "sure")
    out = P.merged_profile(kept).join(sure.select("column", "sure"), "column")
    return out.select("column", "filled", "missing_pct", F.col("sure").alias("n_distinct"), (F.abs(F.col("n_distinct") - F.col("sure")) <= 0.05 * F.col("sure")).alias("near"))


def confidence_breakdown(spark, d):
    return P.confidence_breakdown(X.electrodes(spark, d), ["interlayer_spacing"])


def confidence_filter(spark, d):
    return P.confidence_filter(X.electrodes(spark, d), "interlayer_spacing", ids=["electrode_id"])


def rows_per_group(spark, d):
    return P.rows_per_group(X.electrodes(spark, d), "source_file", 5)


def electrodes_per_paper(spark, d):
    return P.distinct_per_group(X.measurements(spark, d), "source_file", "electrode_id")


def group_size_stats(spark, d):
    return P.group_size_stats(X.electrodes(spark, d), "source_file")


def oversized(spark, d):
    return P.oversized(X.electrodes(spark, d), "source_file", 10)


def oversized_measurements(spark, d):
    """The first ten papers of more than 60 measurements."""
    return P.oversized(X.measurements(spark, d), "source_file", 60, 10)


def value_counts(spark, d):
    return P.value_counts(X.measurements(spark, d), "scan_rate__unit")


def target_summary(spark, d):
    return P.target_summary(M.normalize_lenient(X.measurements(spark, d)), {"gravimetric_capacitance_F_g": "F g-1", "volumetric_capacitance_F_cm3": "F cm-3", "areal_capacitance_mF_cm2": "mF cm-2"})


def target_coverage(spark, d):
    return P.target_coverage(X.measurements(spark, d), ["gravimetric_capacitance", "areal_capacitance"])


def condition_subset(spark, d):
    return P.condition_subset(strict_measurements(spark, d), "capacitance_F_g", "scan_rate_mV_s", ["electrode_id", "measurement_id"])


def condition_subset_gcd(spark, d):
    return P.condition_subset(strict_measurements(spark, d), "capacitance_F_g", "current_density_A_g", ["electrode_id", "measurement_id"])


def usable_counts(spark, d):
    return P.usable_counts(strict_measurements(spark, d), "capacitance_F_g", {"cv": "scan_rate_mV_s", "gcd": "current_density_A_g"})


def conversion_audit(spark, d):
    return P.conversion_audit(M.normalize_strict(X.electrodes(spark, d)), AUDITED, ["electrode_id"])


def contrast(spark, d):
    return P.within_paper_contrast(M.normalize_strict(X.electrodes(spark, d)), "interlayer_spacing_nm").select("source_file", F.round("control", 6).alias("control"), F.round("variant", 6).alias("variant"), (F.round("difference", 6) + 0.0).alias("difference"))


def dedupe(spark, d):
    return P.dedupe_measurements(X.measurements(spark, d), KEYS)


def upper_median(spark, d):
    return P.upper_median(X.electrodes(spark, d).groupBy("source_file").agg(F.count(F.lit(1)).alias("n")), "n")


def distinct_papers(spark, d):
    return X.electrodes(spark, d).agg(F.count_distinct("doi").alias("dois"), F.count_distinct("source_file").alias("papers"))


def union_tables(spark, d):
    """Rows of the two tables stacked by name; what one lacks is null."""
    e = X.electrodes(spark, d).select("source_file", "electrode_id", "role")
    m = X.measurements(spark, d).select("source_file", "electrode_id", "test_type")
    return e.unionByName(m, allowMissingColumns=True).groupBy("role", "test_type").agg(F.count(F.lit(1)).alias("n"))


def paper_slice(spark, d):
    """The rows of the paper that comes first by hash."""
    return P.paper_slice(X.electrodes(spark, d), "source_file").select("source_file", "electrode_id", "role")


def catalog_coverage(spark, d):
    return P.catalog_coverage(X.electrodes(spark, d), ["mxene_formula", "synthesis_method", "layer_no", "interlayer_spacing", "flake_size", "porosity"], feature_catalog(spark))


def informative(spark, d):
    rows = X.electrodes(spark, d).select("electrode_id", *COLS, F.lit("same").alias("constant"), F.lit(None).cast("string").alias("missing"))
    return P.drop_uninformative(rows, [*COLS, "constant", "missing"])


def covered_features(spark, d):
    rows = X.electrodes(spark, d).select("electrode_id", *COLS, F.lit(None).cast("string").alias("missing"))
    return rows.select("electrode_id", *P.min_coverage_features(rows, [*COLS, "missing"], 10))


def first_record(spark, d):
    """The first electrode of every paper."""
    first = F.min(F.struct("electrode_id", "electrode_label", "role")).alias("first")
    return X.electrodes(spark, d).groupBy("source_file").agg(first).select("source_file", "first.*")


QUERIES = {f.__name__: f for f in (coverage, column_audit, profiles, confidence_breakdown, confidence_filter, rows_per_group, electrodes_per_paper, group_size_stats, oversized, oversized_measurements, value_counts, target_summary, target_coverage, condition_subset, condition_subset_gcd, usable_counts, conversion_audit, contrast, dedupe, upper_median, distinct_papers, union_tables, paper_slice, catalog_coverage, informative, covered_features, first_record)}

_CSM = f"cs AS (SELECT *, {_strict(('scan_rate', 'current_density', 'gravimetric_capacitance'))} FROM m)"
_CSE = f"ce AS (SELECT *, {_strict(('interlayer_spacing', 'flake_size', 'porosity', 'mass_loading'))} FROM e)"


def _sql(body, *more):
    return X.sql("").rstrip() + "".join(f", {m}" for m in more) + " " + body


def _each(template):
    return " UNION ALL ".join(template.format(c=c) for c in COLS)


SQL = {
    "coverage": _sql("SELECT \"column\", filled, pct, CASE WHEN pct >= 60 THEN 'usable' WHEN pct >= 30 THEN 'marginal' ELSE 'sparse' END AS status FROM (" + _each("SELECT '{c}' AS \"column\", count({c}) AS filled, round(100 - round(100 * (1 - count({c}) / count(*)), 1), 1) AS pct FROM e") + ")"),
    "column_audit": _sql(_each("SELECT '{c}' AS \"column\", count({c}) AS filled, round(100 * (1 - count({c}) / count(*)), 1) AS missing_pct, count(DISTINCT {c}) AS n_distinct FROM e")),
    "profiles": _sql(_each("SELECT '{c}' AS \"column\", count({c}) AS filled, round(100 * (1 - count({c}) / count(*)), 1) AS missing_pct, count(DISTINCT {c}) AS n_distinct, TRUE AS near FROM e")),
    "confidence_breakdown": _sql("SELECT 'interlayer_spacing' AS field, count(*) FILTER (WHERE interlayer_spacing__conf = 'stated') AS stated, count(*) FILTER (WHERE interlayer_spacing__conf = 'derived') AS derived, count(*) FILTER (WHERE interlayer_spacing__conf = 'uncertain') AS uncertain, count(*) FILTER (WHERE interlayer_spacing__conf = 'derived') > count(*) FILTER (WHERE interlayer_spacing__conf = 'stated') AS \"check\" FROM e WHERE interlayer_spacing IS NOT NULL"),
    "confidence_filter": _sql("SELECT electrode_id, interlayer_spacing FROM e WHERE interlayer_spacing__conf = 'stated'"),
    "rows_per_group": _sql("SELECT source_file, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, source_file LIMIT 5"),
    "electrodes_per_paper": _sql("SELECT source_file, count(DISTINCT electrode_id) AS n FROM m GROUP BY 1"),
    "group_size_stats": _sql("SELECT median(n) AS median, max(n) AS max, min(n) AS min, count(*) AS groups FROM (SELECT count(*) AS n FROM e GROUP BY source_file)"),
    "oversized": _sql("SELECT source_file, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 10"),
    "oversized_measurements": _sql("SELECT source_file, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 60 ORDER BY n DESC, source_file LIMIT 10"),
    "value_counts": _sql("SELECT scan_rate__unit AS value, count(*) AS n FROM m GROUP BY 1"),
    "target_summary": _sql(" UNION ALL ".join(f"SELECT '{t}' AS target, '{u}' AS unit, count(*) AS n_rows, count(DISTINCT source_file) AS papers, min({t}) AS least, median({t}) AS median, max({t}) AS most FROM tm WHERE {t} IS NOT NULL" for t, u in (("gravimetric_capacitance_F_g", "F g-1"), ("volumetric_capacitance_F_cm3", "F cm-3"), ("areal_capacitance_mF_cm2", "mF cm-2"))), f"tm AS (SELECT source_file, {_TARGETS} FROM m)"),
    "target_coverage": _sql("SELECT 'gravimetric_capacitance' AS target, count(gravimetric_capacitance) AS n_rows, count(DISTINCT source_file) FILTER (WHERE gravimetric_capacitance IS NOT NULL) AS papers FROM m UNION ALL SELECT 'areal_capacitance', count(areal_capacitance), count(DISTINCT source_file) FILTER (WHERE areal_capacitance IS NOT NULL) FROM m"),
    "condition_subset": _sql("SELECT electrode_id, measurement_id, scan_rate_mV_s, capacitance_F_g FROM cs WHERE capacitance_F_g IS NOT NULL AND scan_rate_mV_s IS NOT NULL", _CSM),
    "usable_counts": _sql("SELECT count(capacitance_F_g) AS target, count(*) FILTER (WHERE capacitance_F_g IS NOT NULL AND scan_rate_mV_s IS NOT NULL) AS cv, count(*) FILTER (WHERE capacitance_F_g IS NOT NULL AND current_density_A_g IS NOT NULL) AS gcd FROM cs", _CSM),
    "condition_subset_gcd": _sql("SELECT electrode_id, measurement_id, current_density_A_g, capacitance_F_g FROM cs WHERE capacitance_F_g IS NOT NULL AND current_density_A_g IS NOT NULL", _CSM),
    "conversion_audit": _sql("SELECT electrode_id, interlayer_spacing, interlayer_spacing__unit, interlayer_spacing_nm, flake_size, flake_size__unit, flake_size_um, porosity, porosity__unit, porosity_pct, mass_loading, mass_loading__unit, mass_loading_mg_cm2 FROM ce WHERE coalesce(interlayer_spacing_nm, flake_size_um, porosity_pct, mass_loading_mg_cm2) IS NOT NULL", _CSE),
    "contrast": _sql("SELECT source_file, round(c, 6) AS control, round(v, 6) AS variant, round(v - c, 6) + 0.0 AS difference FROM (SELECT source_file, avg(interlayer_spacing_nm) FILTER (WHERE role = 'control') AS c, avg(interlayer_spacing_nm) FILTER (WHERE role = 'variant') AS v FROM ce GROUP BY 1) WHERE c IS NOT NULL AND v IS NOT NULL", _CSE),
    "dedupe": _sql("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source_file, electrode_id, test_type, scan_rate, scan_rate__unit, current_density, current_density__unit, gravimetric_capacitance, gravimetric_capacitance__unit, volumetric_capacitance, volumetric_capacitance__unit, areal_capacitance, areal_capacitance__unit ORDER BY measurement_id, measurement_label, is_representative) AS k FROM m) WHERE k = 1"),
    "upper_median": _sql("SELECT n AS upper_median FROM (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS c FROM (SELECT count(*) AS n FROM e GROUP BY source_file)) WHERE r = c // 2 + 1"),
    "distinct_papers": _sql("SELECT count(DISTINCT doi) AS dois, count(DISTINCT source_file) AS papers FROM e"),
    "union_tables": _sql("SELECT role, test_type, count(*) AS n FROM (SELECT role, NULL AS test_type FROM e UNION ALL SELECT NULL, test_type FROM m) GROUP BY ALL"),
    "informative": _sql("SELECT electrode_id, " + ", ".join(COLS) + " FROM e"),
    "covered_features": _sql("SELECT electrode_id, " + ", ".join(COLS) + " FROM e"),
    "first_record": _sql("SELECT source_file, electrode_id, electrode_label, role FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY electrode_id) AS k FROM e) WHERE k = 1"),
    "catalog_coverage": _sql(" UNION ALL ".join(f"SELECT {t} AS tier, '{c}' AS \"column\", count({c}) AS filled, round(100 - round(100 * (1 - count({c}) / count(*)), 1), 1) AS pct FROM e" for c, t in (("mxene_formula", "'core'"), ("synthesis_method", "'core'"), ("layer_no", "NULL"), ("interlayer_spacing", "'core'"), ("flake_size", "'core'"), ("porosity", "'extended'")))),
    "paper_slice": _sql("SELECT source_file, electrode_id, role FROM e WHERE source_file = (SELECT source_file FROM e ORDER BY md5(source_file || ':42') LIMIT 1)"),
}
