"""Numbers, units and features over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import features as FE
from mensura.functions import measures as M
from mensura.plans import fixtures as X

E_FIELDS = ("interlayer_spacing", "flake_size", "porosity", "pore_diameter", "electrode_thickness", "mass_loading", "ssa")
TARGETS = ["gravimetric_capacitance_F_g", "volumetric_capacitance_F_cm3", "areal_capacitance_mF_cm2"]
IDS = ["source_file", "electrode_id", "measurement_id"]


def parse_strict(spark, d):
    g = F.col("gravimetric_capacitance")
    return X.measurements(spark, d).select(*IDS, M.parse_strict(g).alias("midpoint"), M.parse_strict(g, "reject").alias("no_range"), M.parse_strict(g, bounds="reject").alias("no_bound"))


def parse_lenient(spark, d):
    return X.measurements(spark, d).select(*IDS, M.parse_lenient(F.col("gravimetric_capacitance")).alias("value"))


def unit_keys(spark, d):
    return X.measurements(spark, d).groupBy(M.unit_key(F.col("scan_rate__unit")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def normalise_strict(spark, d):
    return M.normalize_strict(X.electrodes(spark, d)).select("electrode_id", *(M.STRICT[f][0] for f in E_FIELDS))


def normalise_lenient(spark, d):
    return M.normalize_lenient(X.electrodes(spark, d)).select("electrode_id", *(M.LENIENT[f][0] for f in E_FIELDS), "h2so4_concentration", "concentration_basis", "electrolyte_is_gel")


def conditions_strict(spark, d):
    return M.normalize_strict(X.measurements(spark, d)).select(*IDS, "scan_rate_mV_s", "current_density_A_g", "capacitance_F_g")


def conditions_lenient(spark, d):
    rows = M.normalize_lenient(X.measurements(spark, d))
    return rows.select(*IDS, "scan_rate_mV_s", *(n for n, _ in M.CURRENT), *TARGETS)


def features_strict(spark, d):
    return FE.strict_features(X.electrodes(spark, d)).select("electrode_id", "layer_class", "material_family", "electrolyte_type", "paper_group", "role")


def _prepared(df):
    return FE.engineered_features(M.normalize_lenient(df))


def features_lenient(spark, d):
    rows = X.both(spark, d, _prepared)
    return rows.select(*IDS, "layer_category", "measurement_mode", *FE.COMPOSITION_FLAGS, *FE.SYNTHESIS_FLAGS, "lif_hcl_etch")


def feature_view(spark, d):
    """The 25 features of the lenient model."""
    return FE.feature_view(X.both(spark, d, _prepared), IDS)


def parsed_values(spark, d):
    """Each raw value of a target beside what both parsers make of it."""
    raw = F.col("gravimetric_capacitance")
    rows = X.measurements(spark, d).groupBy(raw.alias("raw_value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw_value", "n", M.parse_lenient(F.col("raw_value")).alias("parsed"), M.parse_strict(F.col("raw_value")).alias("strict"))


QUERIES = {f.__name__: f for f in (parse_strict, parse_lenient, unit_keys, normalise_strict, normalise_lenient, conditions_strict, conditions_lenient, features_strict, features_lenient, feature_view, parsed_values)}


def strict_sql(c, ranges="midpoint", bounds="keep"):
    text = f"replace(trim({c}), ',', '')"
    head = rf"regexp_replace({text}, '\s*(±|\+/-).*$', '')"
    rng = r"(?i)([0-9]*\.?[0-9]+)\s*(?:-|–|—|to)\s*([0-9]*\.?[0-9]+)"
    mid = "NULL" if ranges == "reject" else f"(try_cast(regexp_extract({head}, '{rng}', 1) AS DOUBLE) + try_cast(regexp_extract({head}, '{rng}', 2) AS DOUBLE)) / 2"
    out = rf"CASE WHEN regexp_matches({head}, '{rng}') THEN {mid} ELSE try_cast(regexp_extract({head}, '[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?') AS DOUBLE) END"
    return f"CASE WHEN NOT regexp_matches(lower({text}), 'over |exceeding|greater than|>|less than|<') THEN {out} END" if bounds == "reject" else out


def lenient_sql(c):
    text = rf"regexp_replace(translate(lower(trim({c})), '−–—', '---'), '≈|~|about|around|approximately|approx\.|below|larger than|greater than|less than', '', 'g')"
    rng = r"(?:^|[^a-z0-9.])([0-9]*\.?[0-9]+)\s*-\s*([0-9]*\.?[0-9]+)"
    return rf"CASE WHEN regexp_matches({text}, '{rng}') AND NOT contains({c}, '±') THEN (try_cast(regexp_extract({text}, '{rng}', 1) AS DOUBLE) + try_cast(regexp_extract({text}, '{rng}', 2) AS DOUBLE)) / 2 ELSE try_cast(regexp_extract({text}, '(?:^|[^a-z0-9.+-])([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1) AS DOUBLE) END"


def unit_sql(c):
    return f"translate(lower(trim(coalesce({c}, ''))), 'μ−–—²³ ', 'µ---23')"


def _units(field, *rules):
    """A chain written out: each rule is a condition on the unit `u` and what becomes of the value `v`."""
    return [(condition.replace("u", unit_sql(f"{field}__unit"), 1) if condition else "TRUE", change) for condition, change in rules]


def _case(value, rules):
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}{change}" for condition, change in rules) + " END"


#: The rules of the two presets, by hand: none of this comes from the library's tables.
_STRICT_SQL = {
    "interlayer_spacing": ("interlayer_spacing_nm", _units("interlayer_spacing", ("u IN ('å', 'a')", " * 0.1::DOUBLE"), ("u = 'nm'", ""))),
    "flake_size": ("flake_size_um", _units("flake_size", ("u = 'nm'", " * 0.001::DOUBLE"), ("u IN ('µm', 'um', 'microns')", ""))),
    "porosity": ("porosity_pct", _units("porosity", ("u = '%'", ""))),
    "pore_diameter": ("pore_diameter_nm", _units("pore_diameter", ("u = 'nm'", ""), ("u IN ('µm', 'um')", " * 1000"))),
    "electrode_thickness": ("electrode_thickness_um", _units("electrode_thickness", ("u = 'nm'", " * 0.001::DOUBLE"), ("u IN ('µm', 'um')", ""), ("u = 'mm'", " * 1000"))),
    "mass_loading": ("mass_loading_mg_cm2", _units("mass_loading", ("u IN ('mg/cm2', 'mgcm-2')", ""), ("u IN ('µg/cm2', 'µgcm-2')", " * 0.001::DOUBLE"))),
    "ssa": ("ssa_m2_g", _units("ssa", ("u SIMILAR TO '.*m2.*(g-1|/g).*'", ""))),
    "scan_rate": ("scan_rate_mV_s", _units("scan_rate", ("u IN ('mv/s', 'mvs-1')", ""), ("u IN ('v/s', 'vs-1')", " * 1000"))),
    "current_density": ("current_density_A_g", _units("current_density", ("u IN ('a/g', 'ag-1')", ""))),
    "gravimetric_capacitance": ("capacitance_F_g", _units("gravimetric_capacitance", ("", ""))),
}
_LENIENT_SQL = {
    "interlayer_spacing": ("interlayer_spacing_nm", _units("interlayer_spacing", ("u SIMILAR TO '.*(å|angstrom).*'", " * 0.1::DOUBLE"), ("u LIKE '%nm%'", ""))),
    "flake_size": ("flake_size_um", _units("flake_size", ("u LIKE '%nm%'", " * 0.001::DOUBLE"), ("u SIMILAR TO '.*(µm|micrometer).*'", ""))),
    "porosity": ("porosity_pct", _units("porosity", ("", ""))),
    "pore_diameter": ("pore_diameter_nm", _units("pore_diameter", ("u LIKE '%µm%'", " * 1000"), ("u LIKE '%nm%'", ""))),
    "electrode_thickness": ("electrode_thickness_um", _units("electrode_thickness", ("u LIKE '%mm%'", " * 1000"), ("u LIKE '%nm%'", " * 0.001::DOUBLE"), ("u LIKE '%µm%'", ""))),
    "mass_loading": ("mass_loading_mg_cm2", _units("mass_loading", ("", ""))),
    "ssa": ("ssa_m2_g", _units("ssa", ("", ""))),
    "scan_rate": ("scan_rate_mV_s", _units("scan_rate", ("u LIKE '%mv%'", ""), ("u LIKE 'v%'", " * 1000"))),
}


def _strict(fields):
    out = []
    for f in fields:
        name, rules = _STRICT_SQL[f]
        target, rate = f == "gravimetric_capacitance", f in ("scan_rate", "current_density")
        case = _case(strict_sql(f, "reject", "reject") if target else strict_sql(f, "reject" if rate else "midpoint"), rules)
        if f == "flake_size":
            mixed = r"(?i)([0-9]*\.?[0-9]+)\s*nm\s*(?:-|–|—|to)\s*([0-9]*\.?[0-9]+)\s*[µμu]m"
            case = f"CASE WHEN regexp_matches({f}, '{mixed}') THEN (try_cast(regexp_extract({f}, '{mixed}', 1) AS DOUBLE) / 1000 + try_cast(regexp_extract({f}, '{mixed}', 2) AS DOUBLE)) / 2 ELSE {case} END"
        out.append(f"({case}) AS {name}")
    return ", ".join(out)


def _lenient(fields):
    return ", ".join(f"{_case(lenient_sql(f), _LENIENT_SQL[f][1])} AS {_LENIENT_SQL[f][0]}" for f in fields)


_CU = unit_sql("current_density__unit")
_CURRENT = f"""CASE WHEN {_CU} LIKE '%a/g%' OR {_CU} LIKE '%ag-1%' THEN {lenient_sql('current_density')} END AS current_density_A_g,
CASE WHEN {_CU} LIKE '%ma/cm2%' OR {_CU} LIKE '%macm-2%' THEN {lenient_sql('current_density')} END AS current_density_mA_cm2,
CASE WHEN {_CU} LIKE '%a/cm3%' OR {_CU} LIKE '%acm-3%' THEN {lenient_sql('current_density')} END AS current_density_A_cm3"""
#: The targets, written out: any unit or none for the first two, areal by how the unit begins.
_TARGETS = f"""{lenient_sql('gravimetric_capacitance')} AS gravimetric_capacitance_F_g, {lenient_sql('volumetric_capacitance')} AS volumetric_capacitance_F_cm3,
CASE WHEN starts_with({unit_sql('areal_capacitance__unit')}, 'mf') THEN {lenient_sql('areal_capacitance')} WHEN starts_with({unit_sql('areal_capacitance__unit')}, 'f') THEN {lenient_sql('areal_capacitance')} * 1000 END AS areal_capacitance_mF_cm2"""
_EL = "coalesce(electrolyte, '')"
_ELECTROLYTE = rf"""CASE WHEN regexp_matches({_EL}, '\b[0-9]*\.?[0-9]+\s*(?:M|m|mol\s*/\s*L)\b') THEN {lenient_sql(_EL)} END AS h2so4_concentration,
CASE WHEN regexp_matches({_EL}, '[0-9]\s*M\b') THEN 'molarity_M' WHEN regexp_matches({_EL}, '[0-9]\s*m\b') THEN 'molality_m' WHEN regexp_matches({_EL}, '(?i)mol\s*/\s*l') THEN 'molarity_M' ELSE 'unknown' END AS concentration_basis,
CAST(regexp_matches({_EL}, '(?i)pva|gel') AS INT) AS electrolyte_is_gel"""
_LAYERS = "lower(coalesce(layer_no, ''))"
_COMPOSITION, _SYNTHESIS = "lower(coalesce(composition, ''))", "lower(coalesce(synthesis_method, ''))"
_FEATURES = rf"""CASE WHEN {_LAYERS} = '' THEN 'missing' WHEN regexp_matches({_LAYERS}, '3d|interlinked') THEN '3d' WHEN {_LAYERS} LIKE '%delaminated%' THEN 'delaminated'
  WHEN regexp_matches({_LAYERS}, 'mono|single-layer|individual nanosheet') THEN 'single' WHEN {_LAYERS} LIKE '%few%' THEN 'few' WHEN regexp_matches({_LAYERS}, 'two-layer|double-layer') THEN 'double' ELSE 'mixed_or_other' END AS layer_category,
CASE WHEN current_density_A_cm3 IS NOT NULL THEN 'GCD_volumetric' WHEN current_density_mA_cm2 IS NOT NULL THEN 'GCD_areal' WHEN current_density_A_g IS NOT NULL THEN 'GCD_gravimetric' WHEN scan_rate_mV_s IS NOT NULL THEN 'CV' ELSE 'unknown' END AS measurement_mode,
CAST(regexp_matches({_COMPOSITION}, 'rgo|graphene|cnt|carbon|graphite') AS INT) AS contains_carbon_additive,
CAST(regexp_matches({_COMPOSITION}, 'pva|pdda|poly|chitosan|cellulose|pedot|pani') AS INT) AS contains_polymer,
CAST(regexp_matches({_COMPOSITION}, '\boxide\b|mno|ruo|nio|coo|zno|v2o5|wo3|tio2') AS INT) AS contains_metal_oxide,
CAST({_SYNTHESIS} LIKE '%vacuum%' AS INT) AS vacuum_filtration, CAST({_SYNTHESIS} LIKE '%template%' AS INT) AS template_based, CAST({_SYNTHESIS} LIKE '%freeze%' AS INT) AS freeze_dried,
CAST(regexp_matches({_SYNTHESIS}, '\bhf\b') AS INT) AS hf_etch, CAST({_SYNTHESIS} LIKE '%print%' AS INT) AS printed,
CAST({_SYNTHESIS} LIKE '%lif%' AND {_SYNTHESIS} LIKE '%hcl%' AS INT) AS lif_hcl_etch"""
_STRICT_LAYERS = """CASE WHEN try_cast(layer_no AS DOUBLE) <= 1 THEN 'single_layer' WHEN try_cast(layer_no AS DOUBLE) <= 5 THEN 'few_layer' WHEN try_cast(layer_no AS DOUBLE) IS NOT NULL THEN 'multilayer' WHEN layer_no IS NULL THEN 'unknown'
  WHEN l LIKE '%delaminat%' THEN 'delaminated' WHEN l LIKE '%exfoliat%' THEN 'exfoliated' WHEN regexp_matches(l, 'mono|single') THEN 'single_or_few' WHEN regexp_matches(l, 'few|ultrathin|two-layer') THEN 'few_layer' WHEN regexp_matches(l, 'multi|stack|layered') THEN 'multilayer' ELSE 'other' END"""
_STRICT_FAMILY = """CASE WHEN composition IS NULL THEN 'unknown' WHEN regexp_matches(c, 'pani|polyaniline|pedot|ppy|polypyrrole|pva') THEN 'polymer_composite' WHEN regexp_matches(c, 'cnt|swcnt|mwcnt|graphene|rgo|carbon dot|cnf') THEN 'carbon_composite'
  WHEN regexp_matches(c, 'doped|co-doped|n-ti3c2') THEN 'doped_mxene' WHEN regexp_matches(c, 'porous|aerogel|hydrogel|foam') THEN 'porous_3d' WHEN c LIKE '%ti3c2%' THEN 'mxene_like' ELSE 'other_composite' END"""
_STRICT_ELECTROLYTE = "CASE WHEN electrolyte IS NULL THEN 'unknown' WHEN x LIKE '%ki%' THEN 'redox_additive' WHEN regexp_matches(x, 'pva|gel') THEN 'gel' WHEN regexp_matches(x, 'h2so4|sulfuric') THEN 'aqueous' ELSE 'other' END"
SQL = {
    "parse_strict": X.sql(f"SELECT source_file, electrode_id, measurement_id, {strict_sql('gravimetric_capacitance')} AS midpoint, {strict_sql('gravimetric_capacitance', 'reject')} AS no_range, {strict_sql('gravimetric_capacitance', bounds='reject')} AS no_bound FROM m"),
    "parse_lenient": X.sql(f"SELECT source_file, electrode_id, measurement_id, {lenient_sql('gravimetric_capacitance')} AS value FROM m"),
    "unit_keys": X.sql(f"SELECT {unit_sql('scan_rate__unit')} AS unit, count(*) AS n FROM m GROUP BY 1"),
    "normalise_strict": X.sql(f"SELECT electrode_id, {_strict(E_FIELDS)} FROM e"),
    "normalise_lenient": X.sql(f"SELECT electrode_id, {_lenient(E_FIELDS)}, {_ELECTROLYTE} FROM e"),
    "conditions_strict": X.sql(f"SELECT source_file, electrode_id, measurement_id, {_strict(('scan_rate', 'current_density', 'gravimetric_capacitance'))} FROM m"),
    "conditions_lenient": X.sql(f"SELECT source_file, electrode_id, measurement_id, {_lenient(('scan_rate',))}, {_CURRENT}, {_TARGETS} FROM m"),
    "features_strict": X.sql(f"SELECT electrode_id, {_STRICT_LAYERS} AS layer_class, {_STRICT_FAMILY} AS material_family, {_STRICT_ELECTROLYTE} AS electrolyte_type, coalesce(doi, source_file) AS paper_group, coalesce(role, 'unknown') AS role FROM (SELECT *, lower(trim(layer_no)) AS l, lower(composition) AS c, lower(electrolyte) AS x FROM e)"),
    "features_lenient": X.sql(f"SELECT source_file, electrode_id, measurement_id, {_FEATURES} FROM (SELECT b.*, {_lenient(('scan_rate',))}, {_CURRENT} FROM b)"),
    "feature_view": X.sql(f"SELECT source_file, electrode_id, measurement_id, {', '.join(_LENIENT_SQL[f][0] for f in (*E_FIELDS, 'scan_rate'))}, current_density_A_g, current_density_mA_cm2, current_density_A_cm3, {_ELECTROLYTE}, {_FEATURES} FROM (SELECT b.*, {_lenient((*E_FIELDS, 'scan_rate'))}, {_CURRENT} FROM b)"),
    "parsed_values": X.sql(f"SELECT gravimetric_capacitance AS raw_value, count(*) AS n, any_value({lenient_sql('gravimetric_capacitance')}) AS parsed, any_value({strict_sql('gravimetric_capacitance')}) AS strict FROM m GROUP BY 1"),
}
