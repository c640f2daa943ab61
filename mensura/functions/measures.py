"""Free-form numbers and units to canonical columns. One parser with presets, one converter over rule tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns by which values are read.
PLAIN = r"^[0-9]*\.?[0-9]+\z"
NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
STRICT_RANGE = r"(?i)([0-9]*\.?[0-9]+)\s*(?:-|–|—|to)\s*([0-9]*\.?[0-9]+)"
LENIENT_RANGE = r"(?:^|[^a-z0-9.])([0-9]*\.?[0-9]+)\s*-\s*([0-9]*\.?[0-9]+)"
LENIENT_FIRST = r"(?:^|[^a-z0-9.+-])([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
BOUNDS = r"over |exceeding|greater than|>|less than|<"
HEDGES = r"≈|~|about|around|approximately|approx\.|below|larger than|greater than|less than"


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it; null of null."""
    return F.when(c.isNotNull(), F.get(F.transform(F.array(c), f), F.lit(0)))


def parse_strict(c: Column, ranges: str = "midpoint", bounds: str = "keep") -> Column:
    """ranges: midpoint or reject; bounds: keep or reject. Plain numbers need no search."""

    def searched(text: Column) -> Column:
        head = F.regexp_replace(text, r"(?s)\s*(?:±|\+/-).*$", "")
        out = _once(head, lambda h: F.when(h.rlike(STRICT_RANGE), middle(h)).otherwise(_double(F.regexp_extract(h, NUMBER, 0))))
        return F.when(~F.lower(text).rlike(BOUNDS), out) if bounds == "reject" else out

    def middle(head: Column) -> Column:
        low, high = (_double(F.regexp_extract(head, STRICT_RANGE, i)) for i in (1, 2))
        return F.lit(None).cast("double") if ranges == "reject" else (low + high) / 2

    return _once(F.trim(c.cast("string")), lambda raw: F.when(raw.rlike(PLAIN), _double(raw)).otherwise(_once(F.regexp_replace(raw, ",", ""), searched)))


def parse_lenient(c: Column) -> Column:
    """Plain numbers need no search."""

    def searched(raw: Column) -> Column:
        text = F.regexp_replace(F.translate(F.lower(raw), "−–—", "---"), HEDGES, "")
        middle = lambda t: (_double(F.regexp_extract(t, LENIENT_RANGE, 1)) + _double(F.regexp_extract(t, LENIENT_RANGE, 2))) / 2
        ranged = lambda t: t.contains("-") & t.rlike(LENIENT_RANGE) & ~raw.contains("±")
        return _once(text, lambda t: F.when(ranged(t), middle(t)).otherwise(_double(F.regexp_extract(t, LENIENT_FIRST, 1))))

    return _once(F.trim(c.cast("string")), lambda raw: F.when(raw.rlike(PLAIN), _double(raw)).otherwise(searched(raw)))


def unit_key(c: Column, strip_dot: bool = False) -> Column:
    out = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "μ−–—²³ ", "µ---23")
    return F.translate(out, "·", "") if strip_dot else out


#: Field -> (value column, result column, ((unit pattern, factor), ...)), strict: the whole unit must match.
STRICT = {
    "interlayer_spacing": ("interlayer_spacing_nm", ((r"^(å|a)$", 0.1), (r"^nm$", 1.0))),
    "flake_size": ("flake_size_um", ((r"^nm$", 0.001), (r"^(µm|um|microns)$", 1.0))),
    "porosity": ("porosity_pct", ((r"^%$", 1.0),)),
    "pore_diameter": ("pore_diameter_nm", ((r"^nm$", 1.0), (r"^(µm|um)$", 1000.0))),
    "electrode_thickness": ("electrode_thickness_um", ((r"^nm$", 0.001), (r"^(µm|um)$", 1.0), (r"^mm$", 1000.0))),
    "mass_loading": ("mass_loading_mg_cm2", ((r"^(mg/cm2|mgcm-2)$", 1.0), (r"^(µg/cm2|µgcm-2)$", 0.001))),
    "ssa": ("ssa_m2_g", ((r"m2.*(g-1|/g)", 1.0),)),
    "scan_rate": ("scan_rate_mV_s", ((r"^(mv/s|mvs-1)$", 1.0), (r"^(v/s|vs-1)$", 1000.0))),
    "current_density": ("current_density_A_g", ((r"^(a/g|ag-1)$", 1.0),)),
    "gravimetric_capacitance": ("capacitance_F_g", ((r"", 1.0),)),
}
#: Fixed values, lenient: the unit need only contain the pattern.
LENIENT = {
    "interlayer_spacing": ("interlayer_spacing_nm", ((r"å|angstrom", 0.1), (r"nm", 1.0))),
    "flake_size": ("flake_size_um", ((r"nm", 0.001), (r"µm|micrometer", 1.0))),
    "porosity": ("porosity_pct", ((r"", 1.0),)),
    "pore_diameter": ("pore_diameter_nm", ((r"µm", 1000.0), (r"nm", 1.0))),
    "electrode_thickness": ("electrode_thickness_um", ((r"mm", 1000.0), (r"nm", 0.001), (r"µm", 1.0))),
    "mass_loading": ("mass_loading_mg_cm2", ((r"", 1.0),)),
    "ssa": ("ssa_m2_g", ((r"", 1.0),)),
    "scan_rate": ("scan_rate_mV_s", ((r"mv", 1.0), (r"^v", 1000.0))),
    "gravimetric_capacitance": ("gravimetric_capacitance_F_g", ((r"", 1.0),)),
    "volumetric_capacitance": ("volumetric_capacitance_F_cm3", ((r"", 1.0),)),
    "areal_capacitance": ("areal_capacitance_mF_cm2", ((r"^mf", 1.0), (r"^f", 1000.0))),
}
CURRENT = (("current_density_A_g", r"a/g|ag-1"), ("current_density_mA_cm2", r"ma/cm2|macm-2"), ("current_density_A_cm3", r"a/cm3|acm-3"))
MIXED = r"(?i)([0-9]*\.?[0-9]+)\s*nm\s*(?:-|–|—|to)\s*([0-9]*\.?[0-9]+)\s*[µμu]m"


def convert_unit(value: Column, unit: Column, rules) -> Column:
    out = None
    for pattern, factor in rules:
        hit = unit.rlike(pattern) if pattern else F.lit(True)
        out = out.when(hit, value * factor) if out is not None else F.when(hit, value * factor)
    return out


def _mixed_size(text: Column) -> Column:
    low, high = (_double(F.regexp_extract(text, MIXED, i)) for i in (1, 2))
    return F.when(text.rlike(MIXED), (low / 1000 + high) / 2)


def flake_size_strict(value: Column, unit: Column) -> Column:
    """A range from nm to µm first, then the plain units."""
    return F.coalesce(_mixed_size(value), convert_unit(parse_strict(value), unit_key(unit), STRICT["flake_size"][1]))


def _converted(df: DataFrame, fields: dict, kind: Callable[[str], tuple], parse: Callable, more) -> DataFrame:
    """Canonical doubles for the fields that df has: values and units are read once in a projection of their own, then converted.

    fields: field -> (result, rules); parse(value, *kind(field)) -> the number, said once for all fields of a kind, as a projection that says
    it for each outgrows what the JVM compiles; more(values, units) -> further columns by name.
    """
    own = [f for f in fields if f in df.columns]
    if not own:
        return df.withColumns(more({}, {}))
    kinds = {k: [f for f in own if kind(f) == k] for k in map(kind, own)}
    numbers = lambda k, some: F.transform(F.array(*(F.col(f).cast("string") for f in some)), lambda c: parse(c, *k))
    read = df.withColumns({f"__v{i}": numbers(k, some) for i, (k, some) in enumerate(kinds.items())} | {"__u": F.transform(F.array(*(F.col(f"{f}__unit") for f in own)), lambda u: unit_key(u))})
    value = {f: F.get(f"__v{i}", F.lit(j)) for i, some in enumerate(kinds.values()) for j, f in enumerate(some)}
    unit = {f: F.get("__u", F.lit(j)) for j, f in enumerate(own)}
    new = {name: convert_unit(value[f], unit[f], rules) for f, (name, rules) in fields.items() if f in own and rules}
    return read.withColumns(new | more(value, unit)).drop("__u", *(f"__v{i}" for i in range(len(kinds))))


def normalize_strict(df: DataFrame) -> DataFrame:
    """Canonical doubles for the fields that df has."""

    def kind(field: str) -> tuple:
        target, rate = field == "gravimetric_capacitance", field in ("scan_rate", "current_density")
        return "reject" if target or rate else "midpoint", "reject" if target else "keep"

    def more(value: dict, unit: dict) -> dict:
        name, rules = STRICT["flake_size"]
        return {name: F.coalesce(_mixed_size(F.col("flake_size")), convert_unit(value["flake_size"], unit["flake_size"], rules))} if "flake_size" in value else {}

    return _converted(df, STRICT, kind, parse_strict, more)


def concentration_basis(c: Column) -> Column:
    return F.when(c.rlike(r"[0-9]\s*M\b"), "molarity_M").when(c.rlike(r"[0-9]\s*m\b"), "molality_m").when(c.rlike(r"(?i)mol\s*/\s*l"), "molarity_M").otherwise("unknown")


def concentration(c: Column) -> Column:
    return F.when(c.rlike(r"\b[0-9]*\.?[0-9]+\s*(?:M|m|mol\s*/\s*L)\b"), parse_lenient(c))


def normalize_lenient(df: DataFrame) -> DataFrame:
    def more(value: dict, unit: dict) -> dict:
        new = {name: F.when(unit["current_density"].rlike(p), value["current_density"]) for name, p in CURRENT} if "current_density" in value else {}
        if "electrolyte" in df.columns:
            e = F.coalesce("electrolyte", F.lit(""))
            new |= {"h2so4_concentration": concentration(e), "concentration_basis": concentration_basis(e), "electrolyte_is_gel": e.rlike("(?i)pva|gel").cast("int")}
        return new

    return _converted(df, LENIENT | {"current_density": ("", ())}, lambda f: (), parse_lenient, more)


def parser_examples(spark: SparkSession) -> DataFrame:
    """What the lenient parser makes of some raw values."""
    rows = [(v,) for v in ("~160", "around 280", "1.0 ± 0.1", "3–5", "micrometer-sized", "Ti3C2Tx")]
    return spark.createDataFrame(rows, "raw_value string").withColumn("parsed", parse_lenient(F.col("raw_value")))
