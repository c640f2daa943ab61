"""Strings to categories and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chain(c: Column, rules, default: str, null: str) -> Column:
    out = F.when(c.isNull(), null)
    for pattern, name in rules:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(default)


#: Ordered rules: the first hit names the class. Fixed values.
LAYERS = (("delaminat", "delaminated"), ("exfoliat", "exfoliated"), ("mono|single", "single_or_few"), ("few|ultrathin|two-layer", "few_layer"), ("multi|stack|layered", "multilayer"))
LAYERS_LENIENT = (("^$", "missing"), ("3d|interlinked", "3d"), ("delaminated", "delaminated"), ("mono|single-layer|individual nanosheet", "single"), ("few", "few"), ("two-layer|double-layer", "double"))
FAMILIES = (
    ("pani|polyaniline|pedot|ppy|polypyrrole|pva", "polymer_composite"),
    ("cnt|swcnt|mwcnt|graphene|rgo|carbon dot|cnf", "carbon_composite"),
    ("doped|co-doped|n-ti3c2", "doped_mxene"),
    ("porous|aerogel|hydrogel|foam", "porous_3d"),
    ("ti3c2", "mxene_like"),
)
ELECTROLYTES = (("ki", "redox_additive"), ("pva|gel", "gel"), ("h2so4|sulfuric", "aqueous"))
COMPOSITION_FLAGS = {"contains_carbon_additive": r"rgo|graphene|cnt|carbon|graphite", "contains_polymer": r"pva|pdda|poly|chitosan|cellulose|pedot|pani", "contains_metal_oxide": r"\boxide\b|mno|ruo|nio|coo|zno|v2o5|wo3|tio2"}
SYNTHESIS_FLAGS = {"vacuum_filtration": "vacuum", "template_based": "template", "freeze_dried": "freeze", "hf_etch": r"\bhf\b", "printed": "print"}


def layer_class(c: Column) -> Column:
    text = F.lower(F.trim(c))
    n = text.try_cast("double")
    return F.when(n <= 1, "single_layer").when(n <= 5, "few_layer").when(n.isNotNull(), "multilayer").otherwise(_chain(text, LAYERS, "other", "unknown"))


def layer_category(c: Column) -> Column:
    return _chain(F.lower(F.coalesce(c, F.lit(""))), LAYERS_LENIENT, "mixed_or_other", "missing")


def material_family(c: Column) -> Column:
    return _chain(F.lower(c), FAMILIES, "other_composite", "unknown")


def electrolyte_type(c: Column) -> Column:
    return _chain(F.lower(c), ELECTROLYTES, "other", "unknown")


def measurement_mode() -> Column:
    """The last column set wins, so the test order is reversed."""
    order = (("current_density_A_cm3", "GCD_volumetric"), ("current_density_mA_cm2", "GCD_areal"), ("current_density_A_g", "GCD_gravimetric"), ("scan_rate_mV_s", "CV"))
    out = F.when(F.lit(False), "")
    for column, name in order:
        out = out.when(F.col(column).isNotNull(), name)
    return out.otherwise("unknown")


def paper_group(doi: str = "doi", source: str = "source_file") -> Column:
    return F.coalesce(F.col(doi), F.col(source)).cast("string")


def strict_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "layer_class": layer_class(F.col("layer_no")),
            "material_family": material_family(F.col("composition")),
            "electrolyte_type": electrolyte_type(F.col("electrolyte")),
            "paper_group": paper_group(),
            "role": F.coalesce("role", F.lit("unknown")),
        }
    )


def engineered_features(df: DataFrame) -> DataFrame:
    """The features of the columns that df has: those of electrodes, of measurements or, for rows of both, all."""
    composition, synthesis = (F.lower(F.coalesce(c, F.lit(""))) for c in ("composition", "synthesis_method"))
    new: dict[str, Column] = {}
    if "layer_no" in df.columns:
        new["layer_category"] = layer_category(F.col("layer_no"))
    if "scan_rate_mV_s" in df.columns:
        new["measurement_mode"] = measurement_mode()
    if "composition" in df.columns:
        new |= {k: composition.rlike(p).cast("int") for k, p in COMPOSITION_FLAGS.items()}
    if "synthesis_method" in df.columns:
        new |= {k: synthesis.rlike(p).cast("int") for k, p in SYNTHESIS_FLAGS.items()}
        new["lif_hcl_etch"] = (synthesis.contains("lif") & synthesis.contains("hcl")).cast("int")
    return df.withColumns(new)


#: The lenient model's features, in order.
FEATURE_VIEW = (
    "interlayer_spacing_nm flake_size_um porosity_pct pore_diameter_nm electrode_thickness_um mass_loading_mg_cm2 ssa_m2_g scan_rate_mV_s current_density_A_g current_density_mA_cm2 "
    "current_density_A_cm3 measurement_mode h2so4_concentration concentration_basis electrolyte_is_gel layer_category contains_carbon_additive contains_polymer contains_metal_oxide "
    "vacuum_filtration template_based freeze_dried lif_hcl_etch hf_etch printed"
).split()


def feature_view(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """ids and the 25 features of normalised lenient rows, of which some may be there already."""
    return df.select(*ids, *FEATURE_VIEW) if set(FEATURE_VIEW) <= set(df.columns) else engineered_features(df).select(*ids, *FEATURE_VIEW)
