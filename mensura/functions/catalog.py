"""The feature catalog and the field lists. Fixed values, by level, category and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

V1_FIELDS = (
    "mxene_formula composition synthesis_method layer_no interlayer_spacing flake_size porosity pore_diameter tortuosity electrode_thickness "
    "mass_loading electrolyte ssa scan_rate current_density gravimetric_capacitance volumetric_capacitance areal_capacitance"
).split()
CATALOG = {
    ("electrode", "identity", "core"): "composite_partner composite_ratio composition electrode_architecture intercalant layer_state morphology mxene_formula mxene_weight_fraction preintercalated_ion",
    ("electrode", "identity", "extended"): "dopant_content dopant_elements mxene_family parent_max_phase",
    ("electrode", "synthesis", "core"): "delamination_method etchant post_treatment synthesis_method",
    ("electrode", "synthesis", "extended"): "annealing_temperature annealing_time composite_fabrication_method delamination_agent drying_method drying_temperature etchant_concentration etching_temperature etching_time sonication_time washing_endpoint_ph",
    ("electrode", "surface chemistry", "core"): "carbon_atomic_pct fluorine_atomic_pct nitrogen_atomic_pct oxygen_atomic_pct surface_termination_summary",
    ("electrode", "surface chemistry", "extended"): "f_termination_pct o_termination_pct oh_termination_pct other_heteroatom_atomic_pct oxidation_or_tio2_fraction sulfur_atomic_pct",
    ("electrode", "structure", "core"): "electrode_thickness flake_size interlayer_spacing mass_loading pore_diameter raman_id_ig sheet_thickness specific_surface_area total_pore_volume",
    ("electrode", "structure", "extended"): "electrode_density mesopore_volume micropore_volume porosity tortuosity xrd_002_peak",
    ("electrode", "transport", "core"): "electrical_conductivity",
    ("electrode", "transport", "extended"): "contact_angle sheet_resistance",
    ("electrode", "fabrication", "core"): "binder conductive_additive current_collector freestanding",
    ("electrode", "fabrication", "extended"): "active_material_fraction binder_fraction conductive_additive_fraction electrode_area pressing_pressure substrate",
    ("measurement", "cell", "core"): "cell_configuration device_configuration",
    ("measurement", "cell", "extended"): "counter_electrode electrode_role_in_cell reference_electrode separator",
    ("measurement", "electrolyte", "core"): "anion anion_mobility cation cation_mobility electrolyte electrolyte_concentration electrolyte_ionic_conductivity",
    ("measurement", "electrolyte", "extended"): "cation_ionic_radius cation_valence electrolyte_ph solvent",
    ("measurement", "test protocol", "core"): "capacitance_calculation_method current_density potential_lower potential_upper potential_window scan_rate test_type",
    ("measurement", "test protocol", "extended"): "cycle_number test_temperature",
    ("measurement", "target", "core"): "areal_capacitance capacitance_retention cycles_tested energy_density gravimetric_capacitance power_density volumetric_capacitance",
    ("measurement", "target", "extended"): "coulombic_efficiency rate_retention specific_capacity",
    ("measurement", "impedance", "core"): "charge_transfer_resistance esr",
    ("measurement", "impedance", "extended"): "diffusion_coefficient relaxation_time",
    ("measurement", "kinetics", "extended"): "b_value capacitive_contribution",
}


def fields(level: str) -> list[str]:
    return [f for (lv, _, _), names in CATALOG.items() if lv == level for f in names.split()]


def feature_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The catalog as a table. With the path of the catalog's own CSV file all its columns, with description, preferred_unit and
    literature_basis; without one, level, feature, category and tier."""
    if path is not None:
        columns = "level feature category tier description preferred_unit literature_basis".split()
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(", ".join(f"{c} string" for c in columns)).option("enforceSchema", False).csv(path)
    rows = [(lv, f, cat, tier) for (lv, cat, tier), names in CATALOG.items() for f in names.split()]
    return spark.createDataFrame(rows, "level string, feature string, category string, tier string")
