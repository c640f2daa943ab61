"""Nested records to flat tables and back. Sequences of names stand for the catalog's fields of a level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ITEM = "struct<name:string,value:string,unit:string,source_location:string,evidence:string,confidence:string>"
PAPER_V1 = ("doi", "year", "authors")
PAPER_V2 = ("doi", "title", "journal", "year", "authors")
HEAD = ("source_file", "source_path")
SUFFIX = {"unit": "unit", "confidence": "conf", "source_location": "source", "evidence": "evidence"}
PROVENANCE = {"none": (), "units": ("unit", "confidence"), "full": ("unit", "confidence", "source_location", "evidence")}
NOT_REPORTED, DASH = "Not reported", "—"
#: How the dense fields are shown.
LABELS = {
    "mxene_formula": "MXene Formula", "composition": "Composition", "synthesis_method": "Synthesis Method", "layer_no": "Layer No", "interlayer_spacing": "Interlayer Spacing (d)",
    "flake_size": "Flake Size", "porosity": "Porosity", "pore_diameter": "Pore Diameter", "tortuosity": "Tortuosity", "electrode_thickness": "Electrode Thickness",
    "mass_loading": "Mass Loading", "electrolyte": "Electrolyte", "ssa": "SSA", "scan_rate": "Scan Rate", "current_density": "Current Density",
    "gravimetric_capacitance": "Gravimetric Capacitance", "volumetric_capacitance": "Volumetric Capacitance", "areal_capacitance": "Areal Capacitance",
}
#: What a preview of measurements shows.
PREVIEW = "measurement_id measurement_label test_type cell_configuration electrolyte current_density scan_rate gravimetric_capacitance areal_capacitance volumetric_capacitance capacitance_retention".split()


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _of(df: DataFrame, column: str, kind: str = "string") -> Column:
    """A column, null where df has none of that name."""
    return F.col(column).cast(kind) if column in df.columns else _null(kind)


def item(name: str, value: Column, unit: Column, conf: Column) -> Column:
    parts = {"name": F.lit(name), "value": value.cast("string"), "unit": unit, "source_location": _null(), "evidence": _null(), "confidence": conf}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def sparse(df: DataFrame, names: Sequence[str]) -> Column:
    """Only the fields that have a value, as items."""
    items = [item(n, F.col(n), _of(df, f"{n}__unit"), _of(df, f"{n}__conf")) for n in names]
    return F.filter(F.array(*items), lambda f: f["value"].isNotNull())


def field_map(fields: Column) -> Column:
    """Name -> field, the last of a repeated name winning: where names are repeated or null, fields go in order of name and place, each followed
    by another name kept."""
    names = fields["name"]
    ordered = F.array_sort(F.transform(F.filter(fields, lambda f: f["name"].isNotNull()), lambda f, i: F.named_struct(F.lit("name"), f["name"], F.lit("at"), i, F.lit("field"), f)))
    last = lambda s: F.filter(s, lambda x, i: ~F.coalesce(F.get(s, i + 1)["name"] == x["name"], F.lit(False)))
    kept = F.element_at(F.transform(F.array(ordered), last), 1)  # ordered once a row
    apart = F.size(F.array_distinct(F.array_compact(names))) == F.size(fields)
    return F.when(apart, F.map_from_arrays(names, fields)).otherwise(F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], x["field"]))))


def flatten_fields(fields: Column, names: Sequence[str], provenance: str = "units") -> list[Column]:
    """Every name as columns, null where absent. provenance: none, units, or full."""
    out = []
    for n in names:
        cell = F.try_element_at(fields, F.lit(n))
        out += [cell["value"].alias(n), *(cell[p].alias(f"{n}__{SUFFIX[p]}") for p in PROVENANCE[provenance])]
    return out


def nest_v1(flat: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """Dense records, one a paper: electrodes in the given order with a cell per field."""
    cell = lambda f, note: F.struct(_of(flat, f).alias("value"), _of(flat, f"{f}__unit").alias("unit"), note.alias("note"), _of(flat, f"{f}__conf").alias("confidence"))
    one = F.struct(
        F.col("electrode_label").alias("label"), "role", "is_primary", F.struct(*(cell(f, F.when(F.col(f).isNull(), "absent") if f in flat.columns else _null()).alias(f) for f in fields)).alias("fields")
    )
    paper = F.struct(*(F.max(F.struct(_of(flat, p).alias("value"), _null().alias("unit"), _null().alias("note"), _null().alias("confidence"))).alias(p) for p in PAPER_V1)).alias("paper")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), one.alias("e")))), lambda x: x["e"])
    out = flat.groupBy("source_file").agg(F.max(_of(flat, "source_path")).alias("source_path"), paper, rows.alias("electrodes"))
    return out.withColumn("n_electrodes", F.size("electrodes"))


def flatten_v1(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per electrode, with its position in the paper; papers without electrodes vanish, source_path stays where there is one."""
    head = [c for c in HEAD if c in records.columns]
    rows = records.select(*head, *(F.col(f"paper.{p}.value").alias(p) for p in PAPER_V1), F.posexplode("electrodes").alias("position", "e"))
    cells = [F.col(f"e.fields.{f}.{p}").alias(f if p == "value" else f"{f}__{s}") for f in fields for p, s in (("value", ""), ("unit", "unit"), ("confidence", "conf"))]
    return rows.select(*head, *PAPER_V1, "position", F.col("e.label").alias("electrode_label"), "e.role", "e.is_primary", *cells)


def nest_v2(electrodes: DataFrame, measurements: DataFrame, e_fields: Sequence[str], m_fields: Sequence[str]) -> DataFrame:
    """Sparse records: electrodes with fields and measurements with fields. Ids are strings."""
    one = F.struct(F.col("measurement_id").cast("string").alias("measurement_id"), _of(measurements, "measurement_label").alias("measurement_label"), "is_representative", sparse(measurements, m_fields).alias("fields"))
    m = measurements.select("source_file", "electrode_id", one.alias("m")).groupBy("source_file", "electrode_id").agg(F.array_sort(F.collect_list("m")).alias("measurements"))
    none = F.array().cast(f"array<struct<measurement_id:string,measurement_label:string,is_representative:boolean,fields:array<{ITEM}>>>")
    paper = [p for p in PAPER_V2 if p in electrodes.columns]
    e = electrodes.select("source_file", _of(electrodes, "source_path").alias("source_path"), *paper, "electrode_id", "electrode_label", "role", "is_primary", sparse(electrodes, e_fields).alias("fields"))
    e = e.join(m, ["source_file", "electrode_id"], "left").withColumn("measurements", F.coalesce("measurements", none))
    row = F.struct(F.col("electrode_id").cast("string").alias("electrode_id"), F.col("electrode_label").alias("label"), "role", "is_primary", "fields", F.size("measurements").alias("n_measurements"), "measurements")
    whole = F.struct(*((F.max(p) if p in paper else _null()).alias(p) for p in PAPER_V2)).alias("paper")
    out = e.groupBy("source_file").agg(F.max("source_path").alias("source_path"), whole, F.array_sort(F.collect_list(row)).alias("electrodes"))
    return out.withColumns({"n_electrodes": F.size("electrodes"), "n_measurements": F.aggregate("electrodes", F.lit(0), lambda a, x: a + F.size(x["measurements"]))})


def made_once(df: DataFrame) -> DataFrame:
    """df, whose columns are made once a row: conditions of what follows, such as those of an explode, are not pushed into their making."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _has(kind: StructType, row: Column, name: str) -> Column:
    """A field of a struct as a string, null where its type has none of that name."""
    return row[name].cast("string") if name in kind.names else _null()


def shape_v2(papers: DataFrame, e_fields: Sequence[str], m_fields: Sequence[str]) -> DataFrame:
    """Sparse records, as nest_v2 makes them, of papers that are together already: source_file and electrodes, an array of flat structs, each
    with measurements, an array of flat structs. Nothing is shuffled."""
    e_kind = papers.schema["electrodes"].dataType.elementType
    m_kind = e_kind["measurements"].dataType.elementType

    def fields(kind: StructType, row: Column, names: Sequence[str]) -> Column:
        if not names:
            return F.array().cast(f"array<{ITEM}>")
        return F.filter(F.array(*(item(n, row[n], _has(kind, row, f"{n}__unit"), _has(kind, row, f"{n}__conf")) for n in names)), lambda f: f["value"].isNotNull())

    def measurement(m: Column) -> Column:
        return F.struct(m["measurement_id"].cast("string").alias("measurement_id"), _has(m_kind, m, "measurement_label").alias("measurement_label"), m["is_representative"].alias("is_representative"), fields(m_kind, m, m_fields).alias("fields"))

    def electrode(e: Column) -> Column:
        head = (e["electrode_id"].cast("string").alias("electrode_id"), e["electrode_label"].alias("label"), e["role"].alias("role"), e["is_primary"].alias("is_primary"))
        return F.struct(*head, fields(e_kind, e, e_fields).alias("fields"), F.size(e["measurements"]).alias("n_measurements"), F.sort_array(F.transform(e["measurements"], measurement)).alias("measurements"))

    most = lambda name: F.array_max(F.transform("electrodes", lambda e: _has(e_kind, e, name)))
    paper = F.struct(*(most(p).alias(p) for p in PAPER_V2)).alias("paper")
    out = papers.select("source_file", most("source_path").alias("source_path"), paper, F.sort_array(F.transform("electrodes", electrode)).alias("electrodes"))
    return out.withColumns({"n_electrodes": F.size("electrodes"), "n_measurements": F.aggregate("electrodes", F.lit(0), lambda a, x: a + x["n_measurements"])})


def _electrodes_v2(records: DataFrame, *more: Column | str) -> tuple[DataFrame, list[str]]:
    """Records by electrode, with the columns that say whence."""
    head = [c for c in ("schema_version", *HEAD) if c in records.columns]
    rows = records.select(*head, *(F.col(f"paper.{p}").alias(p) for p in PAPER_V2), F.explode("electrodes").alias("e"))
    rows = rows.select(*head, *PAPER_V2, "e.electrode_id", F.col("e.label").alias("electrode_label"), "e.role", "e.is_primary", field_map(F.col("e.fields")).alias("em"), *more)
    return rows, [*head, *PAPER_V2, "electrode_id", "electrode_label", "role", "is_primary"]


def electrode_table(records: DataFrame, names: Sequence[str], provenance: str = "units") -> DataFrame:
    rows, ids = _electrodes_v2(records, F.coalesce(F.size("e.measurements"), F.lit(0)).cast("long").alias("n_measurements"))
    return rows.select(*ids, "n_measurements", *flatten_fields(F.col("em"), names, provenance))


def measurement_table(records: DataFrame, e_names: Sequence[str], m_names: Sequence[str], provenance: str = "units") -> DataFrame:
    """One row per measurement with its electrode's descriptors; electrodes without one drop out."""
    rows, ids = _electrodes_v2(records, "e.measurements")
    rows = rows.select(*ids, "em", F.explode("measurements").alias("m"))  # the electrode's map is made below, once for all its measurements
    rows = rows.withColumn("mm", field_map(F.col("m.fields")))
    return rows.select(*ids, "m.measurement_id", "m.measurement_label", "m.is_representative", *flatten_fields(F.col("em"), e_names, provenance), *flatten_fields(F.col("mm"), m_names, provenance))


def corpora(records: DataFrame, e_names: Sequence[str], m_names: Sequence[str], provenance: str = "units") -> tuple[DataFrame, DataFrame]:
    """The electrode and the measurement table of the same records; papers without electrodes are in neither."""
    return electrode_table(records, e_names, provenance), measurement_table(records, e_names, m_names, provenance)


def corpus(records: DataFrame, e_names: Sequence[str], m_names: Sequence[str], provenance: str = "units") -> DataFrame:
    """The measurement table: the main corpus."""
    return corpora(records, e_names, m_names, provenance)[1]


def overview_v1(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per electrode: position, label, role, formula, the beginning of the synthesis, capacitance, condition, filled fields."""
    rows = flatten_v1(records, fields)
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(DASH))
    cg = F.when(F.coalesce("gravimetric_capacitance", F.lit("")) != "", F.trim(F.concat_ws(" ", "gravimetric_capacitance", "gravimetric_capacitance__unit"))).otherwise(DASH)
    filled = sum(F.col(f).isNotNull().cast("int") for f in fields)
    condition = F.coalesce(F.nullif("current_density", F.lit("")), F.nullif("scan_rate", F.lit("")), F.lit(DASH))
    return rows.select(
        "source_file", "position", "electrode_label", "role", shown(F.col("mxene_formula")).alias("formula"), F.substring(shown(F.col("synthesis_method")), 1, 28).alias("synthesis"), cg.alias("cg"), condition.alias("condition"), F.concat_ws("/", filled, F.lit(len(fields))).alias("filled")
    )


def overview_v2(records: DataFrame, value: str = "gravimetric_capacitance") -> DataFrame:
    """Per electrode: how many measurements and the first representative one's value, else the last that has one."""
    rows = records.select("source_file", F.explode("electrodes").alias("e"))
    of = F.transform("e.measurements", lambda m: F.struct(m["is_representative"].alias("rep"), F.try_element_at(field_map(m["fields"]), F.lit(value)).alias("f")))
    having = F.filter(of, lambda x: x["f"].isNotNull())
    pick = lambda h: F.coalesce(F.get(F.filter(h, lambda x: x["rep"]), F.lit(0)), F.try_element_at(h, F.lit(-1)))["f"]
    best = F.element_at(F.transform(F.array(having), pick), 1)
    return rows.select("source_file", "e.electrode_id", F.coalesce(F.size("e.measurements"), F.lit(0)).cast("long").alias("n_measurements"), best["value"].alias("representative"), best["unit"].alias("unit"))


def field_card_v1(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Long table of an electrode's dense fields, in their order, with what is shown where nothing is reported."""
    rows = records.select("source_file", F.posexplode("electrodes").alias("electrode", "e"))
    cells = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(LABELS.get(f, f)).alias("field"), *(F.col(f"e.fields.{f}.{p}").alias(p) for p in ("value", "unit", "confidence", "note"))) for i, f in enumerate(fields)))
    c = rows.select("source_file", "electrode", F.explode(cells).alias("c")).select("source_file", "electrode", "c.*")
    shown = lambda n, other: F.coalesce(F.nullif(n, F.lit("")), F.lit(other)).alias(n)
    return c.select("source_file", "electrode", "position", "field", shown("value", NOT_REPORTED), shown("unit", DASH), "confidence", "note")


def field_card_v2(records: DataFrame, catalog: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Long table of an electrode's fields in the order of the catalog (feature, category, tier)."""
    rows = records.select("source_file", F.explode("electrodes").alias("e")).select("source_file", "e.electrode_id", field_map(F.col("e.fields")).alias("map"))
    cell = lambda i, row: F.struct(F.lit(i).alias("position"), *(F.lit(x).alias(k) for k, x in zip(("field", "category", "tier"), row, strict=True)), F.try_element_at("map", F.lit(row[0])).alias("f"))
    c = rows.select("source_file", "electrode_id", F.explode(F.array(*(cell(i, row) for i, row in enumerate(catalog)))).alias("c")).select("source_file", "electrode_id", "c.*")
    shown = lambda n, other: F.coalesce(F.col(f"f.{n}"), F.lit(other)).alias(n)
    unit = F.coalesce(F.nullif(F.col("f.unit"), F.lit("")), F.lit(DASH)).alias("unit")
    return c.select("source_file", "electrode_id", "position", "field", "category", "tier", shown("value", NOT_REPORTED), unit, shown("confidence", DASH), shown("source_location", DASH))


def preview(df: DataFrame, want: Sequence[str] = PREVIEW) -> DataFrame:
    """The wanted columns that df has."""
    return df.select([c for c in want if c in df.columns])
