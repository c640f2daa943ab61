"""Sources and sinks: the views written to the folder that driver and executors share, and read back by the scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mensura.functions import rules
from mensura.functions.catalog import V1_FIELDS
from mensura.operators import records as R
from mensura.operators import reports as P
from mensura.operators.bookkeeping import output_namespace
from mensura.plans import fixtures as X
from mensura.plans import record_queries as N
from mensura.plans import report_queries as Q
from mensura.plans import verdict_queries as V
from mensura.plans.session import scratch
from mensura.sources import records as J
from mensura.sources import tables as T
from mensura.streaming.ingest import incremental_ingest

TEXTS = ["source_file", "doi", "electrode_label", "mxene_formula", "synthesis_method", "electrolyte", "interlayer_spacing"]
FEATURES = ["scan_rate_mV_s", "current_density_A_g", "test_type"]


def csv_strings(spark, d):
    """Every column a string, null as empty."""
    path = scratch(spark, "strings")
    T.write_table(X.electrodes(spark, d).select("electrode_id", *TEXTS), path, "csv")
    return T.require_columns(T.scan_strings(spark, path, ["electrode_id", *TEXTS]), ["mxene_formula", "synthesis_method", "electrolyte"])


def csv_folder(spark, d):
    """All files of a folder; search_id is the name of the file without its suffix."""
    path = scratch(spark, "folder")
    T.write_table(X.measurements(spark, d).select("electrode_id", "measurement_id", "test_type"), path, "csv")
    rows = T.scan_dir(spark, path, ["electrode_id", "measurement_id", "test_type"])
    return rows.select("electrode_id", "measurement_id", "test_type", (F.col("search_id").startswith("part-") & ~F.col("search_id").endswith(".csv")).alias("named"))


def csv_headers(spark, d):
    """Files of one folder whose columns differ in order and number are read by name; what one lacks is empty."""
    path = scratch(spark, "headers")
    rows = X.measurements(spark, d)
    T.write_table(rows.where("measurement_id <= 3").select("electrode_id", "measurement_id", "test_type"), path, "csv")
    T.write_table(rows.where("measurement_id > 3").select("test_type", "electrode_id", "measurement_id", "scan_rate"), path, "csv", mode="append")
    return T.scan_dir(spark, path).drop("search_id")


def file_positions(spark, d):
    """Verdicts joined back to the rows of their CSV files by file and position; in_place: positions follow the order of the lines."""
    path = scratch(spark, "positions")
    T.write_table(X.electrodes(spark, d).select("electrode_id", *TEXTS).repartition("electrode_id").sortWithinPartitions("electrode_id"), path, "csv")
    rows = T.scan_positions(spark, path, ["electrode_id", *TEXTS], one_header=True)
    verdicts = rules.apply_rules(rows).select("search_id", "row_index", "overall")
    number = F.col("electrode_id").cast("long")
    source = rows.select("search_id", "row_index", number.alias("electrode_id"), (F.row_number().over(W.partitionBy("search_id").orderBy(number)) - 1 == F.col("row_index")).alias("in_place"))
    return source.join(verdicts, ["search_id", "row_index"]).select("electrode_id", "overall", "in_place")


def tagged_trees(spark, d):
    """One output tree a model; a rerun of one model, with half of its rows, leaves the others as they are. Read tag by tag."""
    path = scratch(spark, "tagged")
    model = F.concat(F.lit("gpt-5.6-"), F.element_at(F.array(*map(F.lit, ("terra", "sol", "luna"))), (F.col("electrode_id") % 3 + 1).cast("int")))
    rows = X.electrodes(spark, d).select("electrode_id", output_namespace(model).alias("model_tag"))
    T.write_tagged(rows, path)
    T.write_tagged(rows.where("model_tag = 'sol' AND electrode_id % 2 = 0"), path)
    return reduce(DataFrame.unionByName, (T.read_tagged(spark, path, tag) for tag in ("terra", "sol", "luna"))).select("model_tag", "electrode_id")


def csv_typed(spark, d):
    """Types found by Spark."""
    path = scratch(spark, "typed")
    T.write_table(X.measurements(spark, d).select("electrode_id", "measurement_id", "is_representative", "scan_rate"), path, "csv")
    return T.scan_inferred(spark, path).select(F.col("electrode_id").cast("long"), F.col("measurement_id").cast("long"), "is_representative", F.col("scan_rate").cast("long"))


def verdict_files(spark, d):
    """Rows per verdict, from the folders that the split writes."""
    path = scratch(spark, "verdicts")
    T.write_verdict_split(rules.apply_rules(X.electrodes(spark, d)), path, ["electrode_id", "overall"])
    rows, why = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/reasoning")
    return rows.groupBy("overall").agg(F.count(F.lit(1)).alias("n")).join(why.groupBy("overall").agg(F.count(F.lit(1)).alias("n_reasoning")), "overall")


def json_dense(spark, d):
    path = scratch(spark, "dense")
    J.write_records(N.records_v1(spark, d), path)
    return R.flatten_v1(J.scan_records_v1(spark, path), V1_FIELDS).select(*N.V1_HEAD, *V1_FIELDS, "interlayer_spacing__unit", "interlayer_spacing__conf")


def json_sparse(spark, d):
    """Papers whose file ends in 7 have a stale version and stay out."""
    path = scratch(spark, "sparse")
    stale = F.when(F.col("source_file").endswith("7.pdf"), "1").otherwise("2")
    J.write_records(N.records_v2(spark, d).withColumns({"schema_version": stale, "measurement_mode": F.lit("all")}), path)
    rows = R.measurement_table(J.scan_records_v2(spark, path, "2", "all"), ["mxene_formula", "flake_size"], N.M_FIELDS)
    return rows.select(*N.V2_HEAD, "measurement_id", "measurement_label", "is_representative", "mxene_formula", "flake_size__unit", *N.M_FIELDS, "scan_rate__unit")


def ingest_records(spark, d):
    """Record files taken by a file stream in two runs; in the second all records come again in new files."""
    path = scratch(spark, "ingest")
    for _ in range(2):
        J.write_records(N.records_v1(spark, d), f"{path}/in", mode="append")
        incremental_ingest(spark, f"{path}/in", J.schema_v1(), lambda b: R.flatten_v1(b, V1_FIELDS), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out/rows").select(*N.V1_HEAD, *V1_FIELDS, "interlayer_spacing__unit", "interlayer_spacing__conf")


def schema_summary(spark, d):
    return P.schema_summary(X.measurements(spark, d).select("test_type", "scan_rate", "gravimetric_capacitance", "is_representative"))


def feature_coverage(spark, d):
    return P.feature_coverage(Q.strict_measurements(spark, d), FEATURES)


def feature_coverage_labelled(spark, d):
    return P.feature_coverage(Q.strict_measurements(spark, d), FEATURES, "capacitance_F_g")


def target_subset(spark, d):
    return P.target_subset(Q.strict_measurements(spark, d), "capacitance_F_g", FEATURES)


QUERIES = {f.__name__: f for f in (csv_strings, csv_folder, file_positions, tagged_trees, csv_headers, csv_typed, verdict_files, json_dense, json_sparse, ingest_records, schema_summary, feature_coverage, feature_coverage_labelled, target_subset)}


def _coverage(rows):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, round(100 - round(100 * (1 - count({c}) / count(*)), 1), 1) AS pct, count(DISTINCT {c}) AS n_distinct FROM {rows}" for c in FEATURES)


_TYPES = {"test_type": "string", "scan_rate": "string", "gravimetric_capacitance": "string", "is_representative": "boolean"}

SQL = {
    "csv_strings": X.sql("SELECT CAST(electrode_id AS VARCHAR) AS electrode_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in TEXTS) + " FROM e"),
    "csv_folder": X.sql("SELECT CAST(electrode_id AS VARCHAR) AS electrode_id, CAST(measurement_id AS VARCHAR) AS measurement_id, test_type, TRUE AS named FROM m"),
    "csv_headers": X.sql("SELECT CAST(electrode_id AS VARCHAR) AS electrode_id, CAST(measurement_id AS VARCHAR) AS measurement_id, test_type, CASE WHEN measurement_id > 3 THEN coalesce(scan_rate, '') ELSE '' END AS scan_rate FROM m"),
    "file_positions": f"SELECT electrode_id, overall, TRUE AS in_place FROM ({V.SQL['verdict_rows']})",
    "tagged_trees": X.sql("SELECT t AS model_tag, electrode_id FROM (SELECT electrode_id, CASE electrode_id % 3 WHEN 0 THEN 'terra' WHEN 1 THEN 'sol' ELSE 'luna' END AS t FROM e) WHERE t <> 'sol' OR electrode_id % 2 = 0"),
    "csv_typed": X.sql("SELECT CAST(electrode_id AS BIGINT) AS electrode_id, CAST(measurement_id AS BIGINT) AS measurement_id, is_representative, CAST(scan_rate AS BIGINT) AS scan_rate FROM m"),
    "verdict_files": f"SELECT overall, n, n AS n_reasoning FROM ({V.SQL['verdict_counts']})",
    "json_dense": N.SQL["flatten_v1"],
    "json_sparse": f"SELECT * FROM ({N.SQL['measurement_table']}) WHERE source_file NOT LIKE '%7.pdf'",
    "ingest_records": N.SQL["flatten_v1"],
    "schema_summary": X.sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS filled, round(100 * (1 - count({c}) / count(*)), 1) AS missing_pct, count(DISTINCT {c}) AS n_distinct FROM m" for c, t in _TYPES.items())),
    "feature_coverage": Q._sql(_coverage("cs"), Q._CSM),
    "feature_coverage_labelled": Q._sql(_coverage("(SELECT * FROM cs WHERE capacitance_F_g IS NOT NULL)"), Q._CSM),
    "target_subset": Q._sql("SELECT source_file, scan_rate_mV_s, current_density_A_g, test_type, capacitance_F_g FROM cs WHERE capacitance_F_g IS NOT NULL", Q._CSM),
}
