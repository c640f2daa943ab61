"""Records of the stored shapes, written by hand as files, and CSV files whose headers differ."""

import json

import pytest
from pyspark.sql import functions as F

from mensura.functions.catalog import V1_FIELDS
from mensura.operators import records as R
from mensura.sources import records as J
from mensura.sources import tables as T


def cell(value=None, unit=None, note="n", confidence="stated"):
    return {"value": value, "unit": unit, "note": note, "confidence": confidence}


def test_stored_dense_record(spark, tmp_path):
    fields = {f: cell() for f in V1_FIELDS} | {"mxene_formula": cell("Ti3C2Tx"), "gravimetric_capacitance": cell("245", "F g−1"), "scan_rate": cell("2"), "synthesis_method": cell("LiF + HCl etching of Ti3AlC2 powder")}
    record = {
        "source_file": "a.pdf", "source_path": "in/a.pdf", "model": "m", "cost_usd": 0.1, "warnings": [], "n_electrodes": 2, "summary": "s",
        "paper": {"doi": cell("10.1/x"), "year": cell("2014"), "authors": cell("Some One")},
        "electrodes": [{"label": "clay", "role": "primary", "is_primary": True, "fields": fields}, {"label": "bare", "role": "control", "is_primary": False, "fields": {f: cell() for f in V1_FIELDS}}],
    }
    (tmp_path / "a.json").write_text(json.dumps(record, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(record | {"source_file": None, "electrodes": []}, indent=2))
    records = J.scan_records_v1(spark, str(tmp_path), multi_line=True)
    assert sorted(r["source_file"] for r in records.collect()) == ["a.pdf", "b.json"]
    r = R.flatten_v1(records, V1_FIELDS).orderBy("position").collect()
    assert [(x["doi"], x["year"], x["authors"], x["source_path"], x["position"], x["electrode_label"], x["gravimetric_capacitance"]) for x in r] == [
        ("10.1/x", "2014", "Some One", "in/a.pdf", 0, "clay", "245"), ("10.1/x", "2014", "Some One", "in/a.pdf", 1, "bare", None)
    ]
    o = R.overview_v1(records, V1_FIELDS).orderBy("position").collect()
    assert tuple(o[0])[2:] == ("clay", "primary", "Ti3C2Tx", "LiF + HCl etching of Ti3AlC2", "245 F g−1", "2", "4/18")
    assert tuple(o[1])[4:] == ("—", "—", "—", "—", "0/18")
    card = R.field_card_v1(records, ["ssa", "scan_rate"]).where("electrode = 0").orderBy("position").collect()
    assert [tuple(c)[3:] for c in card] == [("SSA", "Not reported", "—", "stated", "n"), ("Scan Rate", "2", "—", "stated", "n")]


def test_stored_sparse_record(spark, tmp_path):
    item = lambda name, value, unit=None: {"name": name, "value": value, "unit": unit, "source_location": "Table 1", "evidence": "e", "confidence": "stated"}
    electrode = {
        "electrode_id": "E01", "label": "film", "role": "primary", "is_primary": True, "n_measurements": 1, "fields": [item("binder", "none"), item("binder", "PVDF")],
        "measurements": [{"measurement_id": "E01-M01", "measurement_label": "CV at 2", "is_representative": True, "fields": [item("scan_rate", "2", "mV s−1")]}],
    }
    record = {
        "schema_version": "2", "measurement_mode": "all", "source_file": "a.pdf", "source_path": "in/a.pdf", "model": "m", "n_electrodes": 1, "n_measurements": 1, "summary": "s",
        "paper": {"doi": "10.1/x", "title": "T", "journal": "J", "year": "2020", "authors": None}, "electrodes": [electrode],
    }
    (tmp_path / "a.json").write_text(json.dumps(record))
    (tmp_path / "b.json").write_text(json.dumps(record | {"schema_version": "1"}))
    records = J.scan_records_v2(spark, str(tmp_path), "2", "all", multi_line=True)
    e, m = R.corpora(records, ["binder"], ["scan_rate"], "full")
    assert [(x["schema_version"], x["title"], x["authors"], x["electrode_id"], x["n_measurements"], x["binder"], x["binder__source"]) for x in e.collect()] == [("2", "T", None, "E01", 1, "PVDF", "Table 1")]
    got = m.first()
    assert (got["electrode_label"], got["measurement_id"], got["measurement_label"], got["binder"], got["scan_rate"], got["scan_rate__unit"]) == ("film", "E01-M01", "CV at 2", "PVDF", "2", "mV s−1")
    with pytest.raises(Exception, match="another version"):
        J.scan_records_v2(spark, str(tmp_path), "2", "all", strict=True, multi_line=True).select("schema_version").collect()


def test_csv_by_name(spark, tmp_path):
    """Files with other headers, another order or a mark at the beginning: values stay with their names."""
    (tmp_path / "a.csv").write_text('x,y\n1,"2\nlines"\n')
    (tmp_path / "b.csv").write_text("y,x\n2,1\n")
    (tmp_path / "c c.csv").write_text("﻿x,z\n3,\n")
    want = [("1", "2\nlines", "", "a"), ("1", "2", "", "b"), ("3", "", "", "c c")]
    rows = T.scan_dir(spark, str(tmp_path), multi_line=True).select("x", "y", "z", "search_id")
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert sorted(map(tuple, T.scan_strings(spark, str(tmp_path), ["y", "x"], multi_line=True).collect())) == sorted((y, x) for x, y, _, _ in want)
    with pytest.raises(Exception):  # noqa: B017  what Spark raises where the header is not as told
        T.scan_strings(spark, str(tmp_path), ["x", "y"], one_header=True).collect()
    assert T.scan_dir(spark, str(tmp_path), ["y"]).where(F.col("search_id") == "b").first()["y"] == "2"
    assert T.scan_dir(spark, str(tmp_path / "b.csv"), ["y", "x"], one_header=True).collect()[0]["search_id"] == "b"
    (tmp_path / "none").mkdir()
    assert T.scan_dir(spark, str(tmp_path / "none"), ["y"]).collect() == [] and T.scan_strings(spark, str(tmp_path / "none"), ["y"]).columns == ["y"]


def test_absent_arrays_count_as_empty(spark):
    from mensura.operators import quality as Q

    v2 = [
        {"source_file": "none.pdf", "declared": 2, "n_measurements": 1},
        {"source_file": "bare.pdf", "declared": 1, "n_measurements": 3, "electrodes": [{"electrode_id": "E1", "label": "a", "is_primary": True, "n_measurements": 2, "fields": [{"name": "bogus", "value": "1"}]}]},
        {"source_file": "m.pdf", "declared": 1, "n_measurements": 1, "electrodes": [{"electrode_id": "E2", "label": "a", "is_primary": True, "n_measurements": 1, "measurements": [{"measurement_id": "M1"}]}]},
    ]
    schema = J.schema_v2() + ", declared int"
    records = spark.createDataFrame([{**r, "electrodes": r.get("electrodes")} for r in v2], schema)
    got = {}
    for r in Q.validate_v2(records, {"electrode": ["binder"], "measurement": ["scan_rate"]}, ["esr"]).collect():
        got.setdefault(r["source_file"], set()).add((r["code"], r["detail"]))
    assert got["none.pdf"] == {("electrode count mismatch", "2 vs 0"), ("measurement total mismatch", "1 vs 0"), ("empty record", "no electrodes")}
    assert got["bare.pdf"] == {("measurement total mismatch", "3 vs 0"), ("electrode measurement mismatch", "E1"), ("no measurements", "E1"), ("invalid electrode fields", "bogus")}
    assert got["m.pdf"] == {("no descriptors", "E2"), ("no target", "M1"), ("no condition", "M1")}
    v1 = spark.createDataFrame([("a.pdf", 2, None)], f"source_file string, declared int, electrodes {spark.createDataFrame([], J.schema_v1()).schema['electrodes'].dataType.simpleString()}")
    assert {(r["code"], r["detail"]) for r in Q.validate_v1(v1, fields=V1_FIELDS, capacitance=["gravimetric_capacitance"]).collect()} == {("count mismatch", "2 vs 0"), ("empty record", "no electrodes")}


def test_tagged_trees(spark, tmp_path):
    """A rerun of one tag leaves the files of the others as they are, and a tag is read from its folder alone."""
    path, rows = str(tmp_path / "out"), spark.createDataFrame([("a", "m1"), ("b", "m2"), ("c", "m2")], "paper string, model_tag string")
    T.write_tagged(rows, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "model_tag=m1").iterdir()}
    T.write_tagged(spark.createDataFrame([("d", "m2")], "paper string, model_tag string"), path)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "model_tag=m1").iterdir()} == before
    assert sorted((r["paper"], r["model_tag"]) for r in T.read_tagged(spark, path).collect()) == [("a", "m1"), ("d", "m2")]
    one = T.read_tagged(spark, path, "m1")
    assert [r["paper"] for r in one.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(model_tag" in one._jdf.queryExecution().toString()


def test_positions_for_one_split_or_many(spark, tmp_path):
    """Places in the file's own order, without a key, however small the splits are; blank lines are no rows."""
    lines = [f"{i * 7919 % 1000},v{i}" for i in range(3000)]
    (tmp_path / "a.csv").write_text("k,v\n" + "\n".join(lines[:2000]) + "\n")
    (tmp_path / "b.csv").write_text("k,v\n" + "\n\n".join(lines[2000:]))
    want = sorted([("a", i, f"v{i}") for i in range(2000)] + [("b", i - 2000, f"v{i}") for i in range(2000, 3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "4k", "500b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100b")
            rows = T.scan_positions(spark, str(tmp_path))
            assert sorted((r["search_id"], r["row_index"], r["v"]) for r in rows.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_papers_nest_as_the_views_do(spark, tmp_path):
    """Records made of a paper's keys are those of the joined views, also where orders stand twice, under two papers or without items."""
    from pyspark.sql import functions as F

    from mensura.operators import records as R
    from mensura.plans import fixtures as X
    from mensura.plans import record_queries as N

    sf = "/root/testdata/sf0.001"
    orders, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    some = orders.where("o_orderkey < 90")
    twice = some.where("o_orderkey % 7 = 0").unionByName(some.where("o_orderkey % 11 = 0").withColumn("o_custkey", F.col("o_custkey") + 1))
    some.unionByName(twice).write.parquet(f"{tmp_path}/orders.parquet")
    items.where("l_orderkey < 90 AND l_orderkey % 5 <> 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = R.nest_v2(X.electrodes(spark, str(tmp_path)), X.measurements(spark, str(tmp_path)), N.E_FIELDS, N.M_FIELDS)
    got = R.shape_v2(X.papers(spark, str(tmp_path)), N.E_FIELDS, N.M_FIELDS)
    by_paper = lambda df: {r["source_file"]: r.asDict(True) for r in df.select(*sorted(df.columns)).collect()}
    assert by_paper(got) == by_paper(want) and got.count() == want.count() > 10
    plan = N.measurement_table(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("RepartitionByExpression")
    assert "paper_" not in plan[plan.index("collect_list", plan.rindex("paper_")) :] and at > 0  # no text is made before the last shuffle


def test_records_without_what_is_not_read(spark):
    """Fields of measurements that a query doesn't read are not made, and all else of the records is as it was; papers are dealt over as many
    parts as shuffles have."""
    from mensura.plans import record_queries as N

    def by_paper(df, names=N.M_FIELDS):
        """Records by paper, measurements with fields of these names, each once: seventh ones repeat the first that they have."""
        out = {r["source_file"]: r.asDict(True) for r in df.collect()}
        for m in (m for r in out.values() for e in r["electrodes"] or [] for m in e["measurements"] or []):
            m["fields"] = [f for i, f in enumerate(m["fields"]) if f["name"] in names and f not in m["fields"][:i]]
        return out

    sf = "/root/testdata/sf0.001"
    for names in ((), ("gravimetric_capacitance",)):
        got = by_paper(N.records_v2(spark, sf, names))
        assert got == by_paper(N.records_v2(spark, sf), names) and len(got) > 10
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")  # whole plans
    try:
        plans = {n: N.QUERIES[n](spark, sf)._jdf.queryExecution().optimizedPlan().toString() for n in ("catalog_fields", "field_card_v2", "electrode_table_full", "overview_v2", "measurement_table")}
    finally:
        spark.conf.set(key, before)
    assert [n for n in plans if "micrometer-sized" in plans[n]] == ["overview_v2", "measurement_table"]
    assert [n for n in plans if "mA cm−2" in plans[n]] == ["measurement_table"]
    dealt = [p[p.index("RepartitionByExpression [o_custkey#") :].split("\n")[0] for p in plans.values()]
    assert all(d.endswith(", " + spark.conf.get("spark.sql.shuffle.partitions")) for d in dealt)


def test_card_takes_fields_before_its_rows(spark):
    """The fields are looked up in the electrode's row; its map isn't copied to each row of the card, not even for an electrode without one."""
    from mensura.plans import record_queries as N

    records = N.records_v2(spark, "/root/testdata/sf0.001", ())
    card = R.field_card_v2(records, [("binder", "c", "t"), ("flake_size", "c", "t")])
    assert "element_at" not in card._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    bare = spark.createDataFrame([{"source_file": "a.pdf", "electrodes": [{"electrode_id": "E1"}]}], J.schema_v2())
    assert [tuple(r)[2:4] + (r["value"], r["unit"]) for r in R.field_card_v2(bare, [("binder", "c", "t")]).collect()] == [(0, "binder", "Not reported", "—")]
