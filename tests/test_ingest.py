"""Record files as they arrive: none is lost, none is taken twice, and a batch does not read what is stored."""

import json
import shutil

from mensura.functions.catalog import V1_FIELDS
from mensura.operators import records as R
from mensura.sources import records as J
from mensura.streaming.ingest import incremental_ingest


def record(label, **head):
    cells = {f: {"value": None, "unit": None, "note": None, "confidence": None} for f in V1_FIELDS}
    return {"model": "m", "n_electrodes": 1, "electrodes": [{"label": label, "role": "primary", "is_primary": True, "fields": cells}], **head}


def run(spark, path):
    incremental_ingest(spark, f"{path}/in", J.schema_v1(), lambda b: R.flatten_v1(b, V1_FIELDS), f"{path}/out", f"{path}/checkpoint", files_per_batch=2)


def stored(spark, path):
    return sorted((r["source_file"], r["electrode_label"]) for r in spark.read.parquet(f"{path}/out/rows").collect())


def test_records_without_a_path(spark, tmp_path):
    """Three records of one model, no source_path: three rows, by the names of their files and what they hold."""
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(record(name)))
    (tmp_path / "in" / "two.json").write_text("\n".join(json.dumps(record(x)) for x in ("d", "e", "e")))  # a line is a record; the last one repeats
    run(spark, tmp_path)
    assert stored(spark, tmp_path) == [("a.json", "a"), ("b.json", "b"), ("c.json", "c"), ("two.json", "d"), ("two.json", "e")]


def test_keys_are_state(spark, tmp_path):
    """Two files, then one more and a repeat, then nothing new. What is stored is not looked at: it may be gone."""
    (tmp_path / "in").mkdir()
    put = lambda file, label, path, model="m": (tmp_path / "in" / file).write_text(json.dumps(record(label, source_path=path, source_file=path, model=model)))
    put("1.json", "one", "p1")
    put("2.json", "two", "p2")
    run(spark, tmp_path)
    assert stored(spark, tmp_path) == [("p1", "one"), ("p2", "two")]
    put("3.json", "again", "p1")  # known
    put("4.json", "other", "p1", "n")  # of another model
    put("5.json", "none", "p1", None)
    run(spark, tmp_path)
    assert stored(spark, tmp_path) == [("p1", "none"), ("p1", "one"), ("p1", "other"), ("p2", "two")]
    shutil.rmtree(tmp_path / "out")
    put("6.json", "six", "p2")
    put("7.json", "seven", "p7")
    run(spark, tmp_path)
    assert stored(spark, tmp_path) == [("p7", "seven")]
    run(spark, tmp_path)
    assert stored(spark, tmp_path) == [("p7", "seven")]
