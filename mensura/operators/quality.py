"""Checks of nested records; each gives rows (source_file, code, detail). A record is read once: its checks are one array of
issues, made by functions over its own arrays, and exploded at the end."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that state a measurement's condition.
CONDITIONS = ("current_density", "scan_rate", "cycle_number", "test_type")
MOST_MEASUREMENTS = 100
ISSUE = "array<struct<code:string,detail:string>>"


def _list(of: Column) -> Column:
    """An absent array is an empty one."""
    return F.coalesce(of, F.array())


def _issue(code: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))


def _issues(*each: Column) -> Column:
    return F.filter(F.array(*each), lambda i: i.isNotNull())


def _once(value: Column, body) -> Column:
    """body of value, with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(names: Column) -> Column:
    """Names that occur twice or more, trimmed and lower-cased, sorted, joined; null where there are none."""
    ordered = F.array_sort(F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: n != ""))
    twice = _once(ordered, lambda s: F.array_distinct(F.filter(s, lambda n, i: F.coalesce(F.get(s, i - 1) == n, F.lit(False)))))
    return F.nullif(F.array_join(twice, ", "), F.lit(""))


def _unknown(names: Column, known: Sequence[str]) -> Column:
    """Names that the catalog doesn't have, sorted, joined; null where there are none."""
    strange = F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(*known))))
    return F.nullif(F.array_join(strange, ", "), F.lit(""))


def _exploded(records: DataFrame, issues: Column) -> DataFrame:
    return records.select("source_file", F.explode(issues).alias("i")).select("source_file", "i.code", "i.detail")


def validate_v1(records: DataFrame, declared: str = "declared", fields: Sequence[str] = (), capacitance: Sequence[str] = ()) -> DataFrame:
    electrodes = _list(F.col("electrodes"))
    n = F.size(electrodes)
    primary = F.size(F.filter(electrodes, lambda e: e["is_primary"]))

    def of_electrode(e: Column) -> Column:
        value = lambda f: e["fields"][f]["value"]
        filled = reduce(lambda a, b: a + b, (value(f).isNotNull().cast("int") for f in fields))
        sparse = _issue("sparse electrode", filled <= 2, F.concat_ws(":", e["label"], filled))
        if not capacitance:
            return _issues(sparse)
        none = F.coalesce(*(F.nullif(value(f), F.lit("")) for f in capacitance)).isNull()
        return _issues(sparse, _issue("no capacitance", none, e["label"]))

    labels = _repeats(F.transform(electrodes, lambda e: e["label"]))
    of_record = _issues(
        _issue("count mismatch", ~F.col(declared).eqNullSafe(n), F.concat_ws(" vs ", F.col(declared), n)),
        _issue("empty record", n == 0, F.lit("no electrodes")),
        _issue("no primary", (n > 0) & (primary == 0), primary),
        _issue("many primaries", primary > 1, primary),
        _issue("duplicate labels", labels.isNotNull(), labels),
    )
    return _exploded(records, F.concat(of_record, F.flatten(F.transform(electrodes, of_electrode))))


def validate_v2(records: DataFrame, names: dict[str, Sequence[str]], targets: Sequence[str], declared: str = "declared", declared_measurements: str = "n_measurements") -> DataFrame:
    """names: level (electrode, measurement) -> the catalog's fields."""
    electrodes = _list(F.col("electrodes"))
    measured = lambda e: _list(e["measurements"])
    field_names = lambda x: _list(x["fields"]["name"])
    n = F.size(electrodes)
    total = F.aggregate(electrodes, F.lit(0), lambda a, e: a + F.size(measured(e)))
    primary = F.size(F.filter(electrodes, lambda e: e["is_primary"]))
    repeated = lambda x: F.size(field_names(x)) > F.size(F.array_distinct(field_names(x)))

    def of_measurement(m: Column) -> Column:
        has = lambda wanted: F.exists(field_names(m), lambda f: F.coalesce(f.isin(*wanted), F.lit(False)))
        return _issues(
            _issue("repeated measurement field", repeated(m), m["measurement_id"]),
            _issue("no target", ~has(targets), m["measurement_id"]),
            _issue("no condition", ~has(CONDITIONS), m["measurement_id"]),
        )

    def of_electrode(e: Column) -> Column:
        own = _issues(
            _issue("repeated electrode field", repeated(e), e["electrode_id"]),
            _issue("electrode measurement mismatch", ~e["n_measurements"].eqNullSafe(F.size(measured(e))), e["electrode_id"]),
            _issue("no descriptors", F.size(field_names(e)) == 0, e["electrode_id"]),
            _issue("no measurements", F.size(measured(e)) == 0, e["electrode_id"]),
        )
        return F.concat(own, F.flatten(F.transform(measured(e), of_measurement)))

    ids = F.flatten(F.transform(electrodes, lambda e: F.transform(measured(e), lambda m: m["measurement_id"])))
    lists = {
        "duplicate labels": _repeats(F.transform(electrodes, lambda e: e["label"])),
        "duplicate electrode ids": _repeats(F.transform(electrodes, lambda e: e["electrode_id"])),
        "duplicate measurement ids": _repeats(ids),
        "invalid electrode fields": _unknown(F.flatten(F.transform(electrodes, field_names)), names["electrode"]),
        "invalid measurement fields": _unknown(F.flatten(F.flatten(F.transform(electrodes, lambda e: F.transform(measured(e), field_names)))), names["measurement"]),
    }
    of_record = _issues(
        _issue("electrode count mismatch", ~F.col(declared).eqNullSafe(n), F.concat_ws(" vs ", F.col(declared), n)),
        _issue("measurement total mismatch", ~F.col(declared_measurements).eqNullSafe(total), F.concat_ws(" vs ", F.col(declared_measurements), total)),
        _issue("empty record", n == 0, F.lit("no electrodes")),
        _issue("primary count", (n > 0) & (primary != 1), primary),
        _issue("too many measurements", total > MOST_MEASUREMENTS, total),
        *(_issue(code, found.isNotNull(), found) for code, found in lists.items()),
    )
    return _exploded(records, F.concat(of_record, F.flatten(F.transform(electrodes, of_electrode))))


def attention_report(failures: DataFrame, issues: DataFrame) -> DataFrame:
    """Failed papers with their reason, flagged papers with all warnings."""
    flagged = issues.groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "code", "detail"))), "; ").alias("detail"))
    failed = failures.select("source_file", F.lit("failed").alias("kind"), F.col("reason").alias("detail"))
    return failed.unionByName(flagged.select("source_file", F.lit("flagged").alias("kind"), "detail"))
