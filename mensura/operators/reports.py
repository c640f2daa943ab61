"""Coverage, confidence and group reports; each one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored

BANDS = ((60.0, "usable"), (30.0, "marginal"))


def _as_text(df: DataFrame, c: str) -> Column:
    """A value as text, equal for equal values: no two zeros."""
    kind = dict(df.dtypes)[c]
    value = F.col(f"`{c}`")
    return F.to_json(F.struct(value.alias("v"))) if kind.startswith(("array", "struct", "map")) else (value + F.lit(0).cast(kind) if kind in ("float", "double") else value).cast("string")


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_distinct): rows are turned to (column, value) once, and equal ones meet before they move; no row is copied whole for
    each column."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in cols)))
    return df.select(cells.alias("c")).select("c.*").where("value IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def column_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, filled, sketch): what column_audit needs, in one pass and in a form that can be kept for each paper or run and
    merged later. The sketch is a HyperLogLog of the values."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("filled"), F.hll_sketch_agg(_as_text(df, c), F.lit(12)).alias("sketch")).alias(f"s_{i}"))
    rows = df.groupBy(*by).agg(*aggs)
    return rows.select(*by, "n", F.explode(F.array(*(f"s_{i}" for i in range(len(cols))))).alias("s")).select(*by, "s.column", "n", "s.filled", "s.sketch")


def merged_profile(profiles: DataFrame) -> DataFrame:
    """Kept profiles as one: per column filled, percent missing, and the estimated number of distinct values, which is off by about 1.6 percent."""
    one = profiles.groupBy("column").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch"))
    return one.select("column", "filled", F.round(100 * (1 - F.col("filled") / F.nullif("n", F.lit(0))), 1).alias("missing_pct"), F.hll_sketch_estimate("sketch").alias("n_distinct"))


def distinct_count(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """One row: how many distinct values a column has, or an estimate that keeps no values."""
    return df.agg((F.count_distinct(F.col(column)) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(_as_text(df, column), F.lit(12)))).alias("n_distinct"))


def column_audit(df: DataFrame, cols: Sequence[str], distinct: bool = True) -> DataFrame:
    """Per column: filled, percent missing, distinct."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"s_{i}") for i, c in enumerate(cols)))
    rows = one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s_{i}").alias("filled")) for i, c in enumerate(cols)))).alias("r")).select("n", "r.*")
    rows = rows.select("column", "filled", F.round(100 * (1 - F.col("filled") / F.nullif("n", F.lit(0))), 1).alias("missing_pct"))
    if not distinct:
        return rows.withColumn("n_distinct", F.lit(None).cast("long"))
    return rows.join(distinct_counts(df, cols), "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def coverage(df: DataFrame, cols: Sequence[str], bands: Sequence[tuple[float, str]] = BANDS, rest: str = "sparse") -> DataFrame:
    out = column_audit(df, cols, distinct=False).select("column", "filled", F.round(100 - F.col("missing_pct"), 1).alias("pct"))
    status = F.when(F.lit(False), "")
    for least, name in bands:
        status = status.when(F.col("pct") >= least, name)
    return out.withColumn("status", status.otherwise(rest))


def confidence_breakdown(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Counts of stated, derived and uncertain per field, and whether derived outnumbers stated."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), F.col(f"{f}__conf")).alias("conf")) for f in fields))
    rows = df.select(F.explode(cells).alias("c")).select("c.*").where("conf IS NOT NULL")
    of = lambda v: F.count_if(F.col("conf") == v).alias(v)
    return rows.groupBy("field").agg(of("stated"), of("derived"), of("uncertain")).withColumn("check", F.col("derived") > F.col("stated"))


def rows_per_group(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
    return out.limit(top) if top else out


def distinct_per_group(df: DataFrame, key: str, member: str) -> DataFrame:
    return df.select(key, member).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def group_size_stats(df: DataFrame, key: str, exact: bool = True) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    facts = [F.max("n").alias("max"), F.min("n").alias("min"), F.count(F.lit(1)).alias("groups")]
    if not exact:
        return sizes.agg(F.percentile_approx("n", 0.5).cast("double").alias("median"), *facts)
    sizes = stored(sizes, "sizes")
    return sizes.agg(*facts).join(grouped_median(sizes, [], "n")).select("median", "max", "min", "groups")  # one row each


def oversized(df: DataFrame, key: str, most: int, first: int | None = None) -> DataFrame:
    """Groups of more rows than that, or the first of them, largest first."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return out.orderBy(F.desc("n"), key).limit(first) if first else out


def condition_subset(df: DataFrame, target: str, condition: str, ids: Sequence[str] = ()) -> DataFrame:
    """Rows that have both the target and the condition it was measured at."""
    return df.where(F.col(target).isNotNull() & F.col(condition).isNotNull()).select(*ids, condition, target)


def usable_counts(df: DataFrame, target: str, conditions: dict[str, str]) -> DataFrame:
    """One row: rows with the target, and with it and each condition, by the conditions' names."""
    t = F.col(target).isNotNull()
    return df.agg(F.count_if(t).alias("target"), *(F.count_if(t & F.col(c).isNotNull()).alias(name) for name, c in conditions.items()))


def conversion_audit(df: DataFrame, converted: dict[str, str], ids: Sequence[str] = ()) -> DataFrame:
    """Raw value, unit and result side by side, where any of the fields was converted. converted: field -> result."""
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in converted.values()))
    return df.where(some).select(*ids, *(c for f, name in converted.items() for c in (f, f"{f}__unit", name)))


def confidence_filter(df: DataFrame, field: str, levels: Sequence[str] = ("stated",), ids: Sequence[str] = ()) -> DataFrame:
    """Rows whose field has one of the confidences."""
    return df.where(F.col(f"{field}__conf").isin(*levels)).select(*ids, field)


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def target_summary(df: DataFrame, targets: dict[str, str], paper: str = "source_file", exact: bool = True) -> DataFrame:
    """Per target: unit, rows, papers, least, median, most. Targets without a row are left out. exact=False takes percentile_approx."""
    cells = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(u).alias("unit"), F.col(t).cast("double").alias("value")) for t, u in targets.items()))
    rows = df.select(paper, F.explode(cells).alias("c")).select(paper, "c.*").where("value IS NOT NULL")
    rows = stored(rows, "targets") if exact else rows  # read again for the medians
    facts = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(paper).alias("papers"), F.min("value").alias("least"), F.max("value").alias("most")]
    if not exact:
        return rows.groupBy("target", "unit").agg(*facts, F.percentile_approx("value", 0.5).alias("median"))
    return rows.groupBy("target", "unit").agg(*facts).join(F.broadcast(grouped_median(rows, ["target"], "value")), "target")  # a row a target


def target_coverage(df: DataFrame, targets: Sequence[str], paper: str = "source_file") -> DataFrame:
    one = df.agg(*(F.struct(F.lit(t).alias("target"), F.count(t).alias("n_rows"), F.count_distinct(F.when(F.col(t).isNotNull(), F.col(paper))).alias("papers")).alias(t) for t in targets))
    return one.select(F.explode(F.array(*targets)).alias("r")).select("r.*")


def within_paper_contrast(df: DataFrame, value: str, control: str = "control", variant: str = "variant", key: str = "source_file") -> DataFrame:
    """Means of a paper's variants and controls, side by side: an aggregate each, so a large paper makes no pairs."""
    mean = lambda role: F.avg(F.when(F.col("role") == role, F.col(value)))
    out = df.groupBy(key).agg(mean(control).alias("control"), mean(variant).alias("variant"))
    return out.where("control IS NOT NULL AND variant IS NOT NULL").withColumn("difference", F.col("variant") - F.col("control"))


def dedupe_measurements(df: DataFrame, keys: Sequence[str], order: str = "measurement_id") -> DataFrame:
    """Of rows equal in all keys, nulls among them, the whole one that comes first by `order`, then by its other columns. A partial
    minimum goes before the shuffle, so copies of one measurement never meet as rows."""
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min(F.struct(F.col(order), *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*(F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns))


def _range_of(value: Column, edges: Sequence) -> Column:
    """How many of the sorted edges lie below a value, by halving."""
    if not edges:
        return F.lit(0)

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(edges[middle]) < value, halved(middle + 1, high)).otherwise(halved(low, middle))

    return halved(0, len(edges))


def running_counts(df: DataFrame, value: str, weight: str | None = None, steps: int = 256) -> DataFrame:
    """(v, n, rows, upto): each distinct value that is not null, how many rows it stands for, how many it has, and the number up to and
    with it. weight: what a row stands for.

    The counts of the values are written once. No task orders them all: they are cut into ranges at approximate quantiles (at most
    `steps` numbers come to the driver), summed within each range, and a small table of the ranges gives what lies before.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = stored(counts, "counts")
    edges = counts.agg(F.percentile_approx("v", [i / steps for i in range(1, steps)], 10 * steps)).first()[0]
    counts = counts.withColumn("range", _range_of(F.col("v"), sorted(set(edges or []))))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("own"))
    ranges = ranges.select("range", (F.sum("own").over(W.orderBy("range")) - F.col("own")).alias("before"))  # at most `steps` rows
    within = F.sum("n").over(W.partitionBy("range").orderBy("v"))
    return counts.withColumn("within", within).join(F.broadcast(ranges), "range").select("v", "n", "rows", (F.col("before") + F.col("within")).alias("upto"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """The element at n div 2 of the sorted values."""
    running = stored(running_counts(df, value), "running")
    half = running.agg(F.expr("sum(n) div 2").alias("half"))
    return running.join(F.broadcast(half)).where("upto > half").agg(F.min("v").alias("upper_median"))  # one row


HOT = 512  # a value that more than this part of all rows share goes by broadcast: there are fewer than HOT of them


def join_by_value(df: DataFrame, column: str, facts: DataFrame, key: str, rows: str, hot: int = HOT) -> DataFrame:
    """df with the columns of facts (one row a value of `key`; `rows`: how many rows of df have it) by its value, null where none.

    Values that more than 1 / hot of the rows share are fewer than hot, so they are broadcast; of the others, none is a large part of
    a join's task.
    """
    names = [c for c in facts.columns if c not in (key, rows)]
    total = facts.agg((F.sum(rows) / F.lit(float(hot))).alias("limit"))
    marked = stored(facts.join(F.broadcast(total)), "by-value")  # one row
    often = marked.where(F.col(rows) > F.col("limit")).select(F.col(key).alias("_often"), *(F.col(c).alias(f"_often_{c}") for c in names))
    seldom = marked.where(F.col(rows) <= F.col("limit")).select(F.col(key).alias("_seldom"), *(F.col(c).alias(f"_seldom_{c}") for c in names))
    out = df.join(F.broadcast(often), F.col(column) == F.col("_often"), "left")
    # rows that have met their value look for no other; without one they are spread, not sent to one task
    rest = F.when(F.col("_often").isNull(), F.col(column))
    out = out.withColumn("_rest", rest)
    met = out.where("_rest IS NULL").select(*df.columns, *(F.col(f"_often_{c}").alias(c) for c in names))
    unmet = out.where("_rest IS NOT NULL").join(seldom.hint("merge"), F.col("_rest") == F.col("_seldom"), "left").select(*df.columns, *(F.col(f"_seldom_{c}").alias(c) for c in names))
    return met.unionByName(unmet)


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, by distinct value; null where the value is. df should be a written table: it is read three times."""
    ranks = running_counts(df, value).select(F.col("v").alias("_v"), F.col("rows").alias("_n"), (F.col("upto") - (F.col("n") - 1) / 2).alias(name))
    return join_by_value(df, value, ranks, "_v", "_n")


INSIDE = 1_000_000  # rows of a group among which its median is sought at last


def grouped_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median", accuracy: int = 10_000, inside: int = INSIDE) -> DataFrame:
    """(by, name): the exact median of each group, by selection: a mergeable sketch brackets the ranks in the middle of all groups at
    once, rows within the brackets are counted by value, and those are bracketed again while a group has more than `inside` of them.

    No task holds the values of a group: a sketch has some `accuracy` numbers, and what is ordered at last is what the brackets
    left. A value that many rows share is one row of the counts.
    """
    rows = stored(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_by_{i}"]) for i, c in enumerate(by)), F.lit(True))
    named = [F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    sizes = rows.groupBy(*by).agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_values"))
    groups = stored(sizes.select(*named, F.expr("(_size - 1) div 2").alias("_low"), F.expr("_size div 2").alias("_high"), "_values", F.lit(0).cast("long").alias("_below")), "groups")
    while (groups.agg(F.max("_values")).first()[0] or 0) > inside:
        # of the values left, by their rows: the sketch is of distinct values, so ranks are bracketed by sums at its points
        points = [i / 256 for i in range(257)]
        edges = rows.groupBy(*by).agg(F.percentile_approx("_v", points, accuracy).alias("_edges")).select(*named, "_edges")
        cut = stored(rows.join(edges, same(rows, edges)).select(*by, "_v", "_n", F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("_range")), "ranges")
        sums = cut.groupBy(*by, "_range").agg(F.sum("_n").alias("_own"), F.count(F.lit(1)).alias("_values"))
        order = W.partitionBy(*by).orderBy("_range")
        sums = sums.select(*named, "_range", "_values", (F.sum("_own").over(order) - F.col("_own")).alias("_before"), F.sum("_own").over(order).alias("_upto"))
        old = groups.select(*(F.col(f"_by_{i}").alias(f"_old_{i}") for i in range(len(by))), "_low", "_high", "_below")
        meets = reduce(lambda x, y: x & y, (F.col(f"_by_{i}").eqNullSafe(F.col(f"_old_{i}")) for i in range(len(by))), F.lit(True))
        held = sums.join(old, meets).where((F.col("_below") + F.col("_before") <= F.col("_high")) & (F.col("_below") + F.col("_upto") > F.col("_low")))
        names = [f"_by_{i}" for i in range(len(by))]
        held = stored(held.select(*names, "_range", "_values", "_low", "_high", (F.col("_below") + F.col("_before")).alias("_below")), "held")
        keys = held.select(*names, F.col("_range").alias("_kept"))
        rows = stored(cut.join(keys, same(cut, keys) & (F.col("_range") == F.col("_kept"))).select(*by, "_v", "_n"), "values")
        before = groups.agg(F.max("_values")).first()[0]
        groups = stored(held.groupBy(*names).agg(F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.sum("_values").alias("_values"), F.min("_below").alias("_below")), "groups")
        if groups.agg(F.max("_values")).first()[0] == before:
            break  # no bracket can part them further
    upto = F.sum("_n").over(W.partitionBy(*by).orderBy("_v"))
    placed = rows.select(*by, "_v", "_n", upto.alias("_upto"))
    placed = placed.join(groups, same(placed, groups)).withColumn("_upto", F.col("_upto") + F.col("_below"))
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    return placed.groupBy(*by).agg(((at("_low") + at("_high")) / 2).alias(name))


def min_coverage_features(df: DataFrame, cols: Sequence[str], least: int) -> list[str]:
    row = df.agg(*(F.count(c).alias(c) for c in cols)).first()
    return [c for c in cols if row[c] >= least]


def drop_uninformative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """df without the columns that have one value at most: least and greatest tell, so no values are kept."""
    row = df.agg(*(F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(c) for c in cols)).first()
    return df.drop(*(c for c in cols if not row[c]))


def schema_summary(df: DataFrame, top: int | None = 20) -> DataFrame:
    """Type, filled, percent missing and distinct of every column; most missing first."""
    types = F.create_map(*(F.lit(v) for pair in df.dtypes for v in pair))
    out = column_audit(df, df.columns).select("column", F.element_at(types, F.col("column")).alias("dtype"), "filled", "missing_pct", "n_distinct").orderBy(F.desc("missing_pct"), "column")
    return out if top is None else out.limit(top)


def feature_coverage(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Filled, percent filled and distinct per feature, over labelled rows only where a target is given; fullest first."""
    rows = df if target is None else df.where(F.col(target).isNotNull())
    out = column_audit(rows, cols)
    return out.select("column", "filled", F.round(100 - F.col("missing_pct"), 1).alias("pct"), "n_distinct").orderBy(F.desc("pct"), "column")


def catalog_coverage(df: DataFrame, cols: Sequence[str], catalog: DataFrame) -> DataFrame:
    """Coverage of the catalog's features, core tier first, fullest first within a tier. catalog: feature, tier, ...; it is small."""
    known = F.broadcast(catalog.select(F.col("feature").alias("column"), "tier"))
    return coverage(df, cols).join(known, "column", "left").select("tier", "column", "filled", "pct").orderBy(F.asc_nulls_last("tier"), F.desc("pct"), "column")


def paper_slice(df: DataFrame, key: str, seed: int = 42, papers: int = 1) -> DataFrame:
    """The rows of the papers that come first by a seeded hash."""
    first = df.select(key).distinct().withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).orderBy("h").limit(papers)
    return df.join(F.broadcast(first.drop("h")), key, "left_semi")


def target_subset(df: DataFrame, target: str, features: Sequence[str], group: str = "source_file") -> DataFrame:
    """Labelled rows: the features, the target and the group."""
    return df.where(F.col(target).isNotNull()).select(group, *features, target)
