"""Vector codes by Lloyd's rounds over two trees.

Vectors are cut into parts; each part position has a codebook, and a part's code is the index of the nearest entry. A task turns
its vectors into blocks, an Arrow batch each. A block holds, for every position, a tree over the parts: points in the tree's order,
and for each node its box and the sum of its points. Blocks are written once; each round reads them.

A round walks the tree of each position beside a tree over the codebook. A pair (node of parts, node of entries) goes where its least
distance is above the greatest distance of another entry node that the node of parts still has; at single entries also where
another entry is nearer over the whole box (the difference of two squared distances is linear, so its maximum lies in a
corner). A node left with one entry is assigned whole, from its cached sum. Leaves with several go point by point. All
distances are integers, so results are those of plain comparison, ties included.

What leaves a task is a sum and a count for each (position, entry): the driver sees places * entries rows a round, whatever the
number of vectors. Labels may be hot: errors are summed by (label, salt) first and return by a join on both.

Defined results: dropped are vectors that are null, hold a null or a component that is not finite, or have another length than
most (of the multiples of `places`, the most frequent length, the smaller of equals; none: all go). Scaled components stand at
the bound that keeps errors within a long, 2 ** 27 for 64 components, if they are beyond it (|x| over 524,288). Where ids
repeat, the first vectors are taken in the order of id, then components; null ids come last. Fewer kept vectors than entries give
as many entries. Equal entries: the lower index. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

PLACES = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 8  # points in a leaf, twice that at most
SALTS = 64  # parts that the rows of one label are dealt over


def _ends(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: halves of halves of n points."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


class Forest:
    """A balanced tree over the points of each place: points [dimension, place, point], ordered so that a node is a slice."""

    def __init__(self, points: np.ndarray, leaf: int):
        places, n = points.shape[1:]
        self.depth = max(0, (n // leaf).bit_length() - 1)
        self.order = np.broadcast_to(np.arange(n), (places, n))
        for level in range(self.depth):
            starts, sizes = _ends(n, level)[:-1], np.diff(_ends(n, level))
            widest = (np.maximum.reduceat(points, starts, axis=2) - np.minimum.reduceat(points, starts, axis=2)).argmax(axis=0)
            key = np.take_along_axis(points, np.repeat(widest, sizes, axis=1)[None], 0)[0].astype(np.int64)
            key -= key.min(initial=0)
            ranks = (np.repeat(np.arange(len(starts)), sizes) * (key.max(initial=0) + 1) + key).argsort(axis=1)  # within nodes
            points = np.take_along_axis(points, ranks[None], 2)
            self.order = np.take_along_axis(self.order, ranks, 1)
        self.points = points
        starts = [_ends(n, level)[:-1] for level in range(self.depth + 1)]
        self.low = [np.minimum.reduceat(points, s, axis=2) for s in starts]
        self.high = [np.maximum.reduceat(points, s, axis=2) for s in starts]
        self.sums = [np.add.reduceat(points, s, axis=2, dtype=np.int64) for s in starts]

    def packed(self) -> dict[str, bytes]:
        flat = lambda levels, kind: np.concatenate(levels, axis=2).astype(kind).tobytes()
        return {
            "points": self.points.astype(np.int32).tobytes(), "places": self.order.astype(np.int32).tobytes(),
            "low": flat(self.low, np.int32), "high": flat(self.high, np.int32), "sums": flat(self.sums, np.int64),
        }

    @classmethod
    def unpacked(cls, row: dict, n: int, places: int, leaf: int) -> Forest:
        self = cls.__new__(cls)
        self.depth = max(0, (n // leaf).bit_length() - 1)
        self.order = np.frombuffer(row["places"], np.int32).reshape(places, n).astype(np.int64)
        self.points = np.frombuffer(row["points"], np.int32).reshape(-1, places, n)
        edges = np.cumsum([1 << level for level in range(self.depth)])
        levels = lambda name, kind: np.split(np.frombuffer(row[name], kind).reshape(-1, places, (2 << self.depth) - 1), edges, axis=2)
        self.low, self.high, self.sums = levels("low", np.int32), levels("high", np.int32), levels("sums", np.int64)
        return self

    def exact(self, other: Forest) -> type:
        """The narrower type that holds squared distances to the other's points."""
        most = max(int(np.abs(side).max(initial=0)) for f in (self, other) for side in (f.low[0], f.high[0]))
        return np.int32 if 16 * len(self.points) * most * most < 1 << 31 else np.int64

    def like(self, kind: type) -> Forest:
        out = Forest.__new__(Forest)
        out.depth, out.order, out.sums = self.depth, self.order, self.sums
        out.points, out.low, out.high = self.points.astype(kind), [a.astype(kind) for a in self.low], [a.astype(kind) for a in self.high]
        return out


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal neighbours begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member and its number within it."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - (np.cumsum(sizes) - sizes)[group]


class Walk:
    """The pairs (node of parts, node of entries) of all places, from both roots down: `whole` has the nodes assigned by one entry as
    (level, place, node, entry), `single` the points of the leaves left over as (place, point, entry)."""

    def __init__(self, parts: Forest, book: Forest):
        self.whole: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        kind = parts.exact(book)
        parts, book = parts.like(kind), book.like(kind)
        places, n = parts.order.shape
        entries = book.order.shape[1]
        level = at = 0  # of the parts and of the entries
        alone = False  # entry nodes are single entries
        place, node, entry = np.arange(places), np.zeros(places, np.int64), np.zeros(places, np.int64)
        while True:
            if alone:
                low = high = book.points[:, place, entry]
            else:
                low, high = book.low[at][:, place, entry], book.high[at][:, place, entry]
            box_low, box_high = parts.low[level][:, place, node], parts.high[level][:, place, node]
            near = (np.maximum(0, np.maximum(low - box_high, box_low - high)) ** 2).sum(axis=0, dtype=kind)
            far = (np.maximum(high - box_low, box_high - low) ** 2).sum(axis=0, dtype=kind)
            starts = _firsts(place, node)
            sizes = np.diff(np.append(starts, len(place)))
            limit = np.repeat(np.minimum.reduceat(far, starts), sizes)
            keep = near <= limit
            if alone:  # against the entry of the least greatest distance: where that one is nearer in every corner
                group = np.repeat(np.arange(len(starts)), sizes)
                hits = np.flatnonzero(far == limit)
                best = low[:, hits[_firsts(group[hits])]][:, group]
                apart = low - best
                gain = (2 * np.maximum(box_low * apart, box_high * apart) - (low + best) * apart).sum(axis=0, dtype=kind)
                keep &= gain >= 0
            place, node, entry = place[keep], node[keep], entry[keep]
            if alone:
                starts = _firsts(place, node)
                sizes = np.diff(np.append(starts, len(place)))
                done = np.repeat(sizes == 1, sizes)
                if done.any():
                    self.whole.append((level, place[done], node[done], book.order[place[done], entry[done]]))
                    place, node, entry = place[~done], node[~done], entry[~done]
                if level == parts.depth or not len(place):
                    break
            if level < parts.depth:  # both halves of a node inherit its pairs
                place, node, entry = (np.repeat(a, 2) for a in (place, node, entry))
                node = 2 * node + np.arange(len(node)) % 2
                level += 1
                ranks = (place * (1 << level) + node).argsort(kind="stable")
                place, node, entry = place[ranks], node[ranks], entry[ranks]
            if at < book.depth:
                place, node, entry = (np.repeat(a, 2) for a in (place, node, entry))
                entry = 2 * entry + np.arange(len(entry)) % 2
                at += 1
            elif not alone:
                ends = _ends(entries, at)
                group, number = _spread(ends[entry + 1] - ends[entry])
                place, node, entry = place[group], node[group], ends[entry[group]] + number
                alone = True
        self._resolve(parts, book, place, node, entry, n)

    def _resolve(self, parts: Forest, book: Forest, place: np.ndarray, node: np.ndarray, entry: np.ndarray, n: int) -> None:
        """Points of leaves with several entries: integer distances, of equal ones the lower index."""
        index = book.order[place, entry]
        ranks = np.lexsort((index, node, place))
        place, node, entry, index = place[ranks], node[ranks], entry[ranks], index[ranks]
        starts = _firsts(place, node)
        choices = np.diff(np.append(starts, len(place)))
        ends = _ends(n, parts.depth)
        first, sizes = ends[node[starts]], ends[node[starts] + 1] - ends[node[starts]]
        leaf, number = _spread(sizes * choices)
        of = choices[leaf]
        point, pair = first[leaf] + number // of, starts[leaf] + number % of
        spot = place[pair]
        distance = ((parts.points[:, spot, point] - book.points[:, spot, entry[pair]]) ** 2).sum(axis=0, dtype=parts.points.dtype)
        begins = np.flatnonzero(number % of == 0)
        least = np.repeat(np.minimum.reduceat(distance, begins), of[begins]) if len(begins) else distance
        hits = np.flatnonzero(distance == least)
        hits = hits[_firsts(spot[hits], point[hits])] if len(hits) else hits
        self.single = spot[hits], point[hits], index[pair[hits]]


def totals(parts: Forest, walk: Walk, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums [dimension, place, entry] and counts [place, entry] of the parts by their entry."""
    width, places, n = parts.points.shape
    sums, counts = np.zeros((width, places * entries), np.int64), np.zeros(places * entries, np.int64)
    taken = [(place * entries + entry, parts.sums[level][:, place, node], np.diff(_ends(n, level))[node]) for level, place, node, entry in walk.whole]
    place, point, entry = walk.single
    taken.append((place * entries + entry, parts.points[:, place, point], np.ones(len(place), np.int64)))
    for at, values, rows in taken:
        np.add.at(counts, at, rows)
        for d in range(width):
            np.add.at(sums[d], at, values[d])
    return sums.reshape(width, places, entries), counts.reshape(places, entries)


def choices(parts: Forest, walk: Walk) -> np.ndarray:
    """The entry of each part, [place, point] in the order of the block."""
    places, n = parts.order.shape
    out = np.zeros((places, n), np.int64)
    for level, place, node, entry in walk.whole:
        ends = _ends(n, level)
        of, number = _spread(ends[node + 1] - ends[node])
        out[place[of], ends[node[of]] + number] = entry[of]
    place, point, entry = walk.single
    out[place, point] = entry
    back = np.empty_like(out)
    np.put_along_axis(back, parts.order, out, 1)
    return back


def _book(codebook: np.ndarray) -> Forest:
    """A tree over the entries of codebooks [place, entry, dimension]."""
    return Forest(np.ascontiguousarray(codebook.transpose(2, 0, 1)), 1)  # never without entries: no vector, no block


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", places: int = PLACES, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): whole vectors as scaled integers."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    whole = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % places == 0))
    whole = whole.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = whole.groupBy(F.size(x).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), "length").first()  # one row
    length = usual["length"] if usual else places
    bound = 1 << (62 - length.bit_length()) // 2  # length * (2 * bound) ** 2 fits a long, and so do sums of a block
    small = lambda c: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(c * scale)))
    within = lambda c: F.greatest(F.lit(-float(bound)), F.least(F.lit(float(bound)), c))
    return whole.where(F.size(x) == length).select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.transform(x, lambda c: small(within(c)).cast("int")).alias("v")
    )


def blocks(rows: DataFrame, places: int, leaf: int) -> DataFrame:
    """Rows of kept() as blocks: a row an Arrow batch, with ids, labels and the trees over its parts."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType))])
    for name in ("points", "places", "low", "high", "sums"):
        schema = schema.add(name, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            points = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, places, -1)
            points = np.ascontiguousarray(points.transpose(2, 1, 0))
            columns = {name: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(c)) for name, c in (("ids", "vec_id"), ("labels", "label"))}
            columns |= {k: pa.array([v], pa.binary()) for k, v in Forest(points, leaf).packed().items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, schema)


def _walks(batch: pa.RecordBatch, book: Forest, places: int, leaf: int) -> Iterator[tuple[int, Forest, Walk]]:
    for i, row in enumerate(batch.select(["points", "places", "low", "high", "sums"]).to_pylist()):
        parts = Forest.unpacked(row, len(row["places"]) // (4 * places), places, leaf)
        yield i, parts, Walk(parts, book)


def round_of(stored: DataFrame, codebook: np.ndarray, leaf: int) -> np.ndarray:
    """The codebook after a round: each entry the floored mean of its parts; unused ones stay."""
    places, entries, width = codebook.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, sums, counts = _book(codebook), np.zeros((width, places, entries), np.int64), np.zeros((places, entries), np.int64)
        for b in batches:
            for _, parts, walk in _walks(b, book, places, leaf):
                s, c = totals(parts, walk, entries)
                sums, counts = sums + s, counts + c
        place, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"place": place, "entry": entry, "n": counts[place, entry], "total": pa.array(list(sums[:, place, entry].T), pa.list_(pa.int64()))})

    partial = stored.mapInArrow(run, "place long, entry long, n long, total array<long>")
    summed = partial.groupBy("place", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(width))).alias("total"))
    new = codebook.copy()
    for r in summed.collect():  # a row an entry at most
        new[r["place"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return new


def coded(stored: DataFrame, codebook: np.ndarray, leaf: int) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the blocks."""
    places = codebook.shape[0]
    ids, labels = stored.schema["ids"].dataType.elementType, stored.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", ids), T.StructField("label", labels), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(codebook) if codebook.size else None
        for b in batches:
            for i, parts, walk in _walks(b, book, places, leaf):
                chosen = choices(parts, walk)
                points = np.empty(parts.points.shape, np.int64)
                np.put_along_axis(points, parts.order[None], parts.points, 2)
                error = ((points.transpose(1, 2, 0) - codebook[np.arange(places)[:, None], chosen]) ** 2).sum(axis=(0, 2))
                digits = chosen.T.astype(np.uint8).tobytes().hex()
                code = [digits[at : at + 2 * places] for at in range(0, len(digits), 2 * places)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return stored.mapInArrow(run, schema)


def vector_codes(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", places: int = PLACES, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, leaf: int = LEAF, salts: int = SALTS
) -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector: vec_id, code (two hex digits a part), error, label_error; and the codebooks [place, entry, dimension]."""
    if entries > 256:
        raise ValueError("codes have two hex digits: at most 256 entries")
    rows = kept(vectors, vec_id, embedding, label, places, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = len(first[0]["v"]) // places if first else 1
    codebook = np.array([r["v"] for r in first], np.int64).reshape(len(first), places, width).transpose(1, 0, 2)
    stored = cut(blocks(rows, places, leaf), "blocks")
    for _ in range(rounds if first else 0):
        codebook = round_of(stored, codebook, leaf)
    out = coded(stored, codebook, leaf).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    out = cut(out, "codes")
    parts = out.groupBy("label", "salt").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("part"))
    whole = parts.groupBy("label").agg(F.sum("part").cast("long").alias("label_error")).withColumnRenamed("label", "l")
    whole = parts.join(whole, F.col("label").eqNullSafe(F.col("l"))).select("l", F.col("salt").alias("s"), "label_error")
    out = out.join(whole, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    return out.select("vec_id", "label", "code", "error", "label_error"), codebook


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, codebook = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    ranked = lambda book: f"""SELECT vec_id, p, e, dist FROM (SELECT vec_id, p, e, dist, row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, e) AS place FROM
        (SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c)) AS dist FROM x JOIN {book} b ON x.p = b.p AND x.j = b.j GROUP BY 1, 2, 3)) WHERE place = 1"""  # noqa: E731
    steps = []
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({ranked(f'b{i}')})")
        steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, CAST(coalesce(m.c, b.c) AS BIGINT) AS c FROM b{i} b LEFT JOIN
            (SELECT a.p, a.e, x.j, CAST(floor(sum(x.c) / count(*)) AS BIGINT) AS c FROM a{i} a JOIN x USING (vec_id, p) GROUP BY 1, 2, 3) m USING (p, e, j))""")
    return f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS c
    FROM (SELECT vec_id, embedding, len(embedding) // {PLACES} AS w, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, e, j, c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{", ".join(steps)}, f AS MATERIALIZED ({ranked(f"b{ROUNDS}")}),
v AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256 FROM v JOIN k USING (vec_id)"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
SQL = {"op11_vector_codes": _sql()}
