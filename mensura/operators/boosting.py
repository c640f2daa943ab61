"""Boosted trees with penalties, many models grown side by side.

Rows are binned once, into blocks of whole numbers that stay with the executors. A tree grows by levels: one aggregate a level gives
the sums of gradients and rows by (model, node, feature, bin) for all models at once: all folds, settings and targets. What a
task hands on is as large as this table, whatever its rows are; tables are added in a tree of tasks, and the driver takes the best splits
from the sum. A fit of any number of models costs as many jobs as its longest one has levels.

Splits are those of second-order boosting for squared errors (gradient g = prediction - target, second derivative 1): with
T(G) = sign(G) * max(|G| - l1, 0), a node of gradient sum G and n rows has the score T(G)^2 / (n + l2) and the value -T(G) / (n + l2);
a split gains half the difference of scores less gamma, and is made where that is above zero and both sides have `least` rows. Rows
without a value go to the side where they gain more. A category is parted one value against the rest.

Rows whose features have the same bins are dealt to one block, hot ones to a run of blocks, and told apart only by target, fold and hash: their
predictions and sides are kept once. A block's rows are read once a tree, for the sums of its sample by vector and fold; levels read the vectors.
Tables are not added feature by feature over the rows: features in a row of which few joint values occur share a code, the sums are
taken by code, and each feature's from those. Both are exact and need no knowledge of other blocks.

Targets and predictions are rounded to whole numbers of fine steps, so that sums don't depend on the order in which blocks are added; rows
are sampled by a hash of their content, features by a seeded draw a tree. A fit is therefore the same however rows are dealt, after lost
executors too. The predictions are kept in cached blocks, cut by a checkpoint every CUT trees.

Arrays added elementwise within partitions have no form as columns that keeps their size, so this module works on blocks in an RDD, as
the trees of pyspark.ml do; all else is DataFrames.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .splits import fold_count, group_fold, median_baseline
from .storage import lineage_folder

#: The settings of the three models.
PRESETS = {
    "strict": {"trees": 400, "step": 0.03, "depth": 3, "least": 3, "rows": 0.8, "columns": 0.8, "l1": 0.1, "l2": 1.0, "gamma": 0.0},
    "gcd": {"trees": 250, "step": 0.03, "depth": 2, "least": 3, "rows": 0.8, "columns": 0.8, "l1": 0.1, "l2": 1.0, "gamma": 0.0},
    "lenient": {"trees": 400, "step": 0.03, "depth": 2, "least": 4, "rows": 0.8, "columns": 0.8, "l1": 1.0, "l2": 10.0, "gamma": 0.0},
}
#: What the search draws from.
GRID = {
    "trees": (150, 250, 400, 600, 800), "step": (0.01, 0.02, 0.03, 0.05, 0.08), "depth": (2, 3, 4), "least": (1, 2, 3, 5, 8),
    "rows": (0.65, 0.8, 1.0), "columns": (0.65, 0.8, 1.0), "l1": (0.0, 0.05, 0.1, 0.5, 1.0), "l2": (0.5, 1.0, 2.0, 5.0, 10.0),
}

BINS = 64  # bins of a numeric feature, beside the one of missing values
WIDEST = 1_000  # values of a category that have a bin of their own
ROWS_A_BLOCK = 1_000_000
STATE_BYTES = 64_000_000  # of a block's predictions, one by model and vector
ROWS_A_SUM = 100_000  # rows whose sum of steps is below 2 ** 53 whatever they are
JOINT = 1 << 16  # joint values that features share a code for, at most
CUT = 100  # trees between checkpoints
TASK_BYTES = 256_000_000  # of a frame that is packed for models which each grow within a task; larger frames are left to fit_all
PIECE = 1 << 15  # rows whose hashes are mixed at a time
FLAT = 16  # partitions whose tables are added on the driver; more are added by tasks first,
FLAT_BYTES = 64_000_000  # unless their tables are no larger in all


@dataclass
class Bins:
    """How raw columns become bins: upper edges of numeric features, known values of categories; bin 0 is for all else."""

    numeric: dict[str, list[float]]
    categorical: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 2 for e in self.numeric.values()] + [len(v) + 1 for v in self.categorical.values()]

    def of(self, batch: pd.DataFrame) -> np.ndarray:
        """[row, feature]"""
        out = np.zeros((len(batch), len(self.names)), np.int32)
        for j, (name, edges) in enumerate(self.numeric.items()):
            x = batch[name].to_numpy(np.float64, na_value=np.nan)
            out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, "left"))
        for j, (name, values) in enumerate(self.categorical.items(), len(self.numeric)):
            known = {v: i + 1 for i, v in enumerate(values)}
            out[:, j] = [known.get(v, 0) for v in batch[name]]
        return out

    def columns(self) -> list:
        """The features as doubles and strings, by their names."""
        return [*(F.col(c).cast("double").alias(c) for c in self.numeric), *(F.col(c).cast("string").alias(c) for c in self.categorical)]


def fit_bins(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], rare: int = 1, bins: int = BINS) -> Bins:
    """Edges at quantiles of the values, and the values of categories seen `rare` times at least. No target is looked at. Columns
    without any value are left out; a category of more than WIDEST frequent values is an error."""
    edges: dict[str, list[float]] = {}
    if numeric:
        at = [i / bins for i in range(1, bins)]
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = df.agg(*(F.percentile_approx(value(c), at, 100 * bins).alias(c) for c in numeric)).first()  # a row of `bins` numbers a feature
        edges = {c: sorted(set(row[c])) for c in numeric if row[c]}
    values: dict[str, list[str]] = {}
    if categorical:
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical)))
        seen = df.select(cells.alias("x")).where("x.v IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rare).select("x.*")
        for r in seen.limit(len(categorical) * WIDEST + 1).collect():
            values.setdefault(r["c"], []).append(r["v"])
        if wide := [c for c, v in values.items() if len(v) > WIDEST]:
            raise ValueError(f"{', '.join(sorted(wide))}: more than {WIDEST} frequent values; it is no category")
    return Bins(edges, {c: sorted(values[c]) for c in categorical if c in values})


@dataclass
class Trees:
    """A fitted model. Nodes are in the order of a heap: 2 i + 1 and 2 i + 2 lie below i. A row goes left where its bin is `bin`
    at most (numeric) or equal to it (category); without a value, where `missing` is set."""

    bins: Bins
    base: float
    setting: dict
    feature: np.ndarray  # [tree, node], -1: a leaf
    bin: np.ndarray
    missing: np.ndarray
    value: np.ndarray
    rows: np.ndarray  # of the training rows, sampled ones, in each node
    gain: np.ndarray
    facts: dict = field(default_factory=dict)

    def sides(self, binned: np.ndarray, tree: int, node: np.ndarray) -> np.ndarray:
        """Whether each row goes left at a node."""
        return _left(binned, self.feature[tree][node], self.bin[tree][node], self.missing[tree][node], len(self.bins.numeric))

    def predict(self, binned: np.ndarray) -> np.ndarray:
        out, columns = np.full(len(binned), self.base), np.ascontiguousarray(binned.T, np.uint16)
        for t in range(len(self.feature)):
            out += self.value[t][_walked(columns, self.feature[t], self.bin[t], self.missing[t], len(self.bins.numeric), self.setting["depth"])]
        return out

    def to_json(self) -> str:
        arrays = {k: getattr(self, k).tolist() for k in ("feature", "bin", "missing", "value", "rows", "gain")}
        return json.dumps({"bins": asdict(self.bins), "base": self.base, "setting": self.setting, "facts": self.facts, **arrays})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        return cls(Bins(**d["bins"]), d["base"], d["setting"], *(np.array(d[k]) for k in ("feature", "bin", "missing", "value", "rows", "gain")), d["facts"])


def _left(binned: np.ndarray, feature: np.ndarray, bin_: np.ndarray, missing: np.ndarray, numeric: int) -> np.ndarray:
    b = binned[np.arange(len(binned)), feature]
    return np.where(feature < numeric, np.where(b == 0, missing, b <= bin_), b == bin_)


def _walked(columns: np.ndarray, feature: np.ndarray, bin_: np.ndarray, missing: np.ndarray, numeric: int, levels: int, node: np.ndarray | None = None, start: int = 0) -> np.ndarray:
    """The node of each row after so many levels, from its node after `start` of them. columns: [feature, row], unsigned."""
    node = np.zeros(columns.shape[1], np.int16) if node is None else node
    for level in range(start, levels):
        below = node.copy()
        for i in range((1 << level) - 1, (2 << level) - 1):
            if (f := feature[i]) < 0:
                continue
            column, b = columns[f], columns.dtype.type(bin_[i])
            left = column == b if f >= numeric else column <= b if missing[i] else column - columns.dtype.type(1) < b  # 0 becomes the greatest
            below = np.where(node == i, np.int16(2 * i + 2) - left, below)
        node = below
    return node


@dataclass
class Frame:
    """Rows to train on: a written table with the target, the features and `part`, the fold of a row; rows of a negative part are
    never trained on."""

    df: DataFrame
    bins: Bins
    target: str
    part: str


@dataclass
class Model:
    """One fit: the frame, its setting and the fold left out (None: all are trained on)."""

    frame: int
    setting: dict
    out: int | None = None

    def trained(self, part: np.ndarray) -> np.ndarray:
        return (part >= 0) if self.out is None else (part >= 0) & (part != self.out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _sampled(hashes: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray | bool:
    if share >= 1:
        return True
    u = _mixed(hashes + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return u < np.uint64(int(share * 2.0**63) * 2)


def _features_of(n: int, share: float, seed: int, tree: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[np.random.default_rng([seed, tree]).permutation(n)[: max(1, round(share * n))]] = True
    return out


@dataclass
class Rows:
    """Binned rows [row, feature] with what a fit needs of them."""

    binned: np.ndarray
    target: np.ndarray
    part: np.ndarray
    hashes: np.ndarray


@dataclass
class Lots:
    """Rows in the order of their vectors, parts and hashes; a lot are those of one vector and part."""

    whole: np.ndarray  # of each row: its target in steps
    hashes: np.ndarray
    start: np.ndarray  # of each lot: its first row
    part: np.ndarray
    vector: np.ndarray
    first: np.ndarray  # of each vector: its first lot

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start, append=len(self.whole))

    def sums(self, share: float, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each lot: how many rows a tree takes, and the sum of their targets."""
        if share >= 1:
            return self.sizes, np.add.reduceat(self.whole, self.start)
        taken = np.empty(len(self.whole), np.int64)
        for at in range(0, len(taken), PIECE):
            taken[at : at + PIECE] = _sampled(self.hashes[at : at + PIECE], share, seed, tree)
        n = np.add.reduceat(taken, self.start)
        taken *= self.whole
        return n, np.add.reduceat(taken, self.start)


@dataclass
class Block:
    """Some rows of a frame, in the order of their vectors of bins, and what its models predict for each vector so far."""

    frame: int
    scale: float
    columns: np.ndarray  # [feature, vector]
    codes: list[tuple[list[int], np.ndarray, np.ndarray]]  # features, [vector] -> joint value, bins [feature, joint value]
    lots: Lots | None  # the rows; None where sums of the tree at hand are kept
    predicted: np.ndarray  # [model, vector]
    kept: dict = field(default_factory=dict)  # of the tree at hand: sums by sample, nodes by model

    def sums(self, model: Model, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector: how many rows a tree of the model takes, and the sum of their targets."""
        share = model.setting["rows"]
        key = "sums", share, model.out
        if self.kept.get(key, (None,))[0] != tree:
            if self.kept.get(("lots", share), (None,))[0] != tree:
                self.kept["lots", share] = tree, *self.lots.sums(share, seed, tree)
            trained = model.trained(self.lots.part)
            self.kept[key] = tree, *(np.add.reduceat(np.where(trained, x, 0), self.lots.first) for x in self.kept["lots", share][1:])
        return self.kept[key][1:]

    def node(self, m: int, growing: _Growing, numeric: int, level: int, tree: int) -> np.ndarray:
        """Of each vector: where model m's tree has it after so many levels."""
        at, done, node = self.kept.get(("node", m), (None, 0, None))
        if at != tree or done > level:
            done, node = 0, None
        node = _walked(self.columns, growing.feature[m], growing.bin[m], growing.missing[m], numeric, level, node, done)
        self.kept["node", m] = tree, level, node
        return node


def _added_up(at: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, exact: by halves where they could pass what a double holds."""
    if np.abs(whole).sum(dtype=np.float64) < 2.0**52:
        return np.bincount(at, whole, size).astype(np.int64)
    high, low = (np.bincount(at, w, size).astype(np.int64) for w in (whole >> 26, whole & (1 << 26) - 1))
    return (high << 26) + low


def _joint(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row that is equal where all columns are, and a row for each number. columns: [feature, row]"""
    code, span = np.zeros(columns.shape[1], np.int64), 1
    for column in columns:
        size = int(column.max(initial=0)) + 1
        if span * size >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            span = len(found)
        code, span = code * size + column, span * size
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _codes(columns: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Runs of features that share a code, as long as their joint values are few beside the vectors."""
    most = min(JOINT, max(1024, columns.shape[1] // 8))
    runs: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for f in range(len(columns)):
        code, first = _joint(np.stack([runs[-1][1], columns[f]])) if runs else _joint(columns[:1])
        if runs and len(first) <= most:
            runs[-1] = [*runs[-1][0], f], code, first
        else:
            runs.append(([f], *(_joint(columns[f : f + 1]))))
    return [(features, code.astype(np.uint16), columns[features][:, first].astype(np.intp)) for features, code, first in runs]


def _packed(rows: Rows, frame: int, models: int, scale: float) -> Block:
    code, first = _joint(np.ascontiguousarray(rows.binned.T))
    columns = np.ascontiguousarray(rows.binned[first].T, np.uint16)
    whole = np.rint(rows.target * scale).astype(np.int64)
    return Block(frame, scale, columns, _codes(columns), _lots(code, rows.part, rows.hashes, whole), np.zeros((models, len(first))))


def _lots(vector: np.ndarray, part: np.ndarray, hashes: np.ndarray, whole: np.ndarray) -> Lots:
    """Of rows whose vectors are numbered from 0 without gaps."""
    order = np.lexsort((hashes, part, vector))
    vector, part = vector[order], part[order]
    start = np.flatnonzero(np.diff(vector, prepend=-1) | (np.diff(part, prepend=part[:1]) != 0))
    vector = vector[start].astype(np.int32)
    return Lots(whole[order], hashes[order], start, part[start], vector, np.flatnonzero(np.diff(vector, prepend=-1)))


def _merged(blocks: list[Block]) -> Block:
    """One block of the rows of several of a frame."""
    columns = np.concatenate([b.columns for b in blocks], axis=1)
    code, first = _joint(columns)
    columns = np.ascontiguousarray(columns[:, first])
    before = np.cumsum([0, *(b.columns.shape[1] for b in blocks)])
    every = [(code[at + np.repeat(b.lots.vector, b.lots.sizes)], np.repeat(b.lots.part, b.lots.sizes), b.lots.hashes, b.lots.whole) for at, b in zip(before, blocks, strict=False)]
    return Block(blocks[0].frame, blocks[0].scale, columns, _codes(columns), _lots(*(np.concatenate(x) for x in zip(*every, strict=True))), np.zeros((len(blocks[0].predicted), len(first))))


def _rows(frame: Frame, parts: int, share: float | None = None):
    """An RDD of rows, those of a partition together; of a share of the rows where one is given. Rows are dealt by ranges of the hash of their
    features, so that equal vectors meet, and within it by row, so that a hot vector is parted; alike each time."""
    content = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(frame.df.columns) if c != frame.part))
    rows = frame.df.where(F.col(frame.target).isNotNull())
    rows = rows.select(*frame.bins.columns(), F.col(frame.target).cast("double").alias("_y"), F.col(frame.part).cast("int").alias("_part"), content.alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    if share is not None:
        rows = rows.where(F.pmod(F.xxhash64("_row", "_hash", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    bins = frame.bins

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cells = [bins.of(b).astype(np.uint16), b["_y"].to_numpy(np.float64), b["_part"].fillna(-1).to_numpy(np.int32), b["_hash"].to_numpy(np.int64)]
                yield pd.DataFrame([[len(b), *(c.tobytes() for c in cells)]], columns=["n", "binned", "y", "part", "hash"])

    def unpacked(r) -> Rows:
        read = lambda raw, kind: np.frombuffer(bytes(raw), kind)
        return Rows(read(r["binned"], np.uint16).reshape(r["n"], -1), read(r["y"], np.float64), read(r["part"], np.int32), read(r["hash"], np.uint64))

    dealt = rows.repartitionByRange(parts, F.xxhash64(*frame.bins.columns()), F.xxhash64("_hash", "_row")).mapInPandas(run, "n int, binned binary, y binary, part binary, hash binary")
    return dealt.rdd.map(unpacked).mapPartitions(_joined)


@dataclass
class _Growing:
    """The trees that all models grow at this time: arrays [model, node]."""

    feature: np.ndarray
    bin: np.ndarray
    missing: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    @classmethod
    def blank(cls, models: int, nodes: int) -> _Growing:
        whole, real = (lambda: np.zeros((models, nodes), np.int64)), (lambda: np.zeros((models, nodes)))
        return cls(np.full((models, nodes), -1), whole(), np.zeros((models, nodes), bool), real(), whole(), real())


def _table(block: Block, models: list[Model], active: list[int], growing: _Growing, level: int, tree: int, seed: int, scale: float, frames: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sums of gradients and rows [place among the active, node of the level, bin, 2] of a block."""
    numeric, starts = frames[block.frame]
    width, nodes = int(starts[-1]), 1 << level
    mine = {m: i for i, m in enumerate(m for m, model in enumerate(models) if model.frame == block.frame)}
    out = np.zeros((len(active), nodes, width, 2), np.int64)
    for place, m in enumerate(active):
        n, t = block.sums(models[m], tree, seed)
        g = n * np.rint(block.predicted[mine[m]] * scale).astype(np.int64) - t
        node = block.node(m, growing, numeric, level, tree).astype(np.intp) - (nodes - 1)
        kept = np.flatnonzero((n > 0) & (node >= 0))  # others have no row in the sample, or ended in a leaf above
        n, g, node = n[kept], g[kept], node[kept]
        for features, code, bins in block.codes:
            joint = bins.shape[1]
            cell = node * joint + code[kept]
            sums = _added_up(cell, g, nodes * joint), _added_up(cell, n, nodes * joint)
            for f, of in zip(features, bins, strict=True):
                size = int(starts[f + 1] - starts[f])
                at = (np.arange(nodes)[:, None] * size + of).ravel()
                for k, by_code in enumerate(sums):
                    out[place, :, starts[f] : starts[f + 1], k] = _added_up(at, by_code, nodes * size).reshape(nodes, size)
    return out


def _shrunk(g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _score(g: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    return np.divide(_shrunk(g, l1) ** 2, n + l2, out=np.zeros(np.broadcast_shapes(g.shape, n.shape)), where=n + l2 > 0)


def _value(g: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    return np.divide(-_shrunk(g, l1), n + l2, out=np.zeros(g.shape), where=n + l2 > 0)


class _Candidates:
    """The splits that a level's table offers, in the order in which equal gains are taken: by feature; numeric ones with missing values
    to the right, then to the left, bins upwards; of a category each value against the rest."""

    def __init__(self, bins: Bins):
        starts = np.cumsum([0, *bins.sizes])
        self.width, self.first = int(starts[-1]), int(starts[1])
        at, less, own, feature, bin_, missing = [], [], [], [], [], []
        for f, size in enumerate(bins.sizes):
            cells = np.arange(starts[f], starts[f + 1])
            if f < len(bins.numeric):  # sums up to a bin, less those up to the missing ones or before them
                for left in (False, True):
                    at.append(cells[1:-1])
                    less.append(np.full(size - 2, starts[f] if not left else starts[f] - 1))
                    missing.append(np.full(size - 2, left))
            else:
                at.append(cells)
                less.append(cells - 1)
                missing.append(np.zeros(size, bool))
            for part in at[len(own) :]:
                own.append(np.full(len(part), f))
                bin_.append(part - starts[f])
        self.at, self.less, self.feature, self.bin, self.missing = (np.concatenate(x) for x in (at, less, own, bin_, missing))

    def sums(self, cells: np.ndarray) -> np.ndarray:
        """Of each candidate's left side. cells: [model, node, bin]"""
        up = np.zeros((*cells.shape[:2], self.width + 1), np.int64)
        np.cumsum(cells, axis=2, out=up[:, :, 1:])
        return up[:, :, self.at + 1] - up[:, :, self.less + 1]


def _split(table: np.ndarray, scale: float, offered: _Candidates, settings: list[dict], allowed: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of each node. table: [model, node, bin, 2]; allowed: [model, feature]."""
    of = lambda name: np.array([s[name] for s in settings], float)[:, None]
    l1, l2, gamma, least = of("l1"), of("l2"), of("gamma"), of("least")
    whole = table[:, :, : offered.first].sum(axis=2)  # every row has one bin of the first feature
    total_g, total_n = whole[..., 0] / scale, whole[..., 1].astype(float)
    parent = _score(total_g, total_n, l1, l2)
    left_g, left_n = offered.sums(table[..., 0]) / scale, offered.sums(table[..., 1]).astype(float)
    right_g, right_n = total_g[..., None] - left_g, total_n[..., None] - left_n
    gain = (_score(left_g, left_n, l1[..., None], l2[..., None]) + _score(right_g, right_n, l1[..., None], l2[..., None]) - parent[..., None]) / 2 - gamma[..., None]
    floor = np.maximum(least[..., None], 1)
    gain[(left_n < floor) | (right_n < floor) | ~allowed[:, None, offered.feature]] = -np.inf
    at = gain.argmax(axis=2)
    take = lambda v: np.take_along_axis(v, at[..., None], 2)[..., 0]
    best = take(gain)
    made = best > 1e-12
    named = {"feature": (offered.feature, -1), "bin": (offered.bin, 0), "missing": (offered.missing, False)}
    out = {name: np.where(made, values[at], none) for name, (values, none) in named.items()}
    return out | {"gain": np.where(made, best, 0.0), "left_g": take(left_g), "left_n": take(left_n), "g": total_g, "n": total_n}


def _stepped(block: Block, models: list[Model], growing: _Growing, active: list[int], numeric: list[int], tree: int) -> Block:
    """The block after a tree of each active model."""
    own = [m for m, model in enumerate(models) if model.frame == block.frame]
    predicted = block.predicted.copy()
    for i, m in enumerate(own):
        if m in active:
            predicted[i] += growing.value[m][block.node(m, growing, numeric[block.frame], models[m].setting["depth"], tree)]
    return replace(block, predicted=predicted, kept={})


def _added(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def _summed(rdd, size: int) -> dict:
    """size: bytes of a partition's sums"""
    parts = rdd.getNumPartitions()
    return rdd.fold({}, _added) if parts <= FLAT or parts * size <= FLAT_BYTES else rdd.treeAggregate({}, _added, _added, 2)


def _base(whole: list[tuple[int, int]], scales: Sequence[float], models: Sequence[Model]) -> list[float]:
    return [int(y) / scales[m.frame] / int(n) if n else 0.0 for (y, n), m in zip(whole, models, strict=True)]


def _scale(n: int, most: float) -> float:
    """Steps so fine that the sum of gradients of ROWS_A_SUM rows is whole within 53 bits, and that of all rows within 63."""
    bits = math.ceil(math.log2(4 * most + 1))
    return 2.0 ** min(32, 52 - bits - math.ceil(math.log2(ROWS_A_SUM)), 62 - bits - math.ceil(math.log2(n + 1)))


def _trained_sums(b: Block, models: Sequence[Model]) -> dict:
    """Of each model's training rows in a block: the sum of targets, in steps, and their number."""
    found = {}
    whole = np.add.reduceat(b.lots.whole, b.lots.start)
    for m, model in enumerate(models):
        if model.frame == b.frame:
            rows = model.trained(b.lots.part)
            found[m] = np.array([whole[rows].sum(), b.lots.sizes[rows].sum()])
    return found


def _errors(b: Block, models: Sequence[Model]) -> dict:
    """Of each model: the sum of absolute errors and the number of the rows of the fold that it leaves out."""
    found, sizes = {}, b.lots.sizes
    for i, m in enumerate(m for m, model in enumerate(models) if model.frame == b.frame):
        lots = b.lots.part == models[m].out if models[m].out is not None else np.zeros(len(sizes), bool)
        rows, vector = np.repeat(lots, sizes), np.repeat(b.lots.vector[lots], sizes[lots])
        found[m] = np.array([np.abs(np.maximum(0, b.predicted[i][vector]) - b.lots.whole[rows] / b.scale).sum(), len(vector)])
    return found


def _begun(b: Block, models: Sequence[Model], base: Sequence[float]) -> Block:
    own = [base[m] for m, model in enumerate(models) if model.frame == b.frame]
    return replace(b, predicted=b.predicted + np.array(own)[:, None], kept={})


def _state(b: Block, models: Sequence[Model], tree: int, seed: int) -> tuple[np.ndarray, dict]:
    """What changes from tree to tree: the predictions, and the sums that the models' next tree takes."""
    for model in models:
        if model.frame == b.frame and tree < model.setting["trees"]:
            b.sums(model, tree, seed)
    return b.predicted, {k: v for k, v in b.kept.items() if k[0] == "sums"}


def _tables(b: Block, asked: tuple) -> dict:
    models, open_, growing, shapes, scales, level, tree, seed = asked
    mine = [m for m in open_ if models[m].frame == b.frame]
    return {b.frame: _table(b, models, mine, growing, level, tree, seed, scales[b.frame], shapes)} if mine else {}


def _grown(bins: Sequence[Bins], models: Sequence[Model], base: Sequence[float], scales: Sequence[float], seed: int, tables: Callable[[tuple], dict], advance: Callable[[_Growing, list[int], int], None]) -> list[Trees]:
    """All trees of all models. tables: what is asked of a level -> its table by frame; advance: takes the rows past a tree."""
    offered, shapes = [_Candidates(b) for b in bins], [(len(b.numeric), np.cumsum([0, *b.sizes])) for b in bins]
    deepest = max(m.setting["depth"] for m in models)
    grown: list[list[tuple]] = [[] for _ in models]
    for tree in range(max(m.setting["trees"] for m in models)):
        active = open_ = [m for m, model in enumerate(models) if tree < model.setting["trees"]]
        growing = _Growing.blank(len(models), (2 << deepest) - 1)
        drawn: dict[tuple, np.ndarray] = {}
        for level in range(deepest):
            above = slice((1 << level - 1) - 1, (1 << level) - 1) if level else None
            open_ = [m for m in open_ if level < models[m].setting["depth"] and (above is None or (growing.feature[m][above] >= 0).any())]
            if not open_:
                break
            for frame, table in tables((models, open_, growing, shapes, scales, level, tree, seed)).items():
                mine = [m for m in open_ if models[m].frame == frame]
                chosen = [models[m].setting for m in mine]
                for share in {s["columns"] for s in chosen}:
                    if (frame, share) not in drawn:
                        drawn[frame, share] = _features_of(len(bins[frame].names), share, seed, tree)
                allowed = np.array([drawn[frame, s["columns"]] for s in chosen])
                _placed(growing, mine, level, _split(table, scales[frame], offered[frame], chosen, allowed), chosen)
        for m in active:
            nodes = (2 << models[m].setting["depth"]) - 1
            grown[m].append(tuple(getattr(growing, k)[m, :nodes].copy() for k in ("feature", "bin", "missing", "value", "rows", "gain")))
        advance(growing, active, tree)
    return [Trees(bins[model.frame], base[m], model.setting, *(np.array(a) for a in zip(*grown[m], strict=True))) for m, model in enumerate(models)]


def _known(frames: Sequence[Frame]) -> list[tuple[int, float, int]]:
    """Rows with a target, the greatest size of a target, and about how many vectors of features these rows have, of each frame."""
    if any(not f.bins.names for f in frames):
        raise ValueError("no feature has a value")
    facts = [f.df.where(F.col(f.target).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col(f.target).cast("double"))).alias("most"), F.approx_count_distinct(F.xxhash64(*f.bins.columns())).alias("vectors")).first() for f in frames]
    return [(k["n"], k["most"] or 0.0, k["vectors"]) for k in facts]


def fit_all(frames: Sequence[Frame], models: Sequence[Model], seed: int = 42) -> tuple[list[Trees], list[tuple[float, int]]]:
    """The models, grown side by side on all rows, and for each the sum of absolute errors and the number of the rows of the fold it leaves
    out (predictions never below zero)."""
    frames, models = list(frames), list(models)
    spark = frames[0].df.sparkSession
    context = spark.sparkContext
    lineage_folder(spark)
    known = _known(frames)
    scales = [_scale(n, most) for n, most, _ in known]
    own = [sum(model.frame == i for model in models) for i in range(len(frames))]
    parts = [max(math.ceil(n / min(ROWS_A_BLOCK, STATE_BYTES // (8 * max(1, own[i])))), round(context.defaultParallelism * n / max(1, sum(k[0] for k in known)))) for i, (n, *_) in enumerate(known)]
    blocks = _by_one(context.union([_rows(f, max(1, parts[i])).map(lambda r, i=i: _packed(r, i, own[i], scales[i])) for i, f in enumerate(frames)])).persist(StorageLevel.MEMORY_AND_DISK)
    sums = _summed(blocks.map(lambda b: _trained_sums(b, models)), 16 * len(models))
    base = _base([tuple(sums.get(m, (0, 0))) for m in range(len(models))], scales, models)
    vectors = _by_one(blocks.map(lambda b: replace(b, lots=None))).persist(StorageLevel.MEMORY_AND_DISK)
    numeric = [len(f.bins.numeric) for f in frames]
    kept = [_by_one(blocks.map(lambda b: _state(_begun(b, models, base), models, 0, seed))).persist(StorageLevel.MEMORY_AND_DISK)]

    def tables(asked: tuple) -> dict:
        shared = context.broadcast(asked)
        size = sum(16 * sum(frames[models[m].frame].bins.sizes) << asked[5] for m in asked[1])
        out = _summed(vectors.zip(kept[-1]).map(lambda b: _tables(replace(b[0], predicted=b[1][0], kept=b[1][1]), shared.value)), size)
        shared.unpersist()
        return out

    def advance(growing: _Growing, active: list[int], tree: int) -> None:
        kept.append(_advanced(blocks.zip(kept[-1]), models, growing, active, numeric, tree, seed).persist(StorageLevel.MEMORY_AND_DISK))
        if tree % CUT == CUT - 1:
            kept[-1].checkpoint()
            kept[-1].count()
        if len(kept) > 2:
            kept.pop(0).unpersist()  # what the newest is made of stays until that is there

    out = _grown([f.bins for f in frames], models, base, scales, seed, tables, advance)
    left = _summed(blocks.zip(kept[-1]).map(lambda b: _errors(replace(b[0], predicted=b[1][0]), models)), 16 * len(models))
    for rdd in (*kept, vectors, blocks):
        rdd.unpersist()
    return out, [(float(left[m][0]), int(left[m][1])) if m in left else (0.0, 0) for m in range(len(models))]


def _by_one(rdd):
    """An RDD whose elements are written one by one, as zip() needs to pair them without writing them anew."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _advanced(rdd, models: list[Model], growing: _Growing, active: list[int], numeric: list[int], tree: int, seed: int):
    return _by_one(rdd.map(lambda b: _state(_stepped(replace(b[0], predicted=b[1][0]), models, growing, active, numeric, tree), models, tree + 1, seed)))


def fit_each(frames: Sequence[Frame], models: Sequence[Model], seed: int = 42, most_rows: int | None = None, trees_of: Callable[[Model], bool] = lambda m: True) -> tuple[list[Trees | None], list[tuple[float, int]]]:
    """As fit_all, on all rows; of frames that a task can hold, each model in a task of its own.

    For searches and folds: a level of a small table costs less than the job that asks for it. Packed rows, some 32 bytes each and 4 a feature
    for each vector of bins, are shipped to all tasks once; frames that would take more than TASK_BYTES are grown by fit_all. Both give the
    same models. trees_of: the models whose trees are wanted; of the others only the errors come back. most_rows: only where a caller wants a
    sample of about so many labelled rows instead; no query does.
    """
    frames, models = list(frames), list(models)
    spark = frames[0].df.sparkSession
    known = _known(frames)
    packed = [32 * n + (4 * len(f.bins.names) + 64) * vectors for f, (n, _, vectors) in zip(frames, known, strict=True)]
    large = [i for i, size in enumerate(packed) if size > TASK_BYTES and most_rows is None]
    out: list[tuple[Trees | None, tuple[float, int]]] = [(None, (0.0, 0))] * len(models)
    if apart := [m for m, model in enumerate(models) if model.frame in large]:
        fitted, errors = fit_all([frames[i] for i in large], [replace(models[m], frame=large.index(models[m].frame)) for m in apart], seed)
        for m, tree, error in zip(apart, fitted, errors, strict=True):
            out[m] = tree if trees_of(models[m]) else None, error
    if rest := [m for m, model in enumerate(models) if model.frame not in large]:
        for m, found in zip(rest, _in_tasks(spark, frames, [models[m] for m in rest], known, seed, most_rows, trees_of), strict=True):
            out[m] = found
    return [t for t, _ in out], [e for _, e in out]


def _in_tasks(spark: SparkSession, frames: list[Frame], models: list[Model], known: list[tuple[int, float, int]], seed: int, most_rows: int | None, trees_of: Callable[[Model], bool]) -> list[tuple[Trees | None, tuple[float, int]]]:
    """Each model with its errors, fitted in a task of its own."""
    blocks: dict[int, Block] = {}
    for i in sorted({m.frame for m in models}):
        n, most, _ = known[i]
        asked = n if most_rows is None else min(n, most_rows)
        scale = _scale(asked, most)
        rows = _rows(frames[i], max(1, math.ceil(asked / ROWS_A_BLOCK)), asked / n if asked < n else None)
        if parts := rows.map(lambda r, scale=scale: _packed(r, 0, 1, scale)).collect():
            blocks[i] = _merged(parts)
    shared = spark.sparkContext.broadcast((blocks, [f.bins for f in frames], models))
    wanted = [trees_of(m) for m in models]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, bins, models = shared.value
        for batch in batches:
            for m in batch["model"]:
                tree, error, n = _fit_here(blocks, bins, models[m], seed)
                yield pd.DataFrame([[m, tree.to_json() if wanted[m] else None, error, n]], columns=["model", "trees", "error", "n"])

    # the longest first, one a task
    order = sorted(range(len(models)), key=lambda m: (-models[m].setting["trees"] * models[m].setting["depth"], m))
    tasks = spark.createDataFrame([(i, m) for i, m in enumerate(order)], "place int, model int").repartitionByRange(len(order), "place").select("model")
    found = {r["model"]: r for r in tasks.mapInPandas(run, "model int, trees string, error double, n long").collect()}
    shared.unpersist()
    return [(Trees.from_json(t) if (t := found[m]["trees"]) else None, (found[m]["error"], found[m]["n"])) for m in range(len(models))]


def _fit_here(blocks: dict[int, Block], bins: Sequence[Bins], model: Model, seed: int) -> tuple[Trees, float, int]:
    """One model on rows at hand."""
    one = Model(0, model.setting, model.out)
    if model.frame not in blocks:
        return Trees(bins[model.frame], 0.0, model.setting, *(np.full((0, 0), v) for v in (-1, 0, False, 0.0, 0, 0.0))), 0.0, 0
    held = [replace(blocks[model.frame], kept={})]
    scale = [held[0].scale]
    base = _base([tuple(_trained_sums(held[0], [one])[0])], scale, [one])
    held[0] = _begun(held[0], [one], base)
    numeric = [len(bins[model.frame].numeric)]

    def advance(growing: _Growing, active: list[int], tree: int) -> None:
        held[0] = _stepped(held[0], [one], growing, active, numeric, tree)

    (tree,) = _grown([bins[model.frame]], [one], base, scale, seed, lambda asked: _tables(held[0], asked), advance)
    error, n = _errors(held[0], [one])[0]
    return tree, float(error), int(n)


def _joined(parts: Iterator[Rows]) -> Iterator[Rows]:
    """The rows of a partition, if there are any."""
    if held := list(parts):
        yield Rows(*(np.concatenate([getattr(r, name) for r in held]) for name in ("binned", "target", "part", "hashes")))


def _placed(growing: _Growing, mine: list[int], level: int, best: dict[str, np.ndarray], settings: list[dict]) -> None:
    """Write the splits of a level, and the values of the nodes below, as these may stay leaves."""
    first = (1 << level) - 1
    l1, l2, step = (np.array([s[k] for s in settings], float)[:, None] for k in ("l1", "l2", "step"))
    nodes = slice(first, 2 * first + 1)
    made = best["feature"] >= 0
    for name in ("feature", "bin", "missing", "gain"):
        getattr(growing, name)[mine, nodes] = best[name]
    if level == 0:
        growing.rows[mine, 0], growing.value[mine, 0] = best["n"][:, 0], (step * _value(best["g"], best["n"], l1, l2))[:, 0]
    right_g, right_n = best["g"] - best["left_g"], best["n"] - best["left_n"]
    below = 2 * np.arange(first, 2 * first + 1)
    for at, g, n in ((below + 1, best["left_g"], best["left_n"]), (below + 2, right_g, right_n)):
        growing.value[np.ix_(mine, at)] = np.where(made, step * _value(g, n, l1, l2), 0)
        growing.rows[np.ix_(mine, at)] = np.where(made, n, 0)


def setting_of(preset: str = "strict", **settings) -> dict:
    if unknown := settings.keys() - PRESETS[preset].keys():
        raise ValueError(f"no such setting: {sorted(unknown)}")
    return PRESETS[preset] | settings


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, preset: str = "strict", rare: int = 1, seed: int = 42, **settings) -> Trees:
    """One model of all labelled rows of a written table."""
    frame = Frame(df.withColumn("_all", F.lit(0)), fit_bins(df, numeric, categorical, rare), y, "_all")
    return fit_all([frame], [Model(0, setting_of(preset, **settings))], seed)[0][0]


def _rows_of(df: DataFrame, bins: Bins) -> tuple[DataFrame, list[str]]:
    """df with the features once more, under names of their own, and these names."""
    names = [f"__{i}" for i in range(len(bins.names))]
    return df.select("*", *(c.alias(n) for c, n in zip(bins.columns(), names, strict=True))), names


def predict(model: Trees, df: DataFrame, name: str = "predicted", floor: float | None = 0.0) -> DataFrame:
    """df with the prediction, never below floor."""
    return predict_folds({None: model}, df, None, name, floor)


def predict_folds(models: dict[int | None, Trees], df: DataFrame, fold: str | None, name: str = "predicted", floor: float | None = 0.0) -> DataFrame:
    """df with the prediction of the model of each row's fold (all rows: of the model of None)."""
    shared = df.sparkSession.sparkContext.broadcast({k: m.to_json() for k, m in models.items()})  # some 100 KB a model
    bins = next(iter(models.values())).bins
    rows, names = _rows_of(df, bins)
    key = F.col(fold).cast("int") if fold else F.lit(None).cast("int")

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = {k: Trees.from_json(text) for k, text in shared.value.items()}
        for folds, *columns in batches:
            binned = bins.of(pd.DataFrame(dict(zip(bins.names, columns, strict=True)), index=folds.index))
            out = np.full(len(binned), np.nan)
            for k, model in known.items():
                hit = folds.isna().to_numpy() if k is None else (folds == k).to_numpy()
                out[hit] = model.predict(binned[hit])
            yield pd.Series(out if floor is None else np.maximum(out, floor))

    return rows.withColumn(name, scored(key, *names)).drop(*names)


def oof_predict_all(frames: dict[str, tuple[DataFrame, Bins, int]], fold: str = "fold", setting: dict | None = None, seed: int = 42, fitter: Callable = fit_all) -> dict[str, DataFrame]:
    """For each target: its rows with predicted, by a model of the other folds, median_baseline of the rows outside the fold and
    absolute_error. frames: target -> (written table, bins, folds); all models of all targets are grown side by side. fitter: fit_all or
    fit_each."""
    setting = setting or setting_of()
    order = list(frames)
    models = [Model(i, setting, k) for i, y in enumerate(order) for k in range(frames[y][2])]
    fitted, _ = fitter([Frame(frames[y][0], frames[y][1], y, fold) for y in order], models, seed)
    out = {}
    for i, y in enumerate(order):
        df, _, k = frames[y]
        rows = predict_folds({m.out: t for m, t in zip(models, fitted, strict=True) if m.frame == i}, df, fold)
        rows = rows.join(F.broadcast(median_baseline(df, y, fold, k)), fold)  # k rows
        out[y] = rows.withColumn("absolute_error", F.abs(F.col(y) - F.col("predicted")))
    return out


def drawn_settings(n: int, seed: int = 42, grid: dict | None = None, preset: str = "strict") -> list[dict]:
    draw, grid = random.Random(seed), GRID if grid is None else grid
    space = reduce(lambda a, v: a * len(v), grid.values(), 1)
    out: list[dict] = []
    while len(out) < min(n, space):
        setting = setting_of(preset, **{name: draw.choice(values) for name, values in grid.items()})
        if setting not in out:
            out.append(setting)
    return out


def search(
    df: DataFrame, bins: Bins, y: str, k: int, group: str, settings: Sequence[dict], fold: str = "fold", papers: Sequence[float] = (1.0,), extra: Sequence[dict] = (), seed: int = 42, most_rows: int | None = None
) -> tuple[Trees, dict, list[tuple[dict, float, float]], list[Trees]]:
    """The setting of the least mean absolute error over k folds, fitted on all rows whose fold is not negative; with each setting's
    last error and the share of papers it was tried on; and fits of `extra` settings on all rows.

    papers: shares of the groups for the rounds of successive halving, the last 1. After a round the better part of the settings goes
    on, as many as make the next round cost what this one did. With (1.0,) all settings are tried on all papers. Models are fitted
    by fit_each on all rows (most_rows: on a sample, as there); in the last round the fits on all rows go beside those of the folds.
    """
    rank = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(group).cast("string"), F.lit("\0")), F.lit(f":halving:{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    left, tried = list(settings), {}
    for i, share in enumerate(papers):
        last = i == len(papers) - 1
        part = F.col(fold) if share >= 1 else F.when(rank < share, F.col(fold)).otherwise(F.lit(-1))
        frame = Frame(df.withColumn("_part", part), bins, y, "_part")
        models = [Model(0, s, f) for s in left for f in range(k)]
        if last:
            models += [Model(0, s) for s in (*left, *extra)]
        fitted, errors = fit_each([frame], models, seed, most_rows, lambda m: m.out is None)
        mean = lambda j: float(np.mean([e / n for e, n in errors[j * k : (j + 1) * k] if n] or [math.inf]))  # noqa: B023, E731
        scored = [(mean(j), j) for j in range(len(left))]
        for error, j in scored:
            tried[json.dumps(left[j])] = (left[j], error, share)
        ranked = [j for _, j in sorted(scored)]
        if not last:
            left = [left[j] for j in sorted(ranked[: max(1, round(len(left) * share / papers[i + 1]))])]
    whole = fitted[len(left) * k :]
    return whole[ranked[0]], left[ranked[0]], list(tried.values()), whole[len(left) :]


def evaluate_frames(frames: dict[str, tuple[DataFrame, Sequence[str], Sequence[str]]], folds: dict[str, int], group: str, store: Callable[[DataFrame, str], DataFrame], preset: str = "lenient", rare: int = 2, seed: int = 42, fitter: Callable = fit_all, **settings) -> dict[str, DataFrame]:
    """Out-of-fold rows of each target, written by store. frames: target -> (labelled rows, numeric, categorical features); folds are as
    many as there are groups at most."""
    ready = {}
    for y, (df, numeric, categorical) in frames.items():
        k = fold_count(df, group, folds[y])
        rows = store(df.withColumn("fold", group_fold(F.col(group), k, seed)), f"folds-{y}")
        ready[y] = (rows, fit_bins(rows, numeric, categorical, rare), k)
    return {y: store(rows, f"oof-{y}") for y, rows in oof_predict_all(ready, "fold", setting_of(preset, **settings), seed, fitter).items()}


def importance(model: Trees) -> list[tuple[str, float]]:
    """Mean gain of the splits of each feature, as a share, most first; a category's values are features of their own."""
    found: dict[str, list[float]] = {}
    names, numeric = model.bins.names, len(model.bins.numeric)
    for f, b, gain in zip(model.feature.ravel(), model.bin.ravel(), model.gain.ravel(), strict=True):
        if f >= 0:
            values = model.bins.categorical.get(names[f])
            name = names[f] if f < numeric else f"{names[f]}={values[b - 1] if b else 'other'}"
            found.setdefault(name, []).append(float(gain))
    means = {name: sum(g) / len(g) for name, g in found.items()}
    total = sum(means.values()) or 1.0
    return sorted(((name, g / total) for name, g in means.items()), key=lambda r: (-r[1], r[0]))


def _leaves(model: Trees) -> Iterator[tuple[int, float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """(tree, value, features) of each leaf: for a feature of its path, the share of training rows that stay on the path at its nodes, and
    the nodes with the side that the path takes."""
    for t in range(len(model.feature)):
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(model.feature[t][node])
            if f < 0:
                yield t, float(model.value[t][node]), path
                continue
            for left in (True, False):
                below = 2 * node + (1 if left else 2)
                share, nodes = path.get(f, (1.0, []))
                stack.append((below, path | {f: (share * float(model.rows[t][below]) / float(model.rows[t][node]), [*nodes, (node, left)])}))


def base_value(model: Trees) -> float:
    """What the model predicts when no feature is known: each tree's leaves by their training rows."""
    return model.base + sum(value * math.prod(share for share, _ in path.values()) for _, value, path in _leaves(model))


def attributions(model: Trees, binned: np.ndarray) -> np.ndarray:
    """Shapley values [row, feature] of the path-dependent game: where a feature is unknown, a row goes both ways, by the training
    rows of either side. Of a leaf, only the features of its path matter, `depth` of them at most, so all their subsets are summed."""
    out = np.zeros(binned.shape)
    sides: dict[tuple[int, int], np.ndarray] = {}
    for t, value, path in _leaves(model):
        features = list(path)
        size = len(features)
        if not size or not value:
            continue
        on = {}
        for f, (_, nodes) in path.items():
            on[f] = np.ones(len(binned), bool)
            for node, left in nodes:
                if (t, node) not in sides:
                    sides = {k: v for k, v in sides.items() if k[0] == t}
                    sides[t, node] = model.sides(binned, t, np.full(len(binned), node))
                on[f] &= sides[t, node] == left
        for f in features:
            others = [g for g in features if g != f]
            weight = np.zeros(len(binned))
            for r in range(size):
                factor = math.factorial(r) * math.factorial(size - r - 1) / math.factorial(size)
                for known in combinations(others, r):
                    apart = math.prod(path[g][0] for g in others if g not in known)
                    weight += factor * apart * np.logical_and.reduce([on[g] for g in known]) if known else factor * apart
            out[:, f] += value * weight * (on[f] - path[f][0])
    return out


def explain(model: Trees, df: DataFrame) -> DataFrame:
    """df with base_value, predicted (unclamped) and phi, the Shapley value of each feature by name: they add up to the prediction."""
    shared = df.sparkSession.sparkContext.broadcast(model.to_json())
    bins, base = model.bins, base_value(model)
    rows, names = _rows_of(df, bins)

    @F.pandas_udf("array<double>")
    def phi(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known = Trees.from_json(shared.value)
        for columns in batches:
            binned = bins.of(pd.DataFrame(dict(zip(bins.names, columns, strict=True))))
            yield pd.Series(list(attributions(known, binned)), dtype=object)

    out = rows.withColumn("phi", phi(*names)).drop(*names)
    out = out.withColumn("phi", F.map_from_arrays(F.array(*map(F.lit, bins.names)), "phi")).withColumn("base_value", F.lit(base))
    return out.withColumn("predicted", F.aggregate(F.map_values("phi"), F.col("base_value"), lambda a, v: a + v))


def mean_attributions(explained: DataFrame) -> DataFrame:
    """Mean absolute and mean Shapley value by feature, largest first."""
    cells = explained.select(F.explode("phi").alias("feature", "v"))
    return cells.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean")).orderBy(F.desc("mean_abs"), "feature")


def save_trees(spark: SparkSession, model: Trees, path: str, facts: dict, predictions: DataFrame | None = None) -> None:
    """The model as JSON with its facts (features, target, unit, metrics) and, where given, the predictions with their row ids."""
    model.facts = facts
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")
    if predictions is not None:
        predictions.write.mode("overwrite").parquet(f"{path}/predictions")


def load_trees(spark: SparkSession, path: str) -> Trees:
    return Trees.from_json(spark.read.text(f"{path}/trees").first().value)
