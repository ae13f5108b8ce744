"""Feature importances of a random forest on rows that fill several tasks.

The rows are written once as small codes (the bin of every feature), in chunks. A level
of all trees is one scan: each task adds up the class weights per open node, feature of
the node's subset and bin, a tree at a time; the sums of the tasks meet by tree and
block of nodes, and the driver gets the best split of a node. Bootstrap counts are drawn
anew in every scan, from the chunk's own seed; the node that a row has reached in each
tree is written every ``STEP`` levels and followed from there. Weights are whole numbers
of up to ``UNITS``, so sums are exact in any order, and the first bin of a feature, which
holds most rows of a one-hot slot, is what the others leave of the node.

The rules are those of MLlib's forest: Poisson(1) counts, ceil(sqrt(features)) of them
a node, at most ``bins`` bins by weight, Gini gain above 0, sibling leaves that predict
alike merged. Cuts come from all rows instead of a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: rows of a chunk, bytes of the rows that a task holds at once, cells that it adds at once
CHUNK, PIECE_BYTES, CELLS = 2048, 128 << 20, 1 << 16
#: the largest weight
UNITS = 1 << 24
#: open nodes of a scan (at least one tree's), nodes whose sums meet in one row
NODES, BLOCK = 200_000, 512
#: levels between two writings of the reached nodes
STEP = 4
#: values of a feature that a task keeps for the cuts
VALUES = 4096
#: the row is in no open node of the tree
CLOSED = 65535
#: bootstrap count by a random 16-bit number
DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]),
                        (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


# ---------------------------------------------------------------- cuts and codes
def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _thin(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their weights; of more than ``VALUES``, neighbours of about
    equal weight in sum are one."""
    v, at = np.unique(values, return_inverse=True)
    w = np.bincount(at, weights, len(v))
    if len(v) > VALUES and w.sum() > 0:
        group = np.minimum((np.cumsum(w) * (VALUES / w.sum())).astype(int), VALUES - 1)
        last = np.r_[np.flatnonzero(np.diff(group)), len(v) - 1]
        v, w = v[last], np.add.reduceat(w, np.r_[0, last[:-1] + 1])
    return v, w


def _cut_points(values: np.ndarray, weights: np.ndarray, bins: int) -> list[float]:
    """MLlib's rule: midpoints of all neighbours, or those nearest to equal weights."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle.tolist()
    reached, stride = np.cumsum(weights), weights.sum() / bins
    found, target = [], stride
    for i, m in enumerate(middle):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            found.append(float(m))
            target += stride
    return found[:bins - 1]


def _cuts(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature its cuts, from all rows (x, y, w)."""
    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        zeros = ones = np.zeros(0)  # weights of the columns that hold nothing else
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            flags = ((x == 0) | (x == 1)).all(axis=0)
            above = np.where(flags, w @ x, 0.0)
            ones = above + (ones if len(ones) else 0.0)
            zeros = np.where(flags, w.sum() - above, 0.0) + (zeros if len(zeros) else 0.0)
            for j in np.flatnonzero(~flags):
                a, b = held.get(j, (np.zeros(0), np.zeros(0)))
                held[j] = _thin(np.r_[a, x[:, j]], np.r_[b, w])
        for j, (zero, one) in enumerate(zip(zeros, ones)):
            a, b = held.get(j, (np.zeros(0), np.zeros(0)))
            few = [(v, u) for v, u in ((0.0, zero), (1.0, one)) if u > 0]
            held[j] = _thin(np.r_[a, [v for v, _ in few]], np.r_[b, [u for _, u in few]])
        part = TaskContext.get().partitionId()
        for j, (v, u) in held.items():
            yield pa.RecordBatch.from_pylist([{"slot": j, "part": part, "v": v.tolist(),
                                               "u": u.tolist()}], schema)

    def cuts(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        v, u = (np.concatenate([np.asarray(r) for r in table[c].to_pylist()]) for c in "vu")
        found = _cut_points(*_thin(v, u), bins)
        return pa.table({"slot": [table["slot"][0].as_py()], "cuts": [found]},
                        pa.schema([("slot", pa.int32()), ("cuts", pa.list_(pa.float64()))]))

    schema = pa.schema([("slot", pa.int32()), ("part", pa.int32()),
                        ("v", pa.list_(pa.float64())), ("u", pa.list_(pa.float64()))])
    found = (rows.mapInArrow(values, "slot int, part int, v array<double>, u array<double>")
             .groupBy("slot").applyInArrow(cuts, "slot int, cuts array<double>"))
    return [np.array(r.cuts) for r in sorted(found.collect())]  # one row a feature


PACKED = "part int, seq int, n int, codes binary, y binary, w binary, nodes binary"


def _packed(rows: DataFrame, cuts: list[np.ndarray], unit: float) -> DataFrame:
    """Chunks of the rows: codes by feature, classes and weights in units."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in (batch.slice(at, CHUNK) for at in range(0, batch.num_rows, CHUNK)):
                x = np.ascontiguousarray(_matrix(b.column(0)).T)
                codes = np.array([np.searchsorted(c, v) for c, v in zip(cuts, x)], np.uint8)
                y, w = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                if not ((y >= 0) & (y == np.floor(y)) & (w >= 0)).all():
                    raise ValueError("labels are 0, 1, ... and weights are not negative")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()),
                     pa.array([b.num_rows], pa.int32()),
                     *(pa.array([v.tobytes()], pa.binary()) for v in
                       (codes, y.astype(np.int32), np.maximum(np.rint(w / unit), w > 0))),
                     pa.array([None], pa.binary())],
                    ["part", "seq", "n", "codes", "y", "w", "nodes"])
                seq += 1

    return rows.mapInArrow(run, PACKED)


# ---------------------------------------------------------------- one scan
@dataclass
class Steps:
    """The splits of a depth, ``start[t]`` the first node of tree t. A child is its
    number in the tree's next depth, or ``CLOSED``."""
    start: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def of(self, tree: int) -> tuple[np.ndarray, ...]:
        s = slice(self.start[tree], self.start[tree + 1])
        children = np.stack([self.left[s], self.right[s]], axis=1).reshape(-1)
        return self.feature[s].astype(np.intp), self.cut[s], children.astype(np.intp)


@dataclass
class Piece:
    part: int
    seq: int
    codes: np.ndarray  # (rows x features), flat
    y: np.ndarray
    w: np.ndarray
    counts: np.ndarray  # (trees, rows)
    nodes: np.ndarray | None

    def reached(self, tree: int, path: list[Steps]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the tree's bootstrap sample in open nodes, and those nodes."""
        if self.nodes is None:
            rows = np.flatnonzero(self.counts[tree])
            node = np.zeros(len(rows), np.intp)
        else:
            rows = np.flatnonzero(self.nodes[tree] != CLOSED)
            node = self.nodes[tree].take(rows).astype(np.intp)
        slots = len(self.codes) // len(self.y)
        for feature, cut, children in (s.of(tree) for s in path):
            code = self.codes.take(rows * slots + feature.take(node))
            node = children.take(2 * node + (code > cut.take(node)))
            open_ = np.flatnonzero(node != CLOSED)
            rows, node = rows.take(open_), node.take(open_)
        return rows, node


def _piece(chunks: list[dict], slots: int, trees: int, seed: int) -> Piece:
    def joined(column, kind, *shape):
        return np.concatenate([np.frombuffer(r[column], kind).reshape(*shape, r["n"])
                               for r in chunks], axis=-1)

    counts = [DRAWS[np.random.default_rng([seed, r["part"], r["seq"]]).integers(
        0, 65536, (trees, r["n"]), dtype=np.uint16)] for r in chunks]
    codes = np.ascontiguousarray(joined("codes", np.uint8, slots).T).reshape(-1)
    nodes = None if chunks[0]["nodes"] is None else joined("nodes", np.uint16, trees)
    return Piece(chunks[0]["part"], chunks[0]["seq"], codes, joined("y", np.int32),
                 joined("w", float), np.concatenate(counts, axis=1), nodes)


def _pieces(batches: Iterable[pa.RecordBatch], slots: int, trees: int, seed: int, size: int
            ) -> Iterator[Piece]:
    """The task's rows, as many at a time as ``size`` bytes hold."""
    held, n, most = [], 0, size // (slots + 3 * trees + 12)
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = batch.slice(i, 1).to_pylist()[0]
            if held and n + chunk["n"] > most:
                yield _piece(held, slots, trees, seed)
                held, n = [], 0
            held.append(chunk)
            n += chunk["n"]
    if held:
        yield _piece(held, slots, trees, seed)


def _moved(table: DataFrame, path: list[Steps], slots: int, trees: int, seed: int
           ) -> DataFrame:
    """The chunks with the nodes that their rows have reached."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                piece = _piece(one.to_pylist(), slots, trees, seed)
                nodes = np.full((trees, len(piece.y)), CLOSED, np.uint16)
                for t in range(trees):
                    rows, node = piece.reached(t, path)
                    nodes[t, rows] = node
                yield one.set_column(6, one.schema.field(6), pa.array([nodes.tobytes()], pa.binary()))

    return table.mapInArrow(run, PACKED)


@dataclass
class Level:
    """The open nodes of a scan's trees: features of each, and where their sums begin."""
    start: np.ndarray
    subset: np.ndarray
    bins: np.ndarray  # of every feature

    def of(self, tree: int, first: int = 0, last: int | None = None
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subset, bins and first cell of some of the tree's nodes, and cells in all."""
        subset = self.subset[self.start[tree]:self.start[tree + 1]][first:last].astype(np.intp)
        width = self.bins[subset]
        end = np.cumsum(width).reshape(width.shape)
        return subset, width, end - width


def _sums(table: DataFrame, level: Level, path: list[Steps], trees: range, slots: int,
          all_trees: int, classes: int, seed: int) -> DataFrame:
    """Class weights per node, then per node, feature and bin (none in the first bin), of
    every piece of rows, a block of nodes a row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, slots, all_trees, seed, PIECE_BYTES):
            for t in trees:
                rows, node = piece.reached(t, path)
                if not len(rows):
                    continue
                subset, width, first = level.of(t)
                n, k, size = len(subset), subset.shape[1], int(width.sum())
                first = np.concatenate([first + c * size for c in range(classes)])
                y = piece.y.take(rows)
                weight = piece.counts[t].take(rows) * piece.w.take(rows)
                whole = np.bincount(y * n + node, weight, classes * n).reshape(classes, n)
                total = np.zeros(classes * size)
                at_once = max(CELLS, len(total)) // k + 1
                for at in range(0, len(rows), at_once):
                    part = slice(at, at + at_once)
                    cell = subset.take(node[part], axis=0)
                    cell += (rows[part] * slots)[:, None]
                    code = piece.codes.take(cell).reshape(-1)
                    above = np.flatnonzero(code != 0)  # the first bin is what is left
                    row = above // k
                    cell = first.take((y[part] * n + node[part]).take(row) * k + above - row * k)
                    cell += code.take(above)
                    total += np.bincount(cell, weight[part].take(row), len(total))
                total = total.reshape(classes, size)
                for b, lo in enumerate(range(0, len(subset), BLOCK)):
                    hi = min(lo + BLOCK, n)
                    part = np.concatenate([whole[:, lo:hi], total[
                        :, first[lo, 0]:first[hi - 1, -1] + width[hi - 1, -1]]], axis=1)
                    if part.any():
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array([v], pa.int32()) for v in (t, b, piece.part, piece.seq)),
                             pa.array([part.tobytes()], pa.binary())],
                            ["tree", "block", "part", "seq", "sums"])

    return table.mapInArrow(run, "tree int, block int, part int, seq int, sums binary")


def _best(sums: np.ndarray, subset: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gain, feature, cut and the class weights on either side of each node's best split;
    gain 0 and all weights on the left where there is none."""
    n, s = subset.shape
    deep = max(2, int(width.max()))
    cells = np.zeros((len(sums), n, s, deep))
    cells[:, np.arange(deep) < width[:, :, None]] = sums[:, n:]
    cells[..., 0] = sums[:, :n, None] - cells.sum(axis=3)
    cells = cells.cumsum(axis=3)
    whole = cells[:, :, :, -1:]
    left = cells[:, :, :, :-1]
    right = whole - left
    a, b = left.sum(axis=0), right.sum(axis=0)
    both = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        parent = 1 - ((whole / both[..., -1:]) ** 2).sum(axis=0)
        gain = parent - (a * (1 - ((left / a) ** 2).sum(axis=0))
                         + b * (1 - ((right / b) ** 2).sum(axis=0))) / both
    gain = np.where((a > 0) & (b > 0), gain, 0.0).reshape(n, -1)
    pick, k = gain.argmax(axis=1), np.arange(n)
    j, cut = np.divmod(pick, deep - 1)
    gain = gain[k, pick]
    some = gain > 0
    return (np.where(some, gain, 0.0), subset[k, j], cut,
            np.where(some, left[:, k, j, cut], whole[:, k, 0, 0]),
            np.where(some, right[:, k, j, cut], 0.0))


def _splits(sums: DataFrame, level: Level, classes: int) -> DataFrame:
    """The best split of every node, a block of nodes a row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(key, total):
            t, b = key
            subset, width, _ = level.of(t, b * BLOCK, (b + 1) * BLOCK)
            found = _best(total.reshape(classes, -1), subset, width)
            kinds = (float, np.int32, np.uint8, float, float)
            return pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([b], pa.int32()),
                 *(pa.array([v.astype(x).tobytes()], pa.binary())
                   for v, x in zip(found, kinds))],
                ["tree", "block", "gain", "feature", "cut", "left", "right"])

        key, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                part = np.frombuffer(batch.column(4)[i].as_buffer(), float)
                if at != key:
                    if key is not None:
                        yield result(key, total)
                    key, total = at, np.zeros(len(part))
                total += part
        if key is not None:
            yield result(key, total)

    return (sums.repartition("tree", "block")
            .sortWithinPartitions("tree", "block", "part", "seq")
            .mapInArrow(run, "tree int, block int, gain binary, feature binary, cut binary, "
                             "left binary, right binary"))


# ---------------------------------------------------------------- the forest
@dataclass
class Depth:
    """What is kept of a depth's nodes; ``after`` is where each tree's next depth begins."""
    steps: Steps
    gain: np.ndarray
    count: np.ndarray
    predicts: np.ndarray  # (nodes, 2): class of the left and the right child
    after: np.ndarray

    def trees(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.steps.start) - 1), np.diff(self.steps.start))


def _subsets(rng: np.random.Generator, nodes: int, slots: int) -> np.ndarray:
    """ceil(sqrt(slots)) features of each node."""
    size = math.ceil(math.sqrt(slots))
    out = np.empty((nodes, size), np.int32)
    for at in range(0, nodes, 4096):
        order = rng.random((min(4096, nodes - at), slots), np.float32)
        out[at:at + 4096] = np.sort(np.argpartition(order, size - 1, axis=1)[:, :size], axis=1)
    return out


def _groups(start: np.ndarray) -> Iterator[range]:
    """Runs of trees that have at most ``NODES`` open nodes together."""
    first = 0
    for t in range(1, len(start)):
        if t == len(start) - 1 or start[t + 1] - start[first] > NODES:
            if start[t] > start[first]:
                yield range(first, t)
            first = t


def grow(train: DataFrame, features: str, label: str, weight: str, trees: int, depth: int,
         seed: int, bins: int = 32) -> tuple[list[Depth], int]:
    """All depths of a forest of ``trees`` trees, and the number of features."""
    if depth > 15:
        raise ValueError("a tree's nodes are numbered in 16 bits: at most 15 levels")
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"),
                        F.col(weight).cast("double").alias("w"))
    cuts = _cuts(rows, bins)
    slots, width = len(cuts), np.array([len(c) + 1 for c in cuts])
    most = train.agg(F.max(label), F.max(weight)).first()
    classes = max(2, int(most[0]) + 1)
    table = materialize(_packed(rows, cuts, (most[1] or 1.0) / UNITS))
    start, path, found = np.arange(trees + 1), [], []
    while len(found) < depth and start[-1]:
        if len(path) == STEP:
            table, path = materialize(_moved(table, path, slots, trees, seed)), []
        n = int(start[-1])
        level = Level(start, _subsets(np.random.default_rng([seed, len(found)]), n, slots), width)
        gain, feature, cut = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.uint8)
        left, right = np.zeros((n, classes)), np.zeros((n, classes))
        for group in _groups(start):
            lo, hi = start[group[0]], start[group[-1] + 1]
            some = Level(np.clip(start, lo, hi) - lo, level.subset[lo:hi], width)
            sums = _sums(table, some, [_only(s, group) for s in path], group, slots, trees,
                         classes, seed)
            for r in _splits(sums, some, classes).collect():  # one row for BLOCK nodes
                at = start[r.tree] + r.block * BLOCK
                part = slice(at, at + len(r.cut))
                gain[part], feature[part] = np.frombuffer(r.gain), np.frombuffer(r.feature, np.int32)
                cut[part] = np.frombuffer(r.cut, np.uint8)
                left[part], right[part] = (np.frombuffer(v).reshape(classes, -1).T
                                           for v in (r.left, r.right))
        last = len(found) + 1 == depth
        opens = np.stack([(gain > 0) & ((side > 0).sum(axis=1) > 1) & (not last)
                          for side in (left, right)], axis=1)
        before = np.r_[0, np.cumsum(opens.reshape(-1))]
        after = before[2 * start]
        tree = np.repeat(np.arange(trees), np.diff(start))
        number = np.where(opens, before[:-1].reshape(-1, 2) - after[tree][:, None],
                          CLOSED).astype(np.uint16)
        steps = Steps(start, feature, cut, number[:, 0], number[:, 1])
        found.append(Depth(steps, gain, (left + right).sum(axis=1), np.stack(
            [left.argmax(axis=1), right.argmax(axis=1)], axis=1).astype(np.int32), after))
        path.append(steps)
        start = after
    return found, slots


def _only(steps: Steps, trees: range) -> Steps:
    """The steps of some trees."""
    lo, hi = steps.start[trees[0]], steps.start[trees[-1] + 1]
    return Steps(np.clip(steps.start, lo, hi) - lo, steps.feature[lo:hi], steps.cut[lo:hi],
                 steps.left[lo:hi], steps.right[lo:hi])


def importances(train: DataFrame, features: str, label: str, weight: str, trees: int,
                depth: int, seed: int) -> list[float]:
    """Per feature the gain of its splits times their weight, each tree's share adding
    up to 1, over all trees. A split whose children are leaves that predict alike is a
    leaf, from below up."""
    depths, slots = grow(train, features, label, weight, trees, depth, seed)
    total = np.zeros((trees, slots))
    leaf, predicts = np.zeros(0, bool), np.zeros(0, np.int32)
    for d in reversed(depths):
        tree, split = d.trees(), d.gain > 0
        number = np.stack([d.steps.left, d.steps.right], axis=1).astype(np.intp)
        child_leaf, child_class = np.ones(number.shape, bool), d.predicts.copy()
        opens = number != CLOSED
        at = (d.after[tree][:, None] + number)[opens]
        child_leaf[opens], child_class[opens] = leaf[at], predicts[at]
        alike = child_leaf.all(axis=1) & (child_class[:, 0] == child_class[:, 1])
        leaf, predicts = ~split | alike, child_class[:, 0]
        kept = ~leaf
        np.add.at(total, (tree[kept], d.steps.feature[kept]), (d.gain * d.count)[kept])
    norm = total.sum(axis=1, keepdims=True)
    total = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0).sum(axis=0)
    return (total / total.sum() if total.sum() > 0 else total).tolist()
