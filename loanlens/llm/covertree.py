"""Hard-negative mining by inner product with cover trees over norm-augmented vectors.

1. A vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm: all lie on one sphere, an anchor q has 0 there, and
   the inner product is |q| M cos(angle). A node with centre c whose rows lie within the angle r of c holds only
   products between |q| M cos(angle(q, c) + r) and |q| M cos(angle(q, c) - r).
2. The upper level of the tree are at most ``TOP`` centres, taken by farthest-first traversal from a bounded sample
   of ``SAMPLE`` rows (it shapes the tree; it decides no result). Every row goes to its nearest centre; each
   centre's rows are cut by id hash into blocks of about ``BLOCK`` rows, so a centre of any number of rows, or of
   copies, is spread. A task builds the cover tree of a block: the centres of a node's children are taken
   farthest-first until they cover it within its radius / ``BASE`` or ``FANOUT`` are reached; each node keeps its covering
   radius. Leaves have ``LEAF`` rows, or rows that agree.
3. Anchors go in blocks of at most ``ANCHOR_BYTES``, broadcast; tasks read the written trees once a block. Level by
   level, nodes whose products lie outside all windows of an anchor are left. The leaves reached are visited best
   bound first, in rounds of 1, 2, 4, ...: all their products are exact, and a leaf whose bound is below an anchor's
   worst kept result is skipped. A task keeps its best results over all its trees; the best of all tasks are the result.
4. First pass: the best rows of the anchor's label (no window). Second pass: a window for each positive's score, rows of
   other labels.

In directions without structure (random vectors of 64 components) the radii are too wide to leave much out, and a pass
costs what a product of all anchors and rows costs; the result is exact at any rate.

Cases: rows with a null id, label, vector or component take no part, nor do vectors whose squared norm reaches 2^53
(their products would not be exact in a double). Vectors of different lengths are not compared. An id that repeats
takes part once, with its smallest label and vector. Ties go by smaller id. Ids of a type other than integers are
numbered in their order first. Windows of a negative positive score are empty. Empty tables and tables without anchors
give no rows; only the three named columns are read, extra ones are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import sequential_index
from .tables import cut

SAMPLE = 4096
TOP = 256
BLOCK = 2048
LEAF = 64
FANOUT = 16
BASE = 1.3
ANCHOR_BYTES = 16 << 20
CHUNK = 1024  # anchors that descend together
_SLACK = 1e-6  # of angles, against rounding
_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TREE = ("dim int, id array<long>, label array<long>, x binary, parent array<int>, begin array<int>, end array<int>, centre array<int>, "
         "radius array<double>, depth array<int>, leaf array<boolean>")


def on_sphere(x: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors of the norm-augmented rows."""
    return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))]) / norm


def farthest_first(u: np.ndarray, most: int, within: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres by farthest-first traversal, beginning with row 0, until all rows lie within the angle ``within``
    of one or there are ``most``; each row's nearest centre and the cosine to it."""
    centres, best, owner = [0], u @ u[0], np.zeros(len(u), np.int64)
    while len(centres) < most:
        far = int(best.argmin())
        if math.acos(min(1.0, max(-1.0, best[far]))) <= max(within, _SLACK):
            break
        cos = u @ u[far]
        cos[far] = 2.0  # its own centre, also beside rows that agree up to rounding
        owner[cos > best] = len(centres)
        best = np.maximum(best, cos)
        centres.append(far)
    return centres, owner, np.minimum(best, 1.0)


def cover_tree(u: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, list]]:
    """Row order and nodes, level by level: a node's rows are [begin, end) of the order; ``centre`` is a row."""
    nodes: dict[str, list] = {k: [] for k in ("parent", "begin", "end", "centre", "radius", "depth", "leaf")}
    order, todo = np.arange(len(u)), []

    def add(parent: int, begin: int, rows: np.ndarray, centre: int, cos: float, depth: int) -> None:
        order[begin:begin + len(rows)] = rows
        radius = math.acos(min(1.0, max(-1.0, cos)))
        for k, v in zip(nodes, (parent, begin, begin + len(rows), centre, radius, depth, len(rows) <= leaf or radius <= _SLACK)):
            nodes[k].append(v)
        todo.append(rows)

    add(-1, 0, order.copy(), 0, float((u @ u[0]).min()), 0)
    for i, rows in enumerate(todo):  # grows while it is read
        if nodes["leaf"][i]:
            continue
        rows = np.concatenate([[nodes["centre"][i]], rows[rows != nodes["centre"][i]]])  # a centre is its own child's centre
        centres, owner, cos = farthest_first(u[rows], FANOUT, nodes["radius"][i] / BASE)
        begin = nodes["begin"][i]
        for c, first in enumerate(centres):
            inside = owner == c
            add(i, begin, rows[inside], int(rows[first]), float(cos[inside].min()), nodes["depth"][i] + 1)
            begin += int(inside.sum())
    return order, nodes


def _tree_row(norm: float):
    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("id")
        dim = t["dim"][0].as_py()
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        order, nodes = cover_tree(on_sphere(x.astype(np.float64), norm))
        place = np.empty(len(order), np.int64)
        for b, e, leaf in zip(nodes["begin"], nodes["end"], nodes["leaf"]):
            if leaf:
                order[b:e].sort()  # rows of a leaf by id
        place[order] = np.arange(len(order))
        nodes["centre"] = place[nodes["centre"]].tolist()
        row = {"dim": [dim], "id": [t["id"].to_numpy()[order]], "label": [t["label"].to_numpy()[order]], "x": [x[order].astype(np.int32).tobytes()]}
        return pa.table([pa.array(v, f.type) for f, v in zip(_ARROW, [*row.values(), *([nodes[f.name]] for f in _ARROW[4:])])], schema=pa.schema(_ARROW))

    return build


_KIND = {"int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
         "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
_ARROW = [pa.field(*(lambda n, k: (n, _KIND[k]))(*x.split(" "))) for x in _TREE.split(", ")]


class _Anchors:
    """Anchors of one length with their windows, and the best results of a task."""

    def __init__(self, rows: dict, keep: int, same: bool):
        self.id, self.label, self.x = rows["id"], rows["label"], rows["x"].astype(np.float64)
        self.lo, self.hi, self.same = rows["lo"], rows["hi"], same  # n x windows; an unused window has lo = inf
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.score = np.full((*self.lo.shape, keep), -np.inf)
        self.found = np.full((*self.lo.shape, keep), np.iinfo(np.int64).max)

    def least(self, who: np.ndarray) -> np.ndarray:
        """Smallest product that can still matter, per window."""
        return np.maximum(self.lo[who], self.score[who, :, -1])

    def descend(self, tree: dict, who: np.ndarray, norm: float) -> None:
        low, high = self.least(who).min(axis=1), self.hi[who].max(axis=1)
        size = self.norm[who] * norm
        alive, bound = np.zeros((len(who), len(tree["parent"])), bool), np.full((len(who), len(tree["parent"])), -np.inf)
        for nodes in tree["levels"]:
            live = np.ones((len(who), len(nodes)), bool) if tree["parent"][nodes[0]] < 0 else alive[:, tree["parent"][nodes]]
            some = live.any(axis=0)
            nodes, live = nodes[some], live[:, some]
            if not len(nodes):
                break
            product = self.x[who] @ tree["x"][tree["centre"][nodes]].T
            angle = np.arccos(np.clip(product / np.where(size > 0, size, 1)[:, None], -1, 1))
            reach, edge = tree["radius"][nodes] + _SLACK, 1e-9 * size[:, None]
            upper = size[:, None] * np.cos(np.maximum(angle - reach, 0)) + edge
            lower = size[:, None] * np.cos(np.minimum(angle + reach, np.pi)) - edge
            alive[:, nodes] = live & (upper >= low[:, None]) & (lower <= high[:, None])
            bound[:, nodes] = upper
        leaves = np.flatnonzero(tree["leaf"])
        bound = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
        best, step, at = np.argsort(-bound, axis=1), 1, 0
        while at < len(leaves):
            turn = best[:, at:at + step]
            want = np.take_along_axis(bound, turn, axis=1) >= np.maximum(self.least(who).min(axis=1), np.finfo(float).min)[:, None]
            if not want.any():
                break
            a, k = np.nonzero(want)
            leaf = turn[a, k]
            by = np.argsort(leaf, kind="stable")
            a, leaf = a[by], leaf[by]
            cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                node = leaves[leaf[lo]]
                self.verify(tree, int(tree["begin"][node]), int(tree["end"][node]), who[a[lo:hi]])
            at, step = at + step, 2 * step

    def verify(self, tree: dict, begin: int, end: int, who: np.ndarray) -> None:
        product = self.x[who] @ tree["x"][begin:end].T
        match = tree["label"][begin:end] == self.label[who][:, None]
        match = match & (tree["id"][begin:end] != self.id[who][:, None]) if self.same else ~match
        least = self.least(who)
        for w in range(self.lo.shape[1]):
            ok = match & (product >= least[:, w, None]) & (product <= self.hi[who, w, None])
            some = np.flatnonzero(ok.any(axis=1))
            if not len(some):
                continue
            score = np.where(ok[some], product[some], -np.inf)
            top = np.argsort(-score, axis=1, kind="stable")[:, :self.score.shape[2]]  # rows of a leaf are in the order of their ids
            score = np.take_along_axis(score, top, axis=1)
            found = np.where(score > -np.inf, tree["id"][begin:end][top], np.iinfo(np.int64).max)
            i = who[some]
            score, found = np.concatenate([self.score[i, w], score], axis=1), np.concatenate([self.found[i, w], found], axis=1)
            for value in (found, None):  # by score, then id
                by = np.argsort(found if value is not None else -score, axis=1, kind="stable")
                score, found = np.take_along_axis(score, by, axis=1), np.take_along_axis(found, by, axis=1)
            self.score[i, w], self.found[i, w] = score[:, :self.score.shape[2]], found[:, :self.score.shape[2]]


def _search(trees: DataFrame, anchors: list[dict], norm: float, keep: int, same: bool) -> DataFrame:
    """(anchor, window, id, score): the best ``keep`` rows of each task for each anchor and window."""
    shared = trees.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        state = {rows["x"].shape[1]: _Anchors(rows, keep, same) for rows in shared.value}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                if dim not in state:
                    continue
                tree = {f.name: batch.column(f.name)[i].values.to_numpy(zero_copy_only=False) for f in _ARROW if pa.types.is_list(f.type)}
                tree["x"] = np.frombuffer(batch.column("x")[i].as_buffer(), np.int32).reshape(len(tree["id"]), dim).astype(np.float64)
                cuts = np.searchsorted(tree["depth"], np.arange(tree["depth"][-1] + 2))
                tree["levels"] = [np.arange(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])]
                for lo in range(0, len(state[dim].id), CHUNK):
                    state[dim].descend(tree, np.arange(lo, min(lo + CHUNK, len(state[dim].id))), norm)
        for s in state.values():
            a, w, k = np.nonzero(s.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(s.id[a]), pa.array(w.astype(np.int32)), pa.array(s.found[a, w, k]), pa.array(s.score[a, w, k].astype(np.int64))],
                                             names=["anchor", "window", "id", "score"])

    return trees.mapInArrow(run, "anchor long, window int, id long, score long")


def _by_length(t: pa.Table, windows) -> list[dict]:
    """One dictionary of arrays for each vector length; ``windows`` turns a row's scores into (lo, hi) pairs."""
    out, lens = [], np.array([len(v) for v in t["v"].to_pylist()], np.int64)
    spans = [windows(s) for s in t["scores"].to_pylist()]
    width = max((len(s) for s in spans), default=1) or 1
    lo, hi = np.full((t.num_rows, width), np.inf), np.full((t.num_rows, width), -np.inf)
    for i, s in enumerate(spans):
        for w, (a, b) in enumerate(s):
            if a <= b:
                lo[i, w], hi[i, w] = a, b
    for d in np.unique(lens):
        at = np.flatnonzero(lens == d)
        x = t["v"].combine_chunks().take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))
        out.append({"id": t["id"].to_numpy()[at], "label": t["label"].to_numpy()[at], "x": x.astype(np.int32), "lo": lo[at], "hi": hi[at]})
    return out


def _passes(trees: DataFrame, anchors: DataFrame, blocks: int, norm: float, keep: int, same: bool, windows) -> DataFrame:
    """``_search`` for one bounded block of anchors after another; each result is written."""
    out = trees.sparkSession.createDataFrame([], "anchor long, window int, id long, score long")
    for b in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        if part.num_rows:
            out = out.unionByName(cut(_search(trees, _by_length(part, windows), norm, keep, same)))
    return out


def _assigned(rows: DataFrame, centres: dict[int, np.ndarray], norm: float) -> DataFrame:
    """Adds ``shard``, the nearest upper centre of each row."""
    def run(batches):
        for batch in batches:
            col = batch.column("v")
            lens = np.diff(np.asarray(col.offsets))
            flat, begin = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens) - lens
            shard = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(lens):
                if int(d) in centres:
                    at = np.flatnonzero(lens == d)
                    x = flat[begin[at][:, None] + np.arange(d)].astype(np.float64)
                    shard[at] = (on_sphere(x, norm) @ centres[int(d)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lens.astype(np.int32)), pa.array(shard)], names=[*batch.schema.names, "dim", "shard"])

    return rows.mapInArrow(run, "id long, label long, v array<int>, dim int, shard int")


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Rows (id long, label long, v array<int>) -> (the written rows, one tree per block, the largest norm)."""
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top = rows.agg(F.count(F.lit(1)), F.max(size)).first()
    norm = math.sqrt(top or 0.0) or 1.0
    sample = [r[0] for r in rows.select("v", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    most = max(1, min(TOP, math.ceil(n / BLOCK)))
    centres = {}
    for d in {len(v) for v in sample}:
        some = [v for v in sample if len(v) == d]
        u = on_sphere(np.array(some, np.float64).reshape(len(some), d), norm)
        centres[d] = u[farthest_first(u, most)[0]]
    once = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    rows = cut(_assigned(once, centres, norm))
    blocks = rows.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = rows.join(blocks, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    tasks = max(1, min(most + math.ceil(n / BLOCK), 16 * rows.sparkSession.sparkContext.defaultParallelism))
    trees = placed.select("dim", "shard", "block", "id", "label", "v").repartition(tasks, "dim", "shard", "block")
    return rows, cut(trees.groupBy("dim", "shard", "block").applyInArrow(_tree_row(norm), _TREE)), norm


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_column: str = "vec_id", label_column: str = "label", vector_column: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among the rows (a condition on the
    id column) and each of their ``positives`` best rows of the same label: the best ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Vectors are integers."""
    own, label, vector = (F.col(f"`{c}`") for c in (id_column, label_column, vector_column))
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fits = own.isNotNull() & label.isNotNull() & F.coalesce(size < float(1 << 53), F.lit(False))  # null with a null component
    rows = vectors.where(fits).select(own.alias("key"), F.xxhash64(label).alias("label"), vector.cast("array<int>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    numbered = not isinstance(vectors.schema[id_column].dataType, _INT)
    if numbered:
        ids = cut(sequential_index(rows.select("key").distinct(), "key", "id"))
        rows = rows.join(ids, "key")
    else:
        rows = rows.withColumn("id", F.col("key").cast("long"))
    rows, trees, norm, chosen = *build(rows.select("id", "label", "v")), rows.where("anchor").select("id").distinct()
    chosen = cut(rows.join(chosen, "id", "left_semi").select("id", "label", "v"))
    total = chosen.agg(F.sum(4 * F.size("v") + 16 * positives + 16 * positives * max(positives, negatives))).first()[0] or 0
    blocks = math.ceil(total / ANCHOR_BYTES)

    every = [(-math.inf, math.inf)]
    best = _passes(trees, chosen.withColumn("scores", F.array().cast("array<long>")), blocks, norm, positives, True, lambda _: every)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    pairs = cut(best.withColumn("k", place).where(F.col("k") <= positives).select("anchor", F.col("id").alias("positive"), F.col("score").alias("p")))

    def window(s: int) -> tuple[int, int]:
        return -(-low * s // 100), high * s // 100

    scores = pairs.groupBy("anchor").agg(F.array_sort(F.collect_set("p")).alias("scores"))  # ``positives`` at most
    sought = cut(chosen.join(scores.withColumnRenamed("anchor", "id"), "id"))
    found = _passes(trees, sought, blocks, norm, negatives, False, lambda s: [window(x) for x in s])
    found = found.join(scores, "anchor").withColumn("p", F.get("scores", F.col("window")))
    place = F.row_number().over(Window.partitionBy("anchor", "p").orderBy(F.col("score").desc(), "id"))
    found = found.withColumn("rank", place).where(F.col("rank") <= negatives)
    out = pairs.join(found, ["anchor", "p"]).select("anchor", "positive", "rank", "id", "p", "score")
    if numbered:
        for c in ("anchor", "positive", "id"):
            out = out.join(ids.toDF("key", "_n"), F.col(c) == F.col("_n")).withColumn(c, F.col("key")).drop("key", "_n")
    return out.toDF("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
