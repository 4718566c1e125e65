"""Near-duplicate embeddings by lattice hashing: pairs of vectors of one label with a high cosine.

1. Unit vectors are projected by random normal directions, eight to a block, and each block is decoded to its nearest point of the
   E8 lattice (all integers or all halves, even sum). A table's cell is the points of its ``BLOCKS``
   blocks; besides its own cell a vector is entered in ``PROBES`` neighbouring cells: those reached by one of
   the 240 shortest lattice vectors in one block that lie nearest to it. A key hashes label, length, table and cell.
2. Equal vectors of a label form one class with its smallest id as representative and a number of copies; only
   representatives are entered, so a group of copies costs one row a task.
3. Keys with two representatives or more are shared. Shared keys with the same smallest member form a family, so that vectors
   which meet in many tables move once. A family of any size is cut into tiles of ``CHUNK`` by ``CHUNK`` members; a
   task multiplies the vectors of one tile at a time and never emits pairs: it returns per member the number of
   verified links and a hub of its part of the link graph. A pair that shares several families counts in the first one.
4. Links (cosine at least ``threshold``, in double precision) become components by star rounds.

No pair is left out by a cap: all members of a shared key are compared. What is missed are pairs
without a common key: 4 % of pairs at a cosine of exactly 0.98, 0.3 % at 0.99 with the parameters here.
A family of m different vectors costs m * m / 2 products, spread over tiles.

Cases: a null label, null or empty vector, zero vector, null or non-finite component or null id: the row links with
nothing (0 links, its own id as component, kept). Vectors of different lengths are never linked. Rows that repeat a vector are linked
with each other, rows that repeat an id are vectors of their own but one node of the link graph, so both are kept if one
is. Ties need no rule; an empty table gives no rows; only the three named columns are read, extra ones are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .tables import cut

THRESHOLD = 0.98
BLOCKS = 3
SCALE = 1.75
TABLES = 4
PROBES = 2
CHUNK = 2048
_SLICE = 1024


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    f = np.rint(x)
    off = x - f
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    f[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer one of the nearest points of D8 and of D8 + 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def directions(dim: int, tables: int, blocks: int) -> np.ndarray:
    return np.random.default_rng([8, dim]).normal(size=(dim, tables * blocks * 8))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cell_keys(x: np.ndarray, group: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Keys (int64) of each unit vector: its own cell and ``probes`` neighbours in every table. ``group``
    keeps vectors apart that must not meet."""
    roots, mult = shortest_vectors(), tb.random_words(41, 0, 8 * blocks) | np.uint64(1)
    n, out = len(x), []
    y = (x @ directions(x.shape[1], tables, blocks) / scale).reshape(n, tables, blocks, 8)
    for t in range(tables):
        at = y[:, t].reshape(n * blocks, 8)
        own = nearest_e8(at)
        near = ((at - own) @ roots.T).reshape(n, blocks * len(roots))  # the larger, the nearer the neighbouring cell
        cells, row = [own.reshape(n, blocks, 8)], np.arange(n)
        for _ in range(probes):
            best = near.argmax(axis=1)
            near[row, best] = -np.inf
            moved = cells[0].copy()
            moved[row, best // len(roots)] += roots[best % len(roots)]
            cells.append(moved)
        salt = tb._mix(group ^ tb.random_words(42, t, 1)[0])
        for c in cells:
            whole = np.rint(2 * c).astype(np.int64).reshape(n, -1).astype(np.uint64)
            out.append(tb._mix((whole * mult).sum(axis=1, dtype=np.uint64) ^ salt).view(np.int64))
    return np.stack(out, axis=1)


def _matrix(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in a list column without nulls."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = np.diff(np.asarray(col.offsets))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(lens) - lens
    out = []
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        out.append((rows, flat.reshape(len(rows), d) if len(rows) == len(lens) else flat[begin[rows][:, None] + np.arange(d)]))
    return out


def _with_keys(vectors: DataFrame, tables: int, blocks: int, probes: int, scale: float) -> DataFrame:
    names = [f"k{i}" for i in range(tables * (1 + probes))]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                part = batch.slice(lo, _SLICE)
                group = part.column(1).to_numpy().view(np.uint64)
                keys = np.empty((part.num_rows, len(names)), np.int64)
                for rows, x in _matrix(part.column(4)):
                    keys[rows] = cell_keys(unit(x), group[rows], tables, blocks, probes, scale)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(k) for k in keys.T)], names=["id", "g", "d1", "d2", *names])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "g", "d1", "d2", "v").mapInArrow(run, f"id {kind}, g long, d1 long, d2 long, " + ", ".join(f"{k} long" for k in names))


def _parts(adjacent: np.ndarray) -> np.ndarray:
    """The first member of each member's connected part."""
    hub, left = np.arange(len(adjacent)), adjacent.any(axis=1)
    for i in np.flatnonzero(left):
        if left[i]:
            left[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(adjacent[front].any(axis=0) & left)
                left[front] = False
                hub[front] = i
    return hub


def _tile(family: int, two: bool, second: np.ndarray, x: np.ndarray, group: np.ndarray, copies: np.ndarray, families: list, threshold: float):
    """(number of links, hub) of each member of one tile: between its two sides, or within its one."""
    n = len(x)
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if two else (np.arange(n), np.arange(n))
    linked = (x[a] @ x[b].T >= threshold) & (group[a][:, None] == group[b])
    if not two:
        np.fill_diagonal(linked, False)
    holders: dict[int, list[int]] = {}
    for i, of in enumerate(families):
        for f in of:
            if f >= family:
                break
            holders.setdefault(f, []).append(i)
    for rows in holders.values():  # these pairs count in an earlier family
        if len(rows) > 1:
            inside = np.zeros(n, bool)
            inside[rows] = True
            linked[np.ix_(np.flatnonzero(inside[a]), np.flatnonzero(inside[b]))] = False
    links, whole = np.zeros(n, np.int64), linked
    if two:
        links[a], links[b] = linked @ copies[b], linked.T @ copies[a]
        whole = np.zeros((n, n), bool)
        whole[np.ix_(a, b)] = linked
        whole |= whole.T
    else:
        links = linked @ copies
    return links, _parts(whole)


def _compare(members: DataFrame, threshold: float) -> DataFrame:
    """(id, d1, n, hub) per tile and member with links; the members come sorted by tile."""
    def run(batches):
        def solve(t: pa.Table, cuts: np.ndarray):
            second, group, copies = (t[c].to_numpy() for c in ("second", "g", "copies"))
            family, families, two = t["family"].to_numpy(), t["families"].to_pylist(), t["lo"].to_numpy() != t["hi"].to_numpy()
            vectors = [None] * t.num_rows
            for rows, x in _matrix(t["v"]):
                for i, u in zip(rows, unit(x)):
                    vectors[i] = u
            at, n, hub = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                lens = np.array([len(v) for v in vectors[lo:hi]])
                for d in np.unique(lens):
                    rows = lo + np.flatnonzero(lens == d)
                    links, first = _tile(int(family[lo]), bool(two[lo]), second[rows], np.array([vectors[i] for i in rows]), group[rows], copies[rows],
                                         [families[i] for i in rows], threshold)
                    some = np.flatnonzero(links)
                    at.append(rows[some])
                    n.append(links[some])
                    hub.append(rows[first[some]])
            at, n, hub = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, n, hub))
            return pa.RecordBatch.from_arrays([t["id"].combine_chunks().take(pa.array(at)), t["d1"].combine_chunks().take(pa.array(at)), pa.array(n),
                                               t["id"].combine_chunks().take(pa.array(hub))], names=["id", "d1", "n", "hub"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = np.stack([t[c].to_numpy() for c in ("family", "lo", "hi")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
            if len(cuts) > 1:
                yield solve(t.slice(0, int(cuts[-1])).combine_chunks(), cuts)
            held = t.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks(), np.array([0, held.num_rows]))

    kind = members.schema["id"].dataType.simpleString()
    return members.mapInArrow(run, f"id {kind}, d1 long, n long, hub {kind}")


def usable(label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", label_column: str = "label",
                           vector_column: str = "embedding", tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE,
                           chunk: int = CHUNK) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id``, ``kept``."""
    label, vector = F.col(f"`{label_column}`"), F.col(f"`{vector_column}`")
    if vectors.schema[vector_column].dataType.simpleString() != "array<float>":  # floats move as they are; tasks compute in double
        vector = vector.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), label.alias("l"), vector.alias("v"))
    good = usable(F.col("l"), F.col("v")) & F.col("id").isNotNull()
    entered = rows.where(good).select("id", F.xxhash64("l", F.size("v")).alias("g"), F.xxhash64("l", "v").alias("d1"), F.xxhash64(F.lit(12), "l", "v").alias("d2"), "v")
    keyed = _with_keys(entered, tables, blocks, probes, scale)
    names = [c for c in keyed.columns if c not in ("id", "g", "d1", "d2")]
    classes = cut(keyed.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("g").alias("g"),
                                                *(F.min(k).alias(k) for k in names)))
    records = classes.select("id", F.explode(F.array(*names)).alias("key"))
    shared = records.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key", F.xxhash64("low").alias("family"))
    member = cut(records.join(shared, "key").select("family", "id").distinct())
    families = member.groupBy("id").agg(F.array_sort(F.collect_set("family")).alias("families"))  # one for each key at most
    known = classes.select("id", "d1", "g", "copies").join(families, "id")
    # rows that repeat an id and a vector are one vector here
    known = entered.select("id", "d1", "v").join(known, ["id", "d1"]).dropDuplicates(["id", "d1"])
    chunks = member.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    placed = member.join(chunks, "family").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("family", "id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"))
    tiles = placed.join(known, "id").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    found = cut(_compare(tiles, threshold))
    links = found.groupBy("id", "d1").agg(F.sum("n").alias("n"))
    label_of = components(found.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    result = (classes.select("id", "d1", "d2", "copies").join(links, ["id", "d1"], "left").join(label_of.withColumnRenamed("node", "id"), "id", "left")
              .select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "id").alias("component_id")))
    out = entered.select("id", "d1", "d2").join(result, ["d1", "d2"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
