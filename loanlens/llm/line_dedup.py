"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without white space at both ends, A-Z lower-cased. One scan counts, for
each distinct key hash, the documents that hold it (combined per block of text, then per task, then
by a shuffle of (hash, count) rows; a line of every document is one row per block). The hashes
found in ``min_docs`` documents or more are dealt to shards; each shard's task builds a minimal
perfect hash over its distinct line hashes, which numbers the slots of a fingerprint array (a second,
independent 64-bit hash) and a count array. Documents then probe the arrays where they stand: no
line is joined and no text is shuffled.

The arrays take about 12 bytes a line. They are broadcast in blocks of at most ``BLOCK_BYTES``;
a larger index means further passes over the documents (each written once), not a larger
broadcast.

Cases: a null or empty text is one empty line; keys below ``min_chars`` code points never go; a row
is a document (rows with the same doc_id count each; so do repeated rows); all columns besides
the text pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mph
from . import textbytes as tb
from .tables import cut

MIN_CHARS = 1
MIN_DOCS = 10
SHARD_KEYS = 1 << 16
BLOCK_BYTES = 64 << 20


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the documents' n + 1 offsets into them."""
    breaks = np.flatnonzero(buf == 0x0A)
    upto = np.searchsorted(breaks, offs)
    at = upto + np.arange(len(offs))
    starts, ends = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    opening = np.zeros(at[-1], bool)
    opening[at[:-1]] = True
    closing = np.zeros(at[-1], bool)
    closing[at[1:] - 1] = True
    starts[opening], starts[~opening] = offs[:-1], breaks + 1
    ends[closing], ends[~closing] = offs[1:], breaks
    return starts, ends, at


def keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int):
    """For each line whether its key is long enough, and two hashes of the key."""
    solid = np.flatnonzero(tb.NONSPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    if len(solid):
        s = np.where(some, solid[np.minimum(a, len(solid) - 1)], starts)
        e = np.where(some, solid[np.maximum(b - 1, 0)] + 1, starts)
    else:
        s = e = starts
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    low = tb.LOWER[buf]
    long_enough = points[e] - points[s] >= min_chars
    return long_enough, tb.hash_spans(low, s, e, 11), tb.hash_spans(low, s, e, 12)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n): documents that hold each distinct line key."""
    def fn(_, buf, offs):
        starts, ends, at = lines(buf, offs)
        ok, h1, h2 = keys(buf, starts, ends, min_chars)
        owner, _ = tb.ragged(at[1:] - at[:-1])
        owner, h1, h2 = owner[ok], h1[ok], h2[ok]
        by = np.lexsort((owner, h2, h1))
        owner, h1, h2 = owner[by], h1[by], h2[by]
        new = np.ones(len(by), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        fresh = new.copy()
        fresh[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        n = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        return [pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(n)]

    return tb.scan(docs, [], fn, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per shard: levels and bits of its perfect hash, fingerprint and count arrays."""
    frequent = cut(line_counts(docs, min_chars).where(F.col("n") >= min_docs))
    n_shards = max(1, -(-frequent.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        # a pair of lines may agree in one hash; the perfect hash needs distinct keys
        h = tb._mix(h1 ^ (table["h2"].to_numpy().view(np.uint64) >> np.uint64(1)))
        sizes, bits = mph.build(h)
        number = mph.Lookup(sizes, bits).number(h)
        prints, counts = np.zeros(len(h), np.int64), np.zeros(len(h), np.uint32)
        prints[number] = table["h2"].to_numpy()
        counts[number] = np.minimum(table["n"].to_numpy(), (1 << 32) - 1)
        return pa.table({"shard": [table["shard"][0].as_py()], "levels": [sizes.tolist()], "bits": [bits.tobytes()],
                         "prints": [prints.tobytes()], "counts": [counts.tobytes()]},
                        schema=pa.schema([("shard", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()),
                                          ("prints", pa.binary()), ("counts", pa.binary())]))

    schema = "shard long, levels array<long>, bits binary, prints binary, counts binary"
    sharded = frequent.withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    return cut(sharded.groupBy("shard").applyInArrow(build, schema).withColumn("n_shards", F.lit(n_shards)))


class Index:
    """One broadcast block of shards, ready for probing."""

    def __init__(self, rows, n_shards: int):
        self.n_shards = n_shards
        self.shards = {r[0]: (mph.Lookup(np.array(r[1], np.int64), np.frombuffer(r[2], np.uint8)),
                              np.frombuffer(r[3], np.int64), np.frombuffer(r[4], np.uint32)) for r in rows}

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents that hold each line, 0 for lines that this block does not list."""
        out = np.zeros(len(h1), np.int64)
        shard = np.mod(h1.view(np.int64), self.n_shards)
        h = tb._mix(h1 ^ (h2 >> np.uint64(1)))
        for s in np.unique(shard):
            if int(s) not in self.shards:
                continue
            lookup, prints, counts = self.shards[int(s)]
            rows = np.flatnonzero(shard == s)
            number = lookup.number(h[rows])
            hit = number >= 0
            hit[hit] = prints[number[hit]] == h2[rows[hit]].view(np.int64)
            out[rows[hit]] = counts[number[hit]]
        return out


def _probe(docs: DataFrame, shared, text: str, min_chars: int) -> DataFrame:
    """One pass: the text without the lines of this block, counts added to the last two columns."""
    order = list(docs.columns)
    others = [c for c in order if c != text]
    state = {}

    def fn(cols, buf, offs):
        if "index" not in state:
            state["index"] = Index(*shared.value)
        starts, ends, at = lines(buf, offs)
        ok, h1, h2 = keys(buf, starts, ends, min_chars)
        drop = np.zeros(len(starts), bool)
        drop[ok] = state["index"].counts(h1[ok], h2[ok]) > 0
        n = at[1:] - at[:-1]
        owner, _ = tb.ragged(n)
        dropped = np.bincount(owner[drop], minlength=len(n))
        kept = np.flatnonzero(~drop)
        last = np.ones(len(kept), bool)
        last[:-1] = owner[kept[1:]] != owner[kept[:-1]]
        data, piece = tb.pack_spans(buf, starts[kept], ends[kept] + ~last)
        out = tb.string_array(data, piece[np.searchsorted(owner[kept], np.arange(len(n) + 1))])
        old_n, old_dropped = cols["_n_lines"].to_numpy(), cols["_n_dropped"].to_numpy()
        got = dict(cols) | {"_n_lines": pa.array(np.where(old_n < 0, n, old_n)), "_n_dropped": pa.array(old_dropped + dropped), text: out}
        return [got[c] for c in order]

    return tb.scan(docs, others, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), text=text)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the lines found in ``min_docs`` documents or more; ``counts`` names
    two further columns: lines before, and lines dropped."""
    spark, columns = docs.sparkSession, docs.columns
    index = build_index(docs, min_chars, min_docs)
    size, n_shards = index.agg(F.sum(F.octet_length("bits") + F.octet_length("prints") + F.octet_length("counts")), F.max("n_shards")).first()
    n_shards = n_shards or 1
    per_block = max(1, n_shards // max(1, -(-(size or 0) // block_bytes)))
    # neutral names, so that no column clashes with the counts
    out = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], F.lit(-1).cast("long").alias("_n_lines"),
                      F.lit(0).cast("long").alias("_n_dropped"))
    text = f"_{columns.index('text')}"
    for lo in range(0, n_shards, per_block):
        rows = index.where((F.col("shard") >= lo) & (F.col("shard") < lo + per_block)).drop("n_shards").collect()  # one block
        shared = spark.sparkContext.broadcast(([tuple(r) for r in rows], n_shards))
        out = _probe(out if lo == 0 else cut(out), shared, text, min_chars)
    names = [F.col(f"_{i}").alias(c) for i, c in enumerate(columns)]
    if counts:
        names += [F.col("_n_lines").alias(counts[0]), F.col("_n_dropped").alias(counts[1])]
    return out.select(*names)
