"""MinHash near-duplicates with sequential Bayesian verification.

1. One scan makes each text's set of word shingles (64-bit hashes), its size, a digest of the set and a
   MinHash signature. Rows with equal sets form one class; its representative has the smallest id. From
   here on only representatives move, so a group of exact copies costs one row per task.
2. Signatures are banded; members of a band bucket are candidates. A bucket is open while its members
   belong to two components or more. Open buckets with the same largest component form a family, and in
   each round some members of a family are its pivots: unused members outside that component, and those with most
   links. Pivots are compared with all members of other components. A bucket closes once no unused
   member is outside its largest component: then every candidate pair that could join two components has been
   compared. Rows never stand for pairs: pivots (in blocks of ``BLOCK``) meet members (in chunks of
   ``CHUNK``) in bounded co-groups, so a family of any size is spread over tasks. A dense family closes
   after a few rounds.
3. A pair's signatures are compared batch by batch. After m of n values agree, the posterior of the
   similarity under a uniform prior is Beta(m + 1, n - m + 1); a pair is dropped as soon as
   P(similarity >= threshold) falls below ``MISS``, the chosen probability of a miss.
4. Survivors are verified on their full sets: 100 * |A & B| >= percent * |A | B|.
5. Links become components by star rounds over the link table.

Cases: null and empty texts, and texts without words, have an empty set, link with nothing and are
their own component; fewer words than a shingle make one shingle; rows with the same doc_id but
different texts are judged each by its own text; a null doc_id links with nothing, has a null component
and is kept; an empty table gives no rows. Ids of a type other than integers are numbered in their order first.
Extra columns are ignored, a text of any length is one set.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .tables import cut, long_ids

SHINGLE = 4
PERCENT = 80
BANDS = 26
ROWS = 5
BATCH = 26
MISS = 1e-4
SMALL = 16  # families of so many members compare all their pairs in one round
PIVOTS = (4, 256, 4096)  # of larger families, by round; then doubled each round
HUBS = 2
BLOCK, CHUNK = 64, 512


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and the n + 1 offsets."""
    low = tb.LOWER[buf]
    starts, ends, at = tb.spans(low, offs, tb.NONSPACE)
    h = tb.hash_spans(low, starts, ends, 21)
    n = at[1:] - at[:-1]
    owner, k = tb.ragged(np.where(n > 0, np.maximum(n - size + 1, 1), 0))
    place = at[:-1][owner] + k
    mult = tb.random_words(22, 0, size) | np.uint64(1)
    s = np.zeros(len(place), np.uint64)
    for j in range(size):
        inside = k + j < n[owner]
        s += np.where(inside, h[np.minimum(place + j, max(len(h) - 1, 0))] * mult[j], np.uint64(j + 1))
    s = tb._mix(s)
    by = np.lexsort((s, owner))
    s, owner = s[by], owner[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(s: np.ndarray, at: np.ndarray, n_hashes: int) -> np.ndarray:
    """MinHash values (uint32) of each set, one row per document; empty sets give zeros."""
    out = np.zeros((len(at) - 1, n_hashes), np.uint32)
    full = np.flatnonzero(at[1:] > at[:-1])
    if not len(full):
        return out
    x = (s >> np.uint64(32)).astype(np.uint32)
    y = s.astype(np.uint32) | np.uint32(1)
    mult = (tb.random_words(23, 0, n_hashes) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (tb.random_words(24, 0, n_hashes) >> np.uint64(32)).astype(np.uint32)
    begin = at[:-1][full]
    for i in range(n_hashes):
        v = (x ^ add[i]) * mult[i]
        v ^= v >> np.uint32(15)
        v += y * mult[(i + 1) % n_hashes]
        out[full, i] = np.minimum.reduceat(v, begin)
    return out


def features(docs: DataFrame, size: int, n_hashes: int) -> DataFrame:
    """(doc_id, text hash, n_shingles, two digests of the set, signature)."""
    def fn(cols, buf, offs):
        s, at = shingles(buf, offs, size)
        n = at[1:] - at[:-1]
        digest = []
        for k in (25, 26):
            total = np.concatenate([[np.uint64(0)], np.cumsum(tb._mix(s ^ tb.random_words(k, 0, 1)[0]), dtype=np.uint64)])
            digest.append(pa.array(tb._mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64)))
        sig = signatures(s, at, n_hashes)
        return [cols["doc_id"], cols["_text"], pa.array(n.astype(np.int64)), *digest,
                pa.array([row.tobytes() for row in sig], pa.binary())]

    return tb.scan(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")), ["doc_id", "_text"], fn,
                   "doc_id long, _text long, n_shingles long, d1 long, d2 long, sig binary")


def miss_table(n_hashes: int, batch: int, percent: int, miss: float) -> list[int]:
    """Fewest matches that keep a pair alive after each batch of signature values.

    The similarity of a pair given m of n matches is Beta(m + 1, n - m + 1); its upper tail at the
    threshold t is a binomial sum: P(S >= t) = P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, n_hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _comparer(least: list[int], batch: int, percent: int):
    """Links (a, b) between the members and the pivots of one co-group."""
    def sets(col) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in col.to_pylist()]

    def compare(members: pa.Table, pivots: pa.Table) -> pa.Table:
        out = []
        if members.num_rows and pivots.num_rows:
            own, rep, label = sets(members["set"]), members["rep"].to_numpy(), members["label"].to_numpy()
            sig = np.frombuffer(b"".join(members["sig"].to_pylist()), np.uint32).reshape(len(rep), -1)
            size = np.array([len(x) for x in own])
            for p, p_label, p_sig, p_set in zip(*(pivots[c].to_pylist() for c in ("rep", "label", "sig", "set"))):
                p_sig, p_set = np.frombuffer(p_sig, np.uint32), np.frombuffer(p_set, np.uint64)
                live = np.flatnonzero((label != p_label) & (100 * np.minimum(size, len(p_set)) >= percent * np.maximum(size, len(p_set))))
                match = np.zeros(len(rep), np.int64)
                for k, m in enumerate(least):
                    part = slice(k * batch, (k + 1) * batch)
                    match[live] += (sig[live, part] == p_sig[part]).sum(axis=1)
                    live = live[match[live] >= m]
                for i in live:
                    at = np.minimum(np.searchsorted(p_set, own[i]), len(p_set) - 1)
                    both = int((p_set[at] == own[i]).sum())
                    if 100 * both >= percent * (len(p_set) + size[i] - both):
                        out.append((min(p, int(rep[i])), max(p, int(rep[i]))))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return compare


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, sig, set) for the wanted (rep, _text, sig): their texts are shingled once more."""
    def fn(cols, buf, offs):
        s, at = shingles(buf, offs, size)
        return [cols["doc_id"], pa.array([s[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())]

    keys = wanted.select(F.col("rep").alias("doc_id"), "_text")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).join(keys, ["doc_id", "_text"], "left_semi")
    found = tb.scan(texts, ["doc_id"], fn, "rep long, set binary")
    return found.join(wanted.select("rep", "sig"), "rep").select("rep", "sig", "set").distinct()


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, rep) of all bands, only for buckets with two members or more."""
    width = 4 * rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                                 lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width)))))
    members = reps.select(band.alias("bucket"), "rep")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return members.join(shared.select("bucket"), "bucket")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and _text (hash of the text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, ids = long_ids(docs.select("doc_id", "text"), "doc_id", "_doc")
    docs = docs.select(F.col("_doc").alias("doc_id"), "text")
    rows_of = cut(features(docs, size, bands * rows))
    some = rows_of.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # a class is a distinct set, its representative the document with the smallest id
    classes = cut(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("_text", "doc_id").alias("_text"), F.min("sig").alias("sig")))
    todo = cut(_buckets(classes, bands, rows).withColumn("used", F.lit(False)))
    least = miss_table(bands * rows, batch, percent, miss)
    links, label, sets = None, None, None
    for k in itertools.count():
        most = PIVOTS[k] if k < len(PIVOTS) else PIVOTS[-1] << (k - len(PIVOTS) + 1)
        found = _round(todo, links, label, most)
        if found is None:
            break
        members, pivots, todo = found
        # only the members of open buckets are carried from round to round
        open_ = members.select("rep").distinct()
        sets = cut(_sets(docs, classes.join(open_, "rep", "left_semi"), size) if sets is None else sets.join(open_, "rep", "left_semi"))
        groups = ["family", "block", "chunk"]
        own, theirs = sets.toDF("rep", "sig", "set"), sets.toDF("rep", "sig", "set")
        left = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "chunks").join(own, "rep")
        right = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("blocks", "chunks").join(theirs, "rep")
        found = cut(left.groupBy(*groups).cogroup(right.groupBy(*groups))
                    .applyInArrow(_comparer(least, batch, percent), "a long, b long").distinct())
        links = found if links is None else cut(links.unionByName(found))
        label = cut(components(links))
    known = classes.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "rep")
    if label is not None:
        known = known.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("label", "rep"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    judged = (rows_of.drop("sig").join(known, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
            .withColumn("component_id", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id", "_text", "n_shingles", "component_id", "kept"))
    for c in ("doc_id", "component_id"):
        if ids is None:
            judged = judged.withColumn(c, F.col(c).cast(kind))
        else:
            judged = judged.join(ids.toDF("_number", "_id"), F.col(c) == F.col("_number"), "left").withColumn(c, F.col("_id")).drop("_number", "_id")
    return judged.select("doc_id", "_text", "n_shingles", "component_id", "kept")


def _round(todo: DataFrame, links: DataFrame | None, label: DataFrame | None, most: int):
    """Members (family, chunk, rep, label, blocks) and pivots (family, block, rep, label, chunks) of
    this round, and the open buckets' members with pivots marked; None when no bucket is open."""
    m = todo.withColumn("label", F.col("rep")).withColumn("degree", F.lit(0).cast("long"))
    if links is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        m = (todo.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
             .join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    size = m.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(~F.col("used"), 1)).alias("free"))
    largest = F.struct("c", "label")
    open_ = (size.groupBy("bucket").agg(F.max_by("label", largest).alias("family"), F.max_by("free", largest).alias("inner"),
                                        F.count(F.lit(1)).alias("labels"), F.sum("free").alias("free"))
             .where("labels > 1 and free > inner").select("bucket", "family"))
    m = cut(m.join(open_, "bucket"))
    if m.isEmpty():
        return None
    family = m.groupBy("family", "rep", "label", "degree").agg(F.min("used").alias("used"))
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    free = family.where(~F.col("used")).join(sizes, "family")
    # round 1 has no components yet: the smallest members; then members outside the family's own component, and hubs
    apart = free if links is None else free.where(F.col("label") != F.col("family"))
    first = F.row_number().over(Window.partitionBy("family").orderBy("rep"))
    hub = F.row_number().over(Window.partitionBy("family").orderBy(F.col("degree").desc(), "rep"))
    bound = F.when(F.col("n") <= SMALL, F.lit(SMALL)).otherwise(F.lit(most))
    chosen = apart.withColumn("_k", first).where(F.col("_k") <= F.lit(max(most, SMALL))).where(F.col("_k") <= bound)
    if links is not None:
        chosen = chosen.unionByName(free.where(F.col("degree") > 0).withColumn("_k", hub).where(F.col("_k") <= HUBS))
    chosen = chosen.select("family", "rep", "label").distinct()
    number = F.row_number().over(Window.partitionBy("family").orderBy("rep")) - 1
    chosen = cut(chosen.withColumn("block", F.floor(number / BLOCK).cast("int")))
    blocks = chosen.groupBy("family").agg((F.max("block") + 1).alias("blocks"))
    shape = sizes.join(blocks, "family").select("family", "blocks", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    members = family.select("family", "rep", "label").join(shape, "family").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    marked = m.join(chosen.select("family", "rep", F.lit(True).alias("now")), ["family", "rep"], "left")
    todo = cut(marked.select("bucket", "rep", (F.col("used") | F.coalesce("now", F.lit(False))).alias("used")))
    return members, chosen.join(shape, "family"), todo


def keep_first(docs: DataFrame, **kw) -> DataFrame:
    """The documents with one kept of each group, the one with the smallest id, with all columns.
    Repeated rows (equal id and text) count as one document; documents without words and with a
    null id stay."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.xxhash64("text").alias("_hash"))
    own_id = F.col(f"_{docs.columns.index('doc_id')}")
    judged = cut(near_duplicates(docs, **kw).select("doc_id", F.col("_text").alias("_h"), "kept", "n_shingles"))
    # a repeated row with words goes; which of equal rows stays does not matter
    again = judged.where("doc_id is not null and kept and n_shingles > 0").groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = cut(again.select("doc_id", "_h"))
    gone = judged.where("not kept").select("doc_id", "_h").distinct()
    match = own_id.eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("_h"))
    left = plain.join(gone, match, "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, match, "left_semi").dropDuplicates([f"_{docs.columns.index('doc_id')}", "_hash"])
        left = left.join(repeated, match, "left_anti").unionByName(once)
    return left.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
