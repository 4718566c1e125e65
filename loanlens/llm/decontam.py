"""Benchmark decontamination with suffix arrays of the training documents.

Every task lays its block of training documents out as one sequence of words (lower-cased,
64-bit word hashes, a separator after each document) and sorts the suffixes that start at each
word: one shard's suffix array. Every suffix of the test items is then binary-searched in every
shard. The interval found for the first ``WINDOW`` words gives all places where the suffix
occurs; from there the match is extended word by word to the longest verbatim match and its
location. Documents with a match are the affected ones.

Order of words: any total order serves, so words are ranked by hash. A suffix is compared by its
first 11 words, which is as deep as a 10-word window needs: ranks of three words fit one 64-bit
key, ranks of three such keys the next, so four integer sorts make the array.

Scale: the documents are read once per block of test items and are never shuffled; a task holds
one block of text (or one document). Test items are cut into pieces (overlapping by a window
less one word) that are packed into blocks of at most ``ITEM_BLOCK_BYTES``, each broadcast for
one pass: the size is checked and a larger test set means more passes, not a larger broadcast.

Cases: null and empty texts have no words; an item of fewer words than a window (but not none) is
one window; null item ids count as no item id and are searched but listed as the empty string;
repeated item ids count once; an empty test set leaves every document clean. Repeated rows are judged row by row, also over
several passes; kept columns pass through under their own names, others are ignored; a document longer than a block
is a block of its own; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import cut

WINDOW = 10
ITEM_BLOCK_BYTES = 32 << 20
SHARD_WORDS = 1 << 20
_BITS = np.int64(21)

MATCH = "array<struct<item_id: string, doc_word: long, item_word: long, n_words: long>>"
FOUND = {"hits": "array<struct<from: long, to: long>>", "items": "array<string>", "matches": MATCH}


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    s = keys[order]
    new = np.empty(len(s), dtype=bool)
    new[:1] = False
    np.not_equal(s[1:], s[:-1], out=new[1:])
    r = np.empty(len(s), dtype=np.int64)
    r[order] = np.cumsum(new)
    return r, s[np.concatenate([[True], new[1:]])] if len(s) else s


def _ahead(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(a), dtype=np.int64)
    out[:-k] = a[k:]
    return out


class SuffixArray:
    """Suffix array of one shard. ``words``: uint64 hashes, 0 as separator."""

    def __init__(self, words: np.ndarray):
        rank, self.vocabulary = _ranks(words)
        if not len(words) or words.min() != 0:  # rank 0 is kept for the separator
            rank += 1
            self.vocabulary = np.concatenate([[np.uint64(0)], self.vocabulary])
        self.rank = rank
        three, _ = _ranks((rank << (2 * _BITS)) | (_ahead(rank, 1) << _BITS) | _ahead(rank, 2))
        nine, _ = _ranks((three << (2 * _BITS)) | (_ahead(three, 3) << _BITS) | _ahead(three, 6))
        self.order = np.argsort((nine << (2 * _BITS)) | (_ahead(rank, 9) << _BITS) | _ahead(rank, 10))

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Ranks of words of the test items; -1 where the shard lacks the word."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of patterns (rows of ranks, all of one length): [lo, hi) in ``order``."""
        return self._bound(q, False), self._bound(q, True)

    def _bound(self, q: np.ndarray, right: bool) -> np.ndarray:
        n, m = len(self.order), q.shape[1]
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), n, np.int64)
        for _ in range(int(n).bit_length() + 1):
            open_ = lo < hi
            mid = np.minimum((lo + hi) >> 1, n - 1)
            at = self.order[mid]
            less = np.zeros(len(q), bool)
            same = np.ones(len(q), bool)
            for j in range(m):
                w = np.where(at + j < n, self.rank[np.minimum(at + j, n - 1)], 0)
                less |= same & (w < q[:, j])
                same &= w == q[:, j]
            up = (less | same) if right else less
            lo = np.where(open_ & up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)
        return lo


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tb.LOWER[buf]
    starts, ends, at = tb.spans(low, offs, tb.ALNUM)
    return np.maximum(tb.hash_spans(low, starts, ends), np.uint64(1)), at


class TestItems:
    """One block of test items, ready for searching: distinct windows and where they stand."""

    def __init__(self, ids: list[str], firsts: list[int], texts: list[str], window: int):
        col = pa.array(texts, pa.large_string())
        self.words, at = _tokens(*tb.text_buffer(col))
        self.window, self.first = window, np.array(firsts, dtype=np.int64)
        self.ids, self.item = np.unique(np.array(ids, dtype=str), return_inverse=True)
        n = at[1:] - at[:-1]
        self.begin, self.end = at[:-1], at[1:]
        self.groups = []  # (length, distinct windows as rows, sorted places of each)
        for m in sorted({*np.minimum(n[n > 0], window).tolist()}):
            rows = np.flatnonzero(n == m) if m < window else np.flatnonzero(n >= window)
            owner, k = tb.ragged(np.where(n[rows] >= m, n[rows] - m + 1, 0))
            place, piece = self.begin[rows][owner] + k, rows[owner]
            pat = self.words[place[:, None] + np.arange(m)]
            _, first, inverse = np.unique(pat, axis=0, return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
            by = np.argsort(inverse, kind="stable")
            self.groups.append((m, pat[first], place[by], piece[by], np.searchsorted(inverse[by], np.arange(len(first) + 1))))


def _search(seq: np.ndarray, items: TestItems) -> tuple[np.ndarray, ...]:
    """All (sequence place, window length, group, distinct window) of windows that occur."""
    found = []
    overlap = items.window - 1
    for s in range(0, max(len(seq) - overlap, 1), SHARD_WORDS):
        part = seq[s:s + SHARD_WORDS + overlap]
        sa = SuffixArray(part)
        for g, (m, pats, *_rest) in enumerate(items.groups):
            q = sa.lookup(pats.reshape(-1)).reshape(pats.shape)
            there = np.flatnonzero((q > 0).all(axis=1))
            if not len(there):
                continue
            lo, hi = sa.intervals(q[there])
            owner, k = tb.ragged(hi - lo)
            place = sa.order[lo[owner] + k]
            # in the overlap, a place belongs to the next shard
            keep = (place < SHARD_WORDS) | (s + SHARD_WORDS + overlap >= len(seq))
            found.append((s + place[keep], np.full(keep.sum(), m), np.full(keep.sum(), g), there[owner][keep]))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


def _longest(seq, items, place, group, window):
    """Longest match of each (document place run, item piece): extend from the first window of a
    run. Yields arrays (place, item word place, piece, length), in bounded chunks."""
    for g in np.unique(group):
        m, _, places, pieces, at = items.groups[g]
        rows = np.flatnonzero(group == g)
        lens = at[window[rows] + 1] - at[window[rows]]
        cum = np.cumsum(lens)
        lo = 0
        while lo < len(rows):
            done = cum[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cum, done + (1 << 19), "right")))
            owner, k = tb.ragged(lens[lo:hi])
            r = rows[lo:hi][owner]
            p, j = place[r], at[window[r]] + k
            w, piece = places[j], pieces[j]
            starts = (w == items.begin[piece]) | (p == 0) | (seq[p - 1] != items.words[w - 1])
            p, w, piece = p[starts], w[starts], piece[starts]
            n = np.full(len(p), m, np.int64)
            live = np.arange(len(p))
            while len(live):
                live = live[(w[live] + n[live] < items.end[piece[live]]) & (p[live] + n[live] < len(seq))]
                live = live[seq[p[live] + n[live]] == items.words[w[live] + n[live]]]
                n[live] += 1
            yield p, w, piece, n
            lo = hi


def _match_block(items: TestItems, words: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    n_docs = len(at) - 1
    n = at[1:] - at[:-1]
    # one separator (0) after each document
    seq = np.zeros(len(words) + n_docs, np.uint64)
    owner, _ = tb.ragged(n)
    seq[np.arange(len(words)) + owner] = words
    begin = at[:-1] + np.arange(n_docs)
    place, length, group, window = _search(seq, items)
    # hit words as merged intervals
    by = np.argsort(place, kind="stable")
    place, length, group, window = place[by], length[by], group[by], window[by]
    reach = np.maximum.accumulate(place + length) if len(place) else place
    new = np.ones(len(place), bool)
    new[1:] = place[1:] > reach[:-1]
    lo = place[new]
    hi = reach[np.concatenate([np.flatnonzero(new)[1:], [len(place)]]).astype(np.int64) - 1] if len(place) else place
    doc = np.searchsorted(begin, lo, "right") - 1
    hit_at = np.searchsorted(doc, np.arange(n_docs + 1))
    hits = tb.list_array(pa.StructArray.from_arrays([pa.array(lo - begin[doc]), pa.array(hi - begin[doc])], names=["from", "to"]), hit_at)
    # items with occurring windows, longest match of each
    got = [x for x in _longest(seq, items, place, group, window) if len(x[0])]
    if got:
        p, w, piece, m = (np.concatenate(x) for x in zip(*got))
        d = np.searchsorted(begin, p, "right") - 1
        item = items.item[piece]
        by = np.lexsort((p, -m, item, d))
        p, w, piece, m, d, item = p[by], w[by], piece[by], m[by], d[by], item[by]
        first = np.ones(len(p), bool)
        first[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
        p, w, piece, m, d = p[first], w[first], piece[first], m[first], d[first]
    else:
        p = w = piece = m = d = np.zeros(0, np.int64)
    ids = pa.array(items.ids[items.item[piece]].tolist() if len(piece) else [], pa.string())
    match_at = np.searchsorted(d, np.arange(n_docs + 1))
    fields = [ids, pa.array(p - begin[d]), pa.array(w - items.begin[piece] + items.first[piece]), pa.array(m)]
    matches = tb.list_array(pa.StructArray.from_arrays(fields, names=["item_id", "doc_word", "item_word", "n_words"]), match_at)
    return [pa.array(n.astype(np.int64)), hits, tb.list_array(ids, match_at), matches]


def item_pieces(benchmark: DataFrame, window: int = WINDOW, piece_words: int = 100_000) -> DataFrame:
    """Rows (item_id string, first word, text): each item's words in pieces that overlap by a
    window less one word, so that every window stands whole in a piece."""
    words = F.filter(F.split(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                             r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")
    t = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.size("w") - F.lit(window))
    t = t.select("item_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(piece_words))).alias("first"))
    return t.select("item_id", "first", F.array_join(F.slice("w", F.col("first") + 1, piece_words + window - 1), " ").alias("text"))


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
                 block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """One row per document: the ``keep`` columns, n_words, hits (merged intervals of hit words),
    items (ids with occurring windows, sorted) and matches (per item the longest verbatim match,
    with its places in document and item)."""
    if not 1 <= window <= 11:
        raise ValueError("a window of 1 to 11 words is needed")
    spark = docs.sparkSession
    pieces = cut(item_pieces(benchmark, window))
    size = pieces.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // block_bytes) * 2) if size > block_bytes else 1
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    block_of = F.pmod(F.xxhash64("item_id", "first"), F.lit(n_blocks))
    used = sorted(r["b"] for r in pieces.select(block_of.alias("b")).distinct().collect()) or [0]  # a number a block
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    for i, b in enumerate(used):
        rows = pieces.where(block_of == b).collect()  # at most about block_bytes
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["first"] for r in rows], [r["text"] for r in rows]))
        out = _one_pass(out, shared, keep, kinds, window, i, i < len(used) - 1)
        if i < len(used) - 1:
            out = cut(out)  # a pass takes the rows of the pass before with their results: nothing is grouped
    out = out.select(*[F.col(f"`{c}`") for c in keep], "n_words", *[F.concat(*[f"_{c}_{i}" for i in range(len(used))]).alias(c) for c in FOUND])
    merged = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("reach")),
        lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], a["reach"]))).alias("sum"),
                              F.greatest(a["reach"], x["to"]).alias("reach")),
        lambda a: a["sum"])
    return out.select(*keep, "n_words", merged.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "matches")


def _one_pass(rows: DataFrame, shared, keep, kinds: str, window: int, number: int, carry: bool) -> DataFrame:
    """The kept columns, the results of earlier passes and of this one; with ``carry`` the text as well."""
    before = {f"_{c}_{b}": t for b in range(number) for c, t in FOUND.items()}
    text = {"_text": "string"} if carry else {}
    state = {}

    def fn(c, buf, offs):
        if "items" not in state:
            state["items"] = TestItems(*shared.value, window)
        return [*c.values(), *_match_block(state["items"], *_tokens(buf, offs))]

    added = {"n_words": "long"} | {f"_{c}_{number}": t for c, t in FOUND.items()}
    schema = ", ".join([kinds, *(f"{c} {t}" for c, t in (before | text | added).items())])
    return tb.scan(rows, [*keep, *before, *text], fn, schema, text="_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    # columns under neutral names, so that none clashes with those of the matches
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text"))
    found = find_matches(plain, benchmark, tuple(plain.columns[:-1]), window)
    return found.where(F.col("n_hit") == 0).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
