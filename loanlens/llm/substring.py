"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the smallest hash among
its word pairs (short ones rank last, so common function words are rarely minimisers).
Consecutive windows with the same minimiser overlap almost wholly, so they travel as one packed string, a
super-k-mer of (windows + 12) words, to the bucket of the minimiser. All occurrences of a window share its
minimiser, hence its bucket, where the windows are sorted and equal ones counted together: the
smallest doc_id of each distinct window decides which occurrences go.

Before the shuffle a block of text merges equal super-k-mers into one string with its list of
places, and packs the strings of a bucket into one compressed value. A string with more than ``HOT``
places in a block (a passage that many documents share) sends only its smallest doc_id to the bucket; its
places meet the bucket's answer in a join on the string's digest, which the planner may split, so no
task gathers the places of a hot passage.

Bucket numbers follow the minimiser hash; the number of buckets follows the input's bytes, and a
task works through its buckets one after another, each of about ``BUCKET_BYTES``. The bytes of each bucket
are counted first. A bucket of over ``SPLIT`` times that (different strings around one frequent word pair)
is dealt anew by a second minimiser, among runs of ``SECOND`` words, and what is still over by the window
itself: equal windows share both, so they stay together. At the last level each block sends a
window once, with its smallest doc_id, and all its places go the way of hot strings.

Cases: null and empty texts have no words; a null doc_id ranks above all others; rows with the
same doc_id do not count against each other; the text becomes its kept words joined by one space; all other
columns pass through, whatever their names; an empty table gives an empty result. Ids of a type other than
integers are numbered in their order. Equal rows share their intervals.
"""

from __future__ import annotations

import pickle
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .tables import cut, long_ids

WINDOW = 13
GRAM = 2
SECOND = 6
HOT = 64
BUCKET_BYTES = 16 << 20
SPLIT = 2
NO_ID = (1 << 63) - 1
_SHORT = 8


def _words(buf: np.ndarray, offs: np.ndarray):
    starts, ends, at = tb.spans(buf, offs, tb.NONSPACE)
    return starts, ends, at, tb.hash_spans(buf, starts, ends, 31)


def _rolling(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Multilinear hash of each n consecutive values."""
    m = tb.random_words(seed, 0, n) | np.uint64(1)
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for j in range(n):
        out += h[j:len(out) + j] * m[j]
    return tb._mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def _minimisers(starts: np.ndarray, ends: np.ndarray, h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window the smallest hash among its runs of ``gram`` words."""
    x = _rolling(h, gram, 33) >> np.uint64(1)
    size = ends - starts
    if gram == GRAM and len(x):
        short = size[:-1] + size[1:] < _SHORT
        x |= short.astype(np.uint64) << np.uint64(63)
    return _sliding_min(x, window - gram + 1)


#: One way to deal windows: words of the minimiser, number of buckets, number of the first, and the
#: (sorted) buckets of the level before that are dealt so.
Level = namedtuple("Level", "gram buckets first over")


def super_kmers(starts: np.ndarray, ends: np.ndarray, at: np.ndarray, h: np.ndarray, window: int, levels: list[Level], least: int = 0):
    """(first word, number of windows, bucket, document) of each super-k-mer of the buckets from ``least``."""
    n = at[1:] - at[:-1]
    doc, k = tb.ragged(np.maximum(n - window + 1, 0))
    place = at[:-1][doc] + k
    del k
    low, bucket = np.zeros(len(place), np.uint64), np.zeros(len(place), np.int64)
    some = np.arange(len(place))
    for level in levels:
        if level.over is not None:
            some = some[np.isin(bucket[some], level.over)]
        if not len(some):
            break
        low[some] = _minimisers(starts, ends, h, window, level.gram)[place[some]]
        bucket[some] = level.first + (tb._mix(low[some]) % np.uint64(level.buckets)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    keep = bucket[first] >= least
    first, count = first[keep], count[keep]
    return place[first], count, bucket[first], doc[first]


def _pack(obj) -> tuple[int, bytes]:
    raw = pickle.dumps(obj, protocol=5)
    return len(raw), pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours (wrapping): small for ids in order."""
    return np.diff(x, prepend=x.dtype.type(0))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)


def _unpack(raw: int, data: bytes):
    return pickle.loads(pa.decompress(data, decompressed_size=raw, codec="zstd", asbytes=True))


def _strings(starts, ends, at, h, window: int, levels: list[Level], least: int = 0):
    """The super-k-mers (first word, windows, bucket, document, two digests), and equal ones of a bucket together:
    their order ``by``, and the first position and number of each distinct string in it."""
    first, count, bucket, doc = super_kmers(starts, ends, at, h, window, levels, least)
    if not len(first):
        return None
    # digests of the strings, from their word hashes
    n_words = count + window - 1
    owner, k = tb.ragged(n_words)
    begin = np.cumsum(n_words) - n_words
    h_of = h[first[owner] + k]
    longest = int(n_words.max())
    d1, d2 = (tb._mix(np.add.reduceat(h_of * (tb.random_words(s, 0, longest)[k] | np.uint64(1)), begin) + n_words.astype(np.uint64))
              for s in (34, 35))
    del owner, k, h_of
    by = np.lexsort((first, d2, d1, bucket))
    new = np.ones(len(by), bool)
    new[1:] = (d1[by][1:] != d1[by][:-1]) | (d2[by][1:] != d2[by][:-1]) | (bucket[by][1:] != bucket[by][:-1])
    g = np.flatnonzero(new)  # distinct strings, as positions in by
    return first, n_words, bucket, doc, d1, d2, by, g, np.diff(np.append(g, len(by)))


def _hot_from(window: int, levels: list[Level]) -> int:
    """The first bucket of the level of whole windows, where the places of every string go around the bucket."""
    last = levels[-1]
    return last.first if len(levels) > 1 and last.gram == window else NO_ID


def _loads(docs: DataFrame, levels: list[Level], window: int, hot: int) -> DataFrame:
    """(bucket, bytes) of the buckets of the last level."""
    def fn(cols, buf, offs):
        starts, ends, at, h = _words(buf, offs)
        got = _strings(starts, ends, at, h, window, levels, levels[-1].first)
        if got is None:
            return [pa.array([], pa.int64()), pa.array([], pa.int64())]
        first, n_words, bucket, _, _, _, by, g, many = got
        head = by[g]
        size = np.append(0, np.cumsum(ends - starts + 1))
        load = size[first[head] + n_words[head]] - size[first[head]] + 16 * (1 + np.where(many > hot, 0, many))
        new = np.flatnonzero(np.append(True, np.diff(bucket[head]) != 0))
        return [pa.array(bucket[head][new]), pa.array(np.add.reduceat(load, new))]

    return tb.scan(docs, [], fn, "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))


def plan_levels(docs: DataFrame, window: int, hot: int, bucket_bytes: int) -> list[Level]:
    """How windows are dealt to buckets: by the first minimiser, and buckets over the bound by the next key."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    levels = [Level(min(GRAM, window), max(1, -(-3 * size // bucket_bytes)), 0, None)]
    for gram in sorted({min(SECOND, window), window} - {levels[0].gram}):
        over = _loads(docs, levels, window, hot).where(F.col("bytes") > SPLIT * bucket_bytes).collect()
        if not over:
            break
        spread = 2 if gram < window else window  # strings become shorter, their common words are sent more often
        number = 1 + spread * sum(r["bytes"] for r in over) // bucket_bytes
        levels.append(Level(gram, number, levels[-1].first + levels[-1].buckets, np.array(sorted(r["bucket"] for r in over))))
    return levels


def _emit(docs: DataFrame, levels: list[Level], window: int, hot: int) -> DataFrame:
    """Rows (bucket, d1, d2, raw, data). bucket >= 0: packed super-k-mers; bucket < 0: the places of
    a string that is hot in its block, with the string's digest."""
    hot_from = _hot_from(window, levels)

    def fn(cols, buf, offs):
        starts, ends, at, h = _words(buf, offs)
        got = _strings(starts, ends, at, h, window, levels)
        if got is None:
            return _rows([])
        first, n_words, bucket, doc, d1, d2, by, g, many = got
        ids = cols["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)[doc]
        prints = cols["_text"].to_numpy(zero_copy_only=False)[doc]
        pos = (first - at[:-1][doc]).astype(np.int32)
        # words joined by single spaces
        norm, norm_at = tb.pack_spans(np.append(buf, np.uint8(32)), starts, ends + 1)
        norm[norm_at[1:] - 1] = 32
        head = by[g]
        smallest = np.minimum.reduceat(ids[by], g)
        # within a bucket in the order of the text: neighbours compress well
        again = np.lexsort((first[head], bucket[head]))
        g, many, head, smallest = g[again], many[again], head[again], smallest[again]
        apart = (many > hot) | (bucket[head] >= hot_from)
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[head]) != 0))
        rows = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(g))):
            s = head[lo:hi]
            text, text_at = tb.pack_spans(norm, norm_at[first[s]], norm_at[first[s] + n_words[s]])
            is_hot = apart[lo:hi]
            owner, k = tb.ragged(np.where(is_hot, 0, many[lo:hi]))
            own = by[g[lo:hi][owner] + k]
            raw, data = _pack((text, np.diff(text_at).astype(np.int32), _steps(smallest[lo:hi]), np.bincount(owner, minlength=hi - lo).astype(np.int32),
                               _steps(ids[own]), prints[own], pos[own], np.flatnonzero(is_hot), d1[s[is_hot]], d2[s[is_hot]]))
            rows.append((int(bucket[s[0]]), 0, 0, raw, data))
        for j in np.flatnonzero(apart):
            span = by[g[j]:g[j] + many[j]]
            raw, data = _pack((ids[span], prints[span], pos[span]))
            a, b = int(d1[head[j]].view(np.int64)), int(d2[head[j]].view(np.int64))
            rows.append((-1 - int(ids[span[0]] % 1009), a, b, raw, data))
        return _rows(rows)

    def _rows(rows):
        cols = list(zip(*rows)) if rows else [()] * 5
        return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]

    return tb.scan(docs, ["doc_id", "_text"], fn, "bucket long, d1 long, d2 long, raw long, data binary")


def _flagged(ids: np.ndarray, prints: np.ndarray, pos: np.ndarray, string: np.ndarray, limit: np.ndarray, at: np.ndarray, window: int):
    """Word intervals to remove. Place i: document ids[i], words from pos[i], string string[i];
    limit[at[s]:at[s + 1]]: smallest doc_id of each window of string s."""
    n = at[1:] - at[:-1]
    least = np.minimum.reduceat(limit, at[:-1]) if len(n) else limit
    some = np.flatnonzero(least[string] < ids)
    owner, k = tb.ragged(n[string[some]])
    out = limit[at[:-1][string[some]][owner] + k] < ids[some][owner]
    owner, k = owner[out], k[out]
    new = np.ones(len(k), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (k[1:] != k[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k))[:len(first)] - 1
    who = some[owner[first]]
    return ids[who], prints[who], pos[who] + k[first], pos[who] + k[last] + window


def _solve(packed: list, window: int):
    """One bucket: intervals of the places it holds, and the window limits of its hot strings."""
    texts, lens, smallest, many, ids, prints, pos = (np.concatenate([p[i] for p in packed]) for i in range(7))
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    _, _, at, h = _words(texts, offs)
    owner, k = tb.ragged(at[1:] - at[:-1] - window + 1)
    place = at[:-1][owner] + k
    one, two = _rolling(h, window, 36)[place], _rolling(h, window, 37)[place]
    by = np.argsort(one)
    split = one[by][1:] != one[by][:-1]
    differ = two[by][1:] != two[by][:-1]
    if (differ & ~split).any():  # two windows agree in the first hash only
        by = np.lexsort((two, one))
        split, differ = one[by][1:] != one[by][:-1], two[by][1:] != two[by][:-1]
    new = np.append(True, split | differ)
    low = np.minimum.reduceat(smallest[owner][by], np.flatnonzero(new))
    limit = np.empty(len(by), np.int64)
    limit[by] = low[np.cumsum(new) - 1]
    w_at = np.searchsorted(owner, np.arange(len(lens) + 1))
    got = _flagged(ids, prints, pos, np.repeat(np.arange(len(lens)), many), limit, w_at, window)
    base = np.cumsum([0] + [len(p[1]) for p in packed])[:-1]
    answers = {}
    for b, p in zip(base, packed):
        for s, x, y in zip(p[7], p[8], p[9]):
            answers.setdefault((int(x.view(np.int64)), int(y.view(np.int64))), limit[w_at[b + s]:w_at[b + s + 1]])
    return got, answers


_OUT = "kind int, doc long, print int, start long, stop long, d1 long, d2 long, raw long, data binary"
_OUT_ARROW = [("kind", pa.int32()), ("doc", pa.int64()), ("print", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()),
              ("d1", pa.int64()), ("d2", pa.int64()), ("raw", pa.int64()), ("data", pa.binary())]


def _buckets(emitted: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """kind 0: an interval; 1: places of a hot string, passed on; 2: window limits of a hot string."""
    schema = pa.schema(_OUT_ARROW)

    def batch(kind, n, **cols):
        empty = {c: pa.nulls(n, t) for c, t in _OUT_ARROW}
        return pa.RecordBatch.from_arrays([*(empty | {"kind": pa.array([kind] * n, pa.int32())} | cols).values()], schema=schema)

    def solved(packed):
        (doc, pr, start, stop), answers = _solve(packed, window)
        for lo in range(0, len(doc), 100_000):
            part = slice(lo, lo + 100_000)
            yield batch(0, len(doc[part]), doc=pa.array(doc[part]), print=pa.array(pr[part]), start=pa.array(start[part].astype(np.int64)),
                        stop=pa.array(stop[part].astype(np.int64)))
        if answers:
            data = [_pack(x) for x in answers.values()]
            yield batch(2, len(answers), d1=pa.array([k[0] for k in answers]), d2=pa.array([k[1] for k in answers]),
                        raw=pa.array([x[0] for x in data]), data=pa.array([x[1] for x in data], pa.binary()))

    def run(batches):
        bucket, packed = None, []
        for x in batches:
            number, raw = x.column(0).to_pylist(), x.column(3).to_pylist()
            for i, b in enumerate(number):
                if b < 0:
                    yield batch(1, 1, **{c: x.column(j).slice(i, 1) for c, j in (("d1", 1), ("d2", 2), ("raw", 3), ("data", 4))})
                    continue
                if b != bucket and packed:
                    yield from solved(packed)
                    packed = []
                bucket = b
                p = _unpack(raw[i], x.column(4)[i].as_py())
                packed.append((*p[:2], _sums(p[2]), p[3], _sums(p[4]), *p[5:]))
        if packed:
            yield from solved(packed)

    return emitted.repartition(max(1, n_buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(run, _OUT)


def _hot_intervals(out: DataFrame, window: int) -> DataFrame:
    places = out.where("kind = 1").select("d1", "d2", "raw", "data")
    limits = out.where("kind = 2").select("d1", "d2", F.col("raw").alias("limit_raw"), F.col("data").alias("limit_data")).dropDuplicates(["d1", "d2"])

    def run(batches):
        for x in batches:
            cols = [x.column(i).to_pylist() for i in range(4)]
            for raw, data, limit_raw, limit_data in zip(*cols):
                ids, prints, pos = _unpack(raw, data)
                limit = _unpack(limit_raw, limit_data)
                doc, pr, start, stop = _flagged(ids, prints, pos, np.zeros(len(ids), np.int64), limit, np.array([0, len(limit)]), window)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pr), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))],
                                                 names=["doc", "print", "start", "stop"])

    return places.join(limits, ["d1", "d2"]).select("raw", "data", "limit_raw", "limit_data").mapInArrow(run, "doc long, print int, start long, stop long")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, print, cut array<start, stop>) for documents (doc_id long, text): word intervals whose windows also start in a
    document with a smaller id. ``print`` is the hash of the row's text, ``doc`` the id (NO_ID for null)."""
    keyed = docs.select("doc_id", F.hash("text").alias("_text"), "text")
    levels = plan_levels(keyed, window, hot, bucket_bytes)
    out = cut(_buckets(_emit(keyed, levels, window, hot), window, levels[-1].first + levels[-1].buckets))
    found = out.where("kind = 0").select("doc", "print", "start", "stop").unionByName(_hot_intervals(out, window))
    # equal rows name the same intervals: each is kept once, also before the shuffle
    return found.groupBy("doc", "print").agg(F.collect_set(F.struct("start", "stop")).alias("cut"))


def drop_repeats(docs: DataFrame, window: int = WINDOW, counts: tuple[str, str] | None = None, hot: int = HOT,
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents without the repeated words; ``counts`` names two further columns: words before,
    and words removed."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    numbered, _ = long_ids(named, f"_{columns.index('doc_id')}", "_doc")
    body = F.col(f"_{columns.index('text')}")
    cuts = repeated_intervals(numbered.select(F.col("_doc").alias("doc_id"), body.alias("text")), window, hot, bucket_bytes)
    plain = numbered.withColumn("doc", F.coalesce("_doc", F.lit(NO_ID))).withColumn("print", F.hash(body)).drop("_doc")
    joined = plain.join(cuts, ["doc", "print"], "left")
    text = f"_{columns.index('text')}"
    order = [f"_{i}" for i in range(len(columns))]

    def fn(cols, buf, offs):
        starts, ends, at = tb.spans(buf, offs, tb.NONSPACE)
        iv = cols["cut"]
        iv_at = np.asarray(iv.offsets)
        first, last = (np.asarray(iv.values.field(i))[iv_at[0]:iv_at[-1]] for i in (0, 1))
        owner, _ = tb.ragged(np.diff(iv_at))
        edge = np.bincount(at[:-1][owner] + first, minlength=len(starts) + 1) - np.bincount(at[:-1][owner] + last, minlength=len(starts) + 1)
        gone = np.cumsum(edge[:len(starts)]) > 0
        n = at[1:] - at[:-1]
        doc, _ = tb.ragged(n)
        kept = np.flatnonzero(~gone)
        more = np.zeros(len(kept), bool)  # a kept word of the same document follows
        more[:-1] = doc[kept[1:]] == doc[kept[:-1]]
        data, word_at = tb.pack_spans(np.append(buf, np.uint8(32)), starts[kept], ends[kept] + more)
        data[word_at[1:][more] - 1] = 32
        out = tb.string_array(data, word_at[np.searchsorted(doc[kept], np.arange(len(n) + 1))])
        got = dict(cols) | {text: out, "_n": pa.array(n.astype(np.int64)), "_gone": pa.array(np.bincount(doc[gone], minlength=len(n)).astype(np.int64))}
        return [got[c] for c in (*order, "_n", "_gone")]

    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in order) + ", _n long, _gone long"
    done = tb.scan(joined, [c for c in order if c != text] + ["cut"], fn, schema, text=text)
    names = [F.col(c).alias(name) for c, name in zip(order, columns)]
    if counts:
        names += [F.col("_n").alias(counts[0]), F.col("_gone").alias(counts[1])]
    return done.select(*names)
