"""Vectorised scanning of Arrow text columns: spans (words, lines) and 64-bit span hashes.

Texts stay in their Arrow byte buffer: a span is a (start, end) pair of byte offsets, so a task
never makes one Python object per word. UTF-8 keeps this exact for classes that treat all
non-ASCII characters alike: every byte of such a character is 0x80 or above.

Work goes in blocks of whole documents of about ``BLOCK_BYTES``; memory is bounded by a block
or by the longest single document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 4 << 20
_TABLE = 1 << 12


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift multiply)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, start: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, a pure function of (seed, position)."""
    return _mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                + np.uint64((seed * 0xD1342543DE82EF95 + 1) % (1 << 64)))


def _not_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        t[lo:hi + 1] = False
    return t


SPACES = ~_not_bytes((0x20, 0x20), (0x09, 0x0D))
#: bytes of a word ``[^\x20\x09-\x0D]+``
NONSPACE = ~SPACES
#: bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (on lower-cased text)
ALNUM = _not_bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, every other byte unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes within each document: starts, ends, and for the documents
    the n + 1 offsets into those arrays."""
    m = member[buf]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    cuts = offs[1:-1]
    at = cuts[(cuts > 0) & (cuts < len(buf))]
    first[at] = m[at]
    last[at - 1] = m[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ragged(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments of the given lengths laid end to end: owner and position of each element."""
    owner = np.repeat(np.arange(len(lens)), lens)
    begin = np.cumsum(lens) - lens
    return owner, np.arange(len(owner)) - begin[owner]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span: a sum of random byte values times random position weights,
    finalised together with the length. Empty spans have a fixed value."""
    lens = ends - starts
    out = np.zeros(len(starts), dtype=np.uint64)
    table = random_words(2 * seed, 0, 256)
    weights = random_words(2 * seed + 1, 0, _TABLE) | np.uint64(1)
    full = np.flatnonzero(lens > 0)
    cum = np.cumsum(lens[full])
    lo = 0
    while lo < len(full):
        done = cum[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cum, done + (1 << 20), "right")))
        k = full[lo:hi]
        n = lens[k]
        begin = np.cumsum(n) - n
        pos = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
        w = weights[pos] if int(n.max()) <= _TABLE else random_words(2 * seed + 1, 0, int(n.max()))[pos] | np.uint64(1)
        out[k] = np.add.reduceat(table[buf[pos + np.repeat(starts[k], n)]] * w, begin)
        lo = hi
    return _mix(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pack_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans laid end to end, and their n + 1 offsets."""
    lens = ends - starts
    offs = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=offs[1:])
    idx = np.arange(offs[-1], dtype=np.int64) + np.repeat(starts - offs[:-1], lens)
    return buf[idx], offs


def string_array(data: np.ndarray, offs: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.string(), len(offs) - 1,
                                 [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def list_array(values: pa.Array, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def scan(df: DataFrame, columns: Sequence[str], fn: Callable, schema: str, limit: int = BLOCK_BYTES,
         text: str = "text") -> DataFrame:
    """Run ``fn(columns, buf, offs)`` over blocks of rows inside ``mapInArrow``: ``columns`` as a
    dict of Arrow arrays, the bytes and offsets of the text. ``fn`` returns Arrow arrays in the
    order of ``schema``, a DDL string."""
    names, out_names = list(columns), T.StructType.fromDDL(schema).fieldNames()

    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(batch.column(len(names)))
            for lo, hi in blocks(offs, limit):
                cols = {c: batch.column(i).slice(lo, hi - lo) for i, c in enumerate(names)}
                arrays = fn(cols, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                out = pa.RecordBatch.from_arrays(arrays, names=out_names)
                if out.num_rows:
                    yield out

    return df.select(*names, F.col(text).alias("_scanned_text")).mapInArrow(run, schema)
