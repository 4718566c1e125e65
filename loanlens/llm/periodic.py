"""Periodic runs in texts, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least
``least`` words and ``exponent`` periods, that no neighbouring word extends.

1. Every factor (stretch of consecutive words) of 1, 2, 4, ... words that occurs again in its document gets a name: a
   factor of 2m words is the pair of the names of its halves. A level ends with the names that occur
   once; the levels end when none is left, so ordinary prose needs few.
2. Per level the successor of an occurrence is the next one of the same name. Successors within twice
   the factor's length that follow each other at equal distances form an arithmetic progression of
   three members or more; its difference is proposed as a period. Only the first of neighbouring
   starts is kept: the other ones propose the same run.
   A run of period q and 4 q words holds, at the level of q to 2 q words, its first factor three times,
   q apart; a factor of q words or more cannot occur at other distances inside the run. So every run is
   proposed at its first word, and the difference of successors is always its smallest period.
3. A proposal is extended to the left and to the right with the same names, from the longest level to
   single words, and equal results are taken once.

All of it is one ``mapInArrow`` over blocks of whole documents: no shuffle, memory of a block or of the
longest text (some 100 bytes a word).

Cases: a null, empty or blank text has no words, no runs and an empty collapsed text; ties between runs
and repeated rows are judged row by row; an empty table gives no rows; only the id and the text are
read, so extra columns of any name are ignored. Ids of any type are returned as they are. A run of
exponent below ``exponent`` is not looked for; ``exponent`` must be 4 or more for step 2 to find all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb

LEAST = 6
EXPONENT = 4
BLOCK_BYTES = 1 << 20

#: ids (Arrow) and numbers of words of documents -> (document, word order) of those read in another order
Order = Callable[[pa.Array, np.ndarray], Iterable[tuple[int, np.ndarray]]]


def _levels(code: np.ndarray, end: np.ndarray):
    """Yield (size, positions, names) of the factors that occur twice or more, and (place, gap) of
    the occurrences with a successor within twice the size. ``code`` tells words of one document
    apart and never agrees between documents; ``end`` is the end of each word's document."""
    pos, size = np.arange(len(code)), 1
    while len(pos):
        by = np.argsort(code, kind="stable")
        c, p = code[by], pos[by]
        same = c[1:] == c[:-1]
        again = np.zeros(len(p), bool)
        again[1:] |= same
        again[:-1] |= same
        rank = np.cumsum(np.concatenate([[0], ~same]))
        step = p[1:] - p[:-1]
        near = same & (step <= 2 * size)
        name = np.full(len(end), -1, np.int64)
        name[p[again]] = rank[again]
        at = np.flatnonzero(name >= 0)
        yield size, at, name[at], p[:-1][near], step[near]
        at = at[at + 2 * size <= end[at]]
        first, second = name[at], name[at + size]
        both = second >= 0
        pos, code = at[both], first[both] * (int(rank[-1]) + 1) + second[both]
        size *= 2


def maximal_runs(words: np.ndarray, at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period. ``words``:
    64-bit word hashes of the documents laid end to end, ``at``: their n + 1 offsets."""
    n = at[1:] - at[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    end = at[1:][owner]
    levels, start, period = [], [], []
    for size, place, name, i, gap in _levels(tb._mix(words + tb._mix(owner.astype(np.uint64) + np.uint64(1))), end):
        levels.append((size, place, name))
        step = np.zeros(len(end), np.int64)
        step[i] = gap
        i = np.flatnonzero(step)
        i = i[step[i + step[i]] == step[i]]
        head = np.zeros(len(end), np.int64)
        head[i] = step[i]
        i = i[(i == 0) | (head[i - 1] != step[i])]
        start.append(i)
        period.append(step[i])
    if not start:
        return np.zeros((0, 4), np.int64)
    found = np.unique(np.stack([np.concatenate(start), np.concatenate(period)], axis=1), axis=0)

    def same(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place, name = levels[k][1:]
        if not len(place):
            return np.zeros(len(a), bool)
        x, y = (np.minimum(np.searchsorted(place, v), len(place) - 1) for v in (a, b))
        return (place[x] == a) & (place[y] == b) & (name[x] == name[y])

    left, q = found[:, 0].copy(), found[:, 1]
    right = left.copy()
    for k in range(len(levels) - 1, -1, -1):
        size = levels[k][0]
        left -= np.where(same(k, left - size, left - size + q), size, 0)
        right += np.where(same(k, right, right + q), size, 0)
    length = right + q - left
    runs = np.stack([left, length, q], axis=1)[length >= np.maximum(least, exponent * q)]
    runs = np.unique(runs, axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    doc = owner[runs[:, 0]]
    return np.column_stack([doc, runs[:, 0] - at[:-1][doc], runs[:, 1], runs[:, 2]])


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words of each document joined by one space; ``at``: the documents' offsets into the words."""
    width = ends - starts + 1
    width[at[1:][at[1:] > at[:-1]] - 1] -= 1  # no space after a last word
    offs = np.concatenate([[0], np.cumsum(width)])
    out = np.full(int(offs[-1]), 0x20, np.uint8)
    for lo, hi in tb.blocks(offs, BLOCK_BYTES):
        owner, k = tb.ragged(ends[lo:hi] - starts[lo:hi])
        out[offs[lo:hi][owner] + k] = buf[starts[lo:hi][owner] + k]
    return tb.string_array(out, offs[at])


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, order: Order | None = None, id_column: str = "doc_id") -> DataFrame:
    """One row per document: the id, ``n_words``, ``runs`` (start, length, period: word numbers from 0, by
    start, then period) and ``collapsed``, the text without the words that any run contains after its
    first period, words joined by one space. ``order`` may have words of a document read in another
    order, with repeats."""
    if exponent < 4:
        raise ValueError("runs of fewer than 4 periods are not all found")

    def fn(cols, buf, offs):
        starts, ends, at = tb.spans(buf, offs, tb.NONSPACE)
        n = at[1:] - at[:-1]
        words = tb.hash_spans(buf, starts, ends, 31)
        if order is not None:
            read = np.arange(len(starts))
            for i, places in order(cols[id_column], n):
                read[at[i]:at[i + 1]] = at[i] + places
            starts, ends, words = starts[read], ends[read], words[read]
        runs = maximal_runs(words, at, least, exponent)
        begin = at[:-1][runs[:, 0]] + runs[:, 1]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, begin + runs[:, 3], 1)
        np.add.at(edge, begin + runs[:, 2], -1)
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        lists = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
        return [cols[id_column], pa.array(n.astype(np.int64)),
                tb.list_array(lists, np.searchsorted(runs[:, 0], np.arange(len(n) + 1))),
                _joined(buf, starts[kept], ends[kept], np.searchsorted(kept, at))]

    kind = docs.schema[id_column].dataType.simpleString()
    return tb.scan(docs, [id_column], fn, f"`{id_column}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
                   BLOCK_BYTES)


def planted_order(ids: pa.Array, n: np.ndarray):
    """The word order of documents with a planted repetition: of those with h = crc32(id as text),
    h % 10 = 0 and words, word i >= a is word a + (i - a) % p, where g = h // 10, a = g % n and
    p = 1 + (n - a) // (3 + g % 8)."""
    for i, key in enumerate(ids.to_pylist()):
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n[i]:
            g, m = h // 10, int(n[i])
            a = g % m
            p = 1 + (m - a) // (3 + g % 8)
            k = np.arange(m)
            yield i, np.where(k >= a, a + (k - a) % p, k)
