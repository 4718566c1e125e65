"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes (step ``STEP``; the last one ends with the
text), which cover the whole of it. ``FILTERS`` learned filters of ``WIDTH`` bytes run over each
chunk and are max-pooled; a small layer turns the maxima (and the chunk's length) into chunk
features, whose mean and maximum over the text's chunks give one probability. A filter is a table of one
weight per place and byte value; for scoring, places are paired, so a step reads two rows.

Fitting (bounded: ``PER_CLASS`` labelled texts of either label, of at most ``MAX_BYTES`` each): Adam
on the cross-entropy, full back-propagation, fixed seed. The model is a few MB and is broadcast.

Cases: a null or empty text is one chunk without bytes, scored by the network's bias; without labelled rows of both
labels every score is 0.5; repeated rows score alike; extra columns are ignored; a very long text has more chunks, all
of them read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import sample
from .toxicity import Adam, _sigmoid

CHUNK, STEP = 512, 384
WIDTH, FILTERS, UNITS = 4, 24, 12
PER_CLASS, MAX_BYTES = 1500, 16 << 10
ROUNDS, BATCH, RATE = 5, 96, 0.01
LEAST_STEPS = 150  # small samples get more rounds
_SCRATCH = 1 << 18


def chunks(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and document of each chunk; an empty text has one empty chunk."""
    n = np.diff(offs)
    doc, k = tb.ragged(np.maximum(-(-(n - CHUNK) // STEP), 0) + 1)
    first = offs[:-1][doc] + np.minimum(k * STEP, np.maximum(n[doc] - CHUNK, 0))
    return first, np.minimum(n[doc], CHUNK), doc


def init(seed: int) -> dict:
    rng = np.random.default_rng(seed)

    def near(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {"f": near(WIDTH, 256, FILTERS, scale=0.3), "m": near(FILTERS + 1, UNITS, scale=0.2), "m0": np.zeros(UNITS, np.float32),
            "o": near(2 * UNITS, scale=0.3), "o0": np.zeros(1, np.float32)}


def pairs(p: dict) -> np.ndarray:
    """The filters over two bytes at a time: (WIDTH / 2, 65536, FILTERS)."""
    return np.stack([(p["f"][j][:, None, :] + p["f"][j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)])


def maxima(two: np.ndarray, buf: np.ndarray, first: np.ndarray, n: np.ndarray, where: bool = False):
    """Each filter's maximum over each chunk (0 at least), and with ``where`` its byte offset."""
    data = np.append(buf, np.zeros(WIDTH, np.uint8)).astype(np.int64)
    code = data[:-1] * 256 + data[1:]
    top = np.zeros((len(first), FILTERS), np.float32)
    at = np.full((len(first), FILTERS), -1, np.int64)
    places = n - WIDTH + 1
    full = np.flatnonzero(places > 0)
    cum = np.cumsum(places[full])
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + _SCRATCH, "right")))
        c = full[lo:hi]
        owner, k = tb.ragged(places[c])
        i = first[c][owner] + k
        v = two[0][code[i]]
        for j in range(1, WIDTH // 2):
            v += two[j][code[i + 2 * j]]
        begin = np.cumsum(places[c]) - places[c]
        top[c] = np.maximum.reduceat(v, begin, axis=0)
        if where:
            row, col = np.nonzero(v == top[c][owner])
            at[c[owner[row]], col] = i[row]
        lo = hi
    return (np.maximum(top, 0), np.where(top > 0, at, -1)) if where else np.maximum(top, 0)


def _head(p: dict, top: np.ndarray, n: np.ndarray, doc: np.ndarray, n_docs: int):
    x = np.concatenate([top, np.log1p(n)[:, None].astype(np.float32) / 6], axis=1)
    h = np.tanh(x @ p["m"] + p["m0"])
    begin = np.searchsorted(doc, np.arange(n_docs))
    count = np.bincount(doc, minlength=n_docs).astype(np.float32)[:, None]
    mean, high = np.add.reduceat(h, begin, axis=0) / count, np.maximum.reduceat(h, begin, axis=0)
    return x, h, count, mean, high, np.concatenate([mean, high], axis=1) @ p["o"] + p["o0"][0]


def train(rows: list[tuple[str, int]], seed: int = 11) -> dict | None:
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    buf, offs = tb.text_buffer(pa.array([r[0] for r in rows], pa.large_string()))
    p = init(seed)
    opt = Adam(p, RATE)
    for _ in range(max(ROUNDS, -(-LEAST_STEPS * BATCH // max(len(y), BATCH)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            d = np.sort(order[lo:lo + BATCH])
            own, own_at = tb.pack_spans(buf, offs[d], offs[d + 1])
            first, n, doc = chunks(own_at)
            top, at = maxima(pairs(p), own, first, n, where=True)
            x, h, count, mean, high, logit = _head(p, top, n, doc, len(d))
            dl = ((_sigmoid(logit) - y[d]) / len(d)).astype(np.float32)
            g = {"o": np.concatenate([mean, high], axis=1).T @ dl, "o0": dl.sum(keepdims=True)}
            dh = (dl[:, None] * p["o"][:UNITS] / count)[doc] + np.where(h == high[doc], (dl[:, None] * p["o"][UNITS:])[doc], 0)
            da = dh * (1 - h * h)
            g["m"], g["m0"] = x.T @ da, da.sum(axis=0)
            dt = (da @ p["m"].T)[:, :FILTERS]
            row, col = np.nonzero(at >= 0)
            g["f"] = np.zeros_like(p["f"])
            for j in range(WIDTH):
                np.add.at(g["f"][j], (own[at[row, col] + j], col), dt[row, col])
            opt.step(p, g)
    return p


class Scorer:
    def __init__(self, p: dict):
        self.p, self.two = p, pairs(p)

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        first, n, doc = chunks(offs)
        return _sigmoid(_head(self.p, maxima(self.two, buf, first, n), n, doc, len(offs) - 1)[-1].astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, train_rows, label: str = "quality", per_class: int = PER_CLASS) -> dict | None:
    return train(sample(docs, labels, label, train_rows, per_class, MAX_BYTES))


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score``."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state = {}

    def fn(cols, buf, offs):
        if "scorer" not in state:
            state["scorer"] = Scorer(shared.value)
        return [*cols.values(), pa.array(state["scorer"](buf, offs))]

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return tb.scan(docs, list(keep), fn, f"{kinds}, score double")
