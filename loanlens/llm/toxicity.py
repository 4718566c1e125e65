"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, in numpy.

A text is cut into overlapping windows of ``WINDOW`` words (step ``STEP``; the last one ends with
the text), so every word of every text is read. A word's input is its hashed word embedding
beside the maxima of its hashed character-gram embeddings. A GRU reads the window in either
direction, attention pools the states, a logistic unit scores the window, and a text scores as its
highest window. Each block of text embeds its distinct words once, then all windows advance together.

Fitting (bounded: ``PER_CLASS`` labelled texts of either label, of at most ``MAX_BYTES`` each) is
multiple-instance learning: each round trains on the highest window of every text and a random other
one of the clean texts; the first rounds pick by per-word association with the label, which also starts one
embedding column. Adam, full back-propagation through time, fixed seed. The model is a few hundred kB and
is broadcast.

Cases: null and empty texts and texts without words score 0; without labelled rows of both labels
the untrained model scores 0 throughout; repeated rows score alike; extra columns are ignored; a very long text has more
windows, all of them scored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import sample

WINDOW, STEP = 32, 24
WORDS, GRAMS = 1 << 18, 1 << 16
SIZES = (5, 7)  # bytes of a character gram, the mark of the word's start included
# Words found in MIN_TEXTS fitting texts and more often than chance (by MIN_Z deviations) in toxic ones, or in
# COMMON texts, have an embedding each; all others share one, and their characters tell them apart.
MIN_TEXTS, MIN_Z, COMMON = 4, 3.0, 50
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 4, 8, 8
PER_CLASS, MAX_BYTES = 2000, 16 << 10
ROUNDS, BATCH, RATE, DECAY, DROP = 6, 96, 0.01, 0.05, 0.2
LEAST_STEPS = 240  # small samples get more rounds
_CHUNK = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of some texts: hashed word number, and character pairs as runs."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = tb.LOWER[buf]
        starts, ends, self.at = tb.spans(low, offs, tb.ALNUM)
        h = tb.hash_spans(low, starts, ends, 41)
        _, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        self.word = (h[first] % np.uint64(WORDS)).astype(np.int64)
        # the words' bytes, each with a mark before it; a word shorter than a gram is one gram
        data, base = tb.pack_spans(np.append(np.uint8(0x3C), low), s, e + 1)
        data[base[:-1]] = 0x3C
        self.grams = []
        for j, size in enumerate(SIZES):
            owner, k = tb.ragged(np.maximum(np.diff(base) - size, 0) + 1)
            at = base[:-1][owner] + k
            h = tb.hash_spans(data, at, np.minimum(at + size, base[1:][owner]), 42 + j)
            self.grams.append(((h % np.uint64(GRAMS)).astype(np.int64), np.searchsorted(owner, np.arange(len(first) + 1))))


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of each window."""
    n = at[1:] - at[:-1]
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STEP), 0) + 1, 0)
    doc, k = tb.ragged(count)
    first = at[:-1][doc] + np.minimum(k * STEP, np.maximum(n[doc] - WINDOW, 0))
    return first, np.minimum(n[doc], WINDOW), doc


def init(n_slots: int, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    x, h = WORD_DIM + len(SIZES) * GRAM_DIM, HIDDEN

    def near(*shape, scale=None):
        return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

    p = {"word": near(n_slots, WORD_DIM, scale=0.05)}
    for d in "fb":
        p |= {f"w_{d}": near(x, 3 * h), f"b_{d}": np.zeros(3 * h, np.float32), f"g_{d}": near(h, 2 * h), f"c_{d}": near(h, h)}
    return p | {"a": near(2 * h, ATTEND), "a0": np.zeros(ATTEND, np.float32), "v": near(ATTEND, 1)[:, 0], "o": near(2 * h, 1)[:, 0],
                "o0": np.full(1, -2, np.float32)}


def _inputs(p: dict, w: Words, best: bool = False):
    """Input of each distinct word; with ``best`` also which gram gave each maximum."""
    parts, which = [p["word"][p["slot"][w.word]]], []
    for j, (gram, at) in enumerate(w.grams):
        table, gram = p[f"gram{j}"], p[f"slot{j}"][gram]
        top = np.zeros((len(w.word), GRAM_DIM), np.float32)
        for lo in range(0, len(w.word), 50_000):  # bounded scratch
            a = at[lo:lo + 50_001]
            top[lo:lo + 50_000] = np.maximum.reduceat(table[gram[a[0]:a[-1]]], a[:-1] - a[0], axis=0)
        parts.append(top)
        if best:
            owner, _ = tb.ragged(np.diff(at))
            hit = table[gram] == top[owner]
            pick = np.zeros((len(w.word), GRAM_DIM), np.int64)
            for d in range(GRAM_DIM):
                pick[owner[hit[:, d]], d] = gram[hit[:, d]]
            which.append(pick)
    x = np.concatenate(parts, axis=1)
    return (x, which) if best else x


def _gather(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)
    mask = t < n[:, None]
    return np.where(mask, ids[np.minimum(first[:, None] + t, len(ids) - 1)], 0), mask


def forward(p: dict, xf: np.ndarray, xb: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Window logits. xf, xb: input projections of the distinct words for either direction."""
    n, steps = ids.shape
    h2 = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    trail = {"f": [], "b": []}
    for d, x, order, part in (("f", xf, range(steps), slice(0, HIDDEN)), ("b", xb, range(steps - 1, -1, -1), slice(HIDDEN, None))):
        h = np.zeros((n, HIDDEN), np.float32)
        gate, cand = p[f"g_{d}"], p[f"c_{d}"]
        for t in order:
            inp = x[ids[:, t]]
            rz = _sigmoid(inp[:, :2 * HIDDEN] + h @ gate)
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:] * mask[:, t, None]
            c = np.tanh(inp[:, 2 * HIDDEN:] + (r * h) @ cand)
            new = h + z * (c - h)
            if keep:
                trail[d].append((t, h, r, z, c))
            h = new
            h2[t][:, part] = h
    u = np.tanh(h2 @ p["a"] + p["a0"])
    s = np.where(mask.T, u @ p["v"], -1e9).astype(np.float32)
    alpha = np.exp(s - s.max(axis=0))
    alpha /= alpha.sum(axis=0)
    pooled = (alpha[:, :, None] * h2).sum(axis=0)
    logit = pooled @ p["o"] + p["o0"][0]
    return (logit, (h2, u, alpha, pooled, trail)) if keep else logit


def backward(p: dict, ids: np.ndarray, mask: np.ndarray, state, dlogit: np.ndarray, n_words: int) -> tuple[dict, np.ndarray, np.ndarray]:
    h2, u, alpha, pooled, trail = state
    g = {"o": pooled.T @ dlogit, "o0": dlogit.sum(keepdims=True)}
    dp = dlogit[:, None] * p["o"]
    da = (h2 * dp).sum(axis=2)
    ds = alpha * (da - (alpha * da).sum(axis=0)) * mask.T
    g["v"] = np.einsum("tnd,tn->d", u, ds)
    du = ds[:, :, None] * p["v"] * (1 - u * u)
    g["a"], g["a0"] = np.einsum("tnh,tnd->hd", h2, du), du.sum(axis=(0, 1))
    dh2 = alpha[:, :, None] * dp + du @ p["a"].T
    dx = {}
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        gate, cand = p[f"g_{d}"], p[f"c_{d}"]
        dgate, dcand = np.zeros_like(gate), np.zeros_like(cand)
        dinp = np.zeros((n_words, 3 * HIDDEN), np.float32)
        carry = np.zeros((ids.shape[0], HIDDEN), np.float32)
        for t, h, r, z, c in reversed(trail[d]):
            dh = carry + dh2[t][:, part]
            dz, dc = dh * (c - h), dh * z
            dac = dc * (1 - c * c)
            drh = dac @ cand.T
            dcand += (r * h).T @ dac
            m = mask[:, t, None]
            daz, dar = dz * z * (1 - z) * m, drh * h * r * (1 - r)
            drz = np.concatenate([dar, daz], axis=1)
            dgate += h.T @ drz
            carry = dh * (1 - z) + drh * r + drz @ gate.T
            np.add.at(dinp, ids[:, t], np.concatenate([drz, dac], axis=1))
        g[f"g_{d}"], g[f"c_{d}"], dx[d] = dgate, dcand, dinp
    return g, dx["f"], dx["b"]


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items() if x.dtype == np.float32} for _ in range(2))

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * DECAY * p[k]).astype(np.float32)


def _logits(p: dict, w: Words, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = _inputs(p, w)
    xf, xb = x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"]
    out = np.zeros(len(first), np.float32)
    for lo in range(0, len(first), _CHUNK):
        ids, mask = _gather(w.ids, first[lo:lo + _CHUNK], n[lo:lo + _CHUNK])
        out[lo:lo + _CHUNK] = forward(p, xf, xb, ids, mask)
    return out


def _highest(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Index of the highest window of each document, -1 without one."""
    by = np.lexsort((-values, doc))
    first = np.ones(len(by), bool)
    first[1:] = doc[by][1:] != doc[by][:-1]
    out = np.full(n_docs, -1, np.int64)
    out[doc[by][first]] = by[first]
    return out


def train(rows: list[tuple[str, int]], rounds: int = ROUNDS, seed: int = 7) -> dict | None:
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    w = Words(*tb.text_buffer(pa.array([r[0] for r in rows], pa.large_string())))
    first, n, doc = windows(w.at)
    # association of each hashed word with the label, over documents
    owner, _ = tb.ragged(np.diff(w.at))
    seen = np.unique(owner * WORDS + w.word[w.ids])
    d, b = seen // WORDS, seen % WORDS
    n_all, n_pos = np.bincount(b, minlength=WORDS), np.bincount(b, weights=y[d], minlength=WORDS)
    expect = n_all * y.mean()
    z = (n_pos - expect) / np.sqrt(expect + 1)
    assoc = np.clip(z / 4, -1, 3).astype(np.float32)
    own = (n_all >= MIN_TEXTS) & (z >= MIN_Z) | (n_all >= COMMON)
    slot = np.where(own, np.cumsum(own), 0).astype(np.int32)
    p = init(int(slot.max()) + 1, seed) | {"slot": slot}
    p["word"][slot, 0] = np.where(slot > 0, assoc, 0)
    strength = np.where(slot > 0, assoc, -1)[w.word]
    # character grams start from their own association
    doc_word = np.unique(owner * len(w.word) + w.ids)
    for j, (gram, at) in enumerate(w.grams):
        dw, word = doc_word // len(w.word), doc_word % len(w.word)
        run, k = tb.ragged(np.diff(at)[word])
        seen = np.unique(dw[run] * GRAMS + gram[at[word][run] + k])
        d, b = seen // GRAMS, seen % GRAMS
        n_all, n_pos = np.bincount(b, minlength=GRAMS), np.bincount(b, weights=y[d], minlength=GRAMS)
        expect = n_all * y.mean()
        zg = np.where(n_all >= MIN_TEXTS, (n_pos - expect) / np.sqrt(expect + 1), 0)
        own = (zg >= MIN_Z) | (n_all >= COMMON)
        slot = p[f"slot{j}"] = np.where(own, np.cumsum(own), 0).astype(np.int32)
        table = p[f"gram{j}"] = (rng.standard_normal((int(slot.max()) + 1, GRAM_DIM)) * 0.05).astype(np.float32)
        table[slot, 0] = np.where(slot > 0, np.clip(zg / 4, -1, 3), 0)
        strength = np.maximum(strength, np.maximum.reduceat(table[slot[gram], 0], at[:-1]))
    strength = strength[w.ids]
    t = np.arange(WINDOW)
    start = np.where(t < n[:, None], strength[np.minimum(first[:, None] + t, len(strength) - 1)], -1).max(axis=1)
    weight = np.where(y > 0, np.sqrt(len(y) / (2 * y.sum())), 1).astype(np.float32)
    opt = Adam(p, RATE)
    begin = np.searchsorted(doc, np.arange(len(y)))
    count = np.bincount(doc, minlength=len(y))
    n_win = int((count > 0).sum() + ((count > 0) & (y == 0)).sum())
    rounds = max(rounds, -(-LEAST_STEPS * BATCH // max(n_win, BATCH)))
    for k in range(rounds):
        top = _highest(start if k < (rounds + 1) // 2 else _logits(p, w, first, n), doc, len(y))
        use = np.flatnonzero(top >= 0)
        clean = use[y[use] == 0]
        other = begin[clean] + rng.integers(0, count[clean])
        win = np.concatenate([top[use], other])
        lab, wt = np.concatenate([y[use], y[clean]]), np.concatenate([weight[use], weight[clean]])
        order = rng.permutation(len(win))
        for lo in range(0, len(order), BATCH):
            i = order[lo:lo + BATCH]
            ids, mask = _gather(w.ids, first[win[i]], n[win[i]])
            uniq, local = np.unique(ids, return_inverse=True)
            sub = _subset(w, uniq)
            live = (rng.random(len(uniq)) >= DROP).astype(np.float32)[:, None]
            x, which = _inputs(p, sub, best=True)
            x *= live
            local = local.reshape(ids.shape)
            logit, state = forward(p, x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"], local, mask, keep=True)
            g, df, db = backward(p, local, mask, state, ((_sigmoid(logit) - lab[i]) * wt[i] / len(i)).astype(np.float32), len(uniq))
            g |= {"w_f": x.T @ df, "w_b": x.T @ db, "b_f": df.sum(axis=0), "b_b": db.sum(axis=0)}
            dx = (df @ p["w_f"].T + db @ p["w_b"].T) * live
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], p["slot"][sub.word], dx[:, :WORD_DIM])
            for j, pick in enumerate(which):
                part = WORD_DIM + j * GRAM_DIM
                g[f"gram{j}"] = np.zeros_like(p[f"gram{j}"])
                for d in range(GRAM_DIM):
                    np.add.at(g[f"gram{j}"][:, d], pick[:, d], dx[:, part + d])
            opt.step(p, g)
    return p


def _subset(w: Words, uniq: np.ndarray) -> Words:
    s = object.__new__(Words)
    s.word, s.grams = w.word[uniq], []
    for gram, at in w.grams:
        lens = at[uniq + 1] - at[uniq]
        owner, k = tb.ragged(lens)
        s.grams.append((gram[at[uniq][owner] + k], np.append(0, np.cumsum(lens))))
    return s


def score_texts(p: dict, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    w = Words(buf, offs)
    first, n, doc = windows(w.at)
    out = np.zeros(len(offs) - 1)
    np.maximum.at(out, doc, _sigmoid(_logits(p, w, first, n).astype(np.float64)))
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic", per_class: int = PER_CLASS) -> dict | None:
    return train(sample(docs, labels, label, train_rows, per_class, MAX_BYTES))


def score(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score``."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(cols, buf, offs):
        return [*cols.values(), pa.array(score_texts(shared.value, buf, offs))]

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return tb.scan(docs, list(keep), fn, f"{kinds}, score double")
