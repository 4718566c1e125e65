"""Trained models: held-out accuracy, gradients, whole-text coverage and awkward inputs."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanlens.llm import quality_model, textbytes, toxicity
from loanlens.llm.labelled import sample

from .helpers import AWKWARD, make

SF = "/root/testdata/sf0.01"


def labelled(label, mod):
    rows = duckdb.sql(f"SELECT doc_id, text, {label} FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % mod[0] == mod[1] for r in rows]
    return [r[1:] for r, h in zip(rows, held) if not h], [r[1:] for r, h in zip(rows, held) if h]


def auc(score, y):
    rank = np.empty(len(y))
    rank[np.argsort(score)] = np.arange(len(y))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train(sorted(labelled("toxic", (4, 2))[0]))


def score(p, texts):
    return toxicity.score_texts(p, *textbytes.text_buffer(pa.array(texts, pa.large_string())))


def test_toxicity_held_out(toxic_model):
    rows = labelled("toxic", (4, 2))[1]
    assert auc(score(toxic_model, [r[0] for r in rows]), np.array([r[1] for r in rows])) > 0.88


def test_toxicity_reads_whole_texts(toxic_model):
    clean = "the hat and on " * 3000
    low, high = score(toxic_model, [clean, clean + "idiot moron scum trash stupid loser"])
    assert low < 0.3 <= high


def test_toxicity_gradient():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(0)
    p = toxicity.init(6)
    x = rng.standard_normal((5, p["w_f"].shape[0])).astype(np.float32)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    ids, mask = rng.integers(0, 5, (3, 4)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], bool)

    def loss(q):
        return float((toxicity.forward(q, x @ q["w_f"] + q["b_f"], x @ q["w_b"] + q["b_b"], ids, mask) * [1, -2, 0.5]).sum())

    _, state = toxicity.forward(p, x @ p["w_f"] + p["b_f"], x @ p["w_b"] + p["b_b"], ids, mask, keep=True)
    g, df, db = toxicity.backward(p, ids, mask, state, np.array([1, -2, 0.5]), 5)
    g |= {"w_f": x.T @ df, "b_b": db.sum(axis=0)}
    for k in ("o", "v", "a", "g_f", "c_b", "w_f", "b_b"):
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        step = {**p, k: p[k].copy()}
        step[k][at] += 1e-2
        back = {**p, k: p[k].copy()}
        back[k][at] -= 1e-2
        assert abs((loss(step) - loss(back)) / 2e-2 - g[k][at]) < 2e-3, k


def test_quality_held_out_and_whole_text():
    train, held = labelled("quality", (5, 0))
    p = quality_model.train(sorted(train))
    s = quality_model.Scorer(p)
    got = s(*textbytes.text_buffer(pa.array([r[0] for r in held], pa.large_string())))
    assert auc(got, np.array([r[1] for r in held])) > 0.9
    one, two = s(*textbytes.text_buffer(pa.array(["plain words here " * 400, "plain words here " * 400 + "###$$$ &&& " * 100], pa.large_string())))
    assert one != two


def test_chunks_cover_every_byte():
    offs = np.array([0, 0, 3, 515, 515 + 5000])
    first, n, doc = quality_model.chunks(offs)
    seen = np.zeros(offs[-1], int)
    for a, b in zip(first, n):
        seen[a:a + b] += 1
    assert (seen >= 1).all() and set(doc.tolist()) == {0, 1, 2, 3}
    first, n, doc = toxicity.windows(np.array([0, 0, 3, 100]))
    seen = np.zeros(100, int)
    for a, b in zip(first, n):
        seen[a:a + b] += 1
    assert (seen >= 1).all() and set(doc.tolist()) == {1, 2}


def test_scores_of_awkward_rows(spark, toxic_model):
    d = make(spark, [(*r, None, None) for r in AWKWARD]).withColumnRenamed("lang", "score_")
    got = toxicity.score(d, toxic_model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(d.limit(0), toxic_model).count() == 0
    assert {r["score"] for r in toxicity.score(d, None).collect()} == {0.0}
    q = quality_model.init(1)
    got = quality_model.score(d, q).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_model.score(d, None).collect()} == {0.5}
    assert toxicity.train([("a", 1)]) is None and quality_model.train([]) is None


def test_labelled_sample_passes_over_long_texts(spark):
    docs = spark.createDataFrame([(i, "short" if i >= 56 else "long " * 100) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y long")
    got = sample(docs, labels, "y", F.lit(True), 2, 100)
    assert got == [("short", 0), ("short", 1), ("short", 0), ("short", 1)]


# plain versions, loop by loop -------------------------------------------------------------------
TEXTS = ["", "one", "a few plain words", "The Quick  brown fox\n\tjumps over " * 15, "é ünïcode wörds and 日本語 " * 20, "x" * 900, "word " * 33 + "last"]


def plain_quality(p, text):
    """One text's score, byte by byte and chunk by chunk."""
    b = text.encode()
    starts, at = [], 0
    while True:
        starts.append(max(0, min(at, len(b) - quality_model.CHUNK)))
        if at + quality_model.CHUNK >= len(b):
            break
        at += quality_model.STEP
    units = []
    for s in starts:
        chunk = b[s:s + quality_model.CHUNK]
        x = [0.0] * quality_model.FILTERS
        for i in range(len(chunk) - quality_model.WIDTH + 1):
            for f in range(quality_model.FILTERS):
                x[f] = max(x[f], sum(float(p["f"][j][chunk[i + j]][f]) for j in range(quality_model.WIDTH)))
        x.append(np.log1p(len(chunk)) / 6)
        units.append([np.tanh(sum(x[i] * float(p["m"][i][u]) for i in range(len(x))) + float(p["m0"][u])) for u in range(quality_model.UNITS)])
    n = quality_model.UNITS
    pooled = [sum(u[k] for u in units) / len(units) for k in range(n)] + [max(u[k] for u in units) for k in range(n)]
    return 1 / (1 + np.exp(-(sum(pooled[k] * float(p["o"][k]) for k in range(2 * n)) + float(p["o0"][0]))))


def test_quality_forward_equals_plain_version():
    p = quality_model.init(3)
    texts = TEXTS + ["ab " * 171, "ab " * 172 + "c", "long text " * 130]
    got = quality_model.Scorer(p)(*textbytes.text_buffer(pa.array(texts, pa.large_string())))
    assert np.allclose(got, [plain_quality(p, t) for t in texts], atol=1e-5)


def plain_toxicity(p, x):
    """Highest window probability of one text, given the input vector of each of its words."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, best = toxicity.HIDDEN, 0.0
    starts, at = [], 0
    while len(x):
        starts.append(max(0, min(at, len(x) - toxicity.WINDOW)))
        if at + toxicity.WINDOW >= len(x):
            break
        at += toxicity.STEP
    for s in starts:
        window = x[s:s + toxicity.WINDOW]
        states = {}
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                inp = window[t] @ p[f"w_{d}"] + p[f"b_{d}"]
                r, z = sig(inp[:h] + state @ p[f"g_{d}"][:, :h]), sig(inp[h:2 * h] + state @ p[f"g_{d}"][:, h:])
                state = (1 - z) * state + z * np.tanh(inp[2 * h:] + (r * state) @ p[f"c_{d}"])
                states[d, t] = state
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(window))]
        e = np.exp([np.tanh(b @ p["a"] + p["a0"]) @ p["v"] for b in both])
        best = max(best, float(sig(sum(w * b for w, b in zip(e / e.sum(), both)) @ p["o"] + p["o0"][0])))
    return best


def test_toxicity_forward_equals_plain_version(toxic_model):
    texts = TEXTS + [r[0] for r in labelled("toxic", (4, 2))[1][:12]]
    got = score(toxic_model, texts)
    for t, s in zip(texts, got):
        w = toxicity.Words(*textbytes.text_buffer(pa.array([t], pa.large_string())))
        x = toxicity._inputs(toxic_model, w)[w.ids].astype(np.float64) if len(w.ids) else np.zeros((0, 1))
        assert abs(plain_toxicity(toxic_model, x) - s) < 1e-4
