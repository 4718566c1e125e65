"""Embedding operators and periodic runs against brute force on small, awkward tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import covertree, lattice, periodic, queries

from .helpers import AWKWARD, corpus, make, words

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, [1.0] * 8), (9002, 1, None), (9003, 1, [1.0, None] + [0.0] * 6), (9004, 1, [NAN] + [1.0] * 7), (9005, 1, [INF] + [1.0] * 7),
       (9006, 1, [0.0] * 8), (9007, 1, []), (None, 1, [1.0] * 8), (9008, 1, [1.0, 2.0])]


def cloud(seed=0, n=300, dim=8):
    """Random vectors, near copies around some of them, and equal vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = []
    for i in range(n):
        v = base[i]
        if i % 3 == 0:
            v = base[i % 9] + 0.08 * rng.normal(size=dim)
        elif i % 7 == 0:
            v = base[0]
        rows.append((int(i), int(i % 4 if i % 3 else 1), [float(x) for x in v.astype(np.float32)]))
    return rows


def table(spark, rows, kind="long", vector="array<float>"):
    return spark.createDataFrame(rows, f"vec_id {kind}, label int, embedding {vector}").repartition(3)


# 12 --------------------------------------------------------------------------------------------
def test_e8_decoding():
    roots = lattice.shortest_vectors()
    assert len({tuple(v) for v in roots}) == 240 and np.allclose((roots ** 2).sum(axis=1), 2)
    x = np.random.default_rng(1).normal(scale=2, size=(500, 8))
    c = lattice.nearest_e8(x)
    twice = np.rint(2 * c).astype(int)
    assert np.all((twice % 2 == twice[:, :1] % 2)) and np.all(twice.sum(axis=1) % 4 == 0)  # lattice points
    away = ((x - c) ** 2).sum(axis=1)
    assert away.max() <= 1 + 1e-9  # covering radius
    for v in roots:  # no neighbour is nearer
        assert np.all(((x - c - v) ** 2).sum(axis=1) >= away - 1e-9)


def brute_links(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])]
    links, comp = {i: 0 for i in range(len(ok))}, {r[0]: r[0] for r in ok}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    unit = [np.array(r[2]) / np.linalg.norm(r[2]) for r in ok]
    for i in range(len(ok)):
        for j in range(i):
            if ok[i][1] == ok[j][1] and len(ok[i][2]) == len(ok[j][2]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(ok[i][0]), find(ok[j][0])
                comp[max(a, b)] = min(a, b)
    out = [(r[0], links[i], find(r[0])) for i, r in enumerate(ok)]
    return out + [(r[0], 0, r[0]) for r in rows if r not in ok]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("chunk", [lattice.CHUNK, 16])
def test_lattice_links(spark, chunk):
    rows = cloud() + ODD + [cloud()[3], cloud()[3]]  # repeated rows
    got = lattice.near_duplicate_vectors(table(spark, rows).withColumn("id", F.lit(1)), chunk=chunk).collect()
    want = brute_links(rows, 0.98)
    exact = order([(r["vec_id"], r["n_links"], r["component_id"]) for r in got])
    assert len(exact) == len(want) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    agree = sum(a == b for a, b in zip(exact, order(want)))
    assert sum(x[1] for x in want) > 2000 and agree >= 0.97 * len(want)
    assert all(a[1] <= b[1] for a, b in zip(exact, order(want)))  # no link below the threshold


def test_lattice_recall(spark):
    """Pairs at a cosine of 0.98 to 0.995, each pair apart from all others, in 64 components."""
    rng, rows = np.random.default_rng(5), []
    for i in range(400):
        a, z = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        z -= (z @ a) * a
        c = 0.9801 + 0.0149 * i / 400
        rows += [(2 * i, 1, a.tolist()), (2 * i + 1, 1, (c * a + math.sqrt(1 - c * c) * z / np.linalg.norm(z)).tolist())]
    got = lattice.near_duplicate_vectors(table(spark, rows, vector="array<double>")).where("n_links = 1").count()
    assert got >= 0.95 * len(rows)


def test_lattice_other_ids_and_empty(spark):
    rows = [(str(r[0]), *r[1:]) for r in cloud(n=60)]
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicate_vectors(table(spark, rows, "string")).collect()}
    assert got == {str(r[0]): r[1] for r in brute_links(cloud(n=60), 0.98)}
    assert lattice.near_duplicate_vectors(table(spark, [])).count() == 0


def test_lattice_hot_vector(spark):
    rows = spark.range(30_000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.expr("array(1f, 2f, cast(id % 2 as float) / 1000)").alias("embedding"))
    got = lattice.near_duplicate_vectors(rows)
    assert [tuple(r) for r in got.groupBy("n_links", "component_id").count().collect()] == [(29_999, 0, 30_000)]


# 11 --------------------------------------------------------------------------------------------
def brute_negatives(rows, anchors, n_pos=5, n_neg=3, low=50, high=95):
    once = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v and (i not in once or (label, v) < once[i]):
            once[i] = (label, v)
    out = []
    for a in anchors:
        if a not in once:
            continue
        label, q = once[a]
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in once.items() if len(v) == len(q)}
        rank = sorted((-s, i) for i, s in score.items())
        for s, p in [(-s, i) for s, i in rank if i != a and once[i][0] == label][:n_pos]:
            inside = [(i, -t) for t, i in rank if once[i][0] != label and low * s <= -100 * t <= high * s][:n_neg]
            out += [(a, p, k + 1, i, s, t) for k, (i, t) in enumerate(inside)]
    return sorted(out)


def integer_rows(seed=2, n=700, dim=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.randint(-40, 60) for _ in range(dim)]
        if i % 5 == 0:
            v = [7, 7, 7, 7, 7, i % 3]  # a large group of copies, with ties
        rows.append((i, i % 4, v))
    return rows + [(7001, None, [1] * dim), (7002, 1, None), (7003, 1, [1, None]), (None, 1, [1] * dim), (3, 1, [50] * dim), (7004, 2, [3, 4]), (7005, 3, [4, 4]),
                   (7006, 2, [5, 5]), (7007, 1, []), (7008, 2, [0] * dim), (7009, 2, [2 ** 30] * dim)]


@pytest.mark.parametrize("block", [covertree.BLOCK, 50])
def test_cover_tree_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    if block == 50:  # many trees, several blocks of anchors
        monkeypatch.setattr(covertree, "LEAF", 4)
        monkeypatch.setattr(covertree, "ANCHOR_BYTES", 8000)
    rows = integer_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").repartition(3).withColumn("id", F.lit(0)).withColumn("v", F.lit(""))
    got = covertree.hard_negatives(df, (F.col("vec_id") % 20 == 0) | F.col("vec_id").isin(3, 7004, 7007, 7008))
    chosen = {r[0] for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] in (3, 7004, 7007, 7008))}
    want = brute_negatives([r for r in rows if r[0] != 7009], sorted(chosen))  # 7009 is too long to be exact
    assert want == sorted(tuple(r) for r in got.collect()) and want


def test_cover_tree_covers():
    x = np.random.default_rng(3).normal(size=(900, 5))
    x[300:600] = x[0]
    u = covertree.on_sphere(x, float(np.sqrt((x * x).sum(axis=1).max())))
    order, t = covertree.cover_tree(u, leaf=20)
    assert sorted(order) == list(range(900))
    for i, (b, e, c, r) in enumerate(zip(t["begin"], t["end"], t["centre"], t["radius"])):
        assert np.arccos(np.clip(u[order[b:e]] @ u[c], -1, 1)).max() <= r + 1e-6  # covering
        kids = [k for k, p in enumerate(t["parent"]) if p == i]
        assert t["leaf"][i] == (not kids)
        if kids:  # children share out the rows; the centre is a child's centre again
            assert sorted((t["begin"][k], t["end"][k]) for k in kids)[0][0] == b and sum(t["end"][k] - t["begin"][k] for k in kids) == e - b
            assert c in [t["centre"][k] for k in kids]


def test_cover_tree_other_ids_and_empty(spark):
    rows = [(f"{r[0]:05d}", *r[1:]) for r in integer_rows(n=200)[:200]]
    df = spark.createDataFrame(rows, "vec_id string, label int, vector array<int>")
    got = covertree.hard_negatives(df, F.col("vec_id").endswith("0"))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, [r[0] for r in rows if r[0].endswith("0")])
    assert covertree.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert covertree.hard_negatives(df, F.lit(False)).count() == 0


def test_hard_negative_query_on_odd_rows(spark, tmp_path):
    rows = [(i, l, v) for i, l, v in cloud(n=200)] + [r for r in ODD if len(r[2] or [0] * 8) == 8]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    got = queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(good, [r[0] for r in good if r[0] % 50 == 0])


# 13 --------------------------------------------------------------------------------------------
def brute_runs(w, least=6, exponent=4):
    out = {}
    for q in range(1, len(w) // exponent + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(least, exponent * q) and not any(a <= s and a + n >= e + q for a, n, _ in out):
                out[s, e + q - s, q] = True
            s = max(e, s) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed=4):
    rng, out = random.Random(seed), []
    for k in range(150):
        w = []
        while len(w) < rng.randint(0, 120):
            word = [rng.choice("abc"[:1 + k % 3]) + "é" * (k % 2) for _ in range(rng.randint(1, 9))]
            w += word * rng.randint(1, 7) + word[:rng.randint(0, len(word))]
        out.append((k, rng.choice([" ", "\n", " \t"]).join(w)))
    a, b = "a", "a b"  # Fibonacci words hold many squares, few runs of four periods
    for _ in range(9):
        a, b = b, f"{b} {a}"
    return out + [(900, b), (901, ("x y z " * 4000).strip()), (902, "p q " * 50 + "r " * 50 + "p q " * 50)]


def test_runs_equal_brute_force(spark):
    rows = repetitive() + corpus() + [r + (None,) * 2 for r in AWKWARD if len(r[1] or "") < 20_000]
    got = periodic.find_runs(make(spark, [r[:2] for r in rows])).collect()
    seen = sorted(((r["doc_id"] is None, r["doc_id"] or 0), [tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"]) for r in got)
    want = []
    for r in rows:
        w = words(r[1])
        runs = brute_runs(w)
        want.append(((r[0] is None, r[0] or 0), runs, len(w), brute_collapse(w, runs)))
    assert seen == sorted(want) and sum(len(r[1]) for r in want) > 150


def test_runs_of_long_texts_ids_and_empty(spark):
    docs = make(spark, [r for r in AWKWARD if len(r[1] or "") > 20_000]).select(F.col("doc_id").cast("string").alias("key"), "text", F.lit(1).alias("runs"))
    got = {r["key"]: ([tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"][:10]) for r in periodic.find_runs(docs, id_column="key").collect()}
    assert got == {"1005": ([(0, 30_000, 1)], 30_000, "long"), "1006": ([], 1, "x" * 10)}
    assert periodic.find_runs(docs.limit(0), id_column="key").count() == 0


def test_planted_query(spark, tmp_path):
    import zlib
    rows = [(i, t) for i, (_, t, *_) in enumerate(repetitive() + corpus())]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect():
        w = words(rows[r["doc_id"]][1])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapse(w, runs).encode()).hexdigest()
