"""Risk-driver attribution: additive per-feature impacts, top-k drivers, importance, narratives.

For the closed-form scorecard the attribution is exact: impact_i = w_i * z_i, and
sum_i impact_i + intercept equals the margin. Impacts are produced in long form
(borrower, feature, value, impact) by ``unpivot`` — a per-row Generate, no shuffle — and the
per-borrower top-k is a window partitioned by borrower (planned as WindowGroupLimit).
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import map_lookup


def linear_attribution(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                       weights: Mapping[str, float] = K.SCORECARD_WEIGHTS, key: str = "company_id",
                       eps: float = K.ZSCORE_EPS) -> DataFrame:
    feats = list(weights)
    values = df.select(key, *[F.col(f).cast("double").alias(f) for f in feats])
    long = values.unpivot([key], feats, "feature", "value")
    w = map_lookup("feature", {f: float(weights[f]) for f in feats})
    m = map_lookup("feature", {f: float(stats[f][0]) for f in feats})
    s = map_lookup("feature", {f: float(stats[f][1] or 0.0) for f in feats})
    return long.withColumn("impact", w * ((F.col("value") - m) / (s + F.lit(eps))))


def top_drivers(attr: DataFrame, k: int = K.DRIVERS_EXPLAIN, key: str = "company_id", places: int = 12) -> DataFrame:
    """k largest |impact| per borrower (ties by feature name)."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("impact"), places)), F.asc("feature"))
    return attr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def global_importance(attr: DataFrame) -> DataFrame:
    return attr.groupBy("feature").agg(F.avg(F.abs("impact")).alias("mean_abs_impact"))


def importance_head(importance: DataFrame, n: int) -> DataFrame:
    """The first ``n`` features by importance with their rank (ties by name); one row a feature, so the window is tiny."""
    w = Window.orderBy(F.desc(F.round("mean_abs_impact", 9)), F.asc("feature"))
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _num(v: Column, places: int) -> Column:
    """Fixed-point text of ``v`` rounded half-even to ``places`` decimals."""
    return F.bround(v, places).cast(f"decimal(18,{places})").cast("string")


_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "==": operator.eq}


def _grade(v: Column) -> Column:
    letter = map_lookup(F.bround(v, 0).cast("int"), {n: g for g, n in K.GRADE_MAP.items()})
    return F.coalesce(letter, F.lit("?"))


def narrative(feature: Column | str, value: Column | str,
              rules: Mapping[str, tuple] = K.NARRATIVES_MSME, places: int = 3) -> Column:
    """Plain-English driver sentence, dispatched on the feature name; other features are named with
    their value to ``places`` decimals. Null for a null value."""
    f = F.col(feature) if isinstance(feature, str) else feature
    v = F.col(value) if isinstance(value, str) else value
    out = None
    for name, (template, tiers, other) in rules.items():
        tier = None
        for op, bound, word in tiers:
            cond = _COMPARE[op](v, F.lit(bound))
            tier = F.when(cond, F.lit(word)) if tier is None else tier.when(cond, F.lit(word))
        if tier is not None:
            tier = F.when(v.isNotNull(), tier.otherwise(F.lit(other)))
        parts = []
        rest = template
        while rest:
            i = rest.find("{")
            if i < 0:
                parts.append(F.lit(rest))
                break
            if i:
                parts.append(F.lit(rest[:i]))
            j = rest.index("}", i)
            token = rest[i + 1:j]
            parts.append({"pct": lambda: _num(v * 100, 0), "v0": lambda: _num(v, 0), "v1": lambda: _num(v, 1), "v2": lambda: _num(v, 2),
                          "money": lambda: F.format_number(F.bround(v, 0), 0), "grade": lambda: _grade(v),
                          "int": lambda: v.cast("long").cast("string"), "tier": lambda: tier}[token]())
            rest = rest[j + 1:]
        text = F.concat(*parts)
        out = F.when(f == name, text) if out is None else out.when(f == name, text)
    return out.otherwise(F.concat(f, F.lit(": "), _num(v, places)))


def _ship_by_value() -> None:
    """Serialise this module's functions into the task closures (cloudpickle by value), so
    Python workers need no installed copy of the package."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tree_tables(spark, gbt_model, path: str):
    """Saved-model node tables of a fitted boosted-tree model: per tree, numpy arrays of split
    feature, threshold, children and node value, plus the tree weights. The model is written
    with ``save`` and its ``data`` folder read back (a bounded table: trees x nodes).

    A split of a 0/1 slot (one-hot level) names its left categories; it becomes the threshold 0.5, with its
    children exchanged where 1 goes left, so every split reads ``x <= threshold -> left``."""
    import numpy as np
    gbt_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.rawCount", F.col("nodeData.impurityStats").alias("stats"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"), F.col("nodeData.split.numCategories").alias("levels")).collect()
    weights = list(gbt_model.treeWeights)
    trees = []
    for t in range(len(weights)):
        rows = sorted((r for r in nodes if r["treeID"] == t), key=lambda r: r["id"])
        n = len(rows)
        feat = np.array([r["feature"] if r["leftChild"] >= 0 else -1 for r in rows], dtype=np.int64)
        thr = np.array([(r["thr"][0] if r["thr"] else 0.0) for r in rows], dtype=np.float64)
        left = np.array([r["leftChild"] for r in rows], dtype=np.int64)
        right = np.array([r["rightChild"] for r in rows], dtype=np.int64)
        for i, r in enumerate(rows):
            if r["leftChild"] >= 0 and r["levels"] >= 0:
                if r["levels"] != 2:
                    raise ValueError("a categorical split of more than two levels has no threshold")
                thr[i] = 0.5
                if list(r["thr"]) == [1.0]:
                    left[i], right[i] = right[i], left[i]
        value = np.array([r["prediction"] for r in rows], dtype=np.float64)
        cover = np.array([(r["stats"][0] if r["stats"] else float(r["rawCount"])) for r in rows], dtype=np.float64)
        assert n and rows[0]["id"] == 0
        trees.append((feat, thr, left, right, value, cover))
    return trees, weights


def tree_path_attribution(df: DataFrame, trees, weights, features: Sequence[str], key: str = "company_id") -> DataFrame:
    """Additive per-feature attribution for a boosted-tree margin (path attribution): along each
    tree's decision path, the change in node value at a split is credited to the split feature,
    weighted by the tree weight. base + sum of impacts equals the model margin exactly.

    Runs as ``mapInPandas`` over Arrow batches; the node tables (bounded by the model size)
    travel with the task closure. One output row per (row, feature)."""
    import numpy as np
    import pandas as pd

    feats = list(features)
    d = len(feats)
    _ship_by_value()

    def attribute(batches):
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=np.float64)
            n = len(pdf)
            phi = np.zeros((n, d))
            base = 0.0
            rows = np.arange(n)
            for (feat, thr, left, right, value, _cover), w in zip(trees, weights):
                base += w * value[0]
                idx = np.zeros(n, dtype=np.int64)
                while True:
                    f = feat[idx]
                    active = f >= 0
                    if not active.any():
                        break
                    r, i, fi = rows[active], idx[active], f[active]
                    child = np.where(x[r, fi] <= thr[i], left[i], right[i])
                    np.add.at(phi, (r, fi), w * (value[child] - value[i]))
                    idx[active] = child
            out = pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), d),
                                "feature": np.tile(np.array(feats, dtype=object), n),
                                "impact": phi.reshape(-1),
                                "base": base})
            yield out

    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, feature string, impact double, base double"
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in feats]).mapInPandas(attribute, schema)


def _tree_shap(x, tree, weight, phi):
    """Exact TreeSHAP of one tree (the polynomial-time path algorithm of Lundberg et al., 2018),
    vectorised over the rows of ``x``: the recursion visits every node once per tree and carries
    per-row arrays for the one-fractions and path weights. Adds ``weight`` x Shapley values to
    ``phi`` (rows x features)."""
    import numpy as np

    feat, thr, left, right, value, cover = tree
    n = x.shape[0]

    def extend(path, z, o, d):
        # path entries: [feature, zero_fraction (scalar), one_fraction (n,), pweight (n,)]
        l = len(path)
        new = [list(e[:3]) + [e[3].copy()] for e in path]
        new.append([d, z, o, np.ones(n) if l == 0 else np.zeros(n)])
        for i in range(l - 1, -1, -1):
            new[i + 1][3] = new[i + 1][3] + o * new[i][3] * (i + 1) / (l + 1)
            new[i][3] = z * new[i][3] * (l - i) / (l + 1)
        return new

    def unwind(path, k):
        l = len(path) - 1
        o, z = path[k][2], path[k][1]
        nxt = path[l][3].copy()
        ws = [e[3].copy() for e in path[:l]]
        nz = o != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(l - 1, -1, -1):
                a = nxt * (l + 1) / ((j + 1) * o)
                b = ws[j] * (l + 1) / (z * (l - j))
                nxt = np.where(nz, ws[j] - a * z * (l - j) / (l + 1), nxt)
                ws[j] = np.where(nz, a, b)
        meta = [e[:3] for e in path[:k]] + [e[:3] for e in path[k + 1:]]
        return [list(m) + [w] for m, w in zip(meta, ws)]

    def unwound_sum(path, k):
        l = len(path) - 1
        o, z = path[k][2], path[k][1]
        nxt = path[l][3].copy()
        total = np.zeros(n)
        nz = o != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(l - 1, -1, -1):
                a = nxt * (l + 1) / ((j + 1) * o)
                b = (path[j][3] / z) / ((l - j) / (l + 1))
                total = total + np.where(nz, a, b)
                nxt = np.where(nz, path[j][3] - a * z * (l - j) / (l + 1), nxt)
        return total

    def recurse(j, path, z, o, d):
        path = extend(path, z, o, d)
        if feat[j] < 0:
            for k in range(1, len(path)):
                wsum = unwound_sum(path, k)
                phi[:, path[k][0]] += weight * wsum * (path[k][2] - path[k][1]) * value[j]
            return
        f = feat[j]
        goes_left = x[:, f] <= thr[j]
        iz, io = 1.0, np.ones(n)
        k = next((i for i in range(1, len(path)) if path[i][0] == f), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = unwind(path, k)
        for child, hot in ((left[j], goes_left), (right[j], ~goes_left)):
            recurse(child, path, iz * cover[child] / cover[j], np.where(hot, io, 0.0), f)

    recurse(0, [], 1.0, np.ones(n), -1)


def _tree_shap_shared(x, tree, weight, phi):
    """``_tree_shap`` once for each way the rows of ``x`` answer the tree's splits: rows with the same answers have the
    same Shapley values, and a batch has few different ones."""
    import numpy as np

    feat, thr = tree[0], tree[1]
    inner = np.flatnonzero(feat >= 0)
    if not len(x) or len(inner) > 62:  # the answers are the bits of one number
        return _tree_shap(x, tree, weight, phi)
    answers = (x[:, feat[inner]] <= thr[inner]) @ (np.int64(1) << np.arange(len(inner), dtype=np.int64))
    _, first, same = np.unique(answers, return_index=True, return_inverse=True)
    part = np.zeros((len(first), x.shape[1]))
    _tree_shap(x[first], tree, weight, part)
    phi += part[same]


def tree_shap_values(df: DataFrame, trees, weights, features: Sequence[str], key: str) -> DataFrame:
    """Shapley values of a boosted-tree margin, one row per input row: the key, ``base``, and ``values`` and ``impacts``, arrays in
    the order of ``features``. Nothing is multiplied out, so rankings per row need no shuffle."""
    import numpy as np
    import pyarrow as pa

    feats = list(features)
    base = float(sum(w * t[4][0] for t, w in zip(trees, weights)))
    _ship_by_value()

    def run(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) if batch.num_rows else np.zeros((0, len(feats)))
            phi = np.zeros(x.shape)
            for tree, w in zip(trees, weights):
                _tree_shap_shared(x, tree, w, phi)
            at = pa.array(np.arange(0, phi.size + 1, len(feats), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.columns[0], pa.array(np.full(len(x), base)),
                                              *(pa.ListArray.from_arrays(at, pa.array(a.reshape(-1))) for a in (x, phi))],
                                             names=[key, "base", "values", "impacts"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in feats]).mapInArrow(run, f"{key} {kind}, base double, values array<double>, impacts array<double>")


def tree_shap_attribution(df: DataFrame, trees, weights, features: Sequence[str], key: str = "company_id") -> DataFrame:
    """Per-row, per-feature TreeSHAP values of a boosted-tree margin; ``base`` is the expected
    margin (cover-weighted), so base + sum of impacts equals the margin. Arrow batches via
    ``mapInPandas``; the node tables (bounded by the model size) travel with the task."""
    import numpy as np
    import pandas as pd

    feats = list(features)
    d = len(feats)
    base = float(sum(w * t[4][0] for t, w in zip(trees, weights)))
    _ship_by_value()

    def attribute(batches):
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=np.float64)
            n = len(pdf)
            phi = np.zeros((n, d))
            if n:
                for tree, w in zip(trees, weights):
                    _tree_shap_shared(x, tree, w, phi)
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), d),
                                "feature": np.tile(np.array(feats, dtype=object), n),
                                "impact": phi.reshape(-1), "base": base})

    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, feature string, impact double, base double"
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in feats]).mapInPandas(attribute, schema)
