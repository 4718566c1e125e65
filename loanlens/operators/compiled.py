"""Trained models as column expressions.

A fitted tree is a nest of conditions, a boosted margin a weighted sum of them, an isotonic map a binary search
over its steps. Compiled, a model scores any number of altered rows (twelve scenario months, an upload, a
stream) in the projection that alters them: no vectors, no model transform, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import sigmoid


def tree_column(tree, features: Sequence[Column]) -> Column:
    """Value of the leaf that a row reaches; ``tree`` is one node table of ``attribution.tree_tables``."""
    feature, threshold, left, right, value, _ = tree

    def at(j: int) -> Column:
        if feature[j] < 0:
            return F.lit(float(value[j]))
        return F.when(features[feature[j]] <= F.lit(float(threshold[j])), at(left[j])).otherwise(at(right[j]))

    return at(0)


def margin_column(trees, weights: Sequence[float], features: Sequence[Column]) -> Column:
    """Margin of a boosted-tree classifier: the weighted sum of its trees."""
    out = F.lit(0.0)
    for tree, w in zip(trees, weights):
        out = out + F.lit(float(w)) * tree_column(tree, features)
    return out


def probability_column(margin: Column) -> Column:
    """P(label 1) of a classifier boosted on the log loss of twice the margin."""
    return sigmoid(2.0 * margin)


def isotonic_column(boundaries: Sequence[float], predictions: Sequence[float], x: Column) -> Column:
    """Isotonic map: linear between the two steps around ``x``, the edge value outside; null for null.

    The step is found by halving strides over the literal boundaries; index and value are bound once."""
    n = len(boundaries)
    if not n:
        return F.lit(None).cast("double")
    b, p = (F.array(*[F.lit(float(v)) for v in values]) for values in (boundaries, predictions))
    strides = [1 << k for k in range(max(n - 1, 1).bit_length() - 1, -1, -1)]

    def search(x: Column) -> Column:
        # 0-based index of the last boundary <= x, or 0
        return F.aggregate(F.array(*[F.lit(s) for s in strides]), F.lit(0),
                           lambda i, s: F.when((i + s < n) & (F.get(b, F.least(i + s, F.lit(n - 1))) <= x), i + s).otherwise(i))

    def value(s: Column) -> Column:
        x, i = s["x"], s["i"]
        lo, hi = F.get(b, i), F.get(b, i + 1)
        inside = F.get(p, i) + (F.get(p, i + 1) - F.get(p, i)) * (x - lo) / (hi - lo)
        return F.when(x.isNull(), F.lit(None)).when((x <= lo) | (i + 1 >= n), F.get(p, i)).otherwise(inside)

    bound = F.transform(F.array(x.cast("double")), lambda v: F.struct(v.alias("x"), search(v).alias("i")))
    return F.get(F.transform(bound, value), F.lit(0))
