"""Officer-note text features: lexicon stress index, embedding anchor contrast, tone, PCA.

The lexicon path is a pure Catalyst expression per row (substring counts by length
difference), so it runs inside whole-stage codegen over whole texts. The embedding path
works on an existing ``array<float>`` column; the two anchor vectors are means over the
anchor rows (one aggregate, 2 x dim numbers) carried into the projection as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import dot, l2_normalise, lexicon_count, sigmoid


def lexicon_hits(df: DataFrame, text: str, negative: Sequence[str] = K.LEXICON_NEGATIVE,
                 positive: Sequence[str] = K.LEXICON_POSITIVE) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("neg_hits", lexicon_count(low, negative)).withColumn("pos_hits", lexicon_count(low, positive))


def lexicon_stress(df: DataFrame, text: str, negative: Sequence[str] = K.LEXICON_NEGATIVE,
                   positive: Sequence[str] = K.LEXICON_POSITIVE, slope: float = K.LEXICON_SLOPE) -> DataFrame:
    """stress = sigmoid(slope * (negative hits - positive hits)); null text scores 0.5."""
    hits = lexicon_hits(df, text, negative, positive)
    net = F.col("neg_hits") - F.col("pos_hits")
    return hits.withColumn("net_hits", net).withColumn("stress_index", sigmoid(F.lit(slope) * net))


def note_tone(stress: Column | str, cuts: tuple[float, float] = K.NOTE_TONE_CUTS) -> Column:
    s = F.col(stress) if isinstance(stress, str) else stress
    return (F.when(s > cuts[0], F.lit("stressed")).when(s > cuts[1], F.lit("neutral"))
            .when(s.isNotNull(), F.lit("healthy")))


def anchor_pair(df: DataFrame, vec: str, label: str, stress_value, healthy_value) -> tuple[list[float], list[float]]:
    """Both anchor means (of L2-normalised vectors) in one pass: a vector aggregate per label, two rows collected."""
    unit = df.where(F.col(label).isin(stress_value, healthy_value)).select(label, array_to_vector(l2_normalise(vec)).alias("v"))
    means = {r[label]: r["m"].toArray().tolist() for r in unit.groupBy(label).agg(Summarizer.mean(F.col("v")).alias("m")).collect()}
    return means.get(stress_value, []), means.get(healthy_value, [])


def anchor_contrast(df: DataFrame, vec: str, stress_anchor: Sequence[float], healthy_anchor: Sequence[float],
                    scale: float = K.EMBEDDING_SCALE, name: str = "stress_index") -> DataFrame:
    """sigmoid(scale * (e . s - e . h)) with e the L2-normalised row vector."""
    s = F.array(*[F.lit(float(v)) for v in stress_anchor])
    h = F.array(*[F.lit(float(v)) for v in healthy_anchor])
    e = l2_normalise(vec)
    return df.withColumn(name, sigmoid(F.lit(scale) * (dot(e, s) - dot(e, h))))


def embedding_pca(df: DataFrame, vec: str, k: int = 2, prefix: str = "nlp_stress_flag_") -> DataFrame:
    """Mean-centred PCA to k components (component signs are arbitrary)."""
    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(centred)
    out = model.transform(centred).withColumn("_pcs", vector_to_array("_pc"))
    return out.select(*df.columns, *[F.col("_pcs")[i].alias(f"{prefix}{i + 1}") for i in range(k)])
