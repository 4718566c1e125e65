"""Registered text and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import metrics as MT
from ..operators import text as TX
from ..operators.portfolio import round_doubles
from ..sources import tables as TB
from ..sources import views as V
from . import sql_views as S
from .registry import register

NEG, POS = K.FIXTURE_LEXICON_NEGATIVE, K.FIXTURE_LEXICON_POSITIVE


def _count_sql(text: str, terms) -> str:
    return " + ".join(f"CAST((length({text}) - length(replace({text}, '{w}', ''))) / {len(w)} AS BIGINT)" for w in terms)


NOTES = f"""
v_notes AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
nl AS (SELECT doc_id, lang, quality, toxic, lower(coalesce(text, '')) AS t FROM v_notes),
nh AS (SELECT doc_id, lang, quality, toxic, {_count_sql('t', NEG)} AS neg_hits, {_count_sql('t', POS)} AS pos_hits FROM nl),
ns AS (SELECT *, neg_hits - pos_hits AS net_hits, {S.sigmoid(f'{K.LEXICON_SLOPE} * (neg_hits - pos_hits)')} AS stress_index FROM nh)"""


def tsql(body: str) -> str:
    return S.with_views(NOTES, body=body)


def stressed_notes(spark, sf):
    return TX.lexicon_stress(V.notes(spark, sf), "text", NEG, POS)


@register("lexicon_counts", tsql("SELECT doc_id, neg_hits, pos_hits FROM nh"))
def q_lexicon_counts(spark, sf):
    return TX.lexicon_hits(V.notes(spark, sf), "text", NEG, POS).select("doc_id", "neg_hits", "pos_hits")


@register("lexicon_stress", tsql("SELECT doc_id, net_hits, round(stress_index, 6) AS stress_index FROM ns"))
def q_lexicon_stress(spark, sf):
    return round_doubles(stressed_notes(spark, sf).select("doc_id", "net_hits", "stress_index"))


@register("note_tone", tsql("""
SELECT doc_id, CASE WHEN stress_index > 0.66 THEN 'stressed' WHEN stress_index > 0.40 THEN 'neutral'
                    WHEN stress_index IS NOT NULL THEN 'healthy' END AS tone FROM ns"""))
def q_note_tone(spark, sf):
    return stressed_notes(spark, sf).select("doc_id", TX.note_tone("stress_index").alias("tone"))


@register("feature_auc", tsql("""
SELECT model, round(CAST(sum(pos * (neg_below + neg / 2.0)) AS DOUBLE) / CAST(max("P") * max("N") AS DOUBLE), 6) AS roc_auc
FROM (
  SELECT model, prob, pos, neg, sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N",
         coalesce(sum(neg) OVER (PARTITION BY model ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT model, prob, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
        FROM (SELECT 'stress_vs_toxic' AS model, toxic AS y_true, round(stress_index, 6) AS prob FROM ns WHERE toxic IS NOT NULL
              UNION ALL
              SELECT 'net_hits_vs_low_quality', 1 - quality, CAST(net_hits AS DOUBLE) FROM ns WHERE quality IS NOT NULL)
        GROUP BY model, prob))
GROUP BY model"""))
def q_feature_auc(spark, sf):
    n = stressed_notes(spark, sf)
    a = n.where(F.col("toxic").isNotNull()).select(F.lit("stress_vs_toxic").alias("model"), F.col("doc_id").alias("id"),
                                                  F.col("toxic").alias("y_true"), F.round("stress_index", 6).alias("prob"))
    b = n.where(F.col("quality").isNotNull()).select(F.lit("net_hits_vs_low_quality").alias("model"),
                                                    F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("y_true"),
                                                    F.col("net_hits").cast("double").alias("prob"))
    return round_doubles(MT.roc_auc(a.unionByName(b)))


EMBED = """
en AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
en2 AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS nrm FROM en),
enn AS (SELECT vec_id, label, list_transform(e, lambda x: x / nrm) AS v FROM en2),
anch AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM enn WHERE label IN (0, 1)) GROUP BY label, i),
av AS (SELECT list(m ORDER BY i) FILTER (WHERE label = 0) AS s, list(m ORDER BY i) FILTER (WHERE label = 1) AS h FROM anch)"""


@register("anchor_contrast", S.with_views(EMBED, body=f"""
SELECT vec_id, label, round({S.sigmoid(f'{K.EMBEDDING_SCALE} * (list_dot_product(v, s) - list_dot_product(v, h))')}, 6) AS stress_index
FROM enn CROSS JOIN av"""))
def q_anchor_contrast(spark, sf):
    emb = TB.read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    s, h = TX.anchor_pair(emb, "embedding", "label", 0, 1)
    out = TX.anchor_contrast(emb, "embedding", s, h).select("vec_id", "label", "stress_index")
    return round_doubles(out)


@register("embedding_pca")
def q_embedding_pca(spark, sf):
    emb = TB.read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return TX.embedding_pca(emb, "embedding").select("vec_id", "label", "nlp_stress_flag_1", "nlp_stress_flag_2")
