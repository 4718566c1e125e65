"""Bounded, deterministic samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) rows of either label, taken in the order of a hash of the
    id among the labelled rows where ``train`` holds and the text has at most ``max_bytes``. The chosen ids (bounded) are broadcast, the
    documents are not shuffled. An id on many rows gives one text, the one of smallest hash, chosen before the rows reach the driver:
    2 * ``per_class`` rows of ``max_bytes`` at most."""
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    short = docs.where(F.octet_length("text") <= max_bytes).select("doc_id")
    known = known.join(short, "doc_id", "left_semi")  # ids only
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= max_bytes)
            .groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", "t.text").collect())
    return [(text, int(y)) for _, y, text in sorted(tuple(r) for r in rows)]
