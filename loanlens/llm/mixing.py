"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key (MD5 of its id and of its text's MD5, so rows without an id, or with the
same one, are spread by their texts). Within a source the keys are cut into
about sqrt(rows) ranges; range totals are prefix-summed, and a window inside each range completes
the running sum of words in key order. A source that holds a third of all rows is spread over as
many tasks as it has ranges. The cut is the source's exact budget: whole epochs first, then documents
in key order, the last one in part.

Targets: sources in code-point order (null last) take the weights in turn; a source stops at
``max_epochs`` times its size and its excess goes to the others by weight, until none is above.
One aggregate over the per-source totals per step; only four scalars reach the driver.

Cases: null text has size 0, a null source is a source of its own; rows equal in id and text are alike and stand
together, those of a large group of them at the cut in any order; very long texts are only counted; extra columns are ignored; an empty table gives no rows; if all sizes are 0 nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_sources(totals: DataFrame) -> DataFrame:
    """0, 1, 2, ... over the sources by code point, null last: a distributed sort, then the counts
    of the sorted partitions give each its first number."""
    at = cut(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row per sorted partition
    first = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return at.withColumn("_part", part).join(first, "_part").withColumn("number", F.col("_first") + place).drop("_part", "_first", "_at")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, ...) -> the same with weight and target."""
    weighted = cut(numbered_sources(totals).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))))
    most = (F.col("source_size") * max_epochs).cast("double")
    level, capped = float("inf"), None
    total = share * float(weighted.agg(F.sum("source_size")).first()[0] or 0)
    above = F.lit(False)
    while True:
        row = weighted.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, most)).alias("full"),
                           F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (total - (row["full"] or 0.0)) / row["w"]
        above = F.col("weight") * F.lit(level) > most
    return weighted.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (whole repeats) and
    taken (words taken, repeats counted)."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    totals = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    plan = targets(totals, weights, share, max_epochs)
    ranges = F.greatest(F.lit(1), F.ceil(F.sqrt("n"))).cast("long")
    per_source = cut(plan.select(F.col("source").alias("_source"), "source_size", "target", ranges.alias("ranges")))
    # order-preserving: the first 32 bits of the key as a fraction of the ranges
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = (rows.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("range", F.shiftright(head * F.col("ranges"), 32)))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("_sum"))
    offsets = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"),
                          (F.sum("_sum").over(Window.partitionBy("source").orderBy("range")) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    located = ranged.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    before = F.col("_offset") + F.sum("size").over(inside) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    return (located.withColumn("before", before).withColumn("epochs", epochs)
            .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
            .select("doc_id", "source", "size", "source_size", "target", "epochs", "taken"))
