"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Rules are (host, path) prefixes with a verdict; the longest that fits wins. URLs that a rule decides
are the labelled ones the trees learn from (a bounded sample of distinct URLs by hash, of either verdict); they judge every URL that
no rule fits. Features are Spark expressions of the URL alone: lengths, path depth, digit and
hyphen ratios, entropy of the host's characters, query parameters, and statistics of the host's suffix
(rows and share blocked among the labelled URLs, for the last one and the last two labels).

The suffix statistics cover all labelled URLs; they are an aggregate joined by key. Scoring is a
projection of the fitted tree model.

Cases: a null URL or one without "://" has an empty host and path; duplicate rows are judged alike; without
labelled URLs of both verdicts the trees are not fitted and undecided URLs are allowed; an empty table
gives no rows; columns besides ``url`` pass through under their own names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

# Fixed rules: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAMPLE_ROWS = 20_000
TREES, DEPTH = 20, 4
FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digits", "hyphens", "entropy", "params", "fragment", "secure",
            "suffix1_rows", "suffix1_block", "suffix2_rows", "suffix2_block")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(h: Column, p: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    found = None
    for rh, rp, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        got = F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, got) if found is None else found.when(fits, got)
    return found


def _entropy(s: Column) -> Column:
    chars = F.filter(F.split(s, ""), lambda x: x != "")
    counts = F.transform(F.array_distinct(chars), lambda x: (F.length(s) - F.length(F.replace(s, x, F.lit("")))).cast("double") / F.length(s))
    return F.aggregate(counts, F.lit(0.0), lambda a, q: a - q * F.log2(q))


def lexical(df: DataFrame) -> DataFrame:
    """Adds _host, _path, _rule, the suffix keys and the lexical features."""
    u = F.coalesce(F.col("url"), F.lit(""))
    df = df.withColumn("_host", host(F.col("url"))).withColumn("_path", path(F.col("url")))
    h, p = F.col("_host"), F.col("_path")
    length = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return (df.withColumn("_rule", fitting_rule(h, p))
            .withColumn("_suffix1", F.substring_index(h, ".", -1)).withColumn("_suffix2", F.substring_index(h, ".", -2))
            .withColumn("url_len", F.length(u).cast("double")).withColumn("host_len", F.length(h).cast("double"))
            .withColumn("path_len", F.length(p).cast("double")).withColumn("depth", F.size(F.split(p, "/")).cast("double"))
            .withColumn("labels", F.size(F.split(h, r"\.")).cast("double"))
            .withColumn("digits", F.length(F.regexp_replace(u, "[^0-9]", "")) / length)
            .withColumn("hyphens", F.length(F.regexp_replace(u, "[^-_]", "")) / length)
            .withColumn("entropy", _entropy(h))
            .withColumn("params", F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")))
            .withColumn("fragment", u.contains("#").cast("double")).withColumn("secure", u.startswith("https:").cast("double")))


def _fitting_sample(labelled: DataFrame, known: DataFrame, sample_rows: int) -> DataFrame:
    """Distinct URLs, at most half of ``sample_rows`` of either verdict in the order of their hash, with
    the features, and as weight the URL's rows, scaled so that a verdict weighs as much as all its rows."""
    h = F.xxhash64("url").alias("_h")
    counts = known.groupBy("label", h).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    chosen = None
    for y in (0.0, 1.0):
        part = counts.where(F.col("label") == y).orderBy("_h").limit(max(1, sample_rows // 2))
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = labelled.withColumn("_h", h).join(F.broadcast(chosen), ["label", "_h"])
    fit = cut(rows.groupBy("label", "_h", "_weight").agg(*[F.first(c).alias(c) for c in FEATURES]).coalesce(1).sortWithinPartitions("_h"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.sum("_weight").alias("n")).collect()}
    share = {y: total[y] / n for y, n in taken.items()}
    return fit.withColumn("_weight", F.col("_weight") * F.when(F.col("label") == 1, share.get(1.0, 1.0)).otherwise(share.get(0.0, 1.0)))


def judge(pages: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows with host, path, rule and verdict, and ``score``, the trees' probability of a block."""
    columns = pages.columns
    # neutral names, so that no column clashes with a feature
    plain = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], "url")
    rows = cut(lexical(plain.withColumn("url", F.col("url").cast("string"))))
    known = rows.where(F.col("_rule").isNotNull()).withColumn("label", (F.col("_rule.verdict") == "block").cast("double"))
    out = rows
    for k in ("1", "2"):
        stats = known.groupBy(f"_suffix{k}").agg(F.count(F.lit(1)).cast("double").alias(f"suffix{k}_rows"), F.avg("label").alias(f"suffix{k}_block"))
        out = out.join(stats, f"_suffix{k}", "left").fillna(0.0, [f"suffix{k}_rows"]).fillna(0.5, [f"suffix{k}_block"])
    fit = _fitting_sample(out.where(F.col("_rule").isNotNull()).withColumn("label", (F.col("_rule.verdict") == "block").cast("double")), known, sample_rows)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    out = assemble.transform(out)
    if fit.select("label").distinct().count() == 2:
        model = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, seed=5).fit(assemble.transform(fit))
        score = vector_to_array("probability")[1]
        out = model.transform(out).withColumn("_score", score)
    else:
        out = out.withColumn("_score", F.lit(0.0))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)], F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_score").alias("score"))
