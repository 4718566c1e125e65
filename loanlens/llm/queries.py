"""The registered queries of this package and their DuckDB SQL.

``opN_<name>`` applies operator N with production parameters to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontam, lattice, licenses, line_dedup, mixing, neardup, periodic, quality_model, quality_rules, substring, toxicity, url_filter
from .labelled import fold
from .tables import read_documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ALNUM_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontam_sql(table: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM_WORDS}, []) AS w FROM {table}),
i AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0), unnest(range(1, len(w) - m + 2)) AS t(k)),
dw AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS s
       FROM d, (SELECT DISTINCT m FROM iw), unnest(range(1, greatest(1, len(w) - m + 2))) AS t(k)),
hit AS (SELECT DISTINCT doc_id, k, m, item_id FROM dw JOIN iw USING (m, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + m)) AS t(p) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_register("op1_decontamination", decontam_sql())
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(read_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)
_RULE_SQL = " OR ".join(f"({r.guard} >= {r.at_least} AND 100 * {r.part} {r.sign} {r.percent} * {r.whole})" for r in quality_rules.RULES)


@_register("op3_quality_rules", rf"""
WITH a AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {_SPACE_WORDS} AS w,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
win AS (SELECT r, k, array_to_string(w[k:k + 7], ' ') AS s FROM a, unnest(range(1, greatest(1, len(w) - 6))) AS t(k)),
rep AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM rep, unnest(range(k, k + 8)) AS t(p) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!?]+', '', 'g')) AS n_marks,
        len([x FOR x IN w IF lower(x) IN ({_STOP})]) AS n_stop_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_RULE_SQL}) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def mixing_sql(table: str = "documents", columns: str = "doc_id, size, source_size, target") -> str:
    ctes = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_SPACE_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM {table}),
s AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1)),
o AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
             sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
             1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT min_by((total - full_before) / w_left, 2 * source_size / w) FILTER (WHERE (total - full_before) / w_left * w <= 2 * source_size) AS level FROM o),
g AS (SELECT source, source_size, least(w * coalesce(level, 0), 2.0::DOUBLE * source_size) AS target FROM s, l),
b AS (SELECT doc_id, d.source AS source, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS e,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT {columns},
       CAST(e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - before)) AS BIGINT) AS taken FROM b
"""
    return ctes if table == "documents" else ctes.replace("\nWITH d AS", ", d AS", 1)  # after other tables


@_register("op4_mixing", mixing_sql())
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


_STRIP = f"translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"


def line_dedup_sql(table: str = "documents", kept: str = "sha256(coalesce(kept, '')) AS kept_sha256") -> str:
    return rf"""
WITH a AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM {table}),
x AS (SELECT r, k, l[k] AS x FROM a, unnest(range(1, len(l) + 1)) AS t(k)),
k AS (SELECT r, k, x, {_STRIP} AS key FROM x),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped, string_agg(CASE WHEN f.key IS NULL THEN x END, chr(10) ORDER BY k) AS kept
      FROM k LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, {kept} FROM a JOIN g USING (r)
"""


@_register("op9_line_dedup", line_dedup_sql())
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(read_documents(spark, sf_dir).select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def near_sql(table: str = "documents", size: int = 4, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {size - 1}], ' ') AS x FROM d, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM d JOIN r ON d.doc_id = r.node LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@_register("op10_minhash", near_sql())
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@_register("op5_substring_dedup", rf"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 11))) AS t(k)),
f AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS low FROM win) WHERE low < doc_id),
c AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(k, k + 13)) AS t(p)),
x AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
g AS (SELECT doc_id, count(c.p) AS n_removed, string_agg(CASE WHEN c.p IS NULL THEN x END, ' ' ORDER BY x.p) AS kept
      FROM x LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(read_documents(spark, sf_dir).select("doc_id", "text"), counts=("n_words", "n_removed"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _scored(scored: DataFrame, mod: int, held: int) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return _scored(toxicity.score(docs, model), 4, 2)


@_register("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


_CANON = r"trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))"
for _a, _b in licenses.SPELLINGS:
    _CANON = f"replace({_CANON}, '{_a}', '{_b}')"
_KNOWN = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.LICENSES)


def _canonical_sql(table: str, key: str) -> str:
    kept = r"[x FOR x IN string_split(coalesce(text, ''), chr(10)) IF NOT regexp_matches(x, '(?i)^\s*(copyright|\(c\)|©)')]"
    return f"SELECT {key}, [y FOR y IN [{_CANON} FOR x IN {kept}] IF y <> ''] AS l FROM {table}"


@_register("op7_license_scan", f"""
WITH lic(license_id, text) AS (VALUES {_KNOWN}),
k AS (SELECT DISTINCT license_id, l[1] AS first, len(l) AS n, sha256(array_to_string(l, ' ')) AS digest FROM ({_canonical_sql('lic', 'license_id')}) WHERE len(l) > 0),
d AS ({_canonical_sql('documents', 'doc_id')}),
r AS (SELECT doc_id, l, l[i] AS x, i FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
u AS (SELECT doc_id, sha256(array_to_string(l, ' ')) AS digest, true AS whole FROM d WHERE len(l) > 0
      UNION ALL SELECT doc_id, sha256(array_to_string(l[i:i + s.n - 1], ' ')), false FROM r JOIN (SELECT DISTINCT first, n FROM k) s ON r.x = s.first WHERE i + s.n - 1 <= len(l)),
f AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(DISTINCT license_id) AS n, bool_or(whole) AS whole
      FROM u JOIN k USING (digest) GROUP BY 1)
SELECT doc_id, CASE WHEN len(l) > 0 THEN sha256(array_to_string(l, ' ')) END AS text_digest, coalesce(ids, '') AS license_ids,
       CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(whole, false) AS whole
FROM d LEFT JOIN f USING (doc_id)
""")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


@_register("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = quality_model.fit(docs, _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return _scored(quality_model.score(docs, model), 5, 0)


_CRC32 = """xor(4294967295, list_reduce([4294967295] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


@_register("op13_periodic_runs", rf"""
WITH RECURSIVE a AS (SELECT doc_id, row_number() OVER () AS r, {_SPACE_WORDS} AS w, {_CRC32} AS h FROM documents),
b AS (SELECT doc_id, r, w, len(w) AS n, h, h // 10 AS g FROM a),
c AS (SELECT doc_id, r, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM b),
d AS (SELECT doc_id, r, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] END AS w FROM c),
x AS (SELECT r, i, w[i + 1] AS x FROM d, unnest(range(len(w))) AS t(i)),
nm(k, r, i, c) AS (SELECT 0, r, i, hash(x) FROM x UNION ALL
  SELECT k + 1, r, i, c FROM (SELECT u.k, u.r, u.i, hash(u.c, v.c) AS c FROM nm u JOIN nm v ON u.r = v.r AND v.i = u.i + (CAST(1 AS BIGINT) << u.k))
  QUALIFY count(*) OVER (PARTITION BY r, c) > 1),
s AS (SELECT k, r, lead(i) OVER z - i AS q, lead(i, 2) OVER z - lead(i) OVER z AS q2 FROM nm WINDOW z AS (PARTITION BY k, r, c ORDER BY i)),
can AS (SELECT DISTINCT r, q FROM s WHERE q = q2 AND q <= CAST(2 AS BIGINT) << k),
eq AS (SELECT can.r, q, u.i, u.i - row_number() OVER (PARTITION BY can.r, q ORDER BY u.i) AS island
       FROM can JOIN x u ON u.r = can.r JOIN x v ON v.r = can.r AND v.i = u.i + q WHERE u.x = v.x),
o AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM eq GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.r = o.r AND y.q < o.q AND y.s <= o.s AND y.s + y.l >= o.s + o.l)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l / q DESC, s, q) = 1),
t AS (SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + l)) AS t(i)),
kept AS (SELECT x.r, string_agg(x, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone ON gone.r = x.r AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.r)
SELECT doc_id, coalesce(t.n, 0) AS n_runs, best.s AS "start", best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(t.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(read_documents(spark, sf_dir), order=periodic.planted_order)
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("l"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.l) div (-best.q)").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_register("op12_embedding_dedup", """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, label, v FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN v IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(node, reach) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(reach) AS component_id, e.vec_id = min(reach) AS kept
FROM e JOIN r ON r.node = e.vec_id LEFT JOIN n ON n.vec_id = e.vec_id GROUP BY e.vec_id
""")
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicate_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


@_register("op11_hard_negatives", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER z AS INT) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n USING (a) WHERE NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
WINDOW z AS (PARTITION BY a, p.b ORDER BY n.s DESC, n.b) QUALIFY row_number() OVER z <= 3
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & finite).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return covertree.hard_negatives(rows, F.col("vec_id") % 50 == 0)
