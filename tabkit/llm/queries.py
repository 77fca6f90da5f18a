"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import centroids, decontaminate, language_id, line_dedup, mixing, pq_dedup, quality_rules, sharding, simhash, suffix_dedup, token_alignment, token_counts, toxicity
from tabkit.llm.common import numbered, table


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = numbered(table(spark, folder, "documents").select("doc_id", "text"))
    return suffix_dedup.repeated_bytes(docs).drop("__row", "kept")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return language_id.languages(pages, table(spark, folder, "documents").select("lang", "text"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("source", mixing.words().alias("size"), "doc_id")
    return mixing.plan_mix(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.scores(docs, toxicity.train_on(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = numbered(table(spark, folder, "documents").select("doc_id", "text"))
    return decontaminate.contamination(docs, table(spark, folder, "benchmark").select("item_id", "text")).drop("__row")


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.plan_shards(sharding.keyed(table(spark, folder, "documents"), "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    pages = numbered(table(spark, folder, "pages").select("page_id", "url", "html"))
    cleaned = line_dedup.drop_boilerplate(pages)
    return cleaned.select("page_id", "n_lines", "n_removed", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def op9_pq_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return pq_dedup.near_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(token_counts.MODEL))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))[0]


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    paths = public_tokenizers.path(token_alignment.BYTE_BPE), public_tokenizers.path(token_alignment.PIECE_BPE)
    return token_alignment.alignment_summary(docs, *paths)


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.judged(docs, table(spark, folder, "labels")).drop("anomaly")


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_language_id, op3_simhash, op4_mixing, op5_toxicity, op6_decontaminate, op7_sharding, op8_line_dedup,
    op9_pq_dedup, op10_token_counts, op11_centroids, op12_token_alignment, op13_quality_rules,
)}
#: One window per start, the windows of items found in documents by join, hit positions counted once.
#: Near items: every term that stands near its offset votes for a start of its window.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS k FROM starts
), sizes AS (SELECT DISTINCT n FROM win),
ends AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n
), hit AS (
  SELECT doc_id, item_id, s, ends.n FROM ends JOIN win ON ends.n = win.n AND array_to_string(w[s : s + ends.n - 1], ' ') = k
), places AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit
), hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
), cut AS (
  SELECT DISTINCT array_to_string(w[s : s + 12], ' ') AS k, w[s : s + 12] AS v FROM starts
), parts AS (
  SELECT k, greatest(len(v) - 1, 1) AS n, off, array_to_string(v[off + 1 : off + 2], ' ') AS term
  FROM (SELECT k, v, unnest(generate_series(0, greatest(len(v) - 2, 0))) AS off FROM cut)
), posted AS (
  SELECT doc_id, p, array_to_string(w[p : p + 1], ' ') AS term
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS p FROM d)
  UNION ALL SELECT doc_id, p, w[p] FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)
), votes AS (
  SELECT doc_id, k, n, off, p - off AS base FROM posted JOIN parts USING (term)
), near AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, k, n, off, base + s AS base FROM votes, (SELECT unnest([-1, 0, 1]) AS s)
  ) GROUP BY doc_id, k, n, base HAVING count(DISTINCT off) >= n - n // 4
), near_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN win USING (k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

#: Every byte start as hexadecimal text; starts whose 400 bytes occur twice cover bytes, the rest is kept.
OP1_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), s AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k
  FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2 - 400)) AS i FROM d WHERE length(h) >= 800)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1
), runs AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM rep
), spans AS (
  SELECT r, min(i) AS lo, max(i) + 400 AS hi
  FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM runs) GROUP BY r, g
), edges AS (
  SELECT r, hi AS lo, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS hi FROM spans
  UNION ALL SELECT r, 0, min(lo) FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h) // 2) - lo)), '' ORDER BY lo) AS left_over
  FROM edges JOIN d USING (r) GROUP BY r
), cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""

#: Exact distinct sites per line, then the lines that are left of each page.
OP8_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS site,
    list_filter(regexp_split_to_array(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), '[\\r\\n]+'),
      lambda x: x <> '') AS lines FROM pages
), l AS (
  SELECT r, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM p
), bad AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT site) >= 10),
kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM l ANTI JOIN bad USING (line) GROUP BY r
)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM p LEFT JOIN kept USING (r)
"""



def _op11_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS, seed: int = centroids.SEED) -> str:
    """Plain rounds: every vector against every centroid, ties to the smaller number, sums divided and rounded down."""
    name = f"sha256('{seed}:' || vec_id)"
    parts = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({centroids.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {centroids.WIDTH}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {centroids.WIDTH}
), c0 AS MATERIALIZED (
  SELECT n - 1 AS k, x AS c FROM (SELECT x, row_number() OVER (ORDER BY {name}, x) AS n FROM v) WHERE n <= {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, x, k, d FROM (
    SELECT r, vec_id, x, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS place FROM (
      SELECT r, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM v, c{i}
    )) WHERE place = 1
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(moved.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
      SELECT k, j, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY k, j
    ) GROUP BY k
  ) AS moved USING (k)
)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLE = {"op11_centroids": _op11_sql(), "op1_suffix_dedup": OP1_SQL, "op6_decontaminate": OP6_SQL, "op8_line_dedup": OP8_SQL}
