"""The queries of the dealt operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emporion.llm import bpe, exact_dedup, filter_audit, hnsw, mixing, quality_crf, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, topk, va_file
from emporion.llm.common import read_table

documents, embeddings, labels = read_table("documents"), read_table("embeddings"), read_table("labels")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_crf.quality_scores(docs, quality_crf.train(docs, labels(spark, sf_dir)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir), secret_scan.new_ledger(spark))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(embeddings(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))
    return steps.drop("filter")  # the letter at the step's place in the order


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.cluster(embeddings(spark, sf_dir))


def op13_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_exact_dedup, op2_bpe, op3_quality_crf, op4_simhash, op5_substring_dedup,
        op6_sharding, op7_secret_scan, op8_mixing, op9_suffix_dedup, op10_topk,
        op11_filter_audit, op12_va_clusters, op13_hnsw,
    ]
    return {f.__name__: f for f in own}


#: SHA-256 of UTF-8 bytes; DuckDB's regular expressions are RE2.
OP1 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents
), g AS (
  SELECT sha, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY sha
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.sha AS text_sha256
FROM n JOIN g USING (sha)
"""


#: Windows as joined words: words hold no space, so equal strings are equal windows.
OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), first AS (
  SELECT s, min(doc_id) AS first_id FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN first USING (s) WHERE first_id < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Whole numbers below 2^53 are exact as DOUBLE.
OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


#: Each document by the filters it fails; then every order, by counting within it.
OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), mark AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), least AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), doc AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), d.doc_id > first_id] AS fails
  FROM d JOIN least USING (t) LEFT JOIN mark ON d.doc_id = mark.doc_id
), kind AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM doc GROUP BY ALL
), letter AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), perm AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS f FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), step AS (
  SELECT f, unnest(range(1, 6)) AS step FROM perm
), seen AS (
  SELECT part, f, step, f[step] AS own, n, good, toxic, fails[f[step]] AS hit,
    len(list_filter(f[:step - 1], lambda i: fails[i])) > 0 AS before, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM kind, step
), counted AS (
  SELECT part, f, step, own, coalesce(sum(n) FILTER (NOT hit AND NOT before), 0) AS kept,
    coalesce(sum(n) FILTER (hit AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (hit AND before), 0) AS redundant,
    coalesce(sum(n) FILTER (hit AND alone), 0) AS unique_fails, coalesce(sum(n) FILTER (hit AND NOT before AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (hit AND NOT before AND toxic), 0) AS toxic_lost
  FROM seen GROUP BY part, f, step, own
)
SELECT part, array_to_string(list_transform(f, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

_NEAREST = """near{r} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT rid, m.c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - x[i]) * (v[i] - x[i]))) AS d FROM whole, mean{r} m
  ) GROUP BY rid
)"""
_MEANS = """sum{r} AS MATERIALIZED (
  SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM near{r} JOIN whole USING (rid)) GROUP BY c, i
), mean{next} AS MATERIALIZED (
  SELECT m.c, coalesce(new.x, m.x) AS x FROM mean{r} m LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM sum{r} GROUP BY c
  ) new ON m.c = new.c
)"""

#: The rounds one after the other; whole numbers throughout.
OP12 = (
    """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), mean0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS x FROM whole ORDER BY c LIMIT 8
), """
    + ", ".join(f"{_NEAREST.format(r=r)}, {_MEANS.format(r=r, next=r + 1)}" for r in range(10))
    + f", {_NEAREST.format(r=10)}"
    + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM near10 JOIN whole USING (rid) JOIN mean10 USING (c)
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1, "op5_substring_dedup": OP5, "op10_topk": OP10, "op11_filter_audit": OP11, "op12_va_clusters": OP12,
    }
