"""Registered corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op6_quality_rules")
def op6(spark, sf_dir):
    from dqflow.llm.quality import COUNTS, quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "d2")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM s),
v AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM v),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM p
"""


@query("op9_mix_sources", MIX_SQL)
def op9(spark, sf_dir):
    from dqflow.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_url_filter")
def op10(spark, sf_dir):
    from dqflow.llm.urls import filter_urls, labelled_urls

    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "probability")


@query("op7_secret_scan")
def op7(spark, sf_dir):
    from dqflow.llm.secrets import digest, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns(digest(found)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("_spans").alias("spans"))


@query("op8_license_scan")
def op8(spark, sf_dir):
    from dqflow.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
x AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM p) AS l, unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT x.doc_id, x.i, x.n, p.item FROM x JOIN p ON x.n = p.n AND x.win = p.win),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(g.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(g.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""


@query("op4_decontaminate", LEAK_SQL)
def op4(spark, sf_dir):
    from dqflow.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op2_private_data")
def op2(spark, sf_dir):
    from dqflow.llm.pii import digest, find_private

    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns(digest()).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("_spans").alias("spans"))


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 5 * count(*) >= 4 * (nx.n + ny.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS doc_id, c.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links FROM c LEFT JOIN k ON c.a = k.a
"""


@query("op3_jaccard_join", NEAR_SQL)
def op3(spark, sf_dir):
    from dqflow.llm.near import near_classes

    return near_classes(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "class_id", "n_links")


@query("op5_language_model")
def op5(spark, sf_dir):
    from dqflow.llm.hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    from dqflow.llm.suffixes import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cluster_sql(k=8, rounds=10) -> str:
    """Every round as one pair of views: the nearest centroid of each vector, then the moved centroids."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, v AS m FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, v.v, c, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.v, m)]) AS BIGINT) AS d FROM v, c{r})
  GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(s ORDER BY i) AS m FROM (
      SELECT c, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS s FROM a{r}, range(1, 65) AS t(i) GROUP BY c, i)
    GROUP BY c) AS n ON n.c = c{r}.c)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.c = c.c"""


@query("op11_centroid_clusters", cluster_sql())
def op11(spark, sf_dir):
    from dqflow.llm.bitplanes import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("_id", "vec_id")


COPIES_SQL = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


@query("op12_exact_duplicates", COPIES_SQL)
def op12(spark, sf_dir):
    from dqflow.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def codes_sql(entries=256, rounds=4, width=16) -> str:
    """Parts as rows; every round as the nearest entry of each part, then the moved entries."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS MATERIALIZED (
  SELECT vec_id, p, v[p * {width} + 1:p * {width} + {width}] AS v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i
  FROM v, range(0, 4) AS t(p)),
b0 AS MATERIALIZED (SELECT p, i AS e, v AS m FROM q WHERE i < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT vec_id, q.p, v, e, CAST({" + ".join(f"(v[{i}] - m[{i}]) * (v[{i}] - m[{i}])" for i in range(1, width + 1))} AS BIGINT) AS d
    FROM q JOIN b{r} AS b ON q.p = b.p)
  GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.m, b.m) AS m FROM b{r} AS b LEFT JOIN (
    SELECT p, e, [{", ".join(f"CAST(floor(CAST(sum(v[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, width + 1))}] AS m
    FROM a{r} GROUP BY p, e) AS n ON n.p = b.p AND n.e = b.e)""")
    return "WITH " + ",".join(steps) + f""",
x AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT x.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(m, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM x JOIN v ON v.vec_id = x.vec_id"""


@query("op13_vector_codes", codes_sql())
def op13(spark, sf_dir):
    from dqflow.llm.covertree import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings")).drop("_label").withColumnRenamed("_id", "vec_id")
