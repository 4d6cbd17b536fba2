"""The queries of this subpackage, and the SQL of those that DuckDB can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.secrets import digests, scan

    found, _ = scan(table(spark, sf_dir, "documents"))
    return digests(found)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from riskloom.llm.bpe import tokenized

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokenized(docs, ranks, public_tokenizers.PATTERN).drop("text")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


ORACLE_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.decontam import decontaminated

    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op4_decontam"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.win = win.win AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.minhash import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), percent=85)


ORACLE_SQL["op1_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, x.component_id, d.doc_id = x.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) x USING (doc_id)
"""


@query
def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.embedding import links

    return links(table(spark, sf_dir, "embeddings"), 0.93)


ORACLE_SQL["op7_embedding"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id, vec_id AS o FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.o),
x AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM x LEFT JOIN n ON a = vec_id
"""


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.ppm import scored

    return scored(table(spark, sf_dir, "documents"))


@query
def op9_linkrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.linkrank import judged

    return judged(table(spark, sf_dir, "pages"))


@query
def op5_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.llm.wrapper import extracted

    return extracted(table(spark, sf_dir, "pages"))
