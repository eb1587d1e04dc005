"""The registered queries of the operators and of the pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespark.llm import exact_dedup, lexical, licenses, merkle, mixing, pieces, pii, simhash, substrings, topk, toxicity, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p),
r AS (SELECT *, n >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m AS again FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN m END AS refers_to, true AS verified
FROM r
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(source, '') AS source, doc_id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
p AS (SELECT source, tokens, tokens / CAST((SELECT sum(tokens) FROM s) AS DOUBLE) AS p FROM s WHERE tokens > 0),
e AS (SELECT min(p) AS least, max(p) AS most FROM p),
b AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN pow(least / most, (lo + hi) / 2 - 1) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(least / most, (lo + hi) / 2 - 1) > 2.0 THEN hi ELSE (lo + hi) / 2 END
  FROM b, e WHERE i < 40),
x AS (
  SELECT CASE WHEN pow(least / most, -1) <= 2.0 THEN 0 ELSE round((SELECT lo FROM b WHERE i = 40), 6) END AS x FROM e),
r AS (SELECT source, tokens, pow(p, x) AS r FROM p, x),
w AS (SELECT source, tokens, r / (SELECT sum(r) FROM r) AS weight FROM r),
g AS (SELECT max(tokens / weight) AS budget FROM w),
q AS (
  SELECT source, tokens, weight, CAST(floor(budget * weight + 0.5) AS BIGINT) AS quota,
         greatest(1, CAST(ceil(budget / 1048576) AS BIGINT)) AS blocks FROM w, g
  UNION ALL
  SELECT source, tokens, 0.0, 0, 1 FROM s WHERE tokens = 0),
t AS (
  SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE quota // tokens END AS whole,
         CASE WHEN tokens = 0 THEN 1 ELSE CAST(ceil(quota / tokens) AS BIGINT) END AS epochs FROM q),
u AS (SELECT d.*, t.* EXCLUDE (source), unnest(range(0, t.epochs)) AS epoch FROM d JOIN t USING (source)),
v AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', '42', CAST(epoch AS VARCHAR), source, CAST(doc_id AS VARCHAR))), 1, 15)
                 AS BIGINT) AS place FROM u),
y AS (
  SELECT *, CAST(epoch * tokens + coalesce(sum(n_tokens) OVER (
           PARTITION BY source, epoch ORDER BY place, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS BIGINT) AS start FROM v)
SELECT doc_id, source, n_tokens, epoch, start,
       CASE WHEN quota = 0 THEN 0
            ELSE CAST(least(floor(start * CAST(blocks AS DOUBLE) / quota), blocks - 1) AS BIGINT) END AS block,
       place, round(weight, 9) AS weight
FROM y WHERE epoch < whole OR start < quota
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""



def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.lowered_text_manifest(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE b AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text, list_reduce(
           list_concat([4294967295], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
  FROM documents),
f AS (
  SELECT r, doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, xor(crc, 4294967295) % 5 = 0 AS tampered,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM b),
l AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS other
  FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n AS (
  SELECT 0 AS lvl, source, pos, leaf AS digest FROM p
  UNION ALL
  SELECT lvl + 1, source, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS size FROM n) WHERE size > 1 GROUP BY lvl, source, pos // 16),
s AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, lvl AS height
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lvl DESC) AS k FROM n) WHERE k = 1),
t AS (
  SELECT 0 AS lvl, place AS pos, subroot AS digest FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS size FROM t) WHERE size > 1 GROUP BY lvl, pos // 16),
top AS (SELECT digest AS root, lvl AS height FROM t ORDER BY lvl DESC LIMIT 1),
a AS (
  SELECT 'low' AS part, source, lvl, pos, digest FROM n
  UNION ALL
  SELECT 'top', NULL, lvl, pos, digest FROM t),
g AS (
  SELECT part, source, lvl, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM a WINDOW w AS (PARTITION BY part, source, lvl, pos // 16 ORDER BY pos)),
v AS (
  SELECT p.r, p.source, 'low' AS part, 0 AS lvl, p.pos, coalesce(other, leaf) AS digest, '' AS beside, s.height, s.place, top.height AS higher
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source, top
  UNION ALL
  SELECT v.r, v.source, CASE WHEN v.lvl = v.height THEN 'top' ELSE v.part END, CASE WHEN v.lvl = v.height THEN 0 ELSE v.lvl + 1 END,
         CASE WHEN v.lvl = v.height THEN v.place ELSE v.pos // 16 END,
         CASE WHEN v.lvl = v.height THEN v.digest ELSE sha256(g.before || v.digest || g.after) END,
         CASE WHEN v.lvl = v.height THEN v.beside ELSE v.beside || g.before || g.after END,
         CASE WHEN v.lvl = v.height THEN v.higher ELSE v.height END, v.place, CASE WHEN v.lvl = v.height THEN -1 ELSE v.higher END
  FROM v JOIN g ON v.part = g.part AND v.lvl = g.lvl AND v.pos = g.pos AND (v.part = 'top' OR v.source IS NOT DISTINCT FROM g.source)
  WHERE NOT (v.part = 'top' AND v.lvl = v.height))
SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(v.beside) AS proof_sha256, v.digest AS folded_root, v.digest = top.root AS verified
FROM v JOIN p ON p.r = v.r JOIN s ON p.source IS NOT DISTINCT FROM s.source, top
WHERE v.part = 'top' AND v.lvl = v.height
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_words FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, n_docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM m JOIN w USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_dedup(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (
  SELECT r, x FROM e
  WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x)
  WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) END >= 0.95),
c AS (SELECT r AS a, r AS b FROM e UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT c.a, min(e.vec_id) AS low FROM c JOIN e ON c.b = e.r GROUP BY c.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.low AS component_id, coalesce(e.vec_id = m.low, false) AS kept
FROM e JOIN m ON m.a = e.r LEFT JOIN n ON n.a = e.r
"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_licenses": op6_licenses,
    "op7_pieces": op7_pieces,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_top_k": op10_top_k,
    "op11_merkle": op11_merkle,
    "op12_lexical_search": op12_lexical_search,
    "op13_embedding_dedup": op13_embedding_dedup,
}
ORACLES = {
    "op2_warc": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op10_top_k": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_embedding_dedup": OP13_SQL,
}
