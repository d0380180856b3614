"""The thin queries over the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, divergence, hnsw, langid, media, packing, pieces, pii, secrets, simhash, suffixes, twofit, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.round_trip(_table(spark, sf_dir, "pages"))
    return made.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = langid.identify(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.tensors(media.store(_table(spark, sf_dir, "documents"))))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = twofit.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.component_rows(whitening.whiten(_table(spark, sf_dir, "embeddings")))
    return made.select(F.col("row.vec_id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def queries() -> dict:
    every = (op1_packing, op2_warc, op3_langid, op4_suffix_dedup, op5_secrets, op6_media, op7_sentencepiece, op8_pii, op9_hnsw, op10_simhash, op11_two_fit, op12_divergence, op13_whitening)
    return {f.__name__: f for f in every}


WARC_SQL = """
WITH seen AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS lead FROM seen GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  -- base32: four signs for every five hexadecimal digits
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(seen.h, 5 * (k // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = lead OR lead IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM seen JOIN firsts USING (h)
"""

SUFFIX_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 49)) AS k FROM docs WHERE length(x) >= 100)),
leads AS (SELECT s, min(doc_id) AS lead FROM strings GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, k FROM strings JOIN leads USING (s) WHERE doc_id > lead),
edges AS (SELECT doc_id, k, coalesce(k - lag(k) OVER w > 50, true) AS opens FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
runs AS (SELECT doc_id, k, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM edges),
spans AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM runs GROUP BY doc_id, run),
rest AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS free FROM spans),
pieces AS (
  SELECT doc_id, free AS place, substr(x, 2 * free + 1, 2 * (a - free)) AS piece FROM rest JOIN docs USING (doc_id)
  UNION ALL SELECT doc_id, coalesce(stop, 0), substr(x, 2 * coalesce(stop, 0) + 1) FROM docs LEFT JOIN (SELECT doc_id, max(b) AS stop FROM spans GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(piece, '' ORDER BY place))) AS kept_sha256 FROM pieces GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

HNSW_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM sound p JOIN sound q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)
"""


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT lang, source, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(c) AS n FROM found GROUP BY lang, source),
shares AS (
  SELECT s.lang, s.source, kept.term, coalesce(found.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(found.c, 0) + 2)) // (coalesce(sums.n, 0) + 2 * langs.v) AS p,
    1 + (1000000000::HUGEINT * (kept.total + 2)) // (langs.n + 2 * langs.v) AS q
  FROM sources s JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN found ON found.lang = s.lang AND found.source = s.source AND found.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
scored AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM scored)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators whose whole result SQL can express; the others are held against brute force in the tests."""
    return {"op2_warc": WARC_SQL, "op4_suffix_dedup": SUFFIX_SQL, "op9_hnsw": HNSW_SQL, "op12_divergence": DIVERGENCE_SQL}
