"""The dealt operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm import (
    collocations,
    embedding_dedup,
    fingerprints,
    jaccard_join,
    language_id,
    licenses,
    line_dedup,
    mixing,
    pii,
    prefix_trie,
    subwords,
    toxicity,
    warc,
)
from termscan.llm.common import read
from termscan.llm.registry import QUERIES, SQL, query  # noqa: F401


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read(spark, sf_dir, "documents"))


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read(spark, sf_dir, "documents"))


@query()
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_groups(read(spark, sf_dir, "embeddings"))


@query()
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


@query()
def op5_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.encode(read(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model)


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs, ~language_id.held_out(F.col("doc_id"))))


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


#: Words of pieces, phrases by place, and all the rest with 128-bit numbers.
COLLOCATIONS_SQL = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
phrases AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS size))),
totals AS (SELECT lang, count(*)::HUGEINT AS n FROM phrases WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : size], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, (1000 * c.a * n) // (l.f * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = b.lang AND g.size > b.size AND 100 * g.f >= 100 * b.a
      AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query(COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


WARC_SQL = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
named AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM payloads),
kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS largest FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM kept
"""


@query(WARC_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


#: The checksum bit by bit, conversations as lists, nodes as their beginnings, sums over every beginning of a beginning.
TRIE_SQL = """
WITH own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
checked AS (
  SELECT c, t, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM own),
built AS (
  SELECT a.c, list_concat(coalesce(b.t, [])[1 : a.h], a.t[a.h + 1 : len(a.t)]) AS t FROM checked a LEFT JOIN own b ON b.c = a.base),
members AS (SELECT c, len(t) AS size, d, t[1 : d] AS p FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (WHERE size = d) AS ends,
    CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].text) ELSE 0 END AS saved
  FROM members GROUP BY p, d),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.p = n.p),
sums AS (
  SELECT p[1 : k] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(array_to_string(n.ends, ','), '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.p = n.p LEFT JOIN nodes u ON n.d > 0 AND u.p = n.p[1 : n.d - 1]
"""


@query(TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
