"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, embeddings, fingerprints, hardneg, language, neardup, packing, pieces, substrings, urls, warc

RANKS, TOKENIZER, TOKENIZER_RANKS = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict_held_out(_table(spark, folder, "documents"))


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, folder, "documents"))


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"), neardup.Plan(words=4))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(_table(spark, folder, "conversations"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.archive_and_index(_table(spark, folder, "pages"), min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.removal_digests(_table(spark, folder, "documents"))


def op9_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(TOKENIZER_RANKS),
                        public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.phrases(_table(spark, folder, "documents"))


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hardneg.hard_negatives(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_url_filters, op3_byte_bpe, op4_fingerprints, op5_minhash, op6_chat_formatting, op7_warc, op8_substring_dedup,
        op9_embeddings, op10_packing, op11_collocations, op12_sentencepiece, op13_hard_negatives)}

URL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

SQL: dict[str, str] = {
    # Rules by longest match; then the verdict of the component over canonical links and refreshes.
    "op2_url_filters": f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {URL_RULES}),
seen AS (
  SELECT page_id, html, url, regexp_extract(url, '^([^#]*)', 1, 's') AS bare,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
links AS (
  SELECT DISTINCT r.bare AS u, t.bare AS v
  FROM (SELECT bare, unnest([
          nullif(regexp_extract(html, '<link rel="canonical" href="([^"]+)"', 1), ''),
          nullif(regexp_extract(html, '<meta http-equiv="refresh" content="[^"]*url=([^"]+)"', 1), '')]) AS target FROM seen) r
  JOIN seen t ON regexp_extract(r.target, '^([^#]*)', 1) = t.bare WHERE r.bare <> t.bare),
pairs AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(a, b) AS (SELECT u, v FROM pairs UNION SELECT reach.a, pairs.v FROM reach JOIN pairs ON reach.b = pairs.u),
fit AS (
  SELECT seen.page_id, seen.bare, rules.h || rules.p AS rule, rules.v AS v,
         row_number() OVER (PARTITION BY seen.page_id ORDER BY length(rules.h || rules.p) DESC, rules.v) AS k
  FROM seen JOIN rules ON (seen.host = rules.h OR ends_with(seen.host, '.' || rules.h)) AND starts_with(seen.path, rules.p)),
best AS (SELECT * FROM fit WHERE k = 1),
alias AS (SELECT reach.a AS bare, min(best.v) AS v FROM reach JOIN best ON reach.b = best.bare GROUP BY 1)
SELECT seen.page_id, seen.host, seen.path, best.rule AS rule, coalesce(best.v, alias.v, 'allow') AS verdict,
       best.v IS NULL AND alias.v IS NOT NULL AS by_alias
FROM seen LEFT JOIN best ON seen.page_id = best.page_id LEFT JOIN alias ON seen.bare = alias.bare""",
    # A conversation stays unless its turns open a longer one; equal ones are one class.
    "op6_chat_formatting": """
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS said,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM turns GROUP BY conv_id),
classes AS (SELECT min(conv_id) AS conv_id, n, said, rendered, count(*) AS n_snapshots FROM whole GROUP BY n, said, rendered)
SELECT a.conv_id, a.n AS n_turns, a.n_snapshots, a.rendered FROM classes a
WHERE NOT EXISTS (SELECT 1 FROM classes b WHERE b.n > a.n AND b.said[1] = a.said[1] AND b.said[1:a.n] = a.said)""",
    # Phrases of 2 to 5 words inside pieces, the lowest of their cuts, those no longer phrase explains away.
    "op11_collocations": r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM docs),
said AS (SELECT lang, row_number() OVER () AS piece_id, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
words AS (SELECT lang, piece_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM said),
line AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5
  FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
said_by_size AS (
  SELECT lang, w1 AS phrase FROM line
  UNION ALL SELECT lang, w1 || ' ' || w2 FROM line WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 FROM line WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM line WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM line WHERE w5 IS NOT NULL),
often AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM said_by_size GROUP BY lang, phrase HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS g, f AS a FROM often WHERE contains(phrase, ' ')),
parted AS (
  SELECT lang, phrase, a, k, array_to_string(g[1:k], ' ') AS first_part, array_to_string(g[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM cand)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, t.n, k, x.f AS l, y.f AS r, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM parted c JOIN total t ON c.lang = t.lang
  JOIN often x ON x.lang = c.lang AND x.phrase = c.first_part JOIN often y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1),
inside AS (
  SELECT lang, array_to_string(g[i:j], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT *, unnest(range(1, len(g))) AS i FROM cand))
  WHERE j - i + 1 < len(g) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.phrase = b.phrase WHERE s.a IS NULL OR s.a < b.a),
ranked AS (SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    # Anchors against all rows: the first positives, then the first rows in each positive's window.
    "op13_hard_negatives": """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT DISTINCT vec_id, label, e FROM fine WHERE vec_id % 100 = 0),
met AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, a.e AS anchor, c.vec_id, c.label,
         coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM anchors a JOIN fine c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e)),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, anchor_label, anchor ORDER BY score DESC, vec_id) AS nth
                 FROM met WHERE label = anchor_label) WHERE nth <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, m.vec_id AS negative_id, m.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.anchor, p.nth ORDER BY m.score DESC, m.vec_id) AS rank
  FROM positives p JOIN met m ON m.anchor_id = p.anchor_id AND m.anchor_label = p.anchor_label AND m.anchor = p.anchor
  WHERE m.label <> p.anchor_label AND 30 * p.score <= 100 * m.score AND 100 * m.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10""",
}
