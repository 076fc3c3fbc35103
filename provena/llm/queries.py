"""The queries of this subpackage: thin applications of the operators to whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.substring_dedup import drop_repeated_passages

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_passages(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
tok AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT t.doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n
  FROM tok t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.lm_score import stupid_backoff

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return stupid_backoff(docs, order=2, min_count=2).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_backed_off")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (
  SELECT doc_id, p, w[p] AS x, CASE WHEN p > 1 THEN w[p - 1] END AS prev
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
c1 AS (SELECT x, count(*) AS n FROM tok GROUP BY x),
c2 AS (SELECT prev, x, count(*) AS n FROM tok WHERE prev IS NOT NULL GROUP BY prev, x),
s AS (
  SELECT t.doc_id,
         CASE WHEN c2.n >= 2 THEN ln(c2.n / cp.n)
              ELSE CASE WHEN t.prev IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + ln(c1.n / (SELECT count(*) FROM tok)) END AS v,
         (t.prev IS NOT NULL AND c2.n < 2)::BIGINT AS b
  FROM tok t JOIN c1 ON t.x = c1.x LEFT JOIN c2 ON t.prev = c2.prev AND t.x = c2.x LEFT JOIN c1 cp ON t.prev = cp.x)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(any_value(g.v), 0), 4) AS log_score,
       round(any_value(g.v) / nullif(len(d.w), 0), 6) AS mean_log_score, coalesce(any_value(g.b), 0)::BIGINT AS n_backed_off
FROM d LEFT JOIN (SELECT doc_id, sum(v) AS v, sum(b) AS b FROM s GROUP BY doc_id) g ON d.doc_id = g.doc_id
GROUP BY d.doc_id, d.w
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p
  FROM documents),
k AS (
  SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(o.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.near_duplicates import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h, n) AS class_id, count(*) OVER (PARTITION BY h, n) AS members FROM z),
r AS (SELECT s.doc_id, g, c.n FROM s JOIN c ON s.doc_id = c.doc_id AND c.class_id = c.doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 5 >= 4 * (a.n + b.n - count(*))),
t(node, root) AS (
  SELECT DISTINCT x, x FROM p
  UNION
  SELECT p.y, t.root FROM t JOIN p ON t.node = p.x),
g AS (SELECT node, min(root) AS root FROM t GROUP BY node),
k AS (SELECT p.x, sum(c.members) AS links FROM p JOIN c ON p.y = c.doc_id GROUP BY p.x)
SELECT d.doc_id, coalesce(g.root, c.class_id, d.doc_id) AS group_id, coalesce(c.class_id, d.doc_id) AS class_id,
       coalesce(c.members - 1, 0)::BIGINT AS n_copies, (coalesce(c.members - 1, 0) + coalesce(k.links, 0))::BIGINT AS n_links,
       coalesce(c.n, 0)::BIGINT AS n_shingles
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON c.class_id = g.node LEFT JOIN k ON c.class_id = k.x
"""


def tokenizer_path() -> str:
    """The vocabulary file of the token-count query, from the installed public tokenizers."""
    import os

    return os.environ.get("PROVENA_TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.token_count import count_tokens_of

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens_of(docs, tokenizer_path(), kind="merges").select("doc_id", "n_tokens", "n_pieces")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.decontaminate import contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
oc AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT a.doc_id, a.i, a.m, win.item_id FROM oc a JOIN win ON a.k = win.k AND a.m = win.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.mixing import mix_sources

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "tokens", "epoch", "block", "shuffle_key")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.warc import round_trip

    out = round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT h, min(page_id) AS holder FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(x, 10 * (j // 8) + 1, 10))::BIGINT >> (35 - 5 * (j % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p JOIN f ON p.h = f.h
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.quality import quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS line,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, source, unnest(l) AS x FROM d)),
f AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM ln GROUP BY source, line) l
  JOIN (SELECT source, count(*) AS m FROM d GROUP BY source) s ON l.source IS NOT DISTINCT FROM s.source
  WHERE l.n >= 30 AND l.n > 0.03::DOUBLE * s.m),
rm AS (SELECT ln.doc_id, sum(words) AS n FROM ln JOIN f ON ln.line = f.line AND ln.source IS NOT DISTINCT FROM f.source GROUP BY ln.doc_id),
s AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(d.l) - len(list_distinct(d.l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(rm.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN rm ON d.doc_id = rm.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept
FROM b
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.zip_quality import CompressionClassifier

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality")
    return CompressionClassifier.fit(docs, labels).score(docs, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.line_dedup import LOWER, UPPER
    from provena.llm.merkle import build_manifest, proofs, row_digest

    docs = _table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in columns]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, row_digest(*tampered))
    return proofs(build_manifest(docs, columns, altered=altered)).withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH RECURSIVE
b AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM b),
d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tr,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS used
  FROM f),
t(tr, lvl, i, h, w) AS (
  SELECT tr, 0, i, leaf, w FROM d
  UNION ALL
  SELECT tr, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(w) + 7) // 8 FROM t WHERE w > 1 GROUP BY tr, lvl, i // 8),
sub AS (SELECT tr, h FROM t WHERE w = 1),
u(lvl, i, h, w) AS (
  SELECT 0, tr, h, (SELECT count(*) FROM sub) FROM sub
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(w) + 7) // 8 FROM u WHERE w > 1 GROUP BY lvl, i // 8),
n AS (SELECT tr, lvl, i, h, w FROM t UNION ALL SELECT -1, lvl, i, h, w FROM u),
r AS (SELECT tr, lvl, i // 8 AS g, list(h ORDER BY i) AS hs FROM n WHERE w > 1 GROUP BY tr, lvl, i // 8),
p(doc_id, tr, lvl, i, w, proof, cur) AS (
  SELECT doc_id, tr, 0, i, w, '', used FROM d
  UNION ALL
  SELECT doc_id, CASE WHEN p.w = 1 THEN -1 ELSE p.tr END, CASE WHEN p.w = 1 THEN 0 ELSE p.lvl + 1 END,
         CASE WHEN p.w = 1 THEN p.tr ELSE p.i // 8 END, CASE WHEN p.w = 1 THEN (SELECT count(*) FROM sub) ELSE (p.w + 7) // 8 END,
         CASE WHEN p.w = 1 THEN proof ELSE proof || array_to_string(r.hs[:p.i % 8], '') || array_to_string(r.hs[p.i % 8 + 2:], '') END,
         CASE WHEN p.w = 1 THEN cur ELSE sha256(array_to_string(r.hs[:p.i % 8], '') || cur || array_to_string(r.hs[p.i % 8 + 2:], '')) END
  FROM p LEFT JOIN r ON p.tr = r.tr AND p.lvl = r.lvl AND p.i // 8 = r.g
  WHERE p.w > 1 OR p.tr >= 0)
SELECT d.doc_id, d.leaf, sub.h AS subroot, root.h AS root, sha256(p.proof) AS proof_sha256, p.cur AS folded_root, p.cur = root.h AS verified
FROM d JOIN sub ON d.tr = sub.tr JOIN p ON d.doc_id = p.doc_id AND p.tr = -1 AND p.w = 1, (SELECT h FROM u WHERE w = 1) root
"""


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from provena.llm.token_files import token_file_round_trip

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_file_round_trip(docs, str(public_tokenizers.path("word_bpe_49k.json")), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.llm.tiered_search import ranked_search

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, _table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY item_id, t),
r AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN w ON q.t = w.t JOIN p ON q.t = p.t, s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc": op6_warc,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_files": op12_token_files,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_ngram_jaccard_join": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_lm_scoring": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
