"""One query for each operator of this subpackage, over its whole table, and the
DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exact_dedup, hostrules, langid, lattice, merkle, minhash, mixing, pii, secrets, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The tokenizer file of op2, as installed; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), vocabulary())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), key="op4")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"), similar=85, rows=4, slack=0.22)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pieces() -> str:
    """The vocabulary file of op13, as installed; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_score(table(spark, sf_dir, "documents"), pieces())


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), false) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

OP5_SQL = """
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT rid, unnest(list_transform(range(1, greatest(len(ws) - 7, 0) + 1), lambda i: {'i': i, 'k': list_slice(ws, i, i + 7)})) AS x FROM w),
often AS (SELECT rid, x.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x.k) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM often) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
t AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS all_n, count(*) - 1 AS free, sum(n * n) AS squares FROM h),
s AS (SELECT mean, free, all_n, squares, mean * (1 - mean) AS noise, sum(n * (f / n - mean) * (f / n - mean)) AS ss FROM h, t GROUP BY ALL),
r AS (SELECT mean, (ss - noise * free) / nullif(noise * (all_n - squares / all_n - free), 0) AS alike FROM s),
p AS (SELECT mean, CASE WHEN alike > 0 THEN greatest(1.0::DOUBLE, least(1e6::DOUBLE, 1 / alike - 1)) ELSE 1e6 END AS k FROM r),
bad AS (SELECT source FROM h, p WHERE (f + mean * k) / (n + k) > 0.5::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept
FROM b
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(k % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM k),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
     - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size,
    CASE WHEN cap / w <= level THEN cap
         ELSE min_by(level, struct_pack(a := cap / w, b := k)) FILTER (NOT cap / w <= level) OVER () * w END AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
p AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS part, target - floor(ratio) * source_size AS want FROM r),
hist AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
part AS (
  SELECT hist.source, size, (want - coalesce(sum(size * n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(size::HUGEINT * size * n) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c
  FROM hist JOIN p ON hist.source IS NOT DISTINCT FROM p.source WINDOW w AS (PARTITION BY hist.source ORDER BY size DESC)),
rate AS (SELECT source, max_by(c, size) AS c FROM part WHERE c * size <= 1 GROUP BY source),
u AS (
  SELECT d.doc_id, d.size, p.*, least(1.0::DOUBLE, rate.c * d.size) AS pi,
    (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, ''))), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN rate ON d.source IS NOT DISTINCT FROM rate.source),
q AS (SELECT *, CASE WHEN size > 0 AND pi >= 1 THEN 0.0 WHEN size > 0 AND pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM u),
c AS (SELECT *, sum(size) FILTER (q IS NOT NULL) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= want THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) END AS crc
  FROM documents),
f AS (
  SELECT rid, doc_id, lang, coalesce(crc % 7 = 0, false) AND n_chars IS NOT NULL AS changes,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, length((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) AS more,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS t
  FROM d),
h AS (SELECT rid, doc_id, lang, sha256(head || n || t) AS leaf, CASE WHEN changes THEN sha256(head || more || t) ELSE sha256(head || n || t) END AS start FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM h),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS h, size FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM tree WHERE size > 1 GROUP BY lang, level, pos // 2, size),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS place, count(*) OVER () AS langs FROM tree WHERE size = 1),
top AS (
  SELECT 0 AS level, place AS pos, subroot AS h, langs AS size FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM top WHERE size > 1 GROUP BY level, pos // 2, size),
steps AS (
  SELECT l.rid, t.level, (l.pos >> t.level) & 1 AS odd, t.pos AS mine, l.lang, false AS upper FROM leaves l JOIN tree t
    ON l.lang IS NOT DISTINCT FROM t.lang AND t.pos = l.pos >> t.level AND t.size > 1
  UNION ALL
  SELECT l.rid, 1000 + t.level, (s.place >> t.level) & 1, t.pos, l.lang, true FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t
    ON t.pos = s.place >> t.level AND t.size > 1),
paths AS (
  SELECT s.rid, s.level, s.odd, coalesce(t.h, p.h) AS sibling FROM steps s
  LEFT JOIN tree t ON NOT s.upper AND t.lang IS NOT DISTINCT FROM s.lang AND t.level = s.level AND t.pos = xor(s.mine, 1)
  LEFT JOIN top p ON s.upper AND p.level = s.level - 1000 AND p.pos = xor(s.mine, 1)),
proofs AS (
  SELECT rid, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256,
    list({'odd': odd, 'sibling': sibling} ORDER BY level) AS path FROM paths GROUP BY rid),
folds AS (
  SELECT l.rid, l.start AS h, p.path FROM leaves l JOIN proofs p USING (rid)
  UNION ALL
  SELECT rid, CASE WHEN path[1].sibling IS NULL THEN sha256(h) WHEN path[1].odd = 1 THEN sha256(path[1].sibling || h) ELSE sha256(h || path[1].sibling) END, path[2:]
  FROM folds WHERE len(path) > 0),
folded AS (SELECT rid, h FROM folds WHERE len(path) = 0),
root AS (SELECT h AS root FROM top WHERE size = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, coalesce(f.h, l.start) AS folded_root,
  coalesce(f.h, l.start) = r.root AS verified
FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root r LEFT JOIN proofs p USING (rid) LEFT JOIN folded f USING (rid)
"""

OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (
  SELECT a.lang, a.source, coalesce(l.v, 0) AS v, coalesce(l.lang_total, 0) AS lang_total, coalesce(b.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) b USING (lang, source)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total::HUGEINT + 5 * g.v) AS p,
    1 + (1000000000::HUGEINT * (kept.lang_n + 5)) // (g.lang_total::HUGEINT + 5 * g.v) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, q.source AS item, sum(abs(p.p - q.p)) AS value FROM p JOIN p q ON p.lang = q.lang AND p.term = q.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
f AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM f
QUALIFY part = 'pair' OR rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_host_rules": op5_host_rules,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_secrets": op8_secrets,
    "op9_minmax_near_dedup": op9_minmax_near_dedup,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_lattice_lm": op13_lattice_lm,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op5_host_rules": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op10_mixing": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
