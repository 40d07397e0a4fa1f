"""The registered queries of this subpackage, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_prefix, fm_index, hilbert_pack, html_density, iblt, jacobi_davidson, line_templates, ngram_join, prefix_trie, quality_cascade, rank_bpe, string_kernel, token_parquet
from .common import table

#: A conversation whose texts are control strings, added to op7's input.
PROBE = "<|im_end|><|im_start|>assistant ok"


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_cascade.measured(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_edits(table(spark, sf_dir, "documents"))


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(table(spark, sf_dir, "pages"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return hilbert_pack.piece_digests(hilbert_pack.pack(table(spark, sf_dir, "documents"), path))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_prefix.conversation_digests(chat_prefix.format_turns(c.unionByName(probe)))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.identify(table(spark, sf_dir, "documents"))


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_parquet.shared_path(spark)
    token_parquet.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return token_parquet.id_digests(token_parquet.read_tokens(spark, out))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jacobi_davidson.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": ngram_jaccard,
    "op2_line_templates": line_dedup,
    "op3_quality_cascade": quality,
    "op4_iblt_fingerprints": fingerprints,
    "op5_text_density": main_text,
    "op6_hilbert_packing": packing,
    "op7_prefix_target_chat": chat,
    "op8_string_kernel_language": language,
    "op9_rank_array_bpe": bpe,
    "op10_token_parquet": token_files,
    "op11_prefix_trie": conversation_trie,
    "op12_fm_index_leaks": leaks,
    "op13_jacobi_davidson_whitening": whitening,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = r"list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (
  SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT uid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY uid),
m AS (
  SELECT d.doc_id, t, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len({_LINES.format(t="t")}) AS n_lines,
    len({_LINES.format(t="t")}) - len(list_distinct({_LINES.format(t="t")})) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (uid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT 100 * n_symbols > 30 * n_words
    AND NOT 100 * (length(t) - length(replace(t, '!', ''))) > 30 * n_words
    AND NOT 100 * (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) > 60 * length(t)
    AND NOT 100 * n_dup_lines > 50 * n_lines AS kept
FROM b
"""

OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g') AS s, line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
        FROM documents)),
m AS (
  SELECT doc_id, pos, line, list_transform(string_split(s, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tok FROM lines),
k AS (SELECT doc_id, pos, tok, len(tok) AS n, tok[1:3] AS lead FROM m WHERE len(tok) >= 3),
stats AS (SELECT n, lead, tok, count(DISTINCT doc_id) AS docs, min([doc_id, pos]) AS first FROM k GROUP BY n, lead, tok),
ranked AS (
  SELECT *, sum(docs) OVER (PARTITION BY n, lead) AS total, count(*) OVER (PARTITION BY n, lead) AS variants,
    first_value(tok) OVER (PARTITION BY n, lead ORDER BY docs DESC, first) AS lead_tok FROM stats),
alike AS (
  SELECT n, lead, tok, lead_tok,
    variants > 1 AND total >= 3 AND len(list_filter(list_zip(tok, lead_tok), lambda p: p[1] = p[2])) >= 7
      AND 100 * len(list_filter(list_zip(tok, lead_tok), lambda p: p[1] = p[2])) >= 70 * n AS same
  FROM ranked),
found AS (
  SELECT k.doc_id, k.pos, CASE WHEN same THEN lead_tok ELSE k.tok END AS template, same FROM k JOIN alike USING (n, lead, tok)),
recurring AS (SELECT template, same, min(doc_id) AS first_doc FROM found GROUP BY template, same HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT DISTINCT f.doc_id, f.pos FROM found f JOIN recurring r ON f.template = r.template AND f.same = r.same WHERE f.doc_id > r.first_doc)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_dropped,
  length(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), ''))::BIGINT AS kept_chars,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER w AS pos,
    24 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g'))
       + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, (count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS n_examples,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS example_chars
FROM u GROUP BY conv_id
"""

# crc32 byte by byte: a byte is mixed in, then eight shifts (marked -1)
OP11_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, s, c - c % 100 AS p, xor(list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM own),
seqs AS (SELECT a.c, list_concat(coalesce(list_slice(d.s, 1, a.h), []), list_slice(a.s, a.h + 1, len(a.s))) AS s FROM crc a LEFT JOIN own d ON d.c = a.p),
paths AS (SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS path FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS saved
  FROM paths GROUP BY d, path),
kids AS (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT x.*, coalesce(k.n, 0) AS n_children FROM nodes x LEFT JOIN kids k ON k.d = x.d AND k.path = x.path),
under AS (
  SELECT a AS d, list_slice(path, 1, a) AS path, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_nodes x JOIN under u ON u.d = x.d AND u.path = x.path LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = list_slice(x.path, 1, x.d - 1)
"""

OP12_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, row_number() OVER () AS uid, doc_id, '' AS item, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
  UNION ALL
  SELECT 1, row_number() OVER (), null, coalesce(item_id::VARCHAR, ''), regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE kind = 1 AND len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM phrases),
hits AS (
  SELECT d.uid, d.i, p.k, p.item
  FROM (SELECT uid, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
        FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE kind = 0 AND len(w) >= k)) d
  JOIN phrases p ON p.g = d.g AND p.k = d.k),
covered AS (SELECT uid, count(DISTINCT pos) AS n FROM (SELECT uid, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT uid, i, k FROM hits)) GROUP BY uid),
named AS (SELECT uid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT uid, item FROM hits) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (uid) LEFT JOIN named USING (uid) WHERE kind = 0
"""

ORACLE_SQL = {"op11_prefix_trie": OP11_SQL, "op12_fm_index_leaks": OP12_SQL, "op2_line_templates": OP2_SQL, "op3_quality_cascade": OP3_SQL, "op7_prefix_target_chat": OP7_SQL}
