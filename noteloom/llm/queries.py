"""The queries of these operators on the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noteloom.llm.collision_ann import nearest
from noteloom.llm.common import read_table
from noteloom.llm.grouping_pack import pack
from noteloom.llm.host_suffixes import extract
from noteloom.llm.minimax_shards import shard_documents
from noteloom.llm.nested_secrets import find_secrets
from noteloom.llm.pii import find_pii
from noteloom.llm.pivotal_variants import spelling_variants
from noteloom.llm.probminhash import near_duplicates
from noteloom.llm.rank_index_fim import fill_in_middle_digests
from noteloom.llm.risk_rules import apply_rules
from noteloom.llm.rule_ensemble import score_documents
from noteloom.llm.segment_bpe import encode_texts
from noteloom.llm.warc import archive_pages


def op1_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda vec_id: vec_id % 20 == 0)


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), shards=24, law="bytes")


def op6_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, capacity=1024, end_id=2)


def op7_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return apply_rules(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_texts(read_table(spark, sf_dir, "documents", "doc_id", "text"), path, digests=True)


def op10_offset_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents", "doc_id", "text"), delete_every=31)


def op12_rank_index_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return fill_in_middle_digests(docs, seed=7, fim_percent=100, spm_percent=50)


def op13_nested_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc_members, op2_rule_ensemble, op3_probminhash, op4_collision_ann, op5_minimax_shards, op6_grouping_pack,
        op7_risk_rules, op8_host_suffixes, op9_segment_tree_bpe, op10_offset_pii,
        op11_pivotal_variants, op12_rank_index_fim, op13_nested_secrets)
}
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, upper(sha1(html)) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex),
d AS (
  SELECT hex, first_id, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS digest FROM f)
SELECT page_id, payload_bytes, digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM h JOIN d USING (hex)
"""

_FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
  FROM documents),
x AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(lines[1 + least(h1 % (n + 1), h2 % (n + 1)):greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(lines[1 + greatest(h1 % (n + 1), h2 % (n + 1)):], '') AS s
  FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM c
"""

# The checksum is computed from its definition: every byte is mixed in and then shifted out bit by bit.
_VARIANTS_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs),
summed AS (
  SELECT run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(x) // 2), lambda i:
      [('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END),
    4294967295::BIGINT) AS h FROM hexed),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (
  SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
near AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, min(near) AS form, any_value(near_n) AS form_n
  FROM words w LEFT JOIN near USING (word)
  LEFT JOIN pairs p ON p.word = w.word AND near_n = most AND most >= 10 * w.n GROUP BY ALL),
steps AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

ORACLES: dict[str, str] = {
    "op1_warc_members": _WARC_SQL, "op11_pivotal_variants": _VARIANTS_SQL, "op12_rank_index_fim": _FIM_SQL}
