"""The opN_<name> queries: each applies its operator to the whole of its table. Column order follows the contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm.chat_format import format_preferences, stale_reply_pairs
from lodestone.llm.document_sketch import neighbour_fingerprints
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.language_id import language_id
from lodestone.llm.mixing import Weights, mix_sources, source_group
from lodestone.llm.packing import pack
from lodestone.llm.quality_classifier import quality_classifier
from lodestone.llm.quality_rules import quality_rules
from lodestone.llm.sharding import shard
from lodestone.llm.simhash import simhash_dedup
from lodestone.llm.suffix_dedup import suffix_dedup
from lodestone.llm.turn_repair import repair_damaged
from lodestone.plans.runtime import table

QUERIES, ORACLES = {}, {}


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES["op1_exact_dedup"] = op1_exact_dedup
ORACLES["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op3_simhash(spark, sf_dir):
    return simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES["op3_simhash"] = op3_simhash


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


QUERIES["op5_packing"] = op5_packing


def op8_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))


QUERIES["op8_sharding"] = op8_sharding


def op9_quality_rules(spark, sf_dir):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return quality_rules(table(spark, sf_dir, "documents")).select(*columns)


QUERIES["op9_quality_rules"] = op9_quality_rules


def rule_counts(spark, sf_dir):
    """What op9 counts, without the verdict that SQL cannot express."""
    return op9_quality_rules(spark, sf_dir).drop("kept", "posterior")


QUERIES["rule_counts"] = rule_counts
ORACLES["rule_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
x AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""


def leaf_tokens(spark, sf_dir):
    """The leaves of op10's tree with what they hold; the shares themselves are tested against plain Python."""
    rows = op10_mixing(spark, sf_dir).groupBy("domain", "lang", "source")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))


QUERIES["leaf_tokens"] = leaf_tokens
ORACLES["leaf_tokens"] = r"""
WITH d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1) AS number,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
SELECT 'd' || CASE WHEN number = '' THEN '0' ELSE (number::BIGINT % 4)::VARCHAR END AS domain, lang, source, count(*) AS documents, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL
"""


def shard_sizes(spark, sf_dir):
    """What op8 puts into shards, by text, and how many shards equal texts are in."""
    own = op8_sharding(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return own.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")).agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("bytes"), F.count_distinct("shard").alias("shards"))


QUERIES["shard_sizes"] = shard_sizes
ORACLES["shard_sizes"] = r"""
SELECT sha256(coalesce(text, '')) AS text, count(*) AS documents, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, 1::BIGINT AS shards FROM documents GROUP BY coalesce(text, '')
"""


def op6_quality_classifier(spark, sf_dir):
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op6_quality_classifier"] = op6_quality_classifier


def op7_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


QUERIES["op7_language_id"] = op7_language_id


#: The mixture that op10 and the pipeline aim at.
MIXTURE = Weights(domain={"d0": 0.3, "d1": 0.3, "d2": 0.2, "d3": 0.2}, lang={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})


def op10_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), source_group(), 0.9, MIXTURE, epochs=2)


QUERIES["op10_mixing"] = op10_mixing


def op2_chat_format(spark, sf_dir):
    return format_preferences(stale_reply_pairs(table(spark, sf_dir, "conversations")))


QUERIES["op2_chat_format"] = op2_chat_format
ORACLES["op2_chat_format"] = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
l AS (SELECT conv_id, max(k) AS last FROM n WHERE role = 'assistant' GROUP BY conv_id),
b AS (SELECT n.conv_id, max_by(n.text, n.k) AS stale FROM n JOIN l USING (conv_id) WHERE n.k < l.last AND n.role = 'assistant' GROUP BY n.conv_id),
s AS (SELECT l.conv_id, l.last, n.text AS own, CASE WHEN coalesce(b.stale, '') = n.text THEN '' ELSE coalesce(b.stale, '') END AS stale
      FROM l JOIN n ON n.conv_id = l.conv_id AND n.k = l.last LEFT JOIN b ON b.conv_id = l.conv_id),
p AS (SELECT s.conv_id, string_agg('<|' || replace(coalesce(n.role, ''), '<|', '< |') || '|>' || chr(10) || replace(n.text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY n.k) AS prompt
      FROM s JOIN n ON n.conv_id = s.conv_id AND (n.k < s.last OR n.k = s.last AND s.own = s.stale) GROUP BY s.conv_id),
c AS (SELECT s.conv_id AS pair_id, CAST(CASE WHEN own = s.stale THEN last ELSE last - 1 END AS INTEGER) AS prompt_turns, coalesce(p.prompt, '') AS prompt,
      CASE WHEN own = s.stale THEN '' ELSE '<|assistant|>' || chr(10) || replace(own, '<|', '< |') || '<|end|>' || chr(10) END AS chosen,
      CASE WHEN own = s.stale THEN '' ELSE '<|assistant|>' || chr(10) || replace(s.stale, '<|', '< |') || '<|end|>' || chr(10) END AS rejected
      FROM s LEFT JOIN p ON p.conv_id = s.conv_id)
SELECT pair_id, prompt_turns, prompt, chosen, rejected, CASE WHEN chosen = '' THEN '' ELSE '14:' || length(chosen) END AS chosen_spans,
       CASE WHEN rejected = '' THEN '' ELSE '14:' || length(rejected) END AS rejected_spans FROM c
"""


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES["op4_suffix_dedup"] = op4_suffix_dedup


def op12_document_sketch(spark, sf_dir):
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


QUERIES["op12_document_sketch"] = op12_document_sketch


def edited_texts(spark, sf_dir):
    """What op12 compares documents with; the sketches, of XXH64, are tested against plain Python."""
    return op12_document_sketch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES["edited_texts"] = edited_texts
ORACLES["edited_texts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER (ORDER BY doc_id), CASE WHEN doc_id = max(doc_id) OVER () THEN arg_min(text, doc_id) OVER () END, '') AS after FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) AS edited_sha256 FROM d
"""


def op11_turn_repair(spark, sf_dir):
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES["op11_turn_repair"] = op11_turn_repair
ORACLES["op11_turn_repair"] = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS how FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM o),
n AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS ini, blank, dup, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM f),
m AS (SELECT k, op, repeat('I', k) || op AS code FROM range(3) t(k), (VALUES ('D'), ('K'), ('R')) v(op)),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS st, 0::BIGINT AS cost, '' AS audit, '' AS body FROM n
  UNION ALL SELECT conv_id, i, st, cost, audit, body FROM (SELECT conv_id, i, cost, audit, body || CASE op WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE nx WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10) END AS body,
      CASE op WHEN 'D' THEN st WHEN 'K' THEN ini ELSE nx END AS st FROM
    (SELECT r.conv_id, n.i, op, ini, role, text, cost + 2 * k + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN cut AND op <> 'D' THEN 1 ELSE 0 END AS cost, audit || code AS audit,
      CASE WHEN k = 0 THEN r.st WHEN (k = 1) = (r.st <> 'u') THEN 'u' ELSE 'a' END AS st, CASE WHEN (k % 2 = 0) = (r.st <> 'u') THEN 'u' ELSE 'a' END AS nx,
      body || CASE WHEN k = 0 THEN '' WHEN (k = 1 AND r.st <> 'u') THEN 'user:' || chr(10) WHEN k = 1 THEN 'assistant:' || chr(10) WHEN r.st <> 'u' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE 'assistant:' || chr(10) || 'user:' || chr(10) END AS body,
      blank OR dup AS must FROM r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.i = r.i + 1, m)
    WHERE op = 'D' OR NOT must AND (op = 'R' OR ini = nx OR ini = 's' AND st = '') QUALIFY row_number() OVER (PARTITION BY conv_id, CASE op WHEN 'D' THEN st WHEN 'K' THEN ini ELSE nx END ORDER BY cost, audit) = 1)),
l AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated FROM n GROUP BY conv_id),
b AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two, i FROM n) WHERE i > 1 AND two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
e AS (SELECT r.conv_id, cost + CASE st WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
        body || CASE st WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS body FROM r JOIN l ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.last = r.i),
w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(CASE WHEN coalesce(body, '') = '' THEN '' ELSE left(body, length(body) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""
