"""The registered queries of the training-data operators, each over its whole table, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import table
from treeline.llm.license_align import scan_licenses
from treeline.llm.line_rules import line_rules
from treeline.llm.mixing import mix_sources
from treeline.llm.quality_net import quality_scores
from treeline.llm.sentence_spans import dedup_substrings
from treeline.llm.sentencepiece_wfst import encode_documents
from treeline.llm.shard_tree import DRAW_DIGITS, EXTRA, grown, shard_documents, tree
from treeline.llm.simhash_bk import near_duplicates
from treeline.llm.topk import exact_top_k
from treeline.llm.toxic_lexicon import toxicity_scores


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, keep=("doc_id",)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", "n_tokens", "ids", "round_trip")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs.select("doc_id", "source", "text"), keep=()).select("doc_id", "size", "source_size", "target", "taken")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_license_scans,
        op2_quality_rules,
        op3_quality_classifier,
        op4_sharding,
        op5_simhash_near_dedup,
        op6_sentencepiece,
        op7_substring_dedup,
        op8_mixing,
        op9_exact_topk,
        op10_toxicity,
    )
    return {f.__name__: f for f in own}


OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT rid, doc_id, source, ln, lower(trim(regexp_replace(ln, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, doc_id, source, unnest(string_split(t, chr(10))) AS ln FROM d)),
lw AS (SELECT * FROM l WHERE n > 0),
freq AS (SELECT source, norm FROM lw GROUP BY source, norm HAVING count(DISTINCT rid) > 50),
gone AS (SELECT lw.rid, sum(lw.n) AS g FROM lw JOIN freq f ON lw.norm = f.norm AND lw.source IS NOT DISTINCT FROM f.source GROUP BY lw.rid),
dup AS (SELECT rid, count(*) - count(DISTINCT ln) AS n_dup FROM lw GROUP BY rid),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, x FROM win GROUP BY rid, x HAVING count(*) > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n_rep FROM win JOIN twice USING (rid, x), (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
b AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, coalesce(g, 0) AS gone
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)) AND n_words - gone >= 0.5 * n_words AS kept,
  CAST(gone AS BIGINT) AS n_removed_words
FROM b
"""


def _place_sql(root, column: str) -> str:
    """Nested CASE over the draws of each level, written out from the tree."""

    def draw(node) -> str:
        return f"(ln((CAST('0x' || substr(md5(k || '/{node.name}'), 1, {DRAW_DIGITS}) AS BIGINT) + 1) / {float(16**DRAW_DIGITS)!r}) / {float(node.weight)!r})"

    def down(node) -> str:
        if not node.children:
            return str(node.shard)
        best = "greatest(" + ", ".join(draw(c) for c in node.children) + ")"
        return "CASE " + best + " " + " ".join(f"WHEN {draw(c)} THEN {down(c)}" for c in node.children) + " END"

    return f"CAST({down(root)} AS INTEGER) AS {column}"


def op4_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS t FROM documents),
crc AS (SELECT i, {_crc_steps()} AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS crc FROM crc),
s AS (
  SELECT doc_id, k, CAST(strlen(t) + {EXTRA} AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(t)), '..')]),
      lambda a, b: xor(a >> 8, crc[CAST(xor(a & 255, b) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM d, tab),
p AS (SELECT *, {_place_sql(tree(), "shard")}, {_place_sql(grown(tree()), "grown_shard")} FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '|' || size || '|' || text_crc32), 1, 15), doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM p
"""


def _crc_steps() -> str:
    """The CRC-32 table entry of i, by its eight shift steps with the reflected polynomial."""
    x = "CAST(i AS BIGINT)"
    for _ in range(8):
        x = f"(list_transform([{x}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)[1])"
    return x


OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size), 1, 15) AS BIGINT) AS h FROM d),
s0 AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s1),
s3 AS (
  SELECT *, cap / weight AS runs_out,
    (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS t
  FROM s2 WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce((SELECT t FROM s3 WHERE t <= runs_out ORDER BY runs_out, rank LIMIT 1), (SELECT max(runs_out) FROM s3)) AS t),
s AS (SELECT source, rank, source_size, weight, least(cap, weight * level.t) AS target FROM s3, level),
f AS (
  SELECT row_number() OVER () AS rid, doc_id, size, rank, source_size, weight, target,
    sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source),
items AS (SELECT rid, size, rank, upto / weight + p * (source_size / weight) AS fin FROM f, (SELECT unnest([0, 1]) AS p) WHERE size > 0),
sent AS (SELECT rid, size, sum(size) OVER (ORDER BY fin, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM items),
taken AS (SELECT rid, sum(size) AS taken FROM sent WHERE total <= 1.5 * (SELECT sum(size) FROM d) GROUP BY rid)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM f LEFT JOIN taken USING (rid)
"""

OP9 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op4_sharding": op4_sql(), "op8_mixing": OP8, "op9_exact_topk": OP9}
