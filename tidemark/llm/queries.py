"""The queries op1 to op10 and their SQL; each is a thin digest of its operator's result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read


def tokenizer_path() -> str:
    """The vocabulary file: TOKENIZER_FILE, or that of the installed public tokenizers."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import rotate

    return rotate(read(spark, sf_dir, "conversations"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import line_dedup

    out = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = F.transform(F.coalesce("__runs", F.array().cast("array<struct<first:int,last:int>>")), lambda r: (r["last"] - r["first"] + 1).cast("long"))
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size(sizes).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("longest_run"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import hex_bits, near_dedup

    return near_dedup(read(spark, sf_dir, "documents")).select("doc_id", hex_bits(F.col("bits")).alias("fingerprint"), "component_id")


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hmm import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_nearest_neighbours, op3_substring_dedup, op4_packing, op5_perspectives, op6_line_dedup, op7_mixing, op8_simhash, op9_hmm_scores, op10_exact_dedup)}

_MIN_LINES, _MIN_WORDS = 3, 50
_WINDOWS = " UNION ALL ".join(
    f"SELECT doc_id, i, {n} AS n, list(line) OVER w AS w, sum(words) OVER w AS words FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    for n in range(1, _MIN_LINES + 1)
)
SQL = {
    "op5_perspectives": """
WITH said AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations
), views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker IS NOT NULL),
rows AS (
  SELECT s.conv_id, v.perspective, s.turn, s.speaker, s.text, coalesce(s.speaker = v.perspective, false) AS own,
    CASE WHEN coalesce(s.speaker = v.perspective, false) THEN '<|im_start|>assistant' || chr(10)
         ELSE '<|im_start|>user name=' || coalesce(s.speaker, 'unknown') || chr(10) END AS head
  FROM said s JOIN views v ON s.conv_id IS NOT DISTINCT FROM v.conv_id
), placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered,
    row_number() OVER w - 1 AS position,
    sum(length(head) + length(text) + 11) OVER w - length(head) - length(text) - 11 AS start
  FROM rows WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS LAST, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker,
  CASE WHEN own THEN 'assistant' ELSE 'user' END AS role, rendered, CAST(start AS BIGINT) AS start,
  CASE WHEN own THEN CAST(start + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN own THEN CAST(start + length(rendered) - 1 AS BIGINT) END AS mask_end
FROM placed""",
    "op6_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
), counted AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
windows AS ({_WINDOWS}), later AS (
  SELECT doc_id, i, n FROM (
    SELECT doc_id, i, n, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows WHERE len(w) = n AND (n = {_MIN_LINES} OR words >= {_MIN_WORDS})
  ) WHERE nth > 1
), removed AS (
  SELECT l.doc_id, l.i, l.line, count(x.i) > 0 AS gone
  FROM lines l LEFT JOIN later x ON l.doc_id = x.doc_id AND l.i BETWEEN x.i AND x.i + x.n - 1
  GROUP BY l.doc_id, l.i, l.line
), islands AS (
  SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM removed WHERE gone
), runs AS (SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, island),
per AS (SELECT doc_id, sum(n) AS n_removed, count(*) AS n_runs, max(n) AS longest_run FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM removed GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(p.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(p.longest_run, 0) AS BIGINT) AS longest_run, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN per p USING (doc_id)""",
    "op10_exact_dedup": r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal""",
}
