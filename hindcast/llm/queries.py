"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import (
    chat, decontamination, extraction, hpylm, importance, jaccard, mixing, oracles, quality_rules,
    personal_data, substrings, token_files, toxicity, variants,
)
from hindcast.llm.common import ship_package, stored, table
from hindcast.operators.reliable import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents")
    folder = scratch_folder(documents)
    token_files.write_token_file(documents, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_file(spark, folder)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.severity_model(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_severity(documents, model)


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


@query("op4_chat_formatting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)],
        "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    formatted = stored(chat.format_conversations(rows.unionByName(planted)))
    return chat.conversation_digests(formatted)


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(
        quality_rules.ledger(table(spark, sf_dir, "documents")), "web", 2)
    base = F.col("fail_bits").bitwiseAND(quality_rules.policy_mask("base", 1)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits")


@query("op6_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_hpy_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(table(spark, sf_dir, "documents"))


WORDS = r"[^\x20\x09-\x0D]+"
MIX_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
    md5(concat_ws('|', '7', doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
turns AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes),
levels AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(2 * source_size) OVER low, 0) AS cap_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER low, 0) AS weight_left,
    row_number() OVER (ORDER BY source_size::DOUBLE / weight, weight, source NULLS LAST) AS level
  FROM turns
  WINDOW low AS (ORDER BY source_size::DOUBLE / weight, weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (
  SELECT *, (SELECT min(level) FROM levels
             WHERE cap::DOUBLE >= (total - cap_before) * weight / weight_left) AS first_open
  FROM levels),
targets AS (
  SELECT source, source_size, place, CASE WHEN level >= first_open THEN
    (SELECT total - cap_before FROM opened WHERE level = first_open) * weight
      / (SELECT weight_left FROM opened WHERE level = first_open)
    ELSE cap::DOUBLE END AS target FROM opened),
house AS (
  SELECT *, sum(target) OVER () AS whole, count(*) OVER () AS n,
    ceil(source_size / 64.0)::BIGINT AS blocks,
    round(sum(target) OVER () / 64)::BIGINT AS seats FROM targets),
bounds AS (
  SELECT *, CASE WHEN seats - n > 0 THEN floor(target * (seats - n) / whole + 0.5) ELSE 0 END::BIGINT
      AS sure,
    CASE WHEN seats + n > 0 AND whole > 0 THEN floor(target * (seats + n) / whole + 0.5) ELSE 0 END
      ::BIGINT + 1 AS most FROM house),
tried AS (
  SELECT place, target, unnest(range(sure, most)) AS seat FROM bounds WHERE target > 0),
ranked AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, place, seat) AS rank
  FROM tried),
won AS (
  SELECT place, count(*) AS won FROM ranked
  WHERE rank <= (SELECT max(seats) - sum(sure) FROM bounds) GROUP BY place),
quotas AS (
  SELECT b.*, least(sure + coalesce(won, 0), 2 * blocks) AS draws,
    ('0x' || substr(md5(concat_ws('|', 'first 7', source)), 1, 8))::BIGINT % greatest(blocks, 1)
      AS first_block
  FROM bounds b LEFT JOIN won USING (place)),
placed AS (
  SELECT r.*, q.source_size, q.target, q.blocks, q.draws, q.first_block,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY digest, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM rows r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN blocks > 0 THEN
    draws // blocks * size
    + greatest(least(begins + size, least(first_block + draws % blocks, blocks) * 64)
               - greatest(begins, first_block * 64), 0)
    + greatest(least(begins + size, greatest(first_block + draws % blocks - blocks, 0) * 64)
               - begins, 0)
  ELSE 0 END::BIGINT AS taken
FROM placed
"""


@query("op9_mixing", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling", oracles.IMPORTANCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants", oracles.VARIANTS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
