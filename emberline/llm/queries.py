"""Queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import chat_format, fingerprints, lm_score, near_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece_codec, sharding
from emberline.llm.common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and distances from its language, and the verdict."""
    out = quality_rules.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the fifth of documents that is held out."""
    return _table(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from labels outside the fifth that is held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, training_labels(spark, sf_dir)))
    return scored.select(
        "doc_id",
        F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= quality_classifier.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_text(name: str) -> str:
    return Path(vocabulary_path(name)).read_text(encoding="utf-8")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    return packing.pack(documents(spark, sf_dir), vocabulary_text("byte_bpe_50k.json"), length=2048, end=0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of near equal bytes; equal texts share a shard."""
    out = sharding.shard(documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the language model and under add-one counts."""
    return lm_score.score(documents(spark, sf_dir), _remainder("doc_id", 7) == 2)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component that near-duplicates link it to, over shingles of four words."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with an earlier reply, as prompt and masked completions."""
    turns = chat_format.gathered(_table(spark, sf_dir, "conversations"))
    return chat_format.format_preferences(chat_format.with_earlier_reply(turns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values of each kind it held."""
    out = pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumn("n_pii", sum((F.col(f"pii_n_{k}") for k in pii.KINDS), F.lit(0)).cast("int"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likenesses."""
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, as count and checksum, and whether they decode to its text."""
    return sentencepiece_codec.digests(documents(spark, sf_dir), sentencepiece_codec.Vocabulary(vocabulary_path("piece_bpe_32k.model")))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_lm_score": op5_lm_score,
    "op6_near_dedup": op6_near_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_pii": op8_pii,
    "op9_fingerprints": op9_fingerprints,
    "op10_sentencepiece": op10_sentencepiece,
}

SQL: dict[str, str] = {
    "op7_chat_format": """
with c as (
  select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, role nulls first, text nulls first) as a
  from conversations group by conv_id),
p as (
  select conv_id, a, list_filter(range(1, len(a) + 1), lambda i: a[i].r = 'assistant') as own from c),
q as (
  select conv_id, a, own[-1] as k, case when len(own) > 1 then a[own[-2]].t else '' end as e from p),
b as (
  select conv_id, a, k, list_transform(range(1, len(a) + 1), lambda i: {'r': a[i].r, 't': case when i = k then e else a[i].t end}) as b from q),
n as (
  select conv_id, a, b, coalesce(list_min(list_filter(range(0, len(a)), lambda i: a[i + 1].t <> b[i + 1].t)), len(a)) as n from b),
r as (
  select conv_id, n, a[1:n] as p, a[n + 1:] as a, b[n + 1:] as b from n)
select conv_id, cast(n as integer) as n_prompt_turns,
  array_to_string(list_transform(p, lambda x: concat('<|im_start|>', x.r, chr(10), x.t, '<|im_end|>', chr(10))), '') as prompt,
  array_to_string(list_transform(a, lambda x: concat('<|im_start|>', x.r, chr(10), x.t, '<|im_end|>', chr(10))), '') as chosen,
  array_to_string(list_transform(b, lambda x: concat('<|im_start|>', x.r, chr(10), x.t, '<|im_end|>', chr(10))), '') as rejected,
  array_to_string(list_transform(a, lambda x: concat(13 + length(x.r), ':0,', length(x.t) + 11, case when x.r = 'assistant' then ':1' else ':0' end)), ',') as chosen_mask,
  array_to_string(list_transform(b, lambda x: concat(13 + length(x.r), ':0,', length(x.t) + 11, case when x.r = 'assistant' then ':1' else ':0' end)), ',') as rejected_mask
from r""",
}
