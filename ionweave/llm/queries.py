"""The queries of this subpackage: each operator over its whole table, in the columns its contract fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, exact, langid, lines, mixing, packing, pii, quality, simhash, substring
from .common import documents, in_fold


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_columns(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "n_frames", F.size("segments").cast("long").alias("n_segments"), F.round(F.aggregate("segments", F.lit(0.0), lambda t, s: t + s["end_s"] - s["start_s"]), 6).alias("active_s"),
        "n_tiles", F.round("span_s", 6).alias("span_s"), F.length("tensors").cast("long").alias("tensor_bytes"), F.sha2("tensors", 256).alias("tensor_sha256"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, langid.fit(docs))
    return out.select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    gam = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score(docs, gam)
    return out.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(documents(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.span_text(pii.KINDS), 256).alias("base_sha256"), pii.span_text([*pii.KINDS, "term"]).alias("spans"), F.size("term").cast("long").alias("n_term"), F.sha2("text", 256).alias("sanitised_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_audio": op1_audio,
    "op2_repeats": op2_repeats,
    "op3_private": op3_private,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_exact": op7_exact,
    "op8_lines": op8_lines,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
}
