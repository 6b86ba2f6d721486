"""A corpus pipeline of operators from ``ionweave.llm``: STAGES, run and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

All stages take nulls in any column, empty and very long texts (a task holds one whole), repeated rows and ids,
other columns of any name (which they leave out) and empty tables (which stay empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm import exact, langid, mixing, packing, simhash
from ionweave.llm.common import Scratch, pick, small_batches
from ionweave.storage import scratch_dropped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a language that was learned, with the language found in ``lang``.

    What goes: null and empty texts and others without a letter, and texts of 32 letters and more whose cosine
    with every prototype is below what chance gives. Repeated rows and null ids stay. Without any
    text to learn from, all go. Prototypes don't depend on the order of rows.
    """
    small_batches(spark)
    profiles = langid.fit(docs)
    found = langid.in_learned_language(langid.identify(docs, profiles, keep=True), profiles)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: the one with the largest doc_id; a null id is the smallest, and a null text equals an empty one.

    Of rows that repeat an id and its text one stays; any, where their other columns differ.
    """
    stay = exact.exact_groups(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = pick(docs, *COLUMNS).withColumn("__own", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__own"] == stay["__sha"]))
    return rows.dropDuplicates(["doc_id", "__own"]).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: the one with the smallest doc_id; a null id comes last.

    Where an id stands on several texts of a component, one of these rows stays (the same in each run); rows that repeat an id
    and its text are one. Texts without words are a component of their own.
    """
    stay = simhash.survivors(simhash.near_groups(docs)).withColumnsRenamed({"doc_id": "__id", "mark": "__of"})
    rows = pick(docs, *COLUMNS).withColumn("__mark", simhash.mark())
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(stay["__id"]) & (rows["__mark"] == stay["__of"]))
    return rows.dropDuplicates(["doc_id", "__mark"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each copy of a document that it takes, a partial one cut after its last word.

    Texts without words are taken by no mix. Null is a source of its own; repeated rows count one by one.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece, with its ids; each row of docs is a document, repeated ones too."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("pack", pack),
]

#: SQL has no hypervectors, XXH64 or tokenizers; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents; each but the last is written to the shared folder and read again.

    What a stage wrote for itself is dropped when its result stands, and that when the next one's does; the
    last but one's stays, since the rows returned are read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        with scratch_dropped(spark):
            done = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
