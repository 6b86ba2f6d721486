"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed size. All distinct blocks are sorted, and a
block's place is its integer name; then adjacent pairs of names are named in the
same way, again and again, until each text has one name. Equal texts get equal
names and others don't, by comparison of contents, not by trust in a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, skewed_join

BLOCK = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with a name each: place in the sorted partition, behind those of other partitions.

    Rows are dealt by their own contents and sorted, so a lost task that runs
    again gives the same names.
    """
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(text: F.Column, block: int) -> F.Column:
    data = F.coalesce(text, F.lit("")).cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.length(data) / block) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block + 1, F.lit(block)))


def identities(docs: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """row, doc_id, text_sha256, level, name for each row: (level, name) is the identity of its text."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact")
    rows = pick(docs, "doc_id", "text")
    salt = 0
    while True:  # digests only carry names from blocks to texts; they are used when they tell all blocks apart
        digest = lambda b: F.unhex(F.md5(F.concat(F.lit(bytes([salt])), b)))  # noqa: B023, E731
        distinct = rows.select(F.explode(_blocks(F.col("text"), block)).alias("b")).distinct()
        names = scratch.write(_named(distinct, ["b"]).select(digest(F.col("b")).alias("d"), "name"))
        if names.groupBy("d").count().where("count > 1").isEmpty():
            break
        scratch.drop(names)
        salt += 1
    meta = scratch.write(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("text"), block), digest).alias("ds"),
        ).withColumn("n", F.size("ds").cast("long"))
    )
    level = scratch.write(skewed_join(meta.select("row", "n", F.posexplode("ds").alias("i", "d")), names, ["d"]).select("row", "n", F.col("i").cast("long").alias("i"), "name"))
    scratch.drop(names)
    longest = meta.agg(F.max("n")).first()[0] or 1
    done, depth = [], 0
    while True:
        done.append(level.where("n = 1").select("row", F.lit(depth).cast("long").alias("level"), "name"))
        if longest <= 1:
            break
        left, right = (F.max(F.when(F.col("i") % 2 == k, F.col("name"))) for k in (0, 1))
        pairs = level.where("n > 1").groupBy("row", F.floor(F.col("i") / 2).alias("i")).agg(F.first("n").alias("n"), left.alias("l"), F.coalesce(right, F.lit(-1)).alias("r"))
        pairs = scratch.write(pairs)
        names = _named(pairs.select("l", "r").distinct(), ["l", "r"])
        level = scratch.write(skewed_join(pairs, names, ["l", "r"]).select("row", F.ceil(F.col("n") / 2).alias("n"), "i", "name"))
        scratch.drop(pairs)
        longest = -(-longest // 2)
        depth += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return meta.select("row", "doc_id", "text_sha256").join(out, "row")


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.

    Of rows with equal texts the one with the largest doc_id is kept; keep_id is
    that id. A null text equals an empty one. Null ids are smallest. Rows that
    repeat an id and its text count one by one, and one of them is kept. An empty
    table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    ids = scratch.write(identities(docs, block, scratch))
    best = ids.groupBy("level", "name").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), (-F.col("row")).alias("r"), "doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return skewed_join(ids, best, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.r")).alias("kept"), "text_sha256")
