"""Mixing sources to target weights: hash-random order, prefix sums of sizes, exact cuts, repeated epochs.

Within a source documents are in the order of a random key. Keys are uniform, so
equal ranges of keys hold about equally many documents: a source is cut into as
many ranges as its number of documents asks for, sums of ranges give each range
its offset, and the sums within a range finish the prefix sum. A hot source is
many ranges; nothing is gathered by source but one row a range.

Targets are found on a table with a row for each source, however many there are: a
source gets unit x weight words or its cap, and the unit rises, by sums over
that table, until all words are shared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered
from .common import SPACE, WORD, Scratch, pick, skewed_join

#: A table of at most so many sources is sent to all tasks.
FEW_SOURCES = 10_000


@dataclass(frozen=True)
class MixSpec:
    """weights: of the sources in order of code points, repeating. share: of all sizes. most: times a source's size."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    seed: int = 4
    range_rows: int = 4096


def targets(sizes: DataFrame, spec: MixSpec, scratch: Scratch) -> DataFrame:
    """(source, s, n) with __target: by weight; what is above a source's cap is shared again among the others until none is above.

    A source at its cap stays there, since the unit only rises, so each round is one sum over the
    sources. Sums are of whole numbers, so their order doesn't show.
    """
    rows = numbered(sizes, [F.col("source").isNull(), F.col("source")], "__place", scratch)
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    rows = scratch.write(rows.withColumn("__weight", F.get(weights, (F.col("__place") % len(spec.weights)).cast("int"))).drop("__place"))
    cap, unit = F.col("s") * spec.most, 0.0
    while True:
        full = F.lit(unit) * F.col("__weight") > cap
        got = rows.agg(F.sum("s").alias("all"), F.sum(F.when(full, F.col("s")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("__weight"))).alias("free")).first()
        left = spec.share * (got["all"] or 0) - spec.most * (got["full"] or 0)
        new = left / got["free"] if got["free"] else unit
        if new <= unit:
            break
        unit = new
    return rows.withColumn("__target", F.when(full, cap).otherwise(F.lit(unit) * F.col("__weight")).cast("double")).drop("__weight")


def sized(docs: DataFrame, spec: MixSpec) -> DataFrame:
    """The rows with __size (words, null text: 0), __key (random, the same in each run) and __hash, which tells texts apart where the rest ties.

    The key is 32 bits of an MD5 of id and size, for a null id of size and text.
    """
    docs = docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat_ws(":", F.lit(str(spec.seed)), F.col("__size").cast("string"), name).cast("binary"))
    return docs.withColumns({"__key": F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), "__hash": F.xxhash64("text")})


def assign(rows: DataFrame, spec: MixSpec) -> DataFrame:
    """Adds __source_size, __target and __taken to rows of :func:`sized`."""
    scratch = Scratch(rows.sparkSession, "mix-sources")
    sizes = scratch.write(rows.groupBy("source").agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n")))
    plan = scratch.write(targets(sizes, spec, scratch))
    table = plan.select(
        "source", F.col("s").alias("__source_size"), "__target",
        F.when(F.col("s") > 0, F.floor(F.col("__target") / F.col("s"))).otherwise(0).cast("long").alias("__epochs"),
        F.ceil(F.col("n") / spec.range_rows).alias("__ranges"),
    ).withColumn("__rest", F.floor("__target") - F.col("__epochs") * F.col("__source_size"))
    table = F.broadcast(table) if plan.count() <= FEW_SOURCES else table
    rows = skewed_join(rows, table, ["source"], null_safe=True)
    rows = rows.withColumn("__range", F.shiftright(F.col("__key") * F.col("__ranges"), 32))
    sums = rows.groupBy("source", "__range").agg(F.sum("__size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("__s"), F.col("__range").alias("__r"), F.coalesce(before, F.lit(0)).alias("__offset"))
    inner = F.sum("__size").over(Window.partitionBy("source", "__range").orderBy("__key", "doc_id", "__size", "__hash").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__inner", F.coalesce(inner, F.lit(0)))
    rows = rows.join(offsets, rows["source"].eqNullSafe(offsets["__s"]) & (rows["__range"] == offsets["__r"])).drop("__s", "__r")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - F.col("__offset") - F.col("__inner")))
    taken = F.when(F.col("__source_size") > 0, F.col("__epochs") * F.col("__size") + part).otherwise(0)
    return rows.withColumn("__taken", taken.cast("long"))


def mix_plan(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row; taken counts repeats.

    A source's taken words add up to its target, rounded down: whole epochs, then
    documents in random order up to the exact budget, the last one in part. A null
    text has size 0 and null is a source of its own, last in order. Rows that
    repeat an id count one by one, and null ids are told apart by their texts; texts of any
    length are counted whole; an empty table gives an empty one; other columns
    are ignored. The same input gives the same plan.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(sized(pick(docs, "doc_id", "text", "source"), spec).drop("text"))
    return assign(rows, spec).select("doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix itself: a row for each copy that :func:`mix_plan` takes, a partial one cut after its last word.

    Columns are those of documents; n_chars is that of the row's text.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = assign(sized(pick(docs, *names), spec), spec).where("__taken > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))))
    words = F.least(F.col("__size"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__size"))
    head = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(rf"^(?:[{SPACE}]*+[^{SPACE}]++){{"), words.cast("string"), F.lit("}+")), F.lit(0))
    rows = rows.withColumn("text", F.when(words < F.col("__size"), head).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*names)
