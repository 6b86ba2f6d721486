"""Blocks of spectra close in precursor m/z, within each charge; null is a charge of its own.

A block ends where the next precursor m/z is farther away than the tolerance.
Only the distinct m/z values decide that, so rows are first reduced to one for each
(charge, m/z). These are cut into coarse bins of m/z that are worked on in parallel; gaps across bins are
found on a table with one row a bin, which the range of m/z bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

BIN = 1.0
NO_CHARGE = -128


def charge_key(charge: Column) -> Column:
    """The charge as a number that joins can use: null is -128."""
    return F.coalesce(charge.cast("int"), F.lit(NO_CHARGE))


def _gap(mz: Column, before: Column, tol: float, unit: str) -> Column:
    mz, before = mz.cast("double"), before.cast("double")
    return (mz - before if unit == "Da" else (mz - before) / before * 1e6) > tol


def blocks(spectra: DataFrame, tol: float, unit: str) -> DataFrame:
    """(z, precursor_mz, block, before, size) for each distinct charge and m/z.

    block counts from 0 within a charge; before: spectra of the block with a smaller m/z; size: of the block.
    """
    values = spectra.groupBy(charge_key(F.col("precursor_charge")).alias("z"), "precursor_mz").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("bin", F.floor(F.col("precursor_mz") / BIN))
    w = Window.partitionBy("z", "bin").orderBy("precursor_mz")
    values = values.withColumn("starts", F.coalesce(_gap(F.col("precursor_mz"), F.lag("precursor_mz").over(w), tol, unit), F.lit(False)).cast("int"))
    inner = values.withColumn("k", F.sum("starts").over(w)).withColumn("below", F.sum("n").over(w) - F.col("n"))
    bins = inner.groupBy("z", "bin").agg(F.min("precursor_mz").alias("lo"), F.max("precursor_mz").alias("hi"), F.sum("starts").alias("k_all"), F.sum("n").alias("n_all"))
    v = Window.partitionBy("z").orderBy("bin")
    bins = bins.withColumn("opens", F.coalesce(_gap(F.col("lo"), F.lag("hi").over(v), tol, unit), F.lit(False)).cast("int"))
    bins = bins.withColumn("k_before", F.sum(F.col("opens") + F.col("k_all")).over(v) - F.col("k_all")).withColumn("n_before", F.sum("n_all").over(v) - F.col("n_all"))
    bins = bins.select("z", "bin", "k_before", "n_before")
    placed = inner.join(bins, ["z", "bin"]).select("z", "precursor_mz", (F.col("k") + F.col("k_before")).alias("block"), (F.col("below") + F.col("n_before")).alias("rank"), "n")
    size = placed.groupBy("z", "block").agg(F.sum("n").alias("size"), F.min("rank").alias("first"))
    return placed.join(size, ["z", "block"]).select("z", "precursor_mz", F.col("block").cast("long").alias("block"), (F.col("rank") - F.col("first")).alias("before"), "size")


def with_blocks(spectra: DataFrame, tol: float, unit: str, batch_size: int, key: list[str], exempt_last: bool = False) -> DataFrame:
    """Adds z, block, chunk and block_id (one long for all three) to the spectra.

    A block of batch_size spectra or more is cut, in order of m/z and then ``key``, into equal chunks,
    the first of which get one more if they don't come out even. exempt_last: not the last block of a charge.
    The table of blocks is written first, so that it is made once and tells whether any block is cut at all.
    """
    table = blocks(spectra, tol, unit)
    if exempt_last:
        last = table.groupBy("z").agg(F.max("block").alias("__last"))
        table = table.join(last, "z").withColumn("cut", (F.col("size") >= batch_size) & (F.col("block") < F.col("__last"))).drop("__last")
    else:
        table = table.withColumn("cut", F.col("size") >= batch_size)
    table = Scratch(spectra.sparkSession, "block-table").write(table.withColumnRenamed("precursor_mz", "__mz"))
    rows = spectra.withColumn("__z", charge_key(F.col("precursor_charge")))
    rows = rows.join(table, (rows["__z"] == table["z"]) & (rows["precursor_mz"] == table["__mz"])).drop("__z", "__mz")
    # most spectra are in blocks that stay whole: only the others are put in order
    whole = rows.where("not cut").withColumn("chunk", F.lit(0))
    if table.where("cut").isEmpty():
        rows = whole
    else:
        large = rows.where("cut").withColumn("__at", F.col("before") + F.row_number().over(Window.partitionBy("z", "precursor_mz").orderBy(*key)) - 1)
        n = F.ceil(F.col("size") / batch_size)
        q, r = F.floor(F.col("size") / n), F.col("size") % n
        long_part, place = r * (q + 1), F.col("__at")
        chunk = F.when(place < long_part, F.floor(place / (q + 1))).otherwise(r + F.floor((place - long_part) / q))
        rows = whole.unionByName(large.withColumn("chunk", chunk.cast("int")).drop("__at"))
    block_id = F.shiftleft((F.col("z") + 129).cast("long"), 52) + F.shiftleft("block", 24) + F.col("chunk")
    return rows.withColumn("block_id", block_id).drop("before", "size", "cut")
