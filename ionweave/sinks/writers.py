"""Result files: cluster assignments as CSV, spectra as MGF, staged spectra as Parquet."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..config import Settings, described
from ..functions.natural import natural_key
from ..schema import RESULT_COLUMNS
from ..sources.readers import extension
from ..storage import filesystem


def natural_order(df: DataFrame) -> DataFrame:
    """Rows by file name and spectrum, digits compared as numbers: a range sort over all tasks."""
    return df.orderBy(natural_key(F.col("filename")), natural_key(F.col("spectrum_id")))


def header(s: Settings) -> list[str]:
    return [f"# ionweave version {__version__}", *[f"# {line}" for line in described(s)], "#"]


def exists(spark, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def delete(spark, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def write_text(spark, path: str, lines: Iterable[str]) -> None:
    """One text file on the file system of the path, which ``exists`` and ``delete`` look at too; a few MB are held at a time."""
    fs, at = filesystem(spark, path)
    out = fs.create(at, True)
    held, size = [], 0
    try:
        for line in lines:
            held.append(line)
            size += len(line)
            if size > 1 << 22:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def write_cluster_csv(clusters: DataFrame, path: str, s: Settings, single: bool = True) -> None:
    """The settings as comment lines, a header line, then one line for each spectrum in natural order.

    single: one file, written from partitions that come to the driver one after the other.
    Otherwise a folder of sorted parts, each with a header line, and the settings in ``_settings`` next to them.
    """
    rows = natural_order(clusters.select(*RESULT_COLUMNS))
    if not single:
        rows.write.mode("error").option("header", True).csv(path)
        write_text(clusters.sparkSession, f"{path}/_settings", ["\n".join(header(s))])
        return

    def lines() -> Iterable[str]:
        yield "\n".join(header(s)) + "\n"
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        out.writerow(RESULT_COLUMNS)
        for row in rows.toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if v is None else v for v in row])
            yield text.getvalue()
            text.seek(0)
            text.truncate()
        yield text.getvalue()

    write_text(clusters.sparkSession, path, lines())


def _number(x: Column) -> Column:
    return x.cast("double").cast("string")


def mgf_text(spectra: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One text (value) for each spectrum, after the columns to keep: TITLE, PEPMASS, CHARGE unless null, RTINSECONDS, peaks."""
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", _number(p["mz"]), _number(p["intensity"]))), "\n")
    charge = F.col("precursor_charge").cast("int")
    signed = F.when(charge < 0, F.concat(F.abs(charge).cast("string"), F.lit("-"))).otherwise(F.concat(charge.cast("string"), F.lit("+")))
    lines = [
        F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), "identifier"), F.concat(F.lit("PEPMASS="), _number(F.col("precursor_mz"))),
        F.concat(F.lit("CHARGE="), signed), F.concat(F.lit("RTINSECONDS="), _number(F.coalesce("retention_time", F.lit(-1.0)))),
        F.when(F.size("peaks") > 0, peaks), F.lit("END IONS"), F.lit(""),
    ]
    return spectra.select(*(keep or []), F.concat_ws("\n", *lines).alias("value"))


def write_spectra(spectra: DataFrame, path: str, single: bool = True) -> None:
    """Writes an MGF file (single), or a folder of MGF parts; any other extension is a ValueError."""
    if extension(path) != ".mgf":
        raise ValueError(f"unsupported peak file format: {path}")
    text = mgf_text(spectra)
    if not single:
        text.write.mode("error").text(path)
        return
    write_text(spectra.sparkSession, path, (row["value"] + "\n" for row in text.toLocalIterator(prefetchPartitions=True)))


#: Bits of a streamed spectrum's ``sid``: batch, partition and row.
BATCH_BITS, PART_BITS, ROW_BITS = 20, 17, 26


def _sid(batch: int | None) -> Column:
    """A number for each row; of several batches each has its own range, and rows that don't fit into it are an error."""
    own = F.monotonically_increasing_id()
    if batch is None:
        return own
    part, row = F.shiftright(own, 33), own.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (part < 1 << PART_BITS) & (row < 1 << ROW_BITS) & F.lit(batch < 1 << BATCH_BITS)
    number = F.lit(batch << (PART_BITS + ROW_BITS)) + F.shiftleft(part, ROW_BITS) + row
    return F.when(fits, number).otherwise(F.raise_error(F.lit("too many batches, partitions or rows for a sid")).cast("long"))


def stage(spectra: DataFrame, path: str, mode: str = "errorifexists", batch: int | None = None) -> None:
    """Cleaned spectra as Parquet with two arrays of peaks and a ``sid``, a folder for each charge. batch: of a stream, for sids that differ between batches."""
    rows = spectra.select(
        _sid(batch).alias("sid"), "identifier", F.col("precursor_mz").cast("float").alias("precursor_mz"), "precursor_charge",
        F.transform("peaks", lambda p: p["mz"].cast("float")).alias("mz"), F.transform("peaks", lambda p: p["intensity"].cast("float")).alias("intensity"),
        F.col("retention_time").cast("float").alias("retention_time"), "filename",
    )
    rows.write.mode(mode).partitionBy("precursor_charge").parquet(path)


def read_stage(spark, path: str) -> DataFrame:
    """Staged spectra with their peaks as one array of structs; pruned by charge and by column as usual."""
    schema = "sid long, identifier string, precursor_mz float, mz array<float>, intensity array<float>, retention_time float, filename string, precursor_charge byte"
    df = spark.read.schema(schema).parquet(path)
    return df.withColumn("peaks", F.arrays_zip("mz", "intensity")).drop("mz", "intensity")
