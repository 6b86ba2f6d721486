"""MGF peak files: text records, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PEAKS
from ..storage import Scratch

END = "END IONS"


def _param(body: Column, name: str) -> Column:
    """The first value of NAME=value in a record; null without one."""
    found = F.regexp_extract(body, rf"(?im)^[ \t]*{name}[ \t]*=(.*)$", 1)
    return F.when(body.rlike(rf"(?im)^[ \t]*{name}[ \t]*="), F.trim(F.regexp_replace(found, "\r", "")))


def _charge(value: Column) -> Column:
    """The first charge of values like 2+, 3-, 2+ and 3+; null where there is none that fits a byte."""
    number = F.regexp_extract(value, r"(\d+)", 1).try_cast("int")
    return F.when(F.regexp_extract(value, r"\d+\s*([+-]?)", 1) == "-", -number).otherwise(number).try_cast("byte")


NAMES = ["TITLE", "PEPMASS", "CHARGE", "RTINSECONDS"]


def file_headers(records: DataFrame) -> DataFrame:
    """(filename, and each of NAMES with h_ before it) of the files whose first record has parameters before it.

    records: (value, filename, start), start being where the split of the file begins that a row is from.
    """
    head = F.element_at(F.split("value", "BEGIN IONS", 2), 1)
    first = records.where("start = 0").select("filename", F.monotonically_increasing_id().alias("at"), head.alias("head"))
    found = first.groupBy("filename").agg(F.min_by("head", "at").alias("head"))
    params = [F.when(F.length(_param(F.col("head"), n)) > 0, _param(F.col("head"), n)).alias(f"h_{n}") for n in NAMES]
    return found.select("filename", *params).where(" or ".join(f"h_{n} is not null" for n in NAMES))


def parse_records(records: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Spectra from (value, filename) rows, a value being the text up to the end of a record.

    A record without TITLE or a numeric PEPMASS isn't a spectrum, nor is one whose CHARGE can't be read; ``bad`` tells. Without CHARGE the charge is
    null, without RTINSECONDS the time is -1. Lines that begin with # ; ! or / are comments. What a record
    doesn't say it takes from its file's parameters (headers: see :func:`file_headers`).
    """
    df = records.where(F.contains("value", F.lit("BEGIN IONS"))).withColumn("body", F.regexp_extract("value", r"(?s)BEGIN IONS[^\n]*\n?(.*)$", 1))
    if headers is not None:
        df = df.join(headers, "filename", "left")
    param = {n: _param(F.col("body"), n) if headers is None else F.coalesce(_param(F.col("body"), n), F.col(f"h_{n}")) for n in NAMES}
    rows = F.filter(F.split("body", r"\r?\n"), lambda x: x.rlike(r"^\s*[-+.\d]"))
    cells = F.transform(rows, lambda x: F.split(F.trim(x), r"\s+"))
    peaks = F.transform(cells, lambda c: F.struct(F.get(c, F.lit(0)).try_cast("double").cast("float").alias("mz"), F.get(c, F.lit(1)).try_cast("double").cast("float").alias("intensity")))
    df = df.select(
        param["TITLE"].alias("identifier"),
        F.element_at(F.split(param["PEPMASS"], r"\s+"), 1).try_cast("double").cast("float").alias("precursor_mz"),
        param["CHARGE"].alias("__charge"),
        F.array_sort(peaks).cast(PEAKS).alias("peaks"),
        param["RTINSECONDS"].alias("__rt"),
        "filename",
    )
    broken = F.exists("peaks", lambda p: p["mz"].isNull() | p["intensity"].isNull())
    rt = F.when(F.col("__rt").isNull(), F.lit(-1.0)).otherwise(F.col("__rt").try_cast("double")).cast("float")
    charge = _charge(F.col("__charge"))
    unread = (F.length("__charge") > 0) & charge.isNull()
    bad = F.col("identifier").isNull() | F.col("precursor_mz").isNull() | rt.isNull() | broken | F.coalesce(unread, F.lit(False))
    return df.select("identifier", "precursor_mz", charge.alias("precursor_charge"), "peaks", rt.alias("retention_time"), "filename", bad.alias("bad"))


def with_headers(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Parsed records of whole files; files' parameters are looked for first, in a table that is empty as a rule."""
    headers = Scratch(spark, "headers").write(file_headers(records))
    return parse_records(records, None if headers.isEmpty() else headers)


RECORD = ["value", "_metadata.file_path as filename", "_metadata.file_block_start as start"]


def read_mgf(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spectra of MGF files with ``bad``; files are split, so a large one is read by many tasks."""
    return with_headers(spark, spark.read.option("lineSep", END).text(paths).selectExpr(*RECORD))
