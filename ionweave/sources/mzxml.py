"""mzXML peak files: text cut at the ends of scans, so that nested scans of any depth are rows, and a vectorised function for peaks."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PEAK_ARRAYS, zipped_peaks

#: A scan's start tag with its attributes.
TAG = r"""^<scan((?:\s+[\w:]+\s*=\s*(?:"[^"]*"|'[^']*'))*+)\s*/?>"""


def decode(text: str | None, precision: str | None, compression: str | None) -> np.ndarray | None:
    """(n, 2) numbers of interleaved big-endian m/z and intensity; None where they can't be read."""
    try:
        raw = base64.b64decode(text or "", validate=False)
        if compression == "zlib" and raw:
            raw = zlib.decompress(raw)
        return np.frombuffer(raw, ">f8" if precision == "64" else ">f4").astype(np.float32).reshape(-1, 2)
    except (ValueError, zlib.error):
        return None


@F.pandas_udf(PEAK_ARRAYS)
def _peaks(text: pd.Series, precision: pd.Series, compression: pd.Series) -> pd.DataFrame:
    out = []
    for t, p, c in zip(text, precision, compression):
        found = None if t is None else decode(t, p, c)
        if found is None:
            out.append((None, None))
        else:
            found = found[np.argsort(found[:, 0], kind="stable")]
            out.append((found[:, 0], found[:, 1]))
    return pd.DataFrame(out, columns=["mz", "intensity"])


def minutes(duration: Column) -> Column:
    """ISO durations like PT1M2.5S in minutes, which is how times of this format are given; plain numbers stay."""
    part = lambda unit: F.coalesce(F.regexp_extract(duration, rf"([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(duration.startswith("P"), part("H") * 60 + part("M") + part("S") / 60).otherwise(duration.try_cast("double"))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag's text; null without one."""
    found = F.regexp_extract(tag, rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    return F.when(found != "", F.regexp_extract(found, r"""["']([^"']*)["']$""", 1))


def read_mzxml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spectra of MS level 2 and above with ``bad``; scans may stand in other scans, however deep.

    A scan's own elements come before the scans in it, so its text goes from its tag to the next
    scan's tag or the next end of a scan. A scan that a truncated file breaks off has no whole peaks and is bad.
    """
    df = spark.read.option("lineSep", "</scan").text(paths).select("value", F.col("_metadata.file_path").alias("filename"))
    df = df.where(F.contains("value", F.lit("<scan"))).select(F.explode(F.split("value", r"(?=<scan\s)")).alias("s"), "filename")
    df = df.where(F.col("s").rlike(r"^<scan\s")).withColumn("tag", F.regexp_extract("s", TAG, 1))
    df = df.where(F.coalesce(_attribute(F.col("tag"), "msLevel").try_cast("int"), F.lit(-1)) > 1)
    element = lambda name, group: F.regexp_extract("s", rf"<{name}((?:\s[^>]*+)?)>([^<]*+)</{name}", group)
    has_peaks = F.col("s").rlike(r"<peaks(?:\s[^>]*+)?>[^<]*+</peaks")
    time = _attribute(F.col("tag"), "retentionTime")
    rt = F.when(time.isNull(), F.lit(-1.0)).otherwise(minutes(time)).cast("float")
    of_peaks = element("peaks", 1)
    df = df.select(
        _attribute(F.col("tag"), "num").alias("identifier"), F.trim(F.regexp_replace(element("precursorMz", 2), r"\s", "")).try_cast("double").cast("float").alias("precursor_mz"),
        _attribute(element("precursorMz", 1), "precursorCharge").try_cast("byte").alias("precursor_charge"),
        _peaks(F.when(has_peaks, element("peaks", 2)), _attribute(of_peaks, "precision"), _attribute(of_peaks, "compressionType")).alias("p"), rt.alias("retention_time"), "filename",
    )
    df = df.select("identifier", "precursor_mz", "precursor_charge", zipped_peaks("p").alias("peaks"), "retention_time", "filename")
    bad = F.col("identifier").isNull() | F.col("precursor_mz").isNull() | F.col("peaks").isNull() | F.col("retention_time").isNull()
    return df.withColumn("bad", bad)
