"""mzML peak files: the built-in XML source for spectra, one vectorised function for binary arrays."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PEAK_ARRAYS, zipped_peaks
from ..storage import Scratch

_CV = T.ArrayType(T.StructType([T.StructField("_name", T.StringType()), T.StructField("_value", T.StringType())]))


_REFS = T.StructField("referenceableParamGroupRef", T.ArrayType(T.StructType([T.StructField("_ref", T.StringType())])))


def _with_cv(*more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("cvParam", _CV), _REFS, *more])


def _list(name: str, item: T.StructType) -> T.StructField:
    return T.StructField(f"{name}List", T.StructType([T.StructField(name, T.ArrayType(item))]))


SPECTRUM = _with_cv(
    T.StructField("_id", T.StringType()),
    T.StructField("scanList", T.StructType([T.StructField("scan", T.ArrayType(_with_cv()))])),
    _list("precursor", T.StructType([_list("selectedIon", _with_cv())])),
    _list("binaryDataArray", _with_cv(T.StructField("binary", T.StringType()))),
)


def _cv(params: Column, *names: str) -> Column:
    """The value of the first parameter with one of the names; empty where it has none, null where there is no such parameter."""
    return F.coalesce(*[_first(params, name) for name in names])


def _first(params: Column, name: str) -> Column:
    hit = F.try_element_at(F.filter(params, lambda p: p["_name"] == name), F.lit(1))
    return F.when(hit.isNotNull(), F.coalesce(hit["_value"], F.lit("")))


def decode(text: str | None, kinds: list[str]) -> np.ndarray | None:
    """Numbers of a base64 array, little-endian, whose cvParam names tell width and compression; None where they can't be read."""
    try:
        raw = base64.b64decode(text or "", validate=False)
        if "zlib compression" in kinds:
            raw = zlib.decompress(raw) if raw else raw
        kind = next(t for n, t in (("64-bit float", "<f8"), ("32-bit float", "<f4"), ("64-bit integer", "<i8"), ("32-bit integer", "<i4")) if n in kinds)
        return np.frombuffer(raw, kind).astype(np.float32)
    except (ValueError, zlib.error, StopIteration):
        return None


@F.pandas_udf(PEAK_ARRAYS)
def _peaks(arrays: pd.Series) -> pd.DataFrame:
    out = []
    for row in arrays:
        mz = intensity = None
        for a in row if row is not None else ():
            kinds = list(a["kinds"]) if a["kinds"] is not None else []
            if "m/z array" in kinds:
                mz = decode(a["binary"], kinds)
            elif "intensity array" in kinds:
                intensity = decode(a["binary"], kinds)
        if mz is None or intensity is None or len(mz) != len(intensity):
            out.append((None, None))
            continue
        order = np.argsort(mz, kind="stable")
        out.append((mz[order], intensity[order]))
    return pd.DataFrame(out, columns=["mz", "intensity"])


GROUP = T.StructType([T.StructField("_id", T.StringType()), T.StructField("cvParam", _CV)])


def param_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(filename, groups): for each file that has any, its groups of parameters by id."""
    df = _xml(spark, paths, "referenceableParamGroup", GROUP).where("_id is not null")
    return df.groupBy("filename").agg(F.map_from_entries(F.collect_list(F.struct("_id", F.coalesce("cvParam", F.array().cast(_CV))))).alias("groups"))


def _xml(spark: SparkSession, paths: list[str], tag: str, schema: T.StructType) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(list(paths))
    return df.withColumn("filename", F.col("_metadata.file_path"))


def read_mzml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Spectra of MS level 2 and above with ``bad``; the level is tested before any array is decoded.

    Parameters may stand in groups that the file defines once; these are looked for first, in a table that is empty as a rule.
    The scan start time stays in the file's unit; without one it is -1.
    """
    groups = Scratch(spark, "groups").write(param_groups(spark, paths))
    df = _xml(spark, paths, "spectrum", SPECTRUM)
    none = F.array().cast(_CV)
    if groups.isEmpty():
        params = lambda at: F.coalesce(at["cvParam"], none)
    else:
        df = df.join(groups, "filename", "left")
        shared = lambda at: F.flatten(F.transform(at["referenceableParamGroupRef"], lambda r: F.coalesce(F.try_element_at(F.col("groups"), r["_ref"]), none)))
        params = lambda at: F.concat(F.coalesce(at["cvParam"], none), F.coalesce(shared(at), none))
    top = {c: F.col(c) for c in ("cvParam", "referenceableParamGroupRef")}
    df = df.where(F.coalesce(_first(params(top), "ms level").try_cast("int"), F.lit(-1)) > 1)
    ion = params(F.get(F.get(F.col("precursorList.precursor"), F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0)))
    scan = F.get(F.col("scanList.scan"), F.lit(0))
    start = _first(params(scan), "scan start time")
    rt = F.when(start.isNull(), F.lit(-1.0)).otherwise(start.try_cast("double")).cast("float")
    arrays = F.transform("binaryDataArrayList.binaryDataArray", lambda a: F.struct(F.transform(params(a), lambda p: p["_name"]).alias("kinds"), a["binary"].alias("binary")))
    df = df.select(
        F.col("_id").alias("identifier"), _first(ion, "selected ion m/z").try_cast("double").cast("float").alias("precursor_mz"),
        _cv(ion, "charge state", "possible charge state").try_cast("byte").alias("precursor_charge"),
        _peaks(arrays).alias("p"), F.when(scan.isNotNull(), rt).alias("retention_time"), "filename",
    )
    df = df.select("identifier", "precursor_mz", "precursor_charge", zipped_peaks("p").alias("peaks"), "retention_time", "filename")
    bad = F.col("identifier").isNull() | F.col("precursor_mz").isNull() | F.col("peaks").isNull() | F.col("retention_time").isNull()
    return df.withColumn("bad", bad)
