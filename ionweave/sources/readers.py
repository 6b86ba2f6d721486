"""Reading of peak files by extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..schema import SPECTRA
from ..storage import filesystem
from .mgf import read_mgf
from .mzml import read_mzml
from .mzxml import read_mzxml

FORMATS = {".mgf": read_mgf, ".mzml": read_mzml, ".mzxml": read_mzxml}


def file_states(spark: SparkSession, patterns: list[str] | tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files that match the patterns, on any file system Spark knows; a plain name that doesn't exist is an error."""
    found = []
    for pattern in patterns:
        fs, at = filesystem(spark, pattern)
        hits = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.globStatus(at) or []]
        if not hits and not any(c in pattern for c in "*?[{"):
            raise ValueError(f"no such file: {pattern}")
        found += hits
    return found


def expand(spark: SparkSession, patterns: list[str] | tuple[str, ...]) -> list[str]:
    """Paths of the files that match the patterns: see :func:`file_states`."""
    return [path for path, _, _ in file_states(spark, patterns)]


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return name[name.rfind(".") :] if "." in name else ""


def read_spectra(spark: SparkSession, patterns: list[str] | tuple[str, ...], keep_bad: bool = False) -> DataFrame:
    """Spectra of all files, whatever their formats, with absolute file names.

    Records that can't be parsed are left out, or kept with ``bad`` set so that they can be counted.
    Unknown extensions and missing files are a ValueError. No files at all give no rows.
    """
    by_format: dict[str, list[str]] = {}
    for path in expand(spark, patterns):
        kind = extension(path)
        if kind not in FORMATS:
            raise ValueError(f"unknown peak file format: {path}")
        by_format.setdefault(kind, []).append(path)
    if not by_format:
        empty = spark.createDataFrame([], SPECTRA)
        return empty.selectExpr("*", "false as bad") if keep_bad else empty
    df = reduce(DataFrame.unionByName, [FORMATS[k](spark, p) for k, p in by_format.items()])
    return df if keep_bad else df.where("not bad").drop("bad")
