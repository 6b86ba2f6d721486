"""Schemas: spectra as read, as staged, and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PEAK = T.StructType([T.StructField("mz", T.FloatType()), T.StructField("intensity", T.FloatType())])
PEAKS = T.ArrayType(PEAK)
#: What functions that decode peaks return: plain arrays, which Arrow takes from numpy as they are.
PEAK_ARRAYS = T.StructType([T.StructField(n, T.ArrayType(T.FloatType())) for n in ("mz", "intensity")])


def zipped_peaks(arrays: str) -> Column:
    """PEAKS from a column of PEAK_ARRAYS; null where a function found no peaks to decode."""
    return F.arrays_zip(F.col(f"{arrays}.mz").alias("mz"), F.col(f"{arrays}.intensity").alias("intensity")).cast(PEAKS)


#: Spectra as the readers give them.
SPECTRA = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("precursor_mz", T.FloatType()),
        T.StructField("precursor_charge", T.ByteType()),
        T.StructField("peaks", PEAKS),
        T.StructField("retention_time", T.FloatType()),
        T.StructField("filename", T.StringType()),
    ]
)

#: Staged spectra: cleaned, with two parallel arrays of peaks.
STAGED = T.StructType(
    [
        T.StructField("identifier", T.StringType()),
        T.StructField("precursor_mz", T.FloatType()),
        T.StructField("precursor_charge", T.ByteType()),
        T.StructField("mz", T.ArrayType(T.FloatType(), False)),
        T.StructField("intensity", T.ArrayType(T.FloatType(), False)),
        T.StructField("retention_time", T.FloatType()),
        T.StructField("filename", T.StringType()),
    ]
)

RESULT_COLUMNS = ["filename", "spectrum_id", "precursor_charge", "precursor_mz", "retention_time", "cluster"]
