"""Spectra as binned vectors, and their random projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.peaks import bin_of


def bin_vectors(spectra: DataFrame, min_mz: float, bin_size: float, sid: str = "sid") -> DataFrame:
    """(sid, bin, value): intensities of a spectrum's peaks added up by bin of m/z."""
    peaks = spectra.select(F.col(sid).alias("sid"), F.explode("peaks").alias("p"))
    return peaks.select("sid", bin_of(F.col("p.mz"), min_mz, bin_size).cast("long").alias("bin"), F.col("p.intensity").cast("double").alias("x")).groupBy("sid", "bin").agg(F.sum("x").alias("value"))


def project(vectors: DataFrame, transformation: DataFrame, norm: bool = True) -> DataFrame:
    """(sid, dim, value): vectors times a sparse matrix given as (bin, dim, weight) rows; norm: to unit length."""
    out = vectors.join(transformation, "bin").groupBy("sid", "dim").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    if not norm:
        return out
    length = out.groupBy("sid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l"))
    return out.join(length, "sid").select("sid", "dim", F.when(F.col("l") > 0, F.col("value") / F.col("l")).otherwise(F.col("value")).alias("value"))


def random_projection(bins: DataFrame, dims: int, seed: int = 42) -> DataFrame:
    """(bin, dim, weight): for each bin one sign in each of a few dimensions, chosen by an MD5 of seed, bin and number, the same in each run."""
    k = max(1, round(dims**0.5))
    pick = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("r")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bin").cast("string"), F.col("r").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    rows = bins.select("bin").distinct().select("bin", pick).select("bin", F.pmod(h, F.lit(dims)).cast("int").alias("dim"), F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0).alias("w"))
    return rows.groupBy("bin", "dim").agg((F.sum("w") / F.lit(float(k) ** 0.5)).alias("weight"))
