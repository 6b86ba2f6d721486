"""Spectra made from the ``lineitem`` table: a part is a molecule with three replicas of its spectrum."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

PEAKS_SQL = """
with b as (
  select l_partkey pk, l_orderkey ok, explode(array(0, 1, 2)) r, cast(l_extendedprice as double) ep, cast(l_quantity as double) lq from {lineitem}
)
select pk, r, 60.0D + 0.5D * floor((ep - 1600D * floor(ep / 1600D)) / 0.5D) + 0.01D * r as mz,
  max(lq * lq * (1 + 0.05D * r * (ok % 3)) + (ok % 997) * 0.0005D + 0.37D) as intensity
from b where (ok + r) % 11 <> 0 group by 1, 2, 3
"""

#: Settings of the queries on derived spectra; top 20 since these spectra have fewer than 50 peaks.
SETTINGS = Settings(max_peaks_used=20, precursor_tol=(20.0, "ppm"))
TIGHT = replace(SETTINGS, precursor_tol=(8.0, "ppm"))
STRICT = replace(SETTINGS, min_peaks=12, min_mz_range=1100.0)


def raw_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pk, r, mz, intensity), each part in one partition: rows move once, before each is made three."""
    columns = ["l_partkey", "l_orderkey", "l_extendedprice", "l_quantity"]
    return spark.sql(PEAKS_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns).repartition("l_partkey"))


def raw_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each sid: precursor, charge, retention time, names and peaks in order of m/z."""
    peaks = raw_peaks(spark, sf_dir).groupBy("pk", "r").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    peaks = peaks.select((F.col("pk") * 3 + F.col("r")).alias("sid"), "peaks")
    pk, r = F.floor(F.col("sid") / 3), F.col("sid") % 3
    return peaks.select(
        "sid", "peaks", F.when(pk % 7 != 0, pk % 3 + 1).cast("byte").alias("precursor_charge"),
        (400 + (pk % 97) * 0.5 + F.when(r == 0, 0.0).when(r == 1, 0.002).otherwise(0.005)).cast("double").alias("precursor_mz"),
        ((pk * 7) % 3600 + F.when(r == 0, 0).when(r == 1, 9).otherwise(4)).cast("double").alias("retention_time"),
        F.concat(F.lit("f"), r.cast("string"), F.lit(".mgf")).alias("filename"), F.concat(F.lit("s"), pk.cast("string")).alias("identifier"),
    )
