"""Cleaning of spectra: a fixed chain of peak filters with a validity test after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import peaks as P


def process_spectra(spectra: DataFrame, s: Settings = Settings(), judge: bool = True) -> DataFrame:
    """Adds ``valid`` and replaces ``peaks`` by cleaned, scaled ones of unit length (null where not valid).

    judge False: spectra of low quality are cleaned like the others and stay, however few peaks they have.

    Needs the columns peaks (array of (mz, intensity)), precursor_mz and precursor_charge. The m/z
    range is snapped to the fragment tolerance first. One projection: no shuffle and no Python.
    """
    _, low, high = P.get_dim(s.min_mz, s.max_mz, s.fragment_tol)
    kind = dict(spectra.dtypes)["peaks"]
    steps = []
    if s.remove_precursor_tol is not None:
        steps.append(lambda p: P.without_precursor(p, F.col("precursor_mz"), F.col("precursor_charge"), s.remove_precursor_tol))
    if s.min_intensity is not None or s.max_peaks_used is not None:

        def strongest(p: Column) -> Column:
            strong = P.above(p, s.min_intensity or 0.0)
            return strong if s.max_peaks_used is None else P.let(strong, lambda q: P.top_k(q, s.max_peaks_used))

        steps.append(strongest)
    none = F.lit(None).cast(kind)

    def after(p: Column, left: list) -> Column:
        """The cleaned peaks, or null as soon as a step leaves too few."""
        done = P.let(P.scaled(p, s.scaling, s.max_peaks_used), P.unit).cast(kind) if not left else P.let(left[0](p), lambda q: after(q, left[1:]))
        if not judge:
            return done
        return F.when(P.is_valid(p, s.min_peaks, s.min_mz_range), done).otherwise(none)

    clean = P.let(F.array_sort(P.in_range(F.col("peaks"), low, high)), lambda p: after(p, steps))
    # a generator keeps filters on the result from being computed apart from it
    others = [c for c in spectra.columns if c != "peaks"]
    rows = spectra.select(*others, F.explode(F.array(F.struct(clean.alias("peaks")))).alias("__c"))
    return rows.select(*others, F.col("__c.peaks").alias("peaks")).withColumn("valid", F.col("peaks").isNotNull())


def counted(processed: DataFrame) -> DataFrame:
    """Numbers of spectra kept and of those of low quality."""
    return processed.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_low_quality"))
