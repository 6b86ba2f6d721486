"""From peak files to clusters: read, clean, stage, block, score, cluster, label, write."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import blocking, clustering, preprocess
from ..sinks import writers
from ..sources.readers import file_states, read_spectra
from ..storage import Scratch, shared_dir

log = logging.getLogger("ionweave")
KEY = ["filename", "identifier", "sid"]


def prepare(spark: SparkSession, s: Settings, path: str) -> dict[str, int]:
    """Reads, cleans and stages the spectra; returns how many were kept, of low quality, and unreadable."""
    raw = read_spectra(spark, s.input_filenames, keep_bad=True)
    done = preprocess.process_spectra(raw, s)
    from pyspark.sql import Observation

    seen = Observation("spectra")
    kept = F.col("valid") & ~F.col("bad")
    done = done.observe(seen, F.count_if(kept).alias("n_valid"), F.count_if(~F.col("bad") & ~F.col("valid")).alias("n_low_quality"), F.count_if("bad").alias("n_bad"))
    writers.stage(done.where(kept), path, "overwrite")
    return seen.get


def score_and_cluster(spectra: DataFrame, s: Settings = Settings(), key: list[str] | None = None) -> DataFrame:
    """Adds block_id, cluster (smallest sid in it) and is_representative to cleaned spectra with a ``sid``, which must stay the same when read again."""
    tol, unit = s.precursor_tol
    blocked = blocking.with_blocks(spectra, tol, unit, s.batch_size, key or KEY, s.exempt_last_block)
    found = clustering.score_blocks(blocked, s.fragment_tol, s.min_matched_peaks, s.linkage, s.distance_threshold, tol, unit, s.rt_tol)
    return spectra.join(found, "sid")


def cluster_spectra(spectra: DataFrame, s: Settings = Settings(), key: list[str] | None = None) -> DataFrame:
    """Cleaned spectra with dense integer clusters and is_representative."""
    scratch = Scratch(spectra.sparkSession, "clusters")
    placed = scratch.write(score_and_cluster(spectra, s, key).select("sid", "block_id", "cluster", "is_representative"))
    return spectra.join(clustering.global_labels(placed, scratch), "sid")


def run(spark: SparkSession, s: Settings) -> int:
    """A whole run by settings: 0, or 1 where results exist and may not be overwritten."""
    outputs = [f"{s.output_filename}.csv", f"{s.output_filename}.mgf"]
    here = [o for o in outputs if writers.exists(spark, o)]
    for o in here:
        if not s.overwrite:
            log.error("%s exists", o)
            return 1
    for o in here:
        log.warning("%s is overwritten", o)
        writers.delete(spark, o)
    work = s.work_dir or f"{shared_dir(spark)}/ionweave/staged-{uuid.uuid4().hex}"
    path = f"{work}/spectra/{s.staging_key(file_states(spark, s.input_filenames))}"
    if s.overwrite and writers.exists(spark, f"{work}/spectra"):
        writers.delete(spark, f"{work}/spectra")
    if writers.exists(spark, f"{path}/_SUCCESS"):
        log.info("staged spectra are reused")
    else:
        counts = prepare(spark, s, path)
        log.info("%d spectra staged, %d of low quality, %d unreadable", counts["n_valid"], counts["n_low_quality"], counts["n_bad"])
    spectra = writers.read_stage(spark, path)
    scratch = Scratch(spark, "run")
    done = scratch.write(cluster_spectra(spectra, s).withColumnRenamed("identifier", "spectrum_id"))
    log.info("%s", clustering.summary(done.select("sid", "cluster")).first())
    writers.write_cluster_csv(done, outputs[0], s, single=not s.parts)
    if s.export_representatives:
        heads = done.where("is_representative").withColumnRenamed("spectrum_id", "identifier")
        writers.write_spectra(heads.orderBy("cluster"), outputs[1], single=not s.parts)
    if s.work_dir is None:
        writers.delete(spark, work)
    return 0
