"""Hierarchical clustering in blocks, refinement by precursor m/z and retention time, medoids and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, numbered
from . import kernels, scoring
from .graph import components
from .kernels import linkage_cut, medoids, refine
from .similarity import blocks_in, by_block, flat, peaks_in

MIN_SAMPLES = 2
#: A block with more pairs is split into the connected components of its close pairs before its pairs are gathered.
MANY_PAIRS = 1_000_000


def cluster_blocks(
    spectra: DataFrame, pairs: DataFrame, linkage: str = "complete", threshold: float = 0.1,
    tol: float | None = 20.0, unit: str = "ppm", rt_tol: float | None = None,
) -> DataFrame:
    """(sid, cluster, is_representative): cluster is the smallest sid in it; each spectrum alone is a cluster, and its own medoid.

    spectra: block_id, sid, precursor_mz, retention_time. pairs: those of
    :func:`ionweave.operators.similarity.pair_scores`. Blocks without a pair within the threshold
    never leave the JVM; of others one row with arrays goes to Python, many to a batch.
    A block with many pairs is first split into the connected components of its pairs within the threshold,
    which linkage never crosses, and only pairs inside one are gathered: a task's memory holds a
    component's pairs and its square of distances. For a threshold of 1 a block is one component. tol None: no refinement.
    """
    scratch = Scratch(spectra.sparkSession, "pairs")
    pairs = scratch.write(pairs.select("block_id", "s1", "s2", "distance"))  # read twice, and a table tells how large it is
    rows = spectra.select("block_id", "sid", F.col("precursor_mz").cast("double").alias("mz"), F.coalesce("retention_time", F.lit(-1.0)).cast("double").alias("rt"))
    rows, pairs = rows.withColumn("part", F.lit(-1).cast("long")), pairs.withColumn("part", F.lit(-1).cast("long"))
    if threshold < 1:
        large = scratch.write(pairs.groupBy("block_id").count().where(F.col("count") > MANY_PAIRS).select("block_id"))
        if not large.isEmpty():
            rows, pairs = _by_components(rows, pairs, large, threshold, scratch)
    near = pairs.groupBy("block_id", "part").agg(F.min("distance").alias("least"), *[F.collect_list(c).alias(c) for c in ("s1", "s2", "distance")])
    near = near.where(F.col("least") <= threshold) if threshold < 1 else near
    members = rows.groupBy("block_id", "part").agg(*[F.collect_list(c).alias(c) for c in ("sid", "mz", "rt")])
    both = members.join(near.drop("least"), ["block_id", "part"], "left")
    busy = both.where(F.col("s1").isNotNull() & (F.size("sid") > 1)) if threshold < 1 else both.where(F.size("sid") > 1)
    idle = both.where(F.col("s1").isNull() | (F.size("sid") < 2)) if threshold < 1 else both.where(F.size("sid") < 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, at = flat(batch.column("sid"))
            mz, rt = flat(batch.column("mz"))[0], flat(batch.column("rt"))[0]
            s1, to = flat(batch.column("s1"))
            s2, dist = flat(batch.column("s2"))[0], flat(batch.column("distance"))[0]
            ids, labels, heads = [], [], []
            for k in range(batch.num_rows):
                m = slice(at[k], at[k + 1])
                order = np.argsort(sid[m])
                own = sid[m][order]
                e = slice(to[k], to[k + 1])
                a, b = np.searchsorted(own, s1[e]), np.searchsorted(own, s2[e])
                d = np.asarray(dist[e], np.float64)
                found = linkage_cut(len(own), a, b, d, linkage, threshold)
                if tol is not None:
                    found = refine(found, mz[m][order], rt[m][order], tol, unit != "Da", rt_tol)
                ids.append(own)
                labels.append(own[found])
                heads.append(medoids(found, a, b, d))
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (ids, labels, heads)], names=["sid", "cluster", "is_representative"])

    merged = busy.select("sid", "mz", "rt", "s1", "s2", "distance").mapInArrow(run, "sid long, cluster long, is_representative boolean")
    alone = idle.select(F.explode("sid").alias("sid")).select("sid", F.col("sid").alias("cluster"), F.lit(True).alias("is_representative"))
    return merged.unionByName(alone)


def _linked(p: scoring.Peaks, fragment_tol: float, min_matches: int, linkage: str, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs a < b and distances that clusters and medoids of a block depend on.

    Those are the pairs within the threshold; unless linkage is complete, also the others inside a connected component of
    these, which a second pass over the spectra of such components finds. For a threshold of 1 all pairs.
    """

    def found(q: scoring.Peaks, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [(a[k], b[k], d[k]) for a, b, _, d in scoring.distances(q, fragment_tol, min_matches) for k in [keep(a, b, d)]]
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    a, b, d = found(p, lambda a, b, d: d <= threshold if threshold < 1 else np.ones(len(d), bool))
    if threshold >= 1 or linkage == "complete":
        return a, b, d
    label = kernels.components(p.n, a, b)
    chosen = np.flatnonzero(np.bincount(label, minlength=p.n)[label] > 2)
    if not len(chosen):
        return a, b, d
    of = label[chosen]
    small = ~np.isin(a, chosen)
    i, j, e = found(p.of(chosen), lambda i, j, _: of[i] == of[j])
    return np.concatenate((a[small], chosen[i])), np.concatenate((b[small], chosen[j])), np.concatenate((d[small], e))


def score_blocks(
    spectra: DataFrame, fragment_tol: float, min_matches: int = 0, linkage: str = "complete", threshold: float = 0.1,
    tol: float | None = 20.0, unit: str = "ppm", rt_tol: float | None = None,
) -> DataFrame:
    """As :func:`cluster_blocks`, with block_id, of the pairs that :func:`ionweave.operators.similarity.pair_scores` finds, which are never written or moved.

    A task holds a block's peaks and its pairs within the threshold, or, with another than complete linkage,
    the pairs inside their connected components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            own, peaks = peaks_in(block)
            at = block.column("block_id")[0].as_py()
            first = np.unique(block.column("sid").to_numpy(), return_index=True)[1]
            a, b, d = _linked(peaks, fragment_tol, min_matches, linkage, threshold)
            labels = linkage_cut(len(own), a, b, d, linkage, threshold)
            if tol is not None:
                labels = refine(labels, block.column("mz").to_numpy()[first], block.column("rt").to_numpy()[first], tol, unit != "Da", rt_tol)
            heads = medoids(labels, a, b, d)
            yield pa.record_batch([pa.array(x) for x in (own, np.full(len(own), at), own[labels], heads)], names=["sid", "block_id", "cluster", "is_representative"])

    rows = by_block(spectra, "sid", F.col("precursor_mz").cast("double").alias("mz"), F.coalesce("retention_time", F.lit(-1.0)).cast("double").alias("rt"))
    return rows.mapInArrow(run, "sid long, block_id long, cluster long, is_representative boolean")


def _by_components(rows: DataFrame, pairs: DataFrame, large: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows and pairs with ``part``: in large blocks the smallest sid of the component (pairs between two components go), else -1."""
    hot = pairs.join(large, "block_id", "left_semi")
    root = scratch.write(components(hot.where(F.col("distance") <= threshold).select(F.col("s1").alias("u"), F.col("s2").alias("v")), scratch))
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    inside = hot.join(of("s1"), "s1").join(of("s2"), "s2").where("root_s1 = root_s2").withColumn("part", F.col("root_s1"))
    placed = rows.join(large, "block_id", "left_semi").join(of("sid"), "sid", "left").withColumn("part", F.coalesce("root_sid", "sid"))
    keep = ["block_id", "s1", "s2", "distance", "part"]
    rest = lambda df: df.join(large, "block_id", "left_anti")
    return rest(rows).unionByName(placed.select(*rows.columns)), rest(pairs).select(*keep).unionByName(inside.select(*keep))


def global_labels(clustered: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, cluster, is_representative) with clusters of two and more numbered 0, 1, 2 ..., then the single ones.

    clustered has block_id besides; numbers go by charge and block, where a cluster's first sid breaks ties.
    """
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("b"))
    keys = numbered(sizes.withColumn("alone", F.col("n") < MIN_SAMPLES), [F.col("alone"), F.col("b"), F.col("cluster")], "label", scratch)
    return clustered.join(keys.select("cluster", "label"), "cluster").select("sid", F.col("label").cast("long").alias("cluster"), "is_representative")


def summary(clustered: DataFrame) -> DataFrame:
    """One row: spectra, clusters of two and more, spectra in them, spectra alone, all labels."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") >= MIN_SAMPLES
    return sizes.agg(
        F.sum("n").alias("n_spectra"), F.count_if(many).alias("n_clusters"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_clustered"),
        F.count_if(~many).alias("n_single"), F.count(F.lit(1)).alias("n_labels"),
    )
