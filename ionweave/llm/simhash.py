"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint is split into blocks; two that differ in at most ``max_bits`` bits
agree on all but so many blocks, so they meet under the key of some choice of
the others. Keys that only one fingerprint has are dropped before anything is
compared, keys with two give one pair, and larger groups go to vectorised tasks
of bounded size which return a forest of the links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Scratch, parts, pick, skewed_join, utf8


def mark() -> F.Column:
    """A hash of a row's text, a null one's that of an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


@dataclass(frozen=True)
class SimSpec:
    """tile: so many fingerprints of a key are compared in one task; larger groups are split into pairs of slices."""

    shingle: int = 4
    seed: int = 42
    max_bits: int = 4
    blocks: int | None = None
    tile: int = 4096


def fingerprint(text: bytes, spec: SimSpec = SimSpec()) -> int:
    """The 64-bit fingerprint of a text: a bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: folds A-Z only and splits at space and 9 to 13 only
    n = len(words)
    if not n:
        return 0
    k = spec.shingle
    joined = b" ".join(words)
    if n <= k:
        hashes = [xxhash.xxh64_intdigest(joined, spec.seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        one, seed = xxhash.xxh64_intdigest, spec.seed
        hashes = [one(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())]
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, spec: SimSpec = SimSpec()) -> DataFrame:
    """doc_id, mark (of the text, tells rows of one id apart) and fp (long: the fingerprint's bits) for each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            data, offs = utf8(batch.column("text"))
            raw, at = data.tobytes(), offs.tolist()
            found = np.array([fingerprint(raw[a:b], spec) for a, b in zip(at, at[1:])], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(found.view(np.int64))], names=["doc_id", "mark", "fp"])

    return pick(docs, "doc_id", "text").withColumn("mark", mark()).mapInArrow(run, "doc_id long, mark long, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Bit masks of all choices of blocks - max_bits blocks, as signed longs."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edge)]
    masks = [sum(c) for c in itertools.combinations(each, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def choose_blocks(n: int, max_bits: int) -> int:
    """The fewest blocks whose keys have about two bits more than it takes to number n fingerprints."""
    need = max(20, int(n).bit_length() + 2)
    for m in range(max_bits + 2, max_bits + 9):
        if 64 * (m - max_bits) / m >= need:
            return m
    return max_bits + 8


def _forest(x: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (member, root) that join those of x which steps of at most max_bits bits connect."""
    out, rest = [], np.unique(x)
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= max_bits
            if near.any():
                hit = rest[near]
                out += [(int(h), int(root)) for h in hit]
                queue += list(hit)
                rest = rest[~near]
    return out


def links(nodes: DataFrame, scratch: Scratch, spec: SimSpec = SimSpec()) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that have the same components as all links."""
    m = spec.blocks or choose_blocks(nodes.count(), spec.max_bits)
    keys = nodes.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(block_masks(m, spec.max_bits))])).alias("key"))
    met = scratch.write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= spec.max_bits
    pairs = met.where("n = 2").where(close).select("u", "v")
    many = skewed_join(keys, met.where("n > 2").select("key", "n"), ["key"])
    many = many.withColumn("s", F.ceil(F.col("n") / spec.tile).cast("int")).withColumn("i", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("s").cast("long")).cast("int"))
    tiles = many.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select("key", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None  # a tile may go on in the next batch; it has two slices at most
        seen: set[tuple[int, int]] = set()

        def forests(tag: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            out = []
            for part in np.split(fp, np.flatnonzero((tag[1:] != tag[:-1]).any(axis=1)) + 1):
                out += [e for e in _forest(part, spec.max_bits) if e not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(out)
            return list(dict.fromkeys(out))

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], names=["u", "v"])

        for batch in batches:
            tag = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")], axis=1)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if held is not None:
                tag, fp = np.concatenate([held[0], tag]), np.concatenate([held[1], fp])
            if not len(fp):
                continue
            cut = len(fp) - int((tag[::-1] == tag[-1]).all(axis=1).argmin() or len(fp))
            held = (tag[cut:], fp[cut:])
            if cut:
                yield batch_of(forests(tag[:cut], fp[:cut]))
        if held is not None and len(held[1]):
            yield batch_of(forests(*held))

    grown = tiles.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")
    return pairs.unionByName(grown)


def near_groups(docs: DataFrame, spec: SimSpec = SimSpec()) -> DataFrame:
    """doc_id, mark, fp, root, component_id for each row: component_id is the smallest doc_id that links reach, itself included.

    Equal fingerprints are linked. A text without words, or null, has fingerprint
    zero, which is linked like any other; with fewer words than a shingle takes, the
    whole sequence is one shingle. A null doc_id counts for no component; a
    component of such rows only has component_id null, and root, a fingerprint of the component, still
    names it. Repeated rows and texts of any length stay whole; an
    empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, spec))
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, scratch, spec), scratch)
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = scratch.write(placed)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = scratch.write(skewed_join(placed.select("fp", "root"), least, ["root"]).select("fp", "root", "component_id"))
    return skewed_join(prints, ids, ["fp"]).select("doc_id", "mark", "fp", "root", "component_id")


def survivors(groups: DataFrame) -> DataFrame:
    """(doc_id, mark) of one row of each component of :func:`near_groups`: the smallest doc_id, a null one last, then the smallest mark."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    return groups.groupBy("root").agg(first).select("first.doc_id", "first.mark")
