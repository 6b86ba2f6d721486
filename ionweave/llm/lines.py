"""Line dedup that can be undone: sharded cuckoo filters before exact reference counts.

An index holds, for each line key, how many documents hold it and the largest of
them (exact, by 128-bit digests of whole keys), the list of (key, document) pairs
that counts come from, and a cuckoo filter for each shard of keys. Documents that
come in ask the filters first: a key that no filter knows is new and is counted
without reading the exact table; only the others are joined with it, and those that
it doesn't have either (false positives) are put into the filters after all, so that
every live key has a tag of its own. Deleting documents lowers the counts, finds the next largest document where that one went,
and takes keys that nobody holds out of the filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, parts, pick, skewed_join, utf8

BLANK = b" \t\n\v\f\r"
NO_ID = -(1 << 63)
PAIRS = "doc_id long, key binary"


@dataclass(frozen=True)
class LineSpec:
    """min_chars: shorter keys are never dropped. min_docs: so many documents make a key common. shard_keys: about so many keys a shard.

    batches, returned: how :func:`dedup_lines` fills an index (one in ``returned`` documents leaves and comes back; 0: none).
    """

    min_chars: int = 20
    min_docs: int = 3
    shard_keys: int = 50_000
    tag_bits: int = 16
    batches: int = 2
    returned: int = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A digest of the stripped, A-Z folded line; none if it has too few code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_pairs(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """Distinct (doc_id, key) of each row; a null id is one document of its own, the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            data, offs = utf8(batch.column("text"))
            raw, at = data.tobytes(), offs.tolist()
            ids, keys = [], []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:]):
                own = {line_key(x, spec.min_chars) for x in raw[a:b].split(b"\n")} - {None}
                ids += [NO_ID if doc is None else doc] * len(own)
                keys += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return pick(docs, "doc_id", "text").mapInArrow(run, PAIRS)


class Cuckoo:
    """A cuckoo filter: two buckets of four tags of 16 bits at most for a key; it can forget keys, and grows when full."""

    def __init__(self, bits: int = 10, tags: np.ndarray | None = None, tag_bits: int = 16):
        self.bits, self.tag_bits = bits, tag_bits
        self.tags = np.zeros((1 << bits, 4), np.uint16) if tags is None else tags

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        return cls(blob[0], np.frombuffer(blob, "<u2", offset=2).reshape(-1, 4).copy(), blob[1])

    def dump(self) -> bytes:
        return bytes([self.bits, self.tag_bits]) + self.tags.astype("<u2").tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag and both buckets of keys, given as two 64-bit halves each."""
        tag = (keys[:, 0] >> np.uint64(64 - self.tag_bits)).astype(np.uint16)
        tag[tag == 0] = 1
        mask = np.uint64((1 << self.bits) - 1)
        one = keys[:, 1] & mask
        return tag, one.astype(np.int64), self._other(one, tag)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return ((bucket.astype(np.uint64) ^ (tag.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self._place(keys)
        return (self.tags[a] == tag[:, None]).any(axis=1) | (self.tags[b] == tag[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; False if there was no room (then it must be built anew, larger)."""
        tag, a, b = self._place(keys)
        todo = np.arange(len(tag))
        for bucket in (a, b):  # as many as find a free place in their bucket, all at once
            order = todo[np.argsort(bucket[todo], kind="stable")]
            at = bucket[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            taken = self.tags != 0
            fits = rank < 4 - taken.sum(axis=1)[at]
            free = np.argsort(taken, axis=1, kind="stable")
            self.tags[at[fits], free[at[fits], rank[fits]]] = tag[order[fits]]
            todo = np.sort(order[~fits])
        rng = np.random.default_rng(len(todo))
        for t, at in zip(tag[todo].tolist(), b[todo].tolist()):
            for _ in range(500):
                slot = np.flatnonzero(self.tags[at] == 0)
                if len(slot):
                    self.tags[at, slot[0]] = t
                    break
                k = int(rng.integers(4))
                out = int(self.tags[at, k])
                self.tags[at, k] = t
                t, at = out, int(self._other(np.array([at]), np.array([out]))[0])
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Forgets keys that were inserted once each."""
        tag, a, b = self._place(keys)
        for t, i, j in zip(tag.tolist(), a.tolist(), b.tolist()):
            for at in (i, j):
                slot = np.flatnonzero(self.tags[at] == t)
                if len(slot):
                    self.tags[at, slot[0]] = 0
                    break


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _built(keys: np.ndarray, at_least: int = 0, tag_bits: int = 16) -> Cuckoo:
    bits = max(4, int(np.ceil(np.log2(max(1, max(len(keys), at_least)) / 4 / 0.8))))
    while True:
        made = Cuckoo(bits, tag_bits=tag_bits)
        if made.insert(keys):
            return made
        bits += 1


class LineIndex:
    """Counts, pairs and filters of the documents inserted so far, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, shards: int, spec: LineSpec = LineSpec()):
        self.spark, self.shards, self.spec = spark, shards, spec
        self.scratch = Scratch(spark, "lines")
        self.pairs = spark.createDataFrame([], PAIRS)
        self.counts = spark.createDataFrame([], "key binary, n long, top long")
        self.filters = spark.createDataFrame([], "shard int, filter binary")
        self.empty = True

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def _swap(self, name: str, df: DataFrame) -> None:
        old = getattr(self, name)
        setattr(self, name, self.scratch.write(df))
        self.scratch.drop(old)

    def _filtered(self, keys: DataFrame, gone: bool, all_new: bool = False) -> DataFrame:
        """(shard, key, known, filter): whether the filters knew each key, and the filters with the unknown keys put in (all_new: all keys; gone: taken out).

        keys are distinct, so shards are even however often a line occurs.
        """

        tag_bits, batches = self.spec.tag_bits, max(1, self.spec.batches)

        def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            at = int((new if len(new) else old)["shard"].iloc[0])
            keys = sorted(bytes(k) for k in new["key"])
            h = _halves(keys)
            known = np.zeros(len(keys), bool)
            own = Cuckoo.load(bytes(old["filter"].iloc[0])) if len(old) else None
            if own is not None and len(keys):
                known = own.has(h)
            if gone:
                own.remove(h)
                blob = own.dump()
            elif own is None:
                blob = _built(h, batches * len(h), tag_bits).dump()  # room for the batches to come: none of them finds it full
            else:
                blob = own.dump() if own.insert(h if all_new else h[~known]) else None  # None: full
            rows = pd.DataFrame({"shard": at, "key": keys, "known": known, "filter": None})
            return pd.concat([rows, pd.DataFrame({"shard": [at], "key": [None], "known": [False], "filter": [blob if blob is not None else b""]})])

        new = self._shard(keys.select("key")).groupBy("shard")
        return new.cogroup(self.filters.groupBy("shard")).applyInPandas(run, "shard int, key binary, known boolean, filter binary")

    def _rebuilt(self, shards: DataFrame) -> DataFrame:
        """Filters of shards that were full, from their exact keys."""

        tag_bits = self.spec.tag_bits

        def run(own: pd.DataFrame) -> pd.DataFrame:
            keys = _halves(sorted(bytes(k) for k in own["key"]))
            return pd.DataFrame({"shard": [int(own["shard"].iloc[0])], "filter": [_built(keys, 2 * len(keys), tag_bits).dump()]})

        return self._shard(self.counts.select("key")).join(shards.select("shard"), "shard", "left_semi").groupBy("shard").applyInPandas(run, "shard int, filter binary")

    def insert(self, docs: DataFrame) -> None:
        """Counts these documents' lines; what the index already has of a document isn't counted twice."""
        pairs = line_pairs(docs, self.spec).distinct()
        if not self.empty:
            pairs = pairs.join(self.pairs, ["doc_id", "key"], "left_anti")
        pairs = self.scratch.write(pairs)
        delta = self.scratch.write(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")))
        asked = self.scratch.write(self._filtered(delta, gone=False))
        blobs = asked.where("key is null").select("shard", "filter")
        if self.empty:
            self.pairs, self.counts, self.empty = pairs, delta, False
            self._swap("filters", blobs)
            self.scratch.drop(asked)
            return
        met = asked.where("key is not null").select("key", "known")
        fresh = delta.join(met.where("not known"), "key", "left_semi")
        maybe = delta.join(met.where("known"), "key", "left_semi").select("key", F.col("n").alias("m"), F.col("top").alias("t"))
        # As a table: it is read when counts are another one.
        missed = self.scratch.write(maybe.join(self.counts, "key", "left_anti").select("key"))
        merged = self.counts.join(maybe, "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("top", "t").alias("top"))
        self._swap("counts", fresh.unionByName(merged))
        self._swap("pairs", self.pairs.unionByName(pairs))
        kept = self.filters.join(blobs, "shard", "left_anti").unionByName(blobs.where("length(filter) > 0"))
        self._swap("filters", kept.unionByName(self._rebuilt(blobs.where("length(filter) = 0"))))
        # Shards that were built anew have these keys; in the others they still lack a tag.
        missing = self._shard(missed).join(blobs.where("length(filter) = 0").select("shard"), "shard", "left_anti")
        if not missing.isEmpty():
            late = self.scratch.write(self._filtered(missing, gone=False, all_new=True).where("key is null").select("shard", "filter"))
            self._swap("filters", late.where("length(filter) > 0").unionByName(self._rebuilt(late.where("length(filter) = 0"))))
            self.scratch.drop(late)
        for table in (asked, delta, pairs, missed):
            self.scratch.drop(table)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents with these doc_ids out again, as if they had never been inserted."""
        ids = pick(ids, "doc_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct()
        gone = self.scratch.write(self.pairs.join(ids, "doc_id", "left_semi"))
        self._swap("pairs", self.pairs.join(ids, "doc_id", "left_anti"))
        less = gone.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("doc_id").alias("t"))
        changed = self.scratch.write(self.counts.join(less, "key").select("key", (F.col("n") - F.col("m")).alias("n"), "top", "t"))
        next_top = skewed_join(self.pairs, changed.where("n > 0 and top = t").select("key"), ["key"], "left_semi").groupBy("key").agg(F.max("doc_id").alias("next"))
        live = changed.where("n > 0").join(next_top, "key", "left").select("key", "n", F.when(F.col("top") == F.col("t"), F.col("next")).otherwise(F.col("top")).alias("top"))
        self._swap("counts", self.counts.join(changed, "key", "left_anti").unionByName(live))
        dead = self._filtered(changed.where("n <= 0"), gone=True).where("key is null").select("shard", "filter")
        self._swap("filters", dead)
        self.scratch.drop(changed)
        self.scratch.drop(gone)

    def dropped(self) -> DataFrame:
        """doc_id and the keys whose lines that document loses."""
        common = self.counts.where(F.col("n") >= self.spec.min_docs).select("key", "top")
        lost = skewed_join(self.pairs, common, ["key"]).where("doc_id <> top")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def shards_for(n_docs: int, spec: LineSpec = LineSpec()) -> int:
    return max(4, -(-n_docs * 12 // spec.shard_keys))


def apply_drops(docs: DataFrame, lost: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (lines that stay) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            data, offs = utf8(batch.column("text"))
            raw, at = data.tobytes(), offs.tolist()
            out = []
            for a, b, keys in zip(at, at[1:], batch.column("keys").to_pylist()):
                lines = raw[a:b].split(b"\n")
                keys = set(keys or ())
                kept = [x for x in lines if line_key(x, spec.min_chars) not in keys] if keys else lines
                out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            n, d, t = zip(*out)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(t, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    rows = pick(docs, "doc_id", "text")
    lost = lost.withColumnRenamed("doc_id", "__id")
    rows = rows.join(lost, F.coalesce(rows["doc_id"], F.lit(NO_ID)) == lost["__id"], "left").select("doc_id", "text", "keys")
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def dedup_lines(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """Drops common lines everywhere but in the largest doc_id that holds them: see :func:`apply_drops` for columns.

    The documents come into a :class:`LineIndex` in batches, so the filters tell the lines of
    a later batch that are new from those to be joined with the counts. Then some
    documents are taken out and put in again, which leaves the counts as if they had stayed: the
    result is that of one pass over all documents, by way of insertion and deletion.

    A null or empty text is one empty line. Rows that share a doc_id are one
    document when it comes to counting, and lose the same keys; null ids are one
    document, the smallest. A text of any length is held whole by the task that
    splits it. An empty table gives an empty one; other columns are ignored.
    """
    rows = pick(docs, "doc_id", "text")
    index = LineIndex(docs.sparkSession, shards_for(rows.count(), spec), spec)
    dealt = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(max(1, spec.batches)))
    for batch in range(max(1, spec.batches)):
        index.insert(rows.where(dealt == batch))
    if spec.returned:
        some = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(spec.returned)) == 0)
        index.delete(some)
        index.insert(some)
    return apply_drops(rows, index.dropped(), spec)
