"""Substring dedup with fixed-block anchors.

Every document is a reference: its non-overlapping blocks of words, from its
first word on, are indexed by hash. Every rolling window of a block's length, of
every document, probes the index. A repeat of ``window`` words holds a whole
block of the reference, so each repeat has a hit (an anchor). Anchors are
extended on both sides: all windows of ``window`` words around an anchor, in the
document that was hit as in the one that hit, are compared by 128-bit hashes, and
overlapping windows that agree join to maximal exact repeats. Nothing is removed but by such windows.

Documents are dealt once into chunks (compressed). A chunk sends each hash once,
however many of its documents have it, with the smallest of them: some three bytes a word
for probes, some seventeen for a window around an anchor. So a passage that a third of all documents
share is one entry a chunk. No pairs are made: a bucket keeps the smallest document for each hash.

Chunks meet in buckets of hashes by way of a tree: ``fan`` chunks at most are merged in each of ``fan`` ranges of
hashes, and what is left of these goes on to the ranges of the next level in the same form. A chunk or a merged
group makes ``fan`` rows at most, so rows grow with the corpus and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parts, pick, tidy, utf8
from .words import window_hashes, word_hashes, words

_TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class RepeatSpec:
    """window: words of a repeat. chunk_bytes: about so much text is worked on at once. fan: so many chunks or groups are merged at once, in so many ranges of hashes."""

    window: int = 50
    chunk_bytes: int = 8 << 20
    flush_bytes: int = 48 << 20
    fan: int = 2048

    @property
    def block(self) -> int:
        """The longest block of which each window holds a whole one, wherever it begins."""
        return (self.window + 1) // 2


def pack(a: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as those of their byte planes that aren't all zero."""
    d = a.astype("<u8").view(np.uint8).reshape(-1, 8)
    used = np.flatnonzero(d.any(axis=0))
    mask = int((1 << used).sum()) if len(used) else 0
    return mask.to_bytes(1, "little") + len(a).to_bytes(8, "little") + d[:, used].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    mask, n = blob[0], int.from_bytes(blob[1:9], "little")
    used = [i for i in range(8) if mask >> i & 1]
    d = np.zeros((n, 8), np.uint8)
    d[:, used] = np.frombuffer(blob, np.uint8, offset=9).reshape(len(used), n).T
    return d.reshape(-1).view("<u8")


def squeeze(a: np.ndarray) -> bytes:
    """Ascending 64-bit integers, packed by their differences."""
    return pack(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def expand(blob: bytes) -> np.ndarray:
    """What :func:`squeeze` packed, as unsigned 64-bit integers."""
    return np.cumsum(unpack(blob), dtype=np.uint64)


def _bundles(docs: DataFrame, chunks: int, spec: RepeatSpec) -> DataFrame:
    """(chunk, blob): the documents of a chunk from one task, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("chunk")
            chunk = table["chunk"].to_numpy()
            ends = np.append(np.flatnonzero(np.diff(chunk)) + 1, len(chunk))
            blobs, a = [], 0
            for b in ends.tolist():
                sink = pa.BufferOutputStream()
                part = table.slice(a, b - a).select(["doc_id", "text"]).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_table(part)
                blobs.append(press.compress(sink.getvalue()))
                a = b
            return pa.record_batch([pa.array(chunk[ends - 1], pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

        for batch in parts(batches, "text"):
            held.append(batch)
            size += batch.nbytes
            if size >= spec.flush_bytes:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    rows = pick(docs, "doc_id", "text")
    # the partition is in it so that rows that repeat an id and its text don't share one chunk
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int"))
    return rows.mapInArrow(run, "chunk int, blob binary")


class Chunk:
    """A chunk's documents in a fixed order, and their words: hash, document, place in it."""

    def __init__(self, blobs: list[bytes]):
        tables = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(bytes(b))).read_all() for b in blobs]
        table = pa.concat_tables(tables)
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else None
        given = table["doc_id"].to_pylist() if ids is None else None
        key = (ids if ids is not None else np.array([-(1 << 63) if x is None else x for x in given], np.int64)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        if len(same):  # rows that share an id: their texts settle the order
            texts = table["text"].to_pylist()
            order = np.array(sorted(range(len(key)), key=lambda i: (key[i], texts[i] or "")))
        table = table.take(order)
        self.null = np.array(table["doc_id"].is_null().to_pylist(), bool) if given else np.zeros(len(key), bool)
        self.ids = key[order]
        self.rank = self.ids.view(np.uint64) ^ _TOP  # unsigned, in the order of ids
        self.data, self.offs = utf8(table["text"])
        high, low, docs = [], [], []
        i, n = 0, len(self.ids)
        while i < n:  # a few MB at a time
            j = max(i + 1, int(np.searchsorted(self.offs, self.offs[i] + (2 << 20), side="right")) - 1)
            part, at = self.data[self.offs[i] : self.offs[j]], self.offs[i : j + 1] - self.offs[i]
            starts, ends, doc = words(part, at)
            for held, h in zip((high, low), word_hashes(part, starts, ends, 2)):
                held.append(h)
            docs.append(doc + i)
            i = j
        self.hash = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (high, low)]
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1])) if n else np.zeros(0, np.int64)

    def starts(self, k: int) -> np.ndarray:
        """Where windows of k words that lie in one document begin."""
        return np.flatnonzero(self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :])

    def hashes(self, k: int, stream: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows of k words that begin there, in order."""
        out, h, step = np.empty(len(at), np.uint64), self.hash[stream], 1 << 18
        for i in range(0, len(h) - k + 1, step):
            a, b = np.searchsorted(at, [i, i + step])
            if b > a:
                out[a:b] = window_hashes(h[i : i + step + k - 1], k)[at[a:b] - i]
        return out


def _runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each entry of arrays sorted together differs from the one before."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return new


def _column(frame: pd.DataFrame, name: str) -> list[bytes]:
    return [bytes(x) for x in frame[name]]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class _Probes:
    """Distinct anchor hashes of a chunk or group: which of them are blocks, of which smallest document, and which stand there more than once."""

    sent = "key binary, own binary, rank binary, many binary"
    answer = "which binary, least binary"

    def __init__(self, key: np.ndarray, held: np.ndarray, least: np.ndarray, many: np.ndarray):
        self.key, self.held, self.least, self.many = key, held, least, many

    @property
    def order_key(self) -> np.ndarray:
        return self.key

    def packed(self, s: slice) -> tuple:
        held = self.held[s]
        return squeeze(self.key[s]), squeeze(np.flatnonzero(held)), pack(self.least[s][held]), squeeze(np.flatnonzero(self.many[s]))

    @classmethod
    def merged(cls, frame: pd.DataFrame) -> tuple[_Probes, list[np.ndarray]]:
        """The group of these rows, and where each row's hashes stand in it."""
        keys = [expand(x) for x in _column(frame, "key")]
        ends = np.cumsum([len(k) for k in keys])
        known, inv = np.unique(_joined(keys), return_inverse=True)
        places = np.split(inv, ends[:-1])
        least, held = np.full(len(known), ~np.uint64(0)), np.zeros(len(known), bool)
        times = np.bincount(inv, minlength=len(known))
        for at, own, rank, many in zip(places, _column(frame, "own"), _column(frame, "rank"), _column(frame, "many")):
            own = at[expand(own).astype(np.int64)]  # hashes of a row are distinct
            held[own] = True
            least[own] = np.minimum(least[own], unpack(rank))
            times[at[expand(many).astype(np.int64)]] += 1
        return cls(known, held, least, times > 1), places

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors, and their smallest documents: a block that only its own window hits is no anchor."""
        return self.held & self.many, self.least

    def read(self, which: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.key), ~np.uint64(0))
        least[which] = _joined([unpack(x) for x in _column(frame, "least")])
        hit = np.zeros(len(self.key), bool)
        hit[which] = True
        return hit, least

    def told(self, at: np.ndarray, answer: tuple[np.ndarray, np.ndarray], row: int) -> tuple | None:
        i = np.flatnonzero(answer[0][at])
        return (squeeze(i), pack(answer[1][at[i]])) if len(i) else None


class _Windows:
    """Distinct windows around anchors of a chunk or group, with the smallest document of each."""

    sent = "high binary, low binary, rank binary"
    answer = "which binary"

    def __init__(self, high: np.ndarray, low: np.ndarray, rank: np.ndarray, ranks: list[np.ndarray] | None = None):
        self.high, self.low, self.rank, self.ranks = high, low, rank, ranks

    @property
    def order_key(self) -> np.ndarray:
        return self.high

    def packed(self, s: slice) -> tuple:
        return squeeze(self.high[s]), self.low[s].astype("<u8").tobytes(), pack(self.rank[s])

    @classmethod
    def merged(cls, frame: pd.DataFrame) -> tuple[_Windows, list[np.ndarray]]:
        highs = [expand(x) for x in _column(frame, "high")]
        ranks = [unpack(x) for x in _column(frame, "rank")]
        high, low, rank = _joined(highs), _joined([np.frombuffer(x, "<u8") for x in _column(frame, "low")]), _joined(ranks)
        order = np.lexsort((rank, low, high))
        new = _runs(high[order], low[order])
        inv = np.empty(len(order), np.int64)
        inv[order] = np.cumsum(new) - 1
        first = order[new]
        return cls(high[first], low[first], rank[first], ranks), np.split(inv, np.cumsum([len(h) for h in highs])[:-1])

    def settled(self) -> np.ndarray:
        return np.zeros(len(self.high), bool)

    def read(self, which: np.ndarray, frame: pd.DataFrame) -> np.ndarray:
        gone = self.settled()
        gone[which] = True
        return gone

    def told(self, at: np.ndarray, answer: np.ndarray, row: int) -> tuple | None:
        """Windows that a smaller document has: in this group, or elsewhere."""
        i = np.flatnonzero(answer[at] | (self.rank[at] < self.ranks[row]))
        return (squeeze(i),) if len(i) else None


def _edges(keys: np.ndarray, bits: int, first: int, n: int, buckets: int) -> np.ndarray:
    """Where each of n buckets from ``first`` on begins in sorted keys of so many bits: all buckets are equal ranges of the top 32."""
    b = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(b, np.arange(first, first + n + 1, dtype=np.uint64))


class _Tree:
    """The levels by which so many chunks meet in buckets."""

    def __init__(self, chunks: int, fan: int, bits: int):
        self.fan, self.bits = fan, bits
        self.radix = []  # buckets that a bucket of the level above is split into
        while chunks > fan:
            self.radix.append(fan)
            chunks = -(-chunks // fan)
        self.radix.append(chunks)

    def rows(self, group: _Probes | _Windows, level: int, bucket: int, source: int) -> list[tuple]:
        """(bucket, source, blobs) of a chunk or group for the buckets of a level, below one of the level above."""
        n = self.radix[level]
        edge = _edges(group.order_key, self.bits if isinstance(group, _Probes) else 64, bucket * n, n, int(np.prod(self.radix[: level + 1])))
        return [(bucket * n + b, source, *group.packed(slice(edge[b], edge[b + 1]))) for b in np.flatnonzero(np.diff(edge)).tolist()]

    def read(self, group: _Probes | _Windows, level: int, bucket: int, frame: pd.DataFrame):
        """What the buckets of a level said about a chunk or group."""
        n = self.radix[level]
        edge = _edges(group.order_key, self.bits if isinstance(group, _Probes) else 64, bucket * n, n, int(np.prod(self.radix[: level + 1])))
        which = [expand(x).astype(np.int64) + edge[b - bucket * n] for b, x in zip(frame["bucket"].tolist(), _column(frame, "which"))]
        return group.read(_joined(which).astype(np.int64), frame)

    def settle(self, rows: DataFrame, kind: type, level: int = 0) -> DataFrame:
        """(bucket, source, answers) for the rows of a level."""
        back = f"bucket int, source int, {kind.answer}"
        names = [c.split()[0] for c in back.split(", ")]

        def told(frame: pd.DataFrame, group, places: list[np.ndarray], answer) -> pd.DataFrame:
            out = []
            for k, (bucket, source, at) in enumerate(zip(frame["bucket"].tolist(), frame["source"].tolist(), places)):
                found = group.told(at, answer, k)
                if found:
                    out.append((bucket, source, *found))
            tidy()
            return pd.DataFrame(out, columns=names)

        def leaf(frame: pd.DataFrame) -> pd.DataFrame:
            group, places = kind.merged(frame)
            return told(frame, group, places, group.settled())

        if level + 1 == len(self.radix):
            return rows.groupBy("bucket").applyInPandas(leaf, back)

        def down(frame: pd.DataFrame) -> pd.DataFrame:
            group, _ = kind.merged(frame)
            rows = self.rows(group, level + 1, int(frame["bucket"].iloc[0]), int(frame["part"].iloc[0]))
            return pd.DataFrame(rows, columns=["bucket", "source", *[c.split()[0] for c in kind.sent.split(", ")]])

        def up(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):
                return pd.DataFrame(columns=names)
            group, places = kind.merged(frame)
            return told(frame, group, places, self.read(group, level + 1, int(frame["bucket"].iloc[0]), found))

        rows = rows.withColumn("part", F.floor(F.col("source") / self.fan).cast("int"))
        below = self.settle(rows.groupBy("bucket", "part").applyInPandas(down, f"bucket int, source int, {kind.sent}"), kind, level + 1)
        below = below.withColumn("above", F.floor(F.col("bucket") / self.radix[level + 1]).cast("int"))
        return rows.groupBy("bucket", "part").cogroup(below.groupBy("above", "source")).applyInPandas(up, back)


def dedup_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """doc_id, n_words, n_removed, text for each row; text is the words that stay, joined by one space.

    A word goes if it is in a window of ``spec.window`` words of one document whose
    word sequence also starts in a document with a smaller doc_id. All windows are
    judged on the input. A null text has no words. A null doc_id is the
    smallest; rows that share a doc_id take nothing from each other. Texts with
    fewer words than a window stay whole. An empty table gives an empty one; other
    columns are ignored.
    """
    spark = docs.sparkSession
    size = pick(docs, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // spec.chunk_bytes))
    block, window = spec.block, spec.window
    bits = min(64, 33 + chunks.bit_length())  # so many that few anchors are chance, however large the corpus
    tree = _Tree(chunks, spec.fan, bits)

    def probes_of(c: Chunk) -> tuple[np.ndarray, np.ndarray, _Probes]:
        """Starts of a chunk's rolling windows by key, which of the distinct keys each has, and these."""
        at = c.starts(block)
        key = c.hashes(block, 0, at) >> np.uint64(64 - bits)
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = _runs(key)
        which, key = np.cumsum(new) - 1, key[new]
        own = (at - c.first[c.doc[at]]) % block == 0
        least, held = np.full(len(key), ~np.uint64(0)), np.zeros(len(key), bool)
        np.minimum.at(least, which[own], c.rank[c.doc[at[own]]])
        held[which[own]] = True
        return at, which, _Probes(key, held, least, np.bincount(which, minlength=len(key)) > 1)

    def windows_of(c: Chunk, found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, _Windows]:
        """Starts of the windows around a chunk's anchors, sorted by hash and then document, which of the distinct ones each is, and these."""
        at, which, group = probes_of(c)
        hit, least = tree.read(group, 0, 0, found)
        at, least = at[hit[which]], least[which[hit[which]]]
        doc = c.doc[at]
        place = at - c.first[doc]
        use = (least < c.rank[doc]) | (place % block == 0)
        at, place = at[use], place[use]
        edge = np.zeros(len(c.doc) + 1, np.int64)
        np.add.at(edge, at - np.minimum(place, window - block), 1)
        np.add.at(edge, at + 1, -1)
        start = c.starts(window)
        start = start[np.cumsum(edge)[:-1][start] > 0]
        high, low = c.hashes(window, 0, start), c.hashes(window, 1, start)
        order = np.lexsort((low, high))  # stable, and documents are in order of their ids
        start, high, low = start[order], high[order], low[order]
        new = _runs(high, low)
        return start, np.cumsum(new) - 1, _Windows(high[new], low[new], c.rank[c.doc[start[new]]])

    def probes(frame: pd.DataFrame) -> pd.DataFrame:
        rows = tree.rows(probes_of(Chunk(_column(frame, "blob")))[2], 0, 0, int(frame["chunk"].iloc[0]))
        tidy()
        return pd.DataFrame(rows, columns=["bucket", "source", "key", "own", "rank", "many"])

    def candidates(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "source", "high", "low", "rank"]
        if not len(right) or not len(left):
            return pd.DataFrame(columns=names)
        rows = tree.rows(windows_of(Chunk(_column(left, "blob")), right)[2], 0, 0, int(left["chunk"].iloc[0]))
        tidy()
        return pd.DataFrame(rows, columns=names)

    def kept(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "text"])
        c = Chunk(_column(left, "blob"))
        out = np.zeros(len(c.doc), bool)
        if len(right):
            anchor = right["least"].notna()
            start, which, group = windows_of(c, right[anchor])
            gone = tree.read(group, 0, 0, right[~anchor])[which]
            gone |= c.rank[c.doc[start]] > group.rank[which]  # in the chunk itself, the smallest document's stays
            edge = np.zeros(len(c.doc) + 1, np.int64)
            np.add.at(edge, start[gone], 1)
            np.add.at(edge, start[gone] + window, -1)
            out = np.cumsum(edge)[:-1] > 0
        removed = np.bincount(c.doc[out], minlength=len(c.ids))
        raw, offs = c.data.tobytes(), c.offs.tolist()
        texts = []
        for i, (a, b) in enumerate(zip(offs, offs[1:])):
            own = raw[a:b].split()
            if removed[i]:
                own = [w for w, g in zip(own, out[c.first[i] : c.first[i] + c.count[i]].tolist()) if not g]
            texts.append(b" ".join(own).decode())
        ids = pd.array(c.ids, dtype="Int64")
        ids[c.null] = pd.NA
        tidy()
        return pd.DataFrame({"doc_id": ids, "n_words": c.count, "n_removed": removed, "text": texts})

    bundles = _bundles(docs, chunks, spec)
    found = bundles.groupBy("chunk").applyInPandas(probes, f"bucket int, source int, {_Probes.sent}")
    anchors = Scratch(spark, "repeats").write(tree.settle(found, _Probes))  # as a table: it is read twice
    found = bundles.groupBy("chunk").cogroup(anchors.groupBy("source")).applyInPandas(candidates, f"bucket int, source int, {_Windows.sent}")
    gone = tree.settle(found, _Windows).select("bucket", "source", "which", F.lit(None).cast("binary").alias("least"))
    return bundles.groupBy("chunk").cogroup(anchors.unionByName(gone).groupBy("source")).applyInPandas(kept, "doc_id long, n_words long, n_removed long, text string")
