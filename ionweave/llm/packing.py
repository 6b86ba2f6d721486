"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's full windows are sequences of their own; what is left of each
document is packed with others. A batch of such pieces is split into as many
windows as its tokens need at least: partial partitions with the largest spread
are merged again and again, large sums with small ones. If the largest window is
too long, the number of windows rises.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import parts, pick, utf8


@dataclass(frozen=True)
class PackSpec:
    """path: the tokenizer's file on every machine. batch: pieces that are packed together. piece: what is left of a document is cut into pieces of so many tokens."""

    path: str
    window: int = 1024
    end_id: int = 0
    batch: int = 1200
    piece: int = 512


#: The pattern that byte-level BPE vocabularies of this kind are made with (fixed values).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What \s is in that pattern: characters with the property White_Space (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space this long are cut out by hand: the pattern's matcher keeps a way back for each character of a run.
LONG_RUN = 20_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _is_plain(spec: dict) -> bool:
    """Whether a tokenizer's file is byte-level BPE as :class:`TokenIds` computes it: SPLIT, merges in the order of ids, added tokens that stand alone."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"].get(t) for t in made]
    added = {t["content"] for t in spec.get("added_tokens", ())}
    return None not in ids and all(a < b for a, b in itertools.pairwise(ids)) and len(set(model["vocab"]) - added) == len(made) + 256


class TokenIds:
    """The ids that the tokenizers library gives with add_special_tokens=False (on default settings: an added token's string in a text is that token).

    A plain byte-level BPE file is read into the tiktoken library, which is faster; any other file is left to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = None
        if not _is_plain(spec):
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            return
        import tiktoken

        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.run = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")

    def __call__(self, text: str) -> list[int]:
        if self.slow is not None:
            return self.slow.encode(text, add_special_tokens=False).ids
        if not any(t in text for t in self.added):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.added[part]] if part in self.added else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens. Before other text the last character of a run of white space is not part of the run's piece."""
        if len(text) < LONG_RUN:
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for m in self.run.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.fast.encode_ordinary(text[at : m.start()])
            out += self.fast._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.fast.encode_ordinary(text[at:])


@functools.lru_cache(2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window (0 to k - 1) of each size, and the windows' sums: Karmarkar-Karp for k windows. Deterministic."""
    n = len(sizes)
    first = np.sort(sizes)[::-1]
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    base: dict[int, int] = {}
    merges = []
    one = lambda i: sums.pop(i) if i >= n else np.concatenate(([int(sizes[i])], np.zeros(k - 1, np.int64)))
    new = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = one(a) + one(b)[::-1]
        low = int(total.min())
        order = np.argsort(-total, kind="stable")
        sums[new] = total[order] - low
        base[new] = base.get(a, 0) + base.get(b, 0) + low
        merges.append((a, b, order))
        heapq.heappush(heap, (low - int(total.max()), new))
        new += 1
    root = heap[0][1]
    final = one(root) + base.get(root, 0) if n else first
    label = {root: np.arange(k)}
    out = np.zeros(n, np.int64)
    for i in range(new - 1, n - 1, -1):
        a, b, order = merges[i - n]
        was = np.empty(k, np.int64)
        was[order] = label.pop(i)
        for child, slots in ((a, was), (b, was[::-1])):
            if child >= n:
                label[child] = slots
            else:
                out[child] = slots[0]
    if n == 1:
        out[0] = 0
    return out, final


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size with no sum above the capacity; the number of windows rises until that holds."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return at
        k += max(1, k // 200)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, spec: PackSpec | None = None) -> DataFrame:
    """One row for each piece: its ids (little-endian unsigned 32-bit) and where it lies in which sequence.

    A null or empty text is one token, the end id. Sequences belong to a
    partition of the input and are numbered within it, so nothing is
    shuffled, and a task that runs again gives the same rows; memory holds one
    batch of pieces and one text with its ids, however long it is (runs of a million blanks too). Repeated rows and null ids are packed one by one; an empty
    table gives an empty one; other columns are ignored.
    """
    spec = spec or PackSpec(default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        ids_of = token_ids(spec.path)
        full: list[tuple] = []
        rest: list[tuple] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def packed(pieces: list[tuple]) -> list[tuple]:
            nonlocal made
            at = windows(np.array([p[2] for p in pieces], np.int64), spec.window)
            fill = np.zeros(int(at.max()) + 1, np.int64)
            out = []
            for p, w in zip(pieces, at.tolist()):
                out.append((*p, made + w, int(fill[w])))
                fill[w] += p[2]
            made += len(fill)
            return out

        for batch in parts(batches, "text"):
            data, offs = utf8(batch.column("text"))
            raw, at = data.tobytes(), offs.tolist()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:]):
                ids = np.array([*ids_of(raw[a:b].decode()), spec.end_id], "<u4")
                n, i = len(ids), 0
                while n - i >= spec.window:
                    full.append((doc, i, spec.window, ids[i : i + spec.window].tobytes(), n, made, 0))
                    made += 1
                    i += spec.window
                while i < n:
                    j = min(n, i + spec.piece)
                    rest.append((doc, i, j - i, ids[i:j].tobytes(), n))
                    i = j
            if full:
                yield table(full)
                full = []
            while len(rest) >= 2 * spec.batch:  # a batch always follows, so the last one isn't small
                yield table(packed(rest[: spec.batch]))
                rest = rest[spec.batch :]
        if rest:
            yield table(packed(rest))

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
