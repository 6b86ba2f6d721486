"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1; a trigram's vector is the product of
its letters' vectors, each permuted (rotated) by its place; a text's vector is
the sum of its trigrams' vectors. A language's prototype is the sum over its
training texts; a text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, parts, pick

UNKNOWN = "und"
#: Texts with fewer letters than that are too short to be told from chance.
FEW_LETTERS = 32


@dataclass(frozen=True)
class HyperSpec:
    """dim: length of the vectors. train_rows: about so many training texts at most are read (hash-chosen)."""

    dim: int = 1024
    seed: int = 7
    train_rows: int = 20000
    cache: int = 30000


@functools.lru_cache(1)
def _fold() -> np.ndarray:
    """For each code point: the lower-cased letter, 32 for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.lru_cache(30_000)
def _letter(code: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, code]).integers(0, 2, dim, dtype=np.int8) * 2 - 1


class Encoder:
    """Texts to vectors; keeps the vectors of up to ``cache`` trigrams, and starts anew when that is full."""

    def __init__(self, spec: HyperSpec):
        self.spec = spec
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, self.spec.dim), np.int8)

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct trigrams, each packed as three 21-bit code points."""
        d, s = self.spec.dim, self.spec.seed
        at = np.searchsorted(self.keys, grams)
        new = grams[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != grams)] if len(self.keys) else grams
        if len(new):
            if len(self.keys) + len(new) > self.spec.cache:
                self._clear()
                new = grams
            letters, at = np.unique(np.stack([new >> np.uint64(21 * (2 - place)) & np.uint64(0x1FFFFF) for place in range(3)]), return_inverse=True)
            table = np.stack([_letter(c, d, s) for c in letters.tolist()])
            first, second, third = at.reshape(3, -1)
            made = np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, made])[order]
            at = np.searchsorted(self.keys, grams)
        return self.rows[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, and whether it has any letter. Words are taken with a blank on either side."""
        joined = "\n".join(texts)
        codes = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts])[:-1] if len(texts) > 1 else np.zeros(0, np.int64)
        codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
        doc = np.zeros(len(codes), np.int64)
        np.add.at(doc, ends + 1, 1)
        doc = np.cumsum(doc)
        mid = (codes[1:-1] != 32) | ((codes[:-2] != 32) & (codes[2:] != 32))
        has = np.bincount(doc[1:-1][codes[1:-1] != 32], minlength=len(texts)) > 0
        # a gram that spans two texts would need a letter on both sides of the newline between them
        mid &= ~((codes[1:-1] == 32) & (doc[:-2] != doc[2:]))
        gram = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[mid]
        owner = doc[1:-1][mid]
        out = np.zeros((len(texts), self.spec.dim), np.float32)
        if not len(gram):
            return out, has
        grams, which = np.unique(gram, return_inverse=True)
        for a in range(0, len(grams), 8192):
            vectors = self._vectors(grams[a : a + 8192])
            here = (which >= a) & (which < a + 8192) if len(grams) > 8192 else slice(None)
            width = len(vectors)
            o, w = owner[here], which[here] - a
            for i in range(0, len(texts), 256):
                lo, hi = np.searchsorted(o, [i, i + 256])
                n = min(256, len(texts) - i)
                count = np.bincount((o[lo:hi] - i) * width + w[lo:hi], minlength=n * width).reshape(n, width)
                used = np.flatnonzero(count.any(axis=0))
                out[i : i + n] += count[:, used].astype(np.float32) @ vectors[used].astype(np.float32)
        return out, has


@functools.lru_cache(2)
def _encoder(spec: HyperSpec) -> Encoder:
    return Encoder(spec)


@dataclass(frozen=True)
class HyperProfiles:
    """Prototypes of unit length, one row a language."""

    spec: HyperSpec
    langs: tuple[str, ...]
    unit: np.ndarray

    @property
    def chance(self) -> float:
        """Three standard deviations of the cosine of vectors that have nothing in common: 3 / sqrt(dim)."""
        return 3 / self.spec.dim**0.5

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and cosines (at least 0); ``und`` and 0 for a text without a letter."""
        vectors, has = _encoder(self.spec).encode(texts)
        norm = np.linalg.norm(vectors, axis=1)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cos = (vectors @ self.unit.T).astype(np.float64) / np.maximum(norm, 1e-9)[:, None]
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())], np.where(has, score.round(6), 0.0)


def fit(docs: DataFrame, spec: HyperSpec = HyperSpec()) -> HyperProfiles:
    """Prototypes from the texts outside the held-out fold that have a language.

    At most about ``spec.train_rows`` texts, chosen by a hash of doc_id. What
    reaches the driver is one vector for each language and task.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null").where(~in_fold())
    n = rows.select("doc_id").count()
    if n > spec.train_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(spec.seed), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * spec.train_rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        encoder = _encoder(spec)
        for batch in parts(batches, "text"):
            langs = batch.column("lang").to_pylist()
            vectors, _ = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + vectors[[x == lang for x in langs]].sum(axis=0, dtype=np.float64)
        names = sorted(total)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([total[k].tolist() for k in names], pa.list_(pa.float64()))], names=["lang", "v"])

    each = rows.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    long = each.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = long.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    got = sorted(got, key=lambda r: r["lang"])
    unit = np.array([r["v"] for r in got], np.float64).reshape(len(got), spec.dim)
    unit = np.round(unit / np.maximum(np.linalg.norm(unit, axis=1), 1e-9)[:, None], 9)  # the order of sums doesn't show
    return HyperProfiles(spec, tuple(r["lang"] for r in got), unit.astype(np.float32))


def identify(docs: DataFrame, profiles: HyperProfiles, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for each row (with keep: the documents' columns before them).

    A null text, or one without a letter, is ``und`` with score 0. Ties go to the
    language that sorts first. Without any training text every row is ``und``.
    Repeated rows and null ids stay; other columns are ignored. No shuffle.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"] if keep else ["doc_id", "text"]
    held = names if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            pred, score = profiles.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([*[batch.column(c) for c in held], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*held, "lang_pred", "score"])

    rows = pick(docs, *names)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in held) + ", lang_pred string, score double")


def in_learned_language(identified: DataFrame, profiles: HyperProfiles) -> DataFrame:
    """The rows of :func:`identify` (with keep) whose text is in a language that was learned.

    Texts without a letter go, and texts whose best cosine is one that any text in other letters
    reaches by chance; those of fewer than FEW_LETTERS letters can't be told and stay.
    """
    short = F.regexp_count("text", F.lit(r"\p{L}")) < FEW_LETTERS
    return identified.where((F.col("lang_pred") != UNKNOWN) & ((F.col("score") > profiles.chance) | short))
