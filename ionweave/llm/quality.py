"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and fits a shallow tree to the
gradient on that feature's bins; each tree is added to the feature's lookup
table. Pairs of features get tables of their own in a second run. A score is a
sum of table entries.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, parts, pick, utf8
from .words import word_hashes, words

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "symbols", "bangs", "bars", "digits", "repeats", "distinct",
    "lines", "stops", "capitals", "top_word", "non_ascii", "longest_word",
]


@dataclass(frozen=True)
class GamSpec:
    """train_rows: about so many labelled rows at most are read (hash-chosen)."""

    train_rows: int = 20000
    bins: int = 48
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 120
    pair_rounds: int = 40
    rate: float = 0.1
    leaves: int = 3
    ridge: float = 1.0
    seed: int = 11


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_UPPER = _table(bytes(range(65, 91)))
_SYMBOL = _table(b"#$%&*@^~_<>=+\\{}[]")
_CLASSES = [(_UPPER, "upper"), (_SYMBOL, "symbols"), (_table(b"!"), "bangs"), (_table(b"|"), "bars"), (_table(b"0123456789"), "digits"), (_table(b"\n"), "lines"), (_table(b".,;:?"), "stops"), (_table(bytes(range(128, 256))), "non_ascii")]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all are 0 for an empty one."""
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    out = {"log_bytes": np.log1p(size)}

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
        return total[offs[1:]] - total[offs[:-1]]

    starts, ends, doc = words(data, offs)
    count = np.bincount(doc, minlength=n).astype(np.float64)
    most = np.maximum(count, 1)
    out["log_words"] = np.log1p(count)
    length = (ends - starts).astype(np.float64)
    out["word_bytes"] = np.bincount(doc, length, minlength=n) / most
    for table, name in _CLASSES:
        by = np.maximum(size, 1) if name in ("upper", "symbols", "digits", "non_ascii") else most
        out[name] = per_text(table[data]) / by
    h = word_hashes(data, starts, ends)[0]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["repeats"] = np.bincount(doc, same, minlength=n) / most
    out["capitals"] = np.bincount(doc, _UPPER[data[starts]] if len(starts) else None, minlength=n) / most
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(first)
    run = np.diff(np.append(at, len(h)))
    owner = doc[order][at]
    out["distinct"] = np.bincount(owner, minlength=n) / most
    top = np.zeros(n)
    np.maximum.at(top, owner, run)
    out["top_word"] = top / most
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out["longest_word"] = np.log1p(longest)
    return np.stack([out[k] for k in FEATURES], axis=1)


def _best_steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values of a tree of so many leaves on ordered bins with gradients g and curvatures h: greedy best cuts."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in itertools.pairwise(sorted(cuts)):
            if b - a < 2:
                continue
            i = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[i] - cg[a], ch[i] - ch[a], cg[b] - cg[i], ch[b] - ch[i]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], int(i[k])
        if where is None:
            break
        cuts.append(where)
    out = np.empty(len(g))
    for a, b in itertools.pairwise(sorted(cuts)):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _best_quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut into four quadrants of a table of gradients."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    m = len(g)
    i, j = np.meshgrid(np.arange(1, m), np.arange(1, m), indexing="ij")
    part = lambda c: (c[i, j], c[i, m] - c[i, j], c[m, j] - c[i, j], c[m, m] - c[i, m] - c[m, j] + c[i, j])
    gs, hs = part(cg), part(ch)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs))
    k = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty((m, m))
    v = [a[k] / (b[k] + ridge) for a, b in zip(gs, hs)]
    x, y = k[0] + 1, k[1] + 1
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = v
    return float(gain.max()), out


@dataclass
class Gam:
    """edges: of each feature's bins. tables: a value for each bin. pairs: features, coarse edges, table."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        z = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, ei, ej, t in self.pairs:
            z += t[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, spec: GamSpec = GamSpec()) -> Gam:
    """Fits tables by cyclic boosting on the logistic loss, then tables of the pairs with most gain. Deterministic."""
    if not len(y):
        return Gam()
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    gam = Gam(float(np.log(p0 / (1 - p0))))
    grid = lambda v, m: np.unique(np.quantile(v, np.linspace(0, 1, m + 1)[1:-1]))
    gam.edges = [grid(x[:, k], spec.bins) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(gam.edges)]
    gam.tables = [np.zeros(len(e) + 1) for e in gam.edges]
    z = np.full(len(y), gam.intercept)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(spec.rounds):
        for k, b in enumerate(at):
            p = sigmoid(z)
            m = len(gam.tables[k])
            if m < 2:
                continue
            step = spec.rate * _best_steps(np.bincount(b, y - p, m), np.bincount(b, p * (1 - p), m), spec.leaves, spec.ridge)
            gam.tables[k] += step
            z += step[b]
    coarse = [grid(x[:, k], spec.pair_bins) for k in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    m = spec.pair_bins

    def tables(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, c = sigmoid(z), cell[i] * m + cell[j]
        return c, np.bincount(c, y - p, m * m).reshape(m, m), np.bincount(c, p * (1 - p), m * m).reshape(m, m)

    usable = [k for k in range(x.shape[1]) if len(coarse[k])]
    gains = {(i, j): _best_quadrants(*tables(i, j)[1:], spec.ridge)[0] for i, j in itertools.combinations(usable, 2)}
    chosen = sorted(gains, key=lambda q: (-gains[q], q))[: spec.pairs]
    found = {q: np.zeros((m, m)) for q in chosen}
    for _ in range(spec.pair_rounds):
        for q in chosen:
            c, g, h = tables(*q)
            step = spec.rate * _best_quadrants(g, h, spec.ridge)[1]
            found[q] += step
            z += step.reshape(-1)[c]
    gam.pairs = [(i, j, coarse[i], coarse[j], t) for (i, j), t in found.items()]
    return gam


def fit(docs: DataFrame, labels: DataFrame, spec: GamSpec = GamSpec()) -> Gam:
    """A model of ``labels.quality`` from rows outside the held-out fold.

    Features are computed where the texts are; about ``spec.train_rows`` rows of
    numbers at most reach the driver. Rows without a label or a document are not used.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    good = good.where("doc_id is not null and y is not null").where(~in_fold()).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = good.count()
    if n > spec.train_rows:
        good = good.where(F.pmod(F.xxhash64(F.lit(spec.seed), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * spec.train_rows / n))
    rows = pick(docs, "doc_id", "text").join(good, "doc_id").select("doc_id", "y", "text")  # Spark broadcasts the labels if they are small enough

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            x = features(*utf8(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return train(x, (got["y"].to_numpy(np.float64) > 0).astype(np.float64), spec)


def score(docs: DataFrame, gam: Gam) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for each row.

    A null text counts as empty and gets the score of an empty one. Repeated rows
    and null ids stay; an empty table gives an empty one; other columns are
    ignored. A model without training rows scores 0.5 everywhere. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            s = gam.score(features(*utf8(batch.column("text"))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s.round(9))], names=["doc_id", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
