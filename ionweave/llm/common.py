"""What the operators of this subpackage share: column picking, shared tables, Arrow text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import skewed_join  # noqa: F401
from ..storage import Scratch, shared_dir  # noqa: F401

#: Characters that separate words: space and the ASCII controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
DOC_TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``df``, typed; one that is missing is null.

    Operators start with this, so other columns of the input, however named,
    can't clash with theirs.
    """
    have = set(df.columns)
    return df.select(*[(df[n] if n in have else F.lit(None)).cast(DOC_TYPES.get(n, "string")).alias(n) for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; texts are long, so they go to Python in batches of a thousand at most."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def tidy() -> None:
    """Gives memory that a task has freed back to the system: workers live on, for other operators too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins (one more at the end). Nulls are empty."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if pa.types.is_string(arr.type):
        arr = arr.cast(pa.binary())
    arr = arr.cast(pa.large_binary())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def parts(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text (or one row), so that memory is bounded."""
    for batch in batches:
        _, offs = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + most_bytes, side="right")) - 1
            j = min(n, max(i + 1, j), i + most_rows)
            yield batch.slice(i, j - i)
            i = j
    tidy()


def in_fold(doc_id: str = "doc_id") -> F.Column:
    """True for held-out documents: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
