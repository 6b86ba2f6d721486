"""Audio columns: 8-bit WAV storage, polyphase resampling, log-mel tensors, energy segments.

Each row is worked on alone, in fixed blocks of frames, so equal inputs give
bit-equal features under one numeric library with one thread a task, which is how Spark starts its workers
(other threads or processors may round the last bits of a feature in another way). A task holds
one recording with its resampled signal, its features and its tensors: some twenty times its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts, pick, utf8


@dataclass(frozen=True)
class AudioSpec:
    """rate: of the stored samples. up/down: the resampling ratio. Times are in seconds."""

    rate: int = 16000
    up: int = 3
    down: int = 4
    half_taps: int = 8
    frame_s: float = 0.025
    hop_s: float = 0.010
    n_fft: int = 512
    n_mels: int = 40
    tile: int = 64
    floor: float = 1e-6
    on_db: float = 3.0
    off_db: float = -3.0
    block: int = 2048

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down

    @property
    def frame(self) -> int:
        return round(self.frame_s * self.out_rate)

    @property
    def hop(self) -> int:
        return round(self.hop_s * self.out_rate)


PAD_BYTE, PAD_TO = 255, 576
OUT = (
    "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "n_frames long, n_tiles long, span_s double, tensors binary, segments array<struct<start_s:double,end_s:double>>, feature string"
)


def to_wav(samples: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF file; an odd number of samples gets the pad byte RIFF asks for."""
    n = len(samples)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + n + n % 2) + b"WAVE" + head + samples + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono RIFF file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@functools.lru_cache(4)
def _filters(spec: AudioSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Polyphase taps (window x phases), mel weights, analysis window, taps to the left."""
    cut = min(1.0, spec.up / spec.down)
    half = int(np.ceil(spec.half_taps / cut))
    t0 = np.arange(spec.up) * spec.down / spec.up  # where each output of a cycle of `down` inputs lies
    k = np.arange(-half, half + spec.down + 1)
    d = t0[None, :] - k[:, None]
    taper = np.where(np.abs(d) <= half + 1, 0.5 + 0.5 * np.cos(np.pi * d / (half + 1)), 0.0)
    taps = cut * np.sinc(cut * d) * taper
    taps /= taps.sum(axis=0, keepdims=True)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(spec.out_rate / 2), spec.n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(spec.n_fft, 1 / spec.out_rate)
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    bank = np.maximum(0, np.minimum(up, down))
    return taps.astype(np.float32), bank.astype(np.float32), np.hanning(spec.frame).astype(np.float32), half


def resample(x: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """Rational resampling by up/down: one dot product of a strided window with each phase's taps."""
    taps, _, _, half = _filters(spec)
    cycles = -(-len(x) // spec.down)
    padded = np.zeros(cycles * spec.down + 2 * half + spec.down + 1, np.float32)
    padded[half : half + len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[:: spec.down][:cycles]
    out = np.concatenate([view[i : i + 65536] @ taps for i in range(0, cycles, 65536)]) if cycles else view @ taps
    return out.reshape(-1)[: -(-len(x) * spec.up // spec.down)]


def log_mel(y: np.ndarray, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel features and energies in dB of overlapped frames; the last frame is filled with zeros."""
    _, bank, window, _ = _filters(spec)
    n = 1 + max(0, -(-(len(y) - spec.frame) // spec.hop))
    padded = np.zeros((n - 1) * spec.hop + spec.frame, np.float32)
    padded[: len(y)] = y[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, spec.frame)[:: spec.hop]
    mels, energy = [], []
    for i in range(0, n, spec.block):
        part = frames[i : i + spec.block] * window
        power = np.abs(np.fft.rfft(part, spec.n_fft)).astype(np.float32) ** 2
        mels.append(np.log(power @ bank + spec.floor))
        energy.append(10 * np.log10((part * part).mean(axis=1) + spec.floor))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """[first, end) frames of active stretches: they begin at on_db and end below off_db, against the mean energy."""
    level = energy - energy.mean()
    known = np.where((level >= spec.on_db) | (level < spec.off_db), np.arange(1, len(level) + 1), 0)
    last = np.maximum.accumulate(known)
    active = (last > 0) & (level[np.maximum(last - 1, 0)] >= spec.on_db)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], active.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def tensor_type(spec: AudioSpec = AudioSpec()) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), [spec.tile, spec.n_mels])


def to_tensors(mels: np.ndarray, spec: AudioSpec) -> bytes:
    """An Arrow IPC stream: tiles of a fixed shape with their time spans; the last tile is filled with the log of the floor."""
    n = len(mels)
    tiles = -(-n // spec.tile)
    full = np.full((tiles * spec.tile, spec.n_mels), np.log(spec.floor), np.float32)
    full[:n] = mels
    start = np.arange(tiles) * spec.tile
    end = np.minimum(start + spec.tile, n) - 1
    kind = tensor_type(spec)
    store = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), spec.tile * spec.n_mels)
    batch = pa.record_batch(
        [pa.ExtensionArray.from_storage(kind, store), pa.array(start * spec.hop_s), pa.array(end * spec.hop_s + spec.frame_s)],
        names=["log_mel", "start_s", "end_s"],
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(blob: bytes) -> pa.Table:
    """The table that :func:`to_tensors` stored; ``log_mel`` is a fixed-shape tensor column."""
    return pa.ipc.open_stream(blob).read_all()


def features(samples: bytes, spec: AudioSpec = AudioSpec()) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel features and segments (frames) of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x, spec), spec)
    return mels, segments(energy, spec)


def audio_columns(docs: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """Stores each text's bytes as a WAV file, reads it back and computes its features.

    Output: one row for each input row, in columns OUT: the media file, digests
    of the payload as read back, log-mel tensors (an Arrow IPC stream, see
    :func:`read_tensors`) with the number of tiles and the end of the last one's time span as read back,
    active segments in seconds, and a short digest of the features. Equal texts give equal values.

    A null text is empty; an empty text is 576 bytes of padding. A null doc_id
    stays null; repeated rows give repeated rows; an empty table gives an empty
    one; other input columns are ignored. No shuffle; every row is independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            data, offs = utf8(batch.column("text"))
            raw = data.tobytes()
            rows = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                n = b - a
                media = to_wav(raw[a:b] + bytes([PAD_BYTE]) * ((-n) % PAD_TO if n else PAD_TO), spec.rate)
                _, back = from_wav(media)
                mels, seg = features(back, spec)
                tensors = to_tensors(mels, spec)
                tiles = read_tensors(tensors)
                digest = hashlib.sha256(mels.tobytes() + seg.tobytes()).hexdigest()[:16]
                rows.append(
                    (
                        n, media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(mels), len(tiles), tiles["end_s"][-1].as_py(), tensors,
                        [{"start_s": float(s) * spec.hop_s, "end_s": float(e - 1) * spec.hop_s + spec.frame_s} for s, e in seg],
                        f"frames={len(mels)};segments={len(seg)};mean={mels.mean(dtype=np.float64):.3f};sha={digest}",
                    )
                )
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string()]
            names = ["n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "n_frames", "n_tiles", "span_s", "tensors", "segments", "feature"]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *names])

    return pick(docs, "doc_id", "text").mapInArrow(run, OUT)
