"""Media columns: bytes stored as audio, and features of the stored audio.

A payload is stored as a WAV file of 8-bit mono samples in a binary column.
Features come from the stored bytes: polyphase resampling (by ``UP`` / ``DOWN``, a
phase of the filter for each residue), overlapped log-mel filterbanks, the last
frame padded with silence, and an energy segmentation with hysteresis (a
segment opens above one level and closes below a lower one). A clip's log-mel
frames are cut into tensors of the fixed shape (``FRAMES``, ``MELS``), the last
one padded with the silence level, each with its time span and the spans of
segments inside it; they are stored as an Arrow stream with the fixed-shape
tensor type, one for each clip, and the feature string is derived from what is
read back.

Defined cases: a null text is an empty payload, which is padded to 64 zero
bytes; equal payloads have equal values, as each clip is computed by itself; a
clip of any length is resampled in blocks; rows without an id and repeated rows
are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, UP, DOWN, TAPS = 8000, 3, 4, 32
WINDOW, HOP, MELS, FRAMES = 256, 128, 16, 32
#: Levels in dB above the clip's mean energy at which a segment opens and closes.
OPEN_DB, CLOSE_DB = 1.0, -1.0
#: Samples that are handled at once; the state between blocks is the overlap only.
BLOCK = 1 << 17
FLOOR = 1e-10


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(stored: bytes) -> tuple[int, memoryview]:
    """Rate and samples of a WAV file of 8-bit mono samples."""
    view = memoryview(stored)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("8-bit mono samples only")
        elif kind == b"data":
            return rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int) -> np.ndarray:
    """A low-pass filter of ``up`` x TAPS coefficients at ``up`` times the rate, as one row for each phase."""
    n = np.arange(TAPS * up) - (TAPS * up - 1) / 2
    cut = 1 / max(up, down)
    low = cut * np.sinc(cut * n) * np.hamming(TAPS * up)
    return (up * low / low.sum()).reshape(TAPS, up).T


@lru_cache(maxsize=4)
def _mel_weights() -> tuple[np.ndarray, np.ndarray]:
    """The window and the mel weights."""
    mel = lambda hz: 1127 * np.log1p(hz / 700)
    rate = RATE * UP / DOWN
    edges = 700 * np.expm1(np.linspace(mel(40.0), mel(rate / 2), MELS + 2) / 1127)
    hz = np.fft.rfftfreq(WINDOW, 1 / rate)
    rise = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(WINDOW), np.maximum(0, np.minimum(rise, fall))


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at ``up`` / ``down`` of its rate: each output is one phase of the filter over the TAPS inputs around it."""
    rows = phases(up, down)
    at = np.arange(len(x) * up // down) * down
    held = np.concatenate([np.zeros(TAPS // 2), x, np.zeros(TAPS)])
    views = np.lib.stride_tricks.sliding_window_view(held, TAPS)
    out = np.empty(len(at))
    for first in range(min(up, len(at))):  # outputs that are ``up`` apart have one phase, and inputs ``down`` apart
        own = at[first::up]
        out[first::up] = views[own[0] // up :: down][: len(own)] @ rows[own[0] % up][::-1]
    return out


def log_mel(samples: memoryview | bytes) -> np.ndarray:
    """(frames, MELS) of log energies; at least one frame, the last one padded with silence."""
    window, weights = _mel_weights()
    raw = np.frombuffer(samples, np.uint8)
    total = len(raw) * UP // DOWN
    count = -(-max(total - WINDOW, 0) // HOP) + 1
    step = BLOCK // (HOP * DOWN) * HOP * DOWN  # inputs of a block, which begins at a frame
    each = step * UP // DOWN // HOP
    reach = WINDOW * DOWN // UP + TAPS + DOWN
    out = []
    for k, a in zip(range(0, count, each), range(0, count * step, step)):
        left = TAPS * DOWN if a else 0
        y = resample((raw[a - left : a + step + reach].astype(np.float64) - 128) / 128)[left * UP // DOWN :]
        need = (min(each, count - k) - 1) * HOP + WINDOW
        y = np.concatenate([y[:need], np.zeros(max(0, need - len(y)))])
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        for j in range(0, len(frames), 512):
            power = np.abs(np.fft.rfft(frames[j : j + 512] * window)) ** 2
            out.append(np.log(np.maximum(power @ weights, FLOOR)))
    return np.concatenate(out)


def segments(frames: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans (end exclusive) of the loud segments."""
    energy = 10 / np.log(10) * np.logaddexp.reduce(frames, axis=1)
    energy -= energy.mean()
    state = np.where(energy >= OPEN_DB, 1, np.where(energy < CLOSE_DB, -1, 0))
    turns = np.flatnonzero(state)
    if not len(turns):
        return []
    last = np.zeros(len(state), np.int64)
    last[turns] = np.arange(len(turns)) + 1
    on = np.append(0, state[turns])[np.maximum.accumulate(last)] == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def seconds(frame):
    """When a frame (or each of an array of frames) begins."""
    return frame * HOP * DOWN / UP / RATE


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a WAV file, written to the shared folder and read back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw = [x.as_buffer().to_pybytes() for x in common.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([wav(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.scratch(source.mapInArrow(task, "doc_id long, n_bytes long, media binary"), "media")


SPAN = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel"))
TENSORS = pa.schema([("part", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32()), ("loud", SPAN), ("tensor", TENSOR)])


def tensor_stream(mel: np.ndarray, loud: list[tuple[int, int]]) -> bytes:
    """The tensors of a clip as an Arrow stream: part, time span, frames that are not padding, spans of segments inside, tensor."""
    rows = -(-len(mel) // FRAMES)
    whole = np.full((rows * FRAMES, MELS), np.log(FLOOR), np.float32)
    whole[: len(mel)] = mel
    first = np.arange(rows) * FRAMES
    frames = np.minimum(FRAMES, len(mel) - first)
    inside: list[list] = [[] for _ in range(rows)]
    for a, b in loud:
        for k in range(a // FRAMES, (b - 1) // FRAMES + 1):
            inside[k].append({"start_s": seconds(max(a, k * FRAMES)), "end_s": seconds(min(b, (k + 1) * FRAMES))})
    storage = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), FRAMES * MELS)
    columns = [pa.array(np.arange(rows, dtype=np.int32)), pa.array(seconds(first)), pa.array(seconds(first + frames)), pa.array(frames.astype(np.int32)), pa.array(inside, SPAN), pa.ExtensionArray.from_storage(TENSOR, storage)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSORS))
    return sink.getvalue().to_pybytes()


def tensors_of(stream: pa.Buffer | bytes) -> tuple[pa.Table, np.ndarray]:
    """The table of a clip's tensors, and its frames without padding."""
    table = pa.ipc.open_stream(stream).read_all()
    values = table.column("tensor").combine_chunks()
    frames = values.to_numpy_ndarray().reshape(-1, MELS)[: sum(table.column("n_frames").to_pylist())]
    return table, frames


def tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tensors) of stored media: the digests of what was read back, and its log-mel tensors as an Arrow stream, written to the shared folder and read back."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", common.SLICE_BYTES // 4):
            rows = []
            for media in batch.column(2):
                held = media.as_buffer()
                _, samples = samples_of(held)
                mel = log_mel(samples)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(held), hashlib.sha256(held).hexdigest(), tensor_stream(mel, segments(mel))))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary"
    return common.scratch(stored.mapInArrow(task, schema), "tensors")


def feature(stream: pa.Buffer | bytes) -> str:
    """Counts, loud time, and the mean and deviation of each mel band, from a clip's stored tensors."""
    table, frames = tensors_of(stream)
    spans = [(x["start_s"], x["end_s"]) for part in table.column("loud").to_pylist() for x in part]
    count = sum(a != before for (a, _), before in zip(spans, [None, *(b for _, b in spans)]))
    frames = frames.astype(np.float64)
    values = [*frames.mean(axis=0), *frames.std(axis=0)]
    loud = sum(b - a for a, b in spans)
    return f"tensors={table.num_rows}x{FRAMES}x{MELS};frames={len(frames)};end={table.column('end_s')[-1].as_py():.3f};segments={count};loud={loud:.3f};logmel=" + ",".join(f"{v:.3f}" for v in values)


def features(made: DataFrame) -> DataFrame:
    """The rows of ``tensors`` with the feature string that their streams give in place of the streams."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([feature(x.as_buffer()) for x in batch.column("tensors")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), found], names=names)

    return made.mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
