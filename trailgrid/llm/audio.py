"""Media columns: documents stored as sound, and features of what is read back.

A payload is stored as a WAV file of unsigned 8-bit samples. Features come from the stored bytes:
polyphase resampling, overlapped log-mel filterbanks, and segments of energy by hysteresis. The
filterbank frames are cut into clips of one shape and stored in a column of Arrow streams: one
fixed-shape tensor (FRAMES x MELS float32) a clip beside its time span. Sound is worked through in
blocks, so that working memory doesn't grow with it.

Defined cases: a null text is empty; an empty payload is 64 zero bytes; the last clip is padded with
the floor value; equal texts have equal files and features; repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: Samples a second as stored and as analysed, window and step in samples, clip shape.
STORED_HZ, HZ, WINDOW, STEP, FRAMES, MELS = 16_000, 8_000, 512, 256, 16, 32
#: Taps of the resampling filter for each phase; clips in a block.
TAPS, BLOCK = 16, 64
#: Mean square at which a segment starts and below which it ends; value of silence in log-mel frames.
LOUD, QUIET, FLOOR = 0.055, 0.045, -10.0
PAD = 64


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def to_wav(payload: bytes) -> bytes:
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, STORED_HZ, STORED_HZ, 1, 8) + b"data"
    return head + struct.pack("<I", n & 0xFFFFFFFF) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file, whatever chunks stand before them."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def _filter(up: int, down: int) -> np.ndarray:
    """A windowed sinc below the lower of both bands."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    return (np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1] * up).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, first: int, count: int) -> np.ndarray:
    """Outputs first to first + count of x resampled by up / down; x is zero outside itself.

    Each output uses the one phase of the filter that meets samples, so no zeros are multiplied.
    """
    h, m = _filter(up, down), np.arange(first, first + count)
    base, phase = m * down // up, m * down % up
    lo, hi = int(base[0]) - TAPS + 1 if count else 0, int(base[-1]) + 1 if count else 0
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = x[a:b]
    views = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(count, np.float32)
    for p in range(up):
        at = np.flatnonzero(phase == p)
        if len(at):
            out[at] = views[base[at] - TAPS + 1 - lo] @ h[p::up][:TAPS][::-1]
    return out


def mel_bank() -> np.ndarray:
    """Triangles evenly spaced on the mel scale, one column each."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(HZ / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(WINDOW, 1 / HZ)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def hysteresis(power: np.ndarray, on: bool) -> np.ndarray:
    """Whether each frame is in a segment; `on`: whether the frame before the first was."""
    marks = np.where(power >= LOUD, 1, np.where(power < QUIET, 0, -1))
    last = np.maximum.accumulate(np.where(marks >= 0, np.arange(len(marks)), -1))
    return np.where(last >= 0, marks[last], int(on)).astype(bool)


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Clips (n, FRAMES, MELS), the time span of each, and the time spans of segments."""
    up, down = (a // (g := int(np.gcd(HZ, STORED_HZ))) for a in (HZ, STORED_HZ))
    x = np.frombuffer(samples, np.uint8)
    total = -(-len(x) * up // down)
    frames = 1 + max(0, -(-(total - WINDOW) // STEP))
    bank, window = mel_bank(), np.hanning(WINDOW).astype(np.float32)
    clips, segments, on = [], [], False
    for at in range(0, frames, FRAMES * BLOCK):
        n = min(FRAMES * BLOCK, frames - at)
        need = (n - 1) * STEP + WINDOW
        lo = max(0, at * STEP * down // up - TAPS - down)
        hi = min(len(x), (at * STEP + need) * down // up + TAPS + down)
        block = (x[lo:hi].astype(np.float32) - 128) / 128
        sound = resample(block, up, down, at * STEP - lo * up // down, need) if lo * up % down == 0 else resample((x[:hi].astype(np.float32) - 128) / 128, up, down, at * STEP, need)
        views = np.lib.stride_tricks.sliding_window_view(sound, WINDOW)[::STEP][:n]
        power = np.mean(views * views, axis=1)
        spectrum = np.abs(np.fft.rfft(views * window, axis=1)) ** 2
        logs = np.maximum(np.log10(spectrum.astype(np.float32) @ bank + 1e-10), FLOOR).astype(np.float32)
        active = hysteresis(power, on)
        edge = np.flatnonzero(np.diff(np.concatenate([[on], active]).astype(np.int8)))
        for e in edge:
            if active[e]:
                segments.append([(at + int(e)) * STEP / HZ, None])
            else:
                segments[-1][1] = (at + int(e)) * STEP / HZ
        on = bool(active[-1])
        full = np.full((-(-n // FRAMES) * FRAMES, MELS), FLOOR, np.float32)
        full[:n] = logs
        clips.append(full.reshape(-1, FRAMES, MELS))
    end = len(x) / STORED_HZ
    if on:
        segments[-1][1] = end
    made = np.concatenate(clips)
    spans = [(i * FRAMES * STEP / HZ, min(end, ((i + 1) * FRAMES * STEP + WINDOW - STEP) / HZ)) for i in range(len(made))]
    return made, spans, [tuple(s) for s in segments]


_CLIP = pa.schema([("clip", pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))), ("start_s", pa.float64()), ("end_s", pa.float64())])


def to_tensors(clips: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of clips as fixed-shape tensors with their time spans."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CLIP) as out:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(clips, np.float32).ravel()), FRAMES * MELS)
        start, end = (pa.array([s[i] for s in spans], pa.float64()) for i in (0, 1))
        out.write_batch(pa.record_batch([pa.ExtensionArray.from_storage(_CLIP.field(0).type, flat), start, end], schema=_CLIP))
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Clips (n, FRAMES, MELS) and time spans of a stored stream."""
    read = pa.ipc.open_stream(stored).read_all().combine_chunks()
    clip = read.column("clip").chunk(0)
    return clip.to_numpy_ndarray(), list(zip(read.column("start_s").to_pylist(), read.column("end_s").to_pylist()))


def clips(analysed: DataFrame, id_col: str = "doc_id", tensors_col: str = "tensors") -> DataFrame:
    """(id_col, clip_no from 0, start_s, end_s, clip array<float>): the stored clips read back, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, stored in enumerate(batch.column(1)):
                made, spans = from_tensors(stored.as_py())
                for at in range(0, len(made), 256):
                    part, when = made[at : at + 256], spans[at : at + 256]
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * FRAMES * MELS
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(part), batch.schema.field(0).type), pa.array(np.arange(at, at + len(part))), *(pa.array([s[k] for s in when], pa.float64()) for k in (0, 1)), pa.ListArray.from_arrays(offsets, part.ravel())],
                        names=["key", "clip_no", "start_s", "end_s", "clip"],
                    )

    kind = analysed.schema[id_col].dataType.simpleString()
    return analysed.select(F.col(id_col).alias("key"), tensors_col).mapInArrow(tidy(run), f"key {kind}, clip_no long, start_s double, end_s double, clip array<float>").withColumnRenamed("key", id_col)


def store(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media binary) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [payload_of(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(p) for _, p in made], pa.binary())], names=["key", "n_bytes", "media"])

    schema = T.StructType([T.StructField("key", documents.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("txt")).mapInArrow(tidy(run), schema).withColumnRenamed("key", id_col)


_SPAN = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
_READ = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("tensors", T.BinaryType()), T.StructField("n_clips", T.LongType()), T.StructField("segments", _SPAN),
    ]
)


def analyse(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with digests of the samples read back, clips as stored tensors with their spans, how many, and segments."""
    place, columns = media.columns.index(media_col), media.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        spans_of = lambda s: [{"start_s": a, "end_s": b} for a, b in s]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                payloads = [from_wav(x.as_py()) for x in part.column(place)]
                made = [features(p) for p in payloads]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, pa.array(map(len, payloads), pa.int64()), pa.array((hashlib.sha256(p).hexdigest() for p in payloads), pa.string()),
                        pa.array((zlib.crc32(p[-PAD:]) for p in payloads), pa.int64()), pa.array((to_tensors(c, s) for c, s, _ in made), pa.binary()),
                        pa.array((len(s) for _, s, _ in made), pa.int64()), pa.array([spans_of(s) for _, _, s in made], span),
                    ],
                    names=[*columns, *_READ.names],
                )

    return media.mapInArrow(tidy(run), T.StructType([*media.schema.fields, *_READ.fields]))


def report(documents: DataFrame) -> DataFrame:
    """Per document: sizes and digests of payload and file, and a feature string of clips and segments."""
    read = analyse(store(documents))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "n_clips", F.size("segments"), F.hex(F.xxhash64("tensors", "segments"))).alias("feature"),
    )
