"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

Texts stand for sounds: their bytes are the samples of an 8-bit mono WAV, which keeps them losslessly. Features are kept as
Arrow record batches with a fixed-shape tensor column and time spans, many documents to a block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetric.llm.work import slices, text_or_empty

PAD = 64
RATE = 16_000
UP, DOWN = 1, 2
HALF_TAPS = 8
FRAME, HOP = 256, 128
MELS = 20
WINDOW_FRAMES = 16
RISE, FALL = 0.6, 0.4
BLOCK_DOCS = 500

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
            "media_sha256 string, feature string, n_windows int, segments string")

_TENSOR = pa.fixed_shape_tensor(pa.float16(), [WINDOW_FRAMES, MELS], dim_names=["frame", "mel"])
BLOCK = pa.schema([
    ("row", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("segments", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", _TENSOR)])


def to_wav(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and the WAV of them with zeros up to a positive multiple of PAD."""
    raw = text.encode()
    size = max(PAD, -(-len(raw) // PAD) * PAD)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)
    return len(raw), head + raw + bytes(size - len(raw))


def from_wav(media: bytes) -> bytes:
    """The samples, from the data chunk wherever it stands."""
    at = 12
    while media[at:at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8:at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


@lru_cache(maxsize=8)
def lowpass(up: int, down: int, half: int = HALF_TAPS) -> np.ndarray:
    """Windowed sinc that cuts at the lower of both rates; its taps sum to ``up``."""
    widest = max(up, down)
    k = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(k / widest) * np.hanning(len(k) + 2)[1:-1]
    return (taps * up / taps.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """The signal at ``up / down`` times its rate. Each output phase has its own part of the filter, and each part runs
    over every ``down``-th sample only; no zero is multiplied and no dropped sample is computed."""
    taps = lowpass(up, down)
    delay = len(taps) // 2
    length = -(-len(x) * up // down)
    out = np.zeros(length, dtype=np.float32)
    for r in range(min(up, length)):
        places = np.arange(r, length, up)
        phase, first = (r * down + delay) % up, (r * down + delay) // up
        part = taps[phase::up]
        total = np.zeros(len(places), dtype=np.float32)
        for m in range(min(down, len(part))):
            branch, origin = part[m::down], first - m
            # samples origin, origin + down, ... and, for the filter's past, those before them
            start = origin - down * (len(branch) - 1)
            stop = origin + down * (len(places) - 1) + 1
            padded = np.pad(x[max(start, 0):max(stop, 0)], (max(-start, 0), max(0, stop - max(len(x), 0))))
            total += np.convolve(padded[::down], branch, "valid")[:len(places)]
        out[places] = total
    return out


@lru_cache(maxsize=4)
def mel_filters(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles of equal width on the mel scale, one column per band."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    corners = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1) * frame / rate
    bins = np.arange(frame // 2 + 1)[:, None]
    rising = (bins - corners[:-2]) / (corners[1:-1] - corners[:-2])
    falling = (corners[2:] - bins) / (corners[2:] - corners[1:-1])
    return np.maximum(0, np.minimum(rising, falling)).astype(np.float32)


@lru_cache(maxsize=2)
def _hann(frame: int) -> np.ndarray:
    return np.hanning(frame + 1)[:-1].astype(np.float32)


def log_mel(signal: np.ndarray, rate: int) -> np.ndarray:
    """Log power per frame and mel band; frames overlap by half, the last is filled up with silence."""
    frames = max(1, -(-max(len(signal) - FRAME, 0) // HOP) + 1)
    padded = np.pad(signal, (0, max(0, FRAME + (frames - 1) * HOP - len(signal))))
    cut = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:frames] * _hann(FRAME)
    spectrum = np.fft.rfft(cut, axis=1)
    power = (spectrum.real ** 2 + spectrum.imag ** 2).astype(np.float32)
    return np.log(power @ mel_filters(rate) + np.float32(1e-6))


def active_segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that begin when the energy rises above RISE and end when it falls below FALL, between its quiet (0) and
    its loud (1) level, the tenth and ninetieth percentile. Even energy has no segments."""
    energy = mel.mean(axis=1)
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    level = (energy - quiet) / max(loud - quiet, 1e-6)
    mark = np.where(level > RISE, 1, np.where(level < FALL, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] > 0), [False]])
    turns = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def windows(mel: np.ndarray) -> np.ndarray:
    """Tensors of WINDOW_FRAMES frames; the last is filled up with its lowest value."""
    count = -(-len(mel) // WINDOW_FRAMES)
    full = np.pad(mel, ((0, count * WINDOW_FRAMES - len(mel)), (0, 0)), constant_values=mel.min())
    return full.reshape(count, WINDOW_FRAMES, MELS).astype(np.float16)


def store_media(docs: DataFrame, path: str) -> None:
    """Write ``doc_id, n_bytes, media`` (a WAV) for ``docs(doc_id, text)``; null texts are empty and give 64 zeros."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [to_wav(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())],
                ["doc_id", "n_bytes", "media"])

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
     .mapInArrow(each, MEDIA).write.option("compression", "zstd").parquet(path))


def _describe(media: bytes) -> tuple[tuple, np.ndarray, np.ndarray]:
    payload = from_wav(media)
    signal = (np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128) / 128
    rate = RATE * UP // DOWN
    mel = log_mel(resample(signal), rate)
    spans = ";".join(f"{a * HOP / rate:.3f}-{b * HOP / rate:.3f}" for a, b in active_segments(mel))
    tensors = windows(mel)
    starts = np.arange(len(tensors)) * WINDOW_FRAMES * HOP / rate
    facts = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media),
             hashlib.sha256(media).hexdigest(), spans)
    return facts, tensors, starts


def store_features(spark: SparkSession, media_path: str, path: str) -> None:
    """Read the stored media back and write their features: rows of one Arrow stream (schema BLOCK) for up to BLOCK_DOCS documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                yield pa.RecordBatch.from_pydict({"block": pa.array([_block(batch.slice(start, BLOCK_DOCS))], pa.binary())})

    (spark.read.schema(MEDIA).parquet(media_path).mapInArrow(each, "block binary")
     .write.option("compression", "zstd").parquet(path))


def _block(batch: pa.RecordBatch) -> bytes:
    heads, tensors, starts = [], [], []
    for doc_id, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
        facts, t, s = _describe(media)
        heads.extend([(len(tensors), doc_id, n, *facts)] * len(t))
        tensors.append(t)
        starts.append(s)
    begin = np.concatenate(starts)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*heads), BLOCK)]
    columns += [pa.array(begin), pa.array(begin + WINDOW_FRAMES * HOP * DOWN / (RATE * UP)),
                pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate(tensors), dim_names=["frame", "mel"])]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, BLOCK) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=BLOCK))
    return sink.getvalue().to_pybytes()


def read_block(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the stored tensors: sizes and digests of payload and media, and ``feature``, a digest of all
    its tensors and time spans. Equal texts have equal values."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                table = read_block(block.as_py()).combine_chunks()
                row = table["row"].to_numpy()
                first = np.flatnonzero(np.diff(row, prepend=-1))
                tensors = np.ascontiguousarray(table["tensor"].chunk(0).to_numpy_ndarray())
                spans = np.stack([table["start_s"].to_numpy(), table["end_s"].to_numpy()], axis=1)
                heads = table.select(names[:7]).take(first)
                segments = table["segments"].take(pa.array(first)).to_pylist()
                ends = [*first[1:].tolist(), len(row)]
                digests = [hashlib.sha256(tensors[a:b].tobytes() + spans[a:b].tobytes() + s.encode()).hexdigest()
                           for a, b, s in zip(first.tolist(), ends, segments)]
                counts = np.diff([*first.tolist(), len(row)])
                yield pa.RecordBatch.from_arrays(
                    [*[c.combine_chunks() for c in heads.columns], pa.array(digests), pa.array(counts, pa.int32()), pa.array(segments)], names)

    return spark.read.schema("block binary").parquet(path).mapInArrow(each, FEATURES)
