r"""Media columns: bytes as 8-bit audio, and features of the audio as fixed-shape tensors.

Storing.  A payload (bytes, padded with 255 to a positive multiple of 576) is kept as the
samples of a mono 8-bit PCM WAVE file at 16 kHz, losslessly, in a binary column.

Features of the stored samples, document by document, so that equal texts give equal values:

* polyphase resampling by 1/2: a windowed-sinc filter of 16 taps in two phases;
* log-mel energies of 24 bands over frames of 200 samples every 100, by FFT;
* segments of energy with hysteresis: a segment begins above the high threshold and ends
  below the low one, thresholds being set from the document's own energies.

Features are stored in tensors of shape (FRAMES, BANDS), int16 in steps of 1 / STEP, the last
one of a document padded with its floor; beside each are its time span and the spans of the
energy segments that begin in it.  as_tensors() gives mel as a fixed-shape tensor column.

Null text is an empty text: 576 bytes of 255.  A text of any length is one sample row and as
many tensors as it needs.  Repeated rows each give theirs, told apart by `row`.  An empty
table gives no rows.  Other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

UNIT, RATE, FRAME, HOP, FFT, BANDS, FRAMES = 576, 16_000, 200, 100, 256, 24, 32
FLOOR = np.float32(-10.0)
STEP = 256
STORED = "row long, doc_id long, n_bytes long, media binary"
FEATURES = "row long, doc_id long, tensor int, frames int, begin_ms double, end_ms double, mel array<short>, segments array<struct<begin_ms:double,end_ms:double>>"


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wave(payload: bytes) -> bytes:
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    body = head + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wave(media: bytes) -> bytes:
    """The samples of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(16) - 7.5
    taps = np.sinc(n / 2) * np.hamming(16) / 2
    taps = (taps / taps.sum()).astype(np.float32)
    return taps[0::2], taps[1::2]


@cache
def _bank() -> np.ndarray:
    """Triangular mel filters over FFT bins at half the rate, (bins, BANDS)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    top = RATE / 4
    points = 700 * (10 ** (np.linspace(0, mel(top), BANDS + 2) / 2595) - 1)
    bins = np.linspace(0, top, FFT // 2 + 1)[:, None]
    low, mid, high = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Half the rate: each phase filters every second sample, and the sums are the output."""
    even, odd = _phases()
    x = np.pad(samples, (8, 8 + len(samples) % 2))
    return np.convolve(x[0::2], even[::-1], "valid")[: (len(samples) + 1) // 2] + np.convolve(x[1::2], odd[::-1], "valid")[: (len(samples) + 1) // 2]


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, BANDS) of 8-bit samples as floats; the last frame is padded with silence."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, max(0, (n - 1) * HOP + FRAME - len(x)))).astype(np.float32)
    out = np.empty((n, BANDS), np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for a in range(0, n, 512):
        power = np.abs(np.fft.rfft(frames[a : a + 512] * window, FFT)) ** 2
        out[a : a + 512] = np.log(power.astype(np.float32) @ _bank() + np.exp(FLOOR))
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that begin over the high threshold and last while over the low one."""
    middle, spread = float(np.median(energy)), float(energy.std())
    high, low = energy > middle + spread / 2, energy > middle - spread / 4
    begins = np.flatnonzero(high)
    drops = np.flatnonzero(~low)
    out, at = [], 0
    while (k := np.searchsorted(begins, at)) < len(begins):
        start = int(begins[k])
        d = np.searchsorted(drops, start)
        at = int(drops[d]) if d < len(drops) else len(energy)
        out.append((start, at))
    return out


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(samples))
    return mel, segments(mel.mean(axis=1))


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> STORED.  row is a number of the written row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
        media = pa.array([to_wave(pad(x)) for x in raw], pa.binary())
        return pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), media], names=["row", "doc_id", "n_bytes", "media"])

    return arrow_pass(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), each, STORED)


def checksums(stored: DataFrame) -> DataFrame:
    """STORED -> its columns without media, and checksums of the payload read back and of the stored form."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch["media"]:
            media = value.as_py()
            payload = from_wave(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        out = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]
        return pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["n_bytes"], *out], names=["row", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])

    return arrow_pass(stored, each, "row long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string")


def tensors(stored: DataFrame) -> DataFrame:
    """STORED -> FEATURES, one row a tensor."""
    ms = HOP * 2000 / RATE  # of a frame's step; the features have half the rate

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, doc, number, frames, mels, spans = [], [], [], [], [], []
        for r, d, value in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["media"], strict=True):
            mel, parts = features(from_wave(value.as_py()))
            n = -(-len(mel) // FRAMES)
            held = np.full((n * FRAMES, BANDS), FLOOR * STEP, np.int16)
            held[: len(mel)] = np.clip(np.rint(mel * STEP), -32768, 32767)
            mels.append(held.reshape(n, -1))
            row += [r] * n
            doc += [d] * n
            number += range(n)
            frames += [min(FRAMES, len(mel) - k * FRAMES) for k in range(n)]
            own: list[list] = [[] for _ in range(n)]
            for a, b in parts:
                own[a // FRAMES].append({"begin_ms": a * ms, "end_ms": b * ms})
            spans += own
        if not row:
            return None
        values, k, count = np.concatenate(mels), np.array(number), np.array(frames)
        at = pa.array((np.arange(len(values) + 1) * FRAMES * BANDS).astype(np.int32))
        begin = k * FRAMES * ms
        kind = pa.list_(pa.struct([("begin_ms", pa.float64()), ("end_ms", pa.float64())]))
        out = [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(frames, pa.int32()), pa.array(begin), pa.array(begin + (count - 1) * ms + FRAME * 2000 / RATE)]
        out += [pa.ListArray.from_arrays(at, pa.array(values.ravel())), pa.array(spans, kind)]
        return pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "tensor", "frames", "begin_ms", "end_ms", "mel", "segments"])

    return arrow_pass(stored, each, FEATURES)


def described(kept: DataFrame) -> DataFrame:
    """FEATURES as read back -> row and its features in short; whole numbers are summed, so the order doesn't count."""
    bands = range(0, BANDS, BANDS // 6)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        mel = batch["mel"].flatten().to_numpy(zero_copy_only=False).reshape(-1, FRAMES, BANDS)[:, :, bands.start :: bands.step].astype(np.int64)
        frames = batch["frames"].to_numpy()
        sums = (mel * (np.arange(FRAMES)[None, :, None] < frames[:, None, None])).sum(axis=1)
        return pa.RecordBatch.from_arrays([batch["row"], batch["frames"], *[pa.array(sums[:, k]) for k in range(6)]], names=["row", "frames", *[f"b{k}" for k in range(6)]])

    sums = arrow_pass(kept.select("row", "frames", "mel"), each, "row long, frames int, " + ", ".join(f"b{k} long" for k in range(6)))
    length = F.aggregate("segments", F.lit(0.0), lambda x, y: x + y["end_ms"] - y["begin_ms"])
    spans = kept.select("row", F.size("segments").alias("n"), length.cast("long").alias("ms"), F.array_min("segments.begin_ms").cast("long").alias("first"))
    # Either side keeps one row a row: both are summed in one pass over the union, grouped once.
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    both = sums.select("row", F.col("frames").cast("long"), *[f"b{k}" for k in range(6)], *none("n", "ms", "first"))
    both = both.unionByName(spans.select("row", *none("frames", *[f"b{k}" for k in range(6)]), F.col("n").cast("long"), "ms", "first"))
    whole = both.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("frames", "n", "ms", *[f"b{k}" for k in range(6)])], F.min("first").alias("first"))
    means = F.concat_ws(",", *[F.round(F.col(f"b{k}") / (F.col("frames") * STEP), 1).cast("string") for k in range(6)])
    text = F.concat(F.lit("frames="), "frames", F.lit(";segments="), "n", F.lit(";held_ms="), "ms", F.lit(";first_ms="), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(";mel="), means)
    return whole.select("row", text.alias("feature"))


def as_tensors(kept: pa.Table) -> pa.Table:
    """FEATURES as Arrow, with mel as a fixed-shape tensor column."""
    flat = kept["mel"].combine_chunks()
    values = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    kind = pa.fixed_shape_tensor(pa.int16(), (FRAMES, BANDS))
    held = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, FRAMES * BANDS))
    return kept.set_column(kept.schema.get_field_index("mel"), "mel", held)
