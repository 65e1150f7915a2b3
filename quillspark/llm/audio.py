"""Audio features of media columns: polyphase resampling, log-mel filterbanks, and hysteresis energy segmentation.

A media column holds WAV files of 8-bit mono samples. Their features are fixed-shape tensors of log-mel frames, cut at
the segments of sound, with the time span of each.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, new_path, table

#: Samples a second as stored and as analysed; the ratio is UP / DOWN, and each phase of the filter has TAPS taps.
STORED_RATE, RATE, UP, DOWN, TAPS = 16_000, 12_000, 3, 4, 16
#: Frame, hop and filters of the filterbank; frames of a tensor.
FRAME, HOP, MELS, TENSOR_FRAMES = 384, 192, 24, 64
#: Decibels below the loudest frame at which a segment begins, and at which it ends.
BEGIN_DB, END_DB = 6.0, 9.0
#: A payload is padded with PAD to a positive multiple of UNIT.
UNIT, PAD = 192, b" "
#: Samples that are resampled, and frames that are transformed, at once: bounds memory for long sound.
BLOCK_SAMPLES, BLOCK_FRAMES = 1 << 18, 2048
#: Tensors from which a row group of a tensor file is closed.
GROUP_TENSORS = 2048


def padded(data: bytes) -> bytes:
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), PAD)


def to_wav(payload: bytes) -> bytes:
    """A RIFF file with the payload as unsigned 8-bit mono samples."""
    n = len(payload)
    odd = n % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + odd, b"WAVE", b"fmt ", 16, 1, 1, STORED_RATE, STORED_RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * odd


def from_wav(media: bytes) -> bytes:
    """The samples of a file that ``to_wav`` made, or any 8-bit mono one; raises ValueError on others."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack("<I", media[4:8])[0] != len(media) - 8:
        raise ValueError("no RIFF file of this length")
    at, kind = 12, None
    while at + 8 <= len(media):
        name, n = struct.unpack("<4sI", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if len(body) != n:
            raise ValueError("a chunk is cut off")
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            if kind is None or kind[0] != 1 or kind[1] != 1 or kind[5] != 8:
                raise ValueError("not 8-bit mono samples")
            return body
        at += 8 + n + n % 2
    raise ValueError("no samples")


@functools.cache
def _filter() -> np.ndarray:
    """The low-pass filter's phases as a matrix: samples around DOWN inputs -> UP outputs."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hamming(n) / DOWN * UP
    # output r of a group starts at input r * DOWN // UP and uses phase r * DOWN % UP
    out = np.zeros((TAPS + DOWN, UP))
    for r in range(UP):
        at, phase = divmod(r * DOWN, UP)
        out[at : at + TAPS, r] = h[phase::UP][::-1][:TAPS]
    return out.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """RATE / STORED_RATE as many samples, DOWN at a time to UP; the length is a multiple of DOWN."""
    half = TAPS // 2
    x = np.concatenate([np.zeros(half, np.float32), x, np.zeros(half + DOWN, np.float32)])
    groups = (len(x) - 2 * half - DOWN) // DOWN
    out = np.empty((groups, UP), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, TAPS + DOWN)[::DOWN]
    step = BLOCK_SAMPLES // DOWN
    for i in range(0, groups, step):
        out[i : i + step] = np.ascontiguousarray(view[i : min(i + step, groups)]) @ _filter()
    return out.reshape(-1)


@functools.cache
def _bank() -> tuple[np.ndarray, np.ndarray]:
    """Window, and triangular mel filters over the bins of a frame."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(60), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE)[:, None]
    up, down = (f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """Decibels of each filter in overlapping frames, in tenths as int16; one frame at least."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    window, bank = _bank()
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(view), MELS), np.int16)
    for i in range(0, len(view), BLOCK_FRAMES):
        power = np.abs(np.fft.rfft(view[i : i + BLOCK_FRAMES] * window)) ** 2
        out[i : i + BLOCK_FRAMES] = np.rint(100 * np.log10(power.astype(np.float32) @ bank + np.float32(1e-6)))
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frames [begin, end) of sound: from a frame near the loudest until one that falls below the lower threshold."""
    energy = 10 * np.log10((10.0 ** (mel / 100)).sum(1))
    state = np.where(energy >= energy.max() - BEGIN_DB, 1, np.where(energy < energy.max() - END_DB, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(last >= 0, state[last], 0), [0]])
    edges = np.flatnonzero(np.diff(on))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


@dataclass
class Features:
    mel: np.ndarray
    spans: list[tuple[int, int]]

    def tensors(self) -> Iterator[tuple[int, float, float, np.ndarray]]:
        """(segment, first second, last second, TENSOR_FRAMES x MELS) of every piece; short ones end in zeros."""
        for k, (a, b) in enumerate(self.spans):
            for i in range(a, b, TENSOR_FRAMES):
                part = self.mel[i : min(b, i + TENSOR_FRAMES)]
                t = np.zeros((TENSOR_FRAMES, MELS), np.float32)
                t[: len(part)] = part / 10
                yield k, i * HOP / RATE, ((i + len(part) - 1) * HOP + FRAME) / RATE, t

    def summary(self) -> str:
        """Frames, segments, sounding frames, mean decibels, and a digest of spans and frames."""
        digest = hashlib.sha256(np.array(self.spans, "<i8").tobytes())
        digest.update(self.mel.astype("<i2").tobytes())
        return f"{len(self.mel)}x{MELS};{len(self.spans)};{sum(b - a for a, b in self.spans)};{int(self.mel.sum(dtype=np.int64) // self.mel.size)};{digest.hexdigest()[:32]}"


def features(samples: bytes) -> Features:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x = np.concatenate([x, np.zeros(-len(x) % DOWN, np.float32)])
    mel = log_mel(resample(x))
    return Features(mel, segments(mel))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (id, n_bytes, media) of every row to the shared folder and return the written table.

    A null text is an empty one, and an empty one UNIT bytes of padding. Ids may be null or repeated.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(padded(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return table(own.mapInArrow(rows, f"id {kind}, n_bytes long, media binary"), "media", "zstd")


def tensors(media: DataFrame) -> DataFrame:
    """(id, segment, begin_s, end_s, tensor) of a table (id, media); ``tensor`` is row-major TENSOR_FRAMES x MELS.

    A null media file has no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in zip(b.column("id").to_pylist(), b.column("media").to_pylist()):
                found = list(features(from_wav(m)).tensors()) if m is not None else []
                for at in range(0, len(found), 256):
                    k, t0, t1, x = zip(*found[at : at + 256])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TENSOR_FRAMES * MELS, pa.int32()), pa.array(np.concatenate([v.ravel() for v in x])))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), b.schema.field("id").type), pa.array(k, pa.int32()), pa.array(t0), pa.array(t1), flat], ["id", "segment", "begin_s", "end_s", "tensor"])

    bounded_batches(media.sparkSession)
    kind = media.schema["id"].dataType.simpleString()
    return media.where("media is not null").select("id", "media").mapInArrow(rows, f"id {kind}, segment int, begin_s double, end_s double, tensor array<float>")


def as_tensor_column(rows: pa.Table) -> pa.Table:
    """Rows of ``tensors`` with the column as a fixed-shape Arrow tensor, for Arrow and Parquet files."""
    kind = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS], dim_names=["frame", "mel"])
    flat = rows.column("tensor").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) and flat.num_chunks else flat
    values = flat.flatten() if len(rows) else pa.array([], pa.float32())
    fixed = pa.FixedSizeListArray.from_arrays(values, TENSOR_FRAMES * MELS)
    return rows.set_column(rows.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, fixed))


def digests(media: DataFrame) -> DataFrame:
    """A row per media file: sizes and digests of the samples and of the file as stored, and the features' summary.

    Rows without media, here and in the other readers of media, give none.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
        for b in batches:
            found = []
            for m in b.column("media").to_pylist():
                p = from_wav(m)
                found.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(p).summary()))
            cols = [pa.array([x[k] for x in found], t) for k, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *cols], ["id", "n_bytes", *(c for c, _ in kinds)])

    bounded_batches(media.sparkSession)
    kind = media.schema["id"].dataType.simpleString()
    return media.where("media is not null").select("id", "n_bytes", "media").mapInArrow(
        rows, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


_FILE = [("id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string")]
_PLACE = [("path", "string"), ("row_group", "int"), ("first", "long"), ("tensors", "long")]


def _arrow(kinds: list[tuple[str, str]], rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(kinds)], [c for c, _ in kinds])


def store_tensors(media: DataFrame) -> DataFrame:
    """Write the tensors of all media files to the shared folder; a row per media file with digests and the tensors' place.

    Ids have to be numbers that fit in a long; others raise.

    A partition writes a Parquet file (segment, begin_s, end_s, tensor) of the fixed-shape Arrow type. A task that is run
    again writes a file of a new name; the table names those of the attempt that succeeded.
    """
    folder = new_path(media.sparkSession, "tensors")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, writer, group = f"part-{uuid.uuid4().hex}.parquet", None, 0
        held, places = [], []

        def write() -> None:
            nonlocal writer, group, held
            flat = np.concatenate([x[3].ravel() for x in held]) if held else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * TENSOR_FRAMES * MELS, pa.int32()), pa.array(flat, pa.float32()))
            cols = [pa.array([x[k] for x in held], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            t = as_tensor_column(pa.Table.from_arrays([*cols, lists], ["segment", "begin_s", "end_s", "tensor"]))
            writer = writer or pq.ParquetWriter(base + "/" + name, t.schema, filesystem=store, compression="zstd")
            writer.write_table(t, row_group_size=max(1, len(held)))
            group, held = group + 1, []

        for b in batches:
            for i, n, m in zip(b.column("id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
                p, first = from_wav(m), len(held)
                held.extend(features(p).tensors())
                own = (i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest())
                places.append((*own, f"{folder}/{name}", group, first, len(held) - first))
                if len(held) >= GROUP_TENSORS:
                    write()
            yield _arrow(_FILE + _PLACE, places)
            places = []
        if held:
            write()
        if writer:
            writer.close()

    bounded_batches(media.sparkSession)
    return table(media.where("media is not null").select(F.col("id").cast("long"), "n_bytes", "media").mapInArrow(rows, ", ".join(f"{c} {t}" for c, t in _FILE + _PLACE)), "digests")


def tensor_summary(t: pa.Table) -> str:
    """Shape, segments, sounding frames, their mean decibels, and a digest of spans and frames of one media file's tensors."""
    begin, end = t.column("begin_s").to_numpy(), t.column("end_s").to_numpy()
    frames = np.rint(((end - begin) * RATE - FRAME) / HOP).astype(np.int64) + 1
    x = t.column("tensor").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    x = x.to_numpy_ndarray()
    sound = np.rint(x[np.arange(TENSOR_FRAMES) < frames[:, None]] * 10).astype("<i2")
    digest = hashlib.sha256(np.stack([t.column("segment").to_numpy().astype("<f8"), begin, end], 1).astype("<f8").tobytes())
    digest.update(sound.tobytes())
    segments_ = len(np.unique(t.column("segment").to_numpy()))
    return f"{len(x)}x{TENSOR_FRAMES}x{MELS};{segments_};{int(frames.sum())};{int(sound.sum(dtype=np.int64) // sound.size)};{digest.hexdigest()[:32]}"


def stored_digests(stored: DataFrame) -> DataFrame:
    """The rows of ``store_tensors`` with the summary of the tensors as read back, instead of their place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, group, file, source, t = None, None, None, None, None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["path"] != path:
                    if source is not None:
                        source.close()
                    path, group = r["path"], None
                    store, at = fs.FileSystem.from_uri(path)
                    source = store.open_input_file(at)
                    file = pq.ParquetFile(source)
                if r["row_group"] != group:
                    group = r["row_group"]
                    t = file.read_row_group(group)
                found.append((*(r[c] for c, _ in _FILE), tensor_summary(t.slice(r["first"], r["tensors"]))))
            yield _arrow([*_FILE, ("feature", "string")], found)
        if source is not None:
            source.close()

    return stored.mapInArrow(rows, ", ".join(f"{c} {t}" for c, t in [*_FILE, ("feature", "string")]))
