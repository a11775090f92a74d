"""Media columns: texts or any bytes as 8-bit mono WAV, and audio features read back from the stored form.

``store_audio`` writes the bytes losslessly as unsigned 8-bit samples in a RIFF/WAVE container (a 44-byte header).
``audio_features`` parses the container again and yields, per row,

* ``payload``: the sample bytes read back;
* ``tensors``: the log-mel filterbank in windows of ``FRAMES`` frames, as an Arrow IPC stream whose batch has a row per window:
  its time span in seconds and a fixed-shape tensor (``FRAMES`` x ``MELS``, float32; Arrow's own tensor type). The last window is
  padded with the floor value. ``read_tensors`` opens such a cell, ``tensor_digest`` reads a column of them back;
* ``segments``: active spans by hysteresis on frame energy: a span opens at ``HIGH_DB`` and lasts while it stays over ``LOW_DB``.

Samples are first resampled by a polyphase filter from ``RATE`` to ``RATE * UP / DOWN`` (three of four samples, so three phases).
A recording is resampled and analysed in blocks of frames that overlap as the filter and the window need; besides the samples
and the result only one block is in memory.

Defined cases: null texts are empty; an empty text is one padding unit; texts of any length count whole (a Spark value has
under 2**31 bytes, so the container's 32-bit sizes suffice); extra columns pass through where they do not clash with the outputs
and those that clash are replaced; null media has null outputs; repeated rows give repeated results; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  pa.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, UP, DOWN = 8000, 3, 4
#: Window and hop in samples after resampling: 32 ms and 16 ms at 6 kHz.
WINDOW, HOP = 192, 96
MELS, FRAMES = 16, 32
TAPS = 8
HIGH_DB, LOW_DB, FLOOR_DB = -18.0, -24.0, -80.0
PAD, UNIT = b" ", 192
#: Frames that are resampled and analysed at once.
BLOCK = 2048


def padded(data: Column, unit: int = UNIT) -> Column:
    """Bytes with blanks appended up to a positive multiple of unit."""
    n = F.length(data)
    more = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit))).cast("int")
    return F.concat(data, F.repeat(F.lit(PAD.decode()), more).cast("binary"))


def wav_header(n: Column, rate: int = RATE) -> Column:
    """RIFF/WAVE header of n unsigned 8-bit mono samples; an odd n has no pad byte, so n must be even."""
    fmt = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), _swap(n + 36), F.lit(fmt), _swap(n))


def _swap(x: Column) -> Column:
    """A 32-bit number as four bytes, lowest first."""
    h = F.lpad(F.hex(x.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def store_audio(docs: DataFrame, text_col: str = "text", out: str = "media", unit: int = UNIT) -> DataFrame:
    """docs with the text replaced by its WAV form in ``out`` and its unpadded size in n_bytes."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    data = padded(raw, unit)
    return docs.withColumns({out: F.concat(wav_header(F.length(data)), data), "n_bytes": F.length(raw).cast("long")}).drop(text_col)


def read_wav(media: bytes | memoryview) -> tuple[int, np.ndarray]:
    """(rate, samples as bytes) of an 8-bit mono WAV, walking its chunks."""
    view = memoryview(media)
    if len(view) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV")
    at, rate = 12, 0
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is stored here")
        if kind == b"data":
            return rate, np.frombuffer(view[at + 8 : at + 8 + size], np.uint8)
        at += 8 + size + size % 2
    raise ValueError("WAV without data")


def resampling_filter(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass with ``taps`` coefficients a phase, as rows of phases."""
    n = taps * up * max(1, down // up)
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n)
    h *= up / h.sum()
    return h.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, first: int = 0, last: int | None = None) -> np.ndarray:
    """Polyphase resampling of x, output samples first .. last (by default all): sample m comes from phase (m * down) mod up
    only, and from the inputs around m * down / up; edges see zeros."""
    phases = resampling_filter(up, down)
    taps = phases.shape[1]
    left = taps // 2
    n = -(-len(x) * up // down)
    last = n if last is None else min(last, n)
    # the inputs that these outputs need
    low, high = first * down // up - left, ((last - 1) * down // up + taps) if last > first else 0
    line = np.zeros(max(0, high - low), np.float32)
    a, b = max(low, 0), min(high, len(x))
    line[a - low : b - low] = x[a:b]
    out = np.zeros(max(0, last - first), np.float32)
    for k in range(min(up, len(out))):
        m = first + k
        own = out[k::up]
        rows = np.lib.stride_tricks.sliding_window_view(line, taps)[m * down // up - left - low :: down]
        own[:] = rows[: len(own)] @ phases[m * down % up][::-1]
    return out


def mel_filters(rate: float = RATE * UP / DOWN, window: int = WINDOW, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally wide on the mel scale, as (bins, mels)."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    freq = np.linspace(0.0, rate / 2, window // 2 + 1)
    up = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(up, down)).astype(np.float32)


_STATE: dict[str, np.ndarray] = {}


def frame_count(n: int) -> int:
    """Frames of n samples; they overlap by WINDOW - HOP, and the last is padded with zeros."""
    return max(1, -(-max(0, n - WINDOW) // HOP) + 1)


def log_mel(y: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n frames x MELS log-mel in dB, frame energy in dB) of resampled samples."""
    if not _STATE:
        _STATE.update(mel=mel_filters(), hann=np.hanning(WINDOW).astype(np.float32))
    n = frame_count(len(y)) if n is None else n
    line = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    line[: len(y)] = y
    part = np.lib.stride_tricks.sliding_window_view(line, WINDOW)[::HOP] * _STATE["hann"]
    spectrum = np.fft.rfft(part, axis=1)
    power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) / WINDOW
    mel = 10.0 * np.log10(np.maximum(power @ _STATE["mel"], 1e-8))
    return mel, 10.0 * np.log10(np.maximum(np.einsum("ij,ij->i", part, part) / WINDOW, 1e-8))


def hysteresis(energy: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> np.ndarray:
    """Spans [first, last + 1) of frames over low that hold at least one frame over high."""
    over = np.concatenate([[False], energy >= low, [False]])
    starts, ends = np.flatnonzero(over[1:] & ~over[:-1]), np.flatnonzero(~over[1:] & over[:-1])
    peaks = np.concatenate([[0], np.cumsum(energy >= high)])
    keep = peaks[ends] > peaks[starts]
    return np.stack([starts[keep], ends[keep]], axis=1)


def features_of(samples: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(windows x FRAMES x MELS in float32, active frame spans) of unsigned 8-bit samples, ``block`` frames at a time."""
    n = -(-len(samples) * UP // DOWN)
    frames = frame_count(n)
    windows = -(-frames // FRAMES)
    out, energy = np.full((windows * FRAMES, MELS), FLOOR_DB, np.float32), np.empty(frames, np.float32)
    # inputs of a block's outputs: a filter's length more on either side
    margin = 2 * resampling_filter().shape[1] * UP
    for at in range(0, frames, block):
        end = min(at + block, frames)
        first, last = at * HOP, min((end - 1) * HOP + WINDOW, n)
        base = max(0, first * DOWN // UP - margin) // DOWN * DOWN  # a multiple of DOWN inputs is a whole number of outputs
        part = (samples[base : last * DOWN // UP + margin].astype(np.float32) - 128.0) / 128.0
        shift = base * UP // DOWN
        y = resample(part, first=first - shift, last=last - shift)
        mel, energy[at:end] = log_mel(y, end - at)
        out[at:end] = np.round(mel, 2)
    return out.reshape(windows, FRAMES, MELS), hysteresis(energy)


#: Rows of a tensors cell.
TENSOR = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("values", pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel")))])
SEGMENT = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


def audio_features(media: DataFrame, media_col: str = "media", batch_bytes: int = 1 << 21) -> DataFrame:
    """media plus payload, tensors and segments; see the module's text. Rows with null media have null outputs."""
    keep = [c for c in media.columns if c not in ("payload", "tensors", "segments")]
    fields = ", ".join(f"`{c}` {t}" for c, t in media.select(*keep).dtypes)
    schema = f"{fields}, payload binary, tensors binary, segments array<struct<start_s: double, end_s: double>>"
    step = HOP / (RATE * UP / DOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in batch.column(media_col)]) if batch.num_rows else []
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                end = min(max(int(np.searchsorted(sizes, base + batch_bytes, "right")), start + 1), batch.num_rows)
                yield _feature_batch(batch.slice(start, end - start), keep, media_col, step)
                start = end

    return media.select(*keep).mapInArrow(run, schema)


def _feature_batch(batch: pa.RecordBatch, keep: list[str], media_col: str, step: float) -> pa.RecordBatch:
    payloads, tensors, spans, active, valid = [], [], [np.zeros((0, 2))], [0], []
    for x in batch.column(media_col):
        valid.append(x.is_valid)
        if not x.is_valid:
            payloads.append(None)
            tensors.append(None)
            active.append(active[-1])
            continue
        _, samples = read_wav(x.as_buffer())
        values, segments = features_of(samples)
        payloads.append(samples.tobytes())
        tensors.append(write_tensors(values, step))
        spans.append(segments)
        active.append(active[-1] + len(segments))
    lines = np.concatenate(spans) * step
    segments = pa.ListArray.from_arrays(pa.array(np.array(active, np.int32)), pa.StructArray.from_arrays([pa.array(lines[:, 0]), pa.array(lines[:, 1])], fields=list(SEGMENT)), mask=pa.array([not v for v in valid]))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(payloads, pa.binary()), pa.array(tensors, pa.binary()), segments], names=[*keep, "payload", "tensors", "segments"])


def write_tensors(values: np.ndarray, step: float) -> bytes:
    """Windows of frames (each ``step`` seconds) as an Arrow IPC stream of fixed-shape tensors with time spans."""
    start = np.arange(len(values)) * (FRAMES * step)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(start + FRAMES * step), pa.ExtensionArray.from_storage(TENSOR.field("values").type, storage)], schema=TENSOR)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(cell: bytes | pa.Buffer) -> pa.Table:
    """(start_s, end_s, values) of the windows in one cell; ``values`` has Arrow's fixed-shape tensor type."""
    return pa.ipc.open_stream(cell).read_all()


def tensor_digest(features: DataFrame, out: str = "digest") -> DataFrame:
    """features with ``out`` instead of tensors: windows, frames, mels and the SHA-256 of all spans and values, read back from the cells."""
    keep = [c for c in features.columns if c not in ("tensors", out)]
    schema = ", ".join(f"`{c}` {t}" for c, t in features.select(*keep).dtypes) + f", `{out}` string"

    def one(cell: pa.Scalar) -> str | None:
        if not cell.is_valid:
            return None
        t = read_tensors(cell.as_buffer()).combine_chunks()
        values = t["values"].combine_chunks().to_numpy_ndarray()
        digest = hashlib.sha256(values.tobytes())
        for name in ("start_s", "end_s"):
            digest.update(t[name].to_numpy().tobytes())
        return ":".join([*map(str, values.shape), digest.hexdigest()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([one(x) for x in batch.column("tensors")], pa.string())], names=[*keep, out])

    return features.select(*keep, "tensors").mapInArrow(run, schema)
