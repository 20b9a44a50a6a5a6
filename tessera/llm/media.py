"""Media columns: texts as WAV samples, short-time spectra and spectral-peak pairs."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches

RATE, PAD = 8000, 64
#: Samples a frame, samples from frame to frame, frames that are transformed at a time.
FRAME, HOP, BLOCK = 256, 128, 4096
#: Frequency bands with one peak each (bins of the spectrum), partners a peak, frames ahead.
BANDS, PARTNERS, AHEAD = ((1, 9), (9, 25), (25, 65), (65, 129)), 3, 63

_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file, one channel of 8-bit samples, that holds ``payload`` unchanged."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of 8-bit samples in one channel."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Power spectra of overlapping windowed frames, in blocks of frames; one frame at least."""
    x = samples.astype(np.float32) - 128.0
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, len(frames), BLOCK):
        z = np.fft.rfft(frames[at : at + BLOCK] * _WINDOW, axis=1)
        yield z.real**2 + z.imag**2


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of the spectral-peak pairs of a signal.

    A frame's peak in a band is its strongest bin, in steps of 0.1 dB, the lower of
    equals; it counts if neither neighbour frame is stronger at that bin. Each peak
    is paired with the next PARTNERS peaks up to AHEAD frames later; a pair's code
    is first bin * 2^16 + second bin * 2^8 + frames between, its time the first's.
    """
    times, bins, shift = [], [], 0
    last: np.ndarray | None = None  # a block's last frames wait for what follows
    blocks = list(spectra(np.frombuffer(payload, np.uint8)))
    for k, power in enumerate(blocks):
        level = np.rint(100 * np.log10(power + 1e-6)).astype(np.int32)
        before = level[:1] if last is None else last
        after = level[-1:]
        if k + 1 < len(blocks):
            after = np.rint(100 * np.log10(blocks[k + 1][:1] + 1e-6)).astype(np.int32)
        padded = np.concatenate([before, level, after])
        for a, b in BANDS:
            top = level[:, a:b].argmax(axis=1) + a
            row = np.arange(len(level))
            own = level[row, top]
            kept = (own >= padded[row, top]) & (own >= padded[row + 2, top]) & (own > 0)
            times.append(row[kept] + shift)
            bins.append(top[kept])
        last, shift = level[-1:], shift + len(level)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    t, f = t[order], f[order]
    at, codes = [], []
    for step in range(1, PARTNERS + 1):
        gap = t[step:] - t[:-step]
        near = gap <= AHEAD
        at.append(t[:-step][near])
        codes.append((f[:-step][near] << 16) + (f[step:][near] << 8) + gap[near])
    at, codes = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes, at))
    return at[order].astype(np.int32), codes[order].astype(np.int32)


MEDIA = "k {kind}, n_bytes bigint, media binary, payload binary, fingerprint array<struct<time:int,code:int>>"


def media_columns(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every whole text as a WAV file and its spectral fingerprint.

    Returns ``key``, n_bytes (of the text in UTF-8), media (the WAV file), payload
    (its samples, read back from it: the text and bytes 0 up to a positive multiple
    of 64) and fingerprint (time-coded peak pairs, by time then code). A null text
    counts as empty. Equal texts give equal values, so repeated rows do too; an
    empty table gives an empty result; other columns are ignored. Spectra are made
    in blocks of frames, so a long text needs memory in proportion to its length only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sizes, media, back, times, codes, ends = [], [], [], [], [], [0]
                for data in part["data"].to_pylist():
                    sizes.append(len(data))
                    media.append(to_wav(data + bytes(PAD - len(data) if len(data) < PAD else -len(data) % PAD)))
                    back.append(from_wav(media[-1]))
                    t, c = fingerprint(back[-1])
                    times.append(t)
                    codes.append(c)
                    ends.append(ends[-1] + len(t))
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(times)), pa.array(np.concatenate(codes))], names=["time", "code"])
                yield pa.RecordBatch.from_arrays(
                    [part["k"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                    names=["k", "n_bytes", "media", "payload", "fingerprint"],
                )

    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, MEDIA.format(kind=kind)).withColumnRenamed("k", key)
