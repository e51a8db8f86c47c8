"""PCM WAV files as a table of short frames: media_id, k (frame number), t0, t1, rms, db."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FRAMES = "media_id string, k bigint, t0 double, t1 double, rms double, db double"
INFO = "media_id string, seconds double, rate int, channels int, bits int, error string"
#: Frames per Arrow batch that a task emits at once.
BATCH = 50_000


def pcm(content: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] as the mean of the channels, and the sample rate."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    else:
        raise ValueError(f"sample width {width}")
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1), rate


def frame_rms(x: np.ndarray, size: int) -> np.ndarray:
    """Root mean square of consecutive frames; the last one may be shorter."""
    if not len(x):
        return np.zeros(0)
    starts = np.arange(0, len(x), size)
    return np.sqrt(np.add.reduceat(x.astype(float) ** 2, starts) / np.diff(np.append(starts, len(x))))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")


def read_frames(spark: SparkSession, path: str, seconds: float = 0.01) -> DataFrame:
    """Frames of ``seconds`` of every readable file; a file is one row and so decodes in one task. See read_info for the others."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    x, rate = pcm(content)
                except (wave.Error, EOFError, ValueError):
                    continue
                size = max(1, round(rate * seconds))
                rms = frame_rms(x, size)
                for at in range(0, len(rms), BATCH):
                    part, k = rms[at : at + BATCH], np.arange(at, min(at + BATCH, len(rms)))
                    yield pd.DataFrame({"media_id": name, "k": k, "t0": k * size / rate, "t1": np.minimum((k + 1) * size, len(x)) / rate, "rms": part, "db": 20 * np.log10(np.maximum(part, 1e-10))})

    return _files(spark, path).mapInPandas(decode, FRAMES)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """Length and format of every file, or why it cannot be read."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append([name, w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), None])
                except (wave.Error, EOFError, ZeroDivisionError) as e:
                    rows.append([name, None, None, None, None, str(e) or type(e).__name__])
            yield pd.DataFrame(rows, columns=["media_id", "seconds", "rate", "channels", "bits", "error"]).astype({c: "Int32" for c in ("rate", "channels", "bits")})

    return _files(spark, path).mapInPandas(look, INFO)


def to_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono file of samples in [-1, 1]; what lies outside is clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()
