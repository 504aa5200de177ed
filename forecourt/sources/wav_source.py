"""WAV files: written from tasks, and read with the level of each frame, one row a file."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.sources.toml_source import FOLDERS, few_tasks, file_system

FRAME_MS, RATE = 30, 16_000
SCHEMA = "source_file string, rate int, n_samples bigint, levels array<double>, corrupt string"


def encode(samples: np.ndarray, rate: int, channels: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def decode(raw: bytes, rate: int = RATE) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1, the mean of all channels, and the rate. Bytes without a RIFF header are 16-bit samples at `rate`."""
    if raw[:4] != b"RIFF":
        return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768.0, rate
    with wave.open(io.BytesIO(raw)) as f:
        wide, channels, rate, data = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    data = data[: len(data) // (wide * channels) * wide * channels]
    if wide == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif wide == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{wide}") / float(1 << (8 * wide - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def levels(x: np.ndarray, rate: int, frame_ms: int) -> np.ndarray:
    """Mean square of each frame; the last one may be shorter."""
    size = max(1, rate * frame_ms // 1000)
    starts = np.arange(0, len(x), size)
    return np.add.reduceat(x * x, starts) / np.diff(np.append(starts, len(x))) if len(x) else np.zeros(0)


def read_wavs(spark: SparkSession, folder: str, frame_ms: int = FRAME_MS, rate: int = RATE, pattern: str = "*.wav") -> DataFrame:
    """A row a file below folder: source_file, rate, n_samples (of one channel), levels (one a frame), corrupt (error of a file that can't be read).

    A file is read whole by its task (at most 2 GB); Spark leaves out files without a byte. `rate` is that of files without a header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    x, own = decode(raw, rate)
                    row = {"source_file": path, "rate": own, "n_samples": len(x), "levels": levels(x, own, frame_ms).tolist(), "corrupt": None}
                except (wave.Error, EOFError, ValueError) as e:
                    row = {"source_file": path, "rate": None, "n_samples": None, "levels": None, "corrupt": str(e)[:200] or "truncated"}
                yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("source_file", pa.string()), ("rate", pa.int32()), ("n_samples", pa.int64()), ("levels", pa.list_(pa.float64())), ("corrupt", pa.string())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return few_tasks(files).select("path", "content").mapInArrow(run, SCHEMA)


def write_wavs(rows: DataFrame, folder: str) -> int:
    """Writes a 16-bit file for each row (name, rate, channels, samples array<smallint>, channels by turns). How many files.

    Names don't repeat; files appear whole, by renaming. The folder is one that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(folder)
        for batch in batches:
            for name, rate, channels, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = f"{root}/{sum(name.encode()) % FOLDERS:03d}"
                files.create_dir(own)
                with files.open_output_stream(part := f"{own}/{name}.{uuid.uuid4().hex}") as out:
                    out.write(encode(np.asarray(samples, np.int16), rate, channels))
                files.move(part, f"{own}/{name}.wav")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "rate", "channels", "samples").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
