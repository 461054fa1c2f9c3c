"""Frame files: a big-endian count of values, then frames of native 32-bit floats; plain, gzip, xz or bz2."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ENDINGS = {".gz": "gzip", ".gzip": "gzip", ".xz": "xz", ".lzma": "xz", ".bz2": "bz2"}
_NAMES = {"none": "none", "raw": "none", "gzip": "gzip", "gz": "gzip", "xz": "xz", "lzma": "xz", "bz2": "bz2", "bzip2": "bz2"}


def compression_of(filename: str, requested: str = "auto") -> str:
    """none, gzip, xz or bz2: as requested, or by the ending."""
    if requested == "auto":
        return next((v for k, v in _ENDINGS.items() if filename.endswith(k)), "none")
    if requested not in _NAMES:
        raise ValueError(f"no compression {requested!r}")
    return _NAMES[requested]


def format_of(filename: Column) -> Column:
    return (
        F.when(filename.endswith(".spire.gz"), "SPIREGZIP").when(filename.endswith(".spire.xz"), "SPIREXZ")
        .when(filename.endswith(".spire.bz2"), "SPIREBZ2").when(filename.endswith(".spire"), "SPIRE").otherwise("NML_STANDARD")
    )


def encode(frames: np.ndarray, compression: str = "none", level: int = 6) -> bytes:
    """A file of ``frames`` (frames, values); levels are clamped to what the codec has."""
    data = struct.pack(">I", frames.shape[1]) + np.ascontiguousarray(frames, dtype=np.float32).tobytes()
    if compression == "gzip":
        return gzip.compress(data, max(0, min(9, level)), mtime=0)
    if compression == "xz":
        return lzma.compress(data, preset=max(0, min(9, level)))
    if compression == "bz2":
        return bz2.compress(data, max(1, min(9, level)))
    return data


def decode(data: bytes, compression: str = "none", permissive: bool = False) -> np.ndarray:
    """The frames of a file; a cut last frame raises, or is dropped if ``permissive``."""
    data = {"none": lambda d: d, "gzip": gzip.decompress, "xz": lzma.decompress, "bz2": bz2.decompress}[compression](data)
    if len(data) < 4:
        raise ValueError("the header is cut")
    n = struct.unpack(">I", data[:4])[0]
    whole, rest = divmod(len(data) - 4, 4 * n) if n else (0, len(data) - 4)
    if rest and not permissive:
        raise ValueError("the last frame is cut")
    return np.frombuffer(data, dtype=np.float32, count=whole * n, offset=4).reshape(whole, n)


def read_frames(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Rows (path, frame, values) of all frame files under ``path``, each file read by one task through Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                frames = decode(content.as_py(), compression_of(name), permissive)
                for at in range(0, len(frames), 1024):
                    part = frames[at : at + 1024]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * frames.shape[1]), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), values], ["path", "frame", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, frame long, values array<float>")


def encode_frames(frames: DataFrame, by: str, frame: str, values: str, compression: str = "none") -> DataFrame:
    """A file's bytes (by, content) of the ordered frames of each ``by``; a file is one stream, so a task makes it."""
    ordered = F.array_sort(F.collect_list(F.struct(frame, values)))
    made = frames.groupBy(by).agg(F.transform(ordered, lambda r: r[values]).alias("frames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode(np.array(f, dtype=np.float32), compression) for f in batch.column("frames").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(files, pa.binary())], [by, "content"])

    return made.mapInArrow(run, f"{by} {dict(frames.dtypes)[by]}, content binary")


def decode_frames(files: DataFrame, by: str, compression: str = "none") -> DataFrame:
    """Rows (by, frame, values) of the files (by, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(by).to_pylist(), batch.column("content")):
                frames = decode(content.as_py(), compression)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(frames), batch.schema.field(by).type), pa.array(np.arange(len(frames))), pa.array(frames.tolist(), pa.list_(pa.float32()))], [by, "frame", "values"])

    return files.mapInArrow(run, f"{by} {dict(files.dtypes)[by]}, frame long, values array<float>")


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Rows (time, id) of text files with two columns; short lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.where(F.size(parts) >= 2).select(F.get(parts, F.lit(0)).try_cast("double").alias("time"), F.get(parts, F.lit(1)).alias("id"))


def write_spikes(spikes: DataFrame, path: str, order: str = "TIME_ID") -> None:
    """Lines of time and id, or id and time, in order of time and id."""
    number = F.format_string("%.9g", F.col("time").cast("double"))
    line = F.concat_ws("\t", number, "id") if order == "TIME_ID" else F.concat_ws("\t", "id", number)
    spikes.orderBy("time", "id").select(line.alias("value")).write.text(path)


