"""Arrays from binary files: WAV (PCM), NPY, Kaldi matrices and vectors; and seeded random arrays.

Files are read by executors in Arrow batches; a file that cannot be parsed fails the query. The
engine's own container for arrays is Parquet (array and binary columns); HDF5 is not read.
"""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wav(data: bytes, normalise: bool = True) -> tuple[int, list[list[float]]]:
    """(rate, channels x samples) of PCM data; normalised to [-1, 1) by the sample width."""
    with wave.open(io.BytesIO(data)) as w:
        width, n, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) - 128
    elif width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x -= (x >> 23) << 24
    else:
        x = np.frombuffer(raw, dtype={2: "<i2", 4: "<i4"}[width]).astype(np.int64)
    y = x.reshape(-1, n).T
    return rate, (y / 2.0 ** (8 * width - 1) if normalise else y.astype(float)).tolist()


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def decode_ark(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(key, array) of a binary archive of float or double vectors and matrices, or whole-number vectors."""
    at = 0
    while at < len(data):
        end = data.index(b" ", at)
        key, at = data[at:end].decode(), end + 1
        if data[at : at + 2] != b"\0B":
            raise ValueError(f"{key}: not a binary archive entry")
        at += 2
        if data[at : at + 1] == b"\4":  # a vector of 32-bit numbers, each with its size
            n = struct.unpack_from("<i", data, at + 1)[0]
            rows = np.frombuffer(data, dtype=[("s", "i1"), ("v", "<i4")], count=n, offset=at + 5)
            yield key, rows["v"].astype(np.int64)
            at += 5 + 5 * n
            continue
        kind, at = data[at : at + 3], at + 3
        sizes = {b"FM ": (2, "<f4"), b"DM ": (2, "<f8"), b"FV ": (1, "<f4"), b"DV ": (1, "<f8")}
        if kind not in sizes:
            raise ValueError(f"{key}: entry type {kind!r} is not read")
        dims, dtype = sizes[kind]
        shape = []
        for _ in range(dims):
            shape.append(struct.unpack_from("<i", data, at + 1)[0])
            at += 5
        n = int(np.prod(shape))
        x = np.frombuffer(data, dtype=dtype, count=n, offset=at)
        yield key, x.reshape(shape)
        at += n * x.itemsize


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of whole numbers, samples (mono) or channels x samples; what does not fit is clipped."""
    x = np.atleast_2d(np.asarray(samples)).T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(x, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def encode_npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values, allow_pickle=False)
    return out.getvalue()


def encode_ark(key: str, values: np.ndarray) -> bytes:
    """An archive entry: a double vector or matrix, or a vector of 32-bit whole numbers."""
    head = key.encode() + b" \0B"
    if values.dtype.kind in "iu":
        rows = np.zeros(len(values), dtype=[("s", "i1"), ("v", "<i4")])
        rows["s"], rows["v"] = 4, values
        return head + b"\4" + struct.pack("<i", len(values)) + rows.tobytes()
    sizes = b"".join(b"\4" + struct.pack("<i", n) for n in values.shape)
    return head + (b"DV " if values.ndim == 1 else b"DM ") + sizes + np.ascontiguousarray(values, dtype="<f8").tobytes()


def read_wav(spark: SparkSession, path: str, normalise: bool = True) -> DataFrame:
    """(path, rate, samples): one row a file, samples by channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *decode_wav(bytes(c), normalise)) for p, c in zip(b["path"], b["content"])], columns=["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rate int, samples array<array<double>>")


def read_sounds(spark: SparkSession, folder: str, normalise: bool = True) -> DataFrame:
    """(key, length, rate, samples) of a container of sounds, samples by channel."""
    rows = spark.read.parquet(folder).select("key", "length", "content")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, n, *decode_wav(bytes(c), normalise)) for k, n, c in zip(b["key"], b["length"], b["content"])], columns=["key", "length", "rate", "samples"])

    return rows.mapInPandas(run, f"key {kind}, length bigint, rate int, samples array<array<double>>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, values): one row a file, values in row-major order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [decode_npy(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "shape": [list(a.shape) for a in arrays], "values": [a.astype(float).ravel().tolist() for a in arrays]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, shape array<bigint>, values array<double>")


def read_ark(spark: SparkSession, path: str, shape_only: bool = False) -> DataFrame:
    """(uttid, shape, values) of archives; with ``shape_only`` without the values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["content"]:
                rows = [(k, list(a.shape), a.astype(float).ravel().tolist()) for k, a in decode_ark(bytes(c))]
                out = pd.DataFrame(rows, columns=["uttid", "shape", "values"])
                yield out.drop(columns="values") if shape_only else out

    schema = "uttid string, shape array<bigint>" + ("" if shape_only else ", values array<double>")
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def seeded_uniform(key: str, length, seed: int):
    """Array of ``length`` numbers in [0, 1) from MD5 of key, seed and blocks of eight positions; the same in every run."""
    from pyspark.sql import Column

    n = length if isinstance(length, Column) else F.lit(length)
    # One digest gives eight numbers of 16 bits.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")), lambda b: F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), b.cast("string"))))
    numbers = F.flatten(F.transform(blocks, lambda h: F.transform(F.array(*[F.lit(4 * i + 1) for i in range(8)]), lambda p: F.conv(F.substring(h, p, F.lit(4)), 16, 10).cast("double") / 65536)))
    return F.when(n > 0, F.slice(numbers, F.lit(1), n.cast("int"))).when(n.isNotNull(), F.array().cast("array<double>"))


def random_ints(key: str, length, low: int, high: int, seed: int):
    """Whole numbers in [low, high)."""
    return F.transform(seeded_uniform(key, length, seed), lambda u: (low + F.floor(u * (high - low))).cast("bigint"))


_RANDOM = re.compile(r"rand_int_(\d+)_(\d+)$")


def read_typed(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """A relation of a named type, by exact name (and the pattern rand_int_<low>_<high>, over a shape relation)."""
    from voxloom.sources import formats

    if kind in formats.SEQUENCES:
        return formats.read_sequences(spark, path, kind)
    if kind == "text":
        return formats.read_two_column(spark, path)
    if kind == "duration":
        return formats.read_two_column(spark, path).select("uttid", formats.parse_label(F.col("value")).alias("value"))
    if kind == "rttm":
        return formats.rttm_labels(formats.parse_rttm(spark.read.text(path)))
    if kind in ("sound", "npy", "ark"):
        return {"sound": read_wav, "npy": read_npy, "ark": read_ark}[kind](spark, path, **options)
    if kind == "score":
        from voxloom.sources.scores import read_score_json

        return read_score_json(spark, path)
    m = _RANDOM.match(kind)
    if m or kind == "rand_float":
        shapes = formats.read_sequences(spark, path, "csv_int")
        n = F.aggregate("value", F.lit(1).cast("bigint"), lambda a, x: a * x)
        made = random_ints("uttid", n, int(m[1]), int(m[2]), options.get("seed", 0)) if m else seeded_uniform("uttid", n, options.get("seed", 0))
        return shapes.select("uttid", F.col("value").alias("shape"), made.alias("value"))
    raise ValueError(f"no reader for type {kind!r}")
