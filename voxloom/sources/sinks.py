"""Writing relations: data directories, arrays, JSON records, tables of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.sources.binary import encode_ark, encode_wav
from voxloom.sources.formats import two_column_line


def key_gaps(relations: dict[str, DataFrame], key: str) -> DataFrame:
    """(relation, key): keys that another relation holds and this one lacks; and keys that occur twice, as ``<name>*2``."""
    every = None
    for df in relations.values():
        k = df.select(key).distinct()
        every = k if every is None else every.union(k).distinct()
    out = None
    for name, df in relations.items():
        lacks = every.join(df.select(key), key, "left_anti").select(F.lit(name).alias("relation"), key)
        twice = df.groupBy(key).count().filter("count > 1").select(F.lit(f"{name}*2").alias("relation"), key)
        out = lacks.union(twice) if out is None else out.union(lacks).union(twice)
    return out


def write_datadir(relations: dict[str, DataFrame], folder: str, key: str = "uttid", value: str = "value", check: bool = True) -> None:
    """One folder of text files per relation, lines ``key value`` in key order. With ``check`` uneven key sets fail first."""
    if check and (odd := key_gaps(relations, key).take(1)):
        raise ValueError(f"relation {odd[0][0]} and key {odd[0][1]!r} do not fit the others")
    for name, df in relations.items():
        df.sort(key).select(two_column_line(key, value).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def write_arrays(df: DataFrame, folder: str, feats: str, compression: str = "zstd") -> None:
    """Parquet with the array column and its length as a column of its own, so lengths are read without the arrays."""
    df.withColumn(f"{feats}_length", F.size(feats)).write.mode("overwrite").option("compression", compression).parquet(folder)


def copy_feats(df: DataFrame, folder: str, feats: str, transforms: list | None = None) -> None:
    """Read, transformed by functions DataFrame to DataFrame one after another, and written."""
    for t in transforms or []:
        df = df.transform(t)
    write_arrays(df, folder, feats)


def write_json_records(df: DataFrame, folder: str, key: str, record: str) -> None:
    """Lines {"key": ..., "record": ...} sorted by key within sorted files."""
    df.sort(key).select(F.to_json(F.struct(key, record)).alias("value")).write.mode("overwrite").text(folder)


def markdown_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most_rows`` rows are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows; write them instead")
    lines = ["|" + "|".join(df.columns) + "|", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("|" + "|".join("" if v is None else str(v) for v in r) + "|" for r in rows)]) + "\n"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given as a path or address, and its path there."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)


def _put(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Written beside its place and moved there, so that a task run twice leaves whole files."""
    part = f"{path}.part{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def write_files(df: DataFrame, folder: str, name: str, values: str, encode: Callable[[np.ndarray], bytes]) -> int:
    """One file a row, by executors, named by the column ``name``; the number of files written.

    The folder must be one that all executors share. Null names and values are left out; of
    equal names one file stays.
    """
    files, root = file_system(folder)
    files.create_dir(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put, root = file_system(folder)
        for b in batches:
            for n, v in zip(b["name"], b["values"]):
                _put(put, f"{root}/{n}", encode(np.array(list(v))))
            yield pd.DataFrame({"n": [len(b)]})

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(values).alias("values")).filter("name is not null and values is not null")
    return rows.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_ark(df: DataFrame, folder: str, key: str, values: str) -> int:
    """One archive of vectors a partition, ``part-<number>.ark``; the number of entries written."""
    files, root = file_system(folder)
    files.create_dir(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        put, root = file_system(folder)
        path, n = f"{root}/part-{TaskContext.get().partitionId():05}.ark", 0
        part = f"{path}.part{TaskContext.get().taskAttemptId()}"
        with put.open_output_stream(part) as out:
            for b in batches:
                for k, v in zip(b["key"], b["values"]):
                    out.write(encode_ark(k, np.array(list(v))))
                n += len(b)
        put.move(part, path)
        yield pd.DataFrame({"n": [n]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(values).alias("values")).filter("key is not null and values is not null")
    return rows.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_sounds(df: DataFrame, folder: str, key: str, samples: str, rate: int) -> None:
    """A container of sounds: Parquet with the key, the number of samples and the PCM file of each row.

    Many sounds lie in one file of bounded row groups, and keys and lengths are read without
    the bytes. Null keys and samples are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = [np.array(list(v)) for v in b["__v"]]
            yield pd.DataFrame({"key": b["__k"], "length": [x.shape[-1] for x in values], "content": [encode_wav(x, rate) for x in values]})

    rows = df.select(F.col(key).alias("__k"), F.col(samples).alias("__v")).filter("__k is not null and __v is not null")
    rows.mapInPandas(run, f"key {kind}, length bigint, content binary").write.mode("overwrite").parquet(folder)
