"""Small helpers of the llm operators; stash() and unstash() are the package's own."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.session import stash, unstash

__all__ = ["fresh", "pieces", "powers", "same", "stash", "table", "unstash", "utf8"]


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: str, b: str, *names: str) -> Column:
    """Null-safe equality of the named columns of two aliased frames."""
    return functools.reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def utf8(column: pa.Array) -> list:
    """A string column as a list of UTF-8 bytes or None."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, name: str, most: int = 8 << 20):
    """Slices of a batch whose column `name` holds about `most` bytes, at least one row each."""
    size, start, total = batch.column(name), 0, 0
    for i, n in enumerate(pa.compute.binary_length(size).to_pylist()):
        total += n or 0
        if total >= most:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on


ODD = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64, for rolling hashes."""
    up, down = np.full(n, np.uint64(ODD)), np.full(n, np.uint64(pow(ODD, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)
