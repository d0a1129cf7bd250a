"""Tables, intermediate tables and Arrow texts that the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import ship_package

PIECE_BYTES = 2 << 20  # text that one numpy step takes at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), "voxelloom-shared")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage that survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_class(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 4``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its ``n + 1`` offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most ``limit`` bytes of ``column``; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = texts_of(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class SpanHasher:
    """64-bit hashes of any spans of a byte buffer from one running sum: ``sum(v[byte] * R**position)``.

    ``R`` is odd, so its powers have inverses modulo 2**64 and a span's hash does not depend on its place.
    """

    RADIX = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.values = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            def run(base: int) -> np.ndarray:
                out = np.full(n, base, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            self.power, self.inverse = run(self.RADIX), run(pow(self.RADIX, -1, 2**64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def runs(inside: np.ndarray, ends: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text number of the maximal runs of true bytes; no run crosses a text's end, or goes on where
    ``cut`` is true."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if cut is not None:
        first |= inside & cut
    heads = ends[:-1][(ends[:-1] < ends[1:])]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(ends, start, "right") - 1
