"""What the corpus operators share: tables, the shared folder, Arrow helpers and polynomial hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoints import checkpoint, own_dir  # noqa: F401  for the operators

#: Rows of an Arrow batch. Texts may be long, so batches hold few rows.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def joined_batches(batches, column: int, size: int):
    """Neighbouring batches as one, as long as the column's strings have fewer than `size` bytes."""
    held, have = [], 0
    for b in batches:
        held.append(b)
        have += b.column(column).nbytes
        if have >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, have = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes]:
    """Strings as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# --- polynomial (Rabin-Karp) hashes modulo 2**64 ---------------------------------------------

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


@functools.lru_cache(maxsize=4)
def symbol_values(seed: int = 1) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            np.multiply(have[:step], np.uint64(pow(base, filled, 2**64)), out=have[filled : filled + step])
            filled += step
        _POWERS[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S[i] = sum of values[j] * BASE**j for j < i, so that (S[e]-S[b]) * INVERSE**b is the hash of values[b:e]."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte position: the alike high bytes of sorted numbers stand together, so that Spark's codec packs them."""
    size = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, size).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()
