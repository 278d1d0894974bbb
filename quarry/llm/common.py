"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.sources.files import read_table
from quarry.sources.staged import stored  # noqa: F401  the operators take it from here

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur's), on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_rng = np.random.Generator(np.random.PCG64(977))
_BYTES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_PART = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 14) - 1, base, np.uint64)], dtype=np.uint64)
    return _powers[name][:n]


def _hash_part(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    inside = np.r_[False, ~_SPACE[raw], False]
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = bounds[::2], bounds[1::2]
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * _power("up", _BASE, len(raw)), dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", pow(_BASE, -1, 1 << 64), len(raw) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, in order.

    A word's hash is a polynomial of its bytes, taken from prefix sums of the text: no loop over words. Long texts go in
    parts that end between words, so memory stays bounded.
    """
    if len(text) <= _PART:
        return _hash_part(text)
    parts, at, space = [], 0, re.compile(rb"[\x20\x09-\x0D]")
    while at < len(text):
        found = space.search(text, at + _PART)
        end = found.start() if found else len(text)
        parts.append(_hash_part(text[at:end]))
        at = end
    return np.concatenate(parts)


BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


class Prefix:
    """Hashes of any run of words: sums of word hash times power of BASE, shifted to the run's start."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.cumprod(np.r_[np.uint64(1), np.full(len(h), BASE, np.uint64)], dtype=np.uint64)
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(h), BASE_INV, np.uint64)], dtype=np.uint64)
            self.sums = np.r_[np.uint64(0), np.cumsum(h * power[:-1], dtype=np.uint64)]

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def texts(column) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; nulls as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`: bytes.split() divides at just these six characters."""
    return text.split()
