"""Vectorised word hashes over many texts at once, and a bitmap of fixed size that tells which hashes may matter."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
MAP_BITS = 24


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64, and of its inverse, for places up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value scattered over all bits."""
    out = values ^ (values >> np.uint64(30))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out = out * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


class Tokens:
    """The words of many texts: byte ranges in `data`, a hash each, and the text each belongs to.

    `kinds` maps a byte to what stands for it inside a word, or to 0 between words.
    """

    def __init__(self, texts: pa.Array, kinds: np.ndarray):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.raw = b"\n".join(texts.to_pylist())
        self.data = kinds[np.frombuffer(self.raw, np.uint8)]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = self.data != 0
        edges = np.diff(inside)
        self.starts = np.flatnonzero(edges == 1)
        self.ends = np.flatnonzero(edges == -1)
        text_starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.text = np.searchsorted(text_starts, self.starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(sizes)).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        power, inverse = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.data.astype(np.uint64) * power[: len(self.data)], dtype=np.uint64, out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def shingles(self, size: int) -> np.ndarray:
        """Hashes of `size` words in a row from each word on; 0 where the text has not so many left."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n < size:
            return out
        total = np.full(n - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            total = total * _BASE + self.hashes[k : n - size + 1 + k]
        total = mix(total) | np.uint64(1)
        out[: n - size + 1] = np.where(self.text[: n - size + 1] == self.text[size - 1 :], total, np.uint64(0))
        return out

    def words(self, start: int, end: int) -> bytes:
        """Words `start` to `end` (of all) as they are compared, a blank between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[start:end], self.ends[start:end], strict=True))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Slices of a batch of about `most` bytes of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def bitmap(hashes: DataFrame, column: str, bits: int = MAP_BITS) -> np.ndarray:
    """A map of 2^bits bits, set at the upper bits of each hash: of one size whatever the number of hashes.

    A clear bit proves that a hash is absent; a set one proves nothing. The map comes together on the executors; at
    most 2^(bits - 6) rows of one word each reach the driver.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    rows = hashes.where(F.col(column).isNotNull()).groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    got = rows.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def in_map(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes may be in a bitmap."""
    place = hashes >> np.uint64(64 - int(len(found) * 64).bit_length() + 1)
    return (found[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
