"""Words of whole Arrow columns at once, as 64-bit hashes, and the packed exchange that counts them.

A *bin* holds the documents with one remainder of a hash of id and text, about BIN_BYTES of text:
neither a third of rows without an id nor a third with equal texts meets in one bin.
A *shard* holds all hashes with the same top bits.  A bin's distinct hashes, sorted, are
cut into one slice for each shard and sent as one packed value; the shard's answer has the
same order, so the bin reads it without keys.  A hash that a third of all rows hold comes
once from each bin, not once from each row.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.random.RandomState(7).randint(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Powers:
    """1, b, b**2, ... modulo 2**64, and their inverses, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.r_[U64(1), np.full(n - 1, b, U64)], dtype=U64) for b in (self.base, self.inverse))
        return self.up, self.down


BYTE_POWERS, GRAM_POWERS, GRAM_POWERS_2 = Powers(BASE), Powers(0xBF58476D1CE4E5B9), Powers(0x94D049BB133111EB)


@dataclass
class Words:
    """Words of a column: count by row, and each word's hash in order."""

    counts: np.ndarray
    hashes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)

    def place(self) -> np.ndarray:
        """Each word's place in its row, from 0."""
        return np.arange(len(self.hashes)) - np.repeat(self.ends - self.counts, self.counts)

    def left(self) -> np.ndarray:
        """How many words its row has from each word on."""
        return np.repeat(self.ends, self.counts) - np.arange(len(self.hashes))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its rows' offsets in them; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    a = a.cast(pa.large_string()).fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of each row begin and end among its bytes, and how many it has; ``gap`` says which bytes stand between words."""
    ink = ~gap[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, ink[:-1]], np.r_[ink[1:], False]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """The hash of each word from the values of its bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        a, b = starts[i], ends[j - 1]
        up, down = BYTE_POWERS.to(b - a + 1)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(value[raw[a:b]] * up[: b - a], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return mixed(out)


def words(column: pa.ChunkedArray, lower: bool = False) -> Words:
    """The words of each row: runs of anything but ASCII white space."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        return Words(np.zeros(len(offsets) - 1, np.int64), np.zeros(0, U64))
    starts, ends, counts = runs_of(raw, offsets)
    return Words(counts, hashed(raw, starts, ends, BYTE_VALUE[LOWER] if lower else BYTE_VALUE))


def grams(hashes: np.ndarray, n: int, powers: Powers = GRAM_POWERS) -> np.ndarray:
    """The hash of the n words from each word on; the last n - 1 have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    up, down = powers.to(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mixed((total[n:] - total[:m]) * down[:m])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; the bytes of one significance stand together, which compresses well."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<B", len(arrays)) + b"".join(head + body))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = data[0], 1, []
    heads = [struct.unpack_from("<cBQ", data, 1 + 10 * k) for k in range(n)]
    at += 10 * n
    for kind, width, size in heads:
        planes = np.frombuffer(data, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"{kind.decode()}{width}")).reshape(size))
        at += width * size
    return out


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of a string column, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    size, at = np.r_[0, np.cumsum(sizes)], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=U64(0))


def slices(ascending: np.ndarray, shard_bits: int, bits: int = 64) -> np.ndarray:
    """Where each shard's part of sorted hashes of so many bits begins, and the end."""
    edges = np.arange(1 << shard_bits, dtype=U64) << U64(bits - shard_bits)
    return np.r_[np.searchsorted(ascending, edges), len(ascending)]


@dataclass(frozen=True)
class Layout:
    """How many bins and shards; both follow the data, and the session's partitions at least."""

    bins: int
    shard_bits: int
    bytes: int

    @property
    def shards(self) -> int:
        return 1 << self.shard_bits


def layout(docs: DataFrame, text_col: str = "text", bin_bytes: int = BIN_BYTES) -> Layout:
    """From the bytes of text, in one pass over that column."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = max(parts, math.ceil(total / bin_bytes))
    return Layout(bins, max(1, math.ceil(math.log2(bins))), total)


def bin_of(bins: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bins)).cast("int")
