"""A pair of Bloom filters of the 64-bit hashes seen at least once and of those seen again.

Each input partition fills its own pair, the pairs are merged segment by segment over the
cluster, and each merged segment becomes its piece of a file in the shared folder, which workers
map into memory. Nothing passes the driver.
A bit of the merged `again` filter is set if some partition's own `again` filter has it or if two
partitions' `once` filters have it; so every hash that occurs twice is in it, wherever its
occurrences lie. The filters only ever let too much through, never too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import files
from siltstone.session import scratch

SEGMENT_BYTES = 1 << 18

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the whole word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _S
    h *= _C1
    h ^= h >> _S
    h *= _C2
    h ^= h >> _S
    return h


def filter_bytes(keys: int, bits_per_key: int, most: int) -> int:
    """A power of two of bytes, at least a segment, at most ``most``."""
    need = max(SEGMENT_BYTES, keys * bits_per_key // 8)
    return min(1 << (need - 1).bit_length(), most)


class Pair:
    """The filters of one partition, or of a part of it: its hashes until they are cut into segments.

    What is held grows with the partition and not with the filter.
    """

    MOST = 1 << 21

    def __init__(self, size: int, k: int):
        self.size, self.k, self.held, self.n = size, k, [], 0

    def add(self, hashes: np.ndarray) -> bool:
        """Takes hashes; True if it is time to give the segments."""
        self.held.append(hashes)
        self.n += len(hashes)
        return self.n >= self.MOST

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        if not self.n:
            return
        u, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        once, again = self._cut(u), self._cut(u[n > 1])
        for s, bits in once.items():
            yield s, packed(bits), packed(again.get(s, np.empty(0, np.uint32)))

    def _cut(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """Segment number to the places of its set bits, rising."""
        if not len(hashes):
            return {}
        h = mixed(hashes)
        at = np.unique(np.concatenate([_place(h, i, self.size) for i in range(self.k)]))
        seg = (at // np.uint64(SEGMENT_BYTES * 8)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(seg)) + 1
        inside = (at % np.uint64(SEGMENT_BYTES * 8)).astype(np.uint32)
        return dict(zip(seg[np.concatenate([[0], cuts])].tolist(), np.split(inside, cuts)))


def packed(places: np.ndarray) -> bytes:
    """Places of set bits: as differences, or as the bitmap where they are many."""
    if len(places) > SEGMENT_BYTES // 4:
        return b"\x00" + pa.compress(bitmap(places).tobytes(), codec="zstd", asbytes=True)
    return b"\x01" + len(places).to_bytes(4, "little") + pa.compress(np.diff(places, prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """The bitmap of a segment."""
    if data[:1] == b"\x00":
        return np.frombuffer(pa.decompress(data[1:], decompressed_size=SEGMENT_BYTES, codec="zstd"), dtype=np.uint8)
    n = int.from_bytes(data[1:5], "little")
    return bitmap(np.cumsum(np.frombuffer(pa.decompress(data[5:], decompressed_size=4 * n, codec="zstd"), dtype=np.uint32), dtype=np.uint32) if n else np.empty(0, np.uint32))


def bitmap(places: np.ndarray) -> np.ndarray:
    bits = np.zeros(SEGMENT_BYTES * 8, dtype=bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little")


def _place(h: np.ndarray, i: int, size: int) -> np.ndarray:
    # double hashing: two halves of the mixed word give all k places
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (size * 8 - 1).bit_length())


def has(bits: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Whether each hash may be in the filter; only survivors of a place go on to the next."""
    out = np.zeros(len(hashes), dtype=bool)
    if not len(hashes):
        return out
    h = mixed(hashes)
    left = None
    for i in range(k):
        p = _place(h, i, len(bits))
        ok = (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
        left = np.flatnonzero(ok) if left is None else left[ok]
        if not len(left):
            return out
        h = h[ok]
    out[left] = True
    return out


def _merge(t: pa.Table, path: str, size: int, whole: bool) -> pa.Table:
    seg = t.column("seg")[0].as_py()
    once = np.zeros(SEGMENT_BYTES, dtype=np.uint8)
    again = np.zeros(SEGMENT_BYTES, dtype=np.uint8)
    for a, b in zip(t.column("once"), t.column("again")):
        x = unpacked(a.as_py())
        again |= once & x
        again |= unpacked(b.as_py())
        once |= x
    if whole:
        files.put_at(f"{path}/filters", seg * SEGMENT_BYTES, once.tobytes())
        files.put_at(f"{path}/filters", size + seg * SEGMENT_BYTES, again.tobytes())
    else:
        files.put(f"{path}/{seg}", once.tobytes() + again.tobytes())
    return pa.table({"seg": pa.array([seg], pa.int32())})


def build(df: DataFrame, hashes_of, keys: int, *, bits_per_key: int, k: int, most_bytes: int) -> tuple[str, int, int]:
    """Builds the pair over all rows of ``df``; ``hashes_of(RecordBatch)`` gives a batch's hashes.

    Returns what :func:`load` needs. ``most_bytes`` bounds the file that workers map; a filter at
    its bound lets more through, which costs later work and never a result.
    """
    size = filter_bytes(keys, bits_per_key, most_bytes)
    path = scratch(df.sparkSession, "bloom")
    whole = files.blank(f"{path}/filters", 2 * size)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(size, k)

        def out() -> Iterator[pa.RecordBatch]:
            for s, a, c in pair.segments():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([a], pa.binary()), pa.array([c], pa.binary())], names=["seg", "once", "again"])

        for b in batches:
            h = hashes_of(b)
            if len(h) and pair.add(h):
                yield from out()
        yield from out()

    def merge(t: pa.Table) -> pa.Table:
        return _merge(t, path, size, whole)

    parts = df.mapInArrow(fill, "seg int, once binary, again binary")
    parts.groupBy("seg").applyInArrow(merge, "seg int").agg(F.count("*")).collect()
    return path, size, k


_LOADED: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def load(path: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged (once, again) filters, once per worker process: mapped into memory from the shared
    folder where it is a mounted one, so that the workers of a machine share the pages they touch."""
    if path not in _LOADED:
        _LOADED.clear()
        here = files.mapped(f"{path}/filters")
        if here:
            both = np.memmap(here, dtype=np.uint8, mode="r", shape=(2 * size,))
            _LOADED[path] = both[:size], both[size:]
            return _LOADED[path]
        once, again = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
        for i in range(size // SEGMENT_BYTES):
            if files.exists(f"{path}/{i}"):
                x = np.frombuffer(files.get(f"{path}/{i}"), dtype=np.uint8)
                once[i * SEGMENT_BYTES : (i + 1) * SEGMENT_BYTES] = x[:SEGMENT_BYTES]
                again[i * SEGMENT_BYTES : (i + 1) * SEGMENT_BYTES] = x[SEGMENT_BYTES:]
        _LOADED[path] = once, again
    return _LOADED[path]
