"""Long exact spans shared between documents.

Method, fixed-block anchors: every document's non-overlapping blocks of ``length`` / 2 characters
are indexed (their hashes, in a pair of Bloom filters that partitions fill and the cluster
merges), and every rolling window of that size of every document is probed. A run of ``length``
characters that two documents share holds a whole block of each: the other's block is hit by an
unaligned window here, or by an aligned block that the index has twice. So no shared run is
missed, and what is hit needs only to be extended within ``length`` of the anchor. The extension
is exact and forms no pairs: the runs of ``length`` characters about the anchors are compared by
64-bit hash. Each task first settles what its own documents share; only hashes that are single
there go on, packed, to the reducer of their hash range, so a passage that stands in a third of
all documents comes once from each task and not once from each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import bloom

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19
_FLUSH = 1 << 21


class Powers:
    """Powers of the base and of its inverse modulo 2^64, made once and grown on need."""

    def __init__(self) -> None:
        self.n = 0

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, _CHUNK + (_CHUNK >> 1))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.full(self.n, _BASE, dtype=np.uint64))
                self.down = np.cumprod(np.full(self.n, _INV, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix(chars: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.to(len(chars))
    out = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def windows(pre: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` characters that begin at ``at``."""
    _, down = _POWERS.to(len(pre))
    if isinstance(at, slice):
        return (pre[at.start + size : at.stop + size] - pre[at.start : at.stop]) * down[at.start : at.stop]
    return (pre[at + size] - pre[at]) * down[at]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts with the end appended, characters) of documents, some half a million characters
    at a time; a longer document is one chunk. Characters are code points."""
    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        k, n, size = [], [], 0
        for i, t in enumerate(texts):
            if t:
                k.append(i)
                n.append(len(t))
                size += len(t)
            if k and (size >= _CHUNK or i + 1 == len(texts)):
                chars = np.frombuffer("".join([texts[j] for j in k]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                yield ids[k], np.concatenate([[0], np.cumsum(n)]), chars
                k, n, size = [], [], 0


def _runs(at: np.ndarray, before: int, after: int) -> np.ndarray:
    """The distinct positions within at - before .. at + after, sorted."""
    at = np.unique(at)
    lo, hi = at - before, at + after + 1
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    lo, hi = lo[new], hi[np.append(new[1:] - 1, len(hi) - 1)]
    size = hi - lo
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(lo - (ends - size), size)


def _varied(x: np.ndarray) -> bytes:
    """Integers in order as differences, compressed; their count stands first."""
    d = np.diff(x.astype(np.int64), prepend=0).tobytes()
    return len(d).to_bytes(8, "little") + pa.compress(d, codec="zstd", asbytes=True)


def _read(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(data[8:], decompressed_size=n, codec="zstd"), dtype=np.int64)) if n else np.empty(0, np.int64)


def window_positions(docs: DataFrame, key: str, text: str, *, length: int, bits_per_key: int = 32, k: int = 8, most_filter_bytes: int = 8 << 30) -> DataFrame:
    """(key, at array<int>): where runs of ``length`` characters begin that another row has too;
    several rows for a key. ``most_filter_bytes`` bounds the index file that workers map; beyond it more
    windows are compared, at the same result."""
    spark = docs.sparkSession
    block = length // 2
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.length("t") >= length)
    chars = int(rows.agg(F.sum(F.length("t"))).first()[0] or 0)

    def blocks(b: pa.RecordBatch) -> np.ndarray:
        found = []
        for _, starts, c in chunks(iter([b])):
            at = np.concatenate([np.arange(s, e - block + 1, block) for s, e in zip(starts[:-1], starts[1:])])
            found.append(windows(prefix(c), at, block))
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    path, size, k = bloom.build(rows, blocks, chars // block, bits_per_key=bits_per_key, k=k, most_bytes=most_filter_bytes)
    reducers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // (8 << 20))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = again = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, d, p = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(h)))
            # known here: hashes that two documents of this task have
            several = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at)
            row = np.repeat(several, size)
            yield from told(d[row], p[row])
            # the rest is asked of the reducer of the hash's range; a known one stands only as a witness
            asks = np.flatnonzero(~row)
            asks = asks[np.lexsort((p[asks], d[asks]))]
            knows = at[several]
            to_ask, to_know = _bucket(h[asks], reducers), _bucket(h[knows], reducers)
            out = []
            for r in range(reducers):
                g, w = asks[to_ask == r], knows[to_know == r]
                if len(g) or len(w):
                    out.append((r, h[np.concatenate([g, w])].tobytes(), _varied(d[g]), _varied(p[g])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], names=["r", "h", "d", "p"])

        def told(d: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(d):
                order = np.lexsort((p, d))
                d, p = d[order], p[order]
                cut = np.flatnonzero(np.diff(d)) + 1
                ids = d[np.concatenate([[0], cut])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((-1 - (ids % reducers)).astype(np.int32)), pa.nulls(len(ids), pa.binary()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([_varied(x) for x in np.split(p, cut)], pa.binary())],
                    names=["r", "h", "d", "p"],
                )

        for ids, starts, c in chunks(batches):
            if again is None:
                once, again = bloom.load(path, size)
            if len(c) < length:
                continue
            pre = prefix(c)
            n = len(c) - block + 1
            w = windows(pre, slice(0, n), block)
            doc = np.repeat(np.arange(len(ids)), np.diff(starts))
            offset = np.arange(len(c)) - starts[doc]
            aligned = (offset[:n] % block == 0) & (offset[:n] + block <= np.diff(starts)[doc[:n]])
            hit = np.zeros(n, dtype=bool)
            hit[aligned] = bloom.has(again, w[aligned], k)
            hit[~aligned] = bloom.has(once, w[~aligned], k)
            hit &= doc[:n] == doc[block - 1 : block - 1 + n]
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            at = _runs(at, length - block, 0)
            at = at[(at >= 0) & (at + length <= len(c))]
            at = at[doc[at] == doc[at + length - 1]]
            held.append((windows(pre, at, length), ids[doc[at]].astype(np.int64), offset[at].astype(np.int64)))
            count += len(at)
            if count >= _FLUSH:
                count = 0
                yield from flush()
        if held:
            yield from flush()

    asked = rows.mapInArrow(probe, "r int, h binary, d binary, p binary")

    def settle(t: pa.Table) -> pa.Table:
        if t.column("r")[0].as_py() < 0:
            return pa.table({"k": pa.array([int(np.frombuffer(x.as_py(), dtype=np.int64)[0]) for x in t.column("d")], pa.int64()), "at": pa.array([_read(x.as_py()).astype(np.int32) for x in t.column("p")], pa.list_(pa.int32()))})
        hs = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("h")]
        # a task's batch has a hash of one document alone, or as a witness, so two batches are two documents
        u, n = np.unique(np.concatenate([np.unique(h) for h in hs]), return_counts=True)
        u = u[n > 1]
        d, p = [], []
        for h, docs_, at in zip(hs, t.column("d"), t.column("p")):
            of = _read(docs_.as_py())
            ok = _isin(h[: len(of)], u)
            d.append(of[ok])
            p.append(_read(at.as_py())[ok])
        d, p = np.concatenate(d), np.concatenate(p)
        if not len(d):
            return pa.table({"k": pa.array([], pa.int64()), "at": pa.array([], pa.list_(pa.int32()))})
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        return pa.table({"k": pa.array(d[cut]), "at": pa.ListArray.from_arrays(pa.array(np.append(cut, len(p)), pa.int32()), pa.array(p, pa.int32()))})

    return asked.groupBy("r").applyInArrow(settle, "k long, at array<int>").withColumnRenamed("k", key)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return bloom.mixed(h) % np.uint64(n)


def _isin(x: np.ndarray, rising: np.ndarray) -> np.ndarray:
    if not len(rising):
        return np.zeros(len(x), dtype=bool)
    i = np.minimum(np.searchsorted(rising, x), len(rising) - 1)
    return rising[i] == x


def shared_spans(docs: DataFrame, key: str, text: str, *, length: int = 200, **index) -> DataFrame:
    """(key, span_start, span_end): the unbroken stretches of characters that lie in a run of
    ``length`` characters which also stands, verbatim, in another row.

    Characters are code points from 0, the end is exclusive, nothing is normalised. Repeats within
    one text alone do not count; two rows with the same key count as one text. Null, empty and short
    texts have no spans. Runs are compared by 64-bit hash. An empty table gives an empty result.
    """
    at = window_positions(docs, key, text, length=length, **index)
    # as many positions at most as the text has characters, so a row's list is bounded by its text
    one = at.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("a"))
    starts = F.filter("a", lambda x, i: (i == 0) | (x > F.get(F.col("a"), i - 1) + length))
    ends = F.transform(F.filter("a", lambda x, i: (i == F.size("a") - 1) | (F.get(F.col("a"), i + 1) > x + length)), lambda x: x + length)
    spans = one.select(key, F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("z"))
    return spans.select(key, F.col("z.s").cast("long").alias("span_start"), F.col("z.e").cast("long").alias("span_end"))


def shared_share(docs: DataFrame, key: str, text: str, *, length: int = 200, **index) -> DataFrame:
    """(key, n_spans, shared_chars, share): one row for each text, with the share of its characters
    that is shared elsewhere; 0 for a text without spans, null for a null or empty text."""
    spans = shared_spans(docs, key, text, length=length, **index).groupBy(key).agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    all_ = docs.select(key, F.length(text).cast("long").alias("n"))
    out = all_.join(spans, key, "left").select(key, F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), "n")
    return out.select(key, "n_spans", "shared_chars", (F.col("shared_chars") / F.nullif("n", F.lit(0))).alias("share"))
