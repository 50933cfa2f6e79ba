"""Records that are the same but for how they are written.

Method: every record gets a canonical form and its 128-bit hash (two 64-bit hashes with different
seeds). Bloom filters of hashes seen once and seen again are built per partition and merged; only
records whose hash may be in the second are shuffled for exact grouping on all 128 bits. The
others are emitted as records that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import bloom
from siltstone.session import written

_PUNCT = r"[^\p{L}\p{M}\p{N}]+"
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def folded(c: Column) -> Column:
    return F.lower(F.upper(c))


def words(c: Column) -> Column:
    """Words and numbers in order, parted by one blank; scripts without blanks have none inside."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _PUNCT, " "), rf"(?<={_CJK}) | (?={_CJK})", ""))


def canonical_url(url: Column) -> Column:
    """Words of the address, then its query parameters in sorted order, then the fragment."""
    u = F.split(folded(F.coalesce(url, F.lit(""))), "#", 2)
    parts = F.split(u.getItem(0), r"\?", 2)
    params = F.array_sort(F.filter(F.transform(F.split(F.coalesce(F.get(parts, 1), F.lit("")), "[&;?]"), words), lambda x: x != ""))
    return F.concat_ws("\u0001", words(parts.getItem(0)), F.array_join(params, "\u0002"), words(F.coalesce(F.get(u, 1), F.lit(""))))


def canonical_title(title: Column) -> Column:
    """Words of each segment, the segments sorted; null, empty and blank titles are alike."""
    cut = F.split(folded(F.coalesce(title, F.lit(""))), r"(?U)[|¦•»]|::|(?<=\s)[-–—_/·]+(?=\s)")
    return F.array_join(F.array_sort(F.filter(F.transform(cut, words), lambda x: x != "")), "\u0002")


def hashed(df: DataFrame, key: str, canonical: Column) -> DataFrame:
    return df.select(F.col(key).alias("id"), canonical.alias("c")).select("id", F.xxhash64("c").alias("h"), F.xxhash64(F.lit(1), "c").alias("g"))


def _hashes(b: pa.RecordBatch) -> np.ndarray:
    return b.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def grouped(
    df: DataFrame, key: str, canonical: Column, *, bits_per_key: int = 16, k: int = 4, most_filter_bytes: int = 4 << 30, hot_groups: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(members, singles): ``members`` (first_id, id, n_copies) of records that occur under two ids
    or more, the first itself included; ``singles`` (id) of the records that occur once.

    A row delivered twice under one id counts once. A null id is left out. Records with the same
    canonical form are copies whatever their number: groups of more than rows / ``hot_groups``
    members, of which there can be no more than ``hot_groups``, meet their members by broadcast
    (24 bytes each, 2.4 MB at most by default), the others by a shuffle, so that no task gets a hot
    group. The filter is bounded by ``most_filter_bytes``; beyond it more rows are shuffled. An
    empty table gives empty results.
    """
    spark = df.sparkSession
    hs = written(hashed(df.where(F.col(key).isNotNull()), key, canonical), "hashes")
    n = hs.count()
    path, size, k = bloom.build(hs.select("h"), _hashes, n, bits_per_key=bits_per_key, k=k, most_bytes=most_filter_bytes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = None
        for b in batches:
            if again is None:
                again = bloom.load(path, size)[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bloom.has(again, _hashes(b), k))], names=["id", "h", "g", "maybe"])

    probed = hs.mapInArrow(probe, hs.select("id", "h", "g").schema.simpleString()[7:-1].replace(":", " ") + ", maybe boolean")
    probed = written(probed, "probed")
    maybe = probed.where("maybe").groupBy("h", "g", "id").agg(F.lit(1).alias("one")).drop("one")
    maybe = written(maybe, "maybe")
    groups = written(maybe.groupBy("h", "g").agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies")), "groups")
    many = groups.where("n_copies > 1")
    hot = max(1000, -(-n // hot_groups))
    joined = maybe.join(F.broadcast(many.where(F.col("n_copies") > hot)), ["h", "g"]).unionByName(
        maybe.join(many.where(F.col("n_copies") <= hot).hint("shuffle_merge"), ["h", "g"])
    )
    members = joined.select("first_id", "id", "n_copies")
    singles = groups.where("n_copies = 1").select(F.col("first_id").alias("id")).unionByName(probed.where("not maybe").select("id"))
    return members, singles


def source_copies(sources: DataFrame) -> DataFrame:
    """(first_id, copy_id) of sources whose url and title agree once formatting is disregarded."""
    members, _ = grouped(sources, "source_id", F.concat_ws("\u0003", canonical_url(F.col("url")), canonical_title(F.col("title"))))
    return members.where("id != first_id").select("first_id", F.col("id").alias("copy_id"))


def source_records(sources: DataFrame) -> DataFrame:
    """(source_id, n_copies): one row for each record, those that occur once included."""
    members, singles = grouped(sources, "source_id", F.concat_ws("\u0003", canonical_url(F.col("url")), canonical_title(F.col("title"))))
    return members.where("id = first_id").select(F.col("id").alias("source_id"), "n_copies").unionByName(singles.select(F.col("id").alias("source_id"), F.lit(1).cast("long").alias("n_copies")))
