"""Firms and sources that share a word, without a row for each pair of them.

What a firm's slate holds depends on its words alone, and a source that names one of its distinctive words
is its evidence. So firms of the same words are one set, and tasks that each hold some pages whole work out the
slate of every set from the sources' numbers by word. Only pages on a slate become rows. Firms without a
distinctive word need their whole name, so their sources that hold it become hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.session import written

OUT = "set long, source_id long, url_key string, url string, tier int, hits long"
SLATE, NAMED, PAIRS = 0, 1, 2


def letters(c: Column) -> Column:
    """Words of letters and digits of any script in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _slates(pages: int, low_tier: int, low_attempts: int):
    def work(src: pa.Table, sets: pa.Table) -> pa.Table:
        ids = src.column("source_id").to_numpy()
        keys = src.column("url_key").combine_chunks()
        at = np.lexsort((ids, keys.dictionary_encode().indices.to_numpy(zero_copy_only=False))) if len(ids) else np.empty(0, np.int64)
        # rows by page and within it by source
        src, ids = src.take(pa.array(at)), ids[at]
        code = src.column("url_key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        tiers, urls = src.column("tier").to_numpy(), [b"" if u is None else b"\x01" + u.encode() for u in src.column("url").to_pylist()]
        place = np.empty(len(urls), np.int64)
        place[sorted(range(len(urls)), key=urls.__getitem__)] = np.arange(len(urls))
        rank = (np.unique(tiers, return_inverse=True)[1] if len(ids) else np.empty(0, np.int64)).astype(np.int64)
        # the sources of each word of a set
        listed = sets.column("words").combine_chunks()
        vocabulary = pc.unique(listed.flatten())
        said = src.column("words").combine_chunks()
        number = pc.index_in(said.flatten(), value_set=vocabulary)
        row = pc.list_parent_indices(said).to_numpy(zero_copy_only=False)
        known = number.is_valid().to_numpy(zero_copy_only=False)
        number, row = number.filter(number.is_valid()).to_numpy(zero_copy_only=False), row[known]
        order = np.argsort(number, kind="stable")
        ends = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
        row = row[order]
        of_set = pc.index_in(listed.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False)
        bounds = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        hay = None
        mask = np.zeros(len(ids), bool)
        got_set, got_row, got_hits = [], [], []
        for n, (key, mode, core) in enumerate(zip(*(sets.column(c).to_pylist() for c in ("set", "mode", "core")))):
            parts = [row[ends[w] : ends[w + 1]] for w in of_set[bounds[n] : bounds[n + 1]]]
            parts = [p for p in parts if len(p)]
            if not parts:
                continue
            if len(parts) == 1:
                u = parts[0]
            elif sum(map(len, parts)) * 16 < len(ids):
                u = np.unique(np.concatenate(parts))
            else:
                for p in parts:
                    mask[p] = True
                u = np.flatnonzero(mask)
                mask[u] = False
            if mode != SLATE:
                if mode == NAMED:
                    if hay is None:
                        hay = [h.encode().lower() for h in src.column("hay").to_pylist()]
                    name = core.encode().lower()
                    u = np.array([i for i in u.tolist() if name in hay[i]], dtype=np.int64)
                first, hits = u, np.full(len(u), -1)
            else:
                c = code[u]
                start = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
                hits, first = np.diff(np.append(start, len(u))), u[start]
                if len(first) > pages:
                    # the worst rank and the hits of the last of the best decide who is sorted by address
                    coarse = rank[first] * (len(ids) + 1) + (len(ids) - hits)
                    near = np.flatnonzero(coarse <= np.partition(coarse, pages - 1)[pages - 1])
                    first, hits = first[near], hits[near]
                best = np.lexsort((place[first], -hits, rank[first]))[:pages]
                first, hits = first[best], hits[best]
                low = tiers[first] >= low_tier
                keep = ~low | (np.cumsum(low) <= low_attempts)
                first, hits = first[keep], hits[keep]
            got_set.append(np.full(len(first), key))
            got_row.append(first)
            got_hits.append(hits)
        cat = lambda x: np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)
        at, hits = pa.array(cat(got_row)), cat(got_hits)
        cols = [src.column(c).take(at).combine_chunks() for c in ("source_id", "url_key", "url", "tier")]
        return pa.table([pa.array(cat(got_set)), *cols, pa.array(hits, mask=hits < 0)], names=["set", "source_id", "url_key", "url", "tier", "hits"])

    return work


def met(sources: DataFrame, firms: DataFrame, tier: Column, *, pages: int = 20, low_tier: int = 6, low_attempts: int = 12, shard: int = 100_000, chunk: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, counted, sets) of the firms (account_id, name) with the sources (source_id, url, title, site_name) whose titles share a word with them.

    counted (set, seq, url_key, url, tier, hits) are the pages that may be on the slate of a set (set, accounts), each with
    its first source and the number of its sources, for firms of which every shared word is an identity. hits
    (account_id, seq) are the sources of all others, as far as they may hold the name."""
    own = T.distinctive_tokens(F.col("name"), ())
    words = F.array_sort(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(letters(F.col("name")))))
    mode = F.when(F.size(own) > 0, F.lit(SLATE)).otherwise(F.lit(NAMED))
    named = firms.select("account_id", words.alias("words"), mode.alias("mode"), F.when(F.size(own) > 0, F.lit("")).otherwise(T.core_name(F.col("name"))).alias("core")).where("size(words) > 0")
    kinds = written(named.groupBy("words", "mode", "core").agg(F.collect_list("account_id").alias("accounts")).withColumn("set", F.monotonically_increasing_id()), "sets")
    title, hay = F.coalesce("title", F.lit("")), F.concat_ws(" ", "title", "site_name", "url")
    said = sources.where("source_id is not null").select("source_id", "url", T.url_key(F.col("url")).alias("url_key"), tier.cast("int").alias("tier"), hay.alias("hay"), F.array_distinct(F.concat(T.name_tokens(title), letters(title))).alias("words"))
    said = written(said, "said")
    # a word of the title that is no mention of its own (letters whose lower case is another script's) leaves its firms to the judge
    each = kinds.where(F.col("mode") == SLATE).select("set", F.explode("words").alias("w"))
    # words of Latin letters and digits are mentions wherever they are words
    lone = said.where("exists(words, w -> w rlike '[^a-z0-9]') or hay rlike '[\\u0130\\u212a]'").select("hay", F.explode("words").alias("w")).join(each.select("w").distinct(), "w")
    odd = each.join(lone.where(~T.mentions(F.col("hay"), F.col("w"))).select("w").distinct(), "w", "left_semi").select("set").distinct().withColumn("odd", F.lit(True))
    modes = kinds.select("set", "words", "mode", "core").join(odd, "set", "left").select("set", "words", F.when(F.coalesce("odd", F.lit(False)), PAIRS).otherwise(F.col("mode")).alias("mode"), "core")
    shards = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-said.count() // shard))
    chunks = max(1, -(-kinds.count() // chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = said.withColumn("s", F.pmod(F.xxhash64("url_key"), F.lit(shards)).cast("int")).withColumn("k", every(chunks))
    right = modes.withColumn("k", F.pmod(F.xxhash64("set"), F.lit(chunks)).cast("int")).withColumn("s", every(shards))
    found = written(left.groupBy("s", "k").cogroup(right.groupBy("s", "k")).applyInArrow(_slates(pages, low_tier, low_attempts), OUT), "slates")
    of = kinds.select("set", "accounts")
    hits = found.where("hits is null").join(of, "set").select(F.explode("accounts").alias("account_id"), F.col("source_id").alias("seq"))
    return hits, found.where("hits is not null").withColumnRenamed("source_id", "seq"), of
