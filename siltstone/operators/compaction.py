"""Evidence texts selected to fit a budget in bytes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T

FACTUAL = r"\d[\d,.]*\s*(?:%|percent|million|billion|GWh|MWh|亿|万|€|\$|EUR|USD)"


def passage_score(p: Column, account: Column, words: Sequence[str]) -> Column:
    """Length up to 400 characters, the account's first word, relevant words, a fact with a number."""
    low = F.lower(p)
    first = F.lower(F.get(F.split(T.stripped(F.coalesce(account, F.lit(""))), r"\s+"), 0))
    own = F.when((first != "") & F.contains(low, first), 3.0).otherwise(0.0)
    rel = F.size(F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(low, w))).cast("double") if words else F.lit(0.0)
    return F.least(F.length(p), F.lit(400)) / 400.0 + own + rel + F.when(p.rlike(f"(?i){FACTUAL}"), 1.5).otherwise(0.0)


def compacted_text(items: DataFrame, group: str, *, account: str, words: Sequence[str], budget: Column, shared: int = 8) -> DataFrame:
    """Items (group, seq, text) with text fitted to ``budget`` bytes and the number of repeats left out.

    Texts that fit stay. Of others the passages of most score that still fit are taken, unless they
    share ``shared`` of their first words with one taken before, of any item of the group; they stand in
    their old order. Without a passage the beginning is cut at a character. What is taken depends on
    what was taken before, so a group's passages are folded in order inside the JVM.
    """
    i = items.withColumn("_b", budget.cast("long")).withColumn("_fits", T.utf8_size(F.col("text")) <= F.col("_b"))
    parts = T.passages(F.col("text"))
    scored = F.transform(parts, lambda p, n: F.struct((-passage_score(p, F.col(account), words)).alias("o"), n.alias("n"), p.alias("p"), T.utf8_size(p).alias("z"), T.shingle(p).alias("w")))
    todo = i.where("not _fits").select(group, "seq", "_b", F.array_sort(scored).alias("ps"))
    g = todo.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("seq", "_b", "ps"))).alias("rows"))
    state = "struct<seen:array<array<string>>,out:array<struct<seq:bigint,picked:array<struct<n:int,p:string>>,skipped:int>>>"
    inner = "struct<seen:array<array<string>>,used:bigint,picked:array<struct<n:int,p:string>>,skipped:int>"
    fold = f"""aggregate(rows, CAST(named_struct('seen', array(), 'out', array()) AS {state}), (s, r) ->
      transform(array(aggregate(r.ps, CAST(named_struct('seen', s.seen, 'used', 0L, 'picked', array(), 'skipped', 0) AS {inner}), (a, x) -> CAST(CASE
          WHEN size(x.w) > 0 AND exists(a.seen, y -> size(array_intersect(y, x.w)) >= {shared}) THEN named_struct('seen', a.seen, 'used', a.used, 'picked', a.picked, 'skipped', a.skipped + 1)
          WHEN a.used + x.z + 1 > r._b THEN a
          ELSE named_struct('seen', array_append(a.seen, x.w), 'used', a.used + x.z + 1, 'picked', array_append(a.picked, named_struct('n', x.n, 'p', x.p)), 'skipped', a.skipped) END AS {inner}))),
        t -> CAST(named_struct('seen', t.seen, 'out', array_append(s.out, named_struct('seq', r.seq, 'picked', t.picked, 'skipped', t.skipped))) AS {state}))[0])"""
    done = g.select(group, F.explode(F.expr(fold)["out"]).alias("o")).select(group, F.col("o.seq").alias("seq"), F.array_join(F.transform(F.array_sort("o.picked"), lambda x: x["p"]), "\n").alias("_new"), F.size("o.picked").alias("_n"), F.col("o.skipped").alias("repeats"))
    out = i.join(done, [group, "seq"], "left")
    text = F.when(F.col("_fits"), F.col("text")).when(F.coalesce("_n", F.lit(0)) == 0, T.clip_bytes(F.col("text"), F.col("_b"))).otherwise(F.col("_new"))
    return out.withColumn("text", text).withColumn("repeats", F.coalesce("repeats", F.lit(0))).drop("_b", "_fits", "_new", "_n")


def fitted(items: DataFrame, group: str, *, available: int, overhead: int = 64, floor: int = 400, least: int = 6, shrink: float = 0.75) -> DataFrame:
    """Items of each group shrunk, then dropped, until their texts fit ``available`` bytes together.

    The largest gives way first, by a quarter, down to a floor; only then rows go, those of a repeated
    domain first, of the weakest tier, the smallest text of them; ``least`` rows stay. Each step depends
    on the last, so a group (some sixteen items) is one task's loop. Columns: seq, tier, domain, text.
    """
    schema = items.schema

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        rows = t.sort_values("seq", kind="stable").to_dict("records")
        size = lambda r: len((r["text"] or "").encode()) if isinstance(r["text"], str) else 0
        total = lambda: sum(size(r) + overhead for r in rows)
        while total() > available:
            big = max(rows, key=size, default=None)
            if big is None or size(big) <= floor:
                break
            big["text"] = big["text"].encode()[: max(floor, int(size(big) * shrink))].decode("utf-8", "ignore")
        while total() > available and len(rows) > least:
            n: dict = {}
            for r in rows:
                n[r["domain"]] = n.get(r["domain"], 0) + 1
            pool = [r for r in rows if n[r["domain"]] > 1] or rows
            rows.remove(max(pool, key=lambda r: (r["tier"], -size(r))))
        return pd.DataFrame(rows, columns=t.columns)

    return items.groupBy(group).applyInPandas(fit, schema)


def fit_stats(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """(group, items and bytes before and after, domains kept)."""
    b = before.groupBy(group).agg(F.count("*").alias("items_before"), F.sum(T.utf8_size(F.col("text"))).alias("bytes_before"))
    a = after.groupBy(group).agg(F.count("*").alias("items_after"), F.sum(T.utf8_size(F.col("text"))).alias("bytes_after"), F.count_distinct("domain").alias("domains"))
    return b.join(a, group, "left").select(group, "items_before", "bytes_before", F.coalesce("items_after", F.lit(0)).alias("items_after"), F.coalesce("bytes_after", F.lit(0)).alias("bytes_after"), F.coalesce("domains", F.lit(0)).alias("domains"))
