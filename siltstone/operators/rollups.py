"""Aggregates over runs, batches, reports and calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_snapshot(items: DataFrame, batch: str, *, done: Sequence[str] = ("Completed",), failed: Sequence[str] = ("Failed", "Timed Out")) -> DataFrame:
    """Counts by state, tokens and seconds of the done ones (zeros count as missing), and the time left."""
    is_done, is_failed = F.col("item_status").isin(*done), F.col("item_status").isin(*failed)
    tokens, secs = F.when(is_done, F.nullif("tokens", F.lit(0))), F.when(is_done, F.nullif("latency", F.lit(0.0)))
    g = items.groupBy(batch).agg(
        F.count("*").alias("total"), F.count_if(is_done).alias("completed"), F.count_if(is_failed).alias("failed"),
        F.sum(tokens).alias("total_tokens"), F.floor(F.avg(tokens)).alias("avg_tokens"), F.round(F.avg(secs), 1).alias("avg_seconds"),
    )
    g = g.withColumn("remaining", F.col("total") - F.col("completed") - F.col("failed"))
    return g.withColumn("eta_seconds", F.floor(F.col("avg_seconds") * F.col("remaining")))


def portfolio_totals(records: DataFrame, *, at: str, model: str, sums: Sequence[str]) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.array_join(F.array_sort(F.collect_set(model)), ",").alias("models"), *[F.sum(F.coalesce(s, F.lit(0))).alias(f"sum_{s}") for s in sums])


def usage_rollup(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tokens by group; a call's missing total is the sum of its parts."""
    total = F.coalesce("total_tokens", F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(total).alias("total_tokens"))


def latest(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def covered(want: DataFrame, have: DataFrame, key: str, item: str) -> DataFrame:
    """Keys all of whose wanted items are there (relational division)."""
    missing = want.select(key, item).distinct().join(have.select(key, item).distinct(), [key, item], "left_anti").select(key).distinct()
    return want.select(key).distinct().join(missing, key, "left_anti")


def histogram(rows: DataFrame, group: str, value: str, default: str) -> DataFrame:
    return rows.groupBy(group, F.coalesce(value, F.lit(default)).alias(value)).agg(F.count("*").alias("n"))


def pivot_counts(rows: DataFrame, group: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row for each group with a count for each of the given values, absent ones 0."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(value) == v).alias(v) for v in values])


def marginal_yield(rows: DataFrame, group: str, batch: str, item: str) -> DataFrame:
    """Of each batch of a group how many items no earlier batch had, and how many there are by then."""
    first = rows.groupBy(group, item).agg(F.min(batch).alias(batch))
    per = first.groupBy(group, batch).agg(F.count("*").alias("new_items"))
    every = rows.select(group, batch).distinct().join(per, [group, batch], "left").withColumn("new_items", F.coalesce("new_items", F.lit(0)))
    w = Window.partitionBy(group).orderBy(batch)
    return every.withColumn("so_far", F.sum("new_items").over(w)).withColumn("change", F.col("new_items") - F.lag("new_items", 1).over(w))


def last_state(rows: DataFrame, group: str, state: str, seq: str) -> DataFrame:
    return rows.groupBy(group).agg(F.max_by(state, seq).alias(state))


def ladder(rows: DataFrame, group: str, kind: str, url: str, rungs: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """For each group the addresses of each rung's kinds, and whether the rung is used."""
    cols = []
    for name, kinds in rungs:
        found = F.array_sort(F.collect_set(F.when(F.col(kind).isin(*kinds), F.col(url))))
        cols += [found.alias(name), (F.count_if(F.col(kind).isin(*kinds)) > 0).alias(f"{name}_used")]
    return rows.groupBy(group).agg(*cols)


def top_token(rows: DataFrame, group: str, text: str, pattern: str, least: int = 3) -> DataFrame:
    """The most frequent match of a group (the longer, then the smaller one on ties) if seen often enough."""
    n = rows.select(group, F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))).alias("token")).groupBy(group, "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.desc(F.length("token")), "token"))).where("_r = 1").drop("_r")


def existing_reports(records: DataFrame, key: str) -> DataFrame:
    """Per key the lowest report version, the tokens, the models joined, and whether sources are few."""
    return records.groupBy(key).agg(F.min("version").alias("version"), F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("labels"), (F.min("n_sources") < 5).alias("limited_sources"))


def funnel(rows: DataFrame, group: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """Distinct stages seen as a percentage of the plan, 95 at most until the end."""
    seen = F.size(F.collect_set(F.when(F.col(stage).isin(*stages), F.col(stage))))
    return rows.groupBy(group).agg(F.least(F.lit(95), F.floor(seen * 100 / (len(stages) + 3))).cast("int").alias("percent"))


def run_manifest(calls: DataFrame, pages: DataFrame, key: str, kinds: Sequence[str], *, kind: str, host: str) -> DataFrame:
    """One row for each run: its calls of each kind, all calls, pages and distinct hosts; 0 where there are none."""
    c = calls.groupBy(key).agg(F.count("*").alias("calls"), *[F.count_if(F.col(kind) == k).alias(f"calls_{k}") for k in kinds])
    p = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_distinct(host).alias("hosts"))
    return c.join(p, key, "full").na.fill(0)


def cost(calls: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    """(by, cost): tokens by the rate a thousand of their model, to four places; null without a rate."""
    j = calls.join(rates.select("model", "rate"), "model", "left")
    return j.groupBy(by).agg(F.round(F.sum(F.coalesce("tokens", F.lit(0)) / 1000 * F.col("rate")), 4).alias("cost"))
