"""Writing results: partitioned packages, upserts, deletion, foreachBatch targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_packages(packages: DataFrame, path: str, group: str = "account_id", fmt: str = "parquet") -> None:
    """Each account's package under its own folder; accounts written again replace theirs alone."""
    packages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).format(fmt).save(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after new rows replaced old ones of the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def batch_sink(deliver: Callable[[list[dict]], None], owned: Callable[[DataFrame], DataFrame], size: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that delivers the rows still owned, ``size`` at a time, from the executors."""

    def send(batch: DataFrame, _: int) -> None:
        def part(rows):
            held = []
            for r in rows:
                held.append(r.asDict(recursive=True))
                if len(held) >= size:
                    deliver(held)
                    held = []
            if held:
                deliver(held)

        owned(batch).foreachPartition(part)

    return send


def evidence_block(items: DataFrame, group: str) -> DataFrame:
    """(group, block): numbered sources with their text, in id order, as a prompt quotes them."""
    line = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return items.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("block"))
