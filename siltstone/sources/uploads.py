"""Uploaded account lists: decoding, column roles, cleaned items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "latin-1")


def read_csv_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, cells array<string>) of CSV files, each decoded with the first encoding that fits;
    cells stripped, blank rows left out, row 0 the header. A file is one task's work."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        import io

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = ""
                for enc in ENCODINGS:
                    try:
                        text = data.decode(enc)
                        break
                    except UnicodeDecodeError:
                        continue
                rows = [r for r in ([c.strip() for c in x] for x in csv.reader(io.StringIO(text))) if any(r)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["file", "row_no", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, row_no int, cells array<string>")


def column_roles(rows: DataFrame, *, name_hints: Sequence[str] = ("company", "name", "account", "公司", "客户", "名称"), site_hints: Sequence[str] = ("website", "url", "site", "domain", "网址", "官网"), sample: int = 12, share: float = 0.6) -> DataFrame:
    """(file, name_col, site_col, ambiguous) by the header's words, else by what a sample of cells looks like."""
    head = rows.where("row_no = 0").select("file", F.transform("cells", F.lower).alias("h"))

    def place(hints: Sequence[str]):
        return F.get(F.filter(F.transform("h", lambda x, i: F.when(T.has_any(x, hints), i)), lambda i: i.isNotNull()), 0)

    body = rows.where(F.col("row_no").between(1, sample)).select("file", F.posexplode("cells").alias("i", "c")).where("c != ''")
    looks = body.groupBy("file", "i").agg(F.avg(F.col("c").rlike(r"(?i)^(https?://|www\.)|^[a-z0-9\-]+(\.[a-z0-9\-]+)+(/|$)").cast("int")).alias("s")).where(F.col("s") >= share).groupBy("file").agg(F.min("i").alias("u"))
    r = head.select("file", place(name_hints).alias("n"), place(site_hints).alias("s")).join(looks, "file", "left")
    return r.select("file", F.coalesce("n", F.lit(0)).alias("name_col"), F.coalesce("s", "u").alias("site_col"), F.col("n").isNull().alias("ambiguous"))


def items(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """(file, row_no, company, website): named rows, the first of each name, addresses with a scheme."""
    from siltstone.operators.evidence import first_seen

    r = rows.where("row_no > 0").join(roles, "file")
    c = r.select("file", "row_no", F.substring(F.coalesce(F.get("cells", "name_col"), F.lit("")), 1, 200).alias("company"), T.website(F.get("cells", "site_col")).alias("website")).where("company != ''")
    return first_seen(c, [F.col("file"), F.lower("company")], F.col("row_no"))


def coerced(batch: DataFrame, statuses: Sequence[str], default: str = "Pending") -> DataFrame:
    """Batch items with a known status, whole tokens and seconds as numbers or null, addresses with a scheme."""
    ok = F.get(F.filter(F.array(*map(F.lit, statuses)), lambda s: F.lower(s) == F.lower(T.stripped(F.col("item_status")))), 0)
    return batch.withColumn("item_status", F.coalesce(ok, F.lit(default))).withColumn("tokens", F.col("tokens").cast("string").try_cast("double").cast("long")).withColumn("latency", F.nanvl(F.col("latency").cast("string").try_cast("double"), F.lit(None).cast("double"))).withColumn("website", T.website(F.col("website")))
