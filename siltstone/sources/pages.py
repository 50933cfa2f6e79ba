"""Fetched pages: bytes to text, retrieval status, links, search replies, quote pages, tickers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions import text as T


def decoded(pages: DataFrame, body: str = "body", charset: str = "charset") -> DataFrame:
    """Pages with html: bodies unpacked (gzip or deflate by their first bytes) and decoded by the named
    charset, else the one in the page's head, else UTF-8; wrong bytes become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib

        wider = {"gb2312": "gb18030", "gbk": "gb18030"}
        for b in batches:
            at, cs = b.schema.get_field_index(body), b.schema.get_field_index(charset)
            out = []
            for data, name in zip(b.column(at).to_pylist(), b.column(cs).to_pylist()):
                if data is None:
                    out.append(None)
                    continue
                try:
                    data = zlib.decompress(data, 47) if data[:2] in (b"\x1f\x8b", b"\x78\x9c", b"\x78\x01", b"\x78\xda") else data
                except zlib.error:
                    pass
                if not name:
                    m = re.search(rb"charset=[\"']?([A-Za-z0-9_\-]+)", data[:2048])
                    name = m[1].decode() if m else "utf-8"
                try:
                    out.append(data.decode(wider.get(name.lower(), name), "replace"))
                except LookupError:
                    out.append(data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at], pa.array(out, pa.string())], names=[*[n for n in b.schema.names if n != body], "html"])

    kept = [f for f in pages.schema.fields if f.name != body]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "html string"])
    return pages.mapInArrow(run, schema)


def retrieval_status(text: Column, script_text: Column, http_code: Column, failed: Column, least: int = 400) -> Column:
    """How a page was got: its own text, its script bundle's, blocked, unreachable, an HTTP error or too little."""
    return (
        F.when(http_code.isin(401, 403, 405, 429), "blocked").when(http_code >= 400, "http_error").when(F.coalesce(failed, F.lit("")) == "dns", "unreachable").when(F.coalesce(failed, F.lit("")) == "timeout", "timeout")
        .when(F.coalesce(failed, F.lit("")) != "", "failed").when(F.length(F.coalesce(text, F.lit(""))) >= least, "standard").when(F.length(F.coalesce(script_text, F.lit(""))) >= least, "script-bundle").otherwise("insufficient")
    )


def section_links(pages: DataFrame, group: str, domain: str, sections: Sequence[tuple[str, str]], *, skip: str = r"\.(pdf|jpg|jpeg|png|gif|zip|mp4|css|js)$|/(login|cart|search)\b", per_section: int = 2, most: int = 8) -> DataFrame:
    """(group, section, link): of the home page's links on its own domain the shallowest few of each section."""
    href = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    base = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    l = pages.select(group, F.col(domain).alias("_d"), base.alias("_b"), F.explode(F.array_distinct(href)).alias("h"))
    l = l.withColumn("link", F.when(F.col("h").rlike("(?i)^https?://"), F.col("h")).when(F.startswith("h", F.lit("//")), F.concat(F.lit("https:"), "h")).when(F.startswith("h", F.lit("/")), F.concat("_b", "h")).when(~F.col("h").rlike("(?i)^[a-z]+:"), F.concat("_b", F.lit("/"), "h")))
    l = l.where(F.col("link").isNotNull() & T.host_under(F.col("link"), F.col("_d")) & ~F.lower("link").rlike(skip))
    sect = None
    for name, pattern in sections:
        sect = (sect if sect is not None else F).when(F.lower(T.path(F.col("link"))).rlike(pattern), F.lit(name))
    l = l.withColumn("section", sect).where("section is not null").withColumn("depth", F.size(F.filter(F.split(T.path(F.col("link")), "/"), lambda p: p != ""))).dropDuplicates([group, "link"])
    l = l.withColumn("_n", F.row_number().over(Window.partitionBy(group, "section").orderBy("depth", "link"))).where(F.col("_n") <= per_section)
    return l.withColumn("_m", F.row_number().over(Window.partitionBy(group).orderBy("depth", "link"))).where(F.col("_m") <= most).select(group, "section", "link", "depth")


def search_results(replies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, title, url, content) of Title / URL / Content blocks; only web addresses."""
    block = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?m)^(?=Title:)"), lambda b: F.startswith(b, F.lit("Title:")))
    r = replies.select(key, F.posexplode(block).alias("pos", "b"))
    part = lambda p: T.stripped(F.regexp_extract("b", p, 1))
    return r.select(key, "pos", part(r"(?m)^Title:[ \t]*(.*)$").alias("title"), part(r"(?m)^URL:[ \t]*(\S+)").alias("url"), part(r"(?s)\nContent:[ \t]*(.*)$").alias("content")).where(F.col("url").rlike("(?i)^https?://"))


def sse_events(stream: Column) -> Column:
    """The data of each event of a server-sent stream, lines of one event joined, the end mark left out."""
    events = F.split(F.regexp_replace(F.coalesce(stream, F.lit("")), "\r\n", "\n"), r"\n\n+")
    data = F.transform(events, lambda e: F.array_join(F.transform(F.filter(F.split(e, "\n"), lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda d: (d != "") & (d != "[DONE]"))


def quote_fields(html: Column, labels: Sequence[str]) -> Column:
    """Label to value of a quote page, the first value of each of the known labels."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(r"(?is)<(?:td|span|li)[^>]*>\s*([A-Z][^<>]{2,40}?)\s*</(?:td|span)>\s*<(?:td|span)[^>]*>\s*([^<>]{1,60}?)\s*<"), F.lit(1)).alias("l"),
        F.regexp_extract_all(html, F.lit(r"(?is)<(?:td|span|li)[^>]*>\s*([A-Z][^<>]{2,40}?)\s*</(?:td|span)>\s*<(?:td|span)[^>]*>\s*([^<>]{1,60}?)\s*<"), F.lit(2)).alias("v"),
    )
    known = F.filter(pairs, lambda p: T.has_any(p["l"], labels) & (p["v"] != ""))
    names = F.array_distinct(F.transform(known, lambda p: p["l"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.get(F.filter(known, lambda p: p["l"] == n), 0)["v"])))


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """(title, ticker) of a JSON-lines listing file; the first entry of a title stands."""
    rows = spark.read.schema("cik_str long, ticker string, title string").json(path)
    return rows.where("title is not null").groupBy("title").agg(F.min_by("ticker", "cik_str").alias("ticker"))


class PagesSource(DataSource):
    """Batch source of pages: options ``urls`` (comma-parted) and ``fetcher`` (module:function giving
    (status, body) for an address); one partition for each host, so that no host is asked in parallel."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_pages"

    def schema(self) -> str:
        return "url string, http_code int, body binary, failed string"

    def reader(self, schema) -> DataSourceReader:
        return _PagesReader(self.options)


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split(",") if u]
        self.fetcher = options.get("fetcher", "")

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(u.split("/")[2] if "://" in u else u, []).append(u)
        return [_Host(v) for v in hosts.values()] or [_Host([])]

    def read(self, partition):
        import importlib

        module, _, name = self.fetcher.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for u in partition.urls:
            try:
                code, body = fetch(u)
                yield (u, int(code), bytes(body), None)
            except TimeoutError:
                yield (u, None, None, "timeout")
            except Exception as e:  # noqa: BLE001 - a page that fails is a row, not the end of a job
                yield (u, None, None, "dns" if "resolve" in str(e).lower() else "failed")
