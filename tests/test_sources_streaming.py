import gzip
import json

import pytest
from pyspark.sql import functions as F

from siltstone.sinks import tables
from siltstone.sources import pages, records, uploads
from siltstone.streaming import queue, sections


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Company,Website\n Acme ,acme.test\n,\nacme,x.test\n蓝海,http://lh.test\n".encode("gb18030"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbffoo,bar\nBeta,https://beta.test/\nGamma,gamma.test\n")
    rows = uploads.read_csv_uploads(spark, str(tmp_path / "*.csv"))
    roles = uploads.column_roles(rows)
    r = {x.file.rsplit("/", 1)[1]: (x.name_col, x.site_col, x.ambiguous) for x in roles.collect()}
    assert r == {"a.csv": (0, 1, False), "b.csv": (0, 1, True)}
    got = {(x.company, x.website) for x in uploads.items(rows, roles).collect()}
    assert got == {("Acme", "https://acme.test"), ("蓝海", "http://lh.test"), ("Beta", "https://beta.test/"), ("Gamma", "https://gamma.test")}
    b = spark.createDataFrame([("completed", "12", "x", "a.test"), ("odd", None, "1.5", None)], "item_status string, tokens string, latency string, website string")
    assert [(x.item_status, x.tokens, x.latency) for x in uploads.coerced(b, ("Pending", "Completed")).collect()] == [("Completed", 12, None), ("Pending", None, 1.5)]


def test_pages(spark):
    rows = [("u1", gzip.compress("héllo".encode()), None), ("u2", "你好".encode("gb18030"), "gb2312"), ("u3", b"\xff\xfe bad", "nope"), ("u4", None, None), ("u5", '<meta charset="big5">'.encode() + "中".encode("big5"), "")]
    df = pages.decoded(spark.createDataFrame(rows, "url string, body binary, charset string"))
    got = {r.url: r.html for r in df.collect()}
    assert got["u1"] == "héllo" and got["u2"] == "你好" and got["u4"] is None and got["u5"].endswith("中")
    s = spark.createDataFrame([("x" * 400, "", 200, None, "standard"), ("", "y" * 400, 200, None, "script-bundle"), ("", "", 403, None, "blocked"), ("", "", 500, None, "http_error"), (None, None, None, "dns", "unreachable"), ("", None, 200, "", "insufficient")], "t string, s string, c int, f string, want string")
    assert s.where(pages.retrieval_status(F.col("t"), F.col("s"), F.col("c"), F.col("f")) != F.col("want")).count() == 0
    html = '<a href="/about/us/team">a</a><a href="/about">b</a><a href="/about/x">c</a><a href="https://other.test/about">d</a><a href="/p.pdf">e</a><a href="products">f</a>'
    l = pages.section_links(spark.createDataFrame([(1, "https://acme.test/", "acme.test", html)], "g int, url string, d string, html string"), "g", "d", (("about", "/about"), ("products", "/products")))
    assert {(r.section, r.link) for r in l.collect()} == {("about", "https://acme.test/about"), ("about", "https://acme.test/about/x"), ("products", "https://acme.test/products")}
    t = "Title: A\nURL: https://a.test\nContent: one\ntwo\nTitle: B\nURL: ftp://b\nContent: x"
    assert [(r.title, r.url, r.content) for r in pages.search_results(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").collect()] == [("A", "https://a.test", "one\ntwo")]
    e = spark.createDataFrame([('data: {"a":1}\n\nevent: x\ndata: b\ndata: c\n\ndata: [DONE]\n\n',)], "s string")
    assert e.select(pages.sse_events(F.col("s")).alias("d")).first().d == ['{"a":1}', "b\nc"]
    q = spark.createDataFrame([("<tr><td>Market Cap</td><td>1.2B</td></tr><tr><td>Market Cap</td><td>9</td></tr><tr><td>Other Thing</td><td>2</td></tr>",)], "h string")
    assert q.select(pages.quote_fields(F.col("h"), ("Market Cap",)).alias("m")).first().m == {"Market Cap": "1.2B"}


def test_pages_source(spark, monkeypatch):
    spark.dataSource.register(pages.PagesSource)
    df = spark.read.format("siltstone_pages").option("urls", "http://a.test/1,http://a.test/2,http://b.test/1").option("fetcher", "json:loads").load()
    got = df.collect()
    assert len(got) == 3 and {r.failed for r in got} == {"failed"}


def test_records_and_sinks(spark, tmp_path):
    for i, (c, at) in enumerate([("a", "2024-01-01"), ("a", "2024-02-01"), ("b", "2024-01-05")]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"company": c, "at": at}))
    r = records.read_records(spark, str(tmp_path), "company string, at string, extra int")
    assert {(x.company, x.at, x.extra) for x in records.newest(r.select("company", "at", "extra"), "company", "at").collect()} == {("a", "2024-02-01", None), ("b", "2024-01-05", None)}
    assert records.history(r, "at", "file", 2).count() == 2
    k = spark.createDataFrame([(" Acme ", "X"), ("acme", "x")], "a string, b string").select(records.cache_key(F.col("a"), F.col("b")).alias("cache_key"))
    assert k.distinct().count() == 1 and records.cache_misses(k, k.limit(0)).count() == 2
    old = spark.createDataFrame([(1, "m", 1), (1, "n", 1)], "k int, model string, v int")
    new = spark.createDataFrame([(1, "m", 2)], "k int, model string, v int")
    assert {(x.model, x.v) for x in tables.upserted(old, new, ("k", "model")).collect()} == {("m", 2), ("n", 1)}
    assert tables.without(old, new, ("k", "model")).count() == 1
    out = str(tmp_path / "pk")
    p = spark.createDataFrame([(1, "x"), (2, "y")], "account_id int, t string")
    tables.write_packages(p, out)
    tables.write_packages(p.where("account_id = 1").withColumn("t", F.lit("z")), out)
    assert {(x.account_id, x.t) for x in spark.read.parquet(out).collect()} == {(1, "z"), (2, "y")}


LOG = [
    (1, 0.0, "enqueue", "a", None, None), (2, 1.0, "enqueue", "b", None, None), (3, 2.0, "enqueue", "c", None, None), (4, 3.0, "enqueue", "a", None, None), (5, 4.0, "claim", None, "w1", None), (6, 5.0, "claim", None, "w2", None),
    (7, 6.0, "claim", None, "w3", None), (8, 50.0, "heartbeat", "a", "w1", 1), (9, 60.0, "finish", "b", "w9", 1), (10, 100.0, "claim", None, "w3", None), (11, 101.0, "finish", "b", "w2", 1), (12, 102.0, "finish", "a", "w1", 1), (13, 103.0, "finish", "b", "w3", 2),
]
WANT = [("a", "queued", True), ("b", "queued", True), ("c", "queued", True), ("a", "queued", False), ("a", "running", True), ("b", "running", True), (None, None, False), ("a", "running", True), ("b", "running", False), ("b", "running", True), ("b", "running", False), ("a", "completed", True), ("b", "completed", True)]


def test_queue_replay_and_stream(spark, tmp_path):
    schema = queue.COMMANDS
    rows = [("q", s, t, op, j, w, a, None) for s, t, op, j, w, a in LOG]
    df = spark.createDataFrame(rows, schema)
    got = queue.replayed(df.repartition(3)).orderBy("seq").collect()
    assert [(r.job_id, r.status, r.accepted) for r in got] == WANT
    for i, part in enumerate((rows[:6], rows[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = queue.streamed(stream).writeStream.format("memory").queryName("q_events").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("q_events").count() == len(LOG)


def test_queue_walks_over_no_job():
    """A command costs little however many jobs there are, and leases end, are extended and taken back as before."""

    class Jobs(dict):
        def values(self):
            raise AssertionError("all jobs were walked over")

        items = __iter__ = values

    q = queue.Queue(lease=10.0, attempts=2, ceiling=2)
    q.jobs = Jobs()
    do = lambda at, op, job=None, worker="w", attempt=None, value=None: q.handle({"seq": int(at * 10), "at": at, "op": op, "job_id": job, "worker_id": worker, "attempt": attempt, "value": value})
    for i in range(5):
        do(i / 10, "enqueue", f"j{i}")
    assert [do(1.0, "claim")[0] for _ in range(3)] == ["j0", "j1", None]
    assert do(9.0, "heartbeat", "j0", attempt=1)[4] and do(11.0, "claim")[0::4] == ("j1", True)
    assert do(12.0, "finish", "j0", attempt=1, value="queued")[3] == "queued" and do(12.0, "claim")[:3] == ("j0", "w", 2)
    assert do(30.0, "claim")[0] == "j2" and q.jobs["j0"]["status"] == q.jobs["j1"]["status"] == "failed"


def test_sections_stream(spark, tmp_path):
    s = {"done": [], "last": -1e18}
    assert sections.flushed(s, 0, "## A\nx", False, 4) == [(1, "A", "x", "partial")]
    assert sections.flushed(s, 1, "## A\nx\n## B\ny", False, 4) == [(1, "A", "x", "complete")]
    assert sections.flushed(s, 9, "## A\nx\n## B\nyz", False, 4) == [(2, "B", "yz", "partial")]
    assert [x[3] for x in sections.flushed(s, 9, "## A\nx\n## B\nyz", True, 4)] == ["complete", "complete"]
    schema = "job_id string, seq int, at double, chunk string, final boolean"
    spark.createDataFrame([("j", 1, 0.0, "## A\nx\n", False), ("j", 2, 1.0, "## B\ny", True)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = sections.streamed(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("sec").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.position, r.status) for r in spark.table("sec").collect()} == {(1, "partial"), (1, "complete"), (2, "complete")}
    e = spark.createDataFrame([("j", "s1", "2024-01-01 00:00:00"), ("j", "s2", "2024-01-01 00:10:00")], "job_id string, stage string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sections.progress(e, ("s1", "s2", "s3")).first().percent == 33


@pytest.mark.parametrize("how,want", [("upload", ["b", "a"]), ("name", ["a", "b"]), ("completed", ["b", "a"])])
def test_order(spark, how, want):
    df = spark.createDataFrame([("b", 1, 1), ("a", 2, None)], "company string, seq int, at int")
    assert [r.company for r in records.ordered(df, how).orderBy("place").collect()] == want


def test_scratch_tables(spark):
    import os

    from siltstone import session

    df = session.written(spark.range(3).toDF("id"), "t")
    assert df.count() == 3 and df.columns == ["id"]
    folder = f"{session.shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"
    assert os.path.isdir(folder)
    session.clear(spark)
    assert not os.path.exists(folder)
