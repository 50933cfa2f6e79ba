import random

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import websites
from siltstone.plans import planning


def test_websites(spark):
    rows = [
        (1, "Blue Sea Motor", "蓝海", "https://blue-sea-motor.test/", "Blue Sea Motor", "Welcome to Blue Sea Motor, founded 1990", True, 1, "searched"),
        (1, "Blue Sea Motor", "蓝海", "https://portal.test/a/b", "News portal", "Many firms, one is Blue Sea Motor", True, 0, "supplied"),
        (1, "Blue Sea Motor", "蓝海", "https://big.deny.test/blue", "Blue Sea Motor", "Blue Sea Motor", True, 2, "searched"),
        (2, "Zed", "", "https://zed.test", None, None, False, 1, "guessed"), (3, "Qux Works", "", "https://other.test", "x", "y", True, 1, "supplied"), (4, "Nul", "", "", None, None, True, 1, "searched"),
    ]
    df = spark.createDataFrame(rows, "account_id int, name string, name_cn string, url string, title string, text string, readable boolean, seq int, origin string")
    v = websites.validated(df, keywords=("founded",), deny=("deny.test",))
    got = {(r.account_id, r.url): (r.ok, r.why, r.score) for r in v.collect()}
    assert got[(1, "https://blue-sea-motor.test/")] == (True, "validated", 9) and got[(1, "https://big.deny.test/blue")][0] is False and got[(2, "https://zed.test")][:2] == (True, "site_blocked")
    assert {r.account_id: (r.url, r.status) for r in websites.resolved(v.where("url != 'https://portal.test/a/b'")).collect()} == {1: ("https://blue-sea-motor.test/", "discovered"), 2: ("https://zed.test", "discovered"), 3: ("https://other.test", "kept-unconfirmed"), 4: (None, "none")}


def test_partners(spark):
    hits = spark.createDataFrame([(1, 1, "Acme Robotics opens", False, "no identity evidence"), (1, 2, "Acme sneakers", False, "unrelated entity (sneaker)"), (1, 3, "own", True, "official domain"), (1, 4, "none", False, "no identity evidence")], "account_id int, seq int, title string, identity_ok boolean, identity_reason string").withColumn("site_name", F.lit("")).withColumn("url", F.lit(""))
    partners = spark.createDataFrame([(1, "Acme"), (1, "Acme Robotics")], "account_id int, entity string")
    assert {r.seq: (r.identity_ok, r.identity_reason) for r in websites.verified_by_partner(hits, partners).collect()} == {1: (True, "verified partner (Acme Robotics)"), 2: (False, "unrelated entity (sneaker)"), 3: (True, "official domain"), 4: (False, "no identity evidence")}


def test_plans(spark):
    acc = spark.createDataFrame([(1, "Acme", "", "acme.test", False), (2, "Beta", "贝塔", None, True)], "account_id int, name string, name_cn string, domain string, is_listed boolean")
    plan = planning.planned(acc, (("site", "{name}  products {domain}", False), ("same", "{name} PRODUCTS {domain}", False), ("cn", "{name_cn}", False), ("stock", "{name} stock", True)))
    assert [(r.account_id, r.position, r.label, r.query) for r in plan.orderBy("account_id", "position").collect()] == [(1, 1, "site", "Acme products acme.test"), (2, 1, "site", "Beta products"), (2, 2, "cn", "贝塔"), (2, 3, "stock", "Beta stock")]

    asked = []

    def search(part, b):
        asked.append((b, part.count()))
        return part.select("account_id", F.concat(F.lit("https://s.test/"), F.col("query")).alias("url"))

    hits = planning.rounds(plan, search, lambda h: h.groupBy("account_id").count().where("count >= 2"), batches=2, size=2)
    assert asked == [(0, 3), (1, 0)] and hits.count() == 3
    w = planning.waves(acc, lambda a, n: a.select("account_id", F.concat(F.lit("https://w.test/"), F.col("account_id").cast("string"), F.lit(f"/{n}")).alias("url")).where(f"account_id = 1 or {n} = 0"), usable=2, most=3)
    assert w.groupBy("account_id").count().orderBy("account_id").collect() == [(1, 2), (2, 1)]
    left = spark.createDataFrame([(1, "mine", None), (2, "x", "y")], "k int, note string, status string")
    right = spark.createDataFrame([(1, "theirs", "done"), (3, "z", "new")], "k int, note string, status string")
    assert {tuple(r) for r in planning.merged_rows(left, right, "k", ("note",)).collect()} == {(1, "mine", "done"), (2, "x", "y"), (3, "z", "new")}
    items = spark.createDataFrame([(1, 1, "First", True), (1, 2, None, False)], "g int, id int, title string, official boolean")
    lim = spark.createDataFrame([(1, 1, "one"), (1, 2, "two")], "g int, seq int, text string")
    assert planning.summary_section(items, lim, "g", most_limits=1).first().section == "## Evidence\n2 sources, 1 official\n- one\n- [1] First\n- [2] "


def test_local_name(spark):
    df = spark.createDataFrame([("about Acme（蓝海科技） today", "Acme", "蓝海科技"), ("蓝海 Acme wins", "Acme", "蓝海"), ("Acme wins", "Acme", None), (None, "x", None)], "t string, n string, want string")
    assert df.where(~T.local_name(F.col("t"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0


def test_found_by_word_equals_validated_pairs(spark):
    """Pages met by a firm's word give the same choice as every pair judged by itself, and none of a firm's or a page's texts is worked out for each pair."""
    firms = spark.createDataFrame([(1, "Blue Sea Motor GmbH", "blue"), (2, "blue ag", "blue"), (3, "Zed Works", "zed"), (4, "华丰 电池", "华丰"), (5, "Nothing", "nothing")], "account_id long, name string, w string")
    rows = [
        (1, "https://portal.test/a/b", "Blue news", "The Blue Sea Motor plant"), (2, "https://blue-sea-motor.test/", "Blue Sea", "text"), (None, "https://blue-sea-motor.test/x", "blue sea", "text"), (3, "https://zed-works.test", "Zed", None), (4, None, "Zed works", "zed works"),
        (5, "https://blue.test/1/2/3", "About BLUE", None), (6, "https://h.test/", "华丰 电池 - 华丰", "© 2020 Other"), (7, "https://deep.test/a/b/c", "zed", "nothing of it"), (8, "https://q.test", None, "blue"),
    ]
    pages = spark.createDataFrame(rows, "seq long, url string, title string, text string")
    c = pages.withColumn("w", F.explode(F.array_distinct(T.name_tokens(F.coalesce("title", F.lit("")))))).join(firms, "w").select("account_id", "name", F.lit("").alias("name_cn"), "url", "title", "text", F.col("text").isNotNull().alias("readable"), "seq", F.lit("searched").alias("origin"))
    want = sorted(map(tuple, websites.resolved(websites.validated(c)).collect()))
    got = websites.found_by_word(pages, firms)
    assert sorted(map(tuple, got.collect())) == want and {r[0] for r in want} == {1, 2, 3, 4}
    assert "validated" not in str(want) and "copyright" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_found_by_word_in_blocks(spark):
    """Blocks of any size give each pair once, and no firm is broadcast once for each shuffle partition."""
    firms = spark.createDataFrame([(i, f"Blue Nr{i:04d} Works", "blue") for i in range(1000)], "account_id long, name string, w string").dropDuplicates(["account_id"])
    pages = spark.createDataFrame([(i, f"https://nr{i:04d}.test/", f"Blue Nr{i:04d} Works", random.Random(i).randbytes(1500).hex()) for i in range(0, 300, 3)], "seq long, url string, title string, text string")
    want = {i: (f"https://nr{i:04d}.test/", "discovered") if i in range(0, 300, 3) else ("https://nr0000.test/", "discovered") for i in range(1000)}

    def broadcast(node) -> list[int]:
        kind = node.nodeName()
        under = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        return ([node.metrics().apply("dataSize").value()] if kind == "BroadcastExchange" else []) + [x for n in under for x in broadcast(n)]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        got = websites.found_by_word(pages, firms)
        assert {r.account_id: (r.url, r.status) for r in got.collect()} == want
        assert max([0, *broadcast(got._jdf.queryExecution().executedPlan())]) < 20_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    few = websites.found_by_word(pages, firms.where("account_id < 40"), page_block=2, firm_block=3)
    assert sorted((r.account_id, r.url, r.status) for r in few.collect()) == [(i, *want[i]) for i in range(40)]
