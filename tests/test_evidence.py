import random

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evidence as E


def test_identity_ladder(spark):
    acc = spark.createDataFrame(
        [(1, "Lenz AG", "", "lenz.com", [], []), (2, "Novek", "诺维克", "", [], ["sneaker"]), (3, "Elite Battery Systems", "", "", ["ebs-x"], [])],
        "account_id int, name string, name_cn string, domain string, aliases array<string>, collisions array<string>",
    )
    rows = [
        (1, "x", "https://www.lenz.com/a", "official domain"), (1, "Lenz announces", "https://n.test/1", "name match without legal suffix (Lenz)"), (1, "silenzio", "https://n.test/2", "no identity evidence"),
        (1, "Lenz AG wins", "https://n.test/3", "full-name match"), (2, "novek sneaker", "https://n.test/4", "unrelated entity (sneaker)"), (2, "诺维克 sneaker", "https://n.test/5", "chinese-name match"),
        (3, "Battery systems for storage", "https://n.test/6", "no identity evidence"), (3, "Elite battery plant", "https://n.test/7", "name tokens (elite, battery)"), (3, "EBS-X line", "https://n.test/8", "alias match (ebs-x)"), (9, "who", "https://n.test/9", "no identity evidence"),
    ]
    hits = spark.createDataFrame([(a, t, u, "", e) for a, t, u, e in rows], "account_id int, title string, url string, site_name string, want string")
    got = E.judge_identity(hits, acc, common=("battery", "systems")).collect()
    assert len(got) == len(rows)
    assert [(r.title, r.identity_reason) for r in got if r.identity_reason != r.want] == []
    assert all(r.identity_ok == (not r.identity_reason.startswith(("unrelated", "no identity"))) for r in got)


def test_classify_and_category(spark):
    rules = (("in_host_or_path", ("job",), 6, "job-board"), ("host", ("sec.test",), 3, "filing"), ("in_host", ("mag",), 5, "press"))
    paths = ((("/investor",), 2, "ir"),)
    rows = [("https://a.acme.test/investor/x", "acme.test", 2, "ir"), ("https://acme.test/", "acme.test", 1, "official-website"), ("https://x.test/jobs/1", "", 6, "job-board"), ("https://www.sec.test/f", "", 3, "filing"), ("https://notsec.test/f", "", 6, "other-web-source"), ("https://mag.test", "", 5, "press"), (None, None, 6, "other-web-source")]
    df = spark.createDataFrame(rows, "url string, d string, tier int, kind string")
    c = E.classify(F.col("url"), F.col("d"), rules, paths=paths)
    assert df.where((c["tier"] != F.col("tier")) | (c["source_type"] != F.col("kind"))).count() == 0
    p = spark.createDataFrame([("https://x.com/a", False), ("https://fox.com/a", True), ("", False), (None, False)], "url string, want boolean")
    assert p.where(E.plausible(F.col("url"), ("x.com",)) != F.col("want")).count() == 0


def walk(rows, most, per_domain, low_budget, low_if_strong, strong):
    """The admission walk, restated plainly."""
    rows = sorted(rows, key=lambda r: (r["tier"], r["subrank"], r["seq"]))
    budget = low_if_strong if sum(r["tier"] <= 2 for r in rows) >= strong else low_budget
    kept, seen, doms, low, waiting = [], set(), {}, 0, []
    for second in (False, True):
        for r in waiting if second else rows:
            if r["key"] in seen or len(kept) >= most:
                continue
            if not second and doms.get(r["dom"], 0) >= per_domain:
                waiting.append(r)
                continue
            if r["tier"] >= 6 and not (r["ver"] and not r["off"]):
                if low >= budget:
                    continue
                low += 1
            seen.add(r["key"])
            doms[r["dom"]] = doms.get(r["dom"], 0) + 1
            kept.append(r["seq"])
    return set(kept)


def test_caps_against_plain_walk(spark):
    rnd = random.Random(3)
    data, want = [], {}
    for a in range(60):
        rows = []
        for i in range(rnd.randint(0, 30)):
            dom, page = f"h{rnd.randint(0, 4)}.test", rnd.randint(0, 12)
            rows.append(dict(seq=i, tier=rnd.randint(1, 7), subrank=rnd.randint(1, 2), dom=dom, key=f"{dom}/{page}", ver=rnd.random() < 0.3, off=rnd.random() < 0.3))
        want[a] = walk(rows, 8, 3, 4, 1, 5)
        data += [(a, r["seq"], r["tier"], r["subrank"], f"https://{r['key']}", r["ver"], r["off"]) for r in rows]
    df = spark.createDataFrame(data, "account_id int, seq int, tier int, subrank int, url string, content_verified boolean, official boolean")
    out = E.capped(df, "account_id", most=8, per_domain=3, low_budget=4, low_if_strong=1).collect()
    assert len(out) == len(data)
    got = {a: {r.seq for r in out if r.account_id == a and r.kept} for a in want}
    assert got == want
    for a in want:
        assert sorted(r.id for r in out if r.account_id == a and r.kept) == list(range(1, len(want[a]) + 1))
    assert all((r.drop_reason is None) == r.kept for r in out)


def test_dedupe_counts_and_topics(spark):
    rows = [(1, "https://a.test/x", "t2", 5, "late"), (1, "http://www.a.test/x/", "t1", 2, "first"), (1, "https://a.test/x?q", "t2", 9, "z"), (1, "https://a.test/y", None, 1, "y")]
    df = spark.createDataFrame(rows, "account_id int, url string, topic string, seq int, title string")
    got = {r.url_key: r for r in E.dedupe_with_counters(df, "account_id", "url", "topic", "seq").collect()}
    assert (got["a.test/x"].hits, got["a.test/x"].title, got["a.test/x"].topics) == (3, "first", ["t1", "t2"])
    assert got["a.test/y"].topics == []


def test_insert_at_rank(spark):
    base = [(1, i, t, 2) for i, t in enumerate([1, 1, 4, 6, 6], 1)] + [(2, 1, 3, 2)]
    rows = spark.createDataFrame(base, "account_id int, id int, tier int, subrank int").withColumn("src", F.lit("old"))
    new = spark.createDataFrame([(1, 4, 1), (2, 9, 2), (3, 4, 1)], "account_id int, tier int, subrank int").withColumn("src", F.lit("new"))
    got = E.inserted(rows, new, "account_id", most=5).orderBy("account_id", "id").collect()
    assert [(r.tier, r.src) for r in got if r.account_id == 1] == [(1, "old"), (1, "old"), (4, "new"), (4, "old"), (6, "old")]
    assert [(r.tier, r.src) for r in got if r.account_id == 2] == [(3, "old"), (9, "new")]
    assert [r.id for r in got if r.account_id == 3] == [1]
    refused = spark.createDataFrame([(1, 6, 2)], "account_id int, tier int, subrank int").withColumn("src", F.lit("new"))
    assert {r.src for r in E.inserted(rows.where("account_id = 1"), refused, "account_id", most=5).collect()} == {"old"}


def test_category_rank_and_empty(spark):
    df = spark.createDataFrame([("news",), ("other",), ("financial",)], "c string")
    got = [r.c for r in df.orderBy(E.category_rank(F.col("c"), ("news",))).collect()]
    assert got == ["news", "financial", "other"]
    none = spark.createDataFrame([], "account_id int, seq int, tier int, subrank int, url string, content_verified boolean, official boolean")
    assert E.capped(none, "account_id").count() == 0


def test_region(spark):
    df = spark.createDataFrame([("Title", "Body text\n© 2024 Acme Ltd all\nmore")], "t string, x string")
    assert "© 2024 acme ltd all" in df.select(T.identity_region(F.col("t"), F.col("x"), 4).alias("r")).first().r


def test_pipeline_takes_every_firm(spark, tmp_path):
    """Firms that share their first word, have a short, accented or Cyrillic one, or are met by a later word alone."""
    from siltstone.queries import evidence as Q

    firms = ["Kobri Letun Ltd", "Kobri Sokar Ltd", "Abc GmbH", "Ålands Ostravyane AB", "ООО «Гопоренен»", "华丰"]
    titles = ["The plant of Letun", "Sokar opens", "News of Abc", "Ostravyane at work", "Завод ооо «гопоренен» сегодня", "华丰 grows"]
    spark.createDataFrame(list(enumerate(firms)), "item_id long, company string").write.parquet(f"{tmp_path}/batch_items.parquet")
    spark.createDataFrame([(i, f"https://n{i}.example/a", x, None, i) for i, x in enumerate(titles)], "source_id long, url string, title string, site_name string, source_index int").write.parquet(f"{tmp_path}/gapfill_sources.parquet")
    spark.createDataFrame([], "page_id long, url string, page_text string").write.parquet(f"{tmp_path}/fetched_pages.parquet")
    got = {(r.account_id, r.url_key) for r in Q.evidence_pipeline(spark, str(tmp_path)).collect()}
    assert {a for a, _ in got} == set(range(len(firms))) and len(got) == len(firms)


def test_evidence_by_words_equals_all_pairs(spark):
    """The slates worked out by sets of words are those of every firm with every source, and no row is made for each pair."""
    from siltstone.plans import meeting, pipeline
    from siltstone.queries.evidence import GROUPS, RULES

    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "华丰", "电池", "z9"]
    firms = [(i, " ".join(rnd.sample(words, rnd.randint(1, 3))) + rnd.choice(("", " gmbh", ", s.r.o."))) for i in range(25)] + [(30, "ооо «гопор»"), (31, "ag"), (32, "гопор")]
    hosts = ("a-ledger.example", "weekly.example", "x.example", "alpha.example", "zellenbote.example")
    src = [(i, f"https://{rnd.choice(hosts)}/{rnd.choice(('view', 'n'))}/{rnd.randint(0, 120)}{rnd.choice(('', '/', '?q=1'))}", rnd.choice((" ", "-")).join(rnd.sample(words, 2)) + rnd.choice(("", " S.r.o. AG", " ооо «гопор» x", " Гопор")), rnd.choice((None, "Beta Post"))) for i in range(500)]
    f, s = spark.createDataFrame(firms, "account_id long, name string"), spark.createDataFrame([*src, (900, None, "alpha 9", None), (901, "https://n.example/1", None, "alpha"), (902, "https://n.example/2", "\u212a9 z9", None)], "source_id long, url string, title string, site_name string")
    pages = spark.createDataFrame([("x.example/n/1", ""), ("weekly.example/n/2", "")], "url_key string, text string")
    got = pipeline.evidence_by_words(s, f, pages, rules=RULES, groups=GROUPS)
    own = T.distinctive_tokens(F.col("name"), ())
    by = f.select("account_id", F.explode(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(meeting.letters(F.col("name"))))).alias("w"))
    title = F.coalesce("title", F.lit(""))
    hits = by.join(s.select("*", F.explode(F.array_distinct(F.concat(T.name_tokens(title), meeting.letters(title)))).alias("w")), "w").drop("w").distinct().withColumn("topic", F.col("site_name")).withColumnRenamed("source_id", "seq")
    accounts = f.select("*", F.lit("").alias("name_cn"), F.lit("").alias("domain"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("collisions"))
    want = pipeline.evidence(hits, accounts, pages, rules=RULES, groups=GROUPS)
    columns = ["account_id", "id", "url_key", "tier", "source_type", "category", "hits", "identity_reason", "content_verified"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows(got) == rows(want) and {r[0] for r in rows(got)} >= {0, 30, 32}
    _, counted, _ = meeting.met(s, f, F.lit(3))
    assert counted.count() < hits.count() / 2
