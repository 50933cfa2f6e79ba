from pyspark.sql import functions as F

from siltstone.functions import text as T


def one(spark, value, f, schema="c string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("c")).alias("x")).first().x


def test_url_parts(spark):
    assert one(spark, " HTTPS://www.Acme.com/A/b/?q=1#x ", T.url_key) == "acme.com/a/b"
    assert one(spark, "http://acme.com", T.url_key) == one(spark, "https://www.acme.com/", T.url_key)
    assert one(spark, "not a url", T.url_key) == ""
    assert one(spark, None, T.url_key) == ""
    assert one(spark, "https://news.motor.com.cn:8080/x", T.registrable_domain) == "motor.com.cn"
    assert one(spark, "https://a.b.co.uk/x", T.registrable_domain) == "b.co.uk"
    assert one(spark, "https://www.example.test", T.registrable_domain) == "example.test"
    assert one(spark, "https://red-auto.com", T.domain_label) == "red-auto"
    assert one(spark, "https://redstone-auto.com", lambda c: T.domain_stems(c, ("auto",))) == ["redstone"]


def test_html_to_text(spark):
    html = "<html><script>var a</script><p>Hello &amp; welcome</p><!-- x --><p>Hello &amp; welcome</p><p>1</p><p>你好世界</p>"
    assert one(spark, html, T.html_to_text) == "Hello & welcome\n你好世界"
    assert one(spark, None, T.html_to_text) == ""


def test_names(spark):
    assert one(spark, "Lenz AG", T.core_name) == "Lenz"
    assert one(spark, "Acme Holding Co., Ltd.", T.core_name) == "Acme"
    assert one(spark, "AG", T.core_name) == "AG"
    assert one(spark, "Dr. Anna van Berg", T.person_key) == "anna berg"
    assert one(spark, "", T.person_key) == ""
    assert one(spark, "Acme 公司 & Sons!", T.org_key) == "acme公司sons"
    r = one(spark, "Blue Sea / 蓝海", T.split_company)
    assert (r.name, r.name_cn) == ("Blue Sea", "蓝海")
    assert one(spark, "蓝海", T.split_company).name_cn == "蓝海"
    assert one(spark, "Director of Supply Chain", T.title_variants) == ["director of supply chain", "supply chain director"]
    assert one(spark, "Acme (NASDAQ: ACME)", T.explicit_ticker) == "ACME"
    assert one(spark, "Acme (USA)", T.explicit_ticker) is None
    assert one(spark, "acme.com", T.website) == "https://acme.com"
    assert one(spark, "https://www.linkpro.example/in/a-b/?x=1", T.linkedin_key) == "linkpro.example/in/a-b"
    assert one(spark, " n/a ", T.placeholder_to_empty) == ""
    hosts = one(spark, "Blue Motor GmbH", lambda c: T.guess_domains(c, ("motor",)))
    assert hosts[0] == "bluemotor.com" and len(hosts) <= 12 and "blue.de" in hosts


def test_mentions(spark):
    rows = [("LENZ announces", "lenz", True), ("silenzio", "lenz", False), ("创企Voltera融资", "voltera", True), (None, "x", False), ("a", "", False), ("a.b+c", "b+c", True)]
    df = spark.createDataFrame(rows, "t string, w string, e boolean")
    assert df.where(T.mentions(F.col("t"), F.col("w")) != F.col("e")).count() == 0


def test_sizes_against_python(spark):
    import json

    for t in ("abc", 'q"\\\n\t\x01', "é中😀", "", "a" * 100_000):
        assert one(spark, t, T.escaped_size) == len(json.dumps(t)) - 2
        assert one(spark, t, T.utf8_size) == len(t.encode())
        for n in (0, 1, 3, 4, 5, 7):
            assert one(spark, t, lambda c, n=n: T.clip_bytes(c, F.lit(n))) == t.encode()[:n].decode("utf-8", "ignore")
    assert one(spark, "中文abcd", T.estimate_tokens) == int(2 + 4 / 3.6)


def test_passages(spark):
    t = "A short one. This sentence is long enough to stay! Another that is also long enough.\n\nParagraph number two here."
    assert one(spark, t, T.passages) == ["This sentence is long enough to stay!", "Another that is also long enough.", "Paragraph number two here."]
    assert one(spark, "Über große Straßen und die große Welt", T.shingle) == ["über", "große", "straßen", "welt"]


def test_heading_side(spark):
    df = spark.createDataFrame([("Overview / 概况",)], "c string")
    assert df.select(T.heading_side(F.col("c"), F.lit("zh")).alias("x")).first().x == "概况"
    assert df.select(T.heading_side(F.col("c"), F.lit("en")).alias("x")).first().x == "Overview"
    assert df.select(T.heading_side(F.col("c"), F.lit("bilingual")).alias("x")).first().x == "Overview / 概况"


def test_aliases(spark):
    df = spark.createDataFrame([("蓝海", "https://www.lanhai-auto.com", "lanhai cars")], "n string, u string, r string")
    assert df.select(T.aliases(F.col("n"), F.col("u"), F.col("r"), ("auto",)).alias("x")).first().x == ["lanhai"]
