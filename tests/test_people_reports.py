from pyspark.sql import functions as F

from siltstone.operators import compaction, discovery, people, reports, rollups


def test_merge_is_greedy_and_ordered(spark):
    rows = [
        (1, 1, "CRM", "Anna Berg", "CEO", "", "link.test/in/ab", "a@x.test", "verified", "Acme", "Oslo", 5),
        (1, 2, "Web", "Dr. Anna Berg", "Chief", "Board", None, None, None, None, None, 9),
        (1, 3, "Directory", "A. Berg", None, None, None, "A@x.test", None, "Other", None, 1),
        (1, 4, "Directory", "Bo Lund", None, None, None, None, None, "Acme", None, 2),
        (1, 5, "Web", None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "account_id int, seq int, source string, name string, title string, department string, linkedin_url string, email string, email_status string, company string, location string, score int")
    got = people.merged_roster(df).orderBy("first_seq").collect()
    assert [(r.name, r.title, r.score, r.sources, r.corroborated) for r in got[:2]] == [("Anna Berg", "CEO", 9, ["CRM", "Web", "Directory"], True), ("Bo Lund", "", 2, ["Directory"], False)]
    assert got[0].department == "Board"
    s = people.roster_summary(people.merged_roster(df), "account_id").first()
    assert (s.total, s.merged, s.verified_email) == (3, 1, 1)
    assert people.roster_markdown(people.merged_roster(df), "account_id").first().markdown.count("\n") == 4


def test_title_scores(spark):
    rules = ((100, "Exec", r"\bchief executive\b"), (70, "Supply", r"\bsupply chain\b.{0,9}\bdirector\b"))
    df = spark.createDataFrame([("Chief Executive Officer", "c_suite", 112), ("Director of Supply Chain", None, 70), ("Executive Assistant to the Chief Executive", None, 0), (None, None, 0)], "title string, s string, want int")
    c = people.title_score(F.col("title"), F.col("s"), rules, r"\bassistant\b", {"c_suite": 12})
    assert df.where(c["score"] != F.col("want")).count() == 0


def test_discovery(spark):
    words = ("laser", "welding", "systems", "provider", "unknown")
    df = spark.createDataFrame([("Bosch Rexroth", True), ("laser welding systems", False), ("Laser Welding", False), ("先导智能", True), ("x", False), (None, False), ("acme robotics inc", True)], "n string, want boolean")
    assert df.where(discovery.is_named_organisation(F.col("n"), words) != F.col("want")).count() == 0
    rel = spark.createDataFrame([("Acme supplied Dorf with lines", "CONFIRMED"), ("Acme reportedly supplied Dorf", "STRONG_INDICATION"), ("Acme sells", "MARKET_ONLY"), (None, "MARKET_ONLY")], "t string, want string")
    assert rel.where(discovery.relationship(F.col("t"), F.array(F.lit("Dorf")), "suppl(y|ied)", "reportedly") != F.col("want")).count() == 0
    rows = spark.createDataFrame([(1, 1, "Beta", True, True, True), (1, 2, "beta ", True, True, True), (1, 3, "Acme Inc", True, True, True), (1, 4, "TBD", True, True, True), (1, 5, "Gamma", True, False, True), (1, 6, "Delta", True, True, None), (1, 7, None, None, True, True)], "g int, seq int, name string, v boolean, c boolean, s boolean")
    g = discovery.guarded(rows, "g", own=F.array(F.lit("Acme")), valid=F.col("v"), cited=F.col("c"), supported=F.col("s"))
    assert {r.seq: r.drop_reason for r in g.collect()} == {1: None, 2: "duplicate", 3: "self", 4: "placeholder", 5: "uncited", 6: "unsupported", 7: "schema"}
    acc = spark.createDataFrame([(1, "Apple Inc"), (2, "General Motors"), (3, "Zed")], "account_id int, name string")
    tick = spark.createDataFrame([("AAPL", "APPLE INC."), ("GM", "General Motors Acceptance"), ("GMX", "General Motors Big Old Car Parts")], "ticker string, title string")
    assert {(r.account_id, r.ticker, r.method) for r in discovery.ticker_lookup(acc, tick).collect()} == {(1, "AAPL", "exact"), (2, "GM", "words")}


REPORT = """## Overview / 概况
**English:**
Fine text that holds a finding worth keeping for readers [1]. **Not enough evidence**
| Company | Role |
| --- | --- |
| Acme, Beta | maker |
**中文:**
见英文
## People / 人员
**English:**
**Not enough evidence**
| Name | Title | Source |
| --- | --- | --- |
| **Anna Berg** [2] | CEO | official |
| N/A | x | web |
"""


def test_reports(spark):
    df = spark.createDataFrame([(1, REPORT), (2, None), (3, "")], "id int, report string")
    lines = reports.lines(df, "id", "report")
    s = reports.sections(df, "id", "report").where("id = 1").orderBy("position").collect()
    assert [(r.position, r.title_en, r.title_zh) for r in s] == [(1, "Overview", "概况"), (2, "People", "人员")]
    f = {(r.section_no, r.reason) for r in reports.completeness(lines, "id", zh_needles=("见英文",), en_needles=("see chinese",)).collect()}
    assert f == {(1, "chinese_cross_reference"), (1, "missing_chinese_table"), (2, "missing_chinese_table")}
    zh = reports.in_language(lines.where("id = 1"), "id", "zh").first().text
    assert "Fine text" not in zh and "见英文" in zh and "## 概况" in zh
    cells = reports.table_cells(lines, "id", "people")
    p = reports.people_from_tables(cells, "id", "assistant").collect()
    assert [(r.name, r.title, r.source) for r in p] == [("Anna Berg", "CEO", "official")]
    d = [r.line for r in reports.displayed(lines.where("id = 1"), "id", missing="Not enough evidence", good=("Verified",), absence="not disclosed", note="Limited.").orderBy("line_no").collect()]
    assert "**Not enough evidence**" not in d and any(x.startswith("Fine text") for x in d)
    only = reports.lines(spark.createDataFrame([(1, "## A\n**English:**\n- **Not enough evidence**\n**中文:**\n内容在此")], "id int, report string"), "id", "report")
    assert [r.line for r in reports.displayed(only, "id", missing="Not enough evidence", good=("Verified",), absence="not disclosed", note="Limited.").orderBy("line_no").collect()] == ["## A", "**English:**", "Limited.", "**中文:**", "内容在此"]
    v = spark.createDataFrame([(1, "beta", False)], "id int, entry string, keep boolean")
    once = reports.corrected_cells(lines.where("id = 1"), "id", "overview", "company", v)
    fixed = [r for r in once.collect() if r.moved]
    assert [(r.line, r.moved) for r in fixed] == [("| Acme | maker |", ["Beta"])]
    assert not [r for r in reports.corrected_cells(once.select("id", "line_no", "line"), "id", "overview", "company", v).collect() if r.moved]


def test_tags_and_json(spark):
    df = spark.createDataFrame([(1, "a **[Verified]** b [likely] c **verified** d [3] plain")], "id int, t string")
    n = reports.tag_counts(df, "id", "t", (("v", "verified", "Verified / 已验证"), ("l", "likely", "Likely / 可能"))).first()
    assert (n.v, n.l, n.total) == (2, 1, 3)
    j = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('see {"b": 2} end', '{"b": 2}'), ("{oops", None), (None, None)], "t string, want string")
    assert j.where(~reports.json_answer(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_compaction(spark):
    a = "Acme runs a plant with 12 percent scrap and many lines. " * 4
    items = spark.createDataFrame([("Acme", 1, "Navigation menu of the page here. " + a), ("Acme", 2, a + "Something entirely different is told in this other sentence."), ("Acme", 3, "short"), ("Acme", 4, None), ("Acme", 5, "x" * 500)], "g string, seq long, text string")
    out = {r.seq: r for r in compaction.compacted_text(items, "g", account="g", words=("plant",), budget=F.lit(120)).collect()}
    assert all(len((r.text or "").encode()) <= 120 for r in out.values())
    assert "scrap" in out[1].text and out[2].repeats >= 1 and out[3].text == "short" and out[4].text is None and len(out[5].text) == 120
    rows = spark.createDataFrame([("g", i, 6 if i > 4 else 1, f"d{i % 3}", "t" * 1000) for i in range(10)], "g string, seq int, tier int, domain string, text string")
    got = compaction.fitted(rows, "g", available=3500, least=4).collect()
    assert sum(len(r.text) + 64 for r in got) <= 3500 and len(got) >= 4
    assert compaction.fit_stats(rows, compaction.fitted(rows, "g", available=3500), "g").first().items_before == 10


def test_rollups(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, m string")
    have = spark.createDataFrame([(1, "a"), (2, "a"), (2, "z")], "k int, m string")
    assert [r.k for r in rollups.covered(want, have, "k", "m").collect()] == [2]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 2, "y"), (1, 3, "x")], "g int, b int, i string")
    assert [(r.b, r.new_items, r.so_far, r.change) for r in rollups.marginal_yield(rows, "g", "b", "i").orderBy("b").collect()] == [(1, 1, 1, None), (2, 1, 2, 0), (3, 0, 2, -1)]
    lad = rollups.ladder(spark.createDataFrame([(1, "ir", "u1"), (1, "press", "u2")], "g int, k string, u string"), "g", "k", "u", (("first", ("ir",)), ("second", ("filing",)))).first()
    assert lad.first == ["u1"] and lad.first_used and lad.second == [] and not lad.second_used
    ex = rollups.existing_reports(spark.createDataFrame([(1, 2, 10, "m", 4), (1, 1, None, "n", 9)], "k int, version int, tokens int, model string, n_sources int"), "k").first()
    assert (ex.version, ex.tokens, ex.labels, ex.limited_sources) == (1, 10, "m, n", True)


def test_table_cells_beyond_a_hundred_columns(spark):
    rows = ["## People", "| " + " | ".join(f"h{i}" for i in range(130)) + " |", "|" + "---|" * 130, "| " + " | ".join(f"c{i}" for i in range(130)) + " |"]
    df = spark.createDataFrame([(1, "\n".join(rows))], "id int, report string")
    cells = reports.table_cells(reports.lines(df, "id", "report"), "id", "people").collect()
    assert len(cells) == 1 and cells[0].cells == {f"h{i}": f"c{i}" for i in range(130)}
