"""The record operators: against brute force, and on odd inputs (nulls, empty and long texts, repeats,
empty tables, extra columns whose names clash with inner ones)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import entity_linkage, formatting_copies, name_variants, names, reference_list

CLASH = ("id", "h", "g", "k", "n", "maybe", "first_id", "node", "key", "kind", "w", "value", "raw", "field_name", "x", "y", "s", "title_list")


def odd(df):
    """The table with columns of clashing names."""
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


URL = "https://a-site.example/x/y_z?id=5&lang=de"
SAME = [
    (URL, "A plan: 1.5 percent | Press | The Site"), (URL.upper(), "a plan 1.5 PERCENT — The Site — Press"), ("<" + URL + ">", "«A plan: 1.5 percent»  |  Press | The　Site..."),
    ("https://a-site.example//x/y-z/?lang=de;id=5,", "A plan : 1.5 percent • Press • The Site"), (" " + URL + "\n", "A plan: 1.5 percent|Press|The Site"),
]
OTHER = [(URL, "A plan: 15 percent | Press | The Site"), (URL + "&p=1", SAME[0][1]), (URL.replace("y_z", "yz"), SAME[0][1]), (URL, None), (URL, ""), (None, None)]


def test_formatting_copies(spark):
    rows = [(i, u, t) for i, (u, t) in enumerate(SAME + OTHER)] + [(0, *SAME[0]), (99, "https://b.example/德国 车", "勤福 慧联：395.3秒"), (98, "https://b.example/德国车", "勤福慧联395.3秒")]
    df = odd(spark.createDataFrame(rows, "source_id long, url string, title string"))
    got = {(r.first_id, r.copy_id) for r in formatting_copies.source_copies(df).collect()}
    assert got == {(0, i) for i in range(1, 5)} | {(8, 9), (98, 99)}
    rec = {r.source_id: r.n_copies for r in formatting_copies.source_records(df).collect()}
    assert rec == {0: 5, 5: 1, 6: 1, 7: 1, 8: 2, 10: 1, 98: 2}
    assert formatting_copies.source_copies(df.limit(0)).count() == 0 and formatting_copies.source_records(df.limit(0)).count() == 0


def test_formatting_copies_with_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("source_id"), F.when(F.col("id") % 3 == 0, "https://hot.example").otherwise(F.concat(F.lit("https://x.example/"), (F.col("id") % 1500).cast("string"))).alias("url"), F.lit("t").alias("title"))
    got = formatting_copies.source_copies(df).groupBy("first_id").count().collect()
    assert {r.first_id: r["count"] for r in got}[0] == 1999
    want = df.groupBy("url").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1)).first()[0]
    assert sum(r["count"] for r in got) == want


TRADES = "automation batteries battery building castings cells cellworks components controls drive electrodes electronics energy engineering equipment laser machine mobility modules motion power powertrain robotics software storage surface systems technology thermal".split()
VOCABULARY = names.Vocabulary("anna daniel nadia henrike katherine kenji magdalena martin martina michael oskar renee samuel sigrid thomas william yelena zoe".split(), TRADES, [("electronics", "power")])


@pytest.mark.parametrize("name,want", [
    ("Berg, Anna", ("anna", "berg")), ("Prof. Dr. Sam O. Vugrad jr.", ("samuel", "vugrad")), ("K. Lund", ("k", "lund")), ("Lund Kenji", ("kenji", "lund")), ("RENÉE GLAGÅRD (she/her)", ("renee", "glagard")),
    ("Wilkiam Terej", ("william", "terej")), ("", ("", "")), (None, ("", "")), ("Anna", ("", "anna")), ("Bischit,D.", ("d", "bischit")), ("Zoë Bim, MBA", ("zoe", "bim")), ("Lena Moe", ("lena", "moe")),
])
def test_person(name, want):
    assert VOCABULARY.person(name) == want


@pytest.mark.parametrize("firm,city,want", [
    ("Stolostule Therm. Syst. O.O.O.", None, ("stolostule", "systems thermal", "llc", "")), ("AB Skoreputru Cells and Modules (Nordvåla)", None, ("skoreputru", "cells modules", "ab", "nordvala")),
    ("TrovumezaDrive Technology", "Bo", ("trovumeza", "drive technology", "", "bo")), ("Brugaskuna, Wexcombe", None, ("brugaskuna", "", "", "wexcombe")), ("Göbä Power Elec. GmbH & Co. KG (GPE)", None, ("goba", "electronics power", "co gmbh kg", "")),
    ("hegitabrelelectrodes", None, ("hegitabrel", "electrodes", "", "")), ("Suske mukran Batt. Ltd", None, ("suskemukran", "battery", "ltd", "")), ("Zeta Eqpt Ctrls Sp. zoo", None, ("zeta", "controls equipment", "spzoo", "")), (None, None, ("", "", "", "")), ("GmbH", None, ("", "", "gmbh", "")), ("Zova sw Inc", None, ("zova", "software", "inc", "")),
])
def test_firm(firm, city, want):
    assert VOCABULARY.firm(firm, city) == want


def test_same_given():
    same = VOCABULARY.same_given
    assert same("lena", "magdalena") and same("lena", "yelena") and same("anna", "anna") and same("frieda", "friedaa") and not same("martin", "martina") and same("m", "martin") is None and same("", "x") is None and same("k", "martin") is False


def test_vocabulary_is_learned_from_the_table(spark):
    """Words beside many others are learned, whatever they are; words of cities and of one firm are not."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(("ba", "kri", "so", "tre", "mu", "lan", "fi", "gos")) for _ in range(4)).capitalize()
    rows = [(f"{word()} {rnd.choice(('Fishery', 'Bakery', 'Print Works'))} Ltd, Porto Alegre", f"{rnd.choice(('Aiko', 'Bronwen'))} {word()}", "Porto Alegre") for _ in range(200)]
    rows += [(f"Hotfirm Fishery {i} Ltd", f"Bronwen {word()}", None) for i in range(100)] + [(None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "company string, name string, city string")
    v = names.learn(df, df)
    assert set(v.trades) == {"fishery", "bakery", "print", "works"} and v.names == {"aiko", "bronwen"} and {frozenset(("print", "works"))} <= v.together
    assert names.learn(df.limit(0), df.limit(0)).trades == ()


def test_edits_against_plain():
    assert names.edits("abcd", "abdc") == 1 and names.edits("abcd", "xbcd") == 1 and names.edits("", "ab") == 2 and names.edits("a" * 500, "a" * 499) == 1 and names.edits("a" * 500, "a" * 400) == 4


TITLES = [(1, "Chief Executive Officer"), (2, "Director of Quality"), (3, "Plant Manager"), (4, "Buyer"), (5, "Project Manager")]


def lists(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in TITLES], "ref_id long, title string, department string"), spark.createDataFrame([(1, "Executive Board"), (2, "Finance"), (3, "Technology")], "ref_id long, department string")


def test_reference_list(spark):
    cases = [
        ("Chief Executive Officer", 1), ("CEO", 1), ("c.e.o. (interim)", 1), ("chief executve off.", 1), ("* Mr. Quality Dir. - Asia", 2), ("Dir of Qlty, Plant North", 2), ("Manager, Plant", 3), ("plant_manger @ HQ", 3), ("bueyr", 4), ("Buyer | Cells BU", 4),
        ("proj. mgr / site 2", 5), ("首席执行官（兼）", 1), ("Assistant to the CEO", 0), ("PA of the Plant Manager", 0), ("Secretary of the plant manager", 0), ("beekeeper", 0), ("x", 0), ("—", 0), ("y" * 5000, 0), ("Acting Plant Mangaer", 3),
    ]
    rows = [(i, t, None) for i, (t, _) in enumerate(cases)] + [(100, None, "finnace dept."), (101, "", "  "), (102, None, "财务部 (HQ)"), (103, None, "Choir"), (0, cases[0][0], None)]
    df = odd(spark.createDataFrame(rows, "crm_contact_id long, title string, department string"))
    t, d = lists(spark)
    got = {(r.crm_contact_id, r.field_name): r.ref_id for r in reference_list.mapped(df, t, d).collect()}
    want = {(i, "title"): e for i, (_, e) in enumerate(cases)} | {(100, "department"): 2, (102, "department"): 2, (103, "department"): 0}
    assert got == want
    assert reference_list.mapped(df.limit(0), t, d).count() == 0
    rep = {(r.field_name, r.value): r.n_rows for r in reference_list.unmatched_report(df, t, d).collect()}
    assert rep[("title", "beekeeper")] == 1 and ("title", "CEO") not in rep


def test_another_list_gives_its_own_ids_only(spark):
    """Wordings go with the text of an entry: nothing maps to an id that is not in the list, or that stands at a place."""
    t = spark.createDataFrame([(1, "Plumber"), (2, "Night Porter"), (71, "Head of Quality"), (72, "Chief Marketing Officer"), (None, "Buyer"), (73, None)], "ref_id long, title string")
    d = spark.createDataFrame([(1, "Choir"), (9, "Marketing")], "ref_id long, department string")
    long = "Keeper of " + "very " * 40 + "old clocks"
    t = t.unionByName(spark.createDataFrame([(74, long)], t.schema))
    want = {"CEO": 0, "采购员": 0, "Werkleiter": 0, "Buyer": 0, "plumbr": 1, "Porter, Night": 2, "Qualitätsleiterin": 71, "质量主管": 71, "CMO": 72, "首席市场官": 72, "Qlty Head": 71, long: 74, long.replace("old", "odl"): 74}
    rows = [(i, v, None) for i, v in enumerate(want)] + [(50, None, "Finanzen"), (51, None, "Mktg dept."), (52, None, "市场部")]
    got = {(r.crm_contact_id, r.field_name): r.ref_id for r in reference_list.mapped(spark.createDataFrame(rows, "crm_contact_id long, title string, department string"), t, d, hot=1).collect()}
    assert got == {(i, "title"): e for i, e in enumerate(want.values())} | {(50, "department"): 0, (51, "department"): 9, (52, "department"): 9}
    assert {r.ref_id for r in reference_list.mapped(spark.createDataFrame(rows, "crm_contact_id long, title string, department string"), t.limit(0), d.limit(0)).collect()} == {0}
    mine = reference_list.mapped(spark.createDataFrame([(1, "Rohrleger", None)], "crm_contact_id long, title string, department string"), t, d, title_words={"plumber": "rohrleger"})
    assert mine.first().ref_id == 1


def test_pigeonhole_finds_all_near_strings(spark):
    """Every value within k edits of a wording is found: against all pairs."""
    rnd = random.Random(5)
    forms = reference_list.wordings(*lists(spark)).cache()
    values = set()
    for f in rnd.sample(sorted(forms.collect(), key=str), 25):
        for _ in range(12):
            w = list(f.form)
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(w) + 1)
                op = rnd.randint(0, 2)
                w[i : i + (op > 0)] = [] if op == 1 else rnd.choice("abcdeimnrst ")
            values.add((f.field_name, "".join(w)))
    asked = spark.createDataFrame(sorted(values), "field_name string, value string")
    got = {(r.field_name, r.value) for r in reference_list.nearest(asked, forms).collect()}
    pairs = asked.join(forms.withColumnRenamed("field_name", "f"), F.col("field_name") == F.col("f")).withColumn("d", F.levenshtein("value", "form"))
    ok = pairs.where("d = 0 or (length(form) >= 5 and not form rlike '[一-鿿]' and (d = 1 or (d = 2 and (length(form) >= 9 or array_sort(split(value, '')) = array_sort(split(form, '')))) or (d = 3 and length(form) >= 13 and size(split(value, ' ')) = size(split(form, ' ')))))")
    ok = ok.where("d <= k and not (value rlike '^(pa|assistant|secretary|office|trainee|driver|chauffeur|sekretariat) ')")
    assert got == {(r.field_name, r.value) for r in ok.select("field_name", "value").distinct().collect()}


VARIANTS = [
    (1, "Bedrabramos Electrodes Inc.", None, None, "c1"), (2, "BEDRABRAMOS ELECTROD. INC., Kukrumouth", None, None, "c1"), (3, "Electrodes Bedrabbramos Incorporated", None, "Kukrumouth", "c1"), (4, "Bedrabramos Inc.", None, "Kukrumouth", "c1"), (5, "Bedrabramos Cells and Modules GmbH", None, "Oberdorf", "c2"),
    (6, "Fikrudahal Mobility AB", "Martin Dagloniak", None, "n1"), (7, "Fikrudåhal Mobility Aktiebolag", "Dr. Dagloniak, Martin", None, "n1"), (8, "Fikrudahal Mobility AB", "Martina Dagloniak", None, "n2"), (9, "Otherfirm Mobility AB", "Martin Dagloniak", None, "n3"), (10, "Fikrudahal AB", "M. Daglonaik", None, "n1?"),
    (11, None, None, None, "-"), (12, "", "", None, "e"), (13, "GmbH", None, None, "f"), (14, "z" * 3000, None, None, "z"), (1, "Bedrabramos Electrodes Inc.", None, None, "c1"),
]


def test_name_variants(spark):
    more = [(100 + i, f"{a}{b} Robotics Ltd", None, None, "") for i, (a, b) in enumerate((x, y) for x in ("Kobri", "Zuma", "Stela", "Prado") for y in ("letun", "sokar", "mifan"))]
    df = odd(spark.createDataFrame([r[:4] for r in VARIANTS + more], "upload_row_id long, company string, name string, city string"))
    for most in (1_000_000, 0):
        rows = name_variants.groups(df, vocabulary=VOCABULARY, threshold=0.55, most=max(1, most))
        g = {r.upload_row_id: r.group_id for r in rows.collect()}
        assert g[1] == g[2] == g[3] == g[4] and g[5] not in (g[1],) and g[6] == g[7] and len({g[6], g[8], g[9]}) == 3
        assert len({g[100 + i] for i in range(12)}) == 12 and len(g) == len({r[0] for r in VARIANTS + more if r[1] is not None or r[2] is not None})
    got = {(r.field_name, r.row_a, r.row_b) for r in name_variants.pairs(df, vocabulary=VOCABULARY, threshold=0.55).collect()}
    assert all(a < b for _, a, b in got) and not any(p[1] >= 100 for p in got)
    assert name_variants.pairs(df.limit(0)).count() == 0


def test_short_words_are_linked(spark):
    """Words of two to four letters have vectors too."""
    rows = [(1, "Kaz Laser AG", None, "Oberdorf"), (2, "Kazz Laser AG", None, "Oberdorf"), (3, "Zeta Mobility AB", "Anna Li", None), (4, "Zeta Mobility AB", "Anna Lii", None), (5, "Zeta Mobility AB", "Anna Wu", None)]
    g = {r.upload_row_id: r.group_id for r in name_variants.groups(spark.createDataFrame(rows, "upload_row_id long, company string, name string, city string"), vocabulary=VOCABULARY).collect()}
    assert g[1] == g[2] and g[3] == g[4] != g[5]


def test_many_spellings_of_one_firm(spark):
    """A firm of three hundred misspellings is one group, whose members need not all be alike."""
    rnd = random.Random(12)
    forms = set()
    while len(forms) < 300:
        w = list("bedrabramoskitur")
        i = rnd.randrange(1, len(w) - 1)
        w[i : i + 1] = rnd.choice(([], [w[i], w[i]], [rnd.choice("abcdefghik")]))
        forms.add("".join(w).capitalize() + rnd.choice((" Electrodes Inc.", " Electrodes", " Electrodes Incorporated", " Electrodes, Oberdorf")))
    rows = [(i, f, None, None) for i, f in enumerate(sorted(forms))] + [(1000 + i, "Bedrabramoskitur Electrodes Inc.", None, None) for i in range(700)] + [(5000, "Bedrabramoskitur Laser GmbH", None, "Nordheim"), (5001, "Bedrabramoskitr Laser GmbH", None, "Nordheim")]
    df = spark.createDataFrame(rows, "upload_row_id long, company string, name string, city string")
    whole = {r.upload_row_id: r.group_id for r in name_variants.groups(df, vocabulary=VOCABULARY).collect()}
    assert len({whole[i] for i in range(300)}) == 1 and whole[5000] == whole[5001] != whole[0]


def test_similar_words_against_all_pairs(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice(("ba", "kri", "so", "tre", "mu", "lan", "fi")) for _ in range(4)) for _ in range(60)]
    words = set(base) | {"li", "lii", "abc", "abd", "x", "", "q" * 200}
    for w in base:
        i = rnd.randrange(1, len(w) - 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]}
    words -= {""}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    vectors = name_variants.vectors_of(df)
    n = {}
    for w in words:
        for g in name_variants.grams(w):
            n[g] = n.get(g, 0) + 1
    weight = {g: np.log(1 + min(len(words) / c, 500)) for g, c in n.items()}
    norm = {w: np.sqrt(sum(weight[g] for g in name_variants.grams(w))) for w in words}
    want = set()
    for a in words:
        for b in words:
            shared = set(name_variants.grams(a)) & set(name_variants.grams(b))
            if sum(weight[g] for g in shared) / (norm[a] * norm[b]) >= 0.42:
                want.add((a, b))
    got = [(r.a, r.b) for r in name_variants.similar_words(df, vectors).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got) & want) >= 0.99 * len(want)


def _shuffled_rows(spark) -> int:
    """Rows written to shuffles by this session so far."""
    jvm, store = spark.sparkContext._gateway.jvm, spark.sparkContext._jsc.sc()
    store.listenerBus().waitUntilEmpty(30_000)
    stages = store.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_similar_words_are_no_rows_before_they_are_near(spark):
    """Words of few syllables share n-grams with most others: what is shuffled grows with the words, and no near pair is missed."""
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice(("bat", "krim", "sok", "tref", "mul", "lan", "fin", "dep")) for _ in range(4)) for _ in range(500)} | {"li", "lii", "kaé", "kae", "x"})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    vectors = name_variants.vectors_of(df)
    want = {(a, b) for a in words for b in words if vectors.cosine(a, b) >= 0.42}
    before = _shuffled_rows(spark)
    got = [(r.a, r.b) for r in name_variants.similar_words(df, vectors).collect()]
    assert _shuffled_rows(spark) - before <= 5 * len(words)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3 * len(words)
    parted = [(r.a, r.b) for r in name_variants.similar_words(df, vectors, block=100).collect()]
    assert len(parted) == len(got) and set(parted) == want
    assert name_variants.similar_words(df.limit(0), vectors).count() == 0


def test_average_linkage():
    """Against one merge at a time over the full matrix."""
    rnd = np.random.default_rng(3)
    for n in (2, 5, 30):
        s = np.triu(rnd.random((n, n)) * (rnd.random((n, n)) < 0.5), 1)
        x, y = np.nonzero(s)
        got = name_variants.average_linkage(x * 10, y * 10, s[x, y], np.ones(len(x)), np.ones(len(x)), 0.5)
        clusters = [[i] for i in range(n)]
        full = s + s.T
        while len(clusters) > 1:
            m, i, j = max((full[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
            if m < 0.5:
                break
            clusters[i] += clusters.pop(j)
        assert {frozenset(v * 10 for v in c) for c in clusters if len(c) > 1} == {f for f in (frozenset(k for k, g in got.items() if g == h) for h in set(got.values())) if len(f) > 1}
    assert name_variants.average_linkage(np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0), np.empty(0)) == {}


def test_linkage(spark):
    crm = [
        (1, "Anna Berg", "CEO", "a.berg@acme.example", "https://l.example/in/anna-berg-1", "Acme Robotics GmbH"), (2, "Berg, Anna", None, None, None, "Acme Robotics"), (3, "Oskar Lund", "Buyer", "info@zeta.example", None, "Zeta Mobility AB"), (4, None, None, None, None, None), (5, "", "", "", "", ""), (6, "Kenji Sol", None, None, "https://l.example/in/kenji-sol", "Old Mobility AB"), (7, "Q" * 2000, None, None, None, "x"), (8, "Kenji Berg", None, "berg@acme.example", None, "Acme Robotics GmbH"),
        (1, "Anna Berg", "CEO", "a.berg@acme.example", "https://l.example/in/anna-berg-1", "Acme Robotics GmbH"),
    ]
    ppl = [
        (10, "A. Berg", "Chief Executive", "mailto:A.Berg@mail.acme.example", None, "Acme Robotics GmbH"), (11, "Ana Berg", None, None, None, "Acme Robotics GmbH"), (12, "Thomas Berg", None, "t.berg@acme.example", None, "Acme Robotics GmbH"), (13, "Oskar Lund", None, "info@zeta.example", None, "Other Laser Inc"), (14, "Sigrid Moe", None, "info@zeta.example", None, "Zeta Mobility AB"),
        (18, "Zoë Berg", None, "berg@acme.example", None, "Acme Robotics GmbH"), (15, "K. Sol", None, None, "http://www.l.example/in/kenji-sol/?x=1", "New Laser Inc"), (16, "Kenji Sol", None, None, None, "New Laser Inc"), (17, None, None, None, "https://l.example/company/acme", None),
    ]
    schema = "title string, email string, linkedin_url string"
    c = odd(spark.createDataFrame(crm, f"crm_contact_id long, name string, {schema}, company string"))
    p = odd(spark.createDataFrame(ppl, f"person_id long, name string, {schema}, organization_name string"))
    got = {(r.crm_contact_id, r.person_id): r.confidence for r in entity_linkage.linked(c, p, VOCABULARY).collect()}
    assert set(got) == {(1, 10), (2, 10), (1, 11), (2, 11), (6, 15), (6, 16)}
    assert all(0.6 < v < 1 for v in got.values()) and got[(6, 16)] < got[(6, 15)]
    assert entity_linkage.linked(c.limit(0), p).count() == 0 and entity_linkage.linked(c, p.limit(0)).count() == 0


def test_crowded_mailbox(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice(("ba", "kri", "so", "tre", "mu", "lan", "fi", "gos", "pel", "dru")) for _ in range(n)).capitalize()
    rows = [(i, f"{word(3)} {word(5)}", None, "all@one.example", None, f"{word(5)} Laser Inc") for i in range(300)]
    schema = "title string, email string, linkedin_url string"
    c = spark.createDataFrame(rows, f"crm_contact_id long, name string, {schema}, company string")
    p = spark.createDataFrame(rows[:5], f"person_id long, name string, {schema}, organization_name string")
    assert {(r.crm_contact_id, r.person_id) for r in entity_linkage.linked(c, p, VOCABULARY).collect()} == {(i, i) for i in range(5)}


def test_crowded_profile_and_mailbox_keep_their_person(spark):
    """Rows that meet by a crowded key alone are linked: another firm, no firm, no last name, slips in the last name."""
    schema = "title string, email string, linkedin_url string"
    url = "https://l.example/in/anna-berg"
    rows = [(i, "Anna Berglund", f"Title {i}", None, url, "Acme Robotics GmbH") for i in range(120)] + [(200 + i, "Oskar Vugradsen", f"Title {i}", "all@one.example", None, "Zeta Laser Inc") for i in range(120)]
    c = spark.createDataFrame(rows, f"crm_contact_id long, name string, {schema}, company string")
    ppl = [(1, "A. Beglnd", None, None, url, "Otherfirm Mobility AB"), (2, "Anna Moe", None, None, url, None), (3, None, None, None, url, None), (4, "Oskar Vugradsn", None, "all@one.example", None, None), (5, "O.", None, "all@one.example", None, None), (6, "Sigrid Vugradsen", None, "all@one.example", None, "Zeta Laser Inc"), (7, "Nadia Terej", None, "all@one.example", None, None)]
    p = spark.createDataFrame(ppl, f"person_id long, name string, {schema}, organization_name string")
    got = {(r.crm_contact_id, r.person_id) for r in entity_linkage.linked(c, p, VOCABULARY).collect()}
    assert got == {(i, n) for i in range(120) for n in (1, 2, 3)} | {(200 + i, n) for i in range(120) for n in (4, 5)}


def test_near_words_against_all_pairs(spark):
    rnd = random.Random(6)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(150)} | {"x" * 80, "x" * 79, "x" * 81, "bacd", "badc"} | {"".join("abcdefghij"[(i * 7 + i // 9) % 10] for i in range(n)) for n in (37, 38, 39, 40, 41, 42, 43, 44)}
    long = "".join("abcdefghijklmnop"[(i * 5 + i // 7) % 16] for i in range(60))
    words |= {long, long[:11] + long[12] + long[11] + long[13:23] + long[24] + long[23] + long[25:], long[2:], "zz" + long, long[:30] + "q" + long[31:]}
    got = [(r.a, r.b) for r in entity_linkage.near_words(spark.createDataFrame([(w,) for w in sorted(words)], "w string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if names.edits(a, b) <= 2}


def test_slips_in_both_name_and_firm(spark):
    schema = "title string, email string, linkedin_url string"
    crm = [(1, "Oskar Degrunaenko", None, None, None, "Nepugusx Test Equipment AB"), (2, "Anna Terejavel", None, None, None, "Soskayresil Laser Inc"), (3, "Oskar Lund", None, None, None, "Zeta Mobility AB")]
    ppl = [(1, "Oskar J. Degrunanko", None, None, None, "Nepugusåx Test Equipment AB"), (2, "Anna Terjavle", None, None, None, "Soskayrsli Laser Inc"), (3, "Oskar Berg", None, None, None, "Zeta Mobility AB"), (4, "Oskar Lund", None, None, None, "Kobriletun Mobility AB")]
    c = spark.createDataFrame(crm, f"crm_contact_id long, name string, {schema}, company string")
    p = spark.createDataFrame(ppl, f"person_id long, name string, {schema}, organization_name string")
    assert {(r.crm_contact_id, r.person_id) for r in entity_linkage.linked(c, p, VOCABULARY).collect()} == {(1, 1), (2, 2)}


def test_weak_edge_beside_strong_ones_is_kept(spark):
    """Two spellings of a person, each with a mailbox of its own: name and firm link them though each has much stronger edges."""
    schema = "title string, email string, linkedin_url string"
    url = "https://l.example/in/anna-berglund"
    other = [(10 + i, f"Oskar {a}{b}sen", None, None, None, f"{b}{a}lin Laser Inc") for i, (a, b) in enumerate((x, y) for x in ("Kriba", "Mulan", "Drufi", "Tresos", "Pelgo", "Zufar") for y in ("gosti", "ranep", "vuhol", "jimet", "xedua", "cwiny"))]
    crm = [(1, "Anna Berglund", None, "anna@acme.example", url, "Acme Robotics GmbH"), (2, "Anna Berglnd", None, "ab@mail.example", None, "Acme Robotics GmbH"), *other]
    ppl = [(1, "Anna Berglund", "Head", "anna@acme.example", url, "Acme Robotics GmbH"), (2, "Anna Berglnd", "Head", "ab@mail.example", None, "Acme Robotics GmbH")]
    c = spark.createDataFrame(crm, f"crm_contact_id long, name string, {schema}, company string")
    p = spark.createDataFrame(ppl, f"person_id long, name string, {schema}, organization_name string")
    assert {(r.crm_contact_id, r.person_id) for r in entity_linkage.linked(c, p, VOCABULARY).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
