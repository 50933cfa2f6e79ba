"""The text operators: against brute force or libraries, on held-out data, and on odd inputs."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, encoding, encodings, labelled_pages, packing, residue, spans
from siltstone.llm.transducer import Transducer, compile_lexicon

CLASH = ("k", "n", "b", "t", "ids", "r", "h", "d", "p", "at", "word", "term", "part", "container_id", "v")


def odd(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def test_transducer():
    rnd = random.Random(1)
    words = {bytes(rnd.choice(b"abcd\xc3\xa9 ") for _ in range(rnd.randint(1, 7))): [rnd.randint(0, 9) for _ in range(rnd.randint(1, 3))] for _ in range(3000)}
    t = Transducer(compile_lexicon(words))
    ask = [*words, b"", b"zzz", b"abc" * 30, *(w + b"!" for w in list(words)[:50])]
    data = np.frombuffer(b"".join(ask), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in ask])
    rank = t.ranks(data, ends - [len(w) for w in ask], ends)
    for w, r in zip(ask, rank):
        assert (list(t.ids[t.starts[r] : t.starts[r + 1]]) if r >= 0 else None) == words.get(w)
    assert len(t.keys) < sum(map(len, words))
    suffixes = Transducer(compile_lexicon({b"a" + s: [1] for s in (b"ing", b"ed")} | {b"b" + s: [2] for s in (b"ing", b"ed")}))
    assert len(suffixes.final) == 1 + 1 + 3 + 1  # root, one node after a and b, i-n-g and e-d, one end
    empty = Transducer(compile_lexicon({}))
    assert list(empty.ranks(np.frombuffer(b"ab", dtype=np.uint8), np.array([0]), np.array([2]))) == [-1]


TEXTS = [
    "Hello world, it's 2024!", "", None, "  \n\t ", "<|endoftext|> is text", "数据处理，你好 123", "naïve Ωmega ﷽ 😀👍🏽", "a" * 30_000, "x y " * 20_000, "​­　 end  ", "don't we'll I'VE", "\r\n\r\n  tabs\t\tdone   ", "ᾷ Ω ﷽ \U0001f9ff \U00031350", "Hello world, it's 2024!",
]


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    df = odd(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    for words in (60_000, 5, 0):
        assert {r.doc_id: r.ids for r in encoding.encoded(df, "doc_id", "text", lexicon_words=words).collect()} == want
    n = {r.doc_id: r.n_tokens for r in encoding.encoded(df, "doc_id", "text", counts_only=True).collect()}
    assert n == {i: len(v) for i, v in want.items()}
    assert encoding.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_best_two_fit():
    rnd = random.Random(2)
    for cap in (10, 100, 2048):
        sizes = np.array([min(cap, int(rnd.paretovariate(1.2) * cap / 40)) for _ in range(800)])
        place = packing.best_two_fit(sizes, cap)
        load = np.bincount(place, weights=sizes)
        assert load.max() <= cap and load[:-3].mean() > 0.985 * cap
    assert list(packing.best_two_fit(np.array([6, 5, 4, 3]), 10)) == [0, 1, 0, 1]
    # greedy would leave a gap of 1 beside 6 and 3; 3 gives way to the two that fit exactly
    p = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert p[0] == p[2] == p[3] and len(packing.best_two_fit(np.array([], dtype=int), 5)) == 0


def test_packed(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 5, 2048, 2049, 6000, 4096, 100, 100, 1948])]
    df = odd(spark.createDataFrame(rows, "doc_id long, n_tokens long"))
    got = packing.packed(df, "doc_id", "n_tokens").collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.part, r.n_tokens))
    assert {d: sum(n for _, n in v) for d, v in per.items()} == {i: n or 0 for i, n in rows}
    assert sorted(per[5]) == [(0, 2048), (1, 2048), (2, 1904)] and len(per[6]) == 2 and len(per[3]) == 1 and len(per[0]) == 1
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048
    many = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 700 + 1).alias("n_tokens"))
    c = packing.packed(many, "doc_id", "n_tokens", bucket_docs=500).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    assert c.agg(F.max("n")).first()[0] <= 2048 and c.agg(F.avg("n")).first()[0] > 0.97 * 2048
    assert packing.packed(df.limit(0), "doc_id", "n_tokens").count() == 0


def brute_spans(docs, length):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    out = []
    for d, t in docs:
        marked = [False] * len(t or "")
        for i in range(len(t or "") - length + 1):
            if len(where[t[i : i + length]]) > 1:
                marked[i : i + length] = [True] * length
        i = 0
        while i < len(marked):
            if marked[i]:
                j = i
                while j < len(marked) and marked[j]:
                    j += 1
                out.append((d, i, j))
                i = j
            i += 1
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rand = lambda n: "".join(rnd.choice("abcde 中é😀") for _ in range(n))
    pieces = [rand(rnd.randint(15, 90)) for _ in range(12)]
    docs = []
    for d in range(60):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(pieces)
            a = rnd.randint(0, len(p) // 2)
            t += rand(rnd.randint(0, 40)) + (p[a:] if rnd.random() < 0.5 else p)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "short"), (103, pieces[0] * 4), (104, "q" * 300), (105, "q" * 19)]
    df = odd(spark.createDataFrame(docs, "doc_id long, text string")).repartition(7)
    got = sorted((r.doc_id, r.span_start, r.span_end) for r in spans.shared_spans(df, "doc_id", "text", length=20).collect())
    assert got == brute_spans(docs, 20) and got
    share = {r.doc_id: r for r in spans.shared_share(df, "doc_id", "text", length=20).collect()}
    assert len(share) == len(docs) and share[100].share is None and share[102].share == 0 and share[102].n_spans == 0
    assert spans.shared_spans(df.limit(0), "doc_id", "text").count() == 0


def test_spans_flush_and_hot_passage(spark, monkeypatch):
    passage = "".join(random.Random(5).choice("abcdefghij") for _ in range(260))
    docs = [(i, f"{i:05d}" * 30 + passage if i % 3 == 0 else f"{i * 7:05d}x" * 60) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.span_start, r.span_end) for r in spans.shared_spans(df, "doc_id", "text").collect()}
    assert {k for k, _ in docs if k % 3 == 0} <= set(got) and all(e - s >= 260 for k, (s, e) in got.items() if k % 3 == 0)


PAGES = [
    (1, "Menu\nLorem ipsum dolor sit amet tempor nisi velit.\nBack to top", True), (2, "Solutions\nYou must enable JavaScript to use this site.\nTerms", True), (3, "{{city}} was founded in {{year}} and makes wire harnesses for customers in {{street}}.", True),
    (4, "Das Werk in Adorf zeigte den Text \"Bitte aktivieren Sie JavaScript\", bis die Anlage 12 neu gestartet wurde.", False), (5, None, False), (6, "", False), (7, "Home\nPrivacy\nTerms", False), (8, "For the best experience please enable JavaScript.\nThe pump in hall 3 of Adorf ran 200 hours without a fault last spring.", False),
    (9, "502 Bad Gateway\nRequest id 9f8e7d6c5b4a", True), (10, " \n \n", False), (1, "Menu\nLorem ipsum dolor sit amet tempor nisi velit.\nBack to top", True), (11, "Pumps of Adorf reached 45 litres per shift behind hall seven. " * 8_000, False), (12, "页面加载失败，请稍后重试", True),
]
ERRS = [(1, "timeout", False), (2, "Error {{reason}}: the call to m failed", True), (3, "search tool returned HTML instead of JSON (12 bytes)", False), (4, None, False), (5, "", False), (6, "<html><head><title>Access denied</title></head><body>Access denied</body></html>", True), (7, "the prompt asks for JavaScript output, which m refuses", False), (8, "Lorem ipsum dolor sit amet", True)]


def page_tables(spark):
    pages = odd(spark.createDataFrame([(i, None, t) for i, t, _ in PAGES], "page_id long, title string, page_text string"))
    return pages, odd(spark.createDataFrame([(i, t) for i, t, _ in ERRS], "result_id long, err string"))


def test_residue(spark):
    pages, results = page_tables(spark)
    got = {(r.table_name, r.row_id) for r in residue.found(pages, results).collect()}
    assert got == {("fetched_pages", i) for i, _, w in PAGES if w} | {("gapfill_results", i) for i, _, w in ERRS if w}
    assert residue.found(pages.limit(0), results.limit(0)).count() == 0


def test_placeholders():
    for t in ("{{a b}}", "${x.y}", "%(n)s", "[[page.x]]", "<%= e %>", "__x__", "#{u}", "@@a.b@@", "«slogan»", "[Insert city here]", "<CITY>", "{ x }", "$price$", "%a%"):
        assert residue.terms(f"about {t} now") == ["about", "⁂", "now"], t
    assert "⁂" not in residue.terms("50% of 20% and a < b and c > d, [12], a[0]")
    assert residue.terms("<p>Incident 9f8e7d6c5b4a</p> on /srv/www/x.php") == ["incident", "idhex", "on"]


def test_page_model_on_held_out_pages():
    """Trained on one seed's pages, held against another's."""
    index = residue.Index({}, 0)
    model = boilerplate.train(index, 300)
    held = labelled_pages.compose(150, seed=99)
    lines = boilerplate.features(index, [t for t, _ in held], [[x for x, _ in ls] for _, ls in held])
    truth = np.array([held[p][1][i][1] for p, i in zip(lines.page, lines.at)])
    assert ((model.marginals(lines) >= 0.5) == truth).mean() > 0.97
    one = boilerplate.features(index, [None], [["", " "]])
    assert len(model.marginals(one)) == 0


def test_messages_against_enumeration():
    """Sum-product on a small tree gives the marginals that summing over all states gives."""
    rng = np.random.default_rng(3)
    model = boilerplate.Model(rng.normal(size=3), np.log(rng.dirichlet([1, 1], 2)), np.log(rng.dirichlet([1, 1], 2)), np.log(rng.dirichlet([1, 1])))
    x, block = rng.normal(size=(5, 3)), np.array([0, 0, 1, 1, 2])
    lines = boilerplate.Lines(np.array([0, 0, 0, 0, 1]), np.arange(5), x, block)
    got = model.marginals(lines)
    z = x @ model.line
    node = np.stack([-np.logaddexp(0, z), -np.logaddexp(0, -z)], axis=1)
    for page, mine, blocks in ((0, [0, 1, 2, 3], [0, 1]), (1, [4], [2])):
        total, on = 0.0, np.zeros(len(mine))
        for states in np.ndindex(*(2,) * (1 + len(blocks) + len(mine))):
            r, bs, ls = states[0], dict(zip(blocks, states[1:])), states[1 + len(blocks) :]
            e = model.page[r] + sum(model.page_block[r, s] for s in bs.values()) + sum(model.block_line[bs[block[i]], s] + node[i, s] for i, s in zip(mine, ls))
            total += np.exp(e)
            on += np.exp(e) * np.array(ls)
        assert np.allclose(got[mine], on / total)


def test_boilerplate(spark):
    page = "Home\nProducts\nContact\n\nBig plant opens in Adorf with 300 jobs\nThe plant in Adorf will make 400 pumps a day from spring on.\nRelated articles\nOther firm buys two mills near Bdorf\nPrivacy\n© 2024 Some Post. All rights reserved."
    pages = odd(spark.createDataFrame([(1, "Big plant opens in Adorf with 300 jobs | Some Post", page), (2, None, None), (3, "t", ""), (4, "x", "Lorem ipsum dolor sit amet.")], "page_id long, title string, page_text string"))
    _, results = page_tables(spark)
    assert {(r.page_id, r.line_no) for r in boilerplate.furniture_lines(pages, results).collect()} == {(1, n) for n in (0, 1, 2, 6, 7, 8, 9)}
    art = {r.page_id: r.article for r in boilerplate.articles(pages, results).collect()}
    assert art == {1: "\n".join(page.split("\n")[4:6]), 2: None, 3: None, 4: None}
    assert boilerplate.furniture_lines(pages.limit(0), results.limit(0)).count() == 0


NAMES = ["Götrovostal GmbH", "São Jorge Indústria", "Société Générale", "ООО «Прогресс Волга»", "天津华能电池有限公司", "株式会社カタリナ工業", "Łódź Społka", "Křižík s.r.o.", "Ålands Bank", "https://x.example/über-uns", "Größe – Straße", "ÃO Ramos", "FUNDAÇÃO Nova", "Øst ApS", "½ Inch Fittings", "Plain ASCII Ltd"]


def test_chains_round_trip():
    for steps in encodings.STEPS:
        for n in NAMES:
            g = encodings.garble(n, steps)
            if g and "�" not in g:
                assert encodings.invert(g, steps) in (n, None)
    assert encodings.invert("plain", encodings.STEPS[0]) is None


def test_encodings_on_held_out_values():
    model = encodings.train([*NAMES, *encodings._WORDS] * 3)
    other = ["Müller & Söhne KG", "Hernández y Compañía", "Фабрика Заря", "上海光明科技股份有限公司", "Çelik Üretim A.Ş.", "Žižkov stroje"]
    for n in other:
        assert model.judge(n)[0] == encodings.CLEAN, n
        for steps in ((("utf-8", "latin-1"),), (("utf-8", "cp1252"),), (("utf-8", "cp1251"),), (("utf-8", "cp437"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))):
            c, back = model.judge(encodings.garble(n, steps))
            assert c != encodings.CLEAN and back == n, (n, steps)
    assert model.judge("M�ller KG")[0] != encodings.CLEAN and model.judge("MÃ¼LLER".lower())[0] != encodings.CLEAN


FOREIGN = ["ТОВ Київський завод", "Підприємство Їжак", "Беларуськалій", "Ђорђевић и Љубић доо", "Կոնյակ", "한국전력공사", "göğüs", "Şişli Öğüt", "Ελληνικά Πετρέλαια", "שלום בעמ", "บริษัท ไทย", "شركة النفط", "საქართველო", "Việt Nam Điện lực", "Łódź Żółć", "हिन्दी", "Ωmega®", "Acme™ – Works"]


def test_letters_of_scripts_that_training_never_saw_are_no_case():
    """Held-out scripts: the sample has Western, Russian and Chinese values only."""
    model = encodings.train([*NAMES, *encodings._WORDS] * 3)
    wrong = [(w, model.judge(w)) for w in FOREIGN if model.judge(w)[0] != encodings.CLEAN]
    assert not wrong
    found = back = whole = 0
    for w in FOREIGN:
        for steps in ((("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1251"),)):
            g = encodings.garble(w, steps)
            if g:
                c, b = model.judge(g)
                whole += 1
                found += c != encodings.CLEAN
                back += b == w
                assert b in (None, w), (w, steps, b)
    assert found >= 0.9 * whole and back >= 0.85 * whole


def test_encodings(spark):
    bad = [encodings.garble(n, (("utf-8", "cp1252"),)) for n in NAMES[:6]]
    rows = [(i, n, None) for i, n in enumerate(NAMES)] + [(100 + i, b, "") for i, b in enumerate(bad)] + [(200, None, "http://x.example/Ã¼ber"), (201, "Müller Söhne " * 3_000, None), (100, bad[0], "")]
    df = odd(spark.createDataFrame(rows, "item_id long, company string, website string"))
    got = {(r.item_id, r.field_name): r.original for r in encodings.judged(df, "item_id", ["company", "website"]).collect()}
    assert set(got) == {(100 + i, "company") for i in range(6)} | {(200, "website")}
    assert [got[(100 + i, "company")] for i in range(6)] == NAMES[:6] and got[(200, "website")] == "http://x.example/über"
    assert encodings.found(df.limit(0)).count() == 0


def test_nothing_else_is_loaded():
    assert "siltstone.llm" in sys.modules
