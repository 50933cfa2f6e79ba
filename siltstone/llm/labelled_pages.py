"""Labelled pages for training: composed by a seeded rule from wordings of furniture and of articles.

Each page is a list of (line, is_article) with a title. The sentences, headings and orders are invented;
single words of menus ("Home", "Kontakt") are what such menus say everywhere and stand in tables, too.
What furniture says is known to the model by its exemplars (``exemplars``), which were written with the
kinds of furniture in view that the tables show; the README has the recall on kinds held out.
"""

from __future__ import annotations

import random

from siltstone.llm import exemplars

_SYLLABLES = "ba de ki lo mu na pe ri so tu va ze gro bli stra fen dor mil kar tho".split()
_THINGS = "pump sensor frame drill press oven cable motor valve panel tray gate mixer hopper".split()
_WORK = "Milling,Wet coating,Cold rolling,Bonding,Seal check,Drying,Line trials,Spot welding,Kitting,Balancing,Fräsen,Verguss,Prüffeld,Beschriftung".split(",")
_WORK_ZH = "铣削 清洗 装配 涂胶 老化 包装 检验 焊接测试 电机装配".split()
_ZH = "东北南西金海云泰华新安平和光荣达力正凯宏"
#: Lines of menus and the like, as they stand alone.
_MENU = {
    "en": "Home,Menu,Search,Contact,About us,News,Events,Products,Solutions,Services,Support,Careers,Blog,Log in,My account,Cart (0),Shop,Industries,Downloads,Locations",
    "de": "Startseite,Menü,Suche,Kontakt,Über uns,Produkte,Lösungen,Leistungen,Branchen,Karriere,Presse,Anmelden,Warenkorb,Standorte",
    "zh": "首页,登录,注册,关于我们,联系我们,产品中心,解决方案,新闻动态,服务支持,加入我们,投资者关系,网站地图",
}
_COOKIE = {
    "en": ("Our shop sets cookies. Fine by me", "{s} and its helpers read small files on this computer to learn which pages people like. Agree", "Stay on these pages and cookies will be stored. Allow every cookie"),
    "de": ("Wir nutzen Cookies für die Statistik. Einverstanden", "{s} speichert kleine Dateien, damit der Besuch bequemer wird. Auswahl ändern"),
    "zh": ("我们使用Cookie统计访问量。知道了", "如果您不关闭此提示，则视为接受Cookie。全部允许"),
}
_INSERT = {
    "en": (("Our monthly letter", "Your mail address", "Subscribe now"), ("Ask for an offer today, our team calls back tomorrow.",), ("Let {s} send you the news of the month by mail.",)),
    "de": (("Unser Rundbrief", "Mailadresse eintragen", "Anmelden"), ("Hier ein unverbindliches Angebot bestellen",)),
    "zh": (("欢迎订阅月报", "填写您的邮箱", "订阅"), ("马上获取报价",)),
}
_SHARE = {
    "en": ("Tell a friend", "Share by mail", "Print page", "Save for later", "Write a comment", "7 comments so far", "Hear the story"),
    "de": ("Beitrag weiterleiten", "Seite ausdrucken", "3 Kommentare"),
    "zh": ("转发给好友", "打印本页", "加入收藏", "评论 3"),
}
_FOOT = {
    "en": ("Top of page", "All pages", "Imprint", "Data protection", "Conditions", "© {s} 2021, every right reserved", "Call +00 765 4321", "{s} Ltd, 9 Mill Lane, {n}", "Site by people from {n}", "Find {s} on video and photo feeds", "{s} belongs to the trade association of {n}. What is said here about coming years may turn out otherwise."),
    "de": ("Zum Seitenanfang", "Impressum", "Datenschutzerklärung", "Geschäftsbedingungen", "© {s} 2021, alle Rechte liegen beim Verlag", "Tel. +00 765 4321", "{s} GmbH, Mühlweg 9, {n}", "{s} in den Netzwerken"),
    "zh": ("网安备 7654321号", "© 2021 {z}股份 保留一切权利", "扫码关注我们", "公司地址：{z}路9号", "客服热线：00-7654321", "使用条款 | 隐私声明"),
}
_SUB = {"en": ("Notes on {n}", "Numbers for May 2023", "Prospects until 2028", "What {n} Works expects"), "de": ("Werte aus {n}", "Blick auf 2028", "Was {n} Maschinen erwartet"), "zh": ("{z}工程情况", "2027年前景")}
_HEAD = {
    "en": ("{n} Works takes over {n} Tools for 25 million", "{t} plant in {n} opens with 410 new posts", "Report 2024 by {n} Drives, sheet 12", "Why {n} Systems left {n} for good"),
    "de": ("{n} Maschinen eröffnet Werk für Pumpen in {n}", "{n}: 310 Plätze bei {n} Technik frei"),
    "zh": ("{z}科技与{z}电子共同研制新型电机", "{z}机械推出新型设备：用时31.5秒", "2023年{z}阀门项目采购公告（第512号）"),
}
_SENTENCE = {
    "en": ("The {t} of {n} Works in {n} passed {d} hours and lost {d} percent of its load.", "{n} Tools Ltd. plans {d} posts near {n}, most of them for the new {t} line.", "With the second {t} in hall {d}, output at {n} grew to {d} pieces a shift.", "A council near {n} let {n} Drives use plot {d} for a {t} works until 2029."),
    "de": ("Das Werk von {n} Maschinen in {n} lieferte {d} Stück bei {d} Grad und {d} Prozent Ausschuss.", "Laut {n} Technik GmbH lief die Anlage {d} in {n} rund {d} Stunden ohne Halt.", "In {n} baut {n} Systeme eine Halle mit {d} Plätzen für die neue Linie."),
    "zh": ("{z}科技在{z}建成{d}平方米车间，用于电机装配与检验。", "{z}机械全年交付{d}台设备，每台用时{d}秒，良率为{d}%。", "据{z}电子介绍，{z}工厂每周生产{d}套阀门。"),
}


def _piece(r: random.Random, lang: str) -> str:
    """A line of a kind of furniture: some words in a row of its exemplar."""
    own = [x for x in exemplars.FURNITURE if any("一" <= c <= "鿿" for c in x) == (lang == "zh")]
    words = r.choice(own).split()
    at = r.randrange(len(words))
    return " ".join(words[at : at + r.randint(1, 9)]).replace(" 0", " 12").capitalize()


def compose(pages: int = 500, seed: int = 11) -> list[tuple[str, list[tuple[str, bool]]]]:
    """``pages`` labelled pages: (title, lines)."""
    r = random.Random(seed)

    def name() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4))).capitalize()

    def zh() -> str:
        return "".join(r.choice(_ZH) for _ in range(r.randint(2, 4)))

    def fill(t: str, site: str) -> str:
        while "{" in t:
            for k, v in (("{n}", name), ("{z}", zh), ("{t}", lambda: r.choice(_THINGS)), ("{d}", lambda: str(r.randint(2, 90000))), ("{s}", lambda: site)):
                t = t.replace(k, v(), 1)
        return t

    out = []
    for _ in range(pages):
        lang = r.choices(("en", "de", "zh"), (5, 3, 3))[0]
        frame = lang if r.random() < 0.85 else r.choice(("en", "de", "zh"))
        site = f"{name()} {r.choice(('Post', 'Review', 'Kurier', 'Blatt'))}"
        work = _WORK_ZH if frame == "zh" else _WORK
        head = fill(r.choice(_HEAD[lang]), site)
        lines: list[tuple[str, bool]] = []

        def put(*texts: str, article: bool = False) -> None:
            lines.extend((fill(t, site), article) for t in texts)

        def known(*texts: str) -> None:
            # most furniture is of a kind that the exemplars have, some is not
            put(*(_piece(r, frame) if r.random() < 0.8 else t for t in texts))

        def gap() -> None:
            if r.random() < 0.4:
                lines.append(("", False))

        def sidebar() -> None:
            put(r.choice([s for s in exemplars.SIDEBARS if (ord(s[-1]) > 0x4E00) == (frame == "zh")]).capitalize())
            put(*(r.choice(_HEAD[lang]) for _ in range(r.randint(2, 4))))

        furnished = r.random() < 0.85
        if furnished:
            if r.random() < 0.15:
                put(r.choice(("Some parts of this site work better with JavaScript.", "Mit JavaScript läuft diese Seite besser.", "启用JavaScript后浏览效果更佳。")))
            if r.random() < 0.5:
                known(r.choice(_COOKIE[frame]))
            menu = r.sample(_MENU[frame].split(","), r.randint(3, 9))
            if r.random() < 0.5:
                menu.insert(r.randint(0, len(menu)), r.choice(work))
            if r.random() < 0.25:
                put(r.choice((" | ", " ")).join(menu))
            else:
                put(*menu)
            if r.random() < 0.4:
                put(r.choice((" > ", " / ", " » ")).join((menu[0], r.choice(menu), r.choice(("News", "Reports", "Markets")))))
            gap()
            if r.random() < 0.25:
                sidebar()
                gap()
        body = r.random() < 0.93
        if body:
            if r.random() < 0.9:
                put(head, article=True)
            for _ in range(r.randint(1, 12)):
                x = r.random()
                if x < 0.62:
                    put(" ".join(r.choice(_SENTENCE[lang]) for _ in range(r.randint(1, 4))), article=True)
                elif x < 0.70:
                    put(r.choice(_SUB[lang]), article=True)
                    put(r.choice(_SENTENCE[lang]), article=True)
                elif x < 0.76:
                    own = _WORK_ZH if lang == "zh" else _WORK
                    put(*r.sample(own, r.randint(2, 4)), article=True)
                elif x < 0.80:
                    put(*(f"- {r.choice(_SENTENCE[lang])}" for _ in range(r.randint(1, 3))), article=True)
                elif x < 0.85:
                    put(*(f"{r.choice(('May', 'June', 'July', 'Quarter'))} | {r.randint(2000, 2029)} | {r.randint(1, 999)}.{r.randint(0, 9)}" for _ in range(r.randint(2, 4))), article=True)
                elif furnished and x < 0.90:
                    known(*r.choice(_INSERT[frame]))
                elif furnished and x < 0.94:
                    sidebar()
            put(r.choice(_SENTENCE[lang]), article=True) if r.random() < 0.7 else None
        if furnished:
            if r.random() < 0.35:
                sidebar()
            known(*r.sample(_SHARE[frame], r.randint(0, len(_SHARE[frame]))))
            if r.random() < 0.3:
                known(*r.choice(_INSERT[frame]))
            gap()
            known(*r.sample(_FOOT[frame], r.randint(1, len(_FOOT[frame]))))
            if r.random() < 0.2:
                known(r.choice(_COOKIE[frame]))
        out.append(("" if r.random() < 0.06 else head + (f" {r.choice('|-')} {site}" if r.random() < 0.6 else ""), lines))
    return out
