"""Parts of names of persons and firms as people type them.

Nothing here knows the names of a table: which words are given names and which are words of trade is
learned from the table (:func:`learn`), as the words that stand beside many different others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import written

# Short forms of given names, folded, with the names they may stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred alexander", "alec": "alexander", "alex": "alexander alexandra alejandro", "andi": "andreas andrea", "andy": "andrew andreas", "angie": "angela", "art": "arthur", "barb": "barbara", "becky": "rebecca",
    "ben": "benjamin benedict", "benny": "benjamin", "beppe": "giuseppe", "bernie": "bernard bernhard", "bert": "albert robert herbert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine",
    "charlie": "charles charlotte", "chris": "christopher christian christine", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "dora": "theodora dorothea", "doug": "douglas",
    "ed": "edward edwin", "eddie": "edward", "eli": "elisabeth elijah", "evi": "eva evelyn", "fran": "frances francisco", "frank": "francis franklin", "fred": "frederick friedrich alfred", "fritz": "friedrich", "gabi": "gabriele gabriela", "gene": "eugene", "geoff": "geoffrey", "gosia": "malgorzata",
    "greg": "gregory", "gus": "august gustav", "hannes": "johannes", "hank": "henry", "hans": "johannes", "harry": "harold henry", "heinz": "heinrich", "herb": "herbert", "ines": "agnes", "jack": "john", "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome",
    "jim": "james", "jimmy": "james", "jo": "joseph johannes joanna josephine", "joe": "joseph", "johnny": "john", "jon": "jonathan", "josh": "joshua", "jule": "julia", "kate": "katherine katharina", "kathi": "katharina", "kathy": "katherine", "katie": "katherine", "katja": "katharina", "katya": "ekaterina",
    "ken": "kenneth", "kim": "kimberly", "kit": "christopher", "kolya": "nikolai", "larry": "lawrence", "lena": "magdalena helena yelena", "leo": "leonard leonhard leopold", "lilli": "elisabeth", "liz": "elizabeth", "lotte": "charlotte", "lupe": "guadalupe", "maggie": "margaret", "magda": "magdalena",
    "mandy": "amanda", "manny": "manuel", "marge": "margaret", "masha": "maria", "matt": "matthew", "max": "maximilian maxwell", "meg": "margaret", "mick": "michael", "mike": "michael", "misha": "mikhail", "moni": "monika", "nadja": "nadeschda", "nancy": "ann", "nate": "nathan nathaniel",
    "nick": "nicholas", "nico": "nicolas nikolaus", "pablo": "paulo", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "pedro": "peter", "peggy": "margaret", "pepe": "jose", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "rolf": "rudolf",
    "ron": "ronald", "rudi": "rudolf", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexandra sandra", "sanne": "susanne", "sascha": "alexander", "sepp": "josef", "sigi": "siegfried", "steffi": "stefanie", "steve": "steven stephen", "sue": "susan", "susi": "susanne", "sveta": "svetlana", "tanya": "tatiana",
    "ted": "theodore edward", "thea": "theodora dorothea", "tim": "timothy", "tina": "christina martina", "tobi": "tobias", "tom": "thomas", "tommy": "thomas", "toni": "anton antonia", "tony": "anthony", "tricia": "patricia", "uli": "ulrich ulrike", "uschi": "ursula", "uwe": "ulrich", "vicky": "victoria",
    "vlad": "vladimir", "vova": "vladimir", "walt": "walter", "will": "william", "willi": "wilhelm", "yura": "yuri", "zack": "zachary",
}
#: Words around a name that are no part of it.
TITLES = frozenset("dr prof mr mrs ms miss herr frau ing dipl phd mba msc jr sr ii iii he him she her they them".split())
# Legal forms, as (words, short name).
_LEGAL_LONG = (
    ("gesellschaft mit beschrankter haftung", "gmbh"), ("gesellschaft mbh", "gmbh"), ("aktiengesellschaft", "ag"), ("aktiebolag", "ab"), ("incorporated", "inc"), ("corporation", "corp"), ("company", "co"),
    ("limited", "ltd"), ("kabushiki kaisha", "kk"), ("anonim sirketi", "as"), ("spolka z o o", "spzoo"), ("spol s r o", "sro"), ("sp z o o", "spzoo"), ("sp zoo", "spzoo"), ("s r o", "sro"), ("g m b h", "gmbh"), ("a g", "ag"), ("a b", "ab"),
    ("s a s", "sas"), ("a s", "as"), ("s a", "sa"), ("k k", "kk"), ("o o o", "llc"), ("ooo", "llc"), ("l l c", "llc"), ("p l c", "plc"), ("limitada", "ltda"), ("societe anonyme", "sa"), ("sociedad anonima", "sa"),
    ("public ltd co", "plc"), ("ltd liability co", "llc"), ("obshchestvo s ogranichennoy otvetstvennostyu", "llc"),
)
LEGAL = frozenset("gmbh ag ab inc corp co ltd kk as spzoo sro sas sa llc plc ltda kg und".split())

_LEGAL_WORDS = frozenset(w for long, _ in _LEGAL_LONG for w in long.split())
_SMALL = frozenset(("and", "und", "the", "of"))

_EXTRA = {"ł": "l", "ø": "o", "ı": "i", "ß": "ss", "đ": "d", "æ": "ae", "ð": "d", "þ": "th", "œ": "oe"}


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    t = "".join(_EXTRA.get(c, c) for c in text.lower())
    return t if t.isascii() else "".join(_EXTRA.get(c, c) for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Edits from a to b, a swap of neighbouring letters being one; 4 for any number beyond 3."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 3:
        return 4
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]



def _within(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def _cuts(w: str) -> set[str]:
    """The word and what is left of it without one letter; words within one edit share one."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


class _Near:
    """The words of a list that are within one edit of a token."""

    def __init__(self, words: Iterable[str]):
        self.by: dict[str, list[str]] = {}
        for w in sorted(words):
            for c in _cuts(w):
                self.by.setdefault(c, []).append(w)

    def of(self, token: str) -> list[str]:
        found = {w for c in _cuts(token) for w in self.by.get(c, ())}
        return sorted(w for w in found if edits(w, token) == 1)


@lru_cache(maxsize=4)
def _vocabulary(given: tuple, trades: tuple, together: tuple, nicknames: tuple) -> Vocabulary:
    """One vocabulary, with what it has worked out, for all tasks of a worker."""
    return Vocabulary(given, trades, together, dict(nicknames))


class Vocabulary:
    """Given names, words of trade and which of these stand together, as :func:`learn` finds them."""

    def __init__(self, given: Iterable[str] = (), trades: Iterable[str] = (), together: Iterable[tuple[str, str]] = (), nicknames: dict[str, str] | None = None):
        self.names, self.trades = frozenset(given), tuple(sorted(trades))
        self.words = frozenset(self.trades)
        self.together = {frozenset(p) for p in together}
        self.nick = {k: tuple(v.split()) for k, v in (NICKNAMES if nicknames is None else nicknames).items()}
        self._near_names, self._near_trades = _Near(self.names), _Near(self.trades)
        self._given: dict[str, str | None] = {}
        self._trade: dict[str, tuple[str, ...]] = {}

    def __reduce__(self):
        return _vocabulary, (tuple(sorted(self.names)), self.trades, tuple(sorted(tuple(sorted(p)) for p in self.together)), tuple((k, " ".join(v)) for k, v in sorted(self.nick.items())))

    def given(self, token: str) -> str | None:
        """The given name that a token stands for: typed right, shortened or with one slip."""
        if token not in self._given:
            if len(self._given) > 100_000:
                self._given.clear()
            self._given[token] = self._find_given(token)
        return self._given[token]

    def _find_given(self, token: str) -> str | None:
        full = self.nick.get(token)
        if full:
            # a short form of several names says one of them only if the table has no other
            known = [n for n in full if n in self.names] or full
            return known[0] if len(known) == 1 else token
        if token in self.names:
            return token
        if len(token) >= 4:
            near = self._near_names.of(token)
            if len(near) == 1:
                return near[0]
        return None

    def stands_for(self, name: str) -> frozenset[str]:
        """The names that a given name can be: itself, and what it is short for."""
        return frozenset((name, *self.nick.get(name, ())))

    def same_given(self, a: str, b: str) -> bool | None:
        """Whether two given names can be one person's; None if an initial or nothing speaks for it only."""
        if not a or not b:
            return None
        if a == b:
            return True
        if len(a) == 1 or len(b) == 1:
            return None if a[0] == b[0] else False
        if a in self.nick or b in self.nick:
            return bool(self.stands_for(a) & self.stands_for(b))
        if a in self.names and b in self.names:
            return False
        e, n = edits(a, b), min(len(a), len(b))
        return e <= 1 and n >= 3 or e <= 2 and n > 3

    def person(self, name: str | None) -> tuple[str, str]:
        """(first, last): folded; first is a given name, an initial or as typed; empty if missing."""
        if not name:
            return "", ""
        text = re.sub(r"\([^)]*\)", " ", fold(name))
        parts = [[t for t in re.findall(r"[^\W\d_]+", p) if t not in TITLES] for p in text.split(",")]
        parts = [p for p in parts if p]
        if not parts:
            return "", ""
        if len(parts) > 1:
            last = max(parts[0], key=len)
            rest = [t for p in parts[1:] for t in p]
            long = [t for t in rest if len(t) > 1]
            first = (long or rest)[0]
            if not long and len(parts[0]) > 1:
                first, last = parts[0][0], parts[0][-1]
            return self.given(first) or first, last
        tokens = parts[0]
        long = [t for t in tokens if len(t) > 1]
        if not long:
            return tokens[0], ""
        if len(long) == 1:
            initials = [t for t in tokens if len(t) == 1]
            return (initials[0] if initials else ""), long[0]
        a, b = self.given(long[0]), self.given(long[-1])
        if a is None and b is not None:
            return b, long[0]
        return a or long[0], long[-1]

    def trade(self, token: str) -> tuple[str, ...]:
        """The words of trade that a token may be: itself, what it shortens, or what it misses by one slip."""
        if token not in self._trade:
            if len(self._trade) > 100_000:
                self._trade.clear()
            self._trade[token] = self._find_trade(token)
        return self._trade[token]

    def _find_trade(self, token: str) -> tuple[str, ...]:
        if token in self.words:
            return (token,)
        n = len(token)
        found = [t for t in self.trades if t.startswith(token)] if n >= 3 else []
        if not found and 3 <= n <= 5:
            # letters of the word in order, its first and its last among them
            found = [t for t in self.trades if t[0] == token[0] and t[-1] == token[-1] and _within(token, t)]
        if not found and n >= 4:
            found = [t for t in self.trades if t[0] == token[0] and n < len(t) and token[:3] == t[:3] and _within(token, t)]
        if not found and n == 2:
            found = [t for t in self.trades if t[0] == token[0] and _within(token, t)]
        if not found and n >= 6:
            found = self._near_trades.of(token)
        return tuple(found)

    def _chosen(self, maybe: tuple[str, ...], sure: set[str]) -> str | None:
        """Of several words that a short form may be, the one that stands with the words beside it elsewhere."""
        if len(maybe) == 1:
            return maybe[0]
        beside = [t for t in maybe if any(frozenset((t, s)) in self.together for s in sure if s != t)]
        if len(beside) == 1:
            return beside[0]
        rest = beside or [t for t in maybe if not sure]
        # words of one root, such as singular and plural, mean the same
        return min(rest, key=len) if rest and all(t[:5] == rest[0][:5] for t in rest) else None

    @lru_cache(maxsize=200_000)
    def firm(self, company: str | None, city: str | None = None) -> tuple[str, str, str, str]:
        """(stem, trades, legal form, city): the distinctive word, the words of trade and the legal form in
        sorted order, and the city, of the column or as it stands behind the name."""
        if not company:
            return "", "", "", fold(city or "").strip()
        text = re.sub(r"(?<=[a-zäöüßéèêâôãõåøæçñşřšžżłńěõë])(?=[A-Z][a-z]+)", " ", company.strip())
        place = fold(city or "").strip()
        inner = re.findall(r"\(([^)]*)\)", text)
        text = re.sub(r"\([^)]*\)", " ", text)
        segments = []
        for seg in fold(text).split(","):
            seg = f" {' '.join(re.findall(r'[a-z0-9]+', seg))} "
            for long, short in _LEGAL_LONG:
                if f" {long} " in seg:
                    seg = seg.replace(f" {long} ", f" {short} ")
            segments.append(seg.split())
        kinds: list[list[tuple[str, str]]] = []
        open_: list[tuple[str, tuple[str, ...]]] = []
        sure: set[str] = set()
        for seg in segments:
            out: list[tuple[str, str]] = []
            for t in seg:
                if t in LEGAL:
                    out.append(("l", t))
                elif t in _SMALL:
                    continue
                elif may := self.trade(t):
                    if len(may) == 1:
                        sure.add(may[0])
                    open_.append((t, may))
                    out.append(("t", t))
                else:
                    end = next((w for w in self.trades if len(w) >= 4 and len(t) > len(w) + 3 and t.endswith(w)), None)
                    if end:
                        sure.add(end)
                        open_.append((end, (end,)))
                        out += [("s", t[: -len(end)]), ("t", end)]
                    else:
                        out.append(("s", t))
            if out:
                kinds.append(out)
        if not any(k == "s" for seg in kinds for k, _ in seg):
            # a short word alone is the firm's own word, not one of trade
            kinds = [[("s" if k == "t" and t not in self.words else k, t) for k, t in seg] for seg in kinds]
        # a last segment of plain words alone is the city, unless it is all there is
        if len(kinds) > 1 and all(k == "s" for k, _ in kinds[-1]) and any(k == "s" for seg in kinds[:-1] for k, _ in seg):
            place = place or " ".join(t for _, t in kinds[-1])
            kinds.pop()
        flat = [x for seg in kinds for x in seg]
        of = dict(open_)
        said = {w for k, t in flat if k == "t" and (w := self._chosen(of[t], sure))}
        stems = [t for k, t in flat if k == "s" and len(t) > 1]
        if not place:
            place = next((fold(x).strip() for x in inner if len(x) > 4 and not x.isupper()), "")
        # the distinctive word may have come apart
        first = next((i for i, (k, t) in enumerate(flat) if k == "s" and len(t) > 1), len(flat))
        last = next((i for i in range(first, len(flat)) if flat[i][0] != "s"), len(flat))
        stem = "".join(t for _, t in flat[first:last]) if stems else ""
        return stem, " ".join(sorted(said)), " ".join(sorted({t for k, t in flat if k == "l"} - {"und"})), place


def learn(firms: DataFrame, persons: DataFrame, *, trade_share: float = 0.02, given_share: float = 0.005, least: int = 8, least_given: int = 3) -> Vocabulary:
    """The vocabulary of two tables, firms (company, city) and persons (name).

    A word of trade stands beside at least ``trade_share`` of all distinct words of firm names (and
    ``least``) and is no word of a city; a given name stands in the place of one beside ``given_share``
    of the distinct words of names (and ``least_given``). Only distinct spellings count, so that a firm
    with many rows weighs no more than others. What reaches the driver is bounded: the shares
    of a word's neighbours sum up to what a name has of words.
    """
    spark = firms.sparkSession

    def pairs(rows: DataFrame, column: str, cut) -> DataFrame:
        def split(batches):
            import pyarrow as pa

            for b in batches:
                left, right = [], []
                for text in b.column(0).to_pylist():
                    for x, y in cut(text):
                        left.append(x)
                        right.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

        return rows.select(column).where(F.col(column).isNotNull()).distinct().mapInArrow(split, "a string, b string").distinct()

    def firm_pairs(text: str):
        t = sorted({w for w in re.findall(r"[^\W\d_]{2,}", fold(re.sub(r"\([^)]*\)", " ", text))) if w not in LEGAL and w not in _SMALL and w not in _LEGAL_WORDS})
        return [(x, y) for x in t for y in t if x != y]

    def person_pairs(text: str):
        parts = [[w for w in re.findall(r"[^\W\d_]{2,}", p) if w not in TITLES] for p in fold(re.sub(r"\([^)]*\)", " ", text)).split(",")]
        parts = [p for p in parts if p]
        if len(parts) > 1:
            return [(parts[1][0], w) for w in parts[0]] + [("", w) for w in parts[0]]
        return [(parts[0][0], w) for w in parts[0][1:]] + [("", w) for w in parts[0][1:]] if parts and len(parts[0]) > 1 else []

    def city_words(text: str):
        return [(w, "") for w in re.findall(r"[^\W\d_]{2,}", fold(text))]

    of_firms, of_persons = written(pairs(firms, "company", firm_pairs), "firm_words"), written(pairs(persons, "name", person_pairs), "person_words")
    cities = pairs(firms, "city", city_words).select("a")
    count = of_firms.groupBy("a").agg(F.count("*").alias("n"))
    many = count.agg(F.count("*")).first()[0]
    trades = sorted(r.a for r in count.where(F.col("n") >= max(least, trade_share * many)).join(cities, "a", "left_anti").collect())
    known = spark.createDataFrame([(t,) for t in trades], "b string")
    both = of_firms.join(F.broadcast(known.withColumnRenamed("b", "a")), "a").join(F.broadcast(known), "b").where("a < b")
    together = [(r.a, r.b) for r in both.collect()]
    lasts = of_persons.where("a = ''").count()
    given = [r.a for r in of_persons.where("a != ''").groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= max(least_given, given_share * lasts)).collect()]
    return Vocabulary(given, trades, together)
