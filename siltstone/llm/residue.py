"""Template residue and error-page text.

Method: labelled exemplars (``exemplars``) are retrieved through an inverted index from terms to
exemplars. Each text is cut into passage windows; a window's TF-IDF containment in an exemplar is
the share of the window's term weight that the exemplar has. Windows take the label of their best
exemplar if its containment is high. A page is residue if it has windows of residue and no window
of prose that no exemplar covers; furniture is set aside. A message is residue if residue covers it.
Document frequencies are those of all texts at hand.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import exemplars
from siltstone.session import written

RESIDUE, FURNITURE, MESSAGE = 0, 1, 2
#: A term in fewer than one text in so many has the highest weight.
RARE = 55
WINDOW_TERMS = 60

_TAG = re.compile(r"<!?/?(?:doctype html|html|head|title|body|h[1-6]|p|br|hr|noscript|div|span|center|pre|ul|li|b|i|a)\b[^<>]*>", re.I)
_HOLDER = re.compile(
    r"\{\{[^{}]*\}\}|\$\{[^{}]*\}|#\{[^{}]*\}|\{%[^{}]*%\}|<%=?[^<>]*%>|\[\[[^\[\]]*\]\]|%\([^()]*\)[sd]|@@[^@\s]+@@|__[A-Za-z][A-Za-z.\- ]*(?:_[A-Za-z.\- ]+)*__"
    r"|%[A-Za-z][\w.\-]*%|\$[A-Za-z][\w.\-]*\$|«[A-Za-z][\w.\-]*»|\[Insert [^\[\]]*\]|\[[A-Za-z][\w.\-]*\]|<[A-Za-z][\w.\-]*>|\{ ?[A-Za-z][\w.\- ]*\}",
    re.I,
)
_TERM = re.compile(r"⁂|[一-鿿぀-ヿ]+|\d[\d.,:]*|[^\W\d_一-鿿぀-ヿ]+(?:['’][^\W\d_]+)?|©")
_ID = re.compile(r"\b(?:[a-f]+\d|\d+[a-f])[0-9a-f]{6,}\b")
_SCRIPT = re.compile(r"\bjava ?script|\bjs\b|\bscript(?:s|ing)\b")
#: What only lines with placeholders, tags, paths or scripts have.
_ODD = re.compile(r"[<{$#%\[@«/]|__|\.php|\d[a-f]|[a-f]\d|script|\bjs\b")
_PATH = re.compile(r"[\w.\-]*(?:/[\w.\-]+)+|\b\w+\.php\b")
_SENTENCE = re.compile(r"(?<=[.!?。！？;；>*])\s+|[\n。！？]|\s(?=[>*]+\s)|<br>|</?(?:h1|p|title|noscript)>", re.I)
_PROSE = re.compile(r"[.。!?！？…]['\"”’»」）)\]]*\s*$")


def terms(text: str) -> list[str]:
    """Words in lower case, numbers as 0, placeholders as PH, pairs of characters of Chinese."""
    text = text.lower()
    if _ODD.search(text):
        if "<" in text:
            text = _TAG.sub(" ", text)
        text = _HOLDER.sub(" ⁂ ", text)
        if "/" in text or ".php" in text:
            text = _PATH.sub(" ", text)
        text = _ID.sub(" idhex ", _SCRIPT.sub("javascript", text))
    out = []
    for t in _TERM.findall(text):
        c = t[0]
        if c <= "z" and not c.isdigit():
            out.append(t)
        elif "぀" <= c <= "鿿":
            out += [t[i : i + 2] for i in range(len(t) - 1)] if len(t) > 1 else [t]
        elif c.isdigit():
            out.append("0")
        else:
            out.append(t)
    return out


def zh_share(text: str) -> float:
    """The share of Chinese and Japanese characters."""
    return sum("぀" <= c <= "鿿" for c in text) / (len(text) or 1)


def _bag(exemplar: str) -> set[str]:
    return {"⁂" if t == "PH" else "idhex" if t == "ID" else x for t in re.split(r"(\bPH\b|\bID\b)", exemplar) for x in (terms(t) if t not in ("PH", "ID") else ["⁂"])}


#: Terms that say more than any word.
_MARKS = frozenset("⁂©")


# Words that say little in any text, whatever the texts at hand are.
_SMALL = frozenset(
    "0 a an the in of to and or for on at by from with is are was were be been has have had it its this that these those will would can not no as if but into over "
    "der die das und oder in im zu zum zur mit von vom für auf ist sind war wird werden ein eine einer eines den dem des am an bei nach sich nicht auch".split()
)


_MESSAGES = [_bag(x) for x in exemplars.MESSAGES]


class Index:
    """The inverted index of the exemplars, with the weights of terms."""

    def __init__(self, df: dict[str, int], texts: int):
        self.top = math.log(RARE)
        self.weight = {t: max(0.05, math.log((texts + 1) / (n + 1))) for t, n in df.items() if n * RARE >= texts}
        self.postings: dict[str, list[int]] = defaultdict(list)
        self.label: list[int] = []
        for label, group in ((RESIDUE, exemplars.RESIDUE), (FURNITURE, exemplars.FURNITURE), (MESSAGE, exemplars.MESSAGES)):
            for x in group:
                for t in _bag(x):
                    self.postings[t].append(len(self.label))
                self.label.append(label)
        # weight and exemplars of every term of which either is known
        self.all = {
            t: (9.0 if t in _MARKS else min(0.7 if t in _SMALL else self.top, self.weight.get(t, self.top)), tuple(self.postings.get(t, ()))) for t in {*self.weight, *self.postings}
        }
        self.memo: dict[str, tuple] = {}

    def window(self, found: list[str]) -> tuple[float, float, float, float]:
        """Containment in the best exemplar of each label, and the weight of the terms."""
        total = matched = 0.0
        known = []
        for t in set(found):
            w = self.all.get(t)
            if w is None:
                total += self.top
            else:
                total += w[0]
                if w[1]:
                    matched += w[0]
                    known.append(w)
        if matched < 0.3 * total:
            # no exemplar can hold more than all of them know together
            c = matched / total
            return c, c, c, total
        score: dict[int, float] = {}
        for w, has in known:
            for x in has:
                score[x] = score.get(x, 0.0) + w
        best, which = [0.0, 0.0, 0.0], [-1, -1, -1]
        for x, s in score.items():
            if s > best[self.label[x]]:
                best[self.label[x]], which[self.label[x]] = s, x
        # what the best exemplar of residue lacks, a second one may have
        if len(found) > 4 and 0 < best[RESIDUE] < total:
            rest: dict[int, float] = {}
            for w, has in known:
                if which[RESIDUE] not in has:
                    for x in has:
                        if self.label[x] == RESIDUE:
                            rest[x] = rest.get(x, 0.0) + w
            best[RESIDUE] += max(rest.values(), default=0.0)
        total = total or 1.0
        return best[0] / total, best[1] / total, best[2] / total, total

    def line(self, text: str) -> tuple[float, float, float, int, bool]:
        """(residue, furniture, message, terms, prose): the containments of a line, averaged over its
        windows by weight, its number of terms, and whether it ends as a sentence does."""
        hit = self.memo.get(text)
        if hit is None:
            sums, whole, size = [0.0, 0.0, 0.0], 0.0, 0
            for sentence in _SENTENCE.split(text):
                found = terms(sentence) if sentence else ()
                size += len(found)
                for i in range(0, len(found), WINDOW_TERMS):
                    *c, w = self.window(found[i : i + WINDOW_TERMS])
                    for j in range(3):
                        sums[j] += c[j] * w
                    whole += w
            hit = (*(s / (whole or 1.0) for s in sums), size, bool(_PROSE.search(text)))
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[text] = hit
        return hit


def is_residue_line(line: tuple) -> bool:
    res, fur, _, n, _ = line
    return res >= 0.6 and res > fur or n == 0


def is_body_line(line: tuple) -> bool:
    res, fur, _, n, prose = line
    return prose and n >= 6 and res < 0.5 and fur < 0.35


def page_is_residue(index: Index, text: str | None) -> bool:
    """Residue stands on the page and nothing that could be a body."""
    if not text or not text.strip():
        return False
    seen = False
    for raw in text.split("\n"):
        t = raw.strip()
        if t:
            line = index.line(t)
            if is_body_line(line):
                return False
            seen = seen or line[3] > 0 and is_residue_line(line)
    return seen


def message_is_residue(index: Index, text: str | None) -> bool:
    """The whole of a message is residue: no label fits it better and it is covered."""
    if not text or not text.strip():
        return False
    res, fur, msg, n, _ = index.line(text)
    if n == 0 or res < 0.5 or res < msg:
        return False
    # words that both have: it is a message if it is most of what such a message says
    own = set(terms(text))
    return res > msg or not any(len(own & b) * 2 >= len(b) for b in _MESSAGES)


def build_index(texts: DataFrame, column: str) -> dict:
    """Document frequencies over all texts: of the terms in at least one text of RARE, of which
    there are no more than RARE times a text's terms. Null texts count as empty ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        short: dict[str, frozenset[str]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([n, *df.values()], pa.int64())], names=["term", "n"])
            df.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                if t:
                    of: set[str] = set()
                    for line in t.split("\n"):
                        if len(line) > 60:
                            of.update(terms(line))
                        elif line:
                            x = short.get(line)
                            if x is None:
                                if len(short) > 20_000:
                                    short.clear()
                                x = short[line] = frozenset(terms(line))
                            of |= x
                    df.update(of)
            if len(df) > 200_000:
                yield flush()
                n = 0
        yield flush()

    counted = written(texts.select(column).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    counted = counted.join(F.broadcast(counted.where("term = ''").select(F.col("n").alias("texts"))))
    rows = counted.where(F.col("n") * RARE >= F.col("texts")).select("term", "n").collect()
    df = {r.term: r.n for r in rows}
    return {"texts": df.pop("", 0), "df": df}


def residue_ids(table: DataFrame, key: str, column: str, counts: dict, judge) -> DataFrame:
    """(key) of the rows whose text ``judge(index, text)`` finds to be residue; each id once."""
    kind = table.schema[key].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts["df"], counts["texts"])
        for b in batches:
            yield b.select([0]).filter(pa.array([judge(index, t) for t in b.column(1).to_pylist()], pa.bool_()))

    rows = table.select(key, column).where(F.col(column).isNotNull() & (F.col(column) != ""))
    return rows.mapInArrow(pick, f"`{key}` {kind}").distinct()


def found(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(table_name, row_id): the pages and the call messages that are residue.

    Null, empty and blank texts are none. A text of furniture alone is none. A row delivered twice
    counts once. Texts of any length are judged whole. Empty tables give an empty result.
    """
    counts = build_index(pages.select(F.col("page_text").alias("t")).unionByName(results.select(F.col("err").alias("t")).where("t is not null and t != ''")), "t")
    a = residue_ids(pages, "page_id", "page_text", counts, page_is_residue)
    b = residue_ids(results, "result_id", "err", counts, message_is_residue)
    return a.select(F.lit("fetched_pages").alias("table_name"), F.col("page_id").alias("row_id")).unionByName(
        b.select(F.lit("gapfill_results").alias("table_name"), F.col("result_id").alias("row_id"))
    )
