"""The article of a page, without the furniture around and inside it.

Method: a tree-structured graphical model. A page's tree has the page at the root, under it its
blocks (neighbouring lines of one kind, parted by blank lines and headings), under these the
lines. Every node is article or not. Node potentials are logistic in what a node shows (its
containment in exemplars of furniture, its kind, its place against title and prose); the
potentials between parent and child are counted. Both are learned from labelled pages
(``labelled_pages``, whose number is a parameter). Sum-product messages pass up to the root and
down again and give each line's marginal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import exemplars, residue
from siltstone.llm.labelled_pages import compose

KNOWN, PROSE, SHORT, HEAD, TABLE = range(5)
_WORDS = re.compile(r"\w+")
#: A table row has numbers in two neighbouring cells at least.
_ROW = re.compile(r"\| *[\d.,%+-]+ *\|[^|]*\d|\d[\d.,%]* *\| *[\d.,%+-]+ *$")
_SIDE = frozenset(exemplars.SIDEBARS)


def _key(t: str) -> str:
    return " ".join(_WORDS.findall(t.lower()))


class Lines:
    """The lines of several pages that are not blank, with their features: flat arrays."""

    def __init__(self, page: np.ndarray, at: np.ndarray, x: np.ndarray, block: np.ndarray):
        self.page, self.at, self.x, self.block = page, at, x, block


def features(index: residue.Index, titles: list[str | None], pages: list[list[str]]) -> Lines:
    """Kinds, places and neighbours of the lines, and the blocks they form."""
    page_, at_, cover_, kind_, own_, side_, dash_ = [], [], [], [], [], [], []
    for p, (title, raw) in enumerate(zip(titles, pages)):
        name = _key(title or "")
        begin = len(kind_)
        for i, t in enumerate(raw):
            t = t.strip()
            if not t:
                continue
            res, fur, _, size, ends = index.line(t)
            cover = max(res, fur)
            key = _key(t) if len(t) < 200 else ""
            side = key in _SIDE
            own = len(key) > 5 and not side and (size > 2 or key == name) and name.startswith(key)
            dash = t[:2] in ("- ", "• ", "* ")
            longer = size > 4 and (size > 8 or residue.zh_share(t) <= 0.5)
            if own:
                kind = HEAD
            elif " | " in t and _ROW.search(t):
                kind = TABLE
            elif cover >= 0.5 or side:
                kind = KNOWN
            elif cover < 0.35 and (ends and longer or dash):
                kind = PROSE
            else:
                kind = HEAD if longer else SHORT
            page_.append(p)
            at_.append(i)
            cover_.append(cover)
            kind_.append(kind)
            own_.append(own)
            side_.append(side)
            dash_.append(dash)
        if not name and PROSE in (mine := kind_[begin:]):
            # without a title, the headline is what looks like one right before the prose
            j = begin + mine.index(PROSE) - 1
            while j > begin and kind_[j] == SHORT:
                j -= 1
            if j >= begin and kind_[j] == HEAD and not (j > begin and (side_[j - 1] or kind_[j - 1] == HEAD)):
                own_[j] = True
    page, at, kind = np.array(page_, dtype=np.int64), np.array(at_, dtype=np.int64), np.array(kind_, dtype=np.int64)
    cover, own, side, dash = np.array(cover_, dtype=float), np.array(own_, dtype=bool), np.array(side_, dtype=bool), np.array(dash_, dtype=bool)
    n, m = len(page), len(pages)
    new = np.ones(n, dtype=bool)
    new[1:] = page[1:] != page[:-1]
    # a list of other articles: what follows its heading and looks like a headline
    listed = np.zeros(n, dtype=bool)
    for j in np.flatnonzero((kind == HEAD) & ~own & ~new):
        listed[j] = (side[j - 1] or listed[j - 1]) and at[j] == at[j - 1] + 1
    place = np.arange(n)
    end = np.full(m, n)

    def first_of(mask: np.ndarray) -> np.ndarray:
        out = np.full(m, n)
        w = np.flatnonzero(mask)[::-1]
        out[page[w]] = w
        return out

    def last_of(mask: np.ndarray) -> np.ndarray:
        out = np.full(m, -1)
        w = np.flatnonzero(mask)
        out[page[w]] = w
        return out

    first_own, first_prose = first_of(own), first_of(kind == PROSE)
    first = np.where(first_own < n, first_own, np.where(first_prose < n, first_prose, end))
    last = last_of((kind == PROSE) | (kind == TABLE))
    last = np.where(last >= 0, last, first)
    before, after = place < first[page], place > last[page]
    inside = ~before & ~after
    prev = np.where(new, KNOWN, np.roll(kind, 1))
    nxt = np.where(np.roll(new, -1), KNOWN, np.roll(kind, -1)) if n else kind
    cols = [np.ones(n), cover, side, own, listed, dash, before, after, (first_prose == n)[page], (first_own == n)[page]]
    for k in (KNOWN, PROSE, SHORT, HEAD, TABLE):
        is_k = kind == k
        cols += [is_k, is_k & before, is_k & after, is_k & inside, is_k & (prev == KNOWN) & (nxt == KNOWN), is_k & (prev == PROSE), is_k & (nxt == PROSE)]
    sure = cover >= 0.9
    cols += [sure, sure & inside, sure & inside & (prev == PROSE), (kind == SHORT) & (prev == SHORT), (kind == SHORT) & (nxt == TABLE)]
    cols += [(kind == HEAD) & (prev == KNOWN) & ~own, (kind == SHORT) & before & ~new & ~own]
    step = new.copy()
    step[1:] |= (np.diff(at) != 1) | (kind[1:] != kind[:-1]) | side[1:] | side[:-1] | own[1:]
    return Lines(page, at, np.column_stack([np.asarray(c, dtype=np.float64) for c in cols]), np.cumsum(step) - 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


class Model:
    """Potentials of lines (logistic), and of blocks given the page and lines given the block."""

    def __init__(self, line: np.ndarray, block_line: np.ndarray, page_block: np.ndarray, page: np.ndarray):
        self.line, self.block_line, self.page_block, self.page = line, block_line, page_block, page

    def marginals(self, lines: Lines) -> np.ndarray:
        """The probability of each line to be article; messages in logarithms."""
        if not len(lines.x):
            return np.zeros(0)
        z = np.clip(lines.x @ self.line, -30, 30)
        node = np.stack([-np.logaddexp(0, z), -np.logaddexp(0, -z)], axis=1)
        block = lines.block
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        owner = lines.page[starts]  # the page of each block
        tops = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        root = np.cumsum(np.concatenate([[True], owner[1:] != owner[:-1]])) - 1
        # upward: from lines to blocks, from blocks to pages
        up = np.logaddexp(node[:, :1] + self.block_line[:, 0], node[:, 1:] + self.block_line[:, 1])
        blocks = np.add.reduceat(up, starts, axis=0)
        to_page = np.logaddexp(blocks[:, :1] + self.page_block[:, 0], blocks[:, 1:] + self.page_block[:, 1])
        page = self.page + np.add.reduceat(to_page, tops, axis=0)
        # downward: each child gets what its parent knows from all others
        rest = page[root] - to_page
        down = np.logaddexp(rest[:, :1] + self.page_block[0], rest[:, 1:] + self.page_block[1])
        around = (down + blocks)[block] - up
        above = np.logaddexp(around[:, :1] + self.block_line[0], around[:, 1:] + self.block_line[1])
        both = node + above
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))


def train(index: residue.Index, pages: int = 500) -> Model:
    """Learns the potentials from ``pages`` labelled pages. The edge from block to line is relative
    to the share of either state, which the logistic part already holds."""
    made = compose(pages)
    lines = features(index, [t for t, _ in made], [[t for t, _ in ls] for _, ls in made])
    y = np.array([made[p][1][i][1] for p, i in zip(lines.page, lines.at)], dtype=np.int64)
    child, grand = np.ones((2, 2)), np.ones((2, 2))
    has = np.bincount(lines.page, weights=y, minlength=pages) > 0
    size, yes = np.bincount(lines.block), np.bincount(lines.block, weights=y)
    state = (yes * 2 >= size).astype(np.int64)
    np.add.at(child, (state[lines.block], y), 1)
    starts = np.flatnonzero(np.concatenate([[True], lines.block[1:] != lines.block[:-1]]))
    np.add.at(grand, (has[lines.page[starts]].astype(np.int64), state), 1)
    roots = np.array([np.sum(~has) + 1.0, np.sum(has) + 1.0])
    edge = child / child.sum(axis=1, keepdims=True) / (child.sum(axis=0) / child.sum())
    return Model(_logistic(lines.x, y.astype(float)), np.log(edge), np.log(grand / grand.sum(axis=1, keepdims=True)), np.log(roots / roots.sum()))


def model_of(counts: dict, labelled: int = 500) -> Model:
    return train(residue.Index(counts["df"], counts["texts"]), labelled)


def judged(pages: DataFrame, counts: dict, labelled: int = 500) -> DataFrame:
    """(page_id, line_no, is_article, residue) of each line that is not blank; a page delivered
    twice is judged twice."""

    model = model_of(counts, labelled)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = residue.Index(counts["df"], counts["texts"])
        for whole in batches:
            for cut in range(0, whole.num_rows, 500):
                b = whole.slice(cut, 500)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                titles, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
                lines = features(index, titles, [t.split("\n") for t in texts])
                bad = np.array([residue.page_is_residue(index, t) for t in texts], dtype=bool)
                out = (ids[lines.page], lines.at, model.marginals(lines) >= 0.5, bad[lines.page])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["page_id", "line_no", "is_article", "residue"])

    rows = pages.select("page_id", "title", "page_text").where("page_text is not null and page_text != ''")
    return rows.mapInArrow(judge, "page_id long, line_no long, is_article boolean, residue boolean")


def _counts(pages: DataFrame, results: DataFrame) -> dict:
    return residue.build_index(pages.select(F.col("page_text").alias("t")).unionByName(results.select(F.col("err").alias("t")).where("t is not null and t != ''")), "t")


def furniture_lines(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, line_no): the lines that are not article; pages that are residue are left out.

    Lines are what a line feed parts, from 0; blank lines count but are no case. Null and empty
    pages have none. A page delivered twice counts once. Pages of any length are judged whole. An
    empty table gives an empty result. ``results`` only adds to the term statistics.
    """
    return judged(pages, _counts(pages, results)).where("not residue and not is_article").select("page_id", "line_no").distinct()


def articles(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, article): the lines of the article in order, joined by line feeds; null if none."""

    kept = judged(pages, _counts(pages, results)).where("not residue and is_article").select("page_id", "line_no").distinct()
    lines = pages.select("page_id", "page_text").dropDuplicates(["page_id"]).join(kept.groupBy("page_id").agg(F.array_sort(F.collect_list("line_no")).alias("n")), "page_id", "left")
    text = F.array_join(F.transform("n", lambda i: F.get(F.split("page_text", "\n"), i.cast("int"))), "\n")
    return lines.select("page_id", F.when(F.size("n") > 0, text).alias("article"))
