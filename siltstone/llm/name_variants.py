"""Variant spellings of firms and persons, linked into groups.

Method: a name becomes one weighted vector of several blocks: the character n-grams of a firm's
distinctive word and of a last name (weighted by rarity, up to a bound that makes the weights the same
at any size), and whole words for what many names share (words of trade, given names, legal forms), as
the table itself teaches (:func:`siltstone.llm.names.learn`). A distributed sparse join finds the names
whose heavy blocks have a cosine above a threshold; the similarity of two names is the cosine of
these vectors over the blocks that both have. In the components that it joins above
the cut, average-linkage clustering over the sparse similarities forms the groups (pairs that the join
did not bring together count as 0).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import graphs
from siltstone.llm import names
from siltstone.session import written

ITEM = ("field_name", "first", "last", "stem", "trades", "legal", "city")
#: What the distinctive words of a name agree in counts as far as the other blocks agree too: by kind of
#: name, the weights of these, 1 being that of the distinctive word itself; and the cut from which names mean the same.
FIRM_WEIGHTS = {"trades": 1.4, "legal": 0.5, "city": 0.8}
PERSON_WEIGHTS = {"first": 2.0, "stem": 1.0, "trades": 0.1, "legal": 0.05, "city": 0.2}
CUT = 0.44
#: An n-gram in fewer than one word in so many weighs no more than one in so many.
RARE = 500


def _squeezed(w: str) -> str:
    """A word without the e that stands for the marks of a vowel."""
    return re.sub("(?<=[aou])e", "", w)


def grams(w: str) -> list[str]:
    """The distinct 2- and 3-grams of a word with its ends marked."""
    p = f"^{_squeezed(w)}$"
    return sorted({p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1)})


class Vectors:
    """Cosines of the n-gram vectors of words; ``weights`` has the frequent n-grams only."""

    def __init__(self, weights: dict[str, float], other: float):
        self.weights, self.other = weights, other
        self.memo: dict[str, tuple[dict[str, float], float]] = {}

    def of(self, w: str) -> tuple[dict[str, float], float]:
        hit = self.memo.get(w)
        if hit is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            v = {g: self.weights.get(g, self.other) for g in grams(w)}
            hit = self.memo[w] = v, math.sqrt(sum(v.values()))
        return hit

    def cosine(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        (va, na), (vb, nb) = self.of(a), self.of(b)
        return sum(va[g] for g in va.keys() & vb.keys()) / (na * nb)

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the frequent n-grams in ascending order, and their weights."""
        code = np.array([_number(g) for g in self.weights], dtype=np.int64)
        order = np.argsort(code)
        return code[order], np.array(list(self.weights.values()), dtype=float)[order]


def _number(g: str) -> int:
    n = 0
    for c in g:
        n = n << 21 | ord(c)
    return n


def _numbered_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`grams` of words as (place of the word, number of the n-gram), the same one of a word once or more."""
    marked = [f"^{_squeezed(w)}$" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    two, three = at[1:] == at[:-1], at[2:] == at[:-2]
    bi, tri = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.concatenate([at[:-1][two], at[:-2][three]]), np.concatenate([bi[two], tri[three]])


def alike(left: list[str], right: list[str], vectors: Vectors, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``left``, in ``right``) of all pairs of words whose cosine is at least ``threshold``. The sums of one
    left word with all right ones are taken at a time, from lists of the words that have an n-gram; no pair is made."""
    if not left or not right:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, code = _numbered_grams(left + right)
    code, g = np.unique(code, return_inverse=True)
    known, weights = vectors.numbered()
    weight = np.full(len(code), vectors.other)
    if len(known):
        place = np.minimum(np.searchsorted(known, code), len(known) - 1)
        weight = np.where(known[place] == code, weights[place], weight)
    at, g = np.divmod(np.unique(at * len(code) + g), len(code))
    norm = np.sqrt(np.bincount(at, weights=weight[g], minlength=len(left) + len(right)))
    of_right = at >= len(left)
    order = np.argsort(g[of_right], kind="stable")
    having, by = at[of_right][order] - len(left), g[of_right][order]
    start = np.searchsorted(by, np.arange(len(code) + 1))
    lists = [having[i:j] for i, j in zip(start[:-1].tolist(), start[1:].tolist())]
    size = np.diff(start)
    own, ends = g[~of_right], np.searchsorted(at[~of_right], np.arange(len(left) + 1)).tolist()
    least = threshold * norm[len(left) :]
    xs, ys = [], []
    for x in range(len(left)):
        gs = own[ends[x] : ends[x + 1]]
        top = np.bincount(np.concatenate([lists[i] for i in gs.tolist()]), weights=np.repeat(weight[gs], size[gs]), minlength=len(right))
        y = np.flatnonzero(top >= norm[x] * least)
        xs.append(np.full(len(y), x))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def vectors_of(words: DataFrame) -> Vectors:
    """The vectors over the distinct words (w). The driver gets the n-grams that more than one word in
    ``RARE`` has: at most ``RARE`` times those of a word, whatever the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        n = 0
        for b in batches:
            for w in b.column("w").to_pylist():
                n += 1
                df.update(grams(w))
            if len(df) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["g", "n"])
                df.clear()
        df[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["g", "n"])

    counted = written(words.mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")), "grams")
    total = (counted.where("g = ''").first() or (None, 0))[1]
    often = counted.where(F.col("n") * RARE > total).where("g != ''").collect()
    bound = min(total, RARE)
    return Vectors({r.g: math.log(1 + min(total / r.n, RARE)) for r in often}, math.log(1 + max(1, bound)))


def similar_words(words: DataFrame, vectors: Vectors, threshold: float = 0.42, *, block: int = 20_000) -> DataFrame:
    """(a, b), both ways round and each with itself: the distinct words (w) whose cosine is at least ``threshold``.

    The words lie in blocks of about ``block``, and each two blocks meet in one task (:func:`alike`). What is shuffled is
    each word once for each block; only pairs that are near are ever rows."""
    n = words.count()
    blocks = max(-(-n // block), min(5, -(-n // 500)), 1)

    def close(t: pa.Table) -> pa.Table:
        k, own = t.column("k")[0].as_py(), t.column("own").to_numpy()
        i, j = divmod(k, blocks)
        w = np.array(t.column("w").to_pylist(), dtype=object)
        left, right = np.sort(w[own == i]), np.sort(w[own == j])
        x, y = alike(left.tolist(), right.tolist(), vectors, threshold)
        if i == j:
            x, y = x[x < y], y[x < y]
        return pa.table({"a": pa.array(left[x], pa.string()), "b": pa.array(right[y], pa.string())})

    placed = words.withColumn("own", F.pmod(F.xxhash64("w"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = placed.select("w", "own", other.alias("o")).select("w", "own", (F.least("own", "o") * blocks + F.greatest("own", "o")).alias("k"))
    tasks = blocks * (blocks + 1) // 2
    found = written(placed.repartition(tasks, "k").groupBy("k").applyInArrow(close, "a string, b string"), "near")
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(words.select(F.col("w").alias("a"), F.col("w").alias("b")))


def _shared(p: str, q: str) -> float:
    """The cosine of two sets of words, singular and plural being one."""
    a, b = ({re.sub("ies$", "y", w).rstrip("s") for w in x.split()} for x in (p, q))
    return len(a & b) / math.sqrt(len(a) * len(b))


class Similarity:
    """The similarity of two names (fields as in ``ITEM``): the cosine of their tensor-product vectors, head
    word x (1 + the other blocks), a block counting only if both names have it. The head word is a firm's own
    word or a person's last name; for a person the 1 is left to the firm's word."""

    def __init__(self, vocabulary: names.Vocabulary, stems: Vectors, lasts: Vectors):
        plain = Vectors({}, 1.0)
        self.vocabulary = vocabulary
        self.by = {"first": self._first, "last": lasts.cosine, "stem": stems.cosine, "trades": _shared, "legal": _shared, "city": plain.cosine}

    def _first(self, a: str, b: str) -> float | None:
        same = self.vocabulary.same_given(a, b)
        return None if same is None else float(same)

    def __call__(self, p: dict, q: dict) -> float:
        person = p["field_name"] == "name"
        main = "last" if person else "stem"
        head = self.by[main](p[main], q[main])
        top = whole = 0.0 if person else 1.0
        for block, w in (PERSON_WEIGHTS if person else FIRM_WEIGHTS).items():
            if p[block] and q[block]:
                c = self.by[block](p[block], q[block])
                if c is not None:
                    top, whole = top + w * c, whole + w
        return head * top / whole if whole else 0.0


def parts(rows: DataFrame, vocabulary: names.Vocabulary) -> DataFrame:
    """The parts of each row's name; rows that name a person have field_name 'name'. Rows of neither are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, company, name, city in zip(*(c.to_pylist() for c in b.columns)):
                first, last = vocabulary.person(name)
                out.append((i, "company" if name is None else "name", first, last, *vocabulary.firm(company, city)))
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["upload_row_id", *ITEM])

    named = rows.select("upload_row_id", "company", "name", "city").where("upload_row_id is not null and (company is not null or name is not null)")
    return named.mapInArrow(cut, "upload_row_id long, " + ", ".join(f"{c} string" for c in ITEM)).dropDuplicates(["upload_row_id"])


def _item_pairs(items: DataFrame, stems: DataFrame, lasts: DataFrame) -> DataFrame:
    """(x, y), x < y, of the spellings that meet: firms by near stems, persons by near stems and near last names.

    One side takes on the near stems, the other the near last names: they meet at the last name of the
    first and the stem of the second. So no hot firm and no hot last name is paired with itself as a whole."""
    firms = items.where("field_name = 'company' and stem != ''").select("node", "stem")
    a = firms.select(F.col("node").alias("x"), F.col("stem").alias("a")).join(stems, "a")
    of_firms = a.join(firms.select(F.col("node").alias("y"), F.col("stem").alias("b")), "b").where("x < y").select("x", "y")
    people = items.where("field_name = 'name' and stem != '' and last != ''").select("node", "last", "stem")
    combos = written(people.groupBy("last", "stem").agg(F.min("node").alias("c")), "combos")
    left = combos.join(stems.select(F.col("a").alias("stem"), "b"), "stem").select("last", F.col("b").alias("stem"), F.col("c").alias("cx"))
    right = combos.join(lasts.select(F.col("a").alias("last"), "b"), "last").select(F.col("b").alias("last"), "stem", F.col("c").alias("cy"))
    met = left.join(right, ["last", "stem"]).where("cx <= cy").select("cx", "cy").distinct()
    of = written(people.join(combos, ["last", "stem"]).select("node", "c"), "of")
    both = met.join(of.select(F.col("c").alias("cx"), F.col("node").alias("p")), "cx").join(of.select(F.col("c").alias("cy"), F.col("node").alias("q")), "cy").where("cx != cy or p < q")
    return of_firms.unionByName(both.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")))


def similar(items: DataFrame, vocabulary: names.Vocabulary, threshold: float = 0.42) -> DataFrame:
    """(x, y, s, nx, ny) of the spellings (node, n and ``ITEM``) that meet: their similarity, and n of both."""

    def distinct(field: str) -> DataFrame:
        return written(items.select(F.col(field).alias("w")).where("w != ''").distinct(), "words")

    stems, lasts = distinct("stem"), distinct("last")
    vs, vl = vectors_of(stems), vectors_of(lasts)
    pairs = _item_pairs(items, similar_words(stems, vs, threshold), similar_words(lasts, vl, threshold))
    measure = Similarity(vocabulary, vs, vl)
    side = lambda n: items.select(F.col("node").alias(n), F.struct(*ITEM).alias(f"r{n}"), F.col("n").alias(f"n{n}"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps, qs = b.column("rx").to_pylist(), b.column("ry").to_pylist()
            s = [measure(p, q) for p, q in zip(ps, qs)]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(s, pa.float64()), b.column("nx"), b.column("ny")], names=["x", "y", "s", "nx", "ny"])

    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "rx", "ry", "nx", "ny").mapInArrow(score, "x long, y long, s double, nx long, ny long")


def average_linkage(x: np.ndarray, y: np.ndarray, s: np.ndarray, nx: np.ndarray, ny: np.ndarray, cut: float = CUT) -> dict[int, int]:
    """{item: group}: groups merge as long as the mean similarity of their members is at least ``cut``;
    an item x stands for nx members alike, and pairs that are not given count as 0. Each round merges all groups that are each other's nearest
    (of equally near ones the pair of smaller numbers), which leads to the same groups as one merge at a time.
    Components that no pair connects do not touch each other, so many are clustered at once."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    size, label = np.ones(len(ids)), np.arange(len(ids))
    size[a], size[b] = nx, ny
    total = s * nx * ny.astype(float)
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        mean = total / (size[lo] * size[hi])
        u, v, m = np.concatenate([lo, hi]), np.concatenate([hi, lo]), np.concatenate([mean, mean])
        order = np.lexsort((np.concatenate([hi, hi]), np.concatenate([lo, lo]), -np.round(m, 12), u))
        first = order[np.concatenate([[True], np.diff(u[order]) != 0])]
        best = np.full(len(ids), -1)
        best[u[first]] = np.where(np.round(m[first], 12) >= cut, v[first], -1)
        # the mean of no pair can rise: what lies under the cut around a group stays there
        merge = np.flatnonzero((best >= 0) & (best[best] == np.arange(len(ids))) & (np.arange(len(ids)) < best))
        if not len(merge):
            break
        into = np.arange(len(ids))
        into[best[merge]] = merge
        size[merge] += size[best[merge]]
        label = into[label]
        a, b = into[lo], into[hi]
        keep = (a != b) & ((best[lo] >= 0) | (best[hi] >= 0))
        a, b, total = a[keep], b[keep], total[keep]
        if len(a):
            code, inv = np.unique(np.minimum(a, b).astype(np.int64) * len(ids) + np.maximum(a, b), return_inverse=True)
            total = np.bincount(inv, weights=total)
            a, b = code // len(ids), code % len(ids)
    return dict(zip(ids.tolist(), ids[label].tolist()))


def _cluster(t: pa.Table) -> pa.Table:
    got = average_linkage(*(t.column(c).to_numpy() for c in ("x", "y", "s", "nx", "ny")))
    return pa.table({"node": pa.array(list(got), pa.int64()), "group_id": pa.array(list(got.values()), pa.int64())})


def linked_rounds(edges: DataFrame, cut: float = CUT) -> DataFrame:
    """(node, group_id): :func:`average_linkage` of edges (x, y, s, nx, ny) with every round as a query, for
    components that are too large for one task."""
    label = written(edges.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("group_id", F.col("node")), "label")
    ends = edges.select(F.explode(F.array(F.struct(F.col("x").alias("g"), F.col("nx").alias("n")), F.struct(F.col("y").alias("g"), F.col("ny").alias("n")))).alias("e"))
    size = written(ends.select("e.g", F.col("e.n").cast("double").alias("n")).distinct(), "size")
    now = edges.select("x", "y", (F.col("s") * F.col("nx") * F.col("ny")).alias("s"))
    while True:
        now = written(now, "round")
        mean = now.join(size.select(F.col("g").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("g").alias("y"), F.col("n").alias("ny")), "y").withColumn("m", F.round(F.col("s") / (F.col("nx") * F.col("ny")), 12))
        key = F.struct((-F.col("m")).alias("m"), F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        both = mean.where(F.col("m") >= cut).select(F.explode(F.array("x", "y")).alias("u"), key.alias("k"))
        best = both.groupBy("u").agg(F.min("k").alias("k"))
        merged = written(best.groupBy(F.col("k.lo").alias("lo"), F.col("k.hi").alias("hi")).agg(F.count("*").alias("c")).where("c = 2").select("lo", "hi"), "merged")
        if merged.isEmpty():
            return label
        into = merged.select(F.col("hi").alias("old"), F.col("lo").alias("new"))

        def moved(df: DataFrame, c: str, into: DataFrame = into) -> DataFrame:
            return df.join(into.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")

        label = written(moved(label, "group_id").select("node", "group_id"), "label")
        size = written(moved(size, "g").groupBy("g").agg(F.sum("n").alias("n")), "size")
        now = moved(moved(now, "x"), "y").where("x != y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("s").alias("s"))


def groups(rows: DataFrame, *, vocabulary: names.Vocabulary | None = None, threshold: float = 0.42, most: int = 1_000_000) -> DataFrame:
    """(field_name, upload_row_id, group_id): the rows that mean the same firm, or the same person of
    the same firm.

    Spellings are clustered once each, with the weight of their rows, so many rows of one spelling cost nothing. A component of up to
    ``most`` pairs is clustered in one task, in memory that grows with its pairs; larger ones by queries,
    with the same groups, a query for each round of merges. ``threshold`` is the cosine from which head words meet. The vocabulary is learned from the rows if none is given. A row delivered
    twice counts once. Rows with neither company nor name are left out; firms without a distinctive
    word, and persons without last name or firm, are groups of their own spelling.
    """
    vocabulary = vocabulary or names.learn(rows, rows)
    cuts = written(parts(rows, vocabulary), "parts")
    items = written(cuts.groupBy(*ITEM).agg(F.min("upload_row_id").alias("node"), F.count("*").alias("n")), "items")
    edges = written(similar(items, vocabulary, threshold), "similar")
    comps = graphs.components(edges.where(F.col("s") >= CUT), "x", "y")
    inner = edges.join(comps.select(F.col("node").alias("x"), F.col("component").alias("c")), "x").join(comps.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y").where("c = cy").drop("cy")
    inner = written(inner, "inner")
    large = inner.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > most).select("c")
    small = inner
    done = None
    if not large.isEmpty():
        small = inner.join(large, "c", "left_anti")
        done = linked_rounds(inner.join(large, "c", "left_semi"))
    # whole components share a task, as many as there are pairs for
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-inner.count() // most))
    grouped = small.groupBy(F.pmod(F.xxhash64("c"), F.lit(tasks)).alias("b")).applyInArrow(_cluster, "node long, group_id long")
    grouped = written(grouped if done is None else grouped.unionByName(done), "grouped")
    spelled = items.join(grouped, "node", "left").withColumn("group_id", F.coalesce("group_id", "node"))
    return cuts.join(spelled.drop("node", "n"), list(ITEM)).select("field_name", "upload_row_id", "group_id")


def pairs(rows: DataFrame, **options) -> DataFrame:
    """(field_name, row_a, row_b): all pairs of rows within a group of :func:`groups`, the smaller id first."""
    g = written(groups(rows, **options), "groups")
    a, b = g.select("field_name", "group_id", F.col("upload_row_id").alias("row_a")), g.select("field_name", "group_id", F.col("upload_row_id").alias("row_b"))
    return a.join(b, ["field_name", "group_id"]).where("row_a < row_b").select("field_name", "row_a", "row_b")
