"""Query plans of accounts, and bounded loops of search rounds over tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.session import written


def planned(accounts: DataFrame, templates: Sequence[tuple[str, str, bool]], most: int | None = None) -> DataFrame:
    """(account_id, position, label, query): each account's templates (label, text with {name}, {name_cn} and
    {domain}, for listed firms only) filled, blanks collapsed, the same query once whatever its case.

    Templates are some dozens of literals, so they stand in an array beside each account and no join is made.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("label"), F.lit(t).alias("t"), F.lit(p).alias("listed")) for i, (a, t, p) in enumerate(templates)])
    q = accounts.select("account_id", "name", "name_cn", "domain", "is_listed", F.explode(rows).alias("r")).where("not r.listed or is_listed")
    text = F.col("r.t")
    for c in ("name", "name_cn", "domain"):
        text = F.replace(text, F.lit("{" + c + "}"), F.coalesce(c, F.lit("")))
    q = q.select("account_id", F.col("r.i").alias("i"), F.col("r.label").alias("label"), T.stripped(F.regexp_replace(text, r"(?U)\s+", " ")).alias("query")).where("query != ''")
    one = q.withColumn("_n", F.row_number().over(Window.partitionBy("account_id", F.lower("query")).orderBy("i"))).where("_n = 1")
    out = one.select("account_id", F.row_number().over(Window.partitionBy("account_id").orderBy("i")).alias("position"), "label", "query")
    return out.where(F.col("position") <= most) if most else out


def merged_rows(left: DataFrame, right: DataFrame, key: str, left_owns: Sequence[str]) -> DataFrame:
    """A full outer merge: the left's value of its own columns, else the right's, each failing that the other's."""
    columns = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != key]
    j = left.alias("l").join(right.alias("r"), key, "full")
    side = lambda c: [F.col(f"{s}.{c}") for s in (("l", "r") if c in left_owns else ("r", "l")) if c in (left if s == "l" else right).columns]
    return j.select(key, *[F.coalesce(*side(c)).alias(c) for c in columns])


def rounds(plan: DataFrame, search: Callable[[DataFrame, int], DataFrame], enough: Callable[[DataFrame], DataFrame], *, batches: int = 2, size: int = 4) -> DataFrame:
    """(hits of all rounds, with the column round): searches ``size`` queries an account at a time, only for
    accounts that ``enough`` (account_id) does not name yet and whose last round brought something new.

    A round's hits are written out, so the plan stays short; the driver runs as many rounds as ``batches``.
    """
    hits = None
    for b in range(batches):
        part = plan.where((F.col("position") > b * size) & (F.col("position") <= (b + 1) * size))
        if hits is not None:
            last = hits.where(F.col("round") == b).select("account_id").distinct()
            part = part.join(enough(hits).select("account_id").distinct(), "account_id", "left_anti").join(last, "account_id", "left_semi")
        new = search(part, b).withColumn("round", F.lit(b + 1))
        if hits is not None:
            new = new.join(hits.select("account_id", T.url_key(F.col("url")).alias("_k")).distinct(), (new["account_id"] == hits["account_id"]) & (T.url_key(new["url"]) == F.col("_k")), "left_anti")
        new = written(new, "round")
        hits = new if hits is None else hits.unionByName(new)
    return hits


def waves(accounts: DataFrame, search: Callable[[DataFrame, int], DataFrame], usable: int, most: int = 3) -> DataFrame:
    """Search waves of which the next runs only for accounts with fewer than ``usable`` pages so far."""
    hits = written(search(accounts, 0).withColumn("wave", F.lit(1)), "wave")
    for w in range(1, most):
        rich = hits.groupBy("account_id").agg(F.count_distinct(T.url_key(F.col("url"))).alias("n")).where(F.col("n") >= usable)
        hits = hits.unionByName(written(search(accounts.join(rich, "account_id", "left_anti"), w).withColumn("wave", F.lit(w + 1)), "wave"))
    return hits


def summary_section(items: DataFrame, limitations: DataFrame, group: str, *, most_limits: int = 6, most_titles: int = 20, width: int = 110) -> DataFrame:
    """(group, section): counts, first limitations and titles of the evidence as a report section."""
    a = items.groupBy(group).agg(F.count("*").alias("n"), F.count_if("official").alias("o"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda x: F.concat(F.lit("- ["), x["id"].cast("string"), F.lit("] "), F.substring(F.coalesce(x["title"], F.lit("")), 1, width))), 1, most_titles).alias("t"))
    b = limitations.groupBy(group).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), 1, most_limits).alias("l"))
    j = a.join(b, group, "left")
    head = F.concat(F.lit("## Evidence\n"), F.col("n").cast("string"), F.lit(" sources, "), F.col("o").cast("string"), F.lit(" official"))
    return j.select(group, F.concat_ws("\n", head, F.array_join(F.coalesce("l", F.array().cast("array<string>")), "\n"), F.array_join("t", "\n")).alias("section"))
