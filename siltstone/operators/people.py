"""Persons of an account: title scores, merging of sources, roster selection and summary."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.evidence import quota_with_backfill


def title_score(title: Column, seniority: Column, rules: Sequence[tuple[int, str, str]], excluded: str, bonus: dict[str, int]) -> Column:
    """struct(score, department) by the first rule (score, department, pattern) that a title matches in
    either word order; 0 and empty if an excluded word stands in it or none matches."""
    variants = F.concat(T.title_variants(title), F.array(F.coalesce(title, F.lit(""))))
    extra = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in bonus.items() for x in kv]), F.lower(F.coalesce(seniority, F.lit("")))), F.lit(0)) if bonus else F.lit(0)
    nothing = F.struct(F.lit(0).alias("score"), F.lit("").alias("department"))
    out = F.when(F.exists(variants, lambda v: v.rlike(f"(?i){excluded}")), nothing)

    def matches(pattern: str) -> Column:
        return F.exists(variants, lambda v: v.rlike(f"(?i){pattern}"))

    for score, department, pattern in rules:
        out = out.when(matches(pattern), F.struct((F.lit(score) + extra).alias("score"), F.lit(department).alias("department")))
    return out.otherwise(nothing)


def scored_people(people: DataFrame, rules: Sequence[tuple[int, str, str]], excluded: str, bonus: dict[str, int]) -> DataFrame:
    """People with score and department, those of score 0 or less left out."""
    s = people.withColumn("_s", title_score(F.col("title"), F.col("seniority"), rules, excluded, bonus))
    return s.withColumn("score", F.col("_s.score")).withColumn("department", F.coalesce(F.nullif(F.col("_s.department"), F.lit("")), F.col("department") if "department" in people.columns else F.lit(""))).drop("_s").where("score > 0")


def joined_enrichment(people: DataFrame, enriched: DataFrame, fields: Sequence[str]) -> DataFrame:
    """People with empty fields filled from enriched rows of the same person_id, else of the same name."""
    by_id = enriched.where("person_id is not null").dropDuplicates(["person_id"]).select("person_id", *[F.col(f).alias(f"_i_{f}") for f in fields])
    by_name = enriched.withColumn("_k", F.lower("name")).where("_k is not null").groupBy("_k").agg(*[F.min_by(f, "person_id").alias(f"_n_{f}") for f in fields])
    j = people.withColumn("_k", F.lower("name")).join(by_id, "person_id", "left").join(by_name, "_k", "left")
    for f in fields:
        j = j.withColumn(f, F.coalesce(T.blank_to_null(F.col(f)), F.col(f"_i_{f}"), F.col(f"_n_{f}")))
    return j.select(*people.columns)


def organisation_matches(ours: Column, theirs: Column, share: float = 0.6) -> Column:
    """Whether enough of our distinctive words stand in their name."""
    a = F.array_distinct(ours)
    return F.when(F.size(a) == 0, F.lit(False)).otherwise(F.size(F.array_intersect(a, theirs)) / F.size(a) >= share)


MERGE_FIELDS = ("name", "title", "department", "linkedin_url", "email", "email_status", "company", "location")


def merged_roster(rows: DataFrame, group: str = "account_id") -> DataFrame:
    """One row for each person of a group from several sources in order of ``seq``.

    The first of a row's keys (mail, profile, name and company) that an earlier row has decides with
    whom it merges; failing that, the same name with no conflicting company. This is greedy and not
    a transitive closure: a row that fits two records joins only the first. Blank fields are filled,
    a CRM row's own fields win, the score is the larger one. The fold needs its order, so a group is
    folded in one task; a roster has some hundred rows at most. Null and blank are alike.
    """
    keyed = rows.select(
        group, "seq", "source", *MERGE_FIELDS, F.coalesce("score", F.lit(0)).cast("long").alias("score"),
        F.lower(F.coalesce(T.clean_email(F.col("email")), F.lit(""))).alias("_mail"), T.linkedin_key(F.col("linkedin_url")).alias("_link"),
        T.person_key(F.col("name")).alias("_name"), T.org_key(F.col("company")).alias("_firm"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join([f"{group} {kinds[group]}", *[f"{f} string" for f in MERGE_FIELDS], "score long", "sources array<string>", "corroborated boolean", "first_seq long"])

    def fold(t: pa.Table) -> pa.Table:
        people: list[dict] = []
        seen: dict[tuple, int] = {}
        by_name: dict[str, list[int]] = {}
        for r in sorted(t.to_pylist(), key=lambda r: r["seq"]):
            text = {f: r[f] or "" for f in MERGE_FIELDS}
            keys = [(k, v) for k, v in (("m", r["_mail"]), ("l", r["_link"]), ("n", r["_name"] and r["_firm"] and f"{r['_name']}|{r['_firm']}")) if v]
            at = next((seen[k] for k in keys if k in seen), None)
            if at is None and r["_name"]:
                at = next((i for i in by_name.get(r["_name"], ()) if not r["_firm"] or not people[i]["_firm"] or people[i]["_firm"] == r["_firm"]), None)
            if at is None:
                at = len(people)
                people.append({group: r[group], **text, "score": r["score"], "sources": [], "_firm": r["_firm"], "first_seq": r["seq"]})
                if r["_name"]:
                    by_name.setdefault(r["_name"], []).append(at)
            p = people[at]
            for f in MERGE_FIELDS:
                if text[f] and (not p[f] or r["source"] == "CRM"):
                    p[f] = text[f]
            p["score"] = max(p["score"], r["score"])
            p["_firm"] = p["_firm"] or r["_firm"]
            if r["source"] not in p["sources"]:
                p["sources"].append(r["source"])
            for k in keys:
                seen.setdefault(k, at)
        for p in people:
            p["corroborated"] = len(p["sources"]) > 1
        kinds = [(group, t.schema.field(group).type), *((f, pa.string()) for f in MERGE_FIELDS), ("score", pa.int64()), ("sources", pa.list_(pa.string())), ("corroborated", pa.bool_()), ("first_seq", pa.int64())]
        return pa.table({n: pa.array([p[n] for p in people], k) for n, k in kinds})

    return keyed.groupBy(group).applyInArrow(fold, schema)


def diverse_roster(people: DataFrame, group: str, *, per_department: int = 4, most: int = 20) -> DataFrame:
    """The best people of a group, at first few of each department; ties by corroboration, then name."""
    order = [F.desc("score"), (~F.coalesce("corroborated", F.lit(False))).cast("int"), F.col("name"), F.col("first_seq")]
    return quota_with_backfill(people, group, "department", order, per_department, most)


def roster_summary(people: DataFrame, group: str) -> DataFrame:
    """Counts of a roster by source, its departments, and how many have a (verified) mail."""
    one = lambda s: (F.size("sources") == 1) & F.array_contains("sources", s)
    return people.groupBy(group).agg(
        F.count("*").alias("total"), F.count_if(one("Directory")).alias("directory_only"), F.count_if(one("Web")).alias("web_only"), F.count_if(F.size("sources") > 1).alias("merged"),
        F.array_sort(F.collect_set(F.nullif("department", F.lit("")))).alias("departments"),
        F.count_if(F.coalesce("email", F.lit("")) != "").alias("with_email"), F.count_if(F.lower(F.coalesce("email_status", F.lit(""))) == "verified").alias("verified_email"),
    )


def roster_markdown(people: DataFrame, group: str) -> DataFrame:
    """(group, markdown): a pipe table of each roster, best first."""
    cell = lambda c: F.replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")), F.lit("|"), F.lit("/"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("name"), cell("title"), cell("department"), cell("email")), F.lit(" |"))
    rows = people.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("name").alias("n"), line.alias("l")))).alias("r"))
    head = "| Name | Title | Department | Mail |\n| --- | --- | --- | --- |"
    return rows.select(group, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("markdown"))


def contact_outcome(runs: DataFrame) -> DataFrame:
    """(account_id, outcome, is_warning) of runs (account_id, supplied, from_crm, from_directory, merged, status):
    which side of the contact search brought something, and if none did, why."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    why = F.coalesce(F.nullif("status", F.lit("")), F.lit("no result"))
    crm, other = n("from_crm"), n("from_directory")
    cases = (
        (F.col("status") == "skipped_crm_sufficient", False, F.format_string("%d CRM contact(s) found, %d relevant, directory not needed", n("supplied"), crm)),
        ((crm > 0) & (other > 0), False, F.format_string("%d CRM contact(s) and %d of the directory, %d after merge", crm, other, n("merged"))),
        ((crm > 0) & F.coalesce(F.col("status").isin("ok", "no_people"), F.lit(False)), False, F.format_string("%d CRM contact(s), the directory added none", crm)),
        (crm > 0, True, F.format_string("%d CRM contact(s) kept, directory unavailable (%s)", crm, why)),
        (other > 0, False, F.format_string("no CRM contacts, %d of the directory", other)),
        (F.col("status") == "not_configured", True, F.lit("no CRM contacts and no directory configured")),
        (n("supplied") == 0, True, F.format_string("no CRM contacts matched and the directory returned none (%s)", why)),
        (F.lit(True), True, F.format_string("%d CRM contact(s) supplied but none relevant, the directory returned none (%s)", n("supplied"), why)),
    )
    text, warn = None, None
    for when, bad, said in cases:
        text = (F if text is None else text).when(F.coalesce(when, F.lit(False)), said)
        warn = (F if warn is None else warn).when(F.coalesce(when, F.lit(False)), F.lit(bad))
    return runs.select("account_id", text.alias("outcome"), warn.alias("is_warning"))


def channel_block(accounts: DataFrame, found: DataFrame, group: str, most_label: str = "none found") -> DataFrame:
    """(group, block): the found names one a line in order; where the search did not run the reason, which is
    not the same as a search that found none. accounts: (group, skip_reason); found: (group, seq, name)."""
    names = found.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("b"))
    skipped = F.when(F.coalesce("skip_reason", F.lit("")) != "", F.concat(F.lit("not searched: "), "skip_reason"))
    return accounts.join(names, group, "left").select(group, F.coalesce("b", skipped, F.lit(most_label)).alias("block"))
