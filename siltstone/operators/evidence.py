"""Evidence about accounts: judging hits, deduplicating, ranking, selecting under quotas.

Every operator works on many accounts at once, keyed by an account column. Vocabularies, host
lists and limits are arguments. Where the order of arrival matters a ``seq`` column carries it and
ends every ordering, so that results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.session import written


def judge_identity(hits: DataFrame, accounts: DataFrame, *, common: Sequence[str] = (), key: str = "account_id") -> DataFrame:
    """Hits with identity_ok and identity_reason: the first rung of a ladder that holds.

    accounts: key, name, name_cn, domain, aliases array, collisions array. The rungs: the account's own
    domain; a known collision, which only the Han name overrules; Han name; full name; an alias; the
    name without legal suffix; two of the name's words of which one is its own; one word of its own.
    Accounts are joined by key; a hit of an unknown account has no identity.
    """
    a = accounts.select(key, "name", "name_cn", "domain", "aliases", "collisions")
    h = hits.join(a, key, "left")
    h = h.withColumn("_hay", F.concat_ws(" ", "title", "site_name", "url")).withColumn("_spaced", T.spaced(F.col("_hay")))
    hay, low = F.col("_hay"), F.col("_spaced")
    # columns of their own, so that each is worked out once for a hit and not once for each rung
    none = F.array().cast("array<string>")
    h = h.withColumn("_own", T.distinctive_tokens(F.col("name"), common)).withColumn("_core", T.core_name(F.col("name"))).withColumn("_tokens", T.name_tokens(F.col("name"))).withColumn("_host", T.host(F.col("url")))
    h = h.withColumn("_clash", F.filter(F.coalesce("collisions", none), lambda c: F.contains(F.lower(hay), F.lower(c)))).withColumn("_alias", F.filter(F.coalesce("aliases", none), lambda x: T.mentions(hay, x, low)))
    h = h.withColumn("_matched", F.filter("_tokens", lambda t: T.mentions(hay, t, low))).withColumn("_hit", F.filter("_own", lambda t: T.mentions(hay, t, low)))
    own, clash, alias, core, matched, hit, host = (F.col(c) for c in ("_own", "_clash", "_alias", "_core", "_matched", "_hit", "_host"))
    has_cn = F.coalesce((F.col("name_cn") != "") & F.contains(hay, F.col("name_cn")), F.lit(False))
    rung = (
        F.when(T.host_under(F.col("url"), F.coalesce("domain", F.lit(""))), F.lit("official domain"))
        .when((F.size(clash) > 0) & ~has_cn, F.concat(F.lit("unrelated entity ("), F.array_join(F.slice(clash, 1, 2), ", "), F.lit(")")))
        .when(has_cn, F.lit("chinese-name match"))
        .when(T.mentions(hay, F.coalesce("name", F.lit("")), low), F.lit("full-name match"))
        .when(F.size(alias) > 0, F.concat(F.lit("alias match ("), F.get(alias, 0), F.lit(")")))
        .when((core != "") & (F.lower(core) != F.lower("name")) & T.mentions(hay, core, low), F.concat(F.lit("name match without legal suffix ("), core, F.lit(")")))
        .when((F.size(matched) >= 2) & F.exists(matched, lambda t: F.array_contains(own, t)), F.concat(F.lit("name tokens ("), F.array_join(F.slice(matched, 1, 3), ", "), F.lit(")")))
        .when((F.size(hit) > 0) & F.contains(F.regexp_replace(host, "[-.]", ""), F.get(hit, 0)), F.concat(F.lit("name token in host ("), F.get(hit, 0), F.lit(")")))
        .when(F.size(hit) > 0, F.concat(F.lit("distinctive name token ("), F.get(hit, 0), F.lit(")")))
        .otherwise(F.lit("no identity evidence"))
    )
    out = h.withColumn("identity_reason", rung).withColumn("identity_ok", ~F.col("identity_reason").rlike("^(unrelated entity|no identity evidence)"))
    return out.drop("name", "name_cn", "domain", "aliases", "collisions", "_hay", "_spaced", "_own", "_core", "_tokens", "_host", "_clash", "_alias", "_matched", "_hit")


def provenance(reason: Column) -> Column:
    """How a source relates to the account: the weakest accepted reason says only the market."""
    return F.when(F.startswith(reason, F.lit("verified partner")), "ecosystem").when(F.startswith(reason, F.lit("distinctive name token")), "market").otherwise("target")


def classify(url: Column, domain: Column, rules: Sequence[tuple[str, Sequence[str], int, str]], *, paths: Sequence[tuple[Sequence[str], int, str]] = (), own: tuple[int, str] = (1, "official-website"), other: tuple[int, str] = (6, "other-web-source")) -> Column:
    """struct(tier, source_type) by the first rule that holds.

    A rule is (how, words, tier, type); how is 'host' (the host is or lies under one of them),
    'in_host' or 'in_host_or_path' (holds one of them). On the account's own domain ``paths`` decide.
    """
    h, p = T.host(url), F.lower(T.path(url))

    def answer(tier: int, kind: str) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("source_type"))

    official = None
    for words, tier, kind in paths:
        official = (official if official is not None else F).when(T.has_any(p, words), answer(tier, kind))
    official = official.otherwise(answer(*own)) if official is not None else answer(*own)
    out = F.when(T.host_under(url, F.coalesce(domain, F.lit(""))), official)
    for how, words, tier, kind in rules:
        under = F.exists(F.array(*map(F.lit, words)), lambda w: (h == w) | F.endswith(h, F.concat(F.lit("."), w)))
        test = under if how == "host" else T.has_any(h, words) if how == "in_host" else T.has_any(h, words) | T.has_any(p, words)
        out = out.when(test, answer(tier, kind))
    return out.otherwise(answer(*other))


def category(url: Column, groups: Sequence[tuple[str, Sequence[str], bool]], other: str = "other") -> Column:
    """The first group (name, words, anywhere) whose words the host holds, or the address if anywhere."""
    h, low = T.host(url), F.lower(F.coalesce(url, F.lit("")))
    out = None
    for name, words, anywhere in groups:
        test = T.has_any(h, words) | T.has_any(low, words) if anywhere else T.has_any(h, words)
        out = (out if out is not None else F).when(test, F.lit(name))
    return out.otherwise(other)


def plausible(url: Column, deny: Sequence[str]) -> Column:
    """A host is there, and it is none of, nor under, the denied ones."""
    h = T.host(url)
    return (h != "") & ~F.exists(F.array(*map(F.lit, deny)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def dedupe_with_counters(hits: DataFrame, group: str, url: str, topic: str, seq: str) -> DataFrame:
    """One row for each page of a group: its first hit, how many hits it had, topics in first-seen order."""
    k = hits.withColumn("url_key", T.url_key(F.col(url)))
    rest = [c for c in hits.columns if c not in (group, topic)]
    agg = k.groupBy(group, "url_key").agg(
        F.min_by(F.struct(*rest), seq).alias("r"), F.count("*").alias("hits"), F.min_by(seq, seq).alias("first_seq"), F.collect_set(F.struct(F.col(seq).alias("s"), F.col(topic).alias("t"))).alias("st")
    )
    topics = F.array_distinct(F.transform(F.array_sort("st"), lambda x: x["t"]))
    return agg.select(group, "url_key", *[F.col(f"r.{c}").alias(c) for c in rest], "hits", F.filter(topics, lambda t: t.isNotNull()).alias("topics"))


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def category_rank(c: Column, order: Sequence[str], known: Sequence[str] = ("financial", "news", "other", "government")) -> Column:
    """The place in a configured order; categories that it lacks follow in their usual order."""
    full = [*order, *(k for k in known if k not in order)]
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(full) for x in (k, i)]), c), F.lit(len(full)))


def quota_with_backfill(rows: DataFrame, group: str, part: str, order: Sequence[Column], per_part: int, most: int) -> DataFrame:
    """Up to ``most`` rows of each group, at first ``per_part`` of each part, then the next best."""
    r = rows.withColumn("_p", F.row_number().over(Window.partitionBy(group, part).orderBy(*order)))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy((F.col("_p") > per_part).cast("int"), *order)))
    return r.where(F.col("_n") <= most).withColumn("backfilled", F.col("_p") > per_part).drop("_p", "_n")


_STATE = "struct<kept:array<struct<key:string,dom:string,i:int>>,low:int,deferred:array<int>,dropped:array<struct<i:int,why:string>>>"


def capped(rows: DataFrame, group: str, *, most: int = 16, per_domain: int = 8, low_tier: int = 6, low_budget: int = 6, low_if_strong: int = 2, strong: int = 5) -> DataFrame:
    """Every row with kept, id and drop_reason, as a walk in (tier, subrank, seq) order decides.

    First pass: a page once; at most ``most`` pages; a publisher with ``per_domain`` pages waits; rows
    of a low tier use a budget unless they are verified third-party ones. Second pass: those that wait,
    by the same rules. The budget is smaller with enough strong rows. The counters move only on
    acceptance, so the walk is a fold over each group's ordered rows; groups are the few dozen
    candidates of one account. Rows: url, tier, subrank, seq, content_verified, official.
    """
    r = rows.withColumn("_key", T.url_key(F.col("url"))).withColumn("_dom", T.registrable_domain(F.col("url")))
    # written once: the walk and its result both need these rows
    r = written(r.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy("tier", "subrank", "seq"))), "walk")
    lowly = (F.col("tier") >= low_tier) & ~(F.coalesce("content_verified", F.lit(False)) & ~F.coalesce("official", F.lit(False)))
    g = r.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_key").alias("key"), F.col("_dom").alias("dom"), lowly.alias("low")))).alias("rows"),
        F.when(F.count_if(F.col("tier") <= 2) >= strong, low_if_strong).otherwise(low_budget).alias("budget"),
    )
    admit = f"""CASE WHEN x.low AND s.low >= budget
        THEN named_struct('kept', s.kept, 'low', s.low, 'deferred', s.deferred, 'dropped', array_append(s.dropped, named_struct('i', x.i, 'why', 'low-tier budget')))
        ELSE named_struct('kept', array_append(s.kept, named_struct('key', x.key, 'dom', x.dom, 'i', x.i)), 'low', s.low + CAST(x.low AS INT), 'deferred', s.deferred, 'dropped', s.dropped) END"""
    full = "named_struct('kept', s.kept, 'low', s.low, 'deferred', s.deferred, 'dropped', array_append(s.dropped, named_struct('i', x.i, 'why', 'evidence cap')))"
    start = f"CAST(named_struct('kept', array(), 'low', 0, 'deferred', array(), 'dropped', array()) AS {_STATE})"
    first = f"""aggregate(rows, {start}, (s, x) -> CAST(CASE
        WHEN exists(s.kept, k -> k.key = x.key) THEN s
        WHEN size(s.kept) >= {most} THEN {full}
        WHEN size(filter(s.kept, k -> k.dom = x.dom)) >= {per_domain} THEN named_struct('kept', s.kept, 'low', s.low, 'deferred', array_append(s.deferred, x.i), 'dropped', s.dropped)
        ELSE {admit} END AS {_STATE}))"""
    second = f"""aggregate(filter(rows, r -> array_contains(p1.deferred, r.i)), p1, (s, x) -> CAST(CASE
        WHEN exists(s.kept, k -> k.key = x.key) THEN s
        WHEN size(s.kept) >= {most} THEN {full}
        ELSE {admit} END AS {_STATE}))"""
    done = g.withColumn("p1", F.expr(first)).withColumn("p2", F.expr(second))
    kept = done.select(group, F.explode(F.expr("transform(array_sort(transform(p2.kept, k -> k.i)), (i, n) -> struct(i AS _i, n + 1 AS id))")).alias("k")).select(group, "k._i", "k.id")
    lost = done.select(group, F.explode("p2.dropped").alias("d")).select(group, F.col("d.i").alias("_i"), F.col("d.why").alias("drop_reason"))
    out = r.join(kept, [group, "_i"], "left").join(lost, [group, "_i"], "left")
    return out.withColumn("kept", F.col("id").isNotNull()).withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("id").isNull(), F.lit("duplicate")))).drop("_key", "_dom", "_i")


def slate(rows: DataFrame, group: str, order: Sequence[Column], *, pages: int = 20, low_tier: int = 6, low_attempts: int = 12) -> DataFrame:
    """The pages to try: the first ``pages`` after rows of a low tier beyond ``low_attempts`` are skipped."""
    w = Window.partitionBy(group, (F.col("tier") >= low_tier).cast("int")).orderBy(*order)
    r = rows.withColumn("_l", F.row_number().over(w)).where((F.col("tier") < low_tier) | (F.col("_l") <= low_attempts))
    return r.withColumn("slate_no", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("slate_no") <= pages).drop("_l")


def admitted(rows: DataFrame, group: str, order: Sequence[Column], *, text: str = "page_text", least: int = 120, low_tier: int = 6, low_most: int = 6, most: int = 16, budgets: Sequence[int] = (5000, 4000, 2500, 2000, 1600, 900)) -> DataFrame:
    """Readable pages in order, few of a low tier, ``most`` in all, texts cut to their tier's budget."""
    r = rows.where(F.length(F.coalesce(text, F.lit(""))) >= least)
    r = r.withColumn("_l", F.row_number().over(Window.partitionBy(group, (F.col("tier") >= low_tier).cast("int")).orderBy(*order))).where((F.col("tier") < low_tier) | (F.col("_l") <= low_most))
    r = r.withColumn("id", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("id") <= most)
    size = F.coalesce(F.get(F.array(*map(F.lit, budgets)), F.col("tier") - 1), F.lit(budgets[-1]))
    return r.withColumn("text", F.substr(F.col(text), F.lit(1), size)).drop("_l")


def first_seen(rows: DataFrame, keys: Sequence[Column], seq: Column) -> DataFrame:
    """The first row of each key; a window, so that a whole row is kept and ties end on ``seq``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def inserted(rows: DataFrame, newcomers: DataFrame, group: str, *, most: int = 16) -> DataFrame:
    """Rows with one newcomer for each group placed by (tier, subrank), ids renumbered.

    In a full group the first row of the worst rank makes way if the newcomer is strictly better;
    otherwise the newcomer stays out. A newcomer stands before the first row that is worse than it.
    """
    n = rows.groupBy(group).agg(F.count("*").alias("_n"), F.max(F.struct("tier", "subrank")).alias("_worst"))
    place = newcomers.join(n, group, "left").withColumn("_out", (F.col("_n") >= most) & (F.col("_worst") <= F.struct("tier", "subrank")))
    enter = place.where(~F.coalesce("_out", F.lit(False)))
    evict = enter.where(F.col("_n") >= most).select(group, F.col("_worst.tier").alias("tier"), F.col("_worst.subrank").alias("subrank"))
    victim = rows.join(evict, [group, "tier", "subrank"]).groupBy(group).agg(F.min("id").alias("id"))
    left = rows.join(victim, [group, "id"], "left_anti").withColumn("_new", F.lit(1))
    both = left.unionByName(enter.drop("_n", "_worst", "_out").withColumn("_new", F.lit(2)), allowMissingColumns=True)
    # rows of the newcomer's own rank stay before it
    return both.withColumn("id", F.row_number().over(Window.partitionBy(group).orderBy("tier", "subrank", "_new", "id"))).drop("_new")


def sufficiency(rows: DataFrame, group: str, *, third_party: int = 4, hosts: int = 3, categories: int = 2) -> DataFrame:
    """Counts of a group's kept rows and whether they are broad enough. Rows: url, domain, category, topics."""
    third = ~T.host_under(F.col("url"), F.coalesce("domain", F.lit("")))
    dom = F.nullif(T.registrable_domain(F.col("url")), F.lit(""))
    out = rows.groupBy(group).agg(
        F.count("*").alias("retained"), F.count_if(third).alias("third_party"), F.count_distinct(F.when(third, dom)).alias("third_party_hosts"),
        F.count_distinct(F.when(third, F.col("category"))).alias("categories"), F.size(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"),
    )
    return out.withColumn("enough", (F.col("third_party") >= third_party) & (F.col("third_party_hosts") >= hosts) & (F.col("categories") >= categories))


def quality(rows: DataFrame, group: str, *, overview: Sequence[str], products: Sequence[str], levels: Sequence[tuple[int, str]] = ((8, "strong"), (5, "acceptable"), (2, "weak"))) -> DataFrame:
    """What a group has, its level and what it lacks. Rows: text, official, section."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    sect = F.coalesce("section", F.lit(""))
    g = rows.groupBy(group).agg(
        F.count("*").alias("sources"), F.count_if("official").alias("official_sources"),
        F.coalesce(F.bool_or((hits(overview) >= 1) | sect.isin("homepage", "about")), F.lit(False)).alias("overview_evidence"),
        F.coalesce(F.bool_or((hits(products) >= 2) | (sect == "products")), F.lit(False)).alias("products_evidence"),
    )
    level = None
    for n, name in levels:
        level = (level if level is not None else F).when(F.col("sources") >= n, F.lit(name))
    g = g.withColumn("level", level.otherwise("insufficient"))
    weak = F.col("level").isin("weak", "insufficient")
    reasons = F.array_compact(F.array(
        F.when(F.col("official_sources") == 0, F.lit("no official source")), F.when(~F.col("overview_evidence"), F.lit("no overview")),
        F.when(~F.col("products_evidence"), F.lit("no products")), F.when(weak, F.concat(F.lit("only "), F.col("sources").cast("string"), F.lit(" sources"))),
    ))
    return g.withColumn("reasons", reasons).withColumn("needs_fallback", weak | ~(F.col("overview_evidence") & F.col("products_evidence")))


def adaptive_batches(rows: DataFrame, group: str, order: Sequence[Column], *, batch: int = 10, most: int = 30, third_party: int = 4, hosts: int = 3) -> DataFrame:
    """(group, batches, fetched, stop_reason): how many batches of an ordered queue are fetched until the
    verified ones suffice. Cumulative counts give every prefix at once. Rows: verified, publisher."""
    r = rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    over = r.where(F.col("n") > most).select(group).distinct().withColumn("_more", F.lit(True))
    r = r.where(F.col("n") <= most)
    first = F.min(F.when(F.col("verified"), F.col("n"))).over(Window.partitionBy(group, "publisher"))
    r = r.withColumn("b", F.ceil(F.col("n") / batch)).withColumn("_new", (F.col("verified") & (F.col("n") == first)).cast("int"))
    per = r.groupBy(group, "b").agg(F.count("*").alias("rows"), F.count_if("verified").alias("v"), F.sum("_new").alias("h"))
    w = Window.partitionBy(group).orderBy("b")
    run = per.withColumn("fetched", F.sum("rows").over(w)).withColumn("cv", F.sum("v").over(w)).withColumn("ch", F.sum("h").over(w))
    ok = (F.col("cv") >= third_party) & (F.col("ch") >= hosts)
    done = run.groupBy(group).agg(F.min(F.when(ok, F.col("b"))).alias("_b"), F.max("b").alias("_last"), F.map_from_entries(F.collect_list(F.struct("b", "fetched"))).alias("_f"))
    b = F.coalesce("_b", "_last")
    done = done.join(over, group, "left")
    return done.select(group, b.cast("int").alias("batches"), F.element_at("_f", b).alias("fetched"), F.when(F.col("_b").isNotNull(), "sufficient").when(F.coalesce("_more", F.lit(False)), "ceiling").otherwise("queue empty").alias("stop_reason"))
