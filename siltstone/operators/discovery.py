"""Organisations that evidence names: whether they are ones, how they are tied to the account."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

ORG_SUFFIXES = ("inc", "corp", "corporation", "llc", "ltd", "gmbh", "ag", "group", "company", "co", "plc", "labs", "works")
PLACEHOLDERS = ("", "n/a", "na", "none", "unknown", "tbd", "various", "other", "others", "undisclosed", "unnamed", "-", "—")


def is_named_organisation(name: Column, category_words: Sequence[str], suffixes: Sequence[str] = ORG_SUFFIXES) -> Column:
    """Whether a text is a firm's name and not a category: 2 to 60 characters, not of category words
    alone, and a Han name, or a capitalised word of its own, or a legal suffix behind another word."""
    c = F.regexp_replace(F.coalesce(name, F.lit("")), r"^[ .,:;·、，]+|[ .,:;·、，]+$", "")
    words = F.filter(F.split(F.lower(c), r"[\s/&,\-]+"), lambda w: w != "")
    raw = F.filter(F.split(c, r"[\s/&,\-()]+"), lambda w: w != "")
    cat = F.array(*map(F.lit, category_words)).cast("array<string>")
    proper = F.exists(raw, lambda w: w.rlike(r"^\p{Lu}") & ~F.array_contains(cat, F.lower(w)) & ~F.array_contains(cat, F.regexp_replace(F.lower(w), "s+$", "")))
    suffix = (F.size(words) > 1) & F.coalesce(F.element_at(words, -1).isin(*suffixes), F.lit(False))
    return F.length(c).between(2, 60) & (F.size(words) > 0) & ~F.forall(words, lambda w: F.array_contains(cat, w)) & (c.rlike(T.CJK) | proper | suffix)


def is_the_account(name: Column, own: Column) -> Column:
    """Whether a name is one of the account's own: its key equals, begins or holds one of theirs."""
    k = T.org_key(name)
    return F.exists(F.transform(own, T.org_key), lambda o: (o != "") & (k != "") & ((k == o) | F.startswith(k, o) | F.startswith(o, k) & (F.length(k) >= 3) | F.contains(o, k) & (F.length(k) >= 3)))


def clearly_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def guarded(rows: DataFrame, group: str, *, own: Column, valid: Column, cited: Column, supported: Column, name: str = "name", seq: str = "seq") -> DataFrame:
    """Rows with drop_reason: null for those that stand, else the first guard that failed, in the order
    schema, placeholder, self, uncited, unsupported, duplicate."""
    n = F.lower(T.stripped(F.coalesce(F.col(name), F.lit(""))))
    r = rows.withColumn("drop_reason", F.when(~F.coalesce(valid, F.lit(False)), "schema").when(n.isin(*PLACEHOLDERS), "placeholder").when(is_the_account(F.col(name), own), "self").when(~F.coalesce(cited, F.lit(False)), "uncited").when(~F.coalesce(supported, F.lit(False)), "unsupported"))
    w = Window.partitionBy(group, T.org_key(F.col(name)), F.col("drop_reason").isNull()).orderBy(seq)
    return r.withColumn("_n", F.row_number().over(w)).withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.col("_n") > 1), "duplicate").otherwise(F.col("drop_reason"))).drop("_n")


def drop_counts(rows: DataFrame, group: str) -> DataFrame:
    """(group, proposed, published, and one column for each reason)."""
    reasons = ("schema", "placeholder", "self", "uncited", "unsupported", "duplicate")
    return rows.groupBy(group).agg(F.count("*").alias("proposed"), F.count_if(F.col("drop_reason").isNull()).alias("published"), *[F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in reasons])


def relationship(text: Column, names: Column, relation: str, hedge: str) -> Column:
    """MARKET_ONLY unless the text names the account and asserts a relation; STRONG_INDICATION if it
    hedges, else CONFIRMED. The patterns are arguments."""
    t = F.coalesce(text, F.lit(""))
    named = F.exists(names, lambda n: F.when(n.rlike(r"^[\x00-\x7f]*$"), T.mentions(t, n)).otherwise(F.contains(t, n)))
    return F.when(~F.coalesce(named, F.lit(False)) | ~t.rlike(f"(?i){relation}"), "MARKET_ONLY").when(t.rlike(f"(?i){hedge}"), "STRONG_INDICATION").otherwise("CONFIRMED")


def promoted(pages: DataFrame, group: str, entity: str, cue: str, *, per_page: int = 6, per_group: int = 24) -> DataFrame:
    """(group, entity, url, cue): names that stand in verified pages with a cue; each once, with its first
    proof by seq, ``per_page`` of a page and ``per_group`` of a group at most (limits are the feature)."""
    hit = pages.where(F.col("text").rlike(f"(?i){cue}")).select(group, "seq", "url", F.regexp_extract("text", f"(?i)({cue})", 1).alias("cue"), F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(entity), F.lit(1)))).alias("pos", "entity"))
    one = hit.withColumn("_n", F.row_number().over(Window.partitionBy(group, F.lower("entity")).orderBy("seq", "pos"))).where("_n = 1")
    page = one.withColumn("_p", F.row_number().over(Window.partitionBy(group, "seq").orderBy("pos"))).where(F.col("_p") <= per_page)
    return page.withColumn("_g", F.row_number().over(Window.partitionBy(group).orderBy("seq", "pos"))).where(F.col("_g") <= per_group).select(group, "entity", "url", "cue")


def ids_to_urls(rows: DataFrame, sources: DataFrame, group: str, key: str, ids: str = "evidence_ids") -> DataFrame:
    """Rows with source_urls, the addresses of their cited ids in the order of citation; unknown ids are left out."""
    cited = rows.select(group, key, F.posexplode(ids).alias("pos", "id")).join(sources.select(group, "id", "url"), [group, "id"])
    urls = cited.groupBy(group, key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("source_urls"))
    return rows.join(urls, [group, key], "left").withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))


def ticker_lookup(accounts: DataFrame, tickers: DataFrame, *, share: float = 0.6) -> DataFrame:
    """(account_id, ticker, listed_name, method): the entry of the same normalised name, else the one with
    the fewest words that has all of the account's words with these at least ``share`` of its own.

    Candidates meet on the account's rarest word, so that no pair without a shared word is formed.
    """
    norm = lambda c: F.array_join(T.name_tokens(T.core_name(F.col(c))), " ")
    a = accounts.select("account_id", norm("name").alias("k"), F.array_distinct(T.name_tokens(T.core_name(F.col("name")))).alias("w")).where("k != ''")
    t = tickers.select("ticker", F.col("title").alias("listed_name"), norm("title").alias("k"), F.array_distinct(T.name_tokens(T.core_name(F.col("title")))).alias("tw")).where("k != ''")
    exact = a.join(t, "k").groupBy("account_id").agg(F.min(F.struct("listed_name", "ticker")).alias("x"), F.lit("exact").alias("method"))
    freq = t.select(F.explode("tw").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rare = a.select("account_id", "w", F.explode("w").alias("word")).join(freq, "word").groupBy("account_id").agg(F.min(F.struct("n", "word")).alias("r"), F.first("w").alias("w")).select("account_id", "w", F.col("r.word").alias("word"))
    near = rare.join(t.select("ticker", "listed_name", "tw", F.explode("tw").alias("word")), "word").where((F.size(F.array_except("w", "tw")) == 0) & (F.size("w") / F.size("tw") >= share))
    near = near.groupBy("account_id").agg(F.min(F.struct(F.size("tw").alias("s"), F.col("listed_name"), F.col("ticker"))).alias("x"), F.lit("words").alias("method"))
    both = exact.select("account_id", "x.ticker", "x.listed_name", "method").unionByName(near.join(exact, "account_id", "left_anti").select("account_id", "x.ticker", "x.listed_name", "method"))
    return both


def headline_fits(headline: Column, name: Column) -> Column:
    """Whether a quote page's headline shares a word with the account's name."""
    return F.arrays_overlap(T.name_tokens(T.core_name(name)), T.name_tokens(headline))


# Words that stand where a name of an organisation should, and verbs of headlines.
NO_ORGANISATIONS = (
    "undisclosed", "unidentified", "unnamed", "unspecified", "unknown", "anonymous", "confidential", "undetermined", "various", "n/a", "none", "not applicable", "not disclosed", "tbc", "tbd", "multiple", "several", "competitor", "distributor", "reseller",
    "representative", "supplier", "company profile", "about us", "home", "terms", "conditions", "directory", "listing", "list", "guide", "overview", "profile", "page", "top", "best", "leading", "other", "others",
)
HEADLINE_VERBS = ("acquire", "acquires", "acquired", "announce", "announces", "launch", "launches", "report", "reports", "win", "wins", "open", "opens", "expand", "expands", "name", "names", "appoint", "appoints", "complete", "completes", "introduce", "introduces", "unveil", "unveils")


def is_proposed_organisation(name: Column, fillers: Sequence[str] = NO_ORGANISATIONS, verbs: Sequence[str] = HEADLINE_VERBS) -> Column:
    """Whether a proposed name can be an organisation's: no filler as a whole, as its first word or in all its
    words, no headline, no address, 2 to 120 characters and at most eight words."""
    t = T.stripped(F.coalesce(name, F.lit("")))
    low = T.stripped(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]+", " "))
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    small = F.forall(words, lambda w: w.isin(*fillers, "of", "and", "the", "for", "in"))
    headline = F.exists(F.filter(F.split(F.lower(t), r"(?U)\W+"), lambda w: w != ""), lambda w: w.isin(*verbs))
    address = F.startswith(t, F.lit("http://")) | F.startswith(t, F.lit("https://")) | F.startswith(t, F.lit("www.")) | (F.regexp_count(t, F.lit("/")) >= 2)
    filler = low.isin(*fillers) | F.get(words, 0).isin(*fillers) | small
    return F.length(t).between(2, 120) & (F.size(words) > 0) & ~filler & ~headline & ~address & (F.size(F.split(t, r"(?U)\s+")) <= 8)


def useful_coverage(rows: DataFrame, group: str, *, grade: str, good: Sequence[str], category: str, domain: str, organisations: int = 2, categories: int = 2, domains: int = 2) -> DataFrame:
    """(group) whose evidence is broad enough to stop: enough well-graded rows, categories and domains."""
    g = rows.groupBy(group).agg(F.count_if(F.col(grade).isin(*good)).alias("o"), F.count_distinct(category).alias("c"), F.count_distinct(domain).alias("d"))
    return g.where((F.col("o") >= organisations) & (F.col("c") >= categories) & (F.col("d") >= domains)).select(group)


def listing(accounts: DataFrame, listings: DataFrame) -> DataFrame:
    """(account_id, ticker, how): a typed ticker, else the listing of the name, else of the name in the other
    script; a listing counts if its headline shares a word with the name. Accounts without one have nulls."""
    known = listings.select(T.org_key(F.col("title")).alias("k"), "title", "ticker").where("k != ''").groupBy("k").agg(F.min_by(F.struct("title", "ticker"), "ticker").alias("x"))
    a = accounts.select("account_id", "name", "name_cn", T.explicit_ticker(F.col("name")).alias("typed"), T.org_key(F.regexp_replace("name", r"[(\[][^)\]]*[)\]]", "")).alias("k1"), F.nullif(T.org_key(F.col("name_cn")), F.lit("")).alias("k2"))
    j = a.join(known.select(F.col("k").alias("k1"), F.col("x").alias("by_name")), "k1", "left").join(known.select(F.col("k").alias("k2"), F.col("x").alias("by_other")), "k2", "left")
    first = F.when(headline_fits(F.col("by_name.title"), F.col("name")), F.col("by_name.ticker"))
    ticker = F.coalesce("typed", first, F.col("by_other.ticker"))
    how = F.when(F.col("typed").isNotNull(), "typed").when(first.isNotNull(), "name").when(F.col("by_other.ticker").isNotNull(), "other script")
    return j.select("account_id", ticker.alias("ticker"), how.alias("how"))
