"""Further queries, one for each operator that the evidence queries leave out, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import discovery, evidence, people, rollups
from siltstone.plans import planning
from siltstone.queries.evidence import _DOMAIN, _H, _KEY
from siltstone.session import table
from siltstone.sinks import tables
from siltstone.sources import pages, records, uploads


QUERIES: dict = {}
SQL: dict[str, str] = {}
_B = r"[\s\pZ]"
_S = f"regexp_replace({{0}}, '^{_B}+|{_B}+$', '', 'g')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_STEM = f"list_filter(regexp_split_to_array(split_part({_DOMAIN}, '.', 1), '[-_]'), lambda p: length(p) >= 4)"


@query(f"SELECT array_to_string({_STEM}, '+') AS stems, count(*) AS n FROM gapfill_sources GROUP BY 1")
def domain_stems(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "gapfill_sources").groupBy(F.array_join(T.domain_stems(F.col("url")), "+").alias("stems")).agg(F.count("*").alias("n"))


@query(f"SELECT p.page_id, count(*) AS domains FROM (SELECT DISTINCT page_id, url FROM fetched_pages) p JOIN (SELECT DISTINCT {_DOMAIN} AS o FROM gapfill_sources WHERE {_DOMAIN} <> '') q ON {_H} = q.o OR suffix({_H}, '.' || q.o) GROUP BY 1")
def pages_under_domains(s: SparkSession, d: str) -> DataFrame:
    # a host lies under each of its own endings, so the join is one of equal keys
    p = table(s, d, "fetched_pages").select("page_id", "url").distinct().withColumn("labels", F.split(T.host(F.col("url")), r"\."))
    ends = p.select("page_id", "url", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice(F.col("labels"), i, F.size("labels")), "."))).alias("o"))
    q = table(s, d, "gapfill_sources").select(T.registrable_domain(F.col("url")).alias("o")).where("o != ''").distinct()
    return ends.join(q, "o").where(T.host_under(F.col("url"), F.col("o"))).groupBy("page_id").agg(F.count("*").alias("domains"))


@query(f"SELECT DISTINCT company, coalesce(p[1], '') AS name, coalesce(list_filter(p[2:], lambda x: regexp_matches(x, '[一-鿿]'))[1], CASE WHEN regexp_matches(p[1], '[一-鿿]') THEN p[1] END, '') AS name_cn FROM (SELECT company, list_filter(list_transform(string_split(coalesce(company, ''), '/'), lambda x: {_S.format('x')}), lambda x: x <> '') AS p FROM batch_items)")
def split_companies(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "batch_items").select("company").distinct()
    return b.select("company", T.split_company(F.col("company")).alias("c")).select("company", "c.name", "c.name_cn")


_SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {0}), ''), 'item')"


@query(f"SELECT DISTINCT {_SLUG.format(40)} AS s40, {_SLUG.format(48)} AS s48, {_SLUG.format(24)} AS s24 FROM batch_items WHERE NOT regexp_matches(company, '[^\\x00-\\x{{24f}}一-鿿]') OR company IS NULL")
def slugs(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "batch_items").where("company is null or not company rlike '[^\\\\x00-\\\\x{24f}一-鿿]'")
    return b.select(*[T.slug(F.col("company"), n).alias(f"s{n}") for n in (40, 48, 24)]).distinct()


@query(f"SELECT e AS email, count(*) AS n FROM (SELECT CASE WHEN contains(lower({_S.format('email')}), '@') AND NOT regexp_matches(lower({_S.format('email')}), 'not_unlocked|placeholder|^none$|^n/a$') THEN lower({_S.format('email')}) END AS e FROM directory_people) GROUP BY 1")
def clean_emails(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "directory_people").groupBy(T.clean_email(F.col("email")).alias("email")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN list_contains(['n/a', 'na', 'none', 'null', 'unknown', 'tbd', '-', '--', '—'], lower({_S.format('coalesce(department, chr(32))')})) THEN '' ELSE {_S.format('coalesce(department, chr(32))')} END AS department, count(*) AS n FROM crm_contacts GROUP BY 1")
def departments_without_placeholders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crm_contacts").groupBy(T.placeholder_to_empty(F.col("department")).alias("department")).agg(F.count("*").alias("n"))


@query(f"SELECT substr(CASE WHEN w = '' OR regexp_matches(w, '^(?i)https?://') THEN w ELSE 'https://' || w END, 1, 500) AS website, count(*) AS n FROM (SELECT {_S.format('coalesce(website, chr(32))')} AS w FROM batch_items) GROUP BY 1")
def websites_with_scheme(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "batch_items").groupBy(T.website(F.col("website")).alias("website")).agg(F.count("*").alias("n"))


@query(f"SELECT result_id, row_number() OVER (PARTITION BY result_id ORDER BY source_index, source_id) - 1 AS pos, {_S.format('title')} AS title, {_S.format('url')} AS url FROM (SELECT DISTINCT result_id, source_index, source_id, title, url FROM gapfill_sources WHERE title IS NOT NULL AND NOT regexp_matches(title, '[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{85}}\\x{{2028}}\\x{{2029}}]') AND regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[\\x21-\\x7e]+\\z'))")
def replies_parsed(s: SparkSession, d: str) -> DataFrame:
    """Replies as the search tool prints them, put together from their sources and parsed again."""
    src = table(s, d, "gapfill_sources").select("result_id", "source_index", "source_id", "title", "url").distinct()
    src = src.where("title is not null and not title rlike '[\\\\n\\\\r\\\\x0b\\\\x0c\\\\x{85}\\\\x{2028}\\\\x{2029}]' and url rlike '^[Hh][Tt][Tt][Pp][Ss]?://[\\\\x21-\\\\x7e]+\\\\z'")
    block = F.concat(F.lit("Title: "), "title", F.lit("\nURL: "), "url", F.lit("\nContent: of "), F.col("source_id").cast("string"), F.lit("\n"))
    text = src.groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", "source_id", block.alias("b")))), lambda x: x["b"]), "").alias("t"))
    return pages.search_results(text, "result_id", "t").select("result_id", "pos", "title", "url")


@query("SELECT item_id FROM (SELECT DISTINCT item_id, company FROM batch_items) WHERE lower(trim(coalesce(company, ''))) NOT IN (SELECT lower(trim(coalesce(company, ''))) FROM upload_names)")
def cache_misses(s: SparkSession, d: str) -> DataFrame:
    want = table(s, d, "batch_items").select("item_id", records.cache_key(F.col("company")).alias("cache_key")).distinct()
    return records.cache_misses(want, table(s, d, "upload_names").select(records.cache_key(F.col("company")).alias("cache_key")).distinct()).select("item_id")


@query("SELECT item_id, CAST(row_number() OVER (ORDER BY entered_at NULLS LAST, item_id) AS INTEGER) AS place FROM (SELECT DISTINCT item_id, entered_at FROM batch_items)")
def places_by_completion(s: SparkSession, d: str) -> DataFrame:
    return records.ordered(table(s, d, "batch_items").select("item_id", "entered_at").distinct(), "completed", upload="item_id", at="entered_at").select("item_id", "place")


_URLS = "coalesce(list_sort(list_distinct(list(url) FILTER (source_index IN {0} AND url IS NOT NULL))), [])"


@query(f"SELECT result_id, {_URLS.format('(1)')} AS first, count_if(source_index = 1) > 0 AS first_used, {_URLS.format('(2, 3)')} AS next, count_if(source_index IN (2, 3)) > 0 AS next_used FROM gapfill_sources GROUP BY 1")
def source_ladder(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "gapfill_sources").withColumn("k", F.concat(F.lit("k"), F.col("source_index").cast("string")))
    return rollups.ladder(g, "result_id", "k", "url", (("first", ("k1",)), ("next", ("k2", "k3"))))


@query("SELECT company, min(batch_id) AS version, sum(tokens) AS tokens, coalesce(string_agg(DISTINCT model, ', ' ORDER BY model), '') AS labels, min(item_id) < 5 AS limited_sources FROM batch_items GROUP BY 1")
def reports_existing(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "batch_items").select("company", F.col("batch_id").alias("version"), "tokens", "model", F.col("item_id").alias("n_sources"))
    return rollups.existing_reports(r, "company")


@query(f"SELECT result_id FROM (SELECT result_id, source_index, site_name, {_DOMAIN} AS dom FROM gapfill_sources) GROUP BY 1 HAVING count_if(source_index <= 4) >= 2 AND count(DISTINCT site_name) >= 2 AND count(DISTINCT dom) >= 2")
def results_covered(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "gapfill_sources").withColumn("grade", F.when(F.col("source_index") <= 4, "strong").otherwise("weak")).withColumn("dom", T.registrable_domain(F.col("url")))
    return discovery.useful_coverage(g, "result_id", grade="grade", good=("strong",), category="site_name", domain="dom")


@query(f"""WITH c AS (SELECT run_label, count(*) AS calls, count_if(http_code = 200) AS calls_200, count_if(http_code = 429) AS calls_429 FROM gapfill_results GROUP BY 1),
p AS (SELECT run_label, count(*) AS pages, count(DISTINCT {_H}) AS hosts FROM (SELECT DISTINCT source_id, result_id, url FROM gapfill_sources) JOIN (SELECT DISTINCT result_id, run_label FROM gapfill_results) USING (result_id) GROUP BY 1)
SELECT run_label, coalesce(calls, 0) AS calls, coalesce(calls_200, 0) AS calls_200, coalesce(calls_429, 0) AS calls_429, coalesce(pages, 0) AS pages, coalesce(hosts, 0) AS hosts FROM c FULL JOIN p USING (run_label)""")
def run_manifests(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "gapfill_results")
    p = table(s, d, "gapfill_sources").select("source_id", "result_id", "url").distinct().join(r.select("result_id", "run_label").distinct(), "result_id").withColumn("host", T.host(F.col("url")))
    return rollups.run_manifest(r.withColumn("code", F.col("http_code").cast("string")), p, "run_label", ("200", "429"), kind="code", host="host")


@query("SELECT batch_id, round(sum(coalesce(tokens, 0) / 1000.0 * CASE model WHEN 'a' THEN 0.5 END), 4) AS cost FROM (SELECT batch_id, tokens, CASE WHEN length(model) % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM batch_items) GROUP BY 1")
def costs(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "batch_items").withColumn("model", F.when(F.length("model") % 2 == 0, "a").otherwise("b"))
    return rollups.cost(b, s.createDataFrame([("a", 0.5)], "model string, rate double"), "batch_id")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9一-鿿]+'), lambda t: t <> '')"


@query(f"SELECT DISTINCT c.company, d.organization_name, len(list_intersect(list_distinct(c.w), d.w)) / len(list_distinct(c.w)) >= 0.6 AS fits FROM (SELECT DISTINCT company, {_WORDS.format('company')} AS w, lower(name) AS n FROM crm_contacts) c JOIN (SELECT DISTINCT organization_name, {_WORDS.format('organization_name')} AS w, lower(name) AS n FROM directory_people) d ON c.n = d.n WHERE len(c.w) > 0")
def organisation_fits(s: SparkSession, d: str) -> DataFrame:
    """Contacts and directory rows of one name: whether their firms' names agree."""
    w = lambda c: T.name_tokens(F.col(c), ("",))
    a = table(s, d, "crm_contacts").select("company", w("company").alias("a"), F.lower("name").alias("n")).distinct()
    b = table(s, d, "directory_people").select("organization_name", w("organization_name").alias("b"), F.lower("name").alias("n")).distinct()
    return a.join(b, "n").where("size(a) > 0").select("company", "organization_name", people.organisation_matches(F.col("a"), F.col("b")).alias("fits")).distinct()


@query("SELECT crm_contact_id, CASE WHEN rank IS NULL THEN 0 ELSE rank END AS rank FROM (SELECT crm_contact_id, row_number() OVER (PARTITION BY company ORDER BY score DESC NULLS FIRST, corroborated DESC, name NULLS FIRST, crm_contact_id) AS rank FROM (SELECT crm_contact_id, any_value(company) AS company, any_value(name) AS name, CAST(length(any_value(title)) AS INTEGER) % 5 AS score, any_value(email) IS NOT NULL AS corroborated FROM crm_contacts GROUP BY 1))")
def people_ranks(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "crm_contacts").dropDuplicates(["crm_contact_id"]).withColumn("score", F.length("title") % 5).withColumn("ok", F.col("email").isNotNull())
    return evidence.ranked(c, "company", F.desc_nulls_first("score"), F.desc("ok"), F.asc_nulls_first("name"), F.col("crm_contact_id")).select("crm_contact_id", "rank")


@query("""WITH n AS (SELECT DISTINCT title FROM crm_contacts), c AS (SELECT title, trim(coalesce(title, '')) AS t FROM n), w AS (SELECT title, t, trim(regexp_replace(lower(t), '[^\\p{L}\\p{M}\\p{N}_\\s]+', ' ', 'g')) AS low FROM c), l AS (SELECT *, list_filter(regexp_split_to_array(low, '\\s+'), lambda x: x <> '') AS ws FROM w)
SELECT title, length(t) BETWEEN 2 AND 120 AND len(ws) > 0 AND NOT list_contains(['unknown', 'none', 'tbd', 'tbc', 'buyer'], low) AND NOT list_contains(['unknown', 'none', 'tbd', 'tbc', 'buyer'], ws[1]) AND len(list_filter(ws, lambda x: NOT list_contains(['unknown', 'none', 'tbd', 'tbc', 'buyer', 'of', 'and', 'the', 'for', 'in'], x))) > 0
 AND NOT list_has_any(list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda x: x <> ''), ['report', 'head']) AND NOT starts_with(t, 'www.') AND length(t) - length(replace(t, '/', '')) < 2 AND len(regexp_split_to_array(t, '\\s+')) <= 8 AS proposed FROM l""")
def proposed_names(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "crm_contacts").select("title").distinct()
    return n.select("title", discovery.is_proposed_organisation(F.col("title"), ("unknown", "none", "tbd", "tbc", "buyer"), ("report", "head")).alias("proposed"))


@query("""WITH s AS (SELECT DISTINCT company, replace(upper(substr(md5(company), 1, 3)), '0', 'X') AS m FROM upload_names WHERE company IS NOT NULL), a AS (SELECT company, company || ' (NYSE: ' || regexp_replace(m, '[0-9]', 'Q', 'g') || ')' AS name FROM s)
SELECT name, CASE WHEN list_contains(['USA', 'US', 'UK', 'EU', 'CN', 'JP', 'DE', 'FR', 'HQ', 'OEM', 'EV', 'ESS', 'AI', 'IT', 'HR'], t) THEN NULL ELSE t END AS ticker FROM (SELECT name, nullif(regexp_extract(name, '[(\\[]\\s*(?:(?:NYSE|NASDAQ|SEHK|SSE|SZSE|TSE|HKEX|TICKER)\\b)?\\s*:?\\s*([A-Z]{1,5}(?:\\.[A-Z]{1,3})?)\\s*[)\\]]', 1), '') AS t FROM a)""")
def typed_tickers(s: SparkSession, d: str) -> DataFrame:
    m = F.regexp_replace(F.replace(F.upper(F.substring(F.md5("company"), 1, 3)), F.lit("0"), F.lit("X")), "[0-9]", "Q")
    a = table(s, d, "upload_names").where("company is not null").select("company").distinct().select(F.concat("company", F.lit(" (NYSE: "), m, F.lit(")")).alias("name"))
    return a.select("name", T.explicit_ticker(F.col("name")).alias("ticker"))


_OUT = "CASE WHEN supplied % 7 = 0 THEN 'skipped_crm_sufficient' WHEN supplied % 7 = 1 THEN 'not_configured' WHEN supplied % 7 = 2 THEN 'ok' WHEN supplied % 7 = 3 THEN '' ELSE 'failed' END"


@query(f"""WITH r AS (SELECT company AS account_id, count(*) AS supplied, count_if(coalesce(length(title) % 3 = 0, false)) AS crm, count_if(coalesce(email IS NULL AND length(title) % 2 = 0, false)) AS dir FROM crm_contacts WHERE company IS NOT NULL GROUP BY 1), t AS (SELECT *, {_OUT} AS status, CASE WHEN {_OUT} = '' THEN 'no result' ELSE {_OUT} END AS why FROM r)
SELECT account_id, CASE WHEN status = 'skipped_crm_sufficient' THEN supplied || ' CRM contact(s) found, ' || crm || ' relevant, directory not needed' WHEN crm > 0 AND dir > 0 THEN crm || ' CRM contact(s) and ' || dir || ' of the directory, ' || (crm + dir) || ' after merge'
 WHEN crm > 0 AND status = 'ok' THEN crm || ' CRM contact(s), the directory added none' WHEN crm > 0 THEN crm || ' CRM contact(s) kept, directory unavailable (' || why || ')' WHEN dir > 0 THEN 'no CRM contacts, ' || dir || ' of the directory' WHEN status = 'not_configured' THEN 'no CRM contacts and no directory configured'
 WHEN supplied = 0 THEN 'no CRM contacts matched and the directory returned none (' || why || ')' ELSE supplied || ' CRM contact(s) supplied but none relevant, the directory returned none (' || why || ')' END AS outcome,
 NOT (status = 'skipped_crm_sufficient' OR (crm > 0 AND (dir > 0 OR status = 'ok')) OR (crm = 0 AND dir > 0)) AS is_warning FROM t""")
def contact_outcomes(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "crm_contacts").where("company is not null").groupBy(F.col("company").alias("account_id")).agg(F.count("*").alias("supplied"), F.count_if(F.col("title").isNotNull() & (F.length("title") % 3 == 0)).alias("from_crm"), F.count_if(F.col("email").isNull() & (F.length("title") % 2 == 0)).alias("from_directory"))
    return people.contact_outcome(r.withColumn("merged", F.col("from_crm") + F.col("from_directory")).withColumn("status", F.expr(_OUT)))


@query("SELECT run_label, CASE WHEN count(DISTINCT err) FILTER (err <> '') > 0 THEN string_agg(DISTINCT '- ' || err, chr(10) ORDER BY '- ' || err) FILTER (err <> '') WHEN min(http_code) = 200 THEN 'not searched: all well' ELSE 'none found' END AS block FROM gapfill_results GROUP BY 1")
def error_blocks(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "gapfill_results")
    runs = r.groupBy("run_label").agg(F.when(F.min("http_code") == 200, "all well").alias("skip_reason"))
    found = r.where("err != ''").select("run_label", F.col("err").alias("seq"), F.col("err").alias("name")).distinct()
    return people.channel_block(runs, found, "run_label")


@query("""SELECT result_id, '## Evidence' || chr(10) || count(*) || ' sources, ' || count_if(source_index <= 2) || ' official' || chr(10) || chr(10) || array_to_string(list('- [' || source_id || '] ' || substr(coalesce(title, ''), 1, 110) ORDER BY source_id)[1:20], chr(10)) AS section
FROM (SELECT DISTINCT result_id, source_id, source_index, title FROM gapfill_sources) GROUP BY 1""")
def evidence_summaries(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "gapfill_sources").select("result_id", "source_id", "source_index", "title").distinct().select("result_id", F.col("source_id").alias("id"), "title", (F.col("source_index") <= 2).alias("official"))
    return planning.summary_section(g, s.createDataFrame([], "result_id long, seq long, text string"), "result_id")


@query(f"WITH k AS (SELECT result_id, source_id, {_KEY} AS k FROM (SELECT DISTINCT result_id, source_id, url FROM gapfill_sources)), f AS (SELECT k, min(result_id) AS first FROM k GROUP BY 1) SELECT result_id, count(DISTINCT k) AS fresh FROM k JOIN f USING (k) WHERE result_id = first GROUP BY 1")
def fresh_hits(s: SparkSession, d: str) -> DataFrame:
    """Pages that no earlier search has brought."""
    k = table(s, d, "gapfill_sources").select("result_id", "source_id", "url").distinct().withColumn("k", T.url_key(F.col("url")))
    return evidence.first_seen(k, [F.col("k")], F.col("result_id")).groupBy("result_id").agg(F.count("*").alias("fresh"))


@query("SELECT * FROM (SELECT DISTINCT item_id, company FROM batch_items WHERE item_id NOT IN (SELECT upload_row_id FROM upload_names)) UNION ALL (SELECT DISTINCT upload_row_id, company FROM upload_names)")
def upserted_names(s: SparkSession, d: str) -> DataFrame:
    new = table(s, d, "upload_names").select(F.col("upload_row_id").alias("item_id"), "company").distinct()
    return tables.upserted(table(s, d, "batch_items").select("item_id", "company").distinct(), new, ["item_id"])


@query("SELECT DISTINCT item_id, company FROM batch_items WHERE item_id NOT IN (SELECT upload_row_id FROM upload_names)")
def items_without_uploads(s: SparkSession, d: str) -> DataFrame:
    return tables.without(table(s, d, "batch_items").select("item_id", "company").distinct(), table(s, d, "upload_names").select(F.col("upload_row_id").alias("item_id")), ["item_id"])


@query(f"SELECT item_id, CASE lower({_S.format('item_status')}) WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' ELSE 'Pending' END AS item_status, coalesce(tokens, -1) AS tokens, CASE WHEN isnan(latency) THEN NULL ELSE latency END AS latency FROM (SELECT DISTINCT item_id, item_status, tokens, latency FROM batch_items)")
def coerced_items(s: SparkSession, d: str) -> DataFrame:
    return uploads.coerced(table(s, d, "batch_items"), ("Completed", "Failed")).select("item_id", "item_status", F.coalesce("tokens", F.lit(-1)).alias("tokens"), "latency").distinct()


@query("SELECT company FROM crm_contacts WHERE company IS NOT NULL INTERSECT SELECT organization_name FROM directory_people")
def firms_in_both(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crm_contacts").select("company").where("company is not null").intersect(table(s, d, "directory_people").select("organization_name"))


@query("SELECT company FROM crm_contacts WHERE company IS NOT NULL EXCEPT SELECT organization_name FROM directory_people")
def firms_of_crm_alone(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crm_contacts").select("company").where("company is not null").subtract(table(s, d, "directory_people").select("organization_name"))


@query("SELECT company AS name FROM crm_contacts UNION ALL SELECT organization_name FROM directory_people")
def firms_of_all(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crm_contacts").select(F.col("company").alias("name")).unionAll(table(s, d, "directory_people").select("organization_name"))


@query("SELECT CAST(w AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM (SELECT CAST(entered_at AS TIMESTAMP) AS ts FROM batch_items WHERE entered_at IS NOT NULL)) GROUP BY 1")
def sliding_hours(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "batch_items").where("entered_at is not null").withColumn("ts", F.col("entered_at").cast("timestamp"))
    return b.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH o AS (SELECT batch_id, entered_at AS ts, CASE WHEN entered_at - lag(entered_at) OVER (PARTITION BY batch_id ORDER BY entered_at) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM batch_items WHERE entered_at IS NOT NULL),
g AS (SELECT *, sum(new) OVER (PARTITION BY batch_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o) SELECT batch_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM g GROUP BY batch_id, k""")
def upload_sessions(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "batch_items").where("entered_at is not null").withColumn("ts", F.col("entered_at").cast("timestamp"))
    return b.groupBy("batch_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("batch_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT result_id, list_filter(regexp_split_to_array(coalesce(answer, ''), '\\n\\n+'), lambda x: length(x) > 0)[1] AS data FROM (SELECT DISTINCT result_id, answer FROM gapfill_results WHERE answer <> '' AND NOT regexp_matches(answer, '[\\n\\r]'))")
def streamed_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers as a server-sent stream of two events, parsed again."""
    r = table(s, d, "gapfill_results").select("result_id", "answer").distinct().where("answer != '' and not answer rlike '[\\\\n\\\\r]'")
    return r.select("result_id", F.get(pages.sse_events(F.concat(F.lit("event: x\r\ndata: "), "answer", F.lit("\r\n\r\ndata: [DONE]\r\n\r\n"))), 0).alias("data"))


