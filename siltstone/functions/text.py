"""Column expressions on names, addresses and texts. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[一-鿿]"

# Public suffixes of more than one label.
MULTI_SUFFIXES = ("com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "co.uk", "org.uk", "ac.uk", "co.jp", "or.jp", "com.au", "com.br", "com.tw", "com.hk", "com.sg", "co.kr", "co.in", "com.mx", "com.tr")
# Legal suffixes of firm names.
LEGAL_SUFFIXES = ("ag", "gmbh", "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "sa", "sas", "plc", "bv", "nv", "srl", "spa", "pte", "kk", "oy", "ab", "as", "aps", "holding", "holdings", "group")


def stripped(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def has_any(c: Column, parts: Sequence[str]) -> Column:
    """Whether the text holds one of the parts; null counts as empty."""
    text = F.coalesce(c, F.lit(""))
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p)) if parts else F.lit(False)


def host(url: Column) -> Column:
    """Host in lower case without port and any `www.`; never fails on a malformed address."""
    netloc = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.replace(F.regexp_replace(F.lower(netloc), r":\d*$", ""), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """One key for a page: scheme, `www.`, query, fragment and trailing slashes disregarded."""
    u = stripped(url)
    return F.concat(host(u), F.lower(F.regexp_replace(path(u), "/+$", "")))


def registrable_domain(url: Column, suffixes: Sequence[str] = MULTI_SUFFIXES) -> Column:
    """The publisher's domain: the last two labels, three under a suffix of two labels."""
    h = host(url)
    labels = F.split(h, r"\.")
    long = F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(h, F.concat(F.lit("."), s)))
    n = F.when(long, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")


def domain_label(url: Column) -> Column:
    return F.split(registrable_domain(url), r"\.").getItem(0)


def domain_stems(url: Column, weak: Sequence[str] = ()) -> Column:
    """Parts of the domain's label of four letters or more that are no weak words."""
    return F.filter(F.split(domain_label(url), "[-_]"), lambda p: (F.length(p) >= 4) & ~p.isin(*weak)) if weak else F.filter(F.split(domain_label(url), "[-_]"), lambda p: F.length(p) >= 4)


def host_under(url: Column, domain: Column) -> Column:
    """Whether the host is the domain or lies under it."""
    h = host(url)
    return F.coalesce((domain != "") & ((h == domain) | F.endswith(h, F.concat(F.lit("."), domain))), F.lit(False))


def html_to_text(html: Column) -> Column:
    """Readable lines of a page: scripts, styles and comments dropped, tags as line ends, entities
    decoded, lines of 2 to 400 characters with words kept once each, in order."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    lines = F.transform(F.split(t, r"\n"), lambda x: stripped(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: F.length(x).between(2, 400) & (x.rlike(CJK) | x.rlike("[A-Za-z]{3}")))), "\n")


def identity_region(title: Column, text: Column, head: int = 400) -> Column:
    """Where a page says whose it is: title, first characters, first copyright line."""
    mark = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)((?:©|copyright|版权所有)[^\n]{0,120})", 1)
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, head), mark))


def core_name(name: Column, suffixes: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """The name without legal suffixes, however many follow each other; itself if nothing else is left."""
    n = stripped(name)
    alts = "|".join(r"\.?".join(s) + r"\.?" if len(s) <= 3 else s + r"\.?" for s in suffixes)
    return F.coalesce(F.nullif(stripped(F.regexp_replace(n, rf"(?i)(?:[,\s]+(?:{alts}))+$", "")), F.lit("")), n)


def name_tokens(name: Column, generic: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """Words of Latin letters, digits and Han in lower case, generic ones left out, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9一-鿿]+"), lambda t: (t != "") & ~t.isin(*generic))


def distinctive_tokens(name: Column, common: Sequence[str]) -> Column:
    return F.filter(name_tokens(core_name(name)), lambda t: ~t.isin(*common)) if common else name_tokens(core_name(name))


def spaced(text: Column) -> Column:
    """The text in lower case with one blank for whatever is no Latin letter or digit, and blanks around."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), F.lit(" "))


def mentions(text: Column, word: Column, among: Column | None = None) -> Column:
    """Whether the word stands alone in the text: no Latin letter or digit beside it; Han may be.

    ``among`` is :func:`spaced` of the text, if it is at hand. A plain search in it decides on words of
    Latin letters and digits and spares most others their pattern.
    """
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), F.replace(word, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![A-Za-z0-9])"))
    there = F.contains(among if among is not None else spaced(text), F.regexp_replace(spaced(word), "^ +| +$", " "))
    full = F.rlike(F.coalesce(text, F.lit("")), quoted)
    return F.coalesce(F.when(F.coalesce(word, F.lit("")) == "", F.lit(False)).when(word.rlike("^[A-Za-z0-9]+$"), there).when(word.rlike(r"^[\x00-\x7f]*[A-Za-z0-9][\x00-\x7f]*$") & ~there, F.lit(False)).otherwise(full), F.lit(False))


def split_company(name: Column) -> Column:
    """struct(name, name_cn) of a name written in two scripts, parted by a slash."""
    parts = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), "/"), stripped), lambda p: p != "")
    first = F.coalesce(F.get(parts, 0), F.lit(""))
    other = F.get(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: p.rlike(CJK)), 0)
    return F.struct(first.alias("name"), F.coalesce(other, F.when(first.rlike(CJK), first), F.lit("")).alias("name_cn"))


def slug(c: Column, most: int, default: str = "item") -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9一-鿿]+", "-"), "^-+|-+$", ""), 1, most), F.lit("")), F.lit(default))


def org_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9一-鿿]+", "")


def person_key(name: Column) -> Column:
    """First and last word of a name without honorifics; letters beyond ASCII and Han are blanks."""
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\b(dr|prof|mr|mrs|ms|ing|dipl)\b\.?", " ")
    words = F.filter(F.split(F.regexp_replace(n, "[^a-z0-9一-鿿]+", " "), " +"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.lit("")).when(F.size(words) == 1, F.get(words, 0)).otherwise(F.concat_ws(" ", F.get(words, 0), F.element_at(words, -1)))


def linkedin_key(url: Column) -> Column:
    """A profile address without scheme, `www.`, query and trailing slash, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(F.coalesce(url, F.lit("")))), r"^https?://|^www\.|[?#].*$", ""), r"^www\.|/+$", "")


def clean_email(c: Column) -> Column:
    e = F.lower(stripped(c))
    return F.when(e.contains("@") & ~e.rlike("not_unlocked|placeholder|^none$|^n/a$"), e)


def placeholder_to_empty(c: Column, words: Sequence[str] = ("n/a", "na", "none", "null", "unknown", "tbd", "-", "--", "—")) -> Column:
    t = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*words), F.lit("")).otherwise(t)


def title_variants(title: Column, roles: Sequence[str] = ("director", "head", "manager", "chief", "lead", "engineer", "officer", "vp", "vice president")) -> Column:
    """The title in plain words, and a title that starts with a role of some area (of, for) also with the area first."""
    base = stripped(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9&./ ]+", " "), " {2,}", " "))
    words = F.filter(F.split(base, " "), lambda w: w != "the")
    at = F.array_position(F.transform(words, lambda w: w.isin("of", "for")), True).cast("int")
    front, area = F.array_join(F.slice(words, 1, F.greatest(at - 1, F.lit(0))), " "), F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ")
    # the role may have words before it, such as senior
    role = F.exists(F.array(*map(F.lit, roles)), lambda r: F.endswith(F.concat(F.lit(" "), front), F.concat(F.lit(" "), r)))
    return F.array_distinct(F.array(base, F.when((at > 1) & role & (area != ""), F.concat_ws(" ", area, front)).otherwise(base)))


# Short words in brackets behind a name that are no tickers.
NO_TICKERS = ("USA", "US", "UK", "EU", "CN", "JP", "DE", "FR", "HQ", "R&D", "OEM", "EV", "ESS", "AI", "IT", "HR", "NYSE", "NASDAQ", "SEHK", "SSE", "SZSE")


def explicit_ticker(name: Column, no_tickers: Sequence[str] = NO_TICKERS) -> Column:
    """A ticker of up to five capitals, its class behind a dot, in round or square brackets, the exchange before it or not."""
    inner = F.regexp_extract(F.coalesce(name, F.lit("")), r"[(\[]\s*(?:(?:NYSE|NASDAQ|SEHK|SSE|SZSE|TSE|HKEX|TICKER)\b)?\s*:?\s*([A-Z]{1,5}(?:\.[A-Z]{1,3})?)\s*[)\]]", 1)
    return F.when((inner != "") & ~F.substring_index(inner, ".", 1).isin(*no_tickers), inner)


def website(c: Column, most: int = 500) -> Column:
    w = stripped(F.coalesce(c, F.lit("")))
    return F.substring(F.when(w == "", w).when(w.rlike("(?i)^https?://"), w).otherwise(F.concat(F.lit("https://"), w)), 1, most)


def guess_domains(name: Column, weak: Sequence[str] = (), tlds: Sequence[str] = ("com", "de", "cn", "net"), most: int = 12) -> Column:
    """Likely hosts of a firm: its words joined, with a hyphen and alone, under each ending in turn."""
    words = F.filter(name_tokens(core_name(name)), lambda t: t.rlike("^[a-z0-9]+$"))
    strong = F.filter(words, lambda t: ~t.isin(*weak)) if weak else words
    stems = F.array_distinct(F.filter(F.concat(F.array(F.array_join(words, "")), F.array(F.array_join(words, "-")), F.slice(strong, 1, 1)), lambda s: F.length(s) >= 3))
    hosts = F.flatten(F.transform(F.array(*map(F.lit, tlds)), lambda t: F.transform(stems, lambda s: F.concat(s, F.lit("."), t))))
    return F.slice(F.array_distinct(hosts), 1, most)


def aliases(name: Column, url: Column, region: Column, barred: Sequence[str], most: int = 3) -> Column:
    """Other spellings of a firm's own name that its domain and its own page both bear."""
    own = name_tokens(name)
    parts = F.filter(F.split(domain_label(url), "[-_]"), lambda p: (F.length(p) >= 3) & ~p.isin(*barred) & ~F.array_contains(own, p) & ((region == "") | F.contains(region, p)))
    return F.slice(F.array_distinct(parts), 1, most)


def utf8_size(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit("")))


def escaped_size(c: Column) -> Column:
    """Bytes of the text inside a JSON string that is pure ASCII: 6 a character beyond it, 12 in the
    astral planes, 2 for those with a short escape, 6 for other controls."""
    t = F.coalesce(c, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    two, control, astral = count(r'["\\\n\r\t\x08\x0c]'), count(r"[\x00-\x07\x0b\x0e-\x1f]"), count(r"[\x{10000}-\x{10ffff}]")
    beyond = count(r"[^\x00-\x7f]")
    return F.length(t) + two + control * 5 + (beyond - astral) * 5 + astral * 11


def estimate_tokens(c: Column) -> Column:
    """A rough count: one for each Han character, one for 3.6 others."""
    t = F.coalesce(c, F.lit(""))
    han = F.regexp_count(t, F.lit(CJK))
    return F.floor(han + F.greatest(F.lit(0), F.length(t) - han) / 3.6).cast("long")


def clip_bytes(c: Column, size: Column) -> Column:
    """The longest beginning of at most ``size`` bytes that splits no character."""
    raw = F.substr(F.encode(F.coalesce(c, F.lit("")), "utf-8"), F.lit(1), F.greatest(F.lit(0), size.cast("int")))
    # a character cut at the end becomes one replacement character
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�$", "")


def passages(text: Column) -> Column:
    """Pieces between blank lines or after sentence ends, of more than 20 characters."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}|(?<=[.!?。！？])[ \t]+"), stripped), lambda p: F.length(p) > 20)


def shingle(passage: Column, words: int = 14) -> Column:
    """The distinct ones of the first words of four characters or more."""
    return F.array_distinct(F.slice(F.regexp_extract_all(F.lower(F.coalesce(passage, F.lit(""))), F.lit(r"(?U)(\w{4,})"), F.lit(1)), 1, words))


def heading_side(text: Column, lang: Column) -> Column:
    """One side of a heading in two scripts, told by script; the whole if there is no choice."""
    parts = F.transform(F.split(text, " / "), stripped)
    han, latin = F.filter(parts, lambda p: p.rlike(CJK)), F.filter(parts, lambda p: ~p.rlike(CJK))
    return F.when((lang == "bilingual") | (F.size(han) == 0) | (F.size(latin) == 0), text).when(lang == "zh", F.array_join(han, " / ")).otherwise(F.array_join(latin, " / "))


def local_name(text: Column, latin: Column) -> Column:
    """The Han name of two to eight characters right behind a Latin one, or right before it; null if none."""
    quoted = F.concat(F.lit("\\Q"), F.replace(latin, F.lit("\\E"), F.lit("")), F.lit("\\E"))
    t = F.coalesce(text, F.lit(""))
    after = F.regexp_substr(F.regexp_substr(t, F.concat(F.lit("(?i)"), quoted, F.lit("\\s*[（(]?\\s*[一-鿿]{2,8}"))), F.lit("[一-鿿]{2,8}$"))
    before = F.regexp_substr(F.regexp_substr(t, F.concat(F.lit("(?i)[一-鿿]{2,8}\\s*[（(]?\\s*"), quoted)), F.lit("^[一-鿿]{2,8}"))
    return F.when(latin != "", F.coalesce(after, before))
