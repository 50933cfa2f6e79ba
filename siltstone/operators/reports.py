"""Bilingual reports in markdown: sections, language blocks, tables, verdict tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

_EN, _ZH = r"(?i)^\s*\*\*English[:：]?\*\*[:：]?\s*$", r"^\s*\*\*中文[:：]?\*\*[:：]?\s*$"
_SEPARATOR = r"^[\s:\-|]+$"


def lines(reports: DataFrame, key: str, report: str) -> DataFrame:
    """(key, line_no, line) of each report."""
    return reports.select(key, F.posexplode(F.split(F.coalesce(report, F.lit("")), "\n")).alias("line_no", "line"))


def contexts(rows: DataFrame, key: str) -> DataFrame:
    """Lines with the number of their section, its heading, and the language block they stand in.

    A second-level heading opens a section and ends the block; a marker line opens a block. What the
    last marker was is a running value over the report's lines.
    """
    head = F.col("line").rlike(r"^##[ \t]+\S")
    mark = F.when(head, F.lit("")).when(F.col("line").rlike(_EN), F.lit("en")).when(F.col("line").rlike(_ZH), F.lit("zh"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("is_heading", head).withColumn("is_marker", mark.isin("en", "zh"))
    r = r.withColumn("section_no", F.count_if("is_heading").over(w)).withColumn("heading", F.last(F.when(F.col("is_heading"), F.regexp_replace("line", r"^##[ \t]+", "")), ignorenulls=True).over(w))
    return r.withColumn("block", F.coalesce(F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")), F.lit("shared"))).withColumn("is_marker", F.coalesce("is_marker", F.lit(False)))


def sections(reports: DataFrame, key: str, report: str) -> DataFrame:
    """(key, position, heading, title_en, title_zh, body) of each second-level section."""
    s = reports.select(key, F.posexplode(F.split(F.coalesce(report, F.lit("")), r"(?m)^(?=##[ \t])")).alias("n", "part")).where(F.col("part").rlike(r"^##[ \t]"))
    heading = T.stripped(F.regexp_replace(F.substring_index("part", "\n", 1), r"^##[ \t]+", ""))
    body = F.when(F.instr("part", "\n") > 0, F.substr("part", F.instr("part", "\n") + 1)).otherwise("")
    out = s.select(key, F.row_number().over(Window.partitionBy(key).orderBy("n")).alias("position"), heading.alias("heading"), T.stripped(body).alias("body"))
    return out.select(key, "position", "heading", T.heading_side(F.col("heading"), F.lit("en")).alias("title_en"), T.heading_side(F.col("heading"), F.lit("zh")).alias("title_zh"), "body")


def is_table_row(line: Column) -> Column:
    return (F.regexp_count(line, F.lit(r"\|")) >= 2) & ~line.rlike(_SEPARATOR)


def table_sizes(rows: DataFrame, key: str) -> DataFrame:
    """(key, section_no, heading, en_rows, zh_rows): data rows of the tables of either block, less the header."""
    c = contexts(rows, key).where("section_no > 0 and not is_heading and not is_marker")
    size = lambda b: F.greatest(F.lit(0), F.count_if(is_table_row(F.col("line")) & (F.col("block") == b)) - 1)
    return c.groupBy(key, "section_no").agg(F.first("heading").alias("heading"), size("en").alias("en_rows"), size("zh").alias("zh_rows"))


def completeness(rows: DataFrame, key: str, *, zh_needles: Sequence[str], en_needles: Sequence[str], tolerance: int = 1) -> DataFrame:
    """(key, section_no, heading, reason) of each gap between the language blocks of a section."""
    c = contexts(rows, key).where("section_no > 0 and not is_heading and not is_marker and block in ('en', 'zh')")
    text = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("block") == b, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    has = lambda b: F.count_if(is_table_row(F.col("line")) & (F.col("block") == b))
    g = c.groupBy(key, "section_no").agg(F.first("heading").alias("heading"), text("en").alias("en"), text("zh").alias("zh"), has("en").alias("et"), has("zh").alias("zt"))
    et, zt = F.col("et") >= 2, F.col("zt") >= 2
    found = F.array_compact(F.array(
        F.when(T.has_any(F.lower("zh"), zh_needles), F.lit("chinese_cross_reference")),
        F.when(~et & zt & T.has_any(F.lower("en"), en_needles), F.lit("english_cross_reference")),
        F.when(et & ~zt, F.lit("missing_chinese_table")), F.when(zt & ~et, F.lit("missing_english_table")),
        F.when(et & zt & (F.abs(F.col("et") - F.col("zt")) > tolerance), F.lit("table_row_mismatch")),
    ))
    return g.where("trim(en) != '' or trim(zh) != ''").select(key, "section_no", "heading", F.explode(found).alias("reason"))


def in_language(rows: DataFrame, key: str, lang: str, tags: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(key, text): each report in one language: headings on one side, the other block left out, tags
    (both, en, zh) in one language, runs of blank lines as one."""
    c = contexts(rows, key)
    any_head = F.col("line").rlike(r"^#{1,4}\s+\S")
    line = F.regexp_replace("line", r"\s+$", "")
    for both, en, zh in tags:
        line = F.replace(line, F.lit(both), F.lit(en if lang == "en" else zh))
    shown = F.when(any_head, F.concat(F.regexp_extract("line", r"^(#{1,4}\s+)", 1), T.heading_side(F.regexp_replace("line", r"^#{1,4}\s+", ""), F.lit(lang)))).otherwise(line)
    kept = c.where(~F.col("is_marker") & (any_head | F.col("block").isin("shared", lang))).select(key, "line_no", shown.alias("line"))
    text = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return text.select(key, F.concat(T.stripped(F.regexp_replace("text", r"\n[ \t]*(?:\n[ \t]*){2,}", "\n\n")), F.lit("\n")).alias("text"))


def normal_tags(text: Column, verdicts: Sequence[tuple[str, str]]) -> Column:
    """Verdict tags in bold, in brackets or in both, each as its one bold form. A verdict is (pattern, form)."""
    out = F.coalesce(text, F.lit(""))
    for pattern, form in verdicts:
        out = F.regexp_replace(out, rf"(?i)\*\*\s*\[(?:[^\]\n*]*?)(?:{pattern})(?:[^\]\n*]*?)\]\s*\*\*|\*\*(?:[^*\n]*?)(?:{pattern})(?:[^*\n]*?)\*\*|\[(?:[^\]\n]*?)(?:{pattern})(?:[^\]\n]*?)\]", f"**{form}**")
    return out


def tag_counts(reports: DataFrame, key: str, report: str, verdicts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Tags of each report by verdict (name, pattern, form) and in all."""
    t = normal_tags(F.col(report), [(p, f) for _, p, f in verdicts])
    n = {name: F.regexp_count(t, F.lit(r"\*\*\Q" + form + r"\E\*\*")) for name, _, form in verdicts}
    total = None
    for c in n.values():
        total = c if total is None else total + c
    return reports.select(key, *[c.alias(k) for k, c in n.items()], total.alias("total"))


def residue(line: Column, forms: Sequence[str]) -> Column:
    """What is left of a line without tags, citations and markup."""
    s = F.coalesce(line, F.lit(""))
    for form in forms:
        s = F.replace(s, F.lit(f"**{form}**"), F.lit(" "))
    s = F.regexp_replace(F.regexp_replace(s, r"\[\d+\]", " "), r"^\s*(?:[-*+]|\d+\.)\s*", " ")
    return T.stripped(F.regexp_replace(F.regexp_replace(s, r"[|*`>#]", " "), r"[\s:：./、,，。;；()（）\-]+", " "))


def displayed(rows: DataFrame, key: str, *, missing: str, good: Sequence[str], absence: str, least: int = 30, note: str) -> DataFrame:
    """(key, line_no, line) for display: lines whose only message is that nothing was found are dropped,
    sentences of that kind without a citation too, and a block left empty gets one note."""
    c = contexts(rows, key)
    tagged = F.contains("line", F.lit(f"**{missing}**")) & ~T.has_any(F.col("line"), [f"**{g}**" for g in good])
    left = residue(F.col("line"), (missing, *good))
    drop = tagged & ((F.length(left) < least) | (left.rlike(f"(?i){absence}") & ~F.col("line").rlike(r"\[\d+\]")))
    parts = F.filter(F.split("line", r"(?<=[.。!！?？])\s*"), lambda p: F.trim(p) != "")
    kept = F.filter(parts, lambda p: ~(p.rlike(f"(?i){absence}") & ~p.rlike(r"\[\d+\]") & ~T.has_any(p, good)))
    pruned = F.when(F.col("line").rlike(f"(?i){absence}") & (F.size(parts) > 1), F.array_join(F.transform(kept, T.stripped), " ")).otherwise(F.col("line"))
    fixed = F.col("is_heading") | F.col("is_marker") | (F.trim("line") == "")
    r = c.withColumn("gone", ~fixed & drop).withColumn("shown", F.when(fixed, F.col("line")).otherwise(F.replace(pruned, F.lit(f"**{missing}**"), F.lit(""))))
    w = Window.partitionBy(key, "section_no", "block")
    r = r.withColumn("_content", F.count_if(~fixed).over(w)).withColumn("_left", F.count_if(~fixed & ~F.col("gone")).over(w)).withColumn("_first", F.min(F.when(~fixed, F.col("line_no"))).over(w))
    limited = (F.col("_content") > 0) & (F.col("_left") == 0) & (F.col("line_no") == F.col("_first"))
    return r.where(~F.col("gone") | limited).select(key, "line_no", F.when(limited, F.lit(note)).otherwise(F.col("shown")).alias("line"))


def table_cells(rows: DataFrame, key: str, heading: str) -> DataFrame:
    """(key, section_no, block, row_no, cells map<header, cell>): data rows of the tables of the sections
    whose heading matches; cells without bold and citations, keyed by their lower-case header."""
    c = contexts(rows, key).where(F.col("heading").rlike(f"(?i){heading}") & is_table_row(F.col("line")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: T.stripped(F.regexp_replace(F.regexp_replace(x, r"\*\*", ""), r"\[\d+\]", "")))
    c = c.withColumn("cells", cells).withColumn("row_no", F.row_number().over(Window.partitionBy(key, "section_no", "block").orderBy("line_no")) - 1)
    head = c.where("row_no = 0").select(key, "section_no", "block", F.transform("cells", F.lower).alias("header"))
    j = c.where("row_no > 0").join(head, [key, "section_no", "block"])
    pairs = F.filter(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("c")), lambda z: z["h"].isNotNull())
    return j.select(key, "section_no", "block", "row_no", F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda z: z["h"])), lambda h: F.struct(h, F.get(F.filter(pairs, lambda z: z["h"] == h), 0)["c"]))).alias("cells"))


#: Cells that stand for no name.
NO_NAMES = ("not enough evidence", "证据不足", "n/a", "na", "none", "unknown", "tbd", "—", "-", "待定", "未知")


def people_from_tables(cells: DataFrame, key: str, excluded: str, placeholders: Sequence[str] = NO_NAMES) -> DataFrame:
    """(key, name, title, source): persons of a report's table; placeholders, over-long and excluded rows left out."""
    pick = lambda words: F.get(F.filter(F.map_entries("cells"), lambda e: T.has_any(e["key"], words)), 0)["value"]
    p = cells.select(key, "row_no", pick(("name", "姓名")).alias("name"), F.coalesce(pick(("title", "role", "position", "职务")), F.lit("")).alias("title"), F.coalesce(pick(("source", "来源")), F.lit("")).alias("where"))
    low = F.lower("name")
    # a placeholder may go on after a blank or a mark
    empty = F.exists(F.array(*map(F.lit, placeholders)), lambda w: (low == w) | (F.startswith(low, w) & ~F.substr(low, F.length(w) + 1, F.lit(1)).rlike("[a-z0-9一-鿿]")))
    ok = F.col("name").isNotNull() & F.length("name").between(2, 60) & ~empty & ~F.col("title").rlike(f"(?i){excluded}")
    return p.where(ok).select(key, "row_no", "name", "title", F.when(F.col("where").rlike("(?i)official|官网"), "official").otherwise("web").alias("source"))


def corrected_cells(rows: DataFrame, key: str, section: str, column: str, verdicts: DataFrame) -> DataFrame:
    """(key, line_no, line, moved): tables of matching sections with the entries of one column checked.

    verdicts: (key, entry, keep): entries of a cell are parted by commas, semicolons, slashes or <br>;
    those that are not kept leave the cell (a dash stands for an empty one) and are listed in moved.
    Doing it twice changes nothing more.
    """
    c = contexts(rows, key)
    row = is_table_row(F.col("line")) & F.coalesce(F.col("heading").rlike(f"(?i){section}"), F.lit(False))
    cells = F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|")
    t = c.where(row).withColumn("cells", cells).withColumn("row_no", F.row_number().over(Window.partitionBy(key, "section_no", "block").orderBy("line_no")) - 1)
    head = t.where("row_no = 0").select(key, "section_no", "block", F.array_position(F.transform("cells", lambda x: F.lower(T.stripped(x)).rlike(column)), True).alias("col")).where("col > 0")
    body = t.where("row_no > 0").join(head, [key, "section_no", "block"])
    entries = body.select(key, "line_no", F.posexplode(F.filter(F.transform(F.split(F.get("cells", F.col("col").cast("int") - 1), r"\s*(?:,|;|/|<br>)\s*"), T.stripped), lambda e: e != "")).alias("pos", "entry"))
    judged = entries.join(verdicts.select(key, F.lower("entry").alias("_e"), "keep"), (entries[key] == verdicts[key]) & (F.lower(entries["entry"]) == F.col("_e")), "left").select(entries[key], "line_no", "pos", entries["entry"], F.coalesce("keep", F.lit(True)).alias("keep"))
    per = judged.groupBy(key, "line_no").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("pos", "entry")))), lambda x: x["entry"]).alias("stay"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("keep"), F.struct("pos", "entry")))), lambda x: x["entry"]).alias("moved"),
    )
    changed = body.join(per.where("size(moved) > 0"), [key, "line_no"])
    new = F.when(F.size("stay") == 0, F.lit("—")).otherwise(F.array_join("stay", ", "))
    fixed = changed.select(key, "line_no", F.concat(F.lit("|"), F.array_join(F.transform("cells", lambda x, i: F.when(i == F.col("col") - 1, F.concat(F.lit(" "), new, F.lit(" "))).otherwise(x)), "|"), F.lit("|")).alias("_new"), "moved")
    return c.select(key, "line_no", "line").join(fixed, [key, "line_no"], "left").select(key, "line_no", F.coalesce("_new", "line").alias("line"), F.coalesce("moved", F.array().cast("array<string>")).alias("moved"))


def json_answer(text: Column) -> Column:
    """The JSON object of an answer, in a fence or between the outermost braces; null if it is none."""
    t = F.coalesce(text, F.lit(""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    j = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")))
    return F.when(F.try_parse_json(j).isNotNull(), j)
