"""Queries of the ten operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import boilerplate, encoding, encodings, entity_linkage, formatting_copies, name_variants, packing, reference_list, residue, spans
from siltstone.session import table, written


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encoded(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(encoding.encoded(table(spark, d, "documents"), "doc_id", "text", counts_only=True), "sizes")
    return packing.packed(sizes, "doc_id", "n_tokens")


QUERIES = {
    "p1_found": lambda s, d: residue.found(table(s, d, "fetched_pages"), table(s, d, "gapfill_results")),
    "p2_found": lambda s, d: encodings.found(table(s, d, "batch_items")),
    "p2_restored": lambda s, d: encodings.judged(table(s, d, "batch_items"), "item_id", ["company", "website"]),
    "p3_found": lambda s, d: formatting_copies.source_copies(table(s, d, "gapfill_sources")),
    "p3_records": lambda s, d: formatting_copies.source_records(table(s, d, "gapfill_sources")),
    "p4_found": lambda s, d: entity_linkage.linked(table(s, d, "crm_contacts"), table(s, d, "directory_people")).select("crm_contact_id", "person_id"),
    "p4_confidence": lambda s, d: entity_linkage.linked(table(s, d, "crm_contacts"), table(s, d, "directory_people")),
    "p5_found": lambda s, d: reference_list.mapped(table(s, d, "crm_contacts"), table(s, d, "title_list"), table(s, d, "department_list")),
    "p5_unmatched": lambda s, d: reference_list.unmatched_report(table(s, d, "crm_contacts"), table(s, d, "title_list"), table(s, d, "department_list")),
    "p7_found": lambda s, d: name_variants.pairs(table(s, d, "upload_names")),
    "p7_groups": lambda s, d: name_variants.groups(table(s, d, "upload_names")),
    "p6_found": lambda s, d: boilerplate.furniture_lines(table(s, d, "fetched_pages"), table(s, d, "gapfill_results")),
    "p6_articles": lambda s, d: boilerplate.articles(table(s, d, "fetched_pages"), table(s, d, "gapfill_results")),
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p10_found": lambda s, d: spans.shared_spans(table(s, d, "documents"), "doc_id", "text"),
    "p10_share": lambda s, d: spans.shared_share(table(s, d, "documents"), "doc_id", "text"),
}

# SQL spellings of the canonical forms
_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"


def _words(x: str) -> str:
    plain = rf"regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({plain}, '({_CJK}) ', '\1', 'g'), ' ({_CJK})', '\1', 'g'))"


def _joined(parts: str) -> str:
    return f"array_to_string(list_sort(list_filter(list_transform({parts}, lambda x: {_words('x')}), lambda x: x <> '')), chr(2))"


_FOLDED = "lower(upper(replace(coalesce({0}, ''), 'ß', 'ss')))"
_FRONT = f"split_part({_FOLDED.format('url')}, '#', 1)"
_PARAMS = f"regexp_split_to_array(CASE WHEN contains({_FRONT}, '?') THEN substr({_FRONT}, instr({_FRONT}, '?') + 1) ELSE '' END, '[&;?]')"
_URL = f"{_words(f'split_part({_FRONT}, {chr(39)}?{chr(39)}, 1)')} || chr(1) || {_joined(_PARAMS)}"
_BARS = _FOLDED.format("title")
for _ in range(2):
    _BARS = rf"regexp_replace({_BARS}, '([\s\p{{Z}}])[-–—_/·]+([\s\p{{Z}}])', '\1|\2', 'g')"
_CANON = f"SELECT DISTINCT source_id, {_URL} || chr(3) || {_joined(f'regexp_split_to_array({_BARS}, {chr(39)}[|¦•»]|::{chr(39)})')} AS c FROM gapfill_sources"

SQL: dict[str, str] = {
    "p5_found": reference_list.brute_force_sql(),
    "p5_unmatched": reference_list.brute_force_sql(report=True),
    "p3_found": f"SELECT first_id, source_id AS copy_id FROM (SELECT source_id, min(source_id) OVER (PARTITION BY c) AS first_id FROM ({_CANON})) WHERE source_id <> first_id",
    "p3_records": f"SELECT min(source_id) AS source_id, count(*) AS n_copies FROM ({_CANON}) GROUP BY c",
}
