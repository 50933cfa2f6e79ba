"""Freely typed values mapped to the entries of a reference list, in SQL alone.

Method, a partition-based pigeonhole join: each wording of an entry is cut into k + 1 segments. A
value within k edits of it holds at least one segment unchanged, at most k places from where the
segment stands. So an equality join of segments with the value's substrings at those places finds
every candidate, `levenshtein` verifies them, and an anti-join reports the values with no entry.
Wordings are made by rule from whatever entries the list holds: word orders, shortened words, and
translations put together from a glossary of areas and roles. No entry is known by its id, so an
id that is not in the list can never come out. Values are mapped once each, however often they stand.

The statements are written for Spark; :func:`wordings_sql` also gives them for DuckDB, where a
brute-force join of all values with all wordings checks the pigeonhole join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import written

# Short forms of English words, as word: short forms.
SHORT_WORDS = {
    "account": "acct", "accounting": "acctg", "administration": "admin", "assistant": "asst", "associate": "assoc", "automation": "autom", "battery": "batt,bat", "building": "bldg", "business": "bus",
    "communications": "comms", "coordinator": "coord", "department": "dept", "design": "des", "development": "dev", "director": "dir,directr", "electrical": "elec", "engineer": "engr", "engineering": "eng,engrg",
    "executive": "exec", "facilities": "fac", "finance": "fin", "financial": "fin", "general": "gen", "human resources": "hr", "industrial": "ind", "information": "info", "key account": "key acct", "laboratory": "lab",
    "logistics": "log", "maintenance": "maint,mtce", "management": "mgmt,mgt", "manager": "mgr", "manufacturing": "mfg,manuf", "marketing": "mktg", "mechanical": "mech", "office": "off", "officer": "off,offcr", "operating": "op", "operations": "ops",
    "planning": "plng", "president": "pres", "procurement": "procmt,procurmt,procment", "production": "prod", "project": "proj", "purchasing": "purch", "quality": "qlty,qual", "representative": "rep",
    "research development": "r d,rnd,research dev", "safety": "saf", "senior": "sr", "software": "sw", "supervisor": "supv", "supply chain": "supplychain,sc", "technical": "tech", "technician": "tech", "technology": "tech",
    "vice president": "vp,vice pres,v p", "warehouse": "whse",
}

# Areas of work in English, German and Chinese; several words of one language parted by a comma.
AREAS = (
    ("executive", "geschäftsführung", "执行"), ("operating", "betrieb", "运营"), ("operations", "betrieb", "运营"), ("financial", "finanz", "财务"), ("finance", "finanz", "财务"), ("technology", "technik", "技术"), ("technical", "technik", "技术"),
    ("information", "it", "信息"), ("procurement", "einkauf", "采购"), ("purchasing", "einkauf", "采购"), ("manufacturing", "fertigung,produktion", "制造,生产"), ("production", "produktion", "生产"), ("quality", "qualität", "质量"),
    ("supply chain", "lieferkette", "供应链"), ("engineering", "konstruktion", "工程"), ("sales", "vertrieb", "销售"), ("marketing", "marketing", "市场"), ("automation", "automatisierung", "自动化"),
    ("research development", "entwicklung,forschung entwicklung,f e", "研发"), ("logistics", "logistik", "物流"), ("maintenance", "instandhaltung", "维护,设备维护"), ("human resources", "personal", "人力资源"), ("legal", "recht", "法务"),
    ("plant", "werk", "厂,工厂"), ("warehouse", "lager", "仓库"), ("process", "prozess", "工艺"), ("test", "prüf,test", "测试"), ("software", "software", "软件"), ("battery cell", "zell,batteriezell", "电芯"), ("cell", "zell", "电芯"),
    ("project", "projekt", "项目"), ("key account", "großkunden", "大客户"), ("safety", "sicherheit", "安全"), ("design", "konstruktion", "设计"), ("accounting", "buchhaltung", "会计"), ("training", "ausbildung", "培训"),
    ("product", "produkt", "产品"), ("service", "service", "服务"), ("export", "export", "出口"), ("environment", "umwelt", "环境"),
)
# Roles, as (English, endings of German compounds, German words before the area, Chinese words, rank).
# Where one wording fits two entries, the one of the smaller rank has it.
ROLES = (
    ("director", "direktor", "direktor", "总监", 0), ("head", "leiter", "leiter", "主管,总管", 1), ("manager", "leiter,manager,betreuer", "", "经理", 0), ("engineer", "ingenieur,entwickler", "", "工程师", 0), ("vice president", "", "", "副总裁", 0),
    ("controller", "controller", "", "主管,主计", 0), ("representative", "mitarbeiter,vertreter", "", "代表", 0), ("officer", "beauftragter,beauftragte", "", "员,专员", 0), ("technician", "techniker", "", "技术员", 0), ("planner", "planer", "", "计划员", 0),
)
# Wordings that no rule puts together, by the text of the entry.
TITLE_WORDS = {
    "chief executive officer": "geschäftsführender vorstand,vorstandsvorsitzender", "buyer": "einkäufer,采购员", "technical writer": "technischer redakteur,technische redakteurin,技术文档工程师", "plant manager": "厂长",
}
DEPARTMENT_WORDS = {
    "executive board": "board,exec board,c suite,management board,geschäftsführung,vorstand,管理层", "finance": "finanzen", "information systems": "it,is,info systems,it abteilung,信息部", "procurement": "purchasing,sourcing procurement",
    "manufacturing": "production", "quality": "qa,qm,q m,quality mgmt,quality management", "supply chain": "scm,supply chain mgmt,supplychain mgmt", "sales": "field sales", "research and development": "rd",
    "human resources": "h r", "plant management": "plant mgmt,plant mgt,werkleitung,werksleitung,工厂管理部", "project office": "pmo,project off,projektbüro,项目部",
}
#: Whoever only serves the holder of a title starts a title so.
SERVES = "pa|assistant|secretary|office|trainee|driver|chauffeur|sekretariat"

_STEPS = (
    (r"\([^)]*\)|（[^）]*）", " "),
    (r"\|.*$|@.*$|[ ,]/ .*$|[ ,][-–—] ?(asia|emea|apac|americas|eu|dach|china|europe)\b.*$", " "),
    (r"^ *((\*|mr\.?|mrs\.?|ms\.?|dr\.?|interim|acting) +)+", ""),
    (r"[ ,_]+(plant (north|south|east|west)|group|eu|emea|asia|hq)[ _]*$", " "),
    (r"\b([a-z])\.", "\1"),
    (r"[\x27’`´]", ""),
    (r"([ -]+(dept\.?|department|team))+ *$", ""),
    ("ß", "ss"),
    (r"[^\pL\pN]+", " "),
)


def clean(v: str, duckdb: bool = False) -> str:
    """SQL of a value's plain form: lower case, without remarks, courtesy and small words."""

    def sub(x: str, pattern: str, by: str) -> str:
        p, r = pattern, by
        if not duckdb:
            p, r = p.replace("\\", "\\\\"), r.replace("\1", "$1")
        else:
            r = r.replace("\1", "\\1")
        return f"regexp_replace({x}, '{p}', '{r}'{', ' + chr(39) + 'g' + chr(39) if duckdb else ''})"

    x = f"lower({sub(v, '[' + chr(92) + 's' + chr(92) + 'pZ]+', ' ')})"
    for pattern, by in _STEPS:
        x = sub(x, pattern, by)
    return f"trim({sub(sub(f'concat({chr(39)} {chr(39)}, {x}, {chr(39)} {chr(39)})', ' ((of|the|and|interim|acting) )+', ' '), ' +', ' ')})"


def _rows(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {text}) AS t({names}))"


def _many(table: dict[str, str]) -> list[tuple]:
    return [(k, w) for k, ws in table.items() for w in ws.split(",")]


def cut_sql(titles: str, departments: str, duckdb: bool = False) -> str:
    """SQL of the entries in plain form, cut into role and area; a department is an area alone."""
    return f"""
SELECT field_name, ref_id, form, role, CASE WHEN role = '' THEN form WHEN role = 'vice president' THEN substr(form, 16) WHEN role IN ('director', 'head') THEN substr(form, length(role) + 2)
         WHEN role = 'chief' THEN substr(form, 7, length(form) - 14) ELSE substr(form, 1, length(form) - length(role) - 1) END AS area
FROM (SELECT field_name, ref_id, form, CASE WHEN field_name = 'department' THEN '' WHEN form LIKE 'vice president %' THEN 'vice president' WHEN form LIKE 'director %' THEN 'director' WHEN form LIKE 'head %' THEN 'head'
         WHEN form LIKE 'chief % officer' THEN 'chief' WHEN form LIKE '% %' THEN split_part(form, ' ', -1) ELSE '' END AS role
  FROM (
    SELECT 'title' AS field_name, CAST(ref_id AS BIGINT) AS ref_id, {clean('title', duckdb)} AS form FROM {titles} WHERE ref_id IS NOT NULL AND title IS NOT NULL
    UNION ALL SELECT 'department', CAST(ref_id AS BIGINT), {clean('department', duckdb)} FROM {departments} WHERE ref_id IS NOT NULL AND department IS NOT NULL
  ) WHERE form <> '')"""


def wordings_sql(cut: str, title_words: dict | None = None, department_words: dict | None = None, duckdb: bool = False) -> str:
    """SQL of every wording (field_name, ref_id, form, n, k) of the entries that :func:`cut_sql` gives.

    ``form`` has n letters and may be missed by k edits. The given words, as {text of an entry:
    wordings parted by commas}, go with the entries of these texts and with no other.
    """
    de = [(e, g) for e, g, _ in AREAS for g in g.split(",")]
    zh = [(e, c) for e, _, z in AREAS for c in z.split(",")]
    # one row for each way in which a language joins area and role: before, between, after
    joins = [(e, link, w + fem, "de", r + (w == "leiter" and e == "head")) for e, ws, _, _, r in ROLES for w in ws.split(",") if w for link in ("", "s") for fem in ("", "in")]
    joins += [("chief", link, "vorstand", "de", 0) for link in ("", "s", " ")] + [("", "", "", "de", 0), ("", "", "部", "zh", 0), ("chief", "", "官", "zh", 0)]
    joins += [(e, "", w, "zh", r) for e, _, _, ws, r in ROLES for w in ws.split(",")]
    fronts = [(e, w + fem, "", "de", 0) for e, _, ws, _, _ in ROLES for w in ws.split(",") if w for fem in ("", " ", "in ") if fem]
    said = [("title", clean_text(k), w) for k, w in _many(TITLE_WORDS if title_words is None else title_words)] + [("department", clean_text(k), w) for k, w in _many(DEPARTMENT_WORDS if department_words is None else department_words)]
    said = [(f, e, v.replace("ß", "ss")) for f, e, w in said for v in ((w, w + "in") if w.endswith("er") else (w,))]
    rows = [(r, "首席" if r == "chief" and lang == "zh" else "", link + end, lang, prio) for r, link, end, lang, prio in joins] + [(r, front, end, lang, prio) for r, front, end, lang, prio in fronts]
    words = [(w.replace("ß", "ss"), e, "de") for e, w in de] + [(w, e, "zh") for e, w in zh]
    return f"""
WITH short AS {_rows(_many(SHORT_WORDS), 'word, alt')}, part AS {_rows(words, 'alt, word, lang')}, way AS {_rows(rows, 'role, front, tail, lang, prio')}, said AS {_rows(said or [('', '', '')], 'field_name, entry, alt')},
area AS (
  SELECT field_name, ref_id, role, area FROM {cut}
  UNION SELECT c.field_name, c.ref_id, c.role, trim(replace(concat(' ', c.area, ' '), concat(' ', s.word, ' '), concat(' ', s.alt, ' '))) FROM {cut} c JOIN short s ON concat(' ', c.area, ' ') LIKE concat('% ', s.word, ' %')
), title_role AS (
  SELECT DISTINCT role, role AS alt FROM {cut} WHERE role NOT IN ('', 'chief') UNION SELECT c.role, s.alt FROM {cut} c JOIN short s ON s.word = c.role WHERE c.role <> 'chief'
  UNION SELECT 'chief', 'officer' UNION SELECT 'chief', alt FROM short WHERE word = 'officer'
), every AS (
  SELECT field_name, ref_id, form, 0 AS prio FROM {cut}
  UNION ALL SELECT field_name, ref_id, area, 0 FROM area WHERE role = ''
  UNION ALL SELECT a.field_name, a.ref_id, concat(CASE WHEN a.role = 'chief' THEN 'chief ' ELSE '' END, a.area, ' ', r.alt), 0 FROM area a JOIN title_role r ON r.role = a.role
  UNION ALL SELECT a.field_name, a.ref_id, concat(r.alt, ' ', a.area), 0 FROM area a JOIN title_role r ON r.role = a.role WHERE a.role <> 'chief'
  UNION ALL SELECT field_name, ref_id, concat('c', substr(area, 1, 1), 'o'), 0 FROM {cut} WHERE role = 'chief'
  UNION ALL SELECT c.field_name, c.ref_id, concat(w.front, p.alt, w.tail), w.prio FROM {cut} c JOIN part p ON p.word = c.area JOIN way w ON w.lang = p.lang AND w.role = c.role WHERE c.role <> '' OR c.field_name = 'department'
  UNION ALL SELECT c.field_name, c.ref_id, s.alt, 0 FROM {cut} c JOIN said s ON s.field_name = c.field_name AND s.entry = c.form
), best AS (SELECT *, min(prio) OVER (PARTITION BY field_name, form) AS least_prio FROM every WHERE form <> '')
SELECT DISTINCT field_name, ref_id, form, CAST(length(form) AS INT) AS n,
  CAST(CASE WHEN length(form) < 5 OR {_han('form', duckdb)} THEN 0 WHEN length(form) < 13 THEN 2 ELSE 3 END AS INT) AS k
FROM best WHERE prio = least_prio"""


def _han(c: str, duckdb: bool) -> str:
    return f"regexp_matches({c}, '[一-鿿]')" if duckdb else f"{c} RLIKE '[一-鿿]'"


def clean_text(entry: str) -> str:
    """An entry's text as the key of its wordings, as :func:`clean` gives it."""
    return " ".join(w for w in entry.lower().split() if w not in ("of", "the", "and"))


#: Candidates share a segment at most k places off.
_CANDIDATES = """
WITH seg AS (
  SELECT field_name, ref_id, form, n, k, CAST(floor(n * i / (k + 1)) AS INT) AS at, CAST(floor(n * (i + 1) / (k + 1)) - floor(n * i / (k + 1)) AS INT) AS size
  FROM (SELECT *, explode(sequence(0, k)) AS i FROM {forms})
), place AS (
  SELECT field_name, n, k, at, size, explode(sequence(greatest(1, n - k), n + k)) AS len FROM (SELECT DISTINCT field_name, n, k, at, size FROM seg)
), piece AS (
  SELECT v.field_name, v.value, p.n, p.k, p.at, p.size, substr(v.value, shifted + 1, p.size) AS piece
  FROM {values} v JOIN place p ON p.field_name = v.field_name AND p.len = length(v.value)
  LATERAL VIEW explode(sequence(greatest(0, p.at - p.k), least(p.at + p.k, greatest(0, length(v.value) - p.size)))) s AS shifted
  WHERE p.at - p.k <= length(v.value) - p.size
)
SELECT DISTINCT q.field_name, q.value, s.ref_id, s.form
FROM piece q JOIN seg s ON s.field_name = q.field_name AND s.n = q.n AND s.k = q.k AND s.at = q.at AND s.size = q.size AND substr(s.form, s.at + 1, s.size) = q.piece"""


def _accepted(d: str, duckdb: bool = False) -> str:
    """The edits must be few for the length, or two swapped letters."""
    serves = f"regexp_matches(value, '^({SERVES}) ')" if duckdb else f"value RLIKE '^({SERVES}) '"
    letters = (lambda c: f"list_sort(string_split({c}, ''))") if duckdb else (lambda c: f"array_sort(split({c}, ''))")
    words = (lambda c: f"len(string_split({c}, ' '))") if duckdb else (lambda c: f"size(split({c}, ' '))")
    return f"""{d} = 0 OR (length(form) >= 5 AND NOT {_han('form', duckdb)} AND NOT {serves} AND (
    {d} = 1 OR ({d} = 2 AND (length(form) >= 9 OR {letters('value')} = {letters('form')})) OR ({d} = 3 AND length(form) >= 13 AND {words('value')} = {words('form')})))"""


def wordings(titles: DataFrame, departments: DataFrame, title_words: dict | None = None, department_words: dict | None = None) -> DataFrame:
    """(field_name, ref_id, form, n, k) of two lists, as :func:`wordings_sql` says."""
    spark = titles.sparkSession
    cut = written(spark.sql(cut_sql("{titles}", "{departments}"), titles=titles.select("ref_id", "title"), departments=departments.select("ref_id", "department")), "entries")
    return spark.sql(wordings_sql("{cut}", title_words, department_words), cut=cut)


def nearest(values: DataFrame, forms: DataFrame) -> DataFrame:
    """(field_name, value, ref_id) of the values (field_name, value) that are within the edits of a wording.

    Of several wordings the one of fewest edits is taken, of entries alike in that the smaller ref_id."""
    spark = values.sparkSession
    near = spark.sql(f"SELECT *, levenshtein(value, form) AS d FROM ({_CANDIDATES})", forms=forms, values=values)
    return spark.sql(f"SELECT field_name, value, min_by(ref_id, struct(d, ref_id)) AS ref_id FROM {{near}} WHERE {_accepted('d')} GROUP BY field_name, value", near=near)


def _typed(contacts: DataFrame) -> DataFrame:
    """(crm_contact_id, field_name, raw), each once, of the values that are neither null nor blank."""
    return contacts.sparkSession.sql(
        r"""SELECT DISTINCT crm_contact_id, field_name, raw FROM {c}
        LATERAL VIEW stack(2, 'title', title, 'department', department) s AS field_name, raw WHERE raw RLIKE '[^\\s\\pZ]'""",
        c=contacts.select("crm_contact_id", "title", "department"),
    )


def _resolved(contacts: DataFrame, titles: DataFrame, departments: DataFrame, title_words: dict | None, department_words: dict | None) -> tuple[DataFrame, DataFrame]:
    """(typed, entries): the typed values of the rows, and (field_name, raw, n, ref_id) of the distinct ones."""
    spark = contacts.sparkSession
    typed = written(_typed(contacts), "typed")
    raws = written(spark.sql(f"SELECT field_name, raw, n, {clean('raw')} AS value FROM (SELECT field_name, raw, count(*) AS n FROM {{t}} GROUP BY field_name, raw)", t=typed), "raws")
    values = spark.sql("SELECT DISTINCT field_name, value FROM {r} WHERE value <> ''", r=raws)
    forms = written(wordings(titles, departments, title_words, department_words), "forms")
    near = written(nearest(values, forms), "matched")
    fit = spark.sql("SELECT r.field_name, r.raw, r.n, m.ref_id FROM {r} r JOIN {m} m ON r.field_name = m.field_name AND r.value = m.value", r=raws, m=near)
    fit = written(fit, "fit")
    none = spark.sql("SELECT r.field_name, r.raw, r.n, CAST(0 AS BIGINT) AS ref_id FROM {r} r LEFT ANTI JOIN {f} f ON r.field_name = f.field_name AND r.raw = f.raw", r=raws, f=fit)
    return typed, written(fit.unionByName(none), "entries")


def mapped(contacts: DataFrame, titles: DataFrame, departments: DataFrame, title_words: dict | None = None, department_words: dict | None = None, hot: int = 100_000) -> DataFrame:
    """(crm_contact_id, field_name, ref_id) of each title and department that is neither null nor
    blank; ref_id 0 if no entry fits.

    A row delivered twice counts once. Of several entries at the same distance the smaller ref_id
    is taken. Remarks on site, region or interim status are dropped; whoever only serves the holder
    of a title has none. Values of any length are mapped. An empty table gives an empty result, an
    empty list only zeros; entries without id or text are left out. ``title_words`` and
    ``department_words`` give further wordings by the text of an entry. A value that more than one
    row in ``hot`` bears, of which there are no more than ``hot``, meets its rows by the broadcast
    of a hash, the others by a shuffle, so that no task gets a hot value.
    """
    typed, entries = _resolved(contacts, titles, departments, title_words, department_words)
    keyed = typed.select("crm_contact_id", "field_name", F.xxhash64("field_name", "raw").alias("h"), F.xxhash64(F.lit(1), "raw").alias("g"))
    total = entries.agg(F.sum("n")).first()[0] or 0
    most = max(1000, -(-total // hot))
    known = entries.select(F.xxhash64("field_name", "raw").alias("h"), F.xxhash64(F.lit(1), "raw").alias("g"), "n", "ref_id")
    out = keyed.join(F.broadcast(known.where(F.col("n") > most)), ["h", "g"]).unionByName(keyed.join(known.where(F.col("n") <= most), ["h", "g"]))
    return out.select("crm_contact_id", "field_name", "ref_id")


def unmatched_report(contacts: DataFrame, titles: DataFrame, departments: DataFrame, title_words: dict | None = None, department_words: dict | None = None) -> DataFrame:
    """(field_name, value, n_rows): each typed value without an entry and how many rows have it."""
    _, entries = _resolved(contacts, titles, departments, title_words, department_words)
    return entries.where("ref_id = 0").select("field_name", F.col("raw").alias("value"), F.col("n").alias("n_rows"))


def brute_force_sql(report: bool = False) -> str:
    """DuckDB SQL of :func:`mapped`, or of the report, by all pairs of values and wordings."""
    none = "coalesce(m.ref_id, 0)"
    head = f"""
WITH cut AS ({cut_sql('title_list', 'department_list', duckdb=True)}), forms AS ({wordings_sql('cut', duckdb=True)}),
typed AS (SELECT DISTINCT crm_contact_id, field_name, raw FROM (SELECT crm_contact_id, 'title' AS field_name, title AS raw FROM crm_contacts UNION ALL SELECT crm_contact_id, 'department', department FROM crm_contacts) WHERE regexp_matches(raw, '[^\\s\\pZ]')),
raws AS (SELECT field_name, raw, {clean('raw', True)} AS value FROM (SELECT DISTINCT field_name, raw FROM typed)),
near AS (SELECT v.field_name, v.value, f.ref_id, f.form, levenshtein(v.value, f.form) AS d FROM (SELECT DISTINCT field_name, value FROM raws) v JOIN forms f ON f.field_name = v.field_name AND abs(length(v.value) - f.n) <= f.k WHERE levenshtein(v.value, f.form) <= f.k),
matched AS (SELECT field_name, value, arg_min(ref_id, d * 1000000 + ref_id) AS ref_id FROM near WHERE {_accepted('d', True)} GROUP BY field_name, value)
"""
    joined = "typed t JOIN raws r ON r.field_name = t.field_name AND r.raw = t.raw LEFT JOIN matched m ON m.field_name = r.field_name AND m.value = r.value"
    if report:
        return f"{head} SELECT t.field_name, t.raw AS value, count(*) AS n_rows FROM {joined} WHERE m.ref_id IS NULL GROUP BY 1, 2"
    return f"{head} SELECT t.crm_contact_id, t.field_name, {none} AS ref_id FROM {joined}"
