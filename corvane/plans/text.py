"""Queries over the text functions: each gives a value for each note or document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.catalog import query, table
from corvane.functions import text as T
from corvane.plans.fixtures import NOTES, notes


def each_note(name: str, make: Callable[[], dict[str, Column]], sql: str) -> None:
    """Register a query of columns over the notes."""

    @query(name, f"WITH {NOTES} SELECT doc_id, {sql} FROM notes")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return notes(spark, sf_dir).select("doc_id", *(c.alias(k) for k, c in make().items()))


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_N, _P = F.col, lambda: F.col("path")
_RUNS = r"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_\-:./]+'), lambda r: regexp_replace(r, '^[_\-:./]+|[_\-:./]+$', '', 'g')), lambda r: r <> '')"
_IS = "(regexp_matches({t}, '^[A-Za-z][A-Za-z0-9]*:[0-9A-Za-z]{{4,}}$') OR ({t} LIKE '%\\_%' ESCAPE '\\' AND regexp_matches({t}, '[^_]')) OR regexp_matches({t}, '[a-z0-9][A-Z]') OR (regexp_matches({t}, '^[A-Za-z0-9]{{3,}}$') AND regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '[0-9]')))"


@query("txt_2", f"WITH {NOTES}, t AS (SELECT DISTINCT unnest({_RUNS.format(x='note')}) AS tok FROM notes) SELECT tok, {_IS.format(t='tok')} AS is_identifier FROM t")
def txt_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = notes(spark, sf_dir).select(F.explode_outer(T.identifier_runs(F.col("note"))).alias("tok")).filter("tok is not null").distinct()
    return toks.select("tok", T.is_identifier(F.col("tok")).alias("is_identifier"))


@query(
    "txt_3",
    f"WITH {NOTES}, r AS (SELECT doc_id, {_RUNS.format(x='note')} AS runs FROM notes), t AS (SELECT doc_id, unnest(runs) AS term, generate_subscripts(runs, 1) AS k FROM r), "
    f"f AS (SELECT doc_id, min_by(term, k) AS term, min(k) AS k FROM t WHERE {_IS.format(t='term')} GROUP BY doc_id, lower(term)) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS ord, term FROM f",
)
def txt_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of each note in their order, each once whatever its case."""
    from pyspark.sql import Window

    each = notes(spark, sf_dir).select("doc_id", F.posexplode_outer(T.identifier_runs(F.col("note"))).alias("at", "term")).filter(T.is_identifier(F.col("term")))
    first = each.groupBy("doc_id", F.lower("term")).agg(F.min_by("term", "at").alias("term"), F.min("at").alias("at"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("ord"), "term")


@query(
    "txt_4",
    rf"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w)) AS plain, {_RUNS.format(x='text')} AS runs FROM documents)
    SELECT doc_id, len(plain) AS n_plain, len(runs) AS n_whole, coalesce(list_sum(list_transform(plain, lambda w: greatest(0, length(w) - 3))), 0)::BIGINT AS n_grams, len(list_filter(plain, lambda w: NOT list_contains([{listed(T.STOP)}], w))) AS n_content FROM w""",
)
def txt_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the alternative tokenisations: plain words, whole runs, four-grams of the words, words without stop words."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)
    each = table(spark, sf_dir, "documents").select("doc_id", words.alias("plain"), F.size(T.identifier_runs(F.col("text"))).cast("long").alias("n_whole"))
    grams = F.aggregate("plain", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0), F.length(w) - 3))
    return each.select("doc_id", F.size("plain").cast("long").alias("n_plain"), "n_whole", grams.alias("n_grams"), F.size(F.filter("plain", lambda w: ~w.isin(T.STOP))).cast("long").alias("n_content"))


_BLANK = r"regexp_replace({x}, '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g')"
each_note("txt_5", lambda: {"plain": T.collapsed(F.col("note"))}, f"trim({_BLANK.format(x='note')}) AS plain")


@query(
    "txt_6",
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'aeo', 'аео') WHEN doc_id % 3 = 1 THEN concat(substring(text, 1, 100), ' да нет') ELSE text END AS t FROM documents),
    c AS (SELECT doc_id, len(regexp_extract_all(t, '[\x{0400}-\x{052F}]')) AS c, len(regexp_extract_all(t, '[A-Za-z]')) AS l, len(regexp_extract_all(t, '[\x{0400}-\x{052F}]+')) AS w FROM d)
    SELECT doc_id, CASE WHEN (c + l > 0 AND c / (c + l) >= 0.25) OR w >= 3 THEN 'ru' ELSE 'en' END AS lang FROM c""",
)
def txt_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeo", "аео")).when(F.col("doc_id") % 3 == 1, F.concat(F.substring("text", 1, 100), F.lit(" да нет"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.language(text).alias("lang"))


_HEAD = "'[Document: ' || regexp_extract(path, '[^/]*$') || ' | Section: ' || source || ' | Date: ' || {d} || ']' || chr(10) || chr(10)"
_DATE = "coalesce(strftime(try_cast(nullif(regexp_extract(note, '(?m)^(?:date|updated|last_updated):\\s*[''\"]?([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE), '%Y-%m-%d'), 'unknown')"
_FRONT = r"regexp_extract(note, '^[ \t\r]*---[ \t\r]*\n(?:[^\n]*\n){0,198}?[ \t\r]*---[ \t\r]*(?:\n|$)')"


def _header() -> Column:
    return T.source_header(T.basename(F.col("path")), F.col("source"), F.try_to_date(F.regexp_extract("note", T.FRONT_DATE, 1), "yyyy-MM-dd").cast("string"))


each_note("txt_7", lambda: {"header": _header()}, f"{_HEAD.format(d=_DATE)} AS header")
each_note(
    "txt_8",
    lambda: {"content": T.with_header(F.col("note"), F.lit("[Document: x]\n\n"))},
    f"CASE WHEN {_FRONT} = '' THEN '[Document: x]' || chr(10) || chr(10) || note ELSE {_FRONT} || CASE WHEN {_FRONT} LIKE '%' || chr(10) THEN '' ELSE chr(10) END || chr(10) || '[Document: x]' || chr(10) || chr(10) || ltrim(substring(note, length({_FRONT}) + 1), chr(10)) END AS content",
)
each_note(
    "txt_9",
    lambda: {"section": T.section_of(F.when(F.col("doc_id") % 5 == 1, F.lit(".session")).when(F.col("doc_id") % 5 == 2, F.lit("memory")).otherwise(F.col("source")), T.kind_of(_P()))},
    "CASE WHEN doc_id % 5 = 1 THEN 'session' WHEN doc_id % 5 = 2 THEN 'memory' WHEN source = '.session' THEN 'session' WHEN source = '.reports' THEN 'report' WHEN source = '.plans' THEN 'plan' WHEN source IN ('docs', 'memory') THEN source WHEN lower(path) LIKE '%.py' THEN 'code' ELSE 'docs' END AS section",
)


@query("txt_10", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d') END, CASE WHEN value > 10 THEN strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END, 'unknown') AS day FROM events")
def txt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's date: that of its commit, else of its file, else unknown (events stand for files here)."""
    commit, changed = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd")), F.when(F.col("value") > 10, F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(commit, changed, F.lit("unknown")).alias("day"))


_LINE = r"regexp_extract(substring(note, 1, 4000), '(?m)^\[Document: [^\n]*\| Date: [^\n]*\]\n\n')"
each_note(
    "txt_11",
    lambda: {"body": T.without_header(F.col("note"))["body"], "header_line": T.without_header(F.col("note"))["header_line"], "fifth": T.source_line(F.lit(5), T.without_header(F.col("note"))["header_line"], T.without_header(F.col("note"))["header_lines"])},
    rf"""CASE WHEN {_LINE} = '' THEN note ELSE substring(note, 1, strpos(note, {_LINE}) - 1) || substring(note, strpos(note, {_LINE}) + length({_LINE})) END AS body,
    (CASE WHEN {_LINE} = '' THEN 0 ELSE 1 + length(substring(note, 1, strpos(note, {_LINE}) - 1)) - length(replace(substring(note, 1, strpos(note, {_LINE}) - 1), chr(10), '')) END)::INT AS header_line,
    (CASE WHEN {_LINE} = '' OR 5 <= header_line THEN 5 WHEN 5 < header_line + 2 THEN header_line ELSE 3 END)::INT AS fifth""",
)
_HDATE = r"regexp_extract(substring(note, 1, 2000), '\[Document:[^|]*\|\s*Section:[^|]*\|\s*Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}|unknown)\s*\]', 1)"
_FDATE = "regexp_extract(substring(note, 1, 2000), '(?m)^(?:date|updated|last_updated):\\s*[''\"]?([0-9]{4}-[0-9]{2}-[0-9]{2})', 1)"
each_note("txt_12", lambda: {"day": T.chunk_date(F.col("note")).cast("string")}, f"CASE WHEN {_HDATE} <> '' THEN try_cast({_HDATE} AS DATE) ELSE try_cast({_FDATE} AS DATE) END::VARCHAR AS day")
each_note(
    "txt_13",
    lambda: {"day": T.ranking_date(F.col("note"), _P()).cast("string")},
    r"coalesce(try_cast(regexp_extract(substring(note, 1, 600), 'Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE), try_cast(regexp_extract(regexp_extract(path, '[^/]*$'), '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE))::VARCHAR AS day",
)
_STALE = r"""(regexp_matches(trim(regexp_extract(substring(note, 1, 1500), '(?m)^name:\s*(.+)$', 1)), '(?i)^\s*[-–—]*\s*(?:DEPRECATED|OBSOLETE|RETRACTED|SUPERSEDED)\b')
    OR regexp_matches(substring(note, 1, 1500), '(?i)\*\*THIS (?:MEMORY|DOCUMENT|NOTE) IS (?:DEPRECATED|OBSOLETE|SUPERSEDED)\b'))"""
each_note("txt_14", lambda: {"stale": T.is_deprecated(F.col("note"))}, f"{_STALE} AS stale")
_FIRST = r"trim(CASE WHEN contains(note, chr(10) || chr(10)) THEN split_part(note, chr(10) || chr(10), 1) ELSE '' END)"
each_note("txt_15", lambda: {"crumb": T.breadcrumb(F.col("note"))}, rf"CASE WHEN regexp_matches({_FIRST}, '^#{{1,6}}\s') THEN {_FIRST} ELSE '' END AS crumb")


def _cut(x: str, size: int, mark: str, line: bool) -> str:
    keep = size - len(mark) if line else size
    word = rf"nullif(regexp_extract(substring({x}, 1, {keep}), '(?s)^(.+) [^ ]*$', 1), '')"
    first = rf"nullif(regexp_extract(substring({x}, 1, {keep}), '(?s)^(.+)\n[^\n]*$', 1), ''), " if line else ""
    return rf"CASE WHEN length({x}) <= {size} THEN {x} ELSE regexp_replace(coalesce({first}{word}, substring({x}, 1, {keep})), '\s+$', '') || '{mark}' END"


each_note("txt_16", lambda: {"word": T.on_word(F.col("note"), 150), "line": T.on_line(F.col("note"), 180)}, f"{_cut('note', 150, '…', False)} AS word, {_cut('note', 180, '…[truncated]', True)} AS line")
_BARE = r"regexp_replace(note, '^\s+|\s+$', '', 'g')"
each_note("txt_17", lambda: {"snippet": T.snippet(F.col("note"))}, rf"CASE WHEN length({_BARE}) <= 240 THEN {_BARE} ELSE regexp_replace(substring({_BARE}, 1, 240), '\s+$', '') || '…' END AS snippet")
_DESC = "concat(source, '<SEP>', lang, '<SEP> ', source, ' <SEP>', substring(text, 1, doc_id % 3 * 300))"


@query(
    "txt_18",
    f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE {_DESC} END AS d FROM documents), p AS (SELECT doc_id, CASE WHEN contains(d, '<SEP>') THEN (SELECT string_agg(p, ' | ' ORDER BY k) FROM (SELECT trim(u.p) AS p, min(u.k) AS k FROM (SELECT unnest(string_split(d, '<SEP>')) AS p, generate_subscripts(string_split(d, '<SEP>'), 1) AS k) u WHERE trim(u.p) <> '' GROUP BY 1)) ELSE d END AS j FROM d) SELECT doc_id, {_cut('j', 400, '…', False)} AS description FROM p",
)
def txt_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.expr(_DESC))
    return table(spark, sf_dir, "documents").select("doc_id", T.one_description(given).alias("description"))


_TERMS = f"list_filter(list_distinct(list_transform(regexp_extract_all({{x}}, '[A-Za-z][A-Za-z0-9_]{{{{3,}}}}'), lambda w: lower(w))), lambda w: NOT list_contains([{listed(T.STOP)}], w) AND NOT list_contains(list_transform(list_filter({_RUNS.format(x='{x}').replace('{', '{{').replace('}', '}}').replace('{{x}}', '{x}')}, lambda t: {_IS.format(t='t').replace('{', '{{').replace('}', '}}')}), lambda t: lower(t)), w))"


@query("txt_19", f"SELECT item_id, list_sort({_TERMS.format(x='text')}) AS terms FROM (SELECT item_id, text || ' hyp:1a2b3c ' || text || ' snake_case' AS text FROM benchmark)")
def txt_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" hyp:1a2b3c "), "text", F.lit(" snake_case")).alias("text"))
    return asked.select("item_id", F.sort_array(T.content_terms(F.col("text"))).alias("terms"))


@query("txt_20", "WITH t AS (SELECT list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{5,}'), lambda w: lower(w)))) AS terms FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) SELECT doc_id, CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda w: contains(lower(text), w))) / len(terms) END AS share FROM documents, t")
def txt_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of one question's terms that each document holds."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)), F.lower))
    one = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(words.alias("terms"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low")).crossJoin(F.broadcast(one))  # one row
    return docs.select("doc_id", T.overlap(F.col("low"), F.col("terms")).alias("share"))


each_note("txt_21", lambda: {"depth": T.heading_depth(F.regexp_replace("note", r"(?s)^(---.*?---\n)?(\[[^\n]*\]\n\n)?", ""))}, r"length(regexp_extract(regexp_replace(note, '(?s)^(---.*?---\n)?(\[[^\n]*\]\n\n)?', ''), '^(#{1,6})\s', 1))::INT AS depth")
each_note("txt_22", lambda: {"code": T.is_code(F.col("note"))}, r"(length(note) > 0 AND ((length(note) - length(regexp_replace(note, '(?s)```.*?```', '', 'g'))) / length(note) >= 0.3 OR length(note) - length(replace(note, '`', '')) >= 20)) AS code")
_WORDS = r"list_filter(list_transform(regexp_extract_all(note, '[A-Za-z][A-Za-z0-9_.:/-]{2,}'), lambda w: regexp_replace(w, '[.,:;()\[\]{}]+$', '')), lambda w: length(w) >= 4 AND NOT list_contains([" + listed(T.KEYWORD_STOP) + "], lower(w)))"


@query(
    "txt_23",
    f"WITH {NOTES}, w AS (SELECT doc_id, {_WORDS} AS ws FROM notes), t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM w), f AS (SELECT doc_id, min_by(w, k) AS w, min(k) AS k FROM t GROUP BY doc_id, lower(w)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM f) SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS words FROM r WHERE n <= 5 GROUP BY doc_id",
)
def txt_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("doc_id", T.keywords(F.col("note")).alias("words"))


_WINDOW = r"trim(regexp_replace(l, '\s+', ' ', 'g'))"


@query("txt_24", f"WITH {NOTES}, l AS (SELECT doc_id, unnest(string_split(note, chr(10))) AS l FROM notes) SELECT doc_id, substring({_WINDOW}, 1, 260) AS evidence, count(*) AS n FROM l WHERE length({_WINDOW}) >= 120 AND NOT starts_with({_WINDOW}, '```') AND NOT starts_with({_WINDOW}, '---') GROUP BY ALL")
def txt_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence windows: long lines that aren't fences, cut."""
    line = notes(spark, sf_dir).select("doc_id", F.explode(F.split("note", "\n")).alias("l")).select("doc_id", F.trim(F.regexp_replace("l", r"\s+", " ")).alias("l"))
    line = line.filter((F.length("l") >= 120) & ~F.col("l").startswith("```") & ~F.col("l").startswith("---"))
    return line.groupBy("doc_id", F.left("l", F.lit(260)).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "txt_25",
    f"WITH w AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]{{3,}}'), lambda w: lower(w)), lambda w: NOT list_contains([{listed(T.STOP)}], w))) AS ws FROM benchmark) "
    "SELECT a.item_id, b.item_id AS next_id, CASE WHEN len(a.ws) + len(b.ws) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) END AS similarity FROM w a JOIN w b ON b.item_id = a.item_id + 1",
)
def txt_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    own = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(words, lambda w: ~w.isin(T.STOP))).alias("ws"))
    after = own.select(F.col("item_id").alias("next_id"), (F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("after"))
    return own.join(after, "item_id").select("item_id", "next_id", T.jaccard(F.col("ws"), F.col("after")).alias("similarity"))


@query("txt_26", r"SELECT p_partkey, lower(trim(regexp_replace(concat(' ', p_type, '_-', p_name, '__', p_brand, ' '), '[_\-\s]+', ' ', 'g'))) AS entity FROM part")
def txt_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.entity_text(F.concat(F.lit(" "), "p_type", F.lit("_-"), "p_name", F.lit("__"), "p_brand", F.lit(" "))).alias("entity"))


_GOLD = "CASE WHEN doc_id % 3 = 0 THEN concat(source, '/', regexp_extract(path, '[^/]*$')) WHEN doc_id % 3 = 1 THEN regexp_extract(path, '[^/]*$') ELSE concat('x/', regexp_extract(path, '[^/]*$')) END"
each_note(
    "txt_27",
    lambda: {"hit": T.matches_gold(_P(), F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/"), T.basename(_P()))).when(F.col("doc_id") % 3 == 1, T.basename(_P())).otherwise(F.concat(F.lit("x/"), T.basename(_P()))))},
    f"CASE WHEN contains({_GOLD}, '/') THEN path = {_GOLD} OR path LIKE '%/' || {_GOLD} ELSE regexp_extract(path, '[^/]*$') = {_GOLD} END AS hit",
)
each_note("txt_28", lambda: {"digest": T.fingerprint(F.col("note"))}, "sha256(note) AS digest")
each_note("txt_29", lambda: {"chunk_id": T.chunk_id(F.col("doc_id"), F.lit(3))}, "'chunk-' || substring(sha256(doc_id::VARCHAR || ':3'), 1, 16) AS chunk_id")
each_note("txt_30", lambda: {"tokens": T.token_estimate(F.col("note"))}, r"(CASE WHEN regexp_replace(note, '\s', '', 'g') = '' THEN 0 ELSE greatest(1, length(note) // 4) END)::INT AS tokens")
_OUT = "concat('entity<|#|>', source, '<|#|>KIND<|#|>', substring(text, 1, 20), chr(10), '`Relation`<|#|> a <|#|>b<|#|>k<|#|>d', chr(10), 'relation<|#|>', lang, chr(10), chr(10), CASE WHEN doc_id % 2 = 0 THEN '<|COMPLETE|>' ELSE 'loose' END)"


@query(
    "txt_31",
    f"WITH o AS (SELECT doc_id, {_OUT} AS o FROM documents), l AS (SELECT doc_id, contains(o, '<|COMPLETE|>') AS complete, trim(unnest(string_split(o, chr(10)))) AS l FROM o), p AS (SELECT doc_id, complete, l, string_split(l, '<|#|>') AS p FROM l WHERE l <> '' AND l <> '<|COMPLETE|>') "
    "SELECT doc_id, complete, CASE WHEN trim(lower(trim(p[1])), '`') = 'entity' AND len(p) = 4 THEN 'entity' WHEN trim(lower(trim(p[1])), '`') = 'relation' AND len(p) = 5 THEN 'relation' ELSE 'malformed' END AS kind, substring(l, 1, 120) AS line, len(p)::INT AS parts FROM p",
)
def txt_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an extractor's output: entities of four parts, relations of five, the rest malformed."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.expr(_OUT).alias("o"))
    line = own.select("doc_id", F.contains("o", F.lit("<|COMPLETE|>")).alias("complete"), F.explode(F.split("o", "\n")).alias("l")).withColumn("l", F.trim("l")).filter("l <> '' and l <> '<|COMPLETE|>'")
    parts = F.split("l", r"<\|#\|>")
    tag = F.trim(F.lower(F.trim(parts[0])), F.lit("`"))
    kind = F.when((tag == "entity") & (F.size(parts) == 4), "entity").when((tag == "relation") & (F.size(parts) == 5), "relation").otherwise("malformed")
    return line.select("doc_id", "complete", kind.alias("kind"), F.left("l", F.lit(120)).alias("line"), F.size(parts).alias("parts"))


each_note("txt_32", lambda: {"said": T.without_thoughts(F.concat(F.lit(" <think>a\nb</think>"), F.left("note", F.lit(80)), F.lit("<think>c</think> end ")))}, r"regexp_replace(regexp_replace(' <think>a' || chr(10) || 'b</think>' || substring(note, 1, 80) || '<think>c</think> end ', '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS said")
each_note(
    "txt_34",
    lambda: {"cited": F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("note", F.lit(r"[A-Za-z0-9_./-]+\.md"), F.lit(0)))), ","), "runs": F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("note", F.lit(r"hyp:[0-9a-f]{8}"), F.lit(0)))), ",")},
    r"array_to_string(list_sort(list_distinct(regexp_extract_all(note, '[A-Za-z0-9_./-]+\.md'))), ',') AS cited, array_to_string(list_sort(list_distinct(regexp_extract_all(note, 'hyp:[0-9a-f]{8}'))), ',') AS runs",
)


@query(
    "txt_36",
    f"WITH w AS (SELECT item_id, regexp_extract_all(text, '[^ ]+') AS ws FROM benchmark), t AS (SELECT item_id, trim(unnest(ws)) AS term, generate_subscripts(ws, 1) AS k FROM w) "
    r"SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY NOT ((regexp_matches(term, '[A-Z]') AND regexp_matches(term, '[a-z]')) OR regexp_matches(term, '[_0-9/.]') OR (regexp_matches(term, '[A-Z]') AND NOT regexp_matches(term, '[a-z]') AND length(term) >= 2) OR length(term) > 4), k))::INT AS ord, term "
    f"FROM t WHERE term <> '' AND lower(term) NOT IN ({listed(T.GREP_STOP)})",
)
def txt_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grep terms, specific ones first, otherwise in their order."""
    from pyspark.sql import Window

    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("k", "term")).withColumn("term", F.trim("term"))
    each = each.filter((F.col("term") != "") & ~F.lower("term").isin(T.GREP_STOP))
    return each.select("item_id", F.row_number().over(Window.partitionBy("item_id").orderBy(~T.is_specific(F.col("term")), "k")).alias("ord"), "term")


_TITLE = "regexp_replace(trim(" + _BLANK.format(x="'\"' || note") + "), '^[\"''`]+|[\"''`]+$', '', 'g')"
each_note("txt_37", lambda: {"title": T.title(F.concat(F.lit('"'), F.col("note")))}, f"{_cut(_TITLE, 120, '…', False)} AS title")
_CONTEXT = """concat('{"entity": "', source, '", "type": "t"}', chr(10), '  {"entity1": "a", "entity2": "', lang, '"}', chr(10), '[', CAST(doc_id AS STRING), '] ', source, '/x.md', chr(10), 'loose', chr(10), '{"reference_id": "', CAST(doc_id AS STRING), '", "content": "c"}', chr(10), '[bad]', chr(10), '{"other": 1}')"""


@query(
    "txt_38",
    f"WITH c AS (SELECT doc_id, trim(unnest(string_split({_CONTEXT}, chr(10)))) AS l FROM documents), k AS (SELECT doc_id, l, CASE WHEN starts_with(l, '[') THEN CASE WHEN regexp_matches(l, '^\\[[^\\]]+\\]\\s+.+$') THEN 'reference' END WHEN NOT starts_with(l, '{{') THEN NULL WHEN json_extract_string(l, '$.reference_id') IS NOT NULL THEN 'source' "
    "WHEN json_extract_string(l, '$.entity1') IS NOT NULL OR json_extract_string(l, '$.entity2') IS NOT NULL THEN 'relation' WHEN json_extract_string(l, '$.entity') IS NOT NULL THEN 'entity' END AS kind FROM c) "
    "SELECT doc_id, kind, CASE kind WHEN 'reference' THEN regexp_extract(l, '^\\[([^\\]]+)\\]', 1) WHEN 'source' THEN json_extract_string(l, '$.reference_id') WHEN 'relation' THEN json_extract_string(l, '$.entity2') ELSE json_extract_string(l, '$.entity') END AS name FROM k WHERE kind IS NOT NULL".replace("{{", "{"),
)
def txt_38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered context read back line by line: entities, relations, sources and references."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.expr(_CONTEXT), "\n")).alias("l")).withColumn("l", F.trim("l"))
    field = lambda name: F.when(F.col("l").startswith("{"), F.get_json_object("l", f"$.{name}"))
    kind = F.when(F.col("l").startswith("["), F.when(F.col("l").rlike(r"^\[[^\]]+\]\s+.+$"), "reference")).when(field("reference_id").isNotNull(), "source")
    kind = kind.when(field("entity1").isNotNull() | field("entity2").isNotNull(), "relation").when(field("entity").isNotNull(), "entity")
    name = F.when(F.col("kind") == "reference", F.regexp_extract("l", r"^\[([^\]]+)\]", 1)).when(F.col("kind") == "source", field("reference_id")).when(F.col("kind") == "relation", field("entity2")).otherwise(field("entity"))
    return line.withColumn("kind", kind).filter("kind is not null").select("doc_id", "kind", name.alias("name"))


_DOC = r"'(?s)\[Document:\s*(.*?)\s*\|\s*Section:\s*(.*?)\s*\|'"
_TOP = rf"trim(split_part({_BARE}, chr(10), 1))"
each_note(
    "txt_39",
    lambda: {"doc": T.hit_document(F.col("note"), _P())["doc"], "section": T.hit_document(F.col("note"), _P())["section"]},
    rf"CASE WHEN regexp_matches(note, {_DOC}) AND regexp_extract(note, {_DOC}, 1) <> '' THEN regexp_extract(note, {_DOC}, 1) ELSE regexp_extract(path, '[^/]*$') END AS doc, CASE WHEN regexp_matches(note, {_DOC}) THEN regexp_extract(note, {_DOC}, 2) WHEN regexp_matches({_TOP}, '^#{{1,6}}\s') THEN {_TOP} ELSE '' END AS section",
)
each_note("src_8", lambda: {"kind": T.kind_of(_P())}, "CASE WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.json' THEN 'json' ELSE 'text' END AS kind")
each_note("src_9", lambda: {"id": T.stable_id(_P(), moved={"/kb": "/home"})}, "'file:' || substring(sha256(regexp_replace(replace(path, '/ingested/', '/'), '^/kb', '/home')), 1, 12) AS id")
