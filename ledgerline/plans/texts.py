"""Queries on texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators.matching import name_tokens
from ledgerline.plans.inputs import CLASS_TEXTS, FILES, HTML, ITEMS, LINES, MESSAGES, NARRATIVES, VARIANTS, table
from ledgerline.plans.registry import query, re2
from ledgerline.sources import files as S
from ledgerline.sources import html as P

_WS = r"[\s\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
SQUEEZE = lambda x: f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"
MARKS = lambda x: f"translate({x}, '{X.MARKED}', '{X.PLAIN}')"
COMPACT = lambda x: f"trim(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}%]+', ' ', 'g'))"


@query("A1_file_type", f"SELECT doc, name, CASE WHEN regexp_matches(lower(name), '\\.pdf$') OR mime = 'application/pdf' THEN 'pdf' WHEN regexp_matches(lower(name), '\\.csv$') OR mime IN ('text/csv', 'application/csv') THEN 'csv' WHEN regexp_matches(lower(name), '\\.(html|htm|xhtml)$') OR mime IN ('text/html', 'application/xhtml+xml') THEN 'html' END AS file_type FROM {FILES.sql}")
def file_types(spark: SparkSession, sf: str) -> DataFrame:
    return FILES.df(spark, sf).select("doc", "name", S.file_type(F.col("name"), F.col("mime")).alias("file_type"))


@query("A4_placed_tables", f"""WITH c AS (SELECT doc, page, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, x, y, count(*) OVER (PARTITION BY doc, page) AS n FROM {ITEMS.sql}),
r AS (SELECT doc, page, floor(y / 3 + 0.5) * 3 AS level, list(text ORDER BY x) AS cells FROM c WHERE n >= 8 GROUP BY ALL HAVING count(*) >= 3)
SELECT doc, page, '[STRUCTURED FINANCIAL TABLE source="pdf-page-' || page || '"]' || chr(10) || string_agg('| ' || array_to_string(cells, ' | ') || ' |', chr(10) ORDER BY level DESC) || chr(10) || '[/STRUCTURED FINANCIAL TABLE]' AS table_text FROM r GROUP BY doc, page""")
def placed_tables(spark: SparkSession, sf: str) -> DataFrame:
    return S.placed_tables(ITEMS.df(spark, sf)).withColumnRenamed("table", "table_text")


@query("A6_csv_text", "SELECT r_name AS region, string_agg('Row ' || n || chr(10) || 'key: ' || n_nationkey || chr(10) || 'name: ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'Column 3: extra' ELSE '' END, chr(10) || chr(10) ORDER BY n) AS csv_text FROM (SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name")
def csv_text(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(', "'), F.col("n_name"), F.lit('" '), F.when(F.col("n_nationkey") % 2 == 0, ",extra").otherwise(""))
    joined = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    content = F.concat(F.lit("﻿key,name\n\n"), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n")).cast("binary")
    return joined.select(F.col("r_name").alias("region"), S.csv_text(F.regexp_replace(content.cast("string"), ', "', ',"').cast("binary")).alias("csv_text"))


_STRIP = "regexp_replace(" * 5 + "html" + "".join(f", '(?is)<{n}[\\s>].*?</{n}\\s*>', ' ', 'g')" for n in P.OMITTED) + ", '<[^>]*>', ' ', 'g')"
_ENT = lambda x: f"regexp_replace(replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', ''''), '(?i)&nbsp;', ' ', 'g')"


@query("A7_html_text", f"SELECT page_id, {SQUEEZE(_ENT(_STRIP))} AS page_text FROM pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", P.html_text(F.col("html")).alias("page_text"))


_KEY = re2("|".join(P.KEYWORDS))
_CELL = SQUEEZE("regexp_replace(replace(replace(c, '&amp;', '&'), '&nbsp;', ' '), '<[^>]*>', ' ', 'g')")
_TABLES = f"""WITH t AS (SELECT page, unnest(regexp_extract_all(html, '(?is)<table.*?</table\\s*>')) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<table.*?</table\\s*>'), 1) AS number FROM {HTML.sql}),
r AS (SELECT page, number, unnest(regexp_extract_all(t, '(?is)<tr.*?</tr\\s*>')) AS r, generate_subscripts(regexp_extract_all(t, '(?is)<tr.*?</tr\\s*>'), 1) AS n FROM t),
c AS (SELECT page, number, n, list_filter(list_transform(regexp_extract_all(r, '(?is)<t[hd][^>]*>(.*?)</t[hd]\\s*>', 1), lambda c: {_CELL}), lambda c: c <> '') AS cells FROM r),
k AS (SELECT *, regexp_matches(lower(array_to_string(cells, ' ')), {_KEY}) AS word, len(list_filter(cells, lambda c: regexp_matches(c, '[0-9]'))) AS numbers FROM c WHERE len(cells) >= 2)
SELECT page, CAST(number AS INTEGER) AS number, CAST(count(*) AS INTEGER) AS n_rows, string_agg('| ' || array_to_string(list_transform(cells, lambda c: trim(regexp_replace(replace(c, '|', '/'), '\\s+', ' ', 'g'))), ' | ') || ' |', chr(10) ORDER BY n) AS body FROM k GROUP BY page, number HAVING count(*) >= 2 AND bool_or(word) AND count(*) FILTER (word OR numbers >= 2) >= 2"""


@query("A8_html_tables", _TABLES)
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = HTML.df(spark, sf).select("page", F.explode(P.tables(F.col("html"))).alias("t"))
    body = F.array_join(F.transform("t.rows", lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, P.cell), " | "), F.lit(" |"))), "\n")
    return found.select("page", "t.number", F.size("t.rows").alias("n_rows"), body.alias("body"))


@query("A10_decode_entities", f"SELECT page_id, {_ENT("html")} AS decoded FROM pages")
def decode_entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.decode_entities(F.col("html")).alias("decoded"))


_Q = SQUEEZE("text")


@query("A11_usable_text", f"SELECT doc_id, length({_Q}) >= 20 AND len(regexp_extract_all({_Q}, '[A-Za-zÀ-ž]')) >= 0.45 * length({_Q}) AND len(regexp_extract_all({_Q}, '[A-Za-zÀ-ž]{{3,}}')) >= 3 AS usable FROM documents")
def usable_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.usable_text(F.col("text")).alias("usable"))


@query("A12_row_signals", f"SELECT doc, no, regexp_matches(lower(line), {_KEY}) AS keyword, len(list_filter(string_split(line, ' '), lambda c: regexp_matches(c, '[0-9]'))) AS numbers FROM {LINES.sql}")
def row_signals(spark: SparkSession, sf: str) -> DataFrame:
    return LINES.df(spark, sf).select("doc", "no", P.has_keyword(F.col("line")).alias("keyword"), P.numeric_cells(F.split("line", " ")).cast("long").alias("numbers"))


@query("A25_byte_range", "SELECT doc_id, substr(regexp_replace(text, '[^ -~]', '?', 'g'), 11, 20) AS part FROM documents")
def byte_range(spark: SparkSession, sf: str) -> DataFrame:
    ascii_ = F.regexp_replace("text", "[^ -~]", "?").cast("binary")
    return table(spark, sf, "documents").select("doc_id", S.byte_range(ascii_, F.lit(10), F.lit(29)).cast("string").alias("part"))


_MANIFEST = "SELECT o_orderkey AS file, CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_custkey END AS company_slug, CASE WHEN o_orderkey % 11 = 0 THEN 'weekly' ELSE 'annual' END AS report_type FROM orders"


@query("A15_manifest_errors", f"WITH m AS ({_MANIFEST}) SELECT file, 'unknown company' AS problem FROM m WHERE company_slug NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT file, 'no such file' FROM m WHERE file NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2) UNION ALL SELECT file, 'unknown report type' FROM m WHERE report_type = 'weekly'")
def manifest_errors(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    manifest = o.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_custkey") % 9 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("company_slug"), F.when(F.col("o_orderkey") % 11 == 0, "weekly").otherwise("annual").alias("report_type"), F.lit("en").alias("output_language"))
    files = table(spark, sf, "lineitem").groupBy("l_orderkey").count().where("count >= 2").select(F.col("l_orderkey").alias("file"))
    return S.check_manifest(manifest, table(spark, sf, "customer").select(F.col("c_custkey").alias("slug")), files, ("annual",), ("en",))


@query("G3_strip_marks", f"SELECT doc_id, {MARKS('text')} AS plain FROM documents")
def strip_marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.strip_marks(F.col("text")).alias("plain"))


@query("G4_normalize_label", f"SELECT doc_id, {MARKS(SQUEEZE('text'))} AS label FROM documents")
def normalize_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalize_label(F.col("text")).alias("label"))


@query("G1_compact_label", f"SELECT doc_id, {COMPACT('text')} AS label FROM documents")
def compact_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.compact_label(F.col("text")).alias("label"))


@query("G5_levenshtein", "SELECT a, b, distance FROM (SELECT p_partkey AS a, lead(p_partkey) OVER w AS b, levenshtein(p_name, lead(p_name) OVER w) AS distance FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey)) WHERE b IS NOT NULL")
def levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    """Every part with the next of its brand and size."""
    own = W.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(own).alias("b"), "p_name", F.lead("p_name").over(own).alias("next_name"))
    return pairs.where("b is not null").select("a", "b", F.levenshtein("p_name", "next_name").cast("long").alias("distance"))


_W = lambda x: f"list_distinct(regexp_split_to_array(lower({x}), '{_WS}'))"


@query("G6_word_jaccard", f"SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect({_W('a.text')}, {_W('b.text')})) / len(list_distinct(list_concat({_W('a.text')}, {_W('b.text')}))) AS jaccard FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's whole text against the next one's."""
    t = table(spark, sf, "documents").select("doc_id", "text")
    after = t.select(F.col("doc_id").alias("b"), (F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return t.join(after, "doc_id").select(F.col("doc_id").alias("a"), "b", X.word_jaccard(F.col("text"), F.col("next_text")).alias("jaccard"))


NAME = lambda x: "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(" + x + "), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[\\s-]+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g'))"
_NAME = NAME("section")
_ALIAS = " ".join(f"WHEN {_NAME} IN ({', '.join(repr(n) for n in names)}) THEN '{target}'" for target, names in X.SECTION_ALIASES.items())


def canonical_section_sql(x: str) -> str:
    return f"CASE WHEN {NAME(x)} IN ({', '.join(map(repr, X.SECTIONS))}) THEN {NAME(x)} {_ALIAS.replace(_NAME, NAME(x))} ELSE 'other' END"


@query("G7_sections", f"SELECT doc, ord, {_NAME} AS name, {canonical_section_sql('section')} AS canonical FROM {NARRATIVES.sql}")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    return NARRATIVES.df(spark, sf).select("doc", "ord", X.section_name(F.col("section")).alias("name"), X.canonical_section(F.col("section")).alias("canonical"))


@query("G8_chart_labels", "SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS label FROM documents")
def chart_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.chart_label(F.col("text")).alias("label"))


@query("G9_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(' ' || p_name || ' ')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.slug(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")), keep_marks=False).alias("slug"))


@query("G10_safe_names", "SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._ -]+', '_', 'g'), '\\s+', ' ', 'g'), 1, 100) AS file FROM documents")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.safe_filename(F.col("text")).alias("file"))


@query("G11_snippets", f"SELECT doc_id, CASE WHEN length({_Q}) > 240 THEN substr({_Q}, 1, 237) || '...' WHEN {_Q} <> '' THEN {_Q} END AS snippet FROM documents")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("G12_first_paragraphs", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT doc_id, {SQUEEZE('line')} AS line, n FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY n) AS k FROM s WHERE line <> ''), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM f WHERE k = 1)
SELECT doc_id, place, line FROM t WHERE place <= 3""")
def first_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", X.squeeze(F.col("line"))).where("line <> ''")
    one = lines.withColumn("k", F.row_number().over(W.partitionBy("doc_id", F.lower("line")).orderBy("n"))).where("k = 1")
    return one.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("n")).cast("long").alias("place"), "line").where("place <= 3")


@query("G13_chunks", "SELECT doc_id, CAST(i AS INTEGER) AS chunk, substr(text, CAST(1 + i * 900 AS INTEGER), 1000) AS part FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 1000) / 900) AS BIGINT), 0))) AS i FROM documents WHERE length(text) > 0)")
def chunked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 1000, 100)).alias("chunk", "part"))


_TREND = re2("|".join(f"(?:{p})" for p in X.TREND_SIGNS))


@query("G14_stages", f"SELECT doc_id, contains(lower(text), '{X.TABLE_MARK}') OR regexp_matches(lower(text), {_TREND}) AS trends, length(text) > 5000 AS narratives FROM documents UNION ALL SELECT -doc, contains(lower(text), '{X.TABLE_MARK}') OR regexp_matches(lower(text), {_TREND}), length(text) > 5000 FROM {CLASS_TEXTS.sql}")
def stages(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "text").union(CLASS_TEXTS.df(spark, sf).select(-F.col("doc").cast("long"), "text"))
    return both.select("doc_id", X.needs_trends(F.col("text")).alias("trends"), X.needs_narratives(F.col("text")).alias("narratives"))


def _class_sql(source: str) -> str:
    head = f"substr(text, 1, {X.CLASS_CHARS})"
    hits = lambda name: " + ".join(f"contains({head}, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in X.CLASS_PHRASES[name])
    parts = " ".join(f"WHEN {hits(n)} >= {X.CLASS_LEAST[n]}{f' AND NOT regexp_matches({head}, {re2(X.FINANCE_TERMS)})' if n == 'press_release' else ''} THEN '{n}'" for n in X.CLASS_PHRASES)
    return f"SELECT doc_id, CASE WHEN len(list_distinct(regexp_extract_all(lower({head}), '[a-z]{{4,}}'))) < 10 THEN 'low_quality_text' {parts} ELSE 'financial_report' END AS class FROM {source}"


@query("G15_document_class", _class_sql("documents") + " UNION ALL " + _class_sql(f"(SELECT -doc AS doc_id, text FROM {CLASS_TEXTS.sql})"))
def document_class(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "text").union(CLASS_TEXTS.df(spark, sf).select(-F.col("doc").cast("long"), "text"))
    return both.select("doc_id", X.document_class(F.col("text")).alias("class"))


@query("E16_E17_hits", f"SELECT doc, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}'))) AS long_words, {' + '.join(f'''contains(text, '{p}')::INT''' for p in X.CLASS_PHRASES['legal_filing'])} AS legal FROM {CLASS_TEXTS.sql}")
def hits(spark: SparkSession, sf: str) -> DataFrame:
    return CLASS_TEXTS.df(spark, sf).select("doc", X.distinct_long_words(F.col("text")).cast("long").alias("long_words"), X.phrase_hits(F.col("text"), X.CLASS_PHRASES["legal_filing"]).alias("legal"))


@query("G16_boilerplate", f"SELECT doc, no, line FROM {LINES.sql} WHERE trim(line) = '' OR NOT regexp_matches(trim(line), {re2(X.BOILERPLATE_PATTERN)})")
def boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return LINES.df(spark, sf).where(~X.is_boilerplate(F.trim("line"))).select("doc", "no", "line")


_PRE = f"""WITH l AS (SELECT doc_id, length(text) AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) = '' OR NOT regexp_matches(trim(line, ' ' || chr(9) || chr(13)), {re2(X.BOILERPLATE_PATTERN)})),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS seen FROM k)
SELECT doc_id, any_value(whole) AS before, coalesce(sum(length(line)) FILTER (t = '' OR length(t) <= 5 OR seen < 3), 0) + greatest(count(*) FILTER (t = '' OR length(t) <= 5 OR seen < 3) - 1, 0) AS after FROM c GROUP BY doc_id"""


def prefilter(docs: DataFrame) -> DataFrame:
    """(doc_id, before, n, line, keep): lines without boilerplate, and whether they come fewer than three times."""
    strip = F.trim(F.col("line"), F.lit(" \t\r"))
    lines = docs.select("doc_id", F.length("text").alias("before"), F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("t", strip).where(~X.is_boilerplate(F.col("t")))
    seen = F.count(F.lit(1)).over(W.partitionBy("doc_id", "t"))
    return lines.withColumn("keep", (F.col("t") == "") | (F.length("t") <= 5) | (seen < 3)).drop("t")


@query("F11_G17_prefilter", _PRE)
def prefiltered(spark: SparkSession, sf: str) -> DataFrame:
    kept = prefilter(table(spark, sf, "documents"))
    n = F.count_if("keep")
    size = F.coalesce(F.sum(F.when(F.col("keep"), F.length("line"))), F.lit(0)) + F.greatest(n - 1, F.lit(0))
    return kept.groupBy("doc_id").agg(F.first("before").cast("long").alias("before"), size.cast("long").alias("after"))


@query("E15_line_counts", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) > 5 GROUP BY ALL HAVING count(*) >= 2")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where(F.length("line") > 5)
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


TOKENS = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace({x}, '(?i)\\ba\\s*/\\s*s\\b', ' ', 'g')), '[.,;:()''\"„“”’/\\\\&]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND t NOT IN ('ab', 'as', 'ou', 'oü', 'uab', 'sia', 'ipas', 'asa', 'oyj', 'plc', 'ltd', 'inc'))"


@query("G18_name_tokens", f"SELECT doc, array_to_string({TOKENS('name')}, ' ') AS tokens FROM {VARIANTS.sql}")
def name_words(spark: SparkSession, sf: str) -> DataFrame:
    return VARIANTS.df(spark, sf).select("doc", F.array_join(name_tokens(F.col("name")), " ").alias("tokens"))


@query("G22_message_parts", f"SELECT id, nullif(regexp_extract(message, 'company=(\\w+)', 1), '') AS company, nullif(regexp_extract(message, 'type=([\\w-]+)', 1), '') AS kind FROM {MESSAGES.sql}")
def message_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract("message", p, 1), F.lit(""))
    return MESSAGES.df(spark, sf).select("id", part(r"company=(\w+)").alias("company"), part(r"type=([\w-]+)").alias("kind"))


@query("G23_lead_fields", "SELECT conv_id, turn, nullif(substr(trim(text), 1, 120), '') AS message, regexp_matches(text, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS has_mail, lower(trim(role)) AS role FROM conversations")
def lead_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.nullif(F.substring(F.trim("text"), 1, 120), F.lit("")).alias("message"), F.col("text").rlike(r"[^\s@]+@[^\s@]+\.[^\s@]+").alias("has_mail"), F.lower(F.trim("role")).alias("role"))
