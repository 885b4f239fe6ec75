"""HTML files as text and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import decode_entities, squeeze

# Words of finance tables in English, Estonian, Latvian and Lithuanian.
KEYWORDS = ("revenue", "sales", "ebitda", "profit", "loss", "assets", "equity", "liabilities", "cash", "capex", "income", "expenses", "tulu", "kasum", "varad", "omakapital", "ieņēmumi", "peļņa", "aktīvi", "pajamos", "pelnas", "turtas")
#: Rows of a table that its text shows, a limit of the feature: the rest of a longer table is left out. tables() has all.
ROWS = 80
OMITTED = ("script", "style", "noscript", "svg")


def _until(text: Column, end: str) -> Column:
    """The text up to the last match of ``end``, which is in it; empty without one.

    A pattern that starts anywhere in it and runs to the next ``end`` finds one,
    so no opening is tried in vain and a search takes linear time.
    """
    return F.regexp_extract(text, rf"(?is)^(.*{end})", 1)


def _cut(html: Column, pattern: str, end: str) -> Column:
    """A space for each match of a pattern that runs to the next ``end``."""
    return F.transform(F.array(_until(html, end)), lambda head: F.concat(F.regexp_replace(head, pattern, " "), F.substr(html, F.length(head) + 1)))[0]


def _strip_tags(html: Column) -> Column:
    """A space for each tag; what stands after the last > holds none."""
    rest = F.substring_index(html, ">", -1)
    head = F.substr(html, F.lit(1), F.length(html) - F.length(rest))
    return F.concat(F.regexp_replace(head, "<[^>]*>", " "), rest)


def _without(html: Column, name: str) -> Column:
    cut = lambda h: _cut(h, rf"(?is)<{name}[\s>].*?</{name}\s*>", rf"</{name}\s*>")
    return F.transform(F.array(html), lambda h: F.when(h.rlike(rf"(?i)<{name}[\s>]"), cut(h)).otherwise(h))[0]


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; references decoded, white space squeezed.

    An opening without its end tag is a tag like any other, one without its >
    is text.
    """
    for name in OMITTED:
        html = _without(html, name)
    # each step is computed once, however often the next one names it
    return squeeze(decode_entities(F.transform(F.array(html), _strip_tags)[0]))


def has_keyword(text: Column) -> Column:
    return F.lower(text).rlike("|".join(KEYWORDS))


def numeric_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c.rlike("[0-9]")))


def cell(text: Column) -> Column:
    return squeeze(F.replace(text, F.lit("|"), F.lit("/")))


def is_useful(row: Column) -> Column:
    return has_keyword(F.array_join(row, " ")) | (numeric_cells(row) >= 2)


def keep_table(rows: Column) -> Column:
    """Two rows or more, two of them useful, and a word of finance."""
    return (F.size(rows) >= 2) & F.exists(rows, lambda r: has_keyword(F.array_join(r, " "))) & (F.size(F.filter(rows, is_useful)) >= 2)


def format_table(rows: Column, source: Column) -> Column:
    """A table's first ROWS rows between marks."""
    body = F.array_join(F.transform(F.slice(rows, 1, ROWS), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n")
    return F.concat(F.lit('[STRUCTURED FINANCIAL TABLE source="'), source, F.lit('"]\n'), body, F.lit("\n[/STRUCTURED FINANCIAL TABLE]"))


def _cells(row: Column) -> Column:
    """What stands between the first opening of a cell and the next end tag of one."""
    parts = F.split(row, r"(?i)</t[hd]\s*>", -1)
    opening = r"(?is)^(.*?<t[hd][^>]*>)"
    tops = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(p.alias("part"), F.regexp_extract(_until(p, ">"), opening, 1).alias("top")))
    return F.transform(F.filter(tops, lambda x: x["top"] != ""), lambda x: F.substr(x["part"], F.length(x["top"]) + 1))


def table_rows(table: Column) -> Column:
    """Rows of two or more cells with text; only references by name are decoded in cells."""
    rows = F.regexp_extract_all(_until(table, r"</tr\s*>"), F.lit(r"(?is)<tr.*?</tr\s*>"), F.lit(0))
    clean = lambda c: squeeze(_named(_strip_tags(c)))
    cells = F.transform(rows, lambda r: F.filter(F.transform(_cells(r), clean), lambda c: c != ""))
    return F.filter(cells, lambda r: F.size(r) >= 2)


def _named(text: Column) -> Column:
    from ledgerline.functions.text import ENTITIES

    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, "(?i)&nbsp;|&#160;", " ")


def tables(html: Column) -> Column:
    """array of (number, rows) of the finance tables; every table counts for the number."""
    found = F.regexp_extract_all(_until(html, r"</table\s*>"), F.lit(r"(?is)<table.*?</table\s*>"), F.lit(0))
    each = F.transform(found, lambda t, i: F.struct((i + 1).alias("number"), table_rows(t).alias("rows")))
    return F.filter(each, lambda t: keep_table(t["rows"]))


def tables_text(html: Column) -> Column:
    return F.array_join(F.transform(tables(html), lambda t: format_table(t["rows"], F.concat(F.lit("html-table-"), t["number"].cast("string")))), "\n\n")
