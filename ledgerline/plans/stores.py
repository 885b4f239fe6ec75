"""Queries on share lists and on files and what refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources import listings as L
from ledgerline.sources import storage_audit as A
from ledgerline.plans.inputs import Made, table
from ledgerline.plans.registry import query
from ledgerline.plans.snapshots import company_name, dealt

_K = "s_suppkey"
_NAME = company_name(_K)
_SECTORS = ("Financials", "Unknown", "Utilities", "Energy", "Unknown")
_SPAN = lambda s: "'<td class=\"tablesaw-toggle-cellhidden d-none text12\"><span title=\"' || " + s + " || '\">s</span></td>'"
#: A row of a share list for each supplier; some lack a ticker, a title or a market of the list.
_ROW = f"""'<tr class="r"><td data-sort-by="' || {_NAME} || '"><div class="compname-flex"' || CASE WHEN {_K} % 7 = 0 THEN '' ELSE ' title="' || {_NAME} || ' "' END || '><a class="text16 compname">' || CASE WHEN {_K} % 11 = 0 THEN 'x' ELSE 'T' || CAST(CAST(floor({_K} / 2) AS BIGINT) * 2 AS STRING) || {dealt(("L", "T"), _K)} END || '</a></div></td>'
 || {_SPAN(dealt(_SECTORS, _K))} || CASE WHEN {_K} % 3 = 0 THEN {_SPAN("'Industrials'")} ELSE '' END || '<td class="d-none">' || {dealt(("TLN", "RIG", "VLN", "OSL"), "s_nationkey + " + _K)} || '</td>' || chr(10) || ' <td><a href="//lt.morningstar/x">x</a></td></tr>'"""
_FIXED, _OVERRULED, _RENAMED = {"T2L": "the-second", "T4T": "the-second"}, {"T6L": "Materials"}, {"T8T": "AS Shown Name"}
_X = lambda p, of="block": f"nullif(regexp_extract({of}, '{p}', 1), '')"
_CASES = lambda key, values: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"
_LISTED = f"""pages_ AS (SELECT s_nationkey AS page, '<table><tr><th>Name</th></tr>' || string_agg({_ROW}, '' ORDER BY {_K}) || '</table>' AS html FROM supplier GROUP BY s_nationkey),
blocks AS (SELECT page, generate_subscripts(string_split(html, '<tr'), 1) - 1 AS row, split_part(unnest(string_split(html, '<tr')), '</tr>', 1) AS block FROM pages_),
cells AS (SELECT page, row, {_X(L.TICKER)} AS ticker, trim(coalesce({_X(L.TITLE)}, {_X(L.SORTED)})) AS name, {_X(L.HOME)} AS home, regexp_extract_all(block, '{L.SECTOR}', 1) AS sectors FROM blocks WHERE row > 0),
listed AS (SELECT page, CAST(row AS INTEGER) AS row, ticker, coalesce({_CASES('ticker', _RENAMED)}, name) AS name, {_CASES('home', {k: v[0] for k, v in L.MARKETS.items()})} AS exchange, {_CASES('home', {k: v[1] for k, v in L.MARKETS.items()})} AS country,
 coalesce({_CASES('ticker', _OVERRULED)}, CASE WHEN coalesce(sectors[1], 'Unknown') = 'Unknown' AND len(sectors) > 1 THEN sectors[2] ELSE coalesce(sectors[1], 'Unknown') END) AS sector FROM cells WHERE ticker IS NOT NULL AND name <> '' AND home IS NOT NULL)"""


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").selectExpr("s_nationkey AS page_id", _K, f"{_ROW} AS r")
    html = F.concat(F.lit("<table><tr><th>Name</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_K, "r"))), lambda x: x["r"]), ""), F.lit("</table>"))
    return L.parse_listing(rows.groupBy("page_id").agg(html.alias("html")), sectors=_OVERRULED, names=_RENAMED)


@query("A17_listing", f"WITH {_LISTED} SELECT * FROM listed")
def share_list(spark: SparkSession, sf: str) -> DataFrame:
    """A share list of each nation's suppliers, read from its HTML."""
    return _listed(spark, sf)


#: The dimension before: companies of two thirds of the suppliers, some under old names, some that are listed no more.
_HELD = Made(
    (
        f"'T' || CAST(CAST(floor({_K} / 2) AS BIGINT) * 2 AS STRING) || CASE WHEN {_K} % 9 = 0 THEN 'X' ELSE {dealt(('L', 'T'), _K)} END AS ticker", f"CASE WHEN {_K} % 6 = 1 THEN 'the-second--' || CAST({_K} AS STRING) ELSE 'held-' || CAST({_K} AS STRING) END AS slug", f"CASE WHEN {_K} % 4 = 0 THEN 'Old' ELSE {_NAME} END AS name",
        "CAST(NULL AS STRING) AS exchange", "CAST(NULL AS STRING) AS country", "'Energy' AS sector",
    ),
    source="supplier", where=f"{_K} % 3 <> 0",
)
_SLUG = "regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("A16_sync", f"""WITH {_LISTED}, held AS (SELECT * FROM {_HELD.sql}), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY page, row) AS n FROM listed) WHERE n = 1),
based AS (SELECT o.*, h.slug AS held, coalesce({_CASES('o.ticker', _FIXED)}, nullif({_SLUG.replace('name', 'o.name')}, ''), lower(o.ticker)) AS base FROM one o LEFT JOIN held h USING (ticker)),
used AS (SELECT slug AS base, 1 AS num FROM held UNION ALL SELECT regexp_replace(slug, '--[0-9]+$', ''), CAST(regexp_extract(slug, '--([0-9]+)$', 1) AS INTEGER) FROM held WHERE regexp_matches(slug, '--[0-9]+$')), top AS (SELECT base, max(num) AS top FROM used GROUP BY base),
turns AS (SELECT ticker, base, row_number() OVER (PARTITION BY base ORDER BY ticker) + coalesce(top, 0) AS n FROM based LEFT JOIN top USING (base) WHERE held IS NULL),
placed AS (SELECT b.*, coalesce(held, CASE WHEN t.n = 1 THEN t.base ELSE t.base || '--' || t.n END) AS slug FROM based b LEFT JOIN turns t USING (ticker))
SELECT coalesce(h.ticker, p.ticker) AS ticker, coalesce(h.slug, p.slug) AS slug, {', '.join(f'CASE WHEN p.ticker IS NULL THEN h.{c} ELSE p.{c} END AS {c}' for c in L.FIELDS)},
 CASE WHEN p.ticker IS NULL THEN 'gone' WHEN h.ticker IS NULL THEN 'inserted' WHEN {' AND '.join(f'h.{c} IS NOT DISTINCT FROM p.{c}' for c in L.FIELDS)} THEN 'unchanged' ELSE 'changed' END AS status FROM held h FULL JOIN placed p ON h.ticker = p.ticker""")
def synced(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension after the share list."""
    return L.sync(_HELD.df(spark, sf), _listed(spark, sf), _FIXED)


_FILES = Made(("'reports/' || CAST(o_orderkey AS STRING) || '.pdf' AS key", "o_custkey AS size"), where="o_orderkey % 5 <> 0")
_FILED = Made(("CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'reports/' || CAST(o_orderkey AS STRING) || '.pdf' END AS key",), where="o_orderkey % 3 <> 0")
_TRIED = Made(("'reports/' || CAST(o_orderkey AS STRING) || '.pdf' AS key",), where="o_orderkey % 7 = 0")


@query("A26_purge", f"""WITH f AS (SELECT * FROM {_FILES.sql}), r AS (SELECT key FROM {_FILED.sql} UNION SELECT key FROM {_TRIED.sql})
SELECT 'orphan' AS kind, key, size FROM f WHERE key NOT IN (SELECT key FROM r WHERE key IS NOT NULL) AND NOT starts_with(key, 'reports/1') UNION ALL SELECT 'dangling', key, NULL FROM r WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM f)""")
def purge(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run: files that no report or candidate names, and names without a file."""
    files, references = _FILES.df(spark, sf).withColumn("path", F.col("key")), [_FILED.df(spark, sf), _TRIED.df(spark, sf)]
    gone = A.purge(files, references, kept=("reports/1",)).select(F.lit("orphan").alias("kind"), "key", "size")
    return gone.unionByName(A.dangling(files, references).select(F.lit("dangling").alias("kind"), "key", F.lit(None).cast("long").alias("size")))
