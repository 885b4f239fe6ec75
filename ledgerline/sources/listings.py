"""Share lists of an exchange as HTML, and the company dimension that follows them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import slug, strip

# Home markets of a list, with exchange, country and the order of exchanges; marks of its cells.
MARKETS = {"TLN": ("Nasdaq Tallinn", "EE"), "RIG": ("Nasdaq Riga", "LV"), "VLN": ("Nasdaq Vilnius", "LT")}
TICKER = r'class="text16 compname">([A-Z0-9]{2,10})</a>'
TITLE = r'compname-flex[^>]*\s+title="([^"]+)"'
SORTED = r'<td data-sort-by="([^"]+)"'
HOME = r'd-none">(' + "|".join(MARKETS) + r')</td>\s*\n\s*<td><a href="//lt\.morningstar'
SECTOR = r'tablesaw-toggle-cellhidden d-none text12"><span title="([^"]+)"'
UNKNOWN = "Unknown"
FIELDS = ("name", "exchange", "country", "sector")


def _picked(key: Column, values: Mapping[str, str]) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()), F.lit(None).cast("string"))


def parse_listing(pages: DataFrame, page: str = "page_id", html: str = "html", sectors: Mapping[str, str] | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """(page, row, ticker, name, exchange, country, sector) of the share lists in pages.

    A table row is a share if it has a ticker, a name and a home market; rows
    count from 1, others included.  A sector of Unknown gives way to the row's
    second.  sectors and names overrule those of the tickers they list.  Every
    page is read in one pass; other pages and null ones give no rows.
    """
    blocks = F.split(F.col(html), "<tr")
    each = pages.select(F.col(page).alias("page"), F.posexplode(F.slice(blocks, F.lit(2), F.size(blocks))).alias("row", "block")).withColumn("block", F.substring_index("block", "</tr>", 1))
    part = lambda p: F.nullif(F.regexp_extract("block", p, 1), F.lit(""))
    found = F.regexp_extract_all("block", F.lit(SECTOR), F.lit(1))
    first = F.coalesce(strip(F.get(found, F.lit(0))), F.lit(UNKNOWN))
    sector = F.when((first == UNKNOWN) & (F.size(found) > 1), strip(F.get(found, F.lit(1)))).otherwise(first)
    ticker, home = part(TICKER), part(HOME)
    rows = each.select("page", (F.col("row") + 1).alias("row"), ticker.alias("ticker"), strip(F.coalesce(part(TITLE), part(SORTED))).alias("name"), home.alias("home"), sector.alias("sector"))
    shares = rows.where(F.col("ticker").isNotNull() & (F.col("name") != "") & F.col("home").isNotNull())
    name = F.coalesce(_picked(F.col("ticker"), names or {}), "name")
    market = lambda i: _picked(F.col("home"), {k: v[i] for k, v in MARKETS.items()})
    return shares.select("page", "row", "ticker", name.alias("name"), market(0).alias("exchange"), market(1).alias("country"), F.coalesce(_picked(F.col("ticker"), sectors or {}), "sector").alias("sector"))


def with_slugs(listing: DataFrame, held: DataFrame, fixed: Mapping[str, str] | None = None) -> DataFrame:
    """listing with slug: what the ticker has in ``held`` (ticker, slug), else a fixed one, else one of its name.

    A slug that held or an earlier ticker has gets a number after two hyphens,
    which no name gives, from 2 on and past all numbers that held has; so slugs
    never change nor clash, whatever the order of rows.
    """
    base = F.coalesce(_picked(F.col("ticker"), fixed or {}), F.nullif(slug(F.col("name"), keep_marks=False), F.lit("")), F.lower("ticker"))
    own = listing.join(held.select("ticker", F.col("slug").alias("held_")), "ticker", "left").withColumn("base_", base)
    new = own.where("held_ is null")
    # numbers that are taken: the slug itself counts as 1
    tail = F.regexp_extract("slug", r"--(\d{1,9})$", 1)
    stem = F.regexp_replace("slug", r"--\d{1,9}$", "")
    used = held.select(F.col("slug").alias("base_"), F.lit(1).alias("at_")).unionByName(held.where(tail != "").select(stem.alias("base_"), tail.cast("int").alias("at_")))
    top = used.groupBy("base_").agg(F.max("at_").alias("top_"))
    turn = F.row_number().over(W.partitionBy("base_").orderBy("ticker")) + F.coalesce("top_", F.lit(0))
    numbered = new.join(top, "base_", "left").withColumn("n_", turn).select("ticker", F.when(F.col("n_") == 1, F.col("base_")).otherwise(F.concat("base_", F.lit("--"), F.col("n_").cast("string"))).alias("new_"))
    return own.join(numbered, "ticker", "left").withColumn("slug", F.coalesce("held_", "new_")).select(*(c for c in listing.columns if c != "slug"), "slug")


def sync(companies: DataFrame, listing: DataFrame, fixed: Mapping[str, str] | None = None) -> DataFrame:
    """(ticker, slug, name, exchange, country, sector, status): the dimension after a listing, one row per ticker.

    status is inserted, changed, unchanged or gone; gone companies stay as they
    are, as their reports do.  companies (ticker, slug, FIELDS), listing
    (ticker, FIELDS, page, row); of a ticker that is listed twice the first row
    counts.  Syncing again with the same listing changes nothing.
    """
    one = listing.withColumn("n_", F.row_number().over(W.partitionBy("ticker").orderBy("page", "row"))).where("n_ = 1").drop("n_")
    placed = with_slugs(one, companies, fixed)
    a, b = companies.select("ticker", "slug", *FIELDS).alias("a"), placed.alias("b")
    joined = a.join(b, F.col("a.ticker") == F.col("b.ticker"), "full_outer")
    same = F.lit(True)
    for c in FIELDS:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    status = F.when(F.col("b.ticker").isNull(), "gone").when(F.col("a.ticker").isNull(), "inserted").when(same, "unchanged").otherwise("changed")
    new = lambda c: F.when(F.col("b.ticker").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return joined.select(F.coalesce("a.ticker", "b.ticker").alias("ticker"), F.coalesce("a.slug", "b.slug").alias("slug"), *(new(c) for c in FIELDS), status.alias("status"))
