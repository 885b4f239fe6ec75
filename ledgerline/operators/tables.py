"""Keyed tables without row-level updates: each change gives a new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.numbering import positions


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    turned = [c.desc() for c in order]
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(*turned))).where("n_ = 1").drop("n_")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new, one row per key.

    Of a key in both tables, columns in ``overwrite`` come from new, those in
    ``fill`` from new unless null there, and the rest from old.  new must have a
    key once (see last_per_key).  Null keys are no keys: such rows are all kept.
    """
    a, b = old.withColumn("old_", F.lit(True)).alias("a"), new.withColumn("new_", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, on, "full_outer")

    def pick(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        both = F.coalesce(y, x) if c in fill or c in keys else y if c in overwrite else x
        return F.when(F.col("new_").isNull(), x).when(F.col("old_").isNull(), y).otherwise(both).alias(c)

    return joined.select(*(pick(c) for c in old.columns))


def insert_unique(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(inserted, duplicates): rows of new whose key is free, and those that lose.

    As with a unique index, a key with a null never collides.
    """
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    marked = new.withColumn("null_", has_null).withColumn("turn_", turn)
    taken = old.select(*keys).distinct().withColumn("taken_", F.lit(True))
    joined = marked.join(taken, list(keys), "left").withColumn("free_", F.col("null_") | (F.col("taken_").isNull() & (F.col("turn_") == 1)))
    return tuple(joined.where("free_" if want else "not free_").select(*new.columns) for want in (True, False))


#: Rows of a key that meet the other side in one task.
PART = 1_000


def null_safe_pairs(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(old_id, new_id) of all rows (id, ...) with the same keys, null being the same as null.

    A key with more than PART rows in old, as those without a company, is cut
    into parts by id, each of which meets all rows of new with the key; so no
    task has a whole such key's pairs.
    """
    heavy = old.groupBy(*keys).count().where(F.col("count") > PART).select(*keys, F.ceil(F.col("count") / PART).cast("int").alias("parts_"))
    parts = F.coalesce("parts_", F.lit(1))

    def dealt(df: DataFrame, part: Column) -> DataFrame:
        joined = df.alias("a").join(F.broadcast(heavy.alias("b")), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
        return joined.select("a.id", *(F.col(f"a.{k}") for k in keys), part.alias("part_"))

    a, b = dealt(old, F.pmod(F.xxhash64("a.id"), parts).cast("int")), dealt(new, F.explode(F.sequence(F.lit(0), parts - 1)))
    a, b = (df.select(F.col("id").alias(f"{side}_id"), *(F.col(k).alias(f"{side}_{k}") for k in (*keys, "part_"))) for df, side in ((a, "old"), (b, "new")))
    return a.join(b, [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in keys] + [F.col("old_part_") == F.col("new_part_")]).select("old_id", "new_id")


def patch(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Partial updates: ``changes`` has the key, values, and set_<column> flags; a set null clears, an unset one leaves."""
    joined = df.alias("a").join(changes.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    value = lambda c: F.when(F.coalesce(F.col(f"b.set_{c}"), F.lit(False)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(*(value(c) if c in columns else F.col(f"a.{c}") for c in df.columns))


def promote(candidates: DataFrame, reports: DataFrame, chosen: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, reports) after the pending candidates whose id is in ``chosen`` replace their report's job, key and snapshot."""
    picked = candidates.join(chosen.select("id").distinct().withColumn("picked_", F.lit(True)), "id", "left").withColumn("go_", F.col("picked_").isNotNull() & (F.col("status") == "pending_review"))
    after = picked.withColumn("status", F.when(F.col("go_"), "approved").otherwise(F.col("status"))).withColumn("approved_at", F.when(F.col("go_"), as_of).otherwise(F.col("approved_at")))
    fields = ("job_id", "s3_key", "extracted_json_snapshot")
    winner = last_per_key(picked.where("go_"), ["report_id"], [F.col("created_at"), F.col("id")]).select(F.col("report_id").alias("id"), *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("hit_"))
    joined = reports.join(winner, "id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)))
    return after.select(*candidates.columns), joined.select(*reports.columns)


def reject(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pending and failed candidates whose id is in ``chosen`` become rejected."""
    picked = candidates.join(chosen.select("id").distinct().withColumn("picked_", F.lit(True)), "id", "left")
    go = F.col("picked_").isNotNull() & F.col("status").isin("pending_review", "failed_quality")
    return picked.withColumn("status", F.when(go, "rejected").otherwise(F.col("status"))).select(*candidates.columns)


def set_company(reports: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping (id, company_id): the reports named there get its company, also a null one."""
    changes = mapping.withColumn("set_company_id", F.lit(True))
    return patch(reports, changes, "id", ["company_id"])


def move_to_unmatched(reports: DataFrame, audits: DataFrame, ids: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, refused): ids outside the audit are refused; without ``confirm`` nothing changes."""
    refused = ids.join(audits.select("id"), "id", "left_anti")
    if not confirm:
        return reports, refused
    moved = ids.join(audits.select("id"), "id", "left_semi").select("id").distinct().withColumn("company_id", F.lit(None).cast("string"))
    return set_company(reports, moved), refused


def delete_company(companies: DataFrame, reports: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting companies sets their reports' company to null."""
    left = companies.join(gone, "id", "left_anti")
    marked = reports.join(gone.select(F.col("id").alias("company_id"), F.lit(True).alias("gone_")), "company_id", "left")
    return left, marked.withColumn("company_id", F.when(F.col("gone_"), None).otherwise(F.col("company_id"))).select(*reports.columns)


def delete_reports(reports: DataFrame, candidates: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting reports deletes their candidates."""
    return reports.join(gone, "id", "left_anti"), candidates.join(gone.select(F.col("id").alias("report_id")), "report_id", "left_anti")


def search(df: DataFrame, query: str, contains: Sequence[str], prefix: Sequence[str]) -> DataFrame:
    """Rows with the query in a ``contains`` column, or at the start of a ``prefix`` column as text; an empty query is none.

    % and _ in the query are wildcards.
    """
    q = query.strip()
    if not q:
        return df
    hit = F.lit(False)
    for c in contains:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    for c in prefix:
        hit = hit | F.coalesce(F.col(c).cast("string").like(f"{q}%"), F.lit(False))
    return df.where(hit)


def with_any(df: DataFrame, column: str, values: Sequence[str] | None, allowed: Sequence[str]) -> DataFrame:
    """Rows with one of the allowed values asked for; asking for none of them asks for all rows."""
    chosen = [v for v in values or () if v in allowed]
    return df.where(F.col(column).isin(*chosen)) if chosen else df


def search_reports(reports: DataFrame, companies: DataFrame, query: str = "", n: int | None = None) -> DataFrame:
    """Reports with their company's name and ticker that a search finds, by name, newest year first; n rows at most (clamp_limit()).

    reports (id, company_id, fiscal_year, report_type), companies (id, name,
    ticker).  The query may stand anywhere in a name or ticker, or begin the
    year; reports without a company come last.
    """
    joined = reports.join(companies.select(F.col("id").alias("company_id"), "name", "ticker"), "company_id", "left")
    found = search(joined, query, ("name", "ticker"), ("fiscal_year",))
    return found.orderBy(F.col("name").asc_nulls_last(), F.col("fiscal_year").desc(), "report_type", "id").limit(clamp_limit(n))


def clamp_limit(n: int | None, default: int = 200, most: int = 500) -> int:
    return default if n is None else min(max(int(n), 1), most)


def newest(df: DataFrame, time: str, tie: str, n: int | None) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(tie)).limit(clamp_limit(n))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with ``place``: its running number from 1 by group, then by order; nulls come first."""
    placed = positions(df.withColumn("all_", F.lit(0)), "all_", [F.col(c) for c in (group, *order)])
    return placed.withColumn("place", F.col("position") + 1).drop("all_", "position")
