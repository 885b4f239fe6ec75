"""Files in: by type, with parsers that can be exchanged."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerline.functions.text import squeeze, usable_text
from ledgerline.sources.html import format_table, html_text, keep_table, tables_text

EXTENSIONS = {"pdf": ("pdf",), "csv": ("csv",), "html": ("html", "htm", "xhtml")}
MIME_TYPES = {"pdf": ("application/pdf",), "csv": ("text/csv", "application/csv"), "html": ("text/html", "application/xhtml+xml")}


def file_type(name: Column, mime: Column | None = None) -> Column:
    """pdf, csv or html by extension or MIME type; null if neither is known."""
    extension = F.regexp_extract(F.lower(name), r"\.([^./\\]+)$", 1)
    kind = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    out = F.lit(None).cast("string")
    for t in ("html", "csv", "pdf"):
        out = F.when(extension.isin(*EXTENSIONS[t]) | kind.isin(*MIME_TYPES[t]), t).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder of any file system Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def byte_range(content: Column, start: Column, end: Column) -> Column:
    """Bytes from start to end inclusive, as a range request asks for them."""
    return F.substr(content, start + 1, end - start + 1)


def _csv_text(data: bytes) -> str:
    rows = [[v.strip() for v in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if r]
    if not rows:
        return ""
    header, *records = rows
    name = lambda i: (header[i] if i < len(header) else "") or f"Column {i + 1}"
    return "\n\n".join(f"Row {n}\n" + "\n".join(f"{name(i)}: {v}" for i, v in enumerate(r)) for n, r in enumerate(records, 1))


def _csv_batch(content: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _csv_text(x) for x in content.to_pylist()], pa.string())


_csv_batch.__annotations__ = {"content": pa.Array, "return": pa.Array}
#: Records as "header: value" lines; ragged records keep all their values, which Spark's CSV reader would drop.
csv_text = F.arrow_udf(_csv_batch, StringType())


def html_document(content: Column) -> Column:
    """Text and finance tables of a page; null if the text is unusable (it needs OCR)."""
    html = F.decode(content, "UTF-8")
    text = html_text(html)
    return F.when(usable_text(text), F.concat_ws("\n\n", text, F.nullif(tables_text(html), F.lit(""))))


#: Extracts a PDF's pages: bytes in, (page, text, items) out; none is part of this library.
PdfReader = Callable[[bytes], list[tuple[int, str, list[tuple[str, float, float]]]]]


def pdf_pages(files: DataFrame, reader: PdfReader) -> tuple[DataFrame, DataFrame]:
    """((path, page, text), (path, page, text, x, y)): pages and their placed items, by a reader that is plugged in."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n, t) for p, c in zip(batch["path"].to_pylist(), batch["content"].to_pylist()) for n, t, _ in reader(c)]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=("path", "page", "text"))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n, *i) for p, c in zip(batch["path"].to_pylist(), batch["content"].to_pylist()) for n, _, found in reader(c) for i in found]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()))], names=("path", "page", "text", "x", "y"))

    own = files.select("path", "content")
    return own.mapInArrow(pages, "path string, page int, text string"), own.mapInArrow(items, "path string, page int, text string, x double, y double")


def placed_tables(items: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """(keys, table): rows of placed items (keys, text, x, y) as a finance table.

    Items within three units of height make a row, from the top; rows need
    three items, the page eight.
    """
    clean = items.withColumn("text", squeeze(F.col("text"))).where("text <> ''").withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("y", F.coalesce("y", F.lit(0.0)))
    counted = clean.withColumn("n_", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("n_ >= 8")
    level = F.floor(F.col("y") / 3 + 0.5) * 3
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"])
    rows = counted.groupBy(*keys, level.alias("level")).agg(cells.alias("cells")).where(F.size("cells") >= 3)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("at"), "cells"))), lambda r: r["cells"])
    pages = rows.groupBy(*keys).agg(ordered.alias("rows")).where(keep_table(F.col("rows")))
    return pages.select(*keys, format_table(F.col("rows"), F.concat(F.lit("pdf-page-"), F.col(keys[-1]).cast("string"))).alias("table"))


def parse_files(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """(path, type, text) of files (path, content); text is null where a PDF or OCR reader would be needed, type where none is known."""
    typed = files.withColumn("type", file_type(F.col("path")))
    rest = typed.where("type is null or type not in ('csv', 'html')").select("path", "type", F.lit(None).cast("string").alias("text"))
    tables = typed.where("type = 'csv'").select("path", "type", csv_text(F.col("content")).alias("text"))
    pages = typed.where("type = 'html'").select("path", "type", html_document(F.col("content")).alias("text"))
    if pdf:
        text, items = pdf_pages(typed.where("type = 'pdf'"), pdf)
        found = placed_tables(items, ("path", "page"))
        whole = text.join(found, ["path", "page"], "left").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text", "table"))), lambda r: F.concat_ws("\n", r["text"], r["table"])), "\n").alias("text"))
        rest = rest.where("type is null").union(whole.select("path", F.lit("pdf").alias("type"), "text"))
    return tables.unionByName(pages).unionByName(rest)


def check_manifest(manifest: DataFrame, companies: DataFrame, files: DataFrame, types: tuple[str, ...], languages: tuple[str, ...]) -> DataFrame:
    """(file, problem) of import rows (file, company_slug, report_type, output_language); an import needs an empty result."""
    unknown = manifest.join(companies.select(F.col("slug").alias("company_slug")), "company_slug", "left_anti").select("file", F.lit("unknown company").alias("problem"))
    absent = manifest.join(files.select("file"), "file", "left_anti").select("file", F.lit("no such file").alias("problem"))
    kind = manifest.where(~F.coalesce(F.col("report_type").isin(*types), F.lit(False))).select("file", F.lit("unknown report type").alias("problem"))
    language = manifest.where(~F.coalesce("output_language", F.lit("en")).isin(*languages)).select("file", F.lit("unknown language").alias("problem"))
    return unknown.union(absent).union(kind).union(language)
