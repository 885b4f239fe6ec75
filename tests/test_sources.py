import time

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.text import needs_trends
from ledgerline.operators.metrics import explode_metrics
from ledgerline.schema import SNAPSHOT
from ledgerline.sources import files as S
from ledgerline.sources.html import html_text, tables_text


def test_csv(spark):
    cases = ["﻿a,b\n1, x \n\n2,y,z\n", "", "only,header\n", 'a\n"q, ""r"""\n', "a,b\n1\n"]
    df = spark.createDataFrame([(i, c.encode()) for i, c in enumerate(cases)], "i int, c binary")
    got = [r[0] for r in df.orderBy("i").select(S.csv_text("c")).collect()]
    assert got == ["Row 1\na: 1\nb: x\n\nRow 2\na: 2\nb: y\nColumn 3: z", "", "", 'Row 1\na: q, "r"', "Row 1\na: 1"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.html").write_text("<html><script>x</script><p>Words enough for usable text here</p><table><tr><td>Revenue</td><td>5</td></tr><tr><td>Profit</td><td>6</td></tr></table></html>")
    (tmp_path / "c.html").write_text("<p>1</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"?")
    found = {r.path.rsplit("/", 1)[1]: (r.type, r.text) for r in S.parse_files(S.read_files(spark, str(tmp_path))).collect()}
    assert found["a.csv"] == ("csv", "Row 1\nk: 1\nv: 2") and found["c.html"] == ("html", None) and found["d.pdf"] == ("pdf", None) and found["e.bin"] == (None, None)
    assert found["b.html"][1].startswith("Words enough") and '[STRUCTURED FINANCIAL TABLE source="html-table-1"]\n| Revenue | 5 |\n| Profit | 6 |' in found["b.html"][1]

    def reader(data):
        return [(1, "page one", [(t, float(x), float(y)) for y, row in ((90, ("Revenue", "1", "2")), (60, ("Profit", "3", "4")), (30, ("Cash", "5", "6"))) for x, t in enumerate(row)]), (2, "page two", [])]

    pdf = {r.path.rsplit("/", 1)[1]: r.text for r in S.parse_files(S.read_files(spark, str(tmp_path)), reader).collect()}["d.pdf"]
    assert pdf.split("\n")[0] == "page one" and "| Profit | 3 | 4 |" in pdf and pdf.endswith("page two")


def test_byte_range(spark):
    df = spark.createDataFrame([(b"0123456789",)], "c binary")
    assert bytes(df.select(S.byte_range(F.col("c"), F.lit(2), F.lit(4))).first()[0]) == b"234"


def test_snapshots(spark):
    good = '{"metadata": {"companyName": "A"}, "metrics": [{"label": "Revenue", "value": 1.5, "evidence": {"confidence": 0.9}}, {"label": "EPS"}]}'
    df = spark.createDataFrame([(1, good), (2, "{bad"), (3, None)], "id int, j string").withColumn("snapshot", F.from_json("j", SNAPSHOT))
    assert [(r.id, r.ok) for r in df.select("id", F.col("snapshot.metadata").isNotNull().alias("ok")).orderBy("id").collect()] == [(1, True), (2, False), (3, False)]
    assert [(r.doc, r.ord, r.label, r.value, r.confidence) for r in explode_metrics(df).orderBy("ord").collect()] == [(1, 0, "Revenue", 1.5, 0.9), (1, 1, "EPS", None, None)]


def test_manifest(spark):
    m = spark.createDataFrame([("a", "x", "annual", None), ("b", "y", "weekly", "fr"), ("c", None, None, "en")], "file string, company_slug string, report_type string, output_language string")
    bad = S.check_manifest(m, spark.createDataFrame([("x",)], "slug string"), spark.createDataFrame([("a",), ("b",)], "file string"), ("annual",), ("en", "et"))
    assert sorted(map(tuple, bad.collect())) == [("b", "unknown company"), ("b", "unknown language"), ("b", "unknown report type"), ("c", "no such file"), ("c", "unknown company"), ("c", "unknown report type")]


#: Tags and texts that searches can start over at, again and again.
PARTS = ("<script ", "<script>", "<style ", "</script ", "<table ", "<table>", "<tr ", "<tr><td ", "<td ", "<td>", "<", "</tr", "&", "<!--", "2020,", "Q1 ", "years 2020, ")


@pytest.mark.parametrize("part", PARTS)
def test_broken_texts_take_linear_time(spark, part):
    long = part * (1_000_000 // len(part))
    texts = [long, f"<table><tr><td>Revenue</td><td>1</td></tr><tr><td>{long}</td><td>x</td></tr></table>", "years " + long + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, html string").repartition(3)
    began = time.perf_counter()
    df.select("i", F.length(html_text(F.col("html"))).alias("n"), F.length(tables_text(F.col("html"))).alias("m"), needs_trends(F.col("html")).alias("t")).collect()
    assert time.perf_counter() - began < 30


def test_openings_without_ends(spark):
    cases = {
        "<script>a</script>b<script>c": "b c", "<SCRIPT x>a</script >b</script>c": "b c", "<style>a<script>b</style>c</script>d": "a d", "a<b": "a<b", "a<b>c<d": "a c<d", "<svg>a</svg>b<svg": "b<svg", "": "", "x</style>": "x",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, html string")
    assert [r[0] for r in df.orderBy("i").select(html_text(F.col("html"))).collect()] == [*cases.values()]


def test_tables_with_odd_cells(spark):
    page = "<table><tr><th>Revenue<th>no end</th><td class='a'>1 200</td></tr><tr><td>Profit</td>x<td>3|4</TD ><td></td></tr><tr><td>open</tr></table><table><tr><td>lost"
    row = spark.createDataFrame([(page,)], "html string").select(tables_text(F.col("html"))).first()[0]
    assert row.split("\n")[1:-1] == ["| Revenue no end | 1 200 |", "| Profit | 3/4 |"]
