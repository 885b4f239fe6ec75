"""Share lists, the dimension that follows them, and files against what refers to them."""

import pytest

from ledgerline.plans import stores
from ledgerline.sources import listings as L
from ledgerline.sources import storage_audit as A

HELD = "ticker string, slug string, name string, exchange string, country string, sector string"
LISTED = "page int, row int, ticker string, name string, exchange string, country string, sector string"


def test_syncing_twice_changes_nothing(spark, sf_dir):
    listed = stores._listed(spark, "/root/testdata/sf0.01")
    once = L.sync(stores._HELD.df(spark, "/root/testdata/sf0.01"), listed, stores._FIXED).cache()
    assert {r.status for r in once.select("status").distinct().collect()} >= {"inserted", "changed", "gone"}
    twice = L.sync(once, listed, stores._FIXED).collect()
    assert {r.status for r in twice} == {"unchanged", "gone"}
    assert {(r.ticker, r.slug, r.name) for r in twice} == {(r.ticker, r.slug, r.name) for r in once.collect()}
    assert len({r.slug for r in twice}) == len(twice) == len({r.ticker for r in twice})


def test_slugs_never_clash(spark):
    held = spark.createDataFrame([("A", "x", "X", None, None, None), ("B", "x--4", "X", None, None, None), ("C", "old", "Gone", None, None, None)], HELD)
    names = [("D", "X"), ("E", "x!"), ("F", "X 2"), ("G", "X"), ("H", "—"), ("A", "New name"), ("I", "Žeme Õ"), ("D", "second row")]
    listed = spark.createDataFrame([(1, i, t, n, "e", "c", None) for i, (t, n) in enumerate(names)], LISTED).repartition(3)
    got = {r.ticker: (r.slug, r.name, r.status) for r in L.sync(held, listed, {"G": "fixed"}).collect()}
    assert got == {
        "A": ("x", "New name", "changed"), "B": ("x--4", "X", "gone"), "C": ("old", "Gone", "gone"), "D": ("x--5", "X", "inserted"), "E": ("x--6", "x!", "inserted"), "F": ("x-2", "X 2", "inserted"), "G": ("fixed", "X", "inserted"), "H": ("h", "—", "inserted"), "I": ("zeme-o", "Žeme Õ", "inserted"),
    }
    assert {r.status for r in L.sync(held.where("false"), listed).collect()} == {"inserted"} and {r.status for r in L.sync(held, listed.where("false")).collect()} == {"gone"}


def test_other_pages_have_no_shares(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<tr><td>x</td></tr>"), (4, "<tr " * 100_000)], "page_id int, html string")
    assert L.parse_listing(pages).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    for name in ("reports/a.pdf", "reports/b.pdf", "reports/deep/c.pdf", "leads/d.csv", "x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    return tmp_path


def test_purge_needs_consent(spark, store):
    files = A.listing(spark, str(store))
    assert {(r.key, r.size) for r in files.collect()} == {(k, 5) for k in ("reports/a.pdf", "reports/b.pdf", "reports/deep/c.pdf", "leads/d.csv", "x.txt")}
    used = spark.createDataFrame([("reports/a.pdf",), (None,), ("reports/gone.pdf",)], "key string")
    dry = A.purge(files, [used], kept=("leads/",)).collect()
    assert {(r.key, r.deleted) for r in dry} == {("reports/b.pdf", False), ("reports/deep/c.pdf", False), ("x.txt", False)} and (store / "x.txt").exists()
    assert [r.key for r in A.dangling(files, [used]).collect()] == ["reports/gone.pdf"]
    done = A.purge(files, [used], kept=("leads/", "x"), consent=True).collect()
    assert {(r.key, r.deleted) for r in done} == {("reports/b.pdf", True), ("reports/deep/c.pdf", True)}
    assert {r.key for r in A.listing(spark, str(store)).collect()} == {"reports/a.pdf", "leads/d.csv", "x.txt"}
