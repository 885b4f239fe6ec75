import math
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    evidence = language.document_evidence(docs)
    model = language.fit_on(evidence.where("doc_id % 2 = 0"), 300)
    held = evidence.where("doc_id % 2 = 1")
    truth = {r.doc_id: r.declared for r in held.collect()}
    # what is declared is held back: text and priors only
    found = language.identify(held.withColumn("declared", F.lit(None).cast("string")), model).collect()
    right = sum(r.language == truth[r.doc_id] for r in found)
    assert right / len(found) > 0.97
    found = language.identify(held, model).collect()
    assert sum(r.language == truth[r.doc_id] for r in found) / len(found) > 0.98
    assert sum(r.rejected for r in found) / len(found) < 0.02


@pytest.fixture(scope="module")
def model():
    # also what the odd rows hold
    en, de = "the quick brown fox jumps over the lazy dog near the river bank today. word word line one is long enough to count short one two the cat and the dog are on the hill with that other one", "der schnelle fuchs springt. der hund und die katze sind nicht auf dem berg mit einem anderen"
    return language.fit([(en.encode(), "en")] * 9 + [(de.encode(), "de")] * 9)


def test_evidence_is_fused(spark, model):
    rows = [
        (1, "the dog and the cat with that", None, "h", None),
        (2, "x", "de", None, None),
        (3, "x", None, None, "de"),
        (4, "der schnelle fuchs springt. der hund und die katze sind", "en", None, "com"),
        (5, None, "en", "h", None),
        (6, "12 34 !!", "en", "h", None),
        (7, "$#%^ qzx &&*( zzqx )(*& %%$# @@!! ~~}{ ||\\\\ x", None, None, None),
    ]
    rows += [(100 + i, "der schnelle fuchs springt. der hund und die katze", None, "g", None) for i in range(40)] + [(8, "xy", None, "g", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string"), model).collect()}
    assert [found[i].language for i in (1, 2, 3, 4, 8)] == ["en", "de", "de", "de", "de"]
    assert [found[i].rejected for i in (1, 2, 4, 5, 6, 7)] == [False, False, False, True, True, True]
    assert len(found) == len(rows)


def brute(rows, model, floor=0.5):
    """(language, confidence, rejected) of (text, declared, host, suffix), one by one in plain floats."""
    names = [*model.languages, "und"]

    def softmax(logs):
        parts = [math.exp(x - max(logs)) for x in logs]
        return [x / math.fsum(parts) for x in parts]

    def likelihood(text):
        data = [b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in (text or "").lower().encode()]
        slots = [((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for a, b, c in zip(data, data[1:], data[2:])]
        return [round(sum(float(model.table[s, k]) for s in slots) / 3, 6) for k in range(len(names) - 1)] + [round(-math.log(1 << 13) * len(slots) / 3, 6)]

    letter = lambda t: any(c.isalpha() for c in t or "")
    scores = [likelihood(t) for t, *_ in rows]
    counts = {}
    for (text, _, host, suffix), s in zip(rows, scores):
        if letter(text):
            for place in ((host, suffix), (suffix,), ()):
                old = counts.setdefault(place, [0.0] * len(names))
                counts[place] = [a + b for a, b in zip(old, softmax(s))]
    smooth = lambda n, parent: [(a + 20 * p) / (sum(n) + 20) for a, p in zip(n, parent)]
    flat = [0.99 / (len(names) - 1)] * (len(names) - 1) + [0.01]
    zero = [0.0] * len(names)
    out = []
    for (text, declared, host, suffix), s in zip(rows, scores):
        prior = smooth(counts.get((host, suffix), zero), smooth(counts.get((suffix,), zero), smooth(counts.get((), zero), flat)))
        logs = [a + math.log(p) for a, p in zip(s, prior)]
        for said, right in ((declared, 0.9), (language.SUFFIXES.get(suffix), 0.7)):
            if said in model.languages:
                wrong = (1 - right) / (len(model.languages) - 1)
                logs = [x + math.log(1 / len(model.languages) if n == "und" else right if n == said else wrong) for x, n in zip(logs, names)]
        p = softmax(logs)
        best = names[p.index(max(p))]
        out.append((best, max(p), not letter(text) or best == "und" or max(p) < floor))
    return out


def test_against_plain(spark, model, monkeypatch):
    r = random.Random(11)
    ws = "the dog and cat der hund die katze auf berg on hill that mit einem near river qzx é 12 !!".split()
    three = language.fit([(b"the dog and the cat on that hill near the river", "en"), ("der hund und die katze auf dem berg mit einem".encode(), "de"), ("le chien et le chat près de la rivière".encode(), "fr")])
    # with all hosts busy, some, and none
    for fitted, hot in ((model, 64), (three, 22), (model, 1)):
        monkeypatch.setattr(language, "HOT_HOSTS", hot)
        rows = [(None if r.random() < 0.05 else " ".join(r.choices(ws, k=r.randint(0, 9))), r.choice([None, "en", "de", "fr", "xx"]), r.choice([None, "", "a", "b", "c"]), r.choice([None, "de", "com", "fr", "uk"])) for _ in range(300)]
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "likelihood long, text string, declared string, host string, suffix string").repartition(4)
        found = {x.likelihood: x for x in language.identify(df, fitted).collect()}
        for i, (best, p, rejected) in enumerate(brute(rows, fitted)):
            assert found[i].confidence == pytest.approx(p, abs=2e-5), rows[i]
            assert found[i].language == best and (found[i].rejected == rejected or abs(p - 0.5) < 2e-5), rows[i]


def test_clashing_columns(spark, model):
    for name in ("likelihood", "bytes", "has_letter", "says", "prior", "hint", "posterior", "row", "key", "language", "a.b"):
        df = spark.createDataFrame([(1, "the dog and the cat", "en", "h", 5)], "doc_id long, text string, lang string, source string, k long").withColumnRenamed("k", name)
        left = language.keep_known(df, model)
        assert left.columns == df.columns and left.first()[name] == 5
        evidence = df.selectExpr("text", "lang as declared", "source as host", "cast(null as string) as suffix", f"`{name}`")
        assert language.identify(evidence, model).first().language == "en"


def test_rare_languages_are_known_at_every_size(spark):
    texts = {"en": "the dog and the cat are on the hill with that other one", "de": "der hund und die katze sind nicht auf dem berg", "sv": "hunden och katten ligger inte uppe vid den gamla sjön"}
    rows = [(i, f"{texts[x]} {i}", x, "h", 0) for i, x in enumerate(["sv"] * 2 + ["en", "de"] * 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    evidence = language.document_evidence(docs)
    assert language.fit_on(evidence).languages == language.fit_on(evidence, 12).languages == ("de", "en", "sv")
    found = {r.doc_id: r for r in language.identify(evidence, language.fit_on(evidence, 12)).collect()}
    assert all(found[i].language == x and not found[i].rejected for i, _, x, _, _ in rows)
    assert language.keep_known(docs).where("doc_id < 2").count() == 2


def test_the_sample_is_bounded(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "fit", lambda rows: taken.extend(rows))
    monkeypatch.setattr(language, "SAMPLE_CHARS", 50)
    same = [(None, "word " * 100, "en", "h", 0)] * 500
    language.fit_on(language.document_evidence(spark.createDataFrame([*same, (1, "x", "fr", "h", 0)], "doc_id long, text string, lang string, source string, n_chars long")), 20)
    assert sorted((x, len(t)) for t, x in taken) == [("en", 50)] * 10 + [("fr", 1)]


def test_codes_and_addresses(spark):
    pages = spark.createDataFrame([(1, "https://u@www.Site.DE:80/x?y", '<html class="a" lang="de-AT"><script>var english = 1</script><p>Der Hund</p>'), (2, None, None), (3, "nowhere", "<p>x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.page_evidence(pages).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix) == ("de", "www.site.de", "de") and "english" not in got[1].text
    assert (got[2].declared, got[2].host, got[2].suffix) == (None, None, None) and got[3].host is None
    codes = spark.createDataFrame([("en-US",), ("FR_fr",), (" es ",), ("english",), ("",), (None,)], "c string")
    assert [r[0] for r in codes.select(language.code(F.col("c"))).collect()] == ["en", "fr", "es", None, None, None]


@pytest.mark.parametrize("part", ["<", "<html ", "<script ", "<!--", "&", "<html lang", "<style>x</style", "<a href='>"])
def test_broken_pages_take_linear_time(spark, part):
    pages = spark.createDataFrame([(1, "http://a.de", part * (1_000_000 // len(part)) + "<p>Der Hund</p>")], "page_id long, url string, html string").repartition(2)
    began = time.perf_counter()
    found = language.page_evidence(pages).collect()
    assert len(found) == 1 and time.perf_counter() - began < 15


def test_null_and_long_pages(spark, model):
    rows = [(1, None, None), (2, "http://a.de/", ""), (2, "http://a.de/", ""), (None, "x", "<html lang=de>" + "<p>der hund und die katze " * 40_000), (3, "http://a.de", "a < b und <p title='x>y'>der hund</p>")]
    got = language.identify(language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")), model).collect()
    assert sorted((r.page_id or 0, r.language, r.rejected) for r in got if r.page_id is None or r.page_id == 3) == [(0, "de", False), (3, "de", False)]
    assert len(got) == 5 and all(r.rejected for r in got if r.page_id in (1, 2))


def test_odd_rows(odd, none, model):
    left = language.keep_known(odd, model)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} >= {1, 2, 7, 10} and not {r.doc_id for r in left.collect()} & {3, 4, 5}
    assert language.keep_known(none).count() == 0
