"""Batches of requests against a loop that answers one after another."""

from __future__ import annotations

import datetime
import json
import random

from pyspark.sql import functions as F

from ledgerline.operators import requests as Q

NOW = "2024-02-01"
AT = datetime.datetime(2024, 2, 1)
CANDIDATE = "id string, report_id string, job_id string, s3_key string, extracted_json_snapshot string, status string, quality_warnings string, created_at timestamp, approved_at timestamp"
REPORT = "id string, company_id string, fiscal_year int, report_type string, language string, job_id string, s3_key string, extracted_json_snapshot string"
JOB = "id string, state string, original_filename string, output_language string, extracted_text string, extracted_json string, error string, company_id string, created_at timestamp, updated_at timestamp"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def reports(spark, n):
    return spark.createDataFrame([(f"r{i}", f"c{i % 3}" if i % 4 else None, 2020 + i % 3, "annual", "en", f"j{i}", f"s{i}", f"{{{i}}}") for i in range(n)], REPORT)


def test_reviews(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        held = [(f"k{i}", f"r{rnd.randrange(6)}", f"jk{i}", f"sk{i}", f"{{k{i}}}", rnd.choice(["pending_review", "pending_review", "failed_quality", "approved", "rejected"]), "[]", AT, None) for i in range(20)]
        asked = [(s, rnd.choice(["k0", "k0", f"k{rnd.randrange(22)}", None]), rnd.choice(["promote", "promote", "reject", "wave", None])) for s in range(80)]
        r = reports(spark, 4)
        c = spark.createDataFrame(held, CANDIDATE)
        answers = Q.answer_reviews(c, r, spark.createDataFrame(rnd.sample(asked, 80), "seq long, candidate_id string, action string"))
        status, of, job, want = {k[0]: k[5] for k in held}, {k[0]: k[1] for k in held}, {f"r{i}": f"j{i}" for i in range(4)}, []
        for s, k, action in asked:
            if k not in status:
                a = "not_found"
            elif action not in ("promote", "reject"):
                a = "unknown_action"
            elif action == "promote":
                a = "not_pending" if status[k] != "pending_review" else "approved" if of[k] in job else "no_report"
                if a == "approved":
                    status[k], job[of[k]] = a, f"j{k}"
            else:
                a = "rejected" if status[k] in Q.OPEN else "not_rejectable"
                status[k] = "rejected" if a == "rejected" else status[k]
            want.append((s, a))
        assert rows(answers, "seq", "answer") == sorted(want, key=repr)
        after, filed = Q.apply_reviews(c, r, answers, F.to_timestamp(F.lit(NOW)))
        assert rows(after, "id", "status") == sorted(status.items(), key=repr)
        assert rows(filed, "id", "job_id") == sorted(job.items(), key=repr)
        assert {x.id for x in after.collect() if x.approved_at} == {k for (s, k, _), (_, a) in zip(asked, want) if a == "approved"}
        assert all(x.s3_key == "s" + x.job_id[1:] for x in filed.collect())
        assert filed.columns == r.columns and after.columns == c.columns


def test_equal_numbers(spark):
    c = spark.createDataFrame([(f"k{i}", "r0", f"jk{i}", "s", "{}", "pending_review", "[]", AT, None) for i in range(3)], CANDIDATE)
    asked = spark.createDataFrame([(1, "k0", "reject"), (1, "k0", "promote"), (1, "k0", "promote"), (1, "k1", "promote"), (1, "k2", "promote")], "seq long, candidate_id string, action string")
    answers = Q.answer_reviews(c, reports(spark, 1), asked)
    assert rows(answers, "candidate_id", "action", "answer") == [("k0", "promote", "approved"), ("k0", "promote", "approved"), ("k0", "reject", "not_rejectable"), ("k1", "promote", "approved"), ("k2", "promote", "approved")]
    after, filed = Q.apply_reviews(c, reports(spark, 1), answers, F.to_timestamp(F.lit(NOW)))
    assert after.count() == 3 and rows(filed, "job_id") == [("jk2",)]
    mapped = Q.map_reports(reports(spark, 1), spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([(1, "r0", "b"), (1, "r0", "a"), (1, "r0", "a")], "seq long, report_id string, company_id string"))[0]
    assert rows(mapped, "id", "company_id") == [("r0", "b")]


def test_review_queue(spark):
    c = spark.createDataFrame([("k1", "r1", "j", "s", "{}", "pending_review", "[]", AT, None), ("k2", "r9", "j", "s", "{}", "pending_review", "[]", AT, None), ("k3", "r0", "j", "s", "{}", "failed_quality", "[]", AT, None), ("k4", "r1", "j", "s", "{}", "approved", "[]", AT, AT)], CANDIDATE)
    companies = spark.createDataFrame([("c1", "Acme", "ACM")], "id string, name string, ticker string")
    assert rows(Q.review_queue(c, reports(spark, 4), companies), "id", "company", "fiscal_year") == [("k1", "Acme", 2021), ("k3", None, 2020)]
    assert rows(Q.review_queue(c, reports(spark, 4), companies, ["none of them"]), "id") == [("k1",), ("k3",), ("k4",)]
    assert rows(Q.review_queue(c, reports(spark, 4), companies, ["approved"]), "id") == [("k4",)]
    assert Q.review_queue(c.limit(0), reports(spark, 0), companies).count() == 0


def test_new_jobs(spark):
    jobs = spark.createDataFrame([("old", "complete", "a.pdf", "en", None, None, None, None, AT, AT)], JOB)
    asked = [(1, "a", "x.PDF", "image/png", "lv", ""), (2, "a", "y.csv", "", "en", "c1"), (3, "old", "z.htm", None, None, None), (4, None, "no", "image/png", "en", None), (5, "", "noend", "", "xx", "c2"), (6, None, "noend", "application/csv", None, None), (7, "b", "x.pdf.exe", "image/png", "en", None), (8, None, None, None, None, None)]
    after, answers = Q.create_jobs(jobs, spark.createDataFrame(asked, "seq long, id string, original_filename string, mime string, output_language string, company_id string"), F.to_timestamp(F.lit(NOW)))
    assert rows(answers, "seq", "answer") == [(1, "created"), (2, "taken"), (3, "taken"), (4, "not_accepted"), (5, "created"), (6, "created"), (7, "not_accepted"), (8, "created")]
    made = {r.original_filename: r for r in after.collect()}
    assert after.columns == jobs.columns and after.count() == 5
    assert (made["x.PDF"].id, made["x.PDF"].state, made["x.PDF"].output_language, made["x.PDF"].company_id) == ("a", "pending", "lv", None)
    ids = {r.id for r in after.collect()}
    assert len(ids) == 5 and ids == {r.id for r in Q.create_jobs(jobs, spark.createDataFrame(asked[::-1], "seq long, id string, original_filename string, mime string, output_language string, company_id string"), F.to_timestamp(F.lit(NOW)))[0].collect()}


def test_details_and_retries(spark):
    jobs = spark.createDataFrame(
        [("a", "failed", "f", "en", "t", "{}", "e", "c", AT, AT), ("b", "complete", "f", "en", "t", "{}", None, None, AT, AT), ("c", "extracting", "f", "en", "t", '{"_extractionProgress": 1}', None, None, AT, AT), ("d", "extracting", "f", "en", "t", None, None, None, AT, AT), ("e", "parsing", "f", "en", "t", '{"_extractionProgress": 1}', None, None, AT, AT)], JOB,
    )
    assert rows(Q.job_details(jobs), "id", "extracted_text") == [("a", "t"), ("b", "t"), ("c", "t"), ("d", None), ("e", None)]
    after, answers = Q.retry_jobs(jobs, spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "x"), (5, None)], "seq long, id string"), F.to_timestamp(F.lit(NOW)))
    assert rows(answers, "seq", "answer") == [(1, "retried"), (2, "not_failed"), (3, "not_failed"), (4, "not_found"), (5, "not_found")]
    assert rows(after, "id", "state", "error", "extracted_text", "company_id")[0] == ("a", "pending", None, None, "c")
    assert rows(after.where("id <> 'a'"), *jobs.columns) == rows(jobs.where("id <> 'a'"), *jobs.columns)


def filed_job(ident, state, period="FY2021", name="Acme", language="en", company="c1", error=None, warnings=None, raw=None):
    raw = json.dumps({"metadata": {"companyName": name, "reportPeriod": period}, **({} if warnings is None else {"qualityWarnings": warnings})}) if raw is None else raw
    return (ident, state, "f", language, None, None if raw == "none" else raw, error, company, AT, AT)


def test_replacements(spark):
    uuid = "0a1b2c3d-0000-1111-2222-333344445555"
    held = reports(spark, 5).union(spark.createDataFrame([("u", uuid, 2024, "q1", "lv", None, None, None), ("n2", None, 2020, "annual", "en", None, None, None)], REPORT))
    jobs = [
        filed_job("a", "complete", warnings=[]), filed_job("b", "failed"), filed_job("c", "complete", warnings=["x", 1]), filed_job("d", "parsing"), filed_job("e", "complete", raw="{bad"), filed_job("f", "complete", raw="none"), filed_job("g", "complete", raw=""), filed_job("h", "complete", name=""),
        filed_job("i", "complete", period="someday"), filed_job("j", "complete", language="xx"), filed_job("k", "duplicate", period="Q1", language="lv", company=None, error=f"Duplicate report: company={uuid}, year=2024"), filed_job("l", "complete", company="c9"), filed_job("m", "complete", period="2020 report", company=None),
    ]
    asked = spark.createDataFrame([(x,) for x in [*"abcdefghijklm", "zz", "a"]], "job_id string")
    found = Q.replacements(spark.createDataFrame(jobs, JOB), asked, held, 2024)
    got = {r.job_id: (r.answer, r.report_id, r.status) for r in found.collect()}
    queued = {"a": ("queued", "r1", "pending_review"), "b": ("queued", "r1", "failed_quality"), "c": ("queued", "r1", "failed_quality"), "k": ("queued", "u", "pending_review"), "m": ("queued", "n2", "pending_review")}
    refused = dict(d="not_replaceable", e="no_data", f="no_metadata", g="no_metadata", h="no_metadata", i="no_period", j="bad_language", l="no_report", zz="not_found")
    assert got == {**queued, **{k: (v, None, None) for k, v in refused.items()}}
    old = spark.createDataFrame([("mine", "r1", "a", "s", "{}", "rejected", "[]", AT, None)], CANDIDATE)
    after = Q.queue_replacements(old, found, F.to_timestamp(F.lit(NOW)))
    assert rows(after, "report_id", "job_id", "status", "quality_warnings") == [("n2", "m", "pending_review", "[]"), ("r1", "a", "pending_review", "[]"), ("r1", "b", "failed_quality", "[]"), ("r1", "c", "failed_quality", '["x"]'), ("u", "k", "pending_review", "[]")]
    assert [r.id for r in after.where("job_id = 'a'").collect()] == ["mine"]
    again = Q.queue_replacements(after, found, F.to_timestamp(F.lit(NOW)))
    assert rows(again, "id", "job_id", "status") == rows(after, "id", "job_id", "status")


def test_found_reports(spark):
    held = reports(spark, 5).union(spark.createDataFrame([("j2", "c8", 2021, "q1", "en", None, None, None), ("r1b", "c1", 2021, "annual", "en", "j1", None, None)], REPORT))
    twice = lambda i, raw, error, state="duplicate": (i, state, "f", "en", None, raw, error, None, AT, AT)
    said = "Duplicate report: company={}, year={}, type=annual, lang=en"
    jobs = [twice("p", '{"duplicateOfReportId": "r3"}', said.format("c1", 2021)), twice("q", '{"duplicateOfReportId": "gone"}', said.format("c1", 2021)), twice("s", "{bad", said.format("unmatched", 2020)), twice("t", None, None), twice("v", '{"duplicateOfReportId": "r3"}', None, "complete"), twice("w", None, said.format("c7", 2021))]
    asked = spark.createDataFrame([(k,) for k in ("r1", "j1", "j2", "p", "q", "s", "t", "v", "w", "none", None, "p")], "key string")
    want = {"r1": ("r1", "id"), "j1": ("r1", "job"), "j2": ("j2", "id"), "p": ("r3", "pointer"), "q": ("r1", "criteria"), "s": ("r0", "criteria")}
    every = {**want, **{k: (None, None) for k in ("t", "v", "w", "none", None)}}
    found = Q.find_reports(asked, held, spark.createDataFrame(jobs, JOB))
    assert {r.key: (r.report_id, r.by) for r in found.collect()} == every
    found = Q.find_reports(asked, held, spark.createDataFrame(jobs, JOB), by_id=False)
    assert {r.key: (r.report_id, r.by) for r in found.collect()} == {**every, "r1": (None, None), "j2": ("r2", "job")}


COMPANY = "id string, slug string, name string, ticker string, exchange string, country string, sector string"


def test_companies(spark):
    old = {"acme": ("id1", "Acme", "ACM", "TLN", "EE", "Energy")}
    rnd = random.Random(5)
    asked = [(s, rnd.choice(["acme", "bolt", "bolt", "cord", "", None]), rnd.choice(["A", "B", "", None, "C"]), rnd.choice(["T", "", None]), rnd.choice(["TLN", "RIG", ""]), rnd.choice(["LV", None]), None) for s in range(60)]
    companies = spark.createDataFrame([(i, s, *v) for s, (i, *v) in old.items()], COMPANY)
    want, now = [], {s: v[1:] for s, v in old.items()}
    for s, slug, name, ticker, exchange, country, sector in asked:
        if slug and name and exchange:
            want.append((s, "updated" if slug in now else "created"))
            now[slug] = (name, ticker or None, exchange, country, sector)
        else:
            want.append((s, "refused"))
    after, answers = Q.create_companies(companies, spark.createDataFrame(rnd.sample(asked, 60), "seq long, slug string, name string, ticker string, exchange string, country string, sector string"))
    assert rows(answers, "seq", "answer") == sorted(want, key=repr)
    assert rows(after, "slug", *Q.COMPANY_FIELDS) == sorted(((s, *v) for s, v in now.items()), key=repr)
    assert [r.id for r in after.where("slug = 'acme'").collect()] == ["id1"] and after.select("id").distinct().count() == len(now)


def test_mapped_reports(spark):
    rnd = random.Random(7)
    asked = [(s, rnd.choice([f"r{rnd.randrange(6)}", "r1", None]), rnd.choice(["a", "b", "zz", "", None])) for s in range(50)]
    held = reports(spark, 4)
    now, want = {r.id: r.company_id for r in held.collect()}, []
    for s, r, c in asked:
        a = "no_company" if not c else "not_found" if r not in now else "unknown_company" if c not in "ab" else "mapped"
        if a == "mapped":
            now[r] = c
        want.append((s, a))
    after, answers = Q.map_reports(held, spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame(asked, "seq long, report_id string, company_id string"))
    assert rows(answers, "seq", "answer") == sorted(want, key=repr)
    assert rows(after, "id", "company_id") == sorted(now.items(), key=repr)


def test_leads(spark):
    rnd = random.Random(11)
    posts = [(s, rnd.choice([" A@x.ee", "a@X.ee\n", "b@y.ee", "bad", "a b@x.ee", "@x.ee", "", None]), rnd.choice([" Co ", "", None]), rnd.choice(["x" * 130, "use"]), rnd.choice([None, " ", f"m{s}"]), rnd.choice([None, f" s{s} "])) for s in range(60)]
    leads = spark.createDataFrame([("a@x.ee", "Old", "u", "hello", None), ("z@x.ee", None, None, "kept", "s")], "email string, company string, use_case string, message string, source string")
    now, refused = {r[0]: tuple(r[1:]) for r in leads.collect()}, []
    for s, email, company, use, message, source in posts:
        email = (email or "").strip().lower()
        if email not in ("a@x.ee", "b@y.ee"):
            refused.append((s,))
            continue
        had = now.get(email, (None,) * 4)
        cut = lambda v, n: ((v or "").strip() or None) and v.strip()[:n]
        now[email] = (cut(company, 200), cut(use, 120), cut(message, 2000) or had[2], cut(source, 120) or had[3])
    after, bad = Q.capture_leads(leads, spark.createDataFrame(posts, "seq long, email string, company string, use_case string, message string, source string"))
    assert rows(after, *leads.columns) == sorted(((k, *v) for k, v in now.items()), key=repr)
    assert rows(bad, "seq") == sorted(refused, key=repr)


def test_truncate(spark):
    tables = {n: spark.range(3) for n in ("companies", "jobs", "reports", "report_rerun_candidates", "leads")}
    count = lambda ts: {n: df.count() for n, df in ts.items()}
    assert set(count(Q.truncate(tables, ["companies"])).values()) == {3}
    assert count(Q.truncate(tables, ["jobs"], confirm=True)) == {"companies": 3, "jobs": 0, "reports": 0, "report_rerun_candidates": 0, "leads": 3}
    assert count(Q.truncate(tables, ["companies"], confirm=True)) == {"companies": 0, "jobs": 0, "reports": 0, "report_rerun_candidates": 0, "leads": 3}
    try:
        Q.truncate(tables, ["nothing"])
    except ValueError as e:
        assert "nothing" in str(e)
    else:
        raise AssertionError


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    answers = Q.answer_reviews(none(CANDIDATE), none(REPORT), none("seq long, candidate_id string, action string"))
    assert [df.count() for df in (answers, *Q.apply_reviews(none(CANDIDATE), none(REPORT), answers, F.to_timestamp(F.lit(NOW))))] == [0, 0, 0]
    assert Q.replacements(none(JOB), none("job_id string"), none(REPORT), 2024).count() == 0
    assert Q.find_reports(none("key string"), none(REPORT), none(JOB)).count() == 0
    assert Q.create_companies(none(COMPANY), none("seq long, slug string, name string, ticker string, exchange string, country string, sector string"))[0].count() == 0
