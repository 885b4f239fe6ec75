"""The operators applied to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import audio, benchmarks, html, language, lines, manifest, mixing, repeats, search, secrets, shards, simhash, tokens
from ledgerline.llm.common import byte_text, table


def _sha(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: doc_id or page_id, language, confidence, rejected."""
    both = language.document_evidence(table(spark, sf_dir, "documents")).unionByName(language.page_evidence(table(spark, sf_dir, "pages")))
    return language.identify(both)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lines_of(table(spark, sf_dir, "documents"))


def op5_lines_of(docs: DataFrame) -> DataFrame:
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    cut = lines.cut_lines(docs.select("doc_id", "text").withColumn("n_lines", n_lines))
    return cut.select("doc_id", "n_lines", F.col("removed_").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), _sha("text").alias("text_sha256"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_audio_of(table(spark, sf_dir, "documents"))


def op6_audio_of(docs: DataFrame) -> DataFrame:
    read = audio.stored_features(docs)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "rate", "pcm"
    )


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets_of(table(spark, sf_dir, "documents"))


def op8_secrets_of(docs: DataFrame) -> DataFrame:
    found = secrets.scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.PATTERNS))
    return found.select("doc_id", *(count(k) for k in secrets.PATTERNS), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_repeats_of(table(spark, sf_dir, "documents"))


def op9_repeats_of(docs: DataFrame) -> DataFrame:
    """text is what is left, n_chars its code points; a character cut in two shows as U+FFFD."""
    left = repeats.without_repeats(docs).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.length("text").cast("long").alias("n_chars"), "text", "n_repeated_words")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_manifest_of(table(spark, sf_dir, "documents"))


def op12_manifest_of(docs: DataFrame) -> DataFrame:
    found = manifest.verified(docs, manifest.lowered_fifth())
    proof = F.sha2(manifest.siblings(F.col("proof")).cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_shards_of(table(spark, sf_dir, "documents"))


def op13_shards_of(docs: DataFrame) -> DataFrame:
    lean = docs.select("doc_id", (F.octet_length(byte_text()) + 8).cast("long").alias("size"), F.crc32(byte_text()).alias("text_crc32"))
    return shards.place(lean).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_mixing, op2_language, op3_decontamination, op4_simhash, op5_lines, op6_audio, op7_tokens, op8_secrets, op9_repeats, op10_html, op11_search, op12_manifest, op13_shards)
    return {f.__name__: f for f in named}


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"""regexp_extract_all(translate(text, {_UPPER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_SEARCH = f"""
WITH asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark), words AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT doc_id, len(terms) AS n FROM words WHERE len(terms) > 0), corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, big_n),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // l))))::BIGINT AS score FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
_LEAF = lambda text: f"sha256(concat({', '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
#: Runs of sixteen, by window; five levels reach a million nodes of a source or a million sources.
_LEVELS = 5


def _level(nodes: str, out: str) -> str:
    """One level: each node's place in its run and the run, null where the node is a root; then the parents, or the roots as they are."""
    return f"""{out} AS (SELECT of, idx, members, digest, (idx % 16)::INT AS pos, CASE WHEN members > 1 THEN list(digest) OVER (PARTITION BY of, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS run FROM {nodes}),
{out}_up AS (SELECT of, idx // 16 AS idx, (members + 15) // 16 AS members, CASE WHEN members > 1 THEN sha256(array_to_string(run, '')) ELSE digest END AS digest FROM {out} WHERE pos = 0)"""


def _along(step: str, start: str) -> str:
    for level in "ab":
        for i in range(_LEVELS):
            start = step.format(value=start, run=f"{level}run{i}", pos=f"{level}pos{i}")
    return start


_FOLD = "CASE WHEN {run} IS NULL THEN {value} ELSE sha256(concat(array_to_string({run}[1:{pos}], ''), {value}, array_to_string({run}[{pos} + 2:], ''))) END"
_REST = "concat({value}, array_to_string({run}[1:{pos}], ''), array_to_string({run}[{pos} + 2:], ''))"
_COLUMNS = ", ".join(f"{level}{i}.run AS {level}run{i}, {level}{i}.pos AS {level}pos{i}" for level in "ab" for i in range(_LEVELS))
_JOINS = " ".join(f"JOIN a{i} ON a{i}.of = n0.of AND a{i}.idx = n0.idx // {16**i}" for i in range(_LEVELS)) + " JOIN subroots s ON s.source_of = n0.of " + " ".join(f"JOIN b{i} ON b{i}.idx = s.idx // {16**i}" for i in range(_LEVELS))
_MANIFEST = f"""
WITH each AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS of, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF(f"translate(text, {_UPPER})")} ELSE {_LEAF("text")} END AS tampered FROM documents),
n0 AS (SELECT of, leaf AS digest, doc_id, leaf, tampered, row_number() OVER (PARTITION BY of ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY of) AS members FROM each),
{", ".join(_level(f"a{i - 1}_up" if i else "n0", f"a{i}") for i in range(_LEVELS))},
subroots AS (SELECT of AS source_of, digest, '' AS of, row_number() OVER (ORDER BY encode(of)) - 1 AS idx, count(*) OVER () AS members FROM a{_LEVELS - 1}_up),
{", ".join(_level(f"b{i - 1}_up" if i else "subroots", f"b{i}") for i in range(_LEVELS))},
paths AS (SELECT doc_id, leaf, tampered, s.digest AS subroot, r.digest AS root, {_COLUMNS} FROM n0 {_JOINS}, b{_LEVELS - 1}_up r)
SELECT doc_id, leaf, subroot, root, sha256({_along(_REST, "''")}) AS proof_sha256, {_along(_FOLD, "tampered")} AS folded_root, folded_root = root AS verified FROM paths"""


def oracle_sql() -> dict[str, str]:
    """SQL can express few of these on whole tables in fair time; tests/llm holds each against brute force."""
    return {"op11_search": _SEARCH, "op12_manifest": _MANIFEST}
