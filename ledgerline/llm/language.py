"""Operator 2: language identification by Bayesian evidence fusion.

Four kinds of evidence multiply: the text under byte-trigram models, the
language that the markup (or table) declares, the suffix of the address, and a
prior for the host.  Priors are smoothed in a hierarchy, host to suffix to all,
from what the texts alone say, by grouped aggregation over every row.  The class
"und" stands for text in no known language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ledgerline.llm.common import bounded, materialize

UNDETERMINED = "und"
#: Rows the text models are fitted on, shared equally by the declared languages; the models, unlike all counts below, need no more.
SAMPLE_ROWS = 2000
#: Characters of a row the models are fitted on, as the sample goes to the driver.
SAMPLE_CHARS = 10_000
SLOTS = 1 << 16
#: A trigram shares two bytes with the next, so three count as about one.
TEMPER = 1 / 3
#: Log-likelihood of a trigram in no known language: one of so many equally likely ones.
OPEN_TRIGRAMS = 1 << 13
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
PRIOR_OPEN = 0.01
#: Pseudo-counts of a parent level.
SMOOTH = 20.0
#: A host with more than one row in so many gets its prior without a shuffle.
HOT_HOSTS = 64
#: Address suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl", "se": "sv"}
_UNIT = 1_000_000


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    #: SLOTS x languages, log-probabilities of hashed trigrams
    table: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood of each text by language, then of no language."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        for a, b in _slices(texts):
            slots, count = _slots(texts[a:b])
            row = np.repeat(np.arange(a, b), count)
            for k in range(len(self.languages)):
                out[a:b, k] = np.bincount(row - a, self.table[slots, k], b - a)
            out[a:b, -1] = -np.log(OPEN_TRIGRAMS) * count
        return TEMPER * out


#: ASCII letters in lower case; what else is ASCII separates words.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)]


def _slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def _slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams of each text and how many each has."""
    sizes = np.array([len(t) for t in texts])
    count = np.maximum(sizes - 2, 0)
    data = _LETTER[np.frombuffer(b"".join(texts), np.uint8)].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64), count
    key = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ok = np.ones(len(data), bool)
    ends = np.cumsum(sizes)
    for back in (1, 2):  # the last two bytes of a text begin no trigram
        ok[ends[sizes >= back] - back] = False
    return key[ok[:-2]].astype(np.int64), count


def fit(rows: list[tuple[bytes, str]]) -> TextModel:
    """Of labelled texts; labels are compared as lower-case language codes."""
    languages = tuple(sorted({label for _, label in rows}))
    table = np.full((SLOTS, max(1, len(languages))), np.log(1 / SLOTS))
    for k, language in enumerate(languages):
        counts = np.zeros(SLOTS)
        for a, b in _slices(own := [t for t, label in rows if label == language]):
            counts += np.bincount(_slots(own[a:b])[0], minlength=SLOTS)
        table[:, k] = np.log((counts + 0.05) / (counts.sum() + 0.05 * SLOTS))
    return TextModel(languages, table)


def code(declared: Column) -> Column:
    """en of "en-US", "EN_us" or "en"; null if nothing is declared."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def fit_on(evidence: DataFrame, rows: int = SAMPLE_ROWS) -> TextModel:
    """Fits every language that any row declares, on about ``rows`` rows in all.

    The languages are counted over all rows.  Each gives as many rows, one at
    least, the smallest by a hash of their other columns, and of a text its
    first SAMPLE_CHARS characters.  The hashes are bounded by the counts first,
    so that few rows are ranked and only the sample's texts leave the tasks.
    """
    hashed = evidence.where("declared is not null").withColumn("hash_", F.xxhash64(*(c for c in evidence.columns if c != "text")))
    counts = hashed.groupBy("declared").agg(F.count(F.lit(1)).alias("n"), F.min("hash_").alias("low")).collect()
    if not counts:
        return fit([])
    each = max(1, rows // len(counts))
    # twice the rows wanted and some, so that chance leaves enough
    bounds = [(r.declared, max(r.low, min((1 << 63) - 1, ((2 * each + 30) << 64) // r.n - (1 << 63)))) for r in counts]
    bounds = evidence.sparkSession.createDataFrame(bounds, "declared string, bound_ long")
    few = hashed.join(F.broadcast(bounds), "declared").where("hash_ <= bound_")
    text = F.lower(F.left(F.coalesce("text", F.lit("")), F.lit(SAMPLE_CHARS))).cast("binary").alias("text")
    ranked = few.select("declared", "hash_", text).withColumn("rank_", F.row_number().over(W.partitionBy("declared").orderBy("hash_", "text")))
    return fit([(bytes(r.text), r.declared) for r in ranked.where(F.col("rank_") <= each).select("text", "declared").collect()])


def _posterior(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            scores = model.scores([x.as_buffer().to_pybytes() for x in batch["bytes"]])
            flat = pa.array(np.round(scores, 6).ravel(), pa.float64())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * scores.shape[1])
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "bytes"), pa.ListArray.from_arrays(offsets, flat)], names=[*(n for n in batch.schema.names if n != "bytes"), "likelihood"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def identify(evidence: DataFrame, model: TextModel | None = None, floor: float = 0.5) -> DataFrame:
    """evidence (text, declared, host, suffix, and more) with language, confidence and rejected instead of text.

    declared is a code of code(), host and suffix are names; any of the four
    may be null, which is no evidence.  language has the highest posterior
    probability, the first by code on ties, and confidence is this probability.
    rejected: the language is "und", or confidence is below ``floor``, or the
    text has no letter (a null or empty one has none).  A row's result depends
    on the others through the priors only; repeated rows get equal results.  Of
    evidence called language, confidence or rejected the result's own stand.
    """
    model = model or fit_on(evidence)
    # the rows' own columns travel in one, so that their names clash with none here
    kept = F.struct(*(F.col(f"`{c}`") for c in evidence.columns if c not in ("text", "language", "confidence", "rejected"))).alias("row")
    names = [*model.languages, UNDETERMINED]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    ready = bounded(evidence).select(kept, "declared", "host", "suffix", letter, F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("bytes"))
    schema = StructType([f for f in ready.schema if f.name != "bytes"]).add("likelihood", ArrayType(DoubleType()))
    scored = materialize(ready.mapInArrow(_posterior(evidence.sparkSession.sparkContext.broadcast(model)), schema), "language-scores")

    # priors: counts of what texts alone say, in millionths so that sums are exact
    says = F.transform(_softmax(F.col("likelihood")), lambda p: F.round(p * _UNIT).cast("long"))
    sums = [F.sum(F.when(F.col("has_letter"), F.col("says")[k]).otherwise(0)).alias(f"n{k}") for k in range(len(names))]
    by_host = materialize(scored.withColumn("says", says).groupBy("host", "suffix").agg(F.count(F.lit(1)).alias("rows_"), *sums), "language-hosts")
    add = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]
    counted = lambda n: F.array(*(F.col(f"n{k}") / _UNIT for k in range(n)))
    every = by_host.agg(F.sum("rows_").alias("all_rows"), *add).select(counted(len(names)).alias("all_n"), "all_rows")
    by_suffix = by_host.groupBy("suffix").agg(*add).select("suffix", counted(len(names)).alias("suffix_n"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def smooth(counts: Column, parent: Column) -> Column:
        size = total(counts)
        return F.transform(F.arrays_zip(counts.alias("n"), parent.alias("p")), lambda x: (F.coalesce(x["n"], F.lit(0.0)) + SMOOTH * x["p"]) / (size + SMOOTH))

    flat = F.array(*(F.lit((1 - PRIOR_OPEN) / max(1, len(names) - 1) if n != UNDETERMINED else PRIOR_OPEN) for n in names))
    # every has one row
    prior = by_host.alias("h").join(by_suffix.alias("s"), F.col("h.suffix").eqNullSafe(F.col("s.suffix"))).join(F.broadcast(every)).select("h.host", "h.suffix", smooth(counted(len(names)), smooth(F.col("suffix_n"), smooth(F.col("all_n"), flat))).alias("prior"), (F.col("rows_") * HOT_HOSTS > F.col("all_rows")).alias("hot_"))
    prior = materialize(prior, "language-priors")

    def agrees(said: Column, right: float, k: int, name: str) -> Column:
        """Log-likelihood of a hint that names a language, given language k."""
        if name == UNDETERMINED:
            return F.when(said.isin(*model.languages), F.lit(float(np.log(1 / max(1, len(model.languages)))))).otherwise(0.0)
        wrong = (1 - right) / max(1, len(model.languages) - 1)
        return F.when(~said.isin(*model.languages) | said.isNull(), 0.0).when(said == name, float(np.log(right))).otherwise(float(np.log(max(wrong, 1e-9))))

    hint = F.coalesce(*(F.when(F.col("e.suffix") == s, F.lit(v)) for s, v in SUFFIXES.items()))
    logs = F.array(*(F.col("likelihood")[k] + F.log(F.col("prior")[k]) + agrees(F.col("declared"), DECLARED_RIGHT, k, n) + agrees(F.col("hint"), SUFFIX_RIGHT, k, n) for k, n in enumerate(names)))
    same = F.col("e.host").eqNullSafe(F.col("p.host")) & F.col("e.suffix").eqNullSafe(F.col("p.suffix"))
    # fewer than HOT_HOSTS hosts can have such a share of the rows; no other host's rows fill a task
    hot, rest = F.broadcast(prior.where("hot_")).alias("p"), prior.where("not hot_").alias("p")
    e = scored.alias("e")
    both = e.join(hot, same).select("e.*", "p.prior").unionByName(e.join(hot, same, "left_anti").alias("e").join(rest, same).select("e.*", "p.prior"))
    joined = both.alias("e").withColumn("hint", hint)
    fused = joined.withColumn("posterior", _softmax(logs))
    best = F.array_max(F.col("posterior"))
    fused = fused.withColumn("confidence", F.round(best, 6)).withColumn("language", F.element_at(F.array(*map(F.lit, names)), F.array_position(F.col("posterior"), best).cast("int")))
    rejected = ~F.col("has_letter") | (F.col("language") == UNDETERMINED) | (F.col("confidence") < floor)
    return fused.withColumn("rejected", rejected).select("row.*", "language", "confidence", "rejected")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare lang; their source stands for the host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"), code(F.col("lang")).alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare the language of their html tag; host and suffix come from the address.

    Null html is an empty page, a null or odd address has neither host nor
    suffix.  Scripts, styles and comments go, to the end if they don't end; so
    do tags and references.  A tag ends at the next < or >, so broken and very
    long pages take linear time.
    """
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</\1\s*>|$)|<!--.*?(-->|$)|<[^<>]*>|&#?\w+;", " ")
    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.regexp_extract(html, r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    suffix = F.nullif(F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([a-z]+)\.?$", 1), F.lit(""))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"), code(declared).alias("declared"), host.alias("host"), suffix.alias("suffix"))


def keep_known(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """docs without those whose language is rejected.

    Rows with the same doc_id and text share the decision.
    """
    evidence = document_evidence(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    found = identify(evidence, model)
    gone = found.where("rejected").select("key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    return keyed.join(gone, "key", "left_anti").select("row.*")
