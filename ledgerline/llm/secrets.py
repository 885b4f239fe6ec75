"""Operator 8: secrets by patterns and by sliding-window entropy.

Only DataFrame and SQL functions.  A pattern's matches come from
regexp_extract_all and the text between them from split with the same pattern;
their lengths give every match's place.  Candidate strings of an entropy class
are scanned window by window: counts per character change by the one that
enters and the one that leaves, and a table holds c*log2(c), so the entropy of
a window follows from the last one's by two look-ups.  Counts are kept twelve to
a number, so that a step rewrites a few numbers and not the whole alphabet.

Repeated groups of the patterns are possessive: Java then matches them by a loop
instead of a call for each round, which long texts let run out of stack.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, in the order they are listed in.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
#: Of assign, what the second group must have.  The other two match whole runs, so their patterns hold the least size.
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Matches placed together; the work per match grows with it and with matches over it.
BLOCK = 256
#: What a text must hold before its matches are looked for.
HINTS = {"assign": r"(?i:pass|secret|token|api)", "access": "AKIA", "hex": "[0-9a-f]{24}"}


@dataclass(frozen=True)
class EntropyClass:
    """Runs of ``alphabet`` with a window of ``window`` characters at ``bits`` or more."""

    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float


_HEX, _BASE = "0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASSES = (
    EntropyClass("entropy_hex", _HEX, r"(?<![0-9A-Za-z])[0-9a-fA-F]{20,}(?![0-9A-Za-z])", 20, 3.0),
    EntropyClass("entropy_base64", _BASE, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])", 24, 3.9),
)
#: Candidates that are no secrets: words, numbers, UUIDs, runs of the alphabet, marked examples, paths and dashed words.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefghij|0123456789abcdef",
    r"(?i)example|placeholder|changeme",
    r"^/?[a-z]+(?:[-_/+][a-z0-9]{1,12})*+/?$",
)
_SCALE = 1_000_000
#: Counts in a number, and the bits of each; a window must be shorter than 2**BITS.
PACKED, BITS = 12, 5
KINDS = (*PATTERNS, *(c.kind for c in CLASSES))
_SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, text, size of the group), in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    zipped = F.arrays_zip(between.alias("between"), matches.alias("match"), parts.alias("part"))

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["between"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("text"), F.length(x["part"]).alias("n"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, text: string, n: int>>").alias("out"))

    def placed(all_: Column) -> Column:
        """Blocks are placed from 0 each and then moved by the ends of those before."""
        number = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(all_) / BLOCK).cast("int") - 1))
        return F.transform(number, lambda b: F.aggregate(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)), start, place))

    def moved(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["at"])))
        pairs = F.arrays_zip(blocks.alias("block"), before.alias("before"))
        by_block = F.transform(F.slice(pairs, F.lit(1), F.size(blocks)), lambda p: F.transform(p["block"]["out"], lambda m: F.struct((m["start"] + p["before"]).alias("start"), (m["end"] + p["before"]).alias("end"), m["text"].alias("text"), m["n"].alias("n"))))
        return F.flatten(by_block)

    return F.when(F.size(matches) > 0, _let(_let(zipped, placed), moved)).otherwise(F.array().cast("array<struct<start: int, end: int, text: string, n: int>>"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))).cast(_SPAN)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one of PATTERNS; text must not be null."""
    found = _found(text, PATTERNS[kind], 2 if kind == "assign" else None)
    long_enough = F.filter(found, lambda m: m["n"] >= LEAST[kind])
    return F.when(text.rlike(HINTS[kind]), _spans(long_enough, kind)).otherwise(F.array().cast(_SPAN))


def _hot_part(run: Column, c: EntropyClass) -> Column:
    """(first, last) window start in run with enough entropy; (-1, -1) if none has."""
    table = F.array(*(F.lit(round(_SCALE * k * log2(k)) if k else 0).cast("long") for k in range(c.window + 2)))
    most = F.lit(round(_SCALE * c.window * (log2(c.window) - c.bits)))
    # of a character's number (1 and up): which packed number counts it, and where in that
    places = range(len(c.alphabet) + 1)
    word = F.array(*(F.lit(max(0, k - 1) // PACKED) for k in places))
    shift = F.array(*(F.lit(max(0, k - 1) % PACKED * BITS) for k in places))
    one = F.array(*(F.lit(1 << (k - 1) % PACKED * BITS if k else 0).cast("long") for k in places))
    codes = F.transform(F.split(run, ""), lambda x: F.instr(F.lit(c.alphabet), x))
    gone = F.concat(F.array_repeat(F.lit(0), c.window), codes)
    steps = F.slice(F.arrays_zip(codes.alias("enter"), gone.alias("leave")), F.lit(1), F.size(codes))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.get(word, code)), F.get(shift, code)).bitwiseAND((1 << BITS) - 1).cast("int")

    def step(s: Column, x: Column) -> Column:
        enter, leave = x["enter"], x["leave"]  # leave is 0 before the first window is full
        n = count(s["counts"], enter)
        m = count(s["counts"], leave) + F.when(enter == leave, 1).otherwise(0)
        total = s["total"] + F.get(table, n + 1) - F.get(table, n) - F.when(leave > 0, F.get(table, m) - F.get(table, m - 1)).otherwise(0)
        zero = F.lit(0).cast("long")
        counts = F.transform(s["counts"], lambda v, k: v + F.when(k == F.get(word, enter), F.get(one, enter)).otherwise(zero) - F.when(k == F.get(word, leave), F.get(one, leave)).otherwise(zero))
        hot = (total <= most) & (s["i"] >= c.window - 1)
        at = s["i"] - (c.window - 1)
        return F.struct(counts.alias("counts"), total.alias("total"), (s["i"] + 1).alias("i"), F.when(hot & (s["first"] < 0), at).otherwise(s["first"]).alias("first"), F.when(hot, at).otherwise(s["last"]).alias("last"))

    numbers = (len(c.alphabet) - 1) // PACKED + 1
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(steps, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, c: EntropyClass, allow: tuple[str, ...] = ALLOW) -> Column:
    """From the start of the first window of enough entropy to the end of the last, for each candidate."""
    found = F.filter(_found(text, c.pattern), lambda m: ~F.array_contains(F.array(*(m["text"].rlike(p) for p in allow)), True))
    scanned = F.transform(found, lambda m: F.struct(m["start"].alias("at"), _hot_part(m["text"], c).alias("w")))
    hot = F.filter(scanned, lambda m: m["w"]["first"] >= 0)
    spans = F.transform(hot, lambda m: F.struct((m["at"] + m["w"]["first"]).alias("start"), F.lit(KINDS.index(c.kind)).alias("rank"), (m["at"] + m["w"]["last"] + c.window).alias("end"), F.lit(c.kind).alias("kind")))
    return F.when(text.rlike(c.pattern), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column ``secrets``: array of (start, rank, end, kind) by start, then kind as listed in KINDS.

    Start and end count code points, end exclusive.  A null or empty text has
    none; repeated rows have the same; a column of docs called secrets is
    replaced.  Entropy adds to what the patterns find and removes none of it.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    parts = [base_spans(own, k) for k in PATTERNS] + [entropy_spans(own, c) for c in CLASSES]
    return docs.withColumn("secrets", F.array_sort(F.concat(*parts)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of ``text`` replaced by ``mark``; overlapping spans become one mark."""
    found = scan(docs.withColumn("text_", F.col("text")), "text_")

    def cut(s: Column, x: Column) -> Column:
        piece = F.substr(F.col("text_"), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        new = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece, F.when(new, F.lit(mark)).otherwise("")).alias("out"))

    done = F.aggregate("secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut)
    return found.withColumn("text", F.when(F.size("secrets") > 0, F.concat(done["out"], F.substr(F.col("text_"), done["at"] + 1))).otherwise(F.col("text"))).drop("text_", "secrets")
