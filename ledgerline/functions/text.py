"""Text functions: Column in, Column out."""

from __future__ import annotations

import re as _re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space with what Java's \s lacks: no-break and other Unicode spaces.
SPACE = r"[\s   -     　﻿]"
EDGES = " \t\n\r\x0b\x0c\u00a0\ufeff"
# Letters with marks and their base letters (Latvian, Lithuanian, Estonian).
MARKED = "ĀāČčĒēĢģĪīĶķĻļŅņŠšŪūŽžĄąĘęĖėĮįŲųÕõÄäÖöÜü"
PLAIN = "AaCcEeGgIiKkLlNnSsUuZzAaEeEeIiUuOoAaOoUu"


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(text, F.lit(EDGES))


def strip_marks(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def normalize_label(label: Column) -> Column:
    """Squeezed, marks stripped, case kept."""
    return strip_marks(squeeze(label))


def _precomposed() -> tuple[str, str]:
    """Latin letters with marks and what is left of them without."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _precomposed()


def fold(text: Column) -> Column:
    """Lower case without combining marks, also those of precomposed Latin letters."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"[̀-ͯ]", "")


def compact_label(label: Column) -> Column:
    """Folded; all but letters, digits and % is a space."""
    return F.trim(F.regexp_replace(fold(label), r"[^\p{L}\p{N}%]+", " "))


def chart_label(label: Column) -> Column:
    """Folded; all but ASCII letters and digits is a space."""
    return F.trim(F.regexp_replace(fold(label), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Lower-case words; an empty text has one empty word."""
    return F.array_distinct(F.split(F.lower(text), SPACE + "+"))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of token arrays; two empty ones are not alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# Narrative sections and other names for them.
SECTIONS = ("executive_summary", "management_commentary", "business_overview", "segment_performance", "strategic_priorities", "outlook", "other")
SECTION_ALIASES = {
    "business_overview": ("business", "business_description", "business_model", "company_overview", "company_profile"),
    "executive_summary": ("financial_highlights", "financial_overview", "financial_performance", "financial_results", "financial_summary", "highlights", "investment_highlights", "key_highlights"),
    "management_commentary": ("management", "management_board_report", "management_comment", "management_report", "management_review"),
    "outlook": ("outlook_and_guidance",),
    "other": ("risks", "risk_factors", "riskfactors"),
    "segment_performance": ("segment", "segment_analysis", "segment_results", "segments"),
    "strategic_priorities": ("strategy", "strategic_focus", "strategic_goals", "strategic_review"),
}


def section_name(section: Column) -> Column:
    """snake_case of a section's heading."""
    s = F.regexp_replace(F.trim(section), "([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "_"), "[^a-zA-Z0-9_]", "")
    return F.lower(F.regexp_replace(s, "_+", "_"))


def canonical_section(section: Column) -> Column:
    name = section_name(section)
    known = F.when(name.isin(*SECTIONS), name)
    for target, names in SECTION_ALIASES.items():
        known = known.when(name.isin(*names), F.lit(target))
    return known.otherwise("other")


def slug(text: Column, keep_marks: bool = True) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; one hyphen at either edge goes."""
    base = F.lower(text) if keep_marks else fold(text)
    return F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_filename(name: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._ -]+", "_"), r"\s+", " "), 1, most)


def snippet(text: Column, most: int = 240) -> Column:
    """Squeezed and cut to ``most`` characters, the last three of them dots; null if nothing is left."""
    s = squeeze(text)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).when(s != "", s)


def first_distinct(items: Column, most: int) -> Column:
    """The first ``most`` items of an array that differ by more than case and white space, squeezed."""
    clean = F.filter(F.transform(items, squeeze), lambda x: x != "")
    new = F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)
    return F.slice(new, 1, most)


def chunk_starts(length: Column, size: int, overlap: int) -> Column:
    """Where windows of ``size`` characters begin; the last one ends with the text."""
    step = size - min(overlap, size // 5)
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunks(text: Column, size: int = 80_000, overlap: int = 3_000) -> Column:
    return F.transform(chunk_starts(F.length(text), size, overlap), lambda at: F.substr(text, at + 1, F.lit(size)))


# Signs that a text compares periods or segments.
TREND_SIGNS = (
    r"\b(q[1-4]|fy|h[1-2])\s*(20\d{2}|'?\d{2})\b",
    r"\b(20\d{2})\s+(20\d{2})\b",
    r"by\s+(segment|geography|division|region)",
    r"\b(revenue|ebitda|net\s+(profit|income))\s+(by|per)\s+(segment|geography)",
    r"\b(segment|geographic)\s+(breakdown|revenue|information)",
    r"\bcompar(ative|ison)\s+(period|year|table)",
    r"\b(prior|previous)\s+year\b",
    r"\byear[\s-]on[\s-]year\b",
    r"\bmulti[\s-]year\b",
    r"\b(periods?|years?)\s+20\d{2}\b",
)
TABLE_MARK = "[structured financial table"


def needs_trends(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit(TABLE_MARK)) | low.rlike("|".join(f"(?:{p})" for p in TREND_SIGNS))


def needs_narratives(text: Column) -> Column:
    return F.length(text) > 5000


# Phrases of documents that are no financial reports, with case.
CLASS_PHRASES = {
    "auditor_report": ("Independent Auditor's Report", "We have audited the", "we have audited the", "in our opinion", "In our opinion", "audit opinion", "financial statements present fairly", "consolidated financial statements give a true and fair view", "we conducted our audit in accordance", "International Standards on Auditing"),
    "prospectus": ("Prospectus", "Offering Circular", "offering memorandum", "offering of securities", "offering of shares", "subscription period", "final terms", "base prospectus"),
    "legal_filing": ("Securities and Exchange Commission", "regulatory filing", "hereby notifies", "hereby announces that", "pursuant to", "stock exchange release", "regulated information", "inside information", "this is a translation", "official translation"),
    "press_release": ("Press Release", "FOR IMMEDIATE RELEASE", "press release", "media release"),
}
#: Phrases of a class that a document must hold.
CLASS_LEAST = {"auditor_report": 1, "prospectus": 1, "legal_filing": 2, "press_release": 2}
FINANCE_TERMS = "(?i)(revenue|EBITDA|net profit|operating profit|balance sheet|income statement|cash flow|earnings per share|dividend|financial statements?|annual report|quarterly report|interim report|consolidated financial|management report|group turnover|turnover)"
CLASS_CHARS = 2000


def distinct_long_words(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))))


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def document_class(text: Column) -> Column:
    head = F.substring(text, 1, CLASS_CHARS)
    out = F.when(distinct_long_words(head) < 10, F.lit("low_quality_text"))
    for name, phrases in CLASS_PHRASES.items():
        hit = phrase_hits(head, phrases) >= CLASS_LEAST[name]
        out = out.when(hit & ~head.rlike(FINANCE_TERMS) if name == "press_release" else hit, F.lit(name))
    return out.otherwise("financial_report")


# Lines that carry no figures.
BOILERPLATE = (
    r"^\s*(Table of )?Contents?\s*$",
    r"^\s*\d+[\.\)]?\s.+[\.\s]{3}\d+\s*$",  # with nothing that can match a stretch in two ways, so in linear time
    r"^\s*Independent Auditor'?s?\s*Report\s*$",
    r"^\s*We have audited the",
    r"^\s*in our opinion[,.]?\s*$",
    r"^\s*Basis for (audit )?opinion\s*$",
    r"^\s*Key Audit Matters\s*$",
    r"^\s*Responsibilities of (the )?(Board|Management|Auditor)",
    r"^\s*Going concern\s*$",
    r"^\s*Material(ity)? (and|&) (uncertainty|risk)",
    r"^\s*(Summary of )?(Significant )?Accounting Policies?\s*$",
    r"^\s*(Principles? of )?(Consolidation|Basis of (Preparation|Accounting))\s*$",
    r"^\s*(Property|Plant|Equipment|Intangible|Goodwill|Inventory|Revenue|Leases?|Tax|Pension|Share.based|Financial\s+(instruments|assets|liabilities)|Employee\s+benefits|Provisions?|Contingent|Foreign\s+currency|Segment|Cash\s+flow|Earnings\s+per)\s+(and|&)\s+(Equipment|Recognition|Measurement|Policy|presentation)",
    r"^\s*The (financial|consolidated|Group) statements (have been|are) prepared",
    r"^\s*IFRS\s+\d+",
    r"^\s*IAS\s+\d+",
    r"^\s*(Critical|Significant)\s+(accounting\s+)?(judgements?|judgments?|estimates?)\s*$",
    r"^\s*(Note|Notes?)\s+(\d+[\.\)]?\s+)?(to the|accompanying|financial|consolidated)",
    r"^\s*Page\s+\d+\s+of\s+\d+\s*$",
    r"^\s*\d+\s*$",
    r"^\s*Registered (office|address|number)",
    r"^\s*Commercial (Register|Registry)",
    r"^\s*This (document|report|is a|translation)",
    r"^\s*In the event of (any )?discrepan",
    r"^\s*The (English|Estonian|Latvian|Lithuanian) (version|language|text)",
)
BOILERPLATE_PATTERN = "(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE)


def is_boilerplate(line: Column) -> Column:
    """Of a line without white space at its ends; an empty one is none."""
    return (line != "") & line.rlike(BOILERPLATE_PATTERN)


def usable_text(text: Column) -> Column:
    """20 characters or more, 45 % of them letters, and three words."""
    s = squeeze(text)
    letters = F.regexp_count(s, F.lit("[A-Za-zÀ-ž]"))
    return (F.length(s) >= 20) & (letters >= 0.45 * F.length(s)) & (F.regexp_count(s, F.lit("[A-Za-zÀ-ž]{3,}")) >= 3)


_NUMERIC = _re.compile(r"&#(\d+);|&#[xX]([0-9a-fA-F]+);")


def _numeric(texts: pa.Array) -> pa.Array:
    def char(m):
        return chr((int(m[1]) if m[1] else int(m[2], 16)) & 0xFFFF)

    return pa.array([None if t is None else _NUMERIC.sub(char, t) for t in texts.to_pylist()], pa.string())


_numeric.__annotations__ = {"texts": pa.Array, "return": pa.Array}
_numeric_udf = F.arrow_udf(_numeric, T.StringType())
#: In the order they are decoded; &amp; comes first, so &amp;lt; decodes twice.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"))


def decode_entities(text: Column) -> Column:
    """Six named references in order, then numeric ones.

    Only texts that hold a numeric reference reach the Arrow function's loop.
    """
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    named = F.regexp_replace(text, "(?i)&nbsp;", " ")
    return F.when(F.contains(named, F.lit("&#")), _numeric_udf(named)).otherwise(named)


def osa(a: str, b: str) -> int:
    """Edits and swaps of neighbours, each letter in one of them at most."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _osa(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else osa(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


_osa.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
#: No built-in function counts swaps of neighbours; names are short.
osa_distance = F.arrow_udf(_osa, T.IntegerType())
