"""Operator 7: token counts by offset-mapped attribution.

Each document is encoded once, as a whole.  The tokens' byte lengths give their
spans, and a sorted search joins the spans with those of the document's
sections (its lines).  The rule for tokens that cross a boundary: a token
belongs to the section it shares most bytes with, of equal shares to the first.
Counts of sections therefore add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, byte_text

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on are encoded apart; the pattern's engine fails on very long ones.
RUN = 1000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=2)
def _encoder(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=table, special_tokens={}), sizes


def encode(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """What encode_ordinary() gives, for runs of white space of any length.

    No piece goes on from other characters to white space, so a run begins a
    piece.  That piece is the run less its last character, which belongs to
    what follows; at the end of the text it is all of the run.
    """
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += encoder._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoder.encode_ordinary(text[at:])


def attribute(ends: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross its end) of each section.

    ends: where each token ends; starts: where each section begins, the first
    at 0; total: the text's bytes.
    """
    begins = np.append(0, ends[:-1])
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    owner = first.copy()
    cross = np.flatnonzero(first != last)
    edges = np.append(starts, total)
    for t in cross.tolist():
        s = np.arange(first[t], last[t] + 1)
        share = np.minimum(edges[s + 1], ends[t]) - np.maximum(edges[s], begins[t])
        owner[t] = s[np.argmax(share)]
    return np.bincount(owner, minlength=len(starts)), np.bincount(first[cross], minlength=len(starts))


def _count(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _encoder(ranks.value)
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for row, x in enumerate(batch["text"]):
                data = x.as_buffer().to_pybytes()
                raw = np.frombuffer(data, np.uint8)
                starts = np.append(0, np.flatnonzero(raw == 10) + 1)
                ids = np.array(encode(encoder, data.decode("utf-8", "replace")), np.int64)
                ends = np.cumsum(sizes[ids])
                n, cross = attribute(ends, starts, len(raw)) if len(ids) else (np.zeros(len(starts), int),) * 2
                chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
                edges = chars[np.append(starts, len(raw))]
                parts.append([np.full(len(starts), row), np.arange(len(starts)), edges[:-1], edges[1:], n, cross])
            if parts:
                row, *columns = (np.concatenate(c) for c in zip(*parts))
                yield pa.record_batch([batch["doc_id"].take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)], names=_NAMES)

    return run


_NAMES = ("doc_id", "section", "start", "end", "n_tokens", "n_crossing")


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section of each row of docs: doc_id, section, start, end, n_tokens, n_crossing.

    Sections are lines with their line break, from 0; start and end count code
    points.  n_crossing counts tokens that begin in the section and end in a
    later one.  A null or empty text has one empty section; so has what follows
    a last line break.  A null doc_id is kept, repeated rows are rows of their
    own, columns besides doc_id and text are not read.

    ``vocabulary`` is a file of the driver; tasks get its content, whose size
    the vocabulary bounds.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = ", ".join(f"{c} long" for c in _NAMES)
    return bounded(docs).select(F.col("doc_id").cast("long"), byte_text().alias("text")).mapInArrow(_count(ranks), schema)


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_sections) by document; rows that repeat a doc_id add up."""
    return section_tokens(docs, vocabulary).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_sections"))
