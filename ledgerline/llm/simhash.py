"""Operator 4: near-duplicates by SimHash, found through a covering code.

A fingerprint has 64 bits; two link if at most 3 differ.  Then at most one
differs in one of the two halves (3 bits over 2 halves).  The anchors of a half
are the codewords of the Hamming code of length 31 on its low bits (the top bit
is left to the final comparison): a perfect code, so every half lies within
covering radius 1 of exactly one anchor.  A fingerprint is replicated to every
anchor within covering radius plus threshold, 1 + 1 = 2: its own and 15 more.
Two halves that differ in one bit then meet at the own anchor of either, so no
link is lost, and all 64 bits are compared per anchor.

Only distinct fingerprints are compared, and only links that connect something
new leave a group, so copies are never expanded into pairs.  Of an anchor with
more than CROWDED fingerprints the task sends them on, to be dealt once more by
the other half: at most 3 bits differ there, so at most one in one of its
quarters, and who has one's quarter with up to one bit changed meets it there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, byte_text, materialize
from ledgerline.llm.components import connected_components, joined_within, spanning_links

SHINGLE = 3
BITS = 3
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each word shingle, block by block; A-Z count as a-z."""
    text, carry, at = text.lower(), [], 0
    short = True
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        words = carry + text[at:end].split()  # splits at the same six bytes
        at = end
        n = len(words) - size + 1
        if n > 0:
            short = False
            shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
            carry = words[n:]
        else:
            carry = words
    if short and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), 42)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; no word: 0."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        for part in np.array_split(hashes, len(hashes) // 8192 + 1):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0]) if total else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint(t.as_py()) for t in batch["text"]]
        yield pa.record_batch({"doc_id": batch["doc_id"], "key": batch["key"], "fp": pa.array(marks, pa.int64())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) of each row; key is a hash of doc_id and text."""
    keyed = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), byte_text().alias("text"))
    return keyed.withColumn("key", F.xxhash64("doc_id", "text")).mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def _syndromes() -> np.ndarray:
    """For each byte of a 31-bit word, what its bits add to the syndrome."""
    out = np.zeros((4, 256), np.uint8)
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * byte + bit < 31:
                    out[byte, value] ^= 8 * byte + bit + 1
    return out


def anchors_within_two(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, own?) for the Hamming codewords within distance 2 of 31-bit words."""
    words = halves.astype(np.int64) & 0x7FFFFFFF
    table = _syndromes()
    syndrome = np.zeros(len(words), np.int64)
    for byte in range(4):
        syndrome ^= table[byte, words >> 8 * byte & 255]
    flip = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    rows, anchors = [np.arange(len(words))], [words ^ flip]
    for i in range(1, 32):
        j = syndrome ^ i
        use = np.flatnonzero((j > i) & (syndrome > 0))
        rows.append(use)
        anchors.append(words[use] ^ (np.int64(1) << i - 1) ^ (np.int64(1) << (j[use] - 1)))
    own = np.zeros(sum(map(len, rows)), bool)
    own[: len(words)] = True
    return np.concatenate(rows), np.concatenate(anchors), own


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch["fp"].to_numpy(zero_copy_only=False)
        for half in (0, 1):
            rows, anchor, own = anchors_within_two(marks >> 32 * half & 0xFFFFFFFF)
            yield pa.record_batch({"cell": pa.array(anchor | half << 31), "fp": pa.array(marks[rows]), "own": pa.array(own)})


#: Cells up to this size are compared pair by pair, many cells at once.
SMALL = 16
#: Cells over this size are dealt to more tasks.
CROWDED = 20_000


def _links(cells: np.ndarray, marks: np.ndarray, own: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in whole cells; rows are sorted by cell."""
    start = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
    count = np.diff(np.append(start, len(cells)))
    size = np.repeat(count, count)
    for step in range(1, SMALL):
        i = np.flatnonzero((size[:-step] <= SMALL) & (cells[:-step] == cells[step:])) if step < len(cells) else []
        if len(i):
            i = i[(own[i] | own[i + step]) & (np.bitwise_count(marks[i] ^ marks[i + step]) <= bits)]
            yield marks[i], marks[i + step]
    for at, n in zip(start[count > SMALL], count[count > SMALL]):
        if own[at : at + n].any():
            part = marks[at : at + n]
            found = spanning_links(part, lambda x, others: np.bitwise_count(others ^ x) <= bits)
            if found:
                pairs = np.array(found, np.uint64)
                yield pairs[:, 0], pairs[:, 1]


def _compare(bits: int, most: int | None = None):
    """(a, b, left): links with left 0, joined within the task; of cells over ``most`` rows the (cell, fp, 1 + own) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later: list[pa.RecordBatch] = []
        for links in joined_within(lambda b: compare(b, later))(batches):
            yield pa.record_batch({"a": links["a"], "b": links["b"], "left": pa.array(np.zeros(links.num_rows, np.int32))})
            yield from later
            later.clear()

    def compare(batches: Iterator[pa.RecordBatch], later: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = [batch["cell"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["own"].to_numpy(zero_copy_only=False)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if len(rows[0]) and len(rows[0]) < 200_000:  # larger steps amortize the calls
                rest = rows
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            rest = [x[cut:] for x in rows]
            if cut:
                yield from send(later, *(x[:cut] for x in rows))
        if rest is not None and len(rest[0]):
            yield from send(later, *rest)

    def send(later: list[pa.RecordBatch], cells: np.ndarray, marks: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        if most is not None and len(cells) > most:
            start = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
            count = np.diff(np.append(start, len(cells)))
            over = np.repeat(count > most, count)
            if over.any():
                later.append(pa.record_batch({"a": pa.array(cells[over]), "b": pa.array(marks[over].view(np.int64)), "left": pa.array(1 + own[over].astype(np.int32))}))
                cells, marks, own = cells[~over], marks[~over], own[~over]
        for a, b in _links(cells, marks, own, bits) if len(cells) else ():
            yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def _quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals the fingerprints of crowded cells by the quarters of the half that the cell's anchor leaves open."""
    flips = np.append(np.int64(0), np.int64(1) << np.arange(16, dtype=np.int64))
    for batch in batches:
        cell, fp = batch["a"].to_numpy(), batch["b"].to_numpy()
        half = np.where(cell >> 31 & 1, fp, fp >> 32) & 0xFFFFFFFF
        for at in (0, 1):
            value = (half >> 16 * at & 0xFFFF)[:, None] ^ flips
            n = len(flips)
            yield pa.record_batch({"parent": pa.array(np.repeat(cell, n)), "part": pa.array((value | at << 16).ravel()), "fp": pa.array(np.repeat(fp, n)), "own": pa.array(np.tile(flips == 0, len(fp)))})


def fingerprint_components(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, root) for the distinct fingerprints that link to others."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover thresholds up to 3 bits")
    schema = "a long, b long, left int"
    cells = marks.select("fp").distinct().mapInArrow(_replicate, "cell long, fp long, own boolean")
    found = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(bits, CROWDED), schema), "fingerprint-links")
    links, crowded = found.where("left = 0").select("a", "b"), found.where("left > 0")
    if not crowded.isEmpty():
        dealt = crowded.select("a", "b").mapInArrow(_quarters, "parent long, part long, fp long, own boolean").select(F.xxhash64("parent", "part").alias("cell"), "fp", "own")
        links = links.union(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(bits), schema).select("a", "b"))
    return connected_components(links, joined=True).toDF("fp", "root")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, fp long, component_id.

    component_id is the smallest doc_id whose fingerprint can be reached over
    links of at most ``bits`` differing bits.  Null and wordless texts have
    fingerprint 0 and link like any other.  Rows that repeat a doc_id are rows
    of their own with the same result if their texts are equal.  A null doc_id
    gets its component's smallest id, null if the component has none.  An empty
    table gives an empty one; columns besides doc_id and text are not read.
    """
    marks, classes = _classes(docs, bits)
    return marks.join(classes, "fp").select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """fingerprints(docs), and for each fingerprint (fp, root, component_id)."""
    marks = materialize(fingerprints(docs), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = fingerprint_components(marks, bits)
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return marks, materialize(named.join(lowest, "root").select("fp", "root", "component_id"), "classes")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs without the near-duplicates: of each component one row stays.

    It is the one with the smallest doc_id, null after all others; of rows that
    share it the one with the smaller hash of its text, and of equal rows one.
    """
    marks, classes = _classes(docs, bits)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = marks.join(classes.select("fp", "root"), "fp").groupBy("root", place.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min("at").alias("first"))
    judged = materialize(rows.join(first, "root").select("at.key", (F.col("at") == F.col("first")).alias("stays"), "n"), "near-duplicates")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), byte_text()).alias("key"))
    kept = keyed.join(judged.where("not stays").select("key"), "key", "left_anti")
    twice = judged.where("stays and n > 1").select("key")
    if not twice.isEmpty():
        kept = kept.join(twice, "key", "left_anti").unionByName(kept.join(twice, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row", "key"))
    return kept.select("row.*")
