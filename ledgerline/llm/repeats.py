"""Operator 9: removal of text that repeats, by a depth-limited radix sort.

Suffixes are told apart by digits from the left until 400 bytes agree, and
leave as soon as they are alone:

1.  Digit 1 is the anchor seed of a window (see windows.py), digit 2 the whole
    region whose windows share this anchor.  Regions alone with their seed are
    out; every window of a region that occurs twice is a repeat.
2.  The other regions are cut into blocks of 84 window starts.  All windows of a
    block share its core of 317 bytes, which is digit 3.
3.  In groups that still have several members the last digit is the window
    itself: equal groups are exactly the repeated windows.

Digits are compared by 64-bit hashes, each on top of those before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, byte_text, materialize
from ledgerline.llm.passages import repeated_words
from ledgerline.llm.windows import WINDOW, anchors, core_rows, window_hashes

BLOCK = 84
#: Up to so many regions are looked up by a broadcast; more by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000
#: A group's members are compared in one task up to this number, else window by window.
GROUP_ROWS = 2_000


def _keyed(docs: DataFrame) -> DataFrame:
    """key tells documents apart: a hash of id and text, equal only for repeated rows."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), byte_text().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [memoryview(x.as_buffer()) for x in batch["text"]]
        i, seed, region, at, first, last = anchors(texts)
        keys = batch["key"].to_numpy()[i]
        # first window, and from it the last one and the anchor
        place = first << 24 | (last - first) << 12 | (at - first)
        yield pa.record_batch({"seed": pa.array(seed), "region": pa.array(region), "key": pa.array(keys), "place": pa.array(place)})


_CORE = "seed long, block int, core long, key long, start long, top int, bytes binary"
_CORE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
_CORE_NAMES = ("seed", "block", "core", "key", "start", "top", "bytes")


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, regions in zip(batch["key"].to_pylist(), batch["text"], batch["regions"]):
            text = memoryview(text.as_buffer())
            rows = [(r["seed"], b, core, key, start, top, data) for r in regions.as_py() for b, core, start, top, data in core_rows(text, r["place"], BLOCK)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _CORE_TYPES)], names=_CORE_NAMES)


def _repeated_in(group: dict[str, list]) -> list[tuple[int, int, int]]:
    """(key, start, end) of what repeated windows cover, of blocks with equal cores."""
    member, at, digit = window_hashes(group["bytes"])
    offset = np.array(group["top"])[member] - at
    order = np.lexsort((digit, offset))
    same = (np.diff(digit[order]) == 0) & (np.diff(offset[order]) == 0)
    chosen = np.sort(order[np.append(False, same) | np.append(same, False)])  # by member, then place
    if not len(chosen):
        return []
    who, at = member[chosen], at[chosen]
    cut = np.append(0, np.flatnonzero((np.diff(who) != 0) | (np.diff(at) != 1)) + 1)
    end = np.append(cut[1:], len(at)) - 1
    return [(group["key"][who[a]], group["start"][who[a]] + int(at[a]), group["start"][who[a]] + int(at[b]) + WINDOW) for a, b in zip(cut, end)]


def _last_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by seed, block and core; groups may cross batches."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        rest, found = _by_group(rows, whole=False)
        if found:
            yield _span_batch(found)
    if rest is not None and (found := _by_group(rest, whole=True)[1]):
        yield _span_batch(found)


def _by_group(rows: pa.Table, whole: bool) -> tuple[pa.Table, list]:
    digits = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("seed", "block", "core")])
    start = np.append(0, np.flatnonzero((np.diff(digits) != 0).any(0)) + 1) if rows.num_rows else np.zeros(0, int)
    end = np.append(start[1:], rows.num_rows)
    keep = start[-1] if len(start) and not whole else rows.num_rows
    found = []
    for a, b in zip(start.tolist(), end.tolist()):
        if a < keep and b - a > 1:
            found += _repeated_in(rows.slice(a, b - a).select(["key", "start", "top", "bytes"]).to_pydict())
    return rows.slice(keep), found


def _span_batch(found: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=("key", "start", "end"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the blocks."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            member, start, digit = window_hashes(part["bytes"].to_pylist())
            take = lambda c: part[c].to_numpy().astype(np.int64)[member]
            yield pa.record_batch({"seed": take("seed"), "offset": take("top") - start, "digit": digit.view(np.int64), "key": take("key"), "start": take("start") + start})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, start, end) of bytes that repeated windows cover; spans may overlap or touch."""
    keyed = _keyed(docs)
    found = materialize(keyed.mapInArrow(_anchors, "seed long, region long, key long, place long"), "anchors")
    regions = found.groupBy("seed", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at"))
    seeds = regions.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    open_ = F.expr("kinds > 1 and least = 1")
    live = regions.join(seeds, "seed").where((F.col("n") > 1) | open_).select("seed", "region", "n", "at", F.when(open_, F.col("kinds")).otherwise(0).alias("kinds"))
    live = materialize(live, "regions")

    span = (F.shiftright("place", 24).alias("start"), (F.shiftright("place", 24) + F.shiftright("place", 12).bitwiseAND(0xFFF) + WINDOW).alias("end"))
    settled = found.join(live.where("n > 1").select("seed", "region"), ["seed", "region"]).select("key", *span)

    def blocks(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("at.key").agg(F.collect_list(F.struct("seed", "at.place")).alias("regions"))
        if which.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        return keyed.join(wanted, "key").select("key", "text", "regions").mapInArrow(_cores, _CORE)

    few = blocks(live.where(f"kinds between 1 and {GROUP_ROWS}"))
    digits = ("seed", "block", "core")
    spans = settled.union(few.repartition(*digits).sortWithinPartitions(*digits).mapInArrow(_last_digit, "key long, start long, end long"))
    crowded = live.where(f"kinds > {GROUP_ROWS}")
    if not crowded.isEmpty():
        # a seed in very many contexts: counts by window instead of groups in a task
        each = materialize(blocks(crowded).mapInArrow(_windows, "seed long, offset long, digit long, key long, start long"), "windows")
        window = ["seed", "offset", "digit"]
        twice = materialize(each.groupBy(*window).count().where("count > 1").drop("count"), "repeated-windows")
        spans = spans.union(each.join(twice, window).select("key", "start", (F.col("start") + WINDOW).alias("end")))
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, count, kept = [], [], [], []
        for text, spans in zip(batch["text"], batch["spans"]):
            data = text.as_buffer()
            out, at, n, gone = [], 0, 0, 0
            if spans.is_valid:
                pairs = np.stack([spans.values.field(c).to_numpy() for c in ("start", "end")])
                pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
                top = np.maximum.accumulate(pairs[1])
                first = np.append(True, pairs[0][1:] > top[:-1])
                for a, b in zip(pairs[0][first].tolist(), top[np.append(np.flatnonzero(first)[1:] - 1, len(top) - 1)].tolist()):
                    out.append(data[at:a].to_pybytes())
                    at, n, gone = b, n + 1, gone + b - a
            out.append(data[at:].to_pybytes())
            size.append(data.size)
            removed.append(gone)
            count.append(n)
            kept.append(b"".join(out))
        yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept": pa.array(kept, pa.binary()), "n_repeated_words": batch["n_repeated_words"]})


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary), n_repeated_words.

    Removed is every byte that a 400-byte string covers which also starts
    elsewhere, in the same document or another; strings are judged on the input
    and never cross documents.  So rows that repeat a text of 400 bytes or more
    lose all of it.  n_repeated_words marks what may be too short for that: the
    words in runs of over 50 that another document holds too (passages.py; rows
    equal in id and text are one document).  It takes nothing away.
    Null and empty texts have no bytes; a null doc_id is kept.
    Columns besides doc_id and text are not read.  No rows give no rows.
    """
    spans = repeated_spans(docs).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    keyed = _keyed(docs)
    known = spans.join(repeated_words(keyed), "key", "full")
    cut = keyed.join(known, "key", "left").select("doc_id", "text", "spans", F.coalesce("n_repeated_words", F.lit(0)).cast("long").alias("n_repeated_words"))
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated_words long")
