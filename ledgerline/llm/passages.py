"""Passages of over 50 words that stand in several documents (operator 9, ``n_repeated_words``).

The same digits as in repeats.py, on words: a window is a run of 51 words, its
first digit the anchor seed, the second the region of consecutive windows with
this anchor.  Regions that two documents hold are settled; the windows of the
others, and of two holders of each settled one beside them, are compared by
their own hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, remove
from ledgerline.llm.windows import _BASE, _LOW, _MIX, _powers, _sliding_min

WORDS = 51
SEED = 8
#: Words handled at once; regions of longer documents end at a cut.
SLICE = 1 << 17
#: Bytes split into words at once.
PIECE = 1 << 20
#: Up to so many regions are looked up by a broadcast; more by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ h >> np.uint64(29)


def _words(text: memoryview) -> np.ndarray:
    """A hash of each word."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        words = bytes(text[at:end]).split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts)


def _runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums whose differences give the hash of any run of words."""
    power, inverse = _powers(_BASE, SLICE + 1)
    return np.append(np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])), inverse


def regions(texts: list[memoryview]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text index, seed hash, region hash, first window, last window) of each region, slice by slice."""
    for group in _slices(texts):
        owner = np.repeat([i for i, _, _ in group], [len(w) for _, _, w in group])
        place = np.concatenate([np.arange(a, a + len(w)) for _, a, w in group])
        prefix, inverse = _runs(np.concatenate([w for _, _, w in group]))
        hashes = _mix((prefix[SEED:] - prefix[:-SEED]) * inverse[: len(prefix) - SEED])
        best = (_sliding_min((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), WORDS - SEED + 1) & _LOW).astype(np.int64)
        window = np.flatnonzero(owner[: len(best)] == owner[WORDS - 1 :])
        start = np.append(0, np.flatnonzero((np.diff(best[window]) != 0) | (np.diff(window) != 1)) + 1)
        first, last = window[start], window[np.append(start[1:], len(window)) - 1]
        shape = (best[first] - first) << 8 | (last - first)
        region = _mix((prefix[last + WORDS] - prefix[first]) * inverse[first] + _MIX * shape.astype(np.uint64))
        yield owner[first], hashes[best[first]].view(np.int64), region.view(np.int64), place[first], place[last]


def _slices(texts: list[memoryview]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (index, first word, words) of at most SLICE words."""
    group, size = [], 0
    for i, text in enumerate(texts):
        words = _words(text)
        for a in range(0, max(len(words) - WORDS + 1, 0), SLICE - WORDS + 1):
            part = words[a : a + SLICE]
            if size + len(part) > SLICE:
                yield group
                group, size = [], 0
            group.append((i, a, part))
            size += len(part)
    if group:
        yield group


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch["key"].to_numpy()
        for i, seed, region, first, last in regions([memoryview(x.as_buffer()) for x in batch["text"]]):
            yield pa.record_batch({"seed": pa.array(seed), "region": pa.array(region), "key": pa.array(keys[i]), "place": pa.array(first << 8 | last - first)})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the places."""
    for batch in batches:
        for key, text, places in zip(batch["key"].to_pylist(), batch["text"], batch["places"]):
            words, digits, starts = _words(memoryview(text.as_buffer())), [], []
            place, settled = (places.values.field(c).to_numpy(zero_copy_only=False) for c in ("place", "settled"))
            for first, more in zip((place >> 8).tolist(), (place & 0xFF).tolist()):
                prefix, inverse = _runs(words[first : first + more + WORDS])
                digits.append(_mix((prefix[WORDS:] - prefix[:-WORDS]) * inverse[: more + 1]))
                starts.append(np.arange(first, first + more + 1))
            start = np.concatenate(starts)
            yield pa.record_batch({"digit": pa.array(np.concatenate(digits).view(np.int64)), "key": pa.array(np.full(len(start), key)), "start": pa.array(start), "settled": pa.array(np.repeat(settled, (place & 0xFF) + 1))})


def repeated_words(keyed: DataFrame) -> DataFrame:
    """(key, n_repeated_words) of the documents (key, text) that hold a run of 51 words which stands in a document of another key too.

    Counted are the words that such runs cover; words are what white space
    parts, as bytes.
    """
    every = materialize(keyed.select("key", "text").mapInArrow(_found, "seed long, region long, key long, place long"), "passages")
    several = [F.min("key").alias("a"), F.max("key").alias("b")]
    seeds = every.groupBy("seed").agg(*several).where("a != b").select("seed")
    found = materialize(every.join(seeds, "seed"), "passages-shared")
    remove(every)
    by_region = found.groupBy("seed", "region").agg(*several).withColumn("settled", F.expr("a != b"))
    live = materialize(by_region, "passage-regions")

    digits = ["seed", "region"]
    whole = found.join(live.where("settled").select(*digits), digits).select("key", "place")
    alone = live.where("not settled").select(*digits)
    # a settled region stands for its holders where others share only its seed
    beside = found.join(live.where("settled").select(*digits, F.col("a").alias("key")), [*digits, "key"]).groupBy(*digits, "key").agg(F.min("place").alias("place")).join(alone.select("seed").distinct(), "seed")
    look = found.join(alone, digits).select("key", "place", F.lit(False).alias("settled")).union(beside.select("key", "place", F.lit(True)))
    look = materialize(look, "passage-places")
    places = look.groupBy("key").agg(F.collect_list(F.struct("place", "settled")).alias("places"))
    if look.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    each = materialize(keyed.join(places, "key").select("key", "text", "places").mapInArrow(_windows, "digit long, key long, start long, settled boolean"), "passage-windows")
    twice = each.groupBy("digit").agg(*several, F.bool_or("settled").alias("settled"), F.bool_and("settled").alias("all")).where("(a != b or settled) and not all").select("digit")
    each = each.where("not settled")
    start = F.shiftright("place", 8)
    spans = whole.select("key", start.alias("start"), (start + F.col("place").bitwiseAND(0xFF) + WORDS).alias("end"))
    spans = spans.union(each.join(twice, "digit").select("key", "start", (F.col("start") + WORDS).alias("end")))
    covered = F.expr("aggregate(array_sort(collect_list(struct(start, end))), struct(0L as n, 0L as top), (s, x) -> struct(s.n + greatest(0L, x.end - greatest(x.start, s.top)) as n, greatest(s.top, x.end) as top), s -> s.n)")
    return spans.groupBy("key").agg(covered.alias("n_repeated_words"))
