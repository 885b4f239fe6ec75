"""Operator 3: benchmark decontamination by trigram seeds and Smith-Waterman.

Word trigrams of the test items are looked up in all documents.  Each is a seed,
however many documents hold it, as leaks themselves make trigrams frequent.
Around a seed the passage and the item are aligned (match 2, mismatch -1, gap
-1); the score is the best local alignment over that of the item with itself.
Copies keep most of it, also edited and paraphrased ones.  Passages that share
too few words with the item to reach the score are not aligned, so phrases
everyone uses cost little.  A copy without any three words in a row, such as one
with a foreign word after every second, has no seed and is not found.

Items of up to BROADCAST_BYTES of text go to every task, which then seeds and
aligns a document in one pass without a shuffle; more are joined by trigram.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, materialize

GRAM = 3
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Distinct items of up to so much text in all are sent to the tasks.
BROADCAST_BYTES = 16 << 20
#: Words of passages that are aligned together, about.
TOGETHER = 1 << 18
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def best_scores(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each passage with its item; words are numbers from 0."""
    out = np.zeros(len(passages), np.int64)
    order = np.argsort([len(p) for p in passages], kind="stable")
    at = 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and (end == at or (end - at + 1) * len(passages[order[end]]) <= 1 << 18):
            end += 1
        pick = order[at:end]
        at = end
        width, height = len(passages[pick[-1]]), max(len(items[i]) for i in pick)
        p, q = np.full((len(pick), width), -2), np.full((len(pick), height), -1)
        for row, i in enumerate(pick):
            p[row, : len(passages[i])] = passages[i]
            q[row, : len(items[i])] = items[i]
        slope = -GAP * np.arange(width, dtype=np.int64)
        h, best = np.zeros((len(pick), width + 1), np.int64), np.zeros(len(pick), np.int64)
        for k in range(height):
            step = np.maximum(h[:, :-1] + np.where(p == q[:, k : k + 1], MATCH, MISMATCH), h[:, 1:] + GAP)
            np.maximum(step, 0, out=step)
            # gaps along the passage: the best earlier cell less what the gap costs
            h[:, 1:] = np.maximum.accumulate(step + slope, axis=1) - slope
            best = np.maximum(best, h.max(axis=1))
        out[pick] = best
    return out


def _gram(parts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, _gram(w[k : k + GRAM]), k, w) for i, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist()) for w in [words(t)] for k in range(len(w) - GRAM + 1)]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())))], names=("item_id", "gram", "at", "words"))


def _ragged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first to last, and where each range begins among them."""
    size = last - first
    begin = np.cumsum(size) - size
    return np.repeat(first - begin, size) + np.arange(size.sum()), begin


class Items:
    """Test items as numbers: what a task needs to seed and align."""

    def __init__(self, items: list[tuple[int | None, list[str]]]) -> None:
        items = [(i, w) for i, w in items if len(w) >= GRAM]
        self.ids = [i for i, _ in items]
        self.numbers = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.words = [np.array([self.numbers[w] for w in ws], np.int64) for _, ws in items]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.end = np.cumsum(self.size)
        self.flat = np.concatenate(self.words) if items else np.zeros(0, np.int64)
        grams = [self.codes(w) for w in self.words]
        self.known, slot = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int64), return_inverse=True)
        #: by item the slots of its trigrams in known, and by slot the items that hold it
        self.slots = np.split(slot, np.cumsum(self.size - GRAM + 1)[:-1]) if items else []
        owner = np.repeat(np.arange(len(items)), self.size - GRAM + 1)
        pairs = np.unique(np.stack([slot, owner], 1), axis=0) if items else np.zeros((0, 2), np.int64)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each trigram of known words."""
        n = len(self.numbers) + 1
        return (ids[:-2] * n + ids[1:-1]) * n + ids[2:]

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, place) of the items' trigrams in a text, by slot."""
        if len(ids) < GRAM or not len(self.known):
            return (np.zeros(0, np.int64),) * 2
        place = np.flatnonzero((ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0))
        code = self.codes(ids)[place]
        slot = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        hit = self.known[slot] == code
        order = np.argsort(slot[hit], kind="stable")
        return slot[hit][order], place[hit][order]

    def candidates(self, slots: np.ndarray, ids: np.ndarray, least: float) -> np.ndarray:
        """Items with one of the slots that share enough words with the text for the least score."""
        which = np.unique(self.owners[_ragged(self.first[slots], self.first[slots + 1])[0]])
        held = np.zeros(len(self.numbers), bool)
        held[ids[ids >= 0]] = True
        at, begin = _ragged(self.end[which] - self.size[which], self.end[which])
        return which[np.add.reduceat(held[self.flat[at]].astype(np.int64), begin) >= (least - 1e-6) * self.size[which]]


def _windows(starts: np.ndarray, n: int, least: float) -> list[list[int]]:
    """Stretches of a text in which an item of n words may lie that begins near starts."""
    # an alignment of the least score has no room for more gaps
    slack = max(8, math.ceil(2 * n * (1 - least)))
    merged: list[list[int]] = []
    for a in np.unique(starts).tolist():
        if merged and max(0, a - slack) <= merged[-1][1]:
            merged[-1][1] = a + n + slack
        else:
            merged.append([max(0, a - slack), a + n + slack])
    return merged


def _found(items: Items, texts: list[str | None], least: float) -> Iterator[list[tuple[int, int, int, float]]]:
    """(text, item, seeds, score) of what is aligned, as lists of about TOGETHER words."""
    passages, against, rows, size = [], [], [], 0

    def scored() -> list[tuple[int, int, int, float]]:
        score = best_scores(passages, against)
        return [(t, k, n, round(float(x) / (MATCH * len(q)), 6)) for (t, k, n), x, q in zip(rows, score, against)]

    for t, text in enumerate(texts):
        ids = np.array([items.numbers.get(w, -3) for w in words(text)], np.int64)  # -1 and -2 fill up rows that are aligned together
        slot, place = items.seeds(ids)
        if not len(slot):
            continue
        own = np.unique(slot)
        first, last = np.searchsorted(slot, own), np.searchsorted(slot, own, "right")
        for k in items.candidates(own, ids, least).tolist():
            at = np.flatnonzero(np.isin(items.slots[k], own))
            which = np.searchsorted(own, items.slots[k][at])
            idx, _ = _ragged(first[which], last[which])
            starts = place[idx] - np.repeat(at, last[which] - first[which])
            item = items.words[k]
            for a, b in _windows(starts, len(item), least):
                # each word of the item matches once at most
                if np.isin(item, ids[a:b]).sum() >= (least - 1e-6) * len(item):
                    passages.append(ids[a:b])
                    against.append(item)
                    rows.append((t, k, len(starts)))
                    size += len(passages[-1])
                    if size > TOGETHER:
                        yield scored()
                        passages, against, rows, size = [], [], [], 0
    if rows:
        yield scored()


def _leak_rows(known, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        for batch in batches:
            keys, docs = batch["key"].to_pylist(), batch["doc_id"].to_pylist()
            for found in _found(items, batch["text"].to_pylist(), least):
                rows = [(keys[t], docs[t], items.ids[k], n, score) for t, k, n, score in found if score >= least]
                if rows:
                    yield pa.record_batch([pa.array(c, f) for c, f in zip(zip(*rows), _FOUND_TYPES)], names=_FOUND)

    return run


def _clean_rows(known, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for found in _found(known.value, batch["text"].to_pylist(), least):
                keep[[t for t, _, _, score in found if score >= least]] = False
            yield batch.filter(pa.array(keep))

    return run


def _all_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
            w = words(text)
            n = max(0, len(w) - GRAM + 1)
            yield pa.record_batch([pa.array([key] * n, pa.int64()), pa.array([_gram(w[k : k + GRAM]) for k in range(n)], pa.int64()), pa.array(range(n), pa.int64())], names=("key", "gram", "place"))


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, text, hits in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "text", "hits"))):
                numbers: dict[str, int] = {}
                number = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64)
                passages, items, rows, own = [], [], [], number(words(text))
                for hit in hits:
                    item = number(hit["words"])
                    for a, b in _windows(np.array(hit["starts"]), len(item), least):
                        if np.isin(item, own[a:b]).sum() >= (least - 1e-6) * len(item):
                            passages.append(own[a:b])
                            items.append(item)
                            rows.append((key, doc, hit["item_id"], hit["seeds"]))
                score = best_scores(passages, items) if rows else []
                found = [(*r, round(float(x) / (MATCH * len(q)), 6)) for r, x, q in zip(rows, score, items)]
                found = [r for r in found if r[-1] >= least]
                if found:
                    yield pa.record_batch([pa.array(c, f) for c, f in zip(zip(*found), _FOUND_TYPES)], names=_FOUND)

    return run


_FOUND = ("key", "doc_id", "item_id", "seeds", "score")
_FOUND_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
_FOUND_SCHEMA = "key long, doc_id long, item_id long, seeds long, score double"


def _keyed(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """(doc_id, item_id, seeds, score) for each document and item that align with ``score`` or more.

    seeds counts the item's seeds in the document.  Items of fewer than three
    words and null texts have no seeds.  Rows that repeat a doc_id or item_id
    are taken together, with their highest score; rows with a null id are found
    too.  Other columns are not read; an empty table on either side gives none.
    """
    found = _aligned(docs, benchmark, score)
    return found.groupBy("doc_id", "item_id").agg(F.max("seeds").alias("seeds"), F.max("score").alias("score"))


def _distinct_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _broadcast_items(benchmark: DataFrame):
    """The items as a broadcast variable; None if they are more than BROADCAST_BYTES."""
    items = _distinct_items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        return None
    return items.sparkSession.sparkContext.broadcast(Items([(r.item_id, words(r.text)) for r in items.orderBy("item_id", "text").collect()]))


def _aligned(docs: DataFrame, benchmark: DataFrame, score: float) -> DataFrame:
    """A row (key, doc_id, item_id, seeds, score) for each passage that aligns; key is a hash of doc_id and text."""
    keyed = _keyed(docs)
    known = _broadcast_items(benchmark)
    if known is not None:
        return keyed.mapInArrow(_leak_rows(known, score), _FOUND_SCHEMA)
    grams = materialize(_distinct_items(benchmark).mapInArrow(_item_grams, "item_id long, gram long, at int, words array<string>"), "items")
    matches = keyed.select("key", "text").mapInArrow(_all_grams, "key long, gram long, place long").join(grams.select("gram").distinct(), "gram", "left_semi").select("key", "gram", "place")
    seeds = grams.select("item_id", "gram", "at", F.xxhash64("words").alias("version"))
    pairs = matches.join(seeds, "gram").groupBy("key", "item_id", "version").agg(F.collect_set(F.struct("place", "at")).alias("places"))
    found = (F.size("places").cast("long").alias("seeds"), F.array_distinct(F.transform("places", lambda p: p["place"] - p["at"])).alias("starts"))
    texts = grams.select("item_id", F.xxhash64("words").alias("version"), "words").distinct()
    same = F.col("p.item_id").eqNullSafe(F.col("t.item_id")) & (F.col("p.version") == F.col("t.version"))
    wanted = pairs.alias("p").join(texts.alias("t"), same).select("p.key", F.struct("p.item_id", "words", *found).alias("hit"))
    wanted = wanted.groupBy("key").agg(F.collect_list("hit").alias("hits"))
    return keyed.join(wanted, "key").select("key", "doc_id", "text", "hits").mapInArrow(_align(score), _FOUND_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """docs without the rows whose text aligns with an item.

    Each row is judged by its own text, whatever its doc_id; a null or empty
    text stays.  An empty table on either side takes nothing away.
    """
    known = _broadcast_items(benchmark)
    if known is not None:
        return bounded(docs).mapInArrow(_clean_rows(known, score), docs.schema)
    gone = _aligned(docs, benchmark, score).select("key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    return keyed.join(gone, "key", "left_anti").select("row.*")
