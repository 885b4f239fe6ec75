"""Operator 11: ranked lexical search over an inverted index in shards.

Index.  A task gathers documents into shards of SHARD_BYTES of text.  In a shard
documents are numbered by doc_id; each term has one row with its postings, the
steps from one document's number to the next and the term's occurrences there,
in bytes of seven bits.  One more row holds the shard's doc_ids and lengths.
Nothing is shuffled, and a shard's size is bounded.

Search.  Items come in blocks of about BLOCK_TERMS words.  A block's terms fetch
their postings, which meet by block and shard.  There an item's postings are
merged document at a time: a heap keyed by the next document has a cursor for
each term, and a document's score is whole once the heap has passed it.  The
best of an item stand in a heap of k, keyed by score, then doc_id, which its
task keeps over all of its shards.  Once k are found, terms that even together
can't lift a document over the least of them leave the merge and are only
looked up for the documents that the others name (MaxScore).  Last, the k of
all tasks are ranked by item.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, byte_text, materialize

SHARD_BYTES = 16 << 20
BLOCK_TERMS = 50_000
#: Bytes of items up to which their terms are broadcast; beyond, terms and postings meet by a salted shuffle.
BROADCAST_BYTES = 8 << 20
SALTS = 32
K = 10

#: Letters and digits of ASCII and all else beyond it belong to terms; A-Z are lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text whose terms are listed at once.
_PIECE = 1 << 20


def term_counts(text: bytes) -> Counter[bytes]:
    """The terms of a text with their occurrences."""
    text, found, at = text.translate(_TERM_BYTES), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value) of numbers below 2**63, seven bits a byte, the lowest first; the last byte of each is below 128."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >> bits > 0
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > i)
        out[end[at] - size[at] + i] = values[at] >> 7 * i & 127 | (size[at] > i + 1) * 128
    return out, end


def unpack(data: memoryview | bytes) -> np.ndarray:
    octets = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(octets < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(octets)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((octets & 127).astype(np.int64) << 7 * place, first)


class _Shard:
    """Documents gathered for one shard of the index."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.size += len(text)
        if counts := term_counts(text):
            self.ids.append(doc_id)
            self.lengths.append(counts.total())
            self.terms.append(np.fromiter(map(self.number.__getitem__, counts), np.int32, len(counts)))
            self.times.append(np.fromiter(counts.values(), np.int64, len(counts)))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        none = np.array([i is None for i in self.ids])
        order = np.lexsort((np.array([i or 0 for i in self.ids]), none))  # by doc_id, null last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, lengths = [self.ids[i] for i in order], [self.lengths[i] for i in order]
        yield _index_batch(shard, [None], [len(ids)], pa.array([None], pa.binary()), [ids], [lengths])
        names = sorted(self.number)
        rank = np.empty(len(names), np.int32)
        rank[[self.number[x] for x in names]] = np.arange(len(names))
        doc = np.repeat(place, [len(t) for t in self.terms])
        term, times = rank[np.concatenate(self.terms)], np.concatenate(self.times)
        by = np.lexsort((doc, term))
        doc, term, times = doc[by], term[by], times[by]
        start = np.flatnonzero(np.diff(term, prepend=-1))
        step = np.diff(doc, prepend=0)
        step[start] = doc[start]
        data, end = pack(np.stack([step, times], 1).ravel())
        ends = end[1::2][np.append(start[1:], len(doc)) - 1]
        count = np.diff(start, append=len(doc))
        first = 0
        while first < len(names):
            base = int(ends[first - 1]) if first else 0
            top = max(first + 1, min(first + 20_000, int(np.searchsorted(ends, base + (4 << 20)))))
            offsets = pa.py_buffer(np.append(0, ends[first:top] - base).astype(np.int32))
            postings = pa.Array.from_buffers(pa.binary(), top - first, [None, offsets, pa.py_buffer(data[base : int(ends[top - 1])])])
            yield _index_batch(shard, names[first:top], count[first:top], postings)
            first = top


_INDEX = "shard long, term binary, n long, postings binary, ids array<long>, lengths array<long>"


def _index_batch(shard: int, terms: list, n: Iterable[int], postings: pa.Array, ids: list | None = None, lengths: list | None = None) -> pa.RecordBatch:
    size, longs = len(terms), pa.list_(pa.int64())
    return pa.record_batch({"shard": pa.array([shard] * size, pa.int64()), "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64()), "postings": postings, "ids": pa.array(ids or [None] * size, longs), "lengths": pa.array(lengths or [None] * size, longs)})


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, number = _Shard(), TaskContext.get().partitionId() << 24
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            shard.add(doc_id, text.as_buffer().to_pybytes())
            if shard.size >= SHARD_BYTES:
                yield from shard.rows(number)
                shard, number = _Shard(), number + 1
    yield from shard.rows(number)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs, written to the shared folder: (shard, term, n, postings), with n the shard's documents that hold the term.

    Rows with a null term hold the shard's documents instead: n counts them,
    ids are their doc_ids in order, null last, lengths the numbers of their
    terms.  Documents without terms, so null and empty texts, are in no shard.
    Repeated rows are documents of their own.  Columns besides doc_id and text
    are not read.
    """
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), byte_text().alias("text"))
    return materialize(rows.mapInArrow(_index, _INDEX), "index")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, block, text in zip(batch["query"].to_pylist(), batch["block"].to_pylist(), batch["text"]):
            counts = term_counts(text.as_buffer().to_pybytes())
            if counts:
                n = len(counts)
                yield pa.record_batch({"query": pa.array([query] * n, pa.int64()), "block": pa.array([block] * n, pa.int64()), "term": pa.array(list(counts), pa.binary()), "times": pa.array(counts.values(), pa.int64())})


Cursor = tuple[list[int], list[int], int, int]


def merge(cursors: list[Cursor], ids: list[int | None], best: list[tuple], k: int) -> None:
    """Scores a shard's documents for one item into the heap ``best`` of (score, smaller doc_id first, doc_id).

    A cursor has documents' numbers, ending with one past the last, what its
    term adds to each, the most it adds, and how often the item holds it.
    """
    end = len(ids)
    cursors = sorted(cursors, key=lambda c: -c[2] * c[3])
    docs, adds, times = [c[0] for c in cursors], [c[1] for c in cursors], [c[3] for c in cursors]
    rest = [0] * (len(cursors) + 1)  # what the cursors from here on add at most
    for i in range(len(cursors) - 1, -1, -1):
        rest[i] = rest[i + 1] + cursors[i][2] * times[i]
    at = [0] * len(cursors)
    least = best[0][0] if len(best) == k else 1
    lead = len(cursors)
    while lead and rest[lead - 1] < least:
        lead -= 1
    heap = [(docs[i][0], i) for i in range(lead)]
    heapq.heapify(heap)
    replace = heapq.heapreplace
    while heap:
        doc, i = heap[0]
        if doc == end:
            return
        score, here = 0, doc
        while here == doc:
            n = at[i]
            score += adds[i][n] * times[i]
            at[i] = n = n + 1
            replace(heap, (docs[i][n], i))
            here, i = heap[0]
        for i in range(lead, len(cursors)):
            if score + rest[i] < least:
                break
            at[i] = n = bisect_left(docs[i], doc, at[i])
            if docs[i][n] == doc:
                score += adds[i][n] * times[i]
        if score < least:
            continue
        own = ids[doc]
        entry = (score, -math.inf if own is None else -own, own)
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry[:2] > best[0][:2]:
            heapq.heapreplace(best, entry)
        if len(best) == k and best[0][0] > least:
            least = best[0][0]
            if lead and rest[lead - 1] < least:
                while lead and rest[lead - 1] < least:
                    lead -= 1
                heap = [h for h in heap if h[1] < lead]
                heapq.heapify(heap)


def _scored(documents: int, terms: int, k: int):
    """Rows come sorted by block and shard, a shard's documents before its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, {}
        shard, ids, m, cursors = None, [], None, defaultdict(list)

        def close() -> None:
            for query, own in cursors.items():
                merge(own, ids, best.setdefault(query, []), k)
            cursors.clear()

        def batch_of(best: dict[int, list]) -> pa.RecordBatch:
            found = [(q, e[2], e[0]) for q, heap in best.items() for e in heap]
            return pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=("query", "doc_id", "score"))

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("block", "shard", "w")]
            for i, (b, s, w) in enumerate(zip(*columns)):
                if (b, s) != (block, shard):
                    close()
                    if b != block and best:
                        yield batch_of(best)
                        best = {}
                    block, shard = b, s
                if w is None:
                    ids = batch["ids"][i].as_py()
                    m = 25 + 75 * batch["lengths"][i].values.to_numpy() * documents // terms
                    continue
                pairs = unpack(batch["postings"][i].as_buffer()).reshape(-1, 2)
                doc, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
                add = w * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                shared = [*doc.tolist(), len(ids)], add.tolist(), int(add.max())
                if shared[2] > 0:
                    for use in batch["uses"][i].as_py():
                        cursors[use["query"]].append((*shared, use["times"]))
        close()
        if best:
            yield batch_of(best)

    return run


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k best documents of the index with a score above 0.

    Equal scores rank by doc_id, null last.  Items without terms, so null and
    empty texts, and items whose terms no document holds have no rows.  Rows of
    items with equal texts have equal results.  Columns besides item_id and
    text are not read.
    """
    rows = bounded(items).select("item_id", byte_text().alias("text"))
    size, wide = rows.select("text").distinct().agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-size // (6 * BLOCK_TERMS)))
    asked = rows.select("text").distinct().select(F.monotonically_increasing_id().alias("query"), F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("block"), "text")
    asked = materialize(asked, "queries")
    uses = materialize(asked.mapInArrow(_item_terms, "query long, block long, term binary, times long"), "query-terms")
    n, total = index.where("term is null").agg(F.sum("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, total = n or 0, total or 1

    few = size <= BROADCAST_BYTES
    sent = F.broadcast if few else lambda df: df
    salt = F.lit(0) if few else F.pmod("shard", F.lit(SALTS)).cast("int")
    salts = F.array(*map(F.lit, range(1 if few else SALTS)))
    held = index.where("term is not null")
    terms = uses.select("term").distinct()
    df = held.select("term", "n", salt.alias("salt")).join(sent(terms.withColumn("salt", F.explode(salts))), ["term", "salt"]).groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")
    wanted = uses.groupBy("term", "block").agg(F.collect_list(F.struct("query", "times")).alias("uses")).join(materialize(df, "frequencies").select("term", w), "term")
    wanted = materialize(wanted, "weights").withColumn("salt", F.explode(salts))
    postings = held.select("shard", "term", "postings", salt.alias("salt")).join(sent(wanted), ["term", "salt"]).select("block", "shard", "w", "uses", "postings", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    shards = index.where("term is null").select(each, "shard", F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<struct<query: long, times: long>>").alias("uses"), F.lit(None).cast("binary").alias("postings"), "ids", "lengths")
    met = shards.unionByName(postings).repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("w").asc_nulls_first())
    found = met.mapInArrow(_scored(n, total, k), "query long, doc_id long, score long")
    turn = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", turn).where(F.col("rank") <= k)
    texts = rows.join(asked.select("query", "text"), "text")
    return texts.select("item_id", "query").join(ranked, "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """search() in a new index of docs."""
    return search(build_index(docs), items, k)
