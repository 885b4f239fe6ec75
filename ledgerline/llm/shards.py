"""Operator 13: a uniform shuffle into shards of exact sizes.

1.  Count the rows of each part (a run of at most PART_ROWS rows that one task
    wrote).
2.  Draw the communication matrix, how many rows go from each part to each
    shard, from the multivariate hypergeometric law with the parts' and the
    shards' sizes as margins.  The parts are halved again and again: a node
    of this tree draws how many of its rows for a shard lie in its left half.
    So a task finds a part's row, and what the parts before it sent, from the
    draws along one path; no one holds the matrix.
3.  Permute each part at random and deal it out by its row of the matrix.
4.  Exchange, and permute again: each shard is sorted by random keys over as
    many tasks as it fills; a row's place is its slot.

All random numbers follow from the seed, the part and the row's place in it,
so that a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.operators.numbering import positions

SHARDS = 24
SEED = 20_251
#: Rows of a part at most, 2 to this power.
PART_BITS = 20
#: numpy draws exactly below this many rows.
_NUMPY_MOST = 10**9


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, drawn without return from good + bad, are good."""
    if good + bad < _NUMPY_MOST:
        return int(random.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    # beyond numpy's range: inversion over the law's ratios around its mode, within 14 deviations
    total = float(good + bad)
    mode = min(max(int((draws + 1) * ((good + 1) / (total + 2))), low), high)
    wide = int(14 * np.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / (total - 1)))) + 30
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    ratio = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    weight = np.append(0.0, np.cumsum(ratio))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return int(k[0]) + int(np.searchsorted(weight, random.random() * weight[-1], "right"))


def split(random: np.random.Generator, sizes: tuple[int, ...], draws: int) -> tuple[int, ...]:
    """Of ``draws`` rows out of classes of these sizes, how many are of each."""
    rest, out = sum(sizes), []
    for n in sizes:
        rest -= n
        out.append(hypergeometric(random, n, rest, draws))
        draws -= out[-1]
    return tuple(out)


def shard_sizes(rows: int, shards: int) -> tuple[int, ...]:
    return tuple(rows // shards + (j < rows % shards) for j in range(shards))


class Matrix:
    """Rows of the communication matrix, drawn on demand."""

    def __init__(self, counts: list[int], shards: int, seed: int):
        self.ends = [0, *np.cumsum(counts, dtype=np.int64).tolist()]
        self.shards, self.seed = shards, seed
        self._left = lru_cache(1 << 12)(self._left)

    def _left(self, low: int, mid: int, high: int, sizes: tuple[int, ...]) -> tuple[int, ...]:
        return split(_generator(self.seed, 0, low, high), sizes, self.ends[mid] - self.ends[low])

    def row(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that earlier parts send, rows this part sends) to each shard."""
        low, high = 0, len(self.ends) - 1
        own, before = shard_sizes(self.ends[-1], self.shards), np.zeros(self.shards, np.int64)
        while high - low > 1:
            mid = (low + high) // 2
            left = self._left(low, mid, high, own)
            if part < mid:
                own, high = left, mid
            else:
                before = before + left
                own, low = tuple(a - b for a, b in zip(own, left)), mid
        return before, np.array(own, np.int64)


def shuffled(seed: int, part: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of a part's rows, and a random key for each of them."""
    return _generator(seed, 1, part).permutation(rows), _generator(seed, 2, part).integers(0, 1 << 63, rows)


def dealt(before: np.ndarray, own: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard, number among the shard's rows) of the rows at these places of a part."""
    at = order[place]
    ends = np.cumsum(own)
    shard = np.searchsorted(ends, at, "right")
    return shard, (before - ends + own)[shard] + at


def place(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with ``shard``, from 0, and ``slot``, from 0 without gaps in its shard.

    Shard sizes differ by one row at most and every arrangement is equally
    likely; rows fall into place by number alone, so nulls, repeated rows and
    long texts are rows like any other.  Columns of docs called shard or slot
    are replaced.  The rows are written once as they come, then once in their
    order.  Reruns agree as long as the rows of docs come in the same order
    from the same tasks.  The driver gets one count per part.  No rows give no
    rows.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot"))).alias("row")
    rows = materialize(docs.select(own, F.monotonically_increasing_id().alias("at")), "shard-parts")
    found = rows.groupBy(F.shiftright("at", PART_BITS).alias("part")).count().orderBy("part").collect()
    number = {r["part"]: i for i, r in enumerate(found)}
    counts = [r["count"] for r in found]

    @F.pandas_udf("shard int, nth long, key long")
    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matrix, known = Matrix(counts, shards, seed), {}
        for at in batches:
            at = at.to_numpy()
            out = [np.empty(len(at), np.int64) for _ in range(3)]
            part = at >> PART_BITS
            for p in np.unique(part).tolist():
                if p not in known:  # a task reads its parts one after the other
                    known = {p: (*matrix.row(number[p]), *shuffled(seed, number[p], counts[number[p]]))}
                before, own, order, keys = known[p]
                where = part == p
                inside = at[where] & ((1 << PART_BITS) - 1)
                out[0][where], out[1][where] = dealt(before, own, order, inside)
                out[2][where] = keys[inside]
            yield pd.DataFrame({"shard": out[0].astype(np.int32), "nth": out[1], "key": out[2]})

    sent = rows.select("row", deal("at").alias("to")).select("row", "to.shard", "to.nth", "to.key")
    placed = positions(sent, "shard", [F.col("key"), F.col("nth")], "slot")
    return placed.select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes docs as Parquet in folders shard=0, shard=1 and so on, in each file by slot."""
    placed = place(docs, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
