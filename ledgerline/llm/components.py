"""Connected components of a link table, by distributed union-find.

Each task first joins its own links with a union-find, which leaves at most
one link per node and task.  Then large-star and small-star steps (Kiveris et
al., "Connected Components in MapReduce and Beyond", 2014) hook every node to
the smallest node near it until all point at their component's smallest one.
No step holds a node's neighbours in memory; each is a minimum by key and a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, remove


class UnionFind:
    """Of integers; a set's root is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while (up := self.parent[x]) != root:
            self.parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


#: Links a task joins at once; bounds its memory, not its result.
CHUNK = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()

    def flush() -> pa.RecordBatch:
        nodes = [x for x, up in sets.parent.items() if up != x]
        roots = [sets.find(x) for x in nodes]
        return pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array(roots, pa.int64())})

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            sets.union(a, b)
        if len(sets.parent) > CHUNK:
            yield flush()
            sets = UnionFind()
    yield flush()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def joined_within(find: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the links (a, b) that find yields, joined in the same task and Python worker."""
    return lambda batches: _contract(find(batches))


def connected_components(links: DataFrame, joined: bool = False) -> DataFrame:
    """links (a long, b long) -> (node, root) for every node that has a link.

    joined: the links come from joined_within(), so no task need join its own.

    root is the smallest node reachable.  Links of a node to itself and rows
    with a null are ignored; direction and repetition don't matter.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize((links if joined else links.mapInArrow(_contract, "a long, b long")).distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v"), F.col("m")).where("v <> m").distinct()
        # every link now points down: v > m
        down = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("low").alias("b")), F.struct(F.col("m").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b")
        after = materialize(small.where("a <> b").distinct(), "links")
        new = _state(after)
        remove(now)
        now, done = after, new == state
        state = new
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def spanning_links(values: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that join what near(i, others) joins, one less than members per component.

    values: indices.  Each is compared with those no component has yet, so a
    dense group costs little more than one pass over it.
    """
    links, left = [], values
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = near(x, left)
            if hit.any():
                links += [(x, y) for y in left[hit]]
                todo += list(left[hit])
                left = left[~hit]
    return links
