import random

from ledgerline.llm.components import UnionFind, connected_components


def brute(links):
    sets = UnionFind()
    for a, b in links:
        sets.union(a, b)
    return {x: sets.find(x) for x in list(sets.parent)}


def test_matches_union_find(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)]  # a long chain
    links += [(1000, 1000 + i) for i in range(1, 400)]  # a star
    links += [(r.randrange(2000, 3000), r.randrange(2000, 3000)) for _ in range(600)] + [(-5, 7), (-5, -9), (-5, 7)]
    r.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    want = {k: v for k, v in brute([x for x in links if x[0] != x[1]]).items()}
    assert got == want


def test_none_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
