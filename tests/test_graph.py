"""Components, outlines, percentiles and finished streams against brute force."""

import math
import random

from vellumspark.operators import bags, graph, records, web


def naive_roots(edges):
    root = {n: n for e in edges for n in e}
    while True:
        moved = {n: min([root[n]] + [root[b] for a, b in edges if a == n] + [root[a] for a, b in edges if b == n]) for n in root}
        if moved == root:
            return root
        root = moved


def test_components(spark):
    rng = random.Random(1)
    cases = [[(i, i + 1) for i in range(40)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(0, i) for i in range(1, 50)], [(3, 3)], []]
    for edges in cases:
        links = spark.createDataFrame(edges, "a long, b long")
        want = naive_roots(edges)
        assert {(r.page, r.root) for r in web.alternate_groups(links).collect()} == set(want.items())
        got = {r.node: r.root for r in graph.connected_components(links.toDF("u", "v")).collect()}
        assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_outline(spark):
    """A chain deeper than any number of rounds, an entry that is its own ancestor, a page twice."""
    entries = [(1, i, i - 1 if i else None, i) for i in range(12)] + [(2, 1, 2, 1), (2, 2, 1, 2), (3, 1, None, 1), (3, 2, None, 1)]
    kept = spark.createDataFrame([(1, 9), (2, 2), (3, 1), (3, 1)], "doc long, page long")
    got = records.surviving_outline(spark.createDataFrame(entries, "doc long, entry long, parent long, page long"), kept).collect()
    assert sorted(tuple(r) for r in got) == [(1, i) for i in range(10)] + [(2, 1), (2, 2), (3, 1), (3, 2)]


def test_percentile(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(10)) for k in "abc" for _ in range(rng.randrange(1, 60))] + [("one", 5)]
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.value for r in bags.percentile(spark.createDataFrame(rows, "k string, v int"), "k", "v", share).collect()}
        for k in {k for k, _ in rows}:
            values = sorted(v for key, v in rows if key == k)
            assert got[k] == values[min(len(values) - 1, math.floor(share * len(values)))]
