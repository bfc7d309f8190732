from __future__ import annotations

import random

import pytest

from codeloom.operators.hierarchy import hierarchy


def brute(links):
    parent = {}
    nodes = set()
    for p, c in links:
        if c is None:
            continue
        nodes.add(c)
        if p is not None:
            nodes.add(p)
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in nodes:
        way, seen = [n], {n}
        while way[-1] in parent and parent[way[-1]] not in seen:
            way.append(parent[way[-1]])
            seen.add(way[-1])
        if way[-1] not in parent:
            out[n] = (way[-1], len(way) - 1, "/".join(map(str, reversed(way))), "tree")
        else:
            out[n] = (-1, -1, "", "on_cycle" if parent[way[-1]] == n else "below_cycle")
    return out


def forest(rng, n):
    links = []
    for c in range(1, n):
        p = rng.choice([c - 1, rng.randrange(c), rng.randrange(max(0, c - 5), c)])
        if rng.random() > 0.05:
            links.append((p, c))
    links += [(9001, 9002), (9002, 9003), (9003, 9001), (9003, 9004), (9004, 9005), (9005, 9006), (8000, 8000), (8000, 8001)]
    links += [(7000 + i, 7001 + i) for i in range(70)] + [(5000 + i, 5001 + i) for i in range(20)] + [(5020, 5000)]
    return links


@pytest.mark.parametrize("max_component", [100_000, 4])
def test_equals_brute_force(spark, max_component):
    links = forest(random.Random(7), 250)
    rows = [(p, c, "x") for p, c in links + links[:5] + [(None, 6000), (4, None), (None, None)]]
    df = spark.createDataFrame(rows, "parent long, child long, node string")
    h = hierarchy(df, "parent", "child", max_component)
    expected = brute([(p, c) for p, c, _ in rows])
    got = {r.node: (r.root, r.depth, r.path, r.status) for r in h.nodes.collect()}
    assert got == expected
    pairs = {(r.ancestor, r.node, r.distance) for r in h.descendants().collect()}
    assert pairs == {(int(a), n, e[1] - i) for n, e in expected.items() if e[3] == "tree" for i, a in enumerate(e[2].split("/")[:-1])}
    below = {r.node: r.n_descendants for r in h.nodes.collect()}
    assert below[9001] is None and below[9004] == 2 and below[9006] == 0 and below[7000] == 70
    assert {(r.cycle, r.parent, r.child) for r in h.back_edges().collect()} == {(9001, 9003, 9001), (8000, 8000, 8000), (5000, 5020, 5000)}


def test_several_parents_keep_the_least(spark):
    df = spark.createDataFrame([(5, 9), (3, 9), (3, 5)], "parent long, child long")
    h = hierarchy(df, "parent", "child")
    assert {r.node: r.path for r in h.nodes.collect()} == {3: "3", 5: "3/5", 9: "3/9"}
    assert [tuple(r) for r in h.dropped.collect()] == [(5, 9)]


def test_long_chain_below_a_cycle_takes_few_rounds(spark):
    links = [(1, 2), (2, 3), (3, 1)] + [(i, i + 1) for i in range(3, 1500)]
    nodes = hierarchy(spark.createDataFrame(links, "parent long, child long"), "parent", "child", max_component=10).nodes.collect()
    assert {r.node for r in nodes if r.status == "on_cycle"} == {1, 2, 3} and {r.cycle for r in nodes} == {1}
    assert {r.node: r.n_descendants for r in nodes if r.status == "below_cycle"} == {i: 1500 - i for i in range(4, 1501)}


def test_empty_table(spark):
    h = hierarchy(spark.createDataFrame([], "parent long, child long"), "parent", "child")
    assert h.nodes.count() == 0 and h.descendants().count() == 0 and h.back_edges().count() == 0
