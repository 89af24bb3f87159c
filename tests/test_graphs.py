"""Communities against a plain Louvain on the whole graph."""

import random

import numpy as np
import pytest

from eventmill.operators import graphs as G


def plain_modularity(edges, label, resolution=1.0):
    m = sum(w for _, _, w in edges)
    inside, degree = {}, {}
    for u, v, w in edges:
        inside[label[u]] = inside.get(label[u], 0) + (w if label[u] == label[v] else 0)
        degree[label[u]] = degree.get(label[u], 0) + w
        degree[label[v]] = degree.get(label[v], 0) + w
    return sum(inside.values()) / m - resolution * sum((d / (2 * m)) ** 2 for d in degree.values())


def plain_louvain(edges, seed):
    """Modularity after local moves on each level's graph until none gains."""
    rng, level = random.Random(seed), list(edges)
    of = {x: x for u, v, _ in edges for x in (u, v)}
    m2 = 2 * sum(w for _, _, w in edges)
    while True:
        near, k = {}, {}
        for u, v, w in level:
            k[u], k[v] = k.get(u, 0) + w, k.get(v, 0) + w
            if u != v:
                near.setdefault(u, {})[v] = near.get(u, {}).get(v, 0) + w
                near.setdefault(v, {})[u] = near.get(v, {}).get(u, 0) + w
        label, total = {x: x for x in k}, dict(k)
        order, any_move = list(k), False
        rng.shuffle(order)
        again = True
        while again:
            again = False
            for x in order:
                links = {}
                for y, w in near.get(x, {}).items():
                    links[label[y]] = links.get(label[y], 0) + w
                total[label[x]] -= k[x]
                best, gain = label[x], links.get(label[x], 0) - k[x] * total[label[x]] / m2
                for to, w in links.items():
                    if w - k[x] * total[to] / m2 > gain + 1e-12:
                        best, gain = to, w - k[x] * total[to] / m2
                total[best] += k[x]
                if best != label[x]:
                    label[x], again, any_move = best, True, True
        of = {x: label[c] for x, c in of.items()}
        if not any_move:
            return plain_modularity(edges, of)
        merged = {}
        for u, v, w in level:
            a, b = sorted((label[u], label[v]))
            merged[a, b] = merged.get((a, b), 0) + w
        level = [(a, b, w) for (a, b), w in merged.items()]


def planted(n, groups, inside, outside, seed):
    r = random.Random(seed)
    return [(i, j, r.uniform(0.5, 1.5)) for j in range(n) for i in range(j) if r.random() < (inside if i % groups == j % groups else outside)]


@pytest.mark.parametrize("part", [10**6, 400])
def test_modularity_of_a_plain_louvain(spark, part):
    edges = planted(180, 6, 0.4, 0.04, 1)
    df = spark.createDataFrame(edges, "u long, v long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(182)], "id long")
    got = {r.id: r.label for r in G.communities(df, nodes, minimum=2, part=part).collect()}
    label = {i: g or -i for i, g in got.items()}
    score = plain_modularity(edges, label)
    assert score == pytest.approx(G.modularity(df, spark.createDataFrame(list(label.items()), "id long, label long")))
    plain = [plain_louvain(edges, s) for s in range(5)]
    assert score >= (np.median(plain) if part > 1000 else 0.97 * min(plain)) - 1e-9
    assert got[180] == got[181] == 0 and set(got) == set(range(182))
    groups = {}
    for i in range(180):
        groups.setdefault(got[i], []).append(i % 6)
    right = sum(max(g.count(k) for k in range(6)) for g in groups.values())
    assert right >= 0.9 * 180


def test_edges_both_ways_and_repeated_and_none(spark):
    edges = [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 1, 2.0), (4, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0), (3, 4, 0.1), (4, 3, 0.1)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    df = spark.createDataFrame(edges, "u long, v long, weight double")
    got = {r.id: r.label for r in G.communities(df, nodes, minimum=3, restarts=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 0}
    assert {r.label for r in G.communities(df.limit(0), nodes, minimum=1).collect()} == set(range(1, 8))
