"""Neighbour graphs and their communities.

Communities grow by local moves that gain modularity. The nodes of a graph are dealt into
parts of bounded size, a community's together; in one job every part moves its nodes, one after
the other and again and again, until no move gains, with the communities of other parts as they
were. So a job makes many moves. A graph of one part needs one job a level; one of more parts is
dealt anew by another hash in each round, so that what a part could not see is inside one later,
and a round that loses is tried again with half of the parts at rest. Then each community is
refined: from single nodes again, moves only inside it, so that what holds together by a
bridge that has gone is told apart. The next level works on the graph of the refined communities and begins with
the communities as they are.

Defined results: edges are undirected, repeated ones add up; a node without edges is a community of
its own; labels are 1, 2, ... by size, then least member, communities of fewer than ``minimum``
nodes are 0; the same seed gives the same labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from eventmill.plans.scratch import discard, materialize

#: Edge ends of a part at most, if no single node has more.
PART = 2_000_000
ROUNDS, LEVELS = 20, 20


def neighbour_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """``u, v, weight`` with u < v: the share of common neighbours of each edge, averaged over its two directions; 0 is left out.

    Common neighbours are counted by joining edges on them; an event has k of them, so nothing grows with its fame
    but the lists of those that name it.
    """
    sets = neighbours.select("id", "neighbour")
    a = sets.select(F.col("id").alias("u"), F.col("neighbour").alias("v"))
    mine = a.join(sets.select(F.col("id").alias("u"), F.col("neighbour").alias("w")), "u")
    both = mine.join(sets.select(F.col("id").alias("v"), F.col("neighbour").alias("w")), ["v", "w"])
    shared = both.groupBy("u", "v").agg(F.count("*").alias("common"))
    directed = shared.select("u", "v", (F.col("common") / (2 * k - F.col("common"))).alias("x"))
    return directed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg((F.sum("x") / 2).alias("weight")).where("weight > 0")


def _scores(edges: DataFrame, labels: DataFrame, resolution: float, copies: int) -> list[float]:
    """The modularity of each copy of a graph; node x is in copy x mod ``copies``."""
    la = labels.select(F.col("id").alias("u"), F.col("label").alias("a"))
    lb = labels.select(F.col("id").alias("v"), F.col("label").alias("b"))
    e = edges.join(la, "u").join(lb, "v")
    by = e.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0).alias("inside"), F.col("weight").alias("w")), F.struct(F.col("b").alias("label"), F.lit(0.0).alias("inside"), F.col("weight").alias("w")))).alias("s")).select("s.*")
    sums = by.groupBy("label").agg(F.sum("inside").alias("inside"), F.sum("w").alias("d"))
    rows = sums.groupBy(F.pmod("label", F.lit(copies)).alias("copy")).agg(F.sum("inside").alias("inside"), F.sum("d").alias("d"), F.sum(F.pow("d", F.lit(2.0))).alias("squares")).collect()  # a row a copy
    out = [0.0] * copies
    for r in rows:
        out[r["copy"]] = 2 * r["inside"] / r["d"] - resolution * r["squares"] / r["d"] ** 2 if r["d"] else 0.0
    return out


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of ``labels(id, label)`` on ``edges(u, v, weight)``; an edge of a node with itself counts at both ends."""
    return _scores(edges, labels, resolution, 1)[0]


def moved(node: np.ndarray, degree: np.ndarray, label: np.ndarray, start: np.ndarray, other_label: np.ndarray, other: np.ndarray, weight: np.ndarray, totals: dict[int, float], two_m: float, resolution: float, order: np.ndarray) -> np.ndarray:
    """The labels of a part's nodes after moves that gain until none does.

    Node i has the edge ends ``start[i]`` to ``start[i + 1]``: the place of the other node in the part, -1 if it is in
    another one, its label at the beginning, and the weight. ``totals`` are the degrees of communities.
    """
    label, totals = label.tolist(), dict(totals)
    ends = list(zip(other.tolist(), other_label.tolist(), weight.tolist(), strict=True))
    own = [ends[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
    degree = degree.tolist()
    waiting, queued = order.tolist()[::-1], [True] * len(label)
    while waiting:
        batch, waiting = waiting[::-1], []
        for i in batch:
            queued[i] = False
            links: dict[int, float] = {}
            for j, far, w in own[i]:
                to = label[j] if j >= 0 else far
                links[to] = links.get(to, 0.0) + w
            now, k = label[i], degree[i]
            totals[now] -= k
            share = resolution * k / two_m
            best, gain = now, links.get(now, 0.0) - share * totals[now]
            for to, w in links.items():
                g = w - share * totals[to]
                if g > gain + 1e-12 or (g > gain - 1e-12 and best != now and to < best):
                    best, gain = to, max(g, gain)
            totals[best] += k
            if best != now:
                label[i] = best
                for j, _, _ in own[i]:
                    if j >= 0 and not queued[j] and label[j] != best:
                        queued[j] = True
                        waiting.append(j)
    return np.array(label, np.int64)


def _round(both: DataFrame, state: DataFrame, copies: int, parts: int, part: int, salt: int, idle: int, two_m: float, resolution: float) -> DataFrame:
    """``id, label, inside`` after one round: ``both(id, other, weight)`` has each edge from both ends, ``state(id, label, inside, k, ends)`` each node.

    ``inside`` bounds moves: only nodes of the same value may share a label. What has one label or bound lies in one part, if it fits.
    """
    totals = state.groupBy("label").agg(F.sum("k").alias("total"))
    together = F.coalesce("inside", "label")
    placed = state.join(totals, "label").withColumn("together", together)
    if parts > 1:  # a community of more than a part's edges is cut into cells
        cells = state.select(together.alias("together"), "ends").groupBy("together").agg(F.ceil(F.sum("ends") / F.lit(max(1, part // 2))).alias("cells"))
        placed = placed.join(cells, "together").withColumn("cell", F.pmod(F.xxhash64("id", F.lit(salt)), "cells"))
    else:
        placed = placed.withColumn("cell", F.lit(0))
    placed = placed.withColumn("part", (F.pmod("id", F.lit(copies)) * parts + F.pmod(F.xxhash64("together", "cell", F.lit(salt)), F.lit(parts))).cast("int"))
    far = placed.select(F.col("id").alias("other"), F.col("label").alias("to"), F.col("total").alias("to_total"), F.col("part").alias("to_part"), F.col("inside").alias("to_inside"))
    ends = both.join(far, "other").join(placed.select("id", "part", "inside"), "id").where(F.col("inside").eqNullSafe(F.col("to_inside")))
    mine = placed.select("part", "id", "label", "inside", "k", "total", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("double").alias("to_total"), F.lit(None).cast("boolean").alias("here"))
    edge = ends.select("part", "id", F.lit(None).cast("long").alias("label"), F.col("inside"), F.lit(None).cast("double").alias("k"), F.lit(None).cast("double").alias("total"), "other", "weight", "to", "to_total", (F.col("to_part") == F.col("part")).alias("here"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "other"], kind="stable")
        nodes, edges = rows[rows["k"].notna()], rows[rows["k"].isna()]
        ids = nodes["id"].to_numpy(np.int64)
        number = int(rows["part"].iloc[0])
        label = nodes["label"].to_numpy(np.int64)
        if idle == 0 or (number + salt) % 2**idle == 0:
            totals = dict(zip(edges["to"].astype(np.int64).tolist(), edges["to_total"].tolist(), strict=True)) | dict(zip(label.tolist(), nodes["total"].tolist(), strict=True))
            other = edges["other"].to_numpy(np.int64)
            at = np.searchsorted(ids, other)
            at = np.where(edges["here"].to_numpy(bool), at, -1)
            start = np.searchsorted(edges["id"].to_numpy(np.int64), np.append(ids, np.iinfo(np.int64).max))
            order = np.random.default_rng([salt, number]).permutation(len(ids))
            label = moved(ids, nodes["k"].to_numpy(), label, start, edges["to"].to_numpy(np.int64), at, edges["weight"].to_numpy(), totals, two_m, resolution, order)
        return pd.DataFrame({"id": ids, "label": label})

    out = mine.unionByName(edge).groupBy("part").applyInPandas(run, "id long, label long")
    return materialize(out, "moved")


def _settled(level: DataFrame, state: DataFrame, both: DataFrame, copies: int, parts: int, part: int, two_m: float, resolution: float, seed: int, rounds: int) -> DataFrame:
    """``state`` after rounds until none gains."""

    def relabelled(new: DataFrame) -> DataFrame:
        return materialize(state.drop("label").join(new, "id").select("id", "label", "inside", "k", "ends"), "labels")

    if parts == 1:  # one round makes all moves, and none of them loses
        return relabelled(_round(both, state, copies, 1, part, seed, 0, two_m, resolution))
    reached, idle = sum(_scores(level, state, resolution, copies)), 0
    for r in range(rounds):
        new = _round(both, state, copies, parts, part, seed + r, idle, two_m, resolution)
        after = sum(_scores(level, new, resolution, copies))
        if after > reached + 1e-9:
            state, reached, idle = relabelled(new), after, 0
        else:
            idle += 1
            if 2**idle > parts:
                break
    return state


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, minimum: int = 10, seed: int = 42, restarts: int = 1, part: int = PART, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """``id, label`` of ``nodes(id)`` on ``edges(u, v, weight)``: the best of ``restarts`` orders of nodes.

    All orders go through the same jobs, as copies of the graph; ids are below 2^58 in size.
    """
    graph = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), F.col("weight").cast("double").alias("weight"))
    copy = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))
    graph = graph.groupBy("u", "v").agg(F.sum("weight").alias("weight")).withColumn("copy", copy)
    graph = materialize(graph.select((F.col("u") * restarts + F.col("copy")).alias("u"), (F.col("v") * restarts + F.col("copy")).alias("v"), "weight"), "graph")
    found = _levels(graph, restarts, resolution, seed, part, rounds, levels)
    best = max(enumerate(_scores(graph, found, resolution, restarts)), key=lambda x: x[1])[0] if restarts > 1 else 0
    own = found.where(F.pmod("id", F.lit(restarts)) == best).select(*[F.expr(f"({c} - {best}) div {restarts}").alias(c) for c in ("id", "label")])
    where = nodes.select(F.col("id").cast("long").alias("id")).distinct().join(own, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    where = materialize(where, "labels")
    sizes = where.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= minimum)
    ranked = sizes.select("label", F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("rank"))  # one row a community
    return where.join(ranked, "label", "left").select("id", F.coalesce("rank", F.lit(0)).alias("label"))


def _levels(graph: DataFrame, copies: int, resolution: float, seed: int, part: int, rounds: int, levels: int) -> DataFrame:
    """``id, label`` of every node with an edge."""
    level = graph
    ends = level.select(F.explode(F.array("u", "v")).alias("id"), "weight")
    degree = materialize(ends.groupBy("id").agg(F.sum("weight").alias("k"), F.count("*").alias("ends")), "degrees")
    two_m = (degree.agg(F.sum("k")).first()[0] or 0.0) / copies
    where = degree.select("id", F.col("id").alias("node"))  # the node of the level that holds each
    state = degree.select("id", F.col("id").alias("label"), F.lit(None).cast("long").alias("inside"), "k", "ends")
    if not two_m:
        return where.select("id", F.col("node").alias("label"))
    for at in range(levels):
        pairs = level.where("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other"), "weight"), F.struct(F.col("v").alias("id"), F.col("u").alias("other"), "weight"))).alias("e")).select("e.*")
        both = materialize(pairs, "both")
        parts = max(1, -(-both.count() // (copies * part)))
        coarse = _settled(level, state, both, copies, parts, part, two_m, resolution, seed + 100 * at, rounds)
        # refined: single nodes again, moves inside a community only
        single = coarse.select("id", F.col("id").alias("label"), F.col("label").alias("inside"), "k", "ends")
        fine = _settled(level, single, both, copies, parts, part, two_m, resolution, seed + 100 * at + 50, rounds)
        labels = where.join(coarse.select(F.col("id").alias("node"), "label"), "node").select("id", "label")
        if fine.where("id <> label").isEmpty():  # every node stands alone: the next level would be this one
            break
        step = fine.select(F.col("id").alias("node"), F.col("label").alias("to"))
        where = materialize(where.join(step, "node").select("id", F.col("to").alias("node")), "nodes")
        state = fine.groupBy(F.col("label").alias("id")).agg(F.min("inside").alias("label"), F.sum("k").alias("k"), F.sum("ends").alias("ends"))
        state = materialize(state.select("id", "label", F.lit(None).cast("long").alias("inside"), "k", "ends"), "state")
        ju, jv = step.withColumnsRenamed({"node": "u", "to": "a"}), step.withColumnsRenamed({"node": "v", "to": "b"})
        merged = level.join(ju, "u").join(jv, "v").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("weight").alias("weight"))
        before, level = level, materialize(merged, "graph")
        discard(both, *([before] if before is not graph else []))
    return materialize(labels, "labels")
