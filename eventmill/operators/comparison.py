"""Comparisons of distributions and of groups, over all values of any number of populations at once.

Values are counted by distinct value before they are ordered, and order is taken in cells
(``plans.order_statistics``), so that no population is held by one task. What reaches a
probability function is a few numbers for each test.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.functions import probabilities as prob
from eventmill.functions.columns import finite
from eventmill.plans.order_statistics import percentiles, with_sums_below
from eventmill.plans.scratch import materialize


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys], F.lit(True))


def _keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        rows = rows.withColumnRenamed(k, f"__{k}")
    return rows


def against_control(events: DataFrame, population: str, value: Column, control: str, by: list[str] | None = None) -> DataFrame:
    """``by, population, v, c, t``: at each value of a target or of the control the events of both.

    The control's values are counted before they meet the targets, of which a request has few.
    """
    by = by or []
    rows = events.select(*by, F.col(population).alias("population"), finite(value).alias("v")).where("v IS NOT NULL")
    counted = rows.groupBy(*by, "population", "v").agg(F.count("*").alias("n"))
    is_control = F.col("population").eqNullSafe(F.lit(control))
    targets = rows.where(~is_control).select(*by, "population").distinct()
    held = counted.where(is_control).select(*[F.col(b).alias(f"__{b}") for b in by], "v", "n")
    c = targets.join(held, _same(targets, held, by)).select(*by, "population", "v", F.col("n").alias("c"), F.lit(0).cast("long").alias("t"))
    t = counted.where(~is_control).select(*by, "population", "v", F.lit(0).cast("long").alias("c"), F.col("n").alias("t"))
    return c.unionByName(t).groupBy(*by, "population", "v").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def leave_one_out(controls: DataFrame, sample: str, value: Column) -> DataFrame:
    """``population, v, below, upto, c, t, c_total, t_total``: each control sample at its own values, against all others.

    The others' counts are those of all less its own: sums below a value of all are taken once and read at
    the sample's values, so a sample does not meet the values of the others. ``below`` and ``upto`` are the others' events
    under a value and up to it.
    """
    rows = controls.select(F.col(sample).alias("population"), finite(value).alias("v")).where("v IS NOT NULL")
    own = materialize(rows.groupBy("population", "v").agg(F.count("*").alias("t")), "own")
    mine = with_sums_below(own, ["population"], "v", ["t"])
    every = with_sums_below(own.select("v", F.col("t").alias("a")), [], "v", ["a"]).select("v", "a", "a_below", "a_total")
    told = mine.join(every, "v")
    below = F.col("a_below") - F.col("t_below")
    return told.select("population", "v", below.alias("below"), (below + F.col("a") - F.col("t")).alias("upto"), (F.col("a") - F.col("t")).alias("c"), "t", (F.col("a_total") - F.col("t_total")).alias("c_total"), "t_total", "t_below")


def leave_one_out_distances(controls: DataFrame, sample: str, value: Column) -> DataFrame:
    """``population, n_control, n, ks_distance, ks_p_value, reason``: each control sample against the pool of all others.

    Two step functions are farthest apart at a value of one of them or right below it; between two values of the
    sample the pool only rises, so the sample's own values, from both sides, are enough. Without others there is a reason.
    """
    r = leave_one_out(controls, sample, value)
    here = F.abs(F.col("upto") / F.col("c_total") - (F.col("t_below") + F.col("t")) / F.col("t_total"))
    before = F.abs(F.col("below") / F.col("c_total") - F.col("t_below") / F.col("t_total"))
    g = r.groupBy("population").agg(F.max("c_total").alias("n_control"), F.max("t_total").alias("n"), F.max(F.when(F.col("c_total") > 0, F.greatest(here, before))).alias("ks_distance"))
    chance = F.when(F.col("n_control") > 0, prob.ks_p_value(F.col("ks_distance"), F.col("n_control"), F.col("n")))
    return g.select("population", "n_control", "n", "ks_distance", chance.alias("ks_p_value"), F.when(F.col("n_control") == 0, "no other control has finite events").alias("reason"))


def pooled_controls(events: DataFrame, ids: list[str], masks: list[Column]) -> DataFrame:
    """Events of any of several control populations, each once."""
    return events.where(reduce(lambda a, b: a | b, masks)).dropDuplicates(ids)


def shared_counts(a: DataFrame, b: DataFrame, ids: list[str]) -> DataFrame:
    """``n_a, n_b, shared``: distinct events of two populations and those in both."""
    both = a.select(*ids).distinct().withColumn("__a", F.lit(1)).join(b.select(*ids).distinct().withColumn("__b", F.lit(1)), ids, "full")
    return both.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("shared"))


def distribution_effects(counts: DataFrame, keys: list[str], direction: str = "higher", shared: bool = False) -> DataFrame:
    """Effects of each target against its control, from rows ``keys, v, c, t``.

    ``ks_distance`` with its value ``ks_at``, sign (control less target) and two-sided chance; cumulative subtraction
    ``overton_percent``, the share of it at the control's height ``enhanced_percent``, and ``ens_percent`` with the largest
    correction before that place. Events that both share allow no chance. ``lower`` takes positives from the other end.
    """
    if direction not in ("higher", "lower"):
        raise ValueError("the positive direction is higher or lower")
    r = with_sums_below(counts, keys, "v", ["c", "t"]).where("c_total > 0 AND t_total > 0")
    c, t = (F.col(f"{k}_below") + F.col(k) for k in "ct")
    r = r.withColumns({"fc": c / F.col("c_total"), "ft": t / F.col("t_total")})
    if direction == "higher":
        r = r.withColumns({"pc": F.col("fc"), "pt": F.col("ft"), "place": F.col("v")})
    else:
        r = r.withColumns({"pc": 1 - F.col("c_below") / F.col("c_total"), "pt": 1 - F.col("t_below") / F.col("t_total"), "place": -F.col("v")})
    r = materialize(r.select(*keys, "v", "c_total", "t_total", "fc", "ft", "pc", "pt", "place", "c", "t"), "curves")
    apart, ahead = F.col("fc") - F.col("ft"), F.col("pc") - F.col("pt")
    head = r.groupBy(*keys).agg(
        F.max("c_total").alias("n_control"),
        F.max("t_total").alias("n"),
        F.min(F.struct((-F.abs(apart)).alias("d"), F.col("v").alias("at"), apart.alias("signed"))).alias("ks"),
        F.min(F.struct((-ahead).alias("d"), "place", "pc", "pt", "v")).alias("top"),
        F.count_if((F.col("c") > 1) | (F.col("t") > 1)).alias("tied"),
    )
    named = _keyed(head.select(*keys, "top"), keys)
    cd, td = F.col("top.pc"), F.col("top.pt")
    prefix = r.join(named, _same(r, named, keys)).where((F.col("place") <= F.col("top.place")) & (F.col("top.d") < 0))
    correction = prefix.groupBy(*keys).agg(F.max((F.col("pc") * td - cd * F.col("pt")) / F.nullif(cd * cd, F.lit(0.0))).alias("correction"))
    late = _keyed(correction, keys)
    out = head.join(late, _same(head, late, keys), "left")
    positive = F.greatest(F.lit(0.0), -F.col("top.d"))
    enhanced = F.when(positive > 0, positive / F.nullif(cd, F.lit(0.0))).otherwise(0.0)
    ens = F.least(F.lit(1.0), enhanced + F.greatest(F.lit(0.0), F.coalesce("correction", F.lit(0.0))))
    distance = -F.col("ks.d")
    chance = F.lit(None).cast("double") if shared else prob.ks_p_value(distance, F.col("n_control"), F.col("n"))
    return out.select(
        *keys, "n_control", "n", distance.alias("ks_distance"), F.col("ks.at").alias("ks_at"), F.col("ks.signed").alias("ks_signed"), chance.alias("ks_p_value"),
        (F.col("tied") > 0).alias("has_ties"), (100 * positive).alias("overton_percent"), F.col("top.v").alias("positive_at"), (100 * F.least(F.lit(1.0), enhanced)).alias("enhanced_percent"), (100 * ens).alias("ens_percent"),
    )


def shared_histograms(counts: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """``keys, bin, low, high, c, t``: counts of both on edges that span both, every bin; one value alone is padded."""
    ends = counts.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    pad = F.greatest(F.abs("__lo") * 1e-6, F.lit(1.0))
    single = F.col("__lo") == F.col("__hi")
    ends = ends.select(*keys, F.when(single, F.col("__lo") - pad).otherwise(F.col("__lo")).alias("__lo"), F.when(single, F.col("__hi") + pad).otherwise(F.col("__hi")).alias("__hi"))
    named = _keyed(ends, keys)
    rows = counts.join(named, _same(counts, named, keys))
    place = F.least(F.floor((F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1)).cast("int")
    got = rows.groupBy(*keys, place.alias("bin")).agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    grid = ends.withColumn("__bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    late = _keyed(got, keys)
    width = (F.col("__hi") - F.col("__lo")) / bins
    told = grid.join(late, _same(grid, late, keys) & (F.col("__bin") == F.col("bin")), "left")
    return told.select(*keys, F.col("__bin").alias("bin"), (F.col("__lo") + width * F.col("__bin")).alias("low"), (F.col("__lo") + width * (F.col("__bin") + 1)).alias("high"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("t", F.lit(0)).alias("t"))


def histogram_excess(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, excess_percent``: what the target has over the control scaled to the target's peak."""
    peaks = histograms.groupBy(*keys).agg(F.max("c").alias("__pc"), F.max("t").alias("__pt"), F.sum("t").alias("__n"))
    named = _keyed(peaks, keys)
    rows = histograms.join(named, _same(histograms, named, keys))
    over = F.greatest(F.lit(0.0), F.col("t") - F.col("c") * F.col("__pt") / F.nullif(F.col("__pc"), F.lit(0)))
    return rows.groupBy(*keys).agg((100.0 * F.sum(over) / F.nullif(F.max("__n"), F.lit(0))).alias("excess_percent"))


def display_curves(histograms: DataFrame, keys: list[str], sigma: float = 0.0) -> DataFrame:
    """Adds fractions, cumulative fractions, their difference and, with ``sigma`` bins, Gaussian smoothed fractions, the ends repeated."""
    w, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin")  # the bins of one comparison
    out = histograms
    for k in "ct":
        share = F.col(k) / F.nullif(F.sum(k).over(w), F.lit(0))
        out = out.withColumns({f"{k}_share": share, f"{k}_cdf": F.sum(k).over(upto) / F.nullif(F.sum(k).over(w), F.lit(0))})
    out = out.withColumn("difference", F.col("t_share") - F.col("c_share"))
    if sigma > 0:
        reach = max(1, math.ceil(4 * sigma))
        weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
        for k in "ct":
            ends = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            first, last = F.first(f"{k}_share").over(ends), F.last(f"{k}_share").over(ends)
            near = [F.coalesce(F.lag(f"{k}_share", -d).over(upto), first) if d < 0 else F.coalesce(F.lead(f"{k}_share", d).over(upto), last) if d else F.col(f"{k}_share") for d in range(-reach, reach + 1)]
            out = out.withColumn(f"{k}_smooth", reduce(lambda a, b: a + b, [n * (x / sum(weights)) for n, x in zip(near, weights)]))
    return out


def probability_cuts(counts: DataFrame, keys: list[str], bins: int = 64) -> DataFrame:
    """``keys, cuts``: cuts of the control into parts of equal counts; equal values are never parted.

    A cut at a position lies between the value that ends there and the one that begins there.
    """
    told = with_sums_below(counts.where("c > 0"), keys, "v", ["c"])
    positions = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.floor(k * F.col("c_total") / bins)))
    told = told.withColumn("__at", positions)
    # positions follow in whole numbers, so an end meets a beginning
    begins = told.where(F.array_contains("__at", F.col("c_below")) & (F.col("c_below") > 0)).select(*keys, F.col("c_below").alias("__p"), F.col("v").alias("__right"))
    ends = told.where(F.array_contains("__at", F.col("c_below") + F.col("c"))).select(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("c_below") + F.col("c")).alias("__q"), F.col("v").alias("__left"))
    both = begins.join(ends, _same(begins, ends, keys) & (F.col("__p") == F.col("__q")))
    middle = F.col("__left") / 2 + F.col("__right") / 2
    cut = F.when((middle > F.col("__left")) & (middle < F.col("__right")), middle).otherwise(F.col("__right"))
    found = both.groupBy(*keys).agg(F.array_sort(F.collect_set(cut)).alias("cuts"))  # ``bins`` at most
    every = counts.select(*keys).distinct()
    late = _keyed(found, keys)
    return every.join(late, _same(every, late, keys), "left").select(*keys, F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"))


def _score(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Chi squared and T(X) of bins ``keys, c, t`` that hold both populations whole."""
    w = Window.partitionBy(*keys)  # bins of one comparison
    shares = parts.withColumns({"__a": F.col("c") / F.nullif(F.sum("c").over(w), F.lit(0)), "__b": F.col("t") / F.nullif(F.sum("t").over(w), F.lit(0))})
    term = F.when(F.col("__a") + F.col("__b") > 0, F.pow(F.col("__a") - F.col("__b"), F.lit(2.0)) / F.nullif(F.col("__a") + F.col("__b"), F.lit(0.0)))
    got = shares.groupBy(*keys).agg(F.count("*").alias("bins"), F.sum(term).alias("chi_squared"), F.least(F.sum("c"), F.sum("t")).alias("events"), F.min("c").alias("least_control"))
    usable = (F.col("bins") >= 2) & (F.col("events") > 0)
    base, sd = F.col("bins") / F.nullif(F.col("events"), F.lit(0)), F.sqrt("bins") / F.nullif(F.col("events"), F.lit(0))
    return got.select(*keys, "bins", "least_control", F.when(usable, F.col("chi_squared")).alias("chi_squared"), F.when(usable, F.greatest(F.lit(0.0), (F.col("chi_squared") - base) / sd)).alias("tx"), F.when(usable, F.greatest(F.lit(0.0), (2 - base) / sd)).alias("most_tx"))


def probability_binning(counts: DataFrame, keys: list[str], bins: int = 64) -> DataFrame:
    """``keys, bins, least_control, chi_squared, tx, most_tx`` over bins of equal control counts."""
    cuts = _keyed(probability_cuts(counts, keys, bins), keys)
    rows = counts.join(cuts, _same(counts, cuts, keys))
    placed = rows.groupBy(*keys, F.size(F.filter("cuts", lambda x: x <= F.col("v"))).alias("__bin")).agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.max(F.size("cuts")).alias("__k"))
    sizes = cuts.select(*[F.col(f"__{k}").alias(k) for k in keys], F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("__bin"))
    late = _keyed(placed, [*keys, "__bin"])
    every = sizes.join(late, _same(sizes, late, [*keys, "__bin"]), "left").select(*keys, F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("t", F.lit(0)).alias("t"))
    return _score(every, keys)


def probability_tree(control: DataFrame, axes: list[str], bins: int = 64, minimum_events: int = 1) -> list[dict]:
    """Splits of the finite rows of a control: the axis of greatest variance at its median, equal values together, level by level.

    A node is ``{"axis", "cut", "left", "right"}`` or ``{"leaf"}``; there are ``bins`` leaves at most. Each level is some
    jobs over all rows; a few numbers of each node reach the driver.
    """
    ok = reduce(lambda a, b: a & b, [finite(F.col(a)).isNotNull() for a in axes])
    rows = materialize(control.where(ok).select(*[F.col(a).cast("double").alias(a) for a in axes], F.lit(0).alias("node")), "tree")
    nodes: list[dict] = [{}]
    live = [0]
    for _ in range(int(math.log2(bins))):
        stats = {r.node: r for r in rows.where(F.col("node").isin(live)).groupBy("node").agg(F.count("*").alias("n"), *[x for a in axes for x in (F.var_pop(a).alias(f"v_{a}"), F.min(a).alias(f"l_{a}"), F.max(a).alias(f"h_{a}"))]).collect()}
        order = {k: sorted((a for a in axes if stats[k][f"l_{a}"] < stats[k][f"h_{a}"]), key=lambda a: (-stats[k][f"v_{a}"], axes.index(a))) for k in live if k in stats and stats[k].n >= 2 * minimum_events}
        made: dict[int, tuple[str, float]] = {}
        tries = 0
        while order and tries < len(axes):
            chosen = {k: o[tries] for k, o in order.items() if len(o) > tries and k not in made}
            if not chosen:
                break
            value = reduce(lambda e, kv: e.when(F.col("node") == kv[0], F.col(kv[1])), chosen.items(), F.when(F.lit(False), F.lit(None).cast("double")))
            counted = rows.where(F.col("node").isin(list(chosen))).select("node", value.alias("v"), F.lit(1).alias("c"))
            ranked = with_sums_below(counted, ["node"], "v", ["c"])
            middle = F.floor(F.col("c_total") / 2)
            upto = F.col("c_below") + F.col("c")
            near = ranked.where((F.col("c_below") <= middle) & (upto >= middle)).select("node", "v", "c_below", upto.alias("upto"), "c_total")
            after = ranked.select("node", F.col("v").alias("right"), F.col("c_below").alias("upto"))
            for_node: dict[int, list] = {}
            held = near.join(after, ["node", "upto"], "left").collect()
            for r in held:
                for_node.setdefault(r.node, []).append(r)
            before = {(r.node, r.at): r.left for r in ranked.join(near.select("node", F.col("c_below").alias("at")).distinct(), "node").where(upto == F.col("at")).select("node", "at", F.col("v").alias("left")).collect()}
            for k, found in for_node.items():
                n = found[0].c_total
                places = {}
                for r in found:
                    if r.right is not None and r.upto < n:
                        places[r.upto] = (r.v, r.right)
                    if r.c_below > 0 and (k, r.c_below) in before:
                        places[r.c_below] = (before[k, r.c_below], r.v)
                fits = [p for p in sorted(places, key=lambda p: (abs(p - n // 2), p)) if minimum_events <= p <= n - minimum_events]
                if fits:
                    a, b = places[fits[0]]
                    m = a / 2 + b / 2
                    made[k] = (chosen[k], m if a < m < b else b)
            tries += 1
        if not made:
            break
        live, step = [], F.when(F.lit(False), F.lit(0))
        for k, (axis, cut) in made.items():
            left, right = len(nodes), len(nodes) + 1
            nodes += [{}, {}]
            nodes[k] = {"axis": axis, "cut": cut, "left": left, "right": right}
            step = step.when((F.col("node") == k) & (F.col(axis) < cut), left).when(F.col("node") == k, right)
            live += [left, right]
        rows = materialize(rows.withColumn("node", step.otherwise(F.col("node")).cast("int")), "tree")
    leaf = 0
    for n in nodes:
        if "axis" not in n:
            n["leaf"] = leaf
            leaf += 1
    return nodes


def tree_leaf(nodes: list[dict]) -> Column:
    """The leaf of a row; NULL if one of the axes is not finite."""
    axes = sorted({n["axis"] for n in nodes if "axis" in n})

    def of(k: int) -> Column:
        n = nodes[k]
        return F.lit(n["leaf"]) if "leaf" in n else F.when(F.col(n["axis"]) < n["cut"], of(n["left"])).otherwise(of(n["right"]))

    ok = reduce(lambda a, b: a & b, [finite(F.col(a)).isNotNull() for a in axes], F.lit(True))
    return F.when(ok, of(0))


def tree_comparison(control: DataFrame, targets: DataFrame, population: str, axes: list[str], bins: int = 64, minimum_events: int = 1) -> DataFrame:
    """Chi squared and T(X) of every target over the leaves of the control's tree."""
    nodes = probability_tree(control, axes, bins, minimum_events)
    leaf = tree_leaf(nodes).alias("leaf")
    ok = reduce(lambda a, b: a & b, [finite(F.col(a)).isNotNull() for a in axes])
    held = control.where(ok).groupBy(leaf).agg(F.count("*").alias("c"))
    got = targets.where(ok).groupBy(F.col(population).alias("population"), leaf).agg(F.count("*").alias("t"))
    grid = got.select("population").distinct().crossJoin(held)  # leaves of one tree
    return _score(grid.join(got, ["population", "leaf"], "left").select("population", "c", F.coalesce("t", F.lit(0)).alias("t")), ["population"])


def average_ranks(rows: DataFrame, keys: list[str], value: str, weights: list[str]) -> DataFrame:
    """A row for each distinct value with its average ``rank`` and the tied count ``tie``; ``weights`` are summed."""
    total = reduce(lambda a, b: a + b, [F.col(w) for w in weights])
    told = with_sums_below(rows.withColumn("tie", total), keys, value, ["tie", *weights])
    return told.withColumn("rank", F.col("tie_below") + (F.col("tie") + 1) / 2)


METHODS = ("welch", "mann_whitney", "paired_t", "wilcoxon")


def compare_groups(rows: DataFrame, measure: str, group: str, value: Column, a: str, b: str, method: str = "welch", pair: str | None = None, level: float = 0.95) -> DataFrame:
    """One test of two groups for each measure, over the finite values, with an ``issue`` where it is undefined.

    ``measure, n_a, n_b, excluded_a, excluded_b, pairs, mean_a, mean_b, mean_difference, median_difference, statistic, p_value, ci_low, ci_high, issue``.
    Paired methods join the groups by ``pair``; a pair that is there twice in a group is an issue.
    """
    if method not in METHODS:
        raise ValueError(f"no test {method!r}")
    paired = method in ("paired_t", "wilcoxon")
    long = rows.where(F.col(group).isin(a, b)).select(F.col(measure).alias("measure"), (F.col(group) == a).alias("__a"), finite(value).alias("v"), *([F.col(pair).alias("__pair")] if paired else []))
    size = long.groupBy("measure").agg(F.count_if("__a").alias("rows_a"), F.count_if(~F.col("__a")).alias("rows_b"))
    if paired:
        keyed = long.where("__pair IS NOT NULL")
        cells = keyed.groupBy("measure", "__pair").agg(F.count_if("__a").alias("ca"), F.count_if(~F.col("__a")).alias("cb"), F.max(F.when(F.col("__a"), F.col("v"))).alias("x"), F.max(F.when(~F.col("__a"), F.col("v"))).alias("y"))
        cells = materialize(cells, "pairs")
        doubled = cells.groupBy("measure").agg(F.max((F.col("ca") > 1) | (F.col("cb") > 1)).alias("doubled"))
        both = cells.where("x IS NOT NULL AND y IS NOT NULL").withColumn("d", F.col("x") - F.col("y"))
        used = both.select("measure", F.explode(F.array(F.struct(F.lit(True).alias("__a"), F.col("x").alias("v")), F.struct(F.lit(False).alias("__a"), F.col("y").alias("v")))).alias("e")).select("measure", "e.*")
    else:
        used = long.where("v IS NOT NULL")
    x, y = F.when(F.col("__a"), F.col("v")), F.when(~F.col("__a"), F.col("v"))
    m = used.groupBy("measure").agg(F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"))
    med = percentiles(used, ["measure", "__a"], F.col("v"), [0.5]).select("measure", "__a", F.col("q")[0].alias("q"))
    med = med.groupBy("measure").agg((F.max(F.when(F.col("__a"), F.col("q"))) - F.max(F.when(~F.col("__a"), F.col("q")))).alias("median_difference"))
    out = size.join(m, "measure", "left").join(med, "measure", "left")
    na, nb = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    null = F.lit(None).cast("double")
    if method == "welch":
        sa, sb = F.col("va") / na, F.col("vb") / nb
        error = F.sqrt(sa + sb)
        df = F.pow(sa + sb, F.lit(2.0)) / F.nullif(F.pow(sa, F.lit(2.0)) / (na - 1) + F.pow(sb, F.lit(2.0)) / (nb - 1), F.lit(0.0))
        out = out.withColumns({"statistic": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.nullif(error, F.lit(0.0))), "__df": F.when((na > 1) & (nb > 1), df), "__error": error})
    elif method == "mann_whitney":
        ranked = average_ranks(used.select("measure", "v", F.col("__a").cast("long").alias("ia"), (~F.col("__a")).cast("long").alias("ib")), ["measure"], "v", ["ia", "ib"])
        u = ranked.groupBy("measure").agg(F.sum(F.col("rank") * F.col("ia")).alias("__sum"), F.sum(F.pow(F.col("tie").cast("double"), F.lit(3.0)) - F.col("tie")).alias("__ties"))
        out = out.join(u, "measure", "left").withColumn("statistic", F.col("__sum") - na * (na + 1) / 2)
    elif method == "paired_t":
        d = both.groupBy("measure").agg(F.count("d").alias("__n"), F.avg("d").alias("__mean"), F.stddev_samp("d").alias("__sd"))
        out = out.join(d, "measure", "left")
        error = F.col("__sd") / F.sqrt("__n")
        out = out.withColumns({"statistic": F.try_divide(F.col("__mean"), F.nullif(error, F.lit(0.0))), "__df": (F.col("__n") - 1).cast("double"), "__error": error})
    else:
        moved = both.where("d <> 0").select("measure", F.abs("d").alias("v"), (F.col("d") > 0).cast("long").alias("up"), (F.col("d") < 0).cast("long").alias("down"))
        ranked = average_ranks(moved, ["measure"], "v", ["up", "down"])
        w = ranked.groupBy("measure").agg(F.sum(F.col("rank") * F.col("up")).alias("__plus"), F.sum(F.col("rank") * F.col("down")).alias("__minus"), F.sum("tie").alias("__n"), F.sum(F.pow(F.col("tie").cast("double"), F.lit(3.0)) - F.col("tie")).alias("__ties"))
        zero = both.groupBy("measure").agg(F.count_if(F.col("d") == 0).alias("__zeros"))
        out = out.join(w, "measure", "left").join(zero, "measure", "left").fillna(0, ["__plus", "__minus", "__n", "__ties", "__zeros"])
        out = out.withColumn("statistic", F.least("__plus", "__minus").cast("double"))
    if paired:
        out = out.join(doubled, "measure", "left")
        issue = F.when(F.coalesce("doubled", F.lit(False)), "pairs are there twice in a group")
    else:
        issue = F.when(F.lit(False), "")
    issue = issue.when((na < 2) | (nb < 2), "fewer than two finite values in a group")
    out = out.withColumn("issue", issue)
    chance = {
        "welch": lambda: prob.t_p_value(F.col("statistic"), F.col("__df")),
        "paired_t": lambda: prob.t_p_value(F.col("statistic"), F.col("__df")),
        "mann_whitney": lambda: prob.mann_whitney_p_value(F.col("statistic"), na, nb, F.col("__ties")),
        "wilcoxon": lambda: prob.wilcoxon_p_value(F.col("__plus").cast("double"), F.col("__minus").cast("double"), F.col("__n"), F.col("__zeros"), F.col("__ties").cast("double")),
    }[method]()
    out = out.withColumn("p_value", chance)
    out = out.withColumn("issue", F.when(F.col("issue").isNull() & (F.col("statistic").isNull() | F.col("p_value").isNull()), "the test is undefined for these values").otherwise(F.col("issue")))
    good = F.col("issue").isNull()
    ends = {"ci_low": null, "ci_high": null}
    if method in ("welch", "paired_t"):
        out = out.withColumn("__reach", prob.t_bound(level, F.col("__df")) * F.col("__error"))
        gap = F.col("mean_a") - F.col("mean_b")
        ends = {"ci_low": gap - F.col("__reach"), "ci_high": gap + F.col("__reach")}
    kept = lambda c: F.when(good, c)
    return out.select(
        "measure", na.alias("n_a"), nb.alias("n_b"), (F.col("rows_a") - na).alias("excluded_a"), (F.col("rows_b") - nb).alias("excluded_b"), (na if paired else F.lit(0)).cast("long").alias("pairs"),
        kept(F.col("mean_a")).alias("mean_a"), kept(F.col("mean_b")).alias("mean_b"), kept(F.col("mean_a") - F.col("mean_b")).alias("mean_difference"), kept(F.col("median_difference")).alias("median_difference"),
        kept(F.col("statistic")).alias("statistic"), kept(F.col("p_value")).alias("p_value"), kept(ends["ci_low"]).alias("ci_low"), kept(ends["ci_high"]).alias("ci_high"), "issue",
    )


def linear_fits(rows: DataFrame, keys: list[str], x: Column, y: Column, intercept: bool = True) -> DataFrame:
    """``keys, n, slope, intercept, r_squared, f_statistic, p_value`` of the finite pairs; NULL below 3 pairs or without variation of x."""
    both = rows.select(*keys, finite(x).alias("x"), finite(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    if intercept:
        m = both.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("xx"), F.regr_sxy("y", "x").alias("xy"), F.regr_syy("y", "x").alias("yy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    else:
        m = both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    ok = (F.col("n") >= 3) & (F.col("xx") > 0)
    slope = F.when(ok, F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0)))
    fitted = slope * F.col("xy")
    rest = F.greatest(F.lit(0.0), F.col("yy") - fitted)
    df = F.col("n") - (2 if intercept else 1)
    f = F.when(rest > 0, fitted / F.nullif(rest, F.lit(0.0)) * df).when(fitted > 0, F.lit(float(np.finfo(float).max))).otherwise(0.0)
    out = m.select(*keys, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.when(ok, F.when(F.col("yy") > 0, fitted / F.nullif(F.col("yy"), F.lit(0.0))).otherwise(0.0)).alias("r_squared"), F.when(ok, f).alias("f_statistic"), df.cast("double").alias("__df"))
    return out.withColumn("p_value", prob.f_p_value(F.col("f_statistic"), F.lit(1.0), F.col("__df"))).drop("__df")


def fit_diagnostics(bins: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """``keys, rmsd, pearson, deviance`` of counts and their predictions."""
    o, p = F.col(observed), F.col(predicted)
    safe = F.greatest(p, F.lit(1e-12))
    return bins.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(o - p, F.lit(2.0)))).alias("rmsd"),
        F.sum(F.pow(o - p, F.lit(2.0)) / safe).alias("pearson"),
        (2 * F.sum(F.when(o > 0, o * F.log(F.nullif(o, F.lit(0)) / safe)).otherwise(0.0) - (o - p))).alias("deviance"),
    )
