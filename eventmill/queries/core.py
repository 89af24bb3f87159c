"""Queries of gates, scales, statistics, time and pooling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventmill.functions.columns import share_of_axis, compensate, finite, ratio, scale, tempered_root, spectral_unmix
from eventmill.functions.formulas import compile_formula
from eventmill.operators import acquisition as A, gates as G, populations as P
from eventmill.operators.tables import safe_text
from eventmill.queries.registry import registered, reset_seconds, rounded as _r, table as _table

_EVENTS_T = "epoch_us(ts) / 1e6"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``t`` in seconds and a value that is NaN for every 97th id."""
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "x": v})


_E = f"(SELECT *, {_EVENTS_T} AS t, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE value END AS x FROM events)"


@registered("""
WITH m AS (SELECT l_suppkey AS sample, l_quantity >= 10 AND l_quantity < 40 AS a,
  l_quantity >= 10 AND l_quantity < 40 AND l_extendedprice >= 10000 AND l_extendedprice < 50000 AND l_discount >= 0.02 AND l_discount < 0.07 AS b FROM lineitem),
c AS (SELECT sample, count(*) AS total, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE a AND NOT b) AS nn FROM m GROUP BY 1)
SELECT sample, 'A' AS population, na AS n, round(100.0 * na / total, 6) AS pct_parent, round(100.0 * na / total, 6) AS pct_total FROM c
UNION ALL SELECT sample, 'B', nb, round(100.0 * nb / nullif(na, 0), 6), round(100.0 * nb / total, 6) FROM c
UNION ALL SELECT sample, 'not B', nn, round(100.0 * nn / nullif(na, 0), 6), round(100.0 * nn / total, 6) FROM c""")
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    b = G.box([(F.col("l_extendedprice"), 10000.0, 50000.0), (F.col("l_discount"), 0.02, 0.07)])
    tree = [G.Gate("A", G.interval(F.col("l_quantity"), 10.0, 40.0)), G.Gate("B", b, "A"), G.Gate("not B", b, "A", complement=True)]
    return P.gate_counts(rows, "l_suppkey", tree).withColumns({"pct_parent": _r("pct_parent"), "pct_total": _r("pct_total")})


@registered("""
WITH m AS (SELECT l_suppkey AS sample, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS d FROM lineitem)
SELECT sample,
 count(*) FILTER (WHERE (x - 5) * (10 - 10) - (y - 10) * (45 - 5) <= 0 AND (x - 45) * (80 - 10) - (y - 10) * (25 - 45) <= 0 AND (x - 25) * (10 - 80) - (y - 80) * (5 - 25) <= 0) AS in_polygon,
 count(*) FILTER (WHERE (x - 5) * (10 - 10) - (y - 10) * (45 - 5) <= 0 AND (x - 45) * (80 - 10) - (y - 10) * (25 - 45) <= 0 AND (x - 25) * (10 - 80) - (y - 80) * (5 - 25) <= 0
   AND NOT (x BETWEEN 20 AND 30 AND y BETWEEN 20 AND 40)) AS in_ring,
 count(*) FILTER (WHERE pow(((x - 25) * cos(0.3) + (y - 35) * sin(0.3)) / 15, 2) + pow(((y - 35) * cos(0.3) - (x - 25) * sin(0.3)) / 20, 2) <= 1) AS in_ellipse,
 count(*) FILTER (WHERE (x - 25) * (x - 25) / 100 + (y - 35) * (y - 35) / 400 + (d - 0.05) * (d - 0.05) / 0.0009 <= 2) AS in_ellipsoid,
 count(*) FILTER (WHERE x < 25 AND y >= 35) AS q1, count(*) FILTER (WHERE x >= 25 AND y >= 35) AS q2,
 count(*) FILTER (WHERE x >= 25 AND y < 35) AS q3, count(*) FILTER (WHERE x < 25 AND y < 35) AS q4
FROM m GROUP BY 1""")
def gate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("d"))
    x, y, d = F.col("x"), F.col("y"), F.col("d")
    outer = [(5.0, 10.0), (45.0, 10.0), (25.0, 80.0)]
    tests = {
        "in_polygon": G.polygon(x, y, outer),
        "in_ring": G.polygon_with_holes(x, y, outer, [[(20.0, 20.0), (30.0, 20.0), (30.0, 40.0), (20.0, 40.0)]]),
        "in_ellipse": G.ellipse(x, y, (25.0, 35.0), (15.0, 20.0), 0.3),
        "in_ellipsoid": G.ellipsoid([x, y, d], [25.0, 35.0, 0.05], np.diag([100.0, 400.0, 0.0009]), 2.0),
    } | {f"q{k}": G.quadrant(x, y, (25.0, 35.0), k) for k in (1, 2, 3, 4)}
    return rows.groupBy("sample").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@registered(f"""
WITH m AS (SELECT event_type AS sample, coalesce(isfinite(x) AND x >= 50 AND x < 300, false) AS a, coalesce(isfinite(x) AND x >= 200, false) AS b FROM {_E})
SELECT sample, p AS population, n, round(100.0 * n / total, 6) AS pct_parent, round(100.0 * n / total, 6) AS pct_total FROM (
 SELECT sample, count(*) AS total, unnest(['a', 'b', 'and', 'or', 'xor', 'not a']) AS p,
  unnest([count(*) FILTER (WHERE a), count(*) FILTER (WHERE b), count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE a OR b), count(*) FILTER (WHERE a <> b), count(*) FILTER (WHERE NOT a)]) AS n
 FROM m GROUP BY sample)""")
def boolean_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    tree = [G.Gate("a", G.interval(x, 50.0, 300.0)), G.Gate("b", G.interval(x, 200.0)), *[G.Gate(o, operands=("a", "b"), op=o) for o in ("and", "or", "xor")], G.Gate("not a", operands=("a",), op="not")]
    return P.gate_counts(_events(spark, sf_dir), "event_type", tree).withColumns({"pct_parent": _r("pct_parent"), "pct_total": _r("pct_total")})


@registered("""
WITH m AS (SELECT l_suppkey AS sample, l_extendedprice - 20000 AS v FROM lineitem)
SELECT sample, round(avg(v), 4) AS linear, round(avg(CASE WHEN v > 0 THEN log10(v) END), 6) AS log, round(avg(asinh(v / 150)), 6) AS asinh,
 round(avg((v + 100) / (50000 + 100.0)), 6) AS gml_linear, round(avg(CASE WHEN v > 0 THEN log10(v / 50000) / 4.5 + 1 END), 6) AS gml_log,
 round(avg((asinh(v * sinh(4.5 * ln(10)) / 50000) + 1.0 * ln(10)) / (5.5 * ln(10))), 6) AS gml_asinh,
 round(avg((log10(greatest(v, 10)) - 1) / 4), 6) AS wsp_log, round(avg(least(greatest(asinh(v / 150), -2), 5)), 6) AS clamped, round(avg(sinh(asinh(v / 150)) * 150), 4) AS back
FROM m GROUP BY 1""")
def channel_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice") - 20000.0
    each = {
        "linear": (scale(v, "linear"), 4),
        "log": (scale(v, "log"), 6),
        "asinh": (scale(v, "asinh"), 6),
        "gml_linear": (scale(v, "gml_linear", t=50000.0, a=100.0), 6),
        "gml_log": (scale(v, "gml_log", t=50000.0, m=4.5), 6),
        "gml_asinh": (scale(v, "gml_asinh", t=50000.0, m=4.5, a=1.0), 6),
        "wsp_log": (scale(v, "wsp_log", offset=10.0, m=4.0), 6),
        "clamped": (scale(v, "asinh", low=-2.0, high=5.0), 6),
        "back": (scale(scale(v, "asinh"), "asinh", inverse=True), 4),
    }
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(*[_r(F.avg(finite(c)), d).alias(n) for n, (c, d) in each.items()])


@registered("""
SELECT l_suppkey AS sample, round(avg((l_quantity - 0.1 * l_discount * 100) / 0.98), 6) AS c0, round(avg((l_discount * 100 - 0.2 * l_quantity) / 0.98), 6) AS c1,
 round(avg((1.25 * l_quantity - 0.5 * l_tax * 100) ), 6) AS u0
FROM (SELECT *, 0 AS k FROM lineitem) GROUP BY 1""")
def unmixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compensate([F.col("l_quantity"), F.col("l_discount") * 100], np.array([[1.0, 0.2], [0.1, 1.0]]))
    u = spectral_unmix([F.col("l_quantity"), F.col("l_tax") * 100], np.linalg.inv(np.array([[1.25, 0.0], [-0.5, 1.0]])))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(_r(F.avg(c[0])).alias("c0"), _r(F.avg(c[1])).alias("c1"), _r(F.avg(u[0])).alias("u0"))


@registered("""
WITH m AS (SELECT l_suppkey AS sample, l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem)
SELECT sample, round(avg(CASE WHEN q > 1 THEN ln(q - 1) END), 6) AS shifted_log, round(avg(CASE WHEN d <> 0 THEN q / (d * 100) END), 6) AS per_discount,
 round(avg(least(greatest(p, 5000), 40000) / 1000 + abs(q - 25) ** 2), 6) AS clipped,
 round(avg(CASE WHEN 10 < q AND q <= 30 THEN sqrt(p) ELSE 0 END), 6) AS chosen, round(avg(CASE WHEN d <> 0.05 THEN 2 * (q - 1) / ((d - 0.05) * 100) END), 4) AS ratio,
 round(avg((p - 30000) / (sqrt(abs(p - 30000) + 1) + 1)), 6) AS root, round(avg((q - 1) / 49), 6) AS fraction
FROM m GROUP BY 1""")
def event_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {"q": F.col("l_quantity"), "p": F.col("l_extendedprice"), "d": F.col("l_discount")}
    f = {"shifted_log": "log(q - 1)", "per_discount": "q / (d * 100)", "clipped": "clip(ch('p'), 5000, 40000) / 1000 + abs(q - 25) ** 2", "chosen": "ifelse(10 < q <= 30, sqrt(p), 0)"}
    more = {"root": tempered_root(F.col("l_extendedprice") - 30000.0), "fraction": share_of_axis(F.col("l_quantity"), 1.0, 50.0)}
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"))
    return rows.agg(
        *[_r(F.avg(finite(compile_formula(t, c)))).alias(n) for n, t in f.items()],
        _r(F.avg(finite(ratio(F.col("l_quantity"), F.col("l_discount") * 100, 2.0, 1.0, 5.0))), 4).alias("ratio"),
        *[_r(F.avg(v)).alias(n) for n, v in more.items()],
    )


@registered("""
WITH m AS (SELECT l_suppkey AS sample, 2.0 * (l_quantity - 1) AS a, l_discount AS d FROM lineitem),
r AS (SELECT *, CASE WHEN d <> 0 THEN least(greatest(a / d, 0), 500) WHEN a > 0 THEN 500 WHEN a < 0 THEN 0 END AS v FROM m)
SELECT sample, count(*) FILTER (WHERE d = 0) AS zero_denominators, count(v) AS n, count(*) FILTER (WHERE v = 500) AS at_bound, round(avg(v), 6) AS mean FROM r GROUP BY 1""")
def bounded_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_discount").alias("d"), finite(ratio(F.col("l_quantity"), F.col("l_discount"), 2.0, 1.0, low=0.0, high=500.0)).alias("v"))
    return rows.groupBy("sample").agg(F.count_if(F.col("d") == 0).alias("zero_denominators"), F.count("v").alias("n"), F.count_if(F.col("v") == 500).alias("at_bound"), _r(F.avg("v")).alias("mean"))


@registered(f"""
WITH m AS (SELECT event_type AS sample, CASE WHEN isfinite(x) THEN x END AS v FROM {_E}),
s AS (SELECT sample, count(*) AS n, count(v) AS n_finite, avg(v) AS mean, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, stddev_samp(v) AS sd, min(v) AS least, max(v) AS most, CASE WHEN min(v) > 0 THEN exp(avg(CASE WHEN v > 0 THEN ln(v) END)) END AS gm FROM m GROUP BY 1),
d AS (SELECT sample, quantile_cont(abs(v - med), 0.5) AS mad FROM m JOIN s USING (sample) GROUP BY 1)
SELECT sample, n, n_finite, round(mean, 6) AS mean, round(med, 6) AS median, round(p5, 6) AS p5, round(p95, 6) AS p95, round(sd, 6) AS sd, round(least, 6) AS least, round(most, 6) AS most,
 round(100 * sd / abs(mean), 6) AS cv, round(mad, 6) AS mad, round(148.26 * mad / abs(med), 6) AS robust_cv, round(gm, 6) AS geometric_mean FROM s JOIN d USING (sample)""")
def population_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the finite values of each sample; the geometric mean is defined only where all of them are positive."""
    out = P.summary(_events(spark, sf_dir).withColumn("sample", F.col("event_type")), ["sample"], F.col("x"))
    return out.select(*[_r(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@registered("""
SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f_n, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS f_mean, round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'F'), 4) AS f_median,
 count(*) FILTER (WHERE o_orderstatus = 'O') AS o_n, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS o_mean, round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'O'), 4) AS o_median
FROM orders GROUP BY 1""")
def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = finite(F.col("o_totalprice"))
    wide = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O"]).agg(F.count(v).alias("n"), _r(F.avg(v), 4).alias("mean"), _r(F.percentile(v, 0.5), 4).alias("median"))
    return wide.select("priority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) if c.endswith("_n") else F.col(c).alias(c.lower()) for c in wide.columns[1:]])


@registered("""
WITH a AS (SELECT DISTINCT o_orderpriority AS priority FROM orders), b AS (SELECT DISTINCT o_orderstatus AS status FROM orders)
SELECT priority, status, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median
FROM a CROSS JOIN b LEFT JOIN orders ON o_orderpriority IS NOT DISTINCT FROM priority AND o_orderstatus IS NOT DISTINCT FROM status GROUP BY 1, 2""")
def pivot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return P.pivot(rows, "priority", "status", F.col("o_totalprice")).withColumns({"mean": _r("mean", 4), "median": _r("median", 4)})


@registered(f"""
WITH h AS (SELECT event_type AS sample, least(floor(x / 12.5), 39)::INT AS bin, count(*) AS n FROM {_E} WHERE isfinite(x) AND x BETWEEN 0 AND 500 GROUP BY 1, 2)
SELECT sample, bin, n, round(100.0 * n / sum(n) OVER (PARTITION BY sample), 6) AS percent, round(n / sum(n) OVER (PARTITION BY sample) / 12.5, 8) AS area,
 round(n / max(n) OVER (PARTITION BY sample), 6) AS peak, CAST(sum(n) OVER (PARTITION BY sample ORDER BY bin) AS BIGINT) AS below FROM h""")
def normalized_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.histogram(_events(spark, sf_dir), ["event_type"], F.col("x"), 0.0, 500.0, 40).withColumnRenamed("event_type", "sample")
    w = Window.partitionBy("sample")  # at most 40 bins a sample
    total = F.sum("n").over(w)
    return h.select("sample", "bin", "n", _r(100.0 * F.col("n") / total).alias("percent"), _r(F.col("n") / total / 12.5, 8).alias("area"), _r(F.col("n") / F.max("n").over(w)).alias("peak"), F.sum("n").over(w.orderBy("bin")).alias("below"))


@registered(f"""
WITH e AS (SELECT event_type AS sample, CASE WHEN isfinite(x) THEN x END AS v FROM {_E}),
s AS (SELECT sample, count(*) AS total, count(v) AS n_finite, count(*) FILTER (WHERE v < 0) AS below, count(*) FILTER (WHERE v > 500) AS above FROM e GROUP BY 1),
g AS (SELECT sample, bin, count(*) FILTER (WHERE v BETWEEN 0 AND 500 AND least(floor(v / 12.5), 39) = bin) AS n, count(*) FILTER (WHERE v <= (bin + 1) * 12.5) AS cdf_n FROM e, (SELECT CAST(unnest(range(40)) AS INT) AS bin) GROUP BY 1, 2)
SELECT sample, bin, n, round(100.0 * n / total, 6) AS percent, round(n / nullif(sum(n) OVER (PARTITION BY sample), 0) / 12.5, 8) AS area, round(n / nullif(max(n) OVER (PARTITION BY sample), 0), 6) AS peak,
 cdf_n, round(100.0 * cdf_n / nullif(n_finite, 0), 6) AS cdf_percent, total, below, above FROM g JOIN s USING (sample)""")
def population_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = P.population_histogram(_events(spark, sf_dir).withColumnRenamed("event_type", "sample"), "sample", F.col("x"), 0.0, 500.0, 40)
    w = Window.partitionBy("sample")  # 40 bins a sample
    zero, n = F.lit(0), F.col("n")
    return h.select("sample", "bin", "n", _r(100.0 * n / F.col("total")).alias("percent"), _r(n / F.nullif(F.sum("n").over(w), zero) / 12.5, 8).alias("area"), _r(n / F.nullif(F.max("n").over(w), zero)).alias("peak"), "cdf_n", _r(100.0 * F.col("cdf_n") / F.nullif(F.col("n_finite"), zero)).alias("cdf_percent"), "total", "below", "above")


@registered("""
WITH g AS (SELECT least(floor((l_quantity - 1) / 2.45), 19)::INT AS bx, least(floor(l_extendedprice / 6000), 19)::INT AS by_, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 120000 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS total FROM g),
t AS (SELECT c AS coverage, max(n) AS threshold FROM r, (SELECT unnest([0.1, 0.5, 0.9]) AS c) WHERE run >= c * total GROUP BY 1)
SELECT CAST(coverage AS DOUBLE) AS coverage, threshold, count(*) AS cells, CAST(sum(n) AS BIGINT) AS events FROM t JOIN g ON n >= threshold GROUP BY 1, 2""")
def density_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bx = F.least(F.floor((F.col("l_quantity") - 1.0) / 2.45), F.lit(19)).cast("int")
    by = F.least(F.floor(F.col("l_extendedprice") / 6000.0), F.lit(19)).cast("int")
    grid = _table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(1, 50) & F.col("l_extendedprice").between(0, 120000)).groupBy(bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"))
    levels = grid.groupBy("n").agg(F.count("*").alias("cells"), F.sum("n").alias("held"))  # ties together; the grid is bounded
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    run = levels.select("n", F.sum("held").over(w).alias("run"), F.sum("cells").over(w).alias("cells_run"), F.sum("held").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    cover = run.withColumn("coverage", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9))))).where(F.col("run") >= F.col("coverage") * F.col("total"))
    return cover.groupBy("coverage").agg(F.max_by(F.struct("n", "cells_run", "run"), "n").alias("r")).select("coverage", F.col("r.n").alias("threshold"), F.col("r.cells_run").alias("cells"), F.col("r.run").alias("events"))


@registered(f"""
WITH d AS (SELECT event_type AS sample, CASE WHEN t >= 0 AND lag(t) OVER w >= 0 THEN t - lag(t) OVER w END AS step FROM (SELECT *, {_EVENTS_T} - 1000000 * floor(event_id / 2500) AS t FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
k AS (SELECT sample, quantile_cont(step, 0.5) AS tick FROM d WHERE step > 0 GROUP BY 1)
SELECT sample, count(*) AS n, count(*) FILTER (WHERE step < 0) AS resets, count(*) FILTER (WHERE step = 0) AS repeats, round(max(tick), 4) AS tick, count(*) FILTER (WHERE step > 20 * tick) AS gaps, round(sum(step) FILTER (WHERE step > 0), 3) AS duration
FROM d JOIN k USING (sample) GROUP BY 1""")
def time_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each sample's clock between neighbours whose times are both valid, that is not negative."""
    rows = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    d = A.time_diagnostics(rows, "sample", reset_seconds())
    return d.select("sample", "n", "resets", "repeats", _r("tick", 4).alias("tick"), "gaps", _r("duration", 3).alias("duration"))


@registered(f"""
WITH e AS (SELECT event_type AS sample, event_id, {_EVENTS_T} - 1000000 * floor(event_id / 2500) AS t FROM events),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY sample ORDER BY event_id) AS step FROM e),
k AS (SELECT sample, quantile_cont(step, 0.5) AS tick FROM d WHERE step > 0 GROUP BY 1)
SELECT event_id, sample, round(t + coalesce(sum(CASE WHEN step < 0 THEN tick - step ELSE 0 END) OVER (PARTITION BY sample ORDER BY event_id), 0), 2) AS clock FROM d JOIN k USING (sample)""")
def clock_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    return A.unwrapped_clock(rows, "sample", reset_seconds()).select("event_id", "sample", _r("clock", 2).alias("clock"))


@registered(f"""
WITH p AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events),
u AS (SELECT value AS v, (event_type = a)::INT AS ia, (event_type = b)::INT AS ib FROM events, p WHERE event_type IN (a, b)),
g AS (SELECT v, sum(ia) AS ia, sum(ib) AS ib FROM u GROUP BY 1),
f AS (SELECT v, sum(ia) OVER (ORDER BY v) / (SELECT sum(ia) FROM g) AS fa, sum(ib) OVER (ORDER BY v) / (SELECT sum(ib) FROM g) AS fb FROM g)
SELECT round(max(abs(fa - fb)), 9) AS distance, CAST((SELECT sum(ia) FROM g) AS BIGINT) AS n_a, CAST((SELECT sum(ib) FROM g) AS BIGINT) AS n_b FROM f""")
def kolmogorov_smirnov(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    pair = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    u = e.join(F.broadcast(pair), (F.col("event_type") == F.col("a")) | (F.col("event_type") == F.col("b")))
    g = u.groupBy("value").agg(F.count_if(F.col("event_type") == F.col("a")).alias("ia"), F.count_if(F.col("event_type") == F.col("b")).alias("ib"))
    # prefix sums over coarse cells first, so that no window holds all values
    cell = F.floor(F.col("value"))
    cells = g.groupBy(cell.alias("cell")).agg(F.sum("ia").alias("ca"), F.sum("ib").alias("cb"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = cells.select("cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s{c}") for c in ("ca", "cb")], *[F.sum(c).over(all_rows).alias(f"t{c}") for c in ("ca", "cb")])
    inside = Window.partitionBy("cell").orderBy("value")
    f = g.withColumn("cell", cell).join(starts, "cell").select(((F.col("sca") + F.sum("ia").over(inside)) / F.col("tca")).alias("fa"), ((F.col("scb") + F.sum("ib").over(inside)) / F.col("tcb")).alias("fb"), "tca", "tcb")
    return f.agg(_r(F.max(F.abs(F.col("fa") - F.col("fb"))), 9).alias("distance"), F.max("tca").alias("n_a"), F.max("tcb").alias("n_b"))


@registered("""
WITH e AS (SELECT event_type AS population, value AS v FROM events WHERE isfinite(value)),
o AS (SELECT population, v, 1 AS ib, 0 AS ia FROM e WHERE population <> 'view' UNION ALL SELECT p.population, e.v, 0, 1 FROM (SELECT DISTINCT population FROM e WHERE population <> 'view') p, e WHERE e.population = 'view'),
g AS (SELECT population, v, sum(ia) AS ia, sum(ib) AS ib FROM o GROUP BY 1, 2),
t AS (SELECT population, sum(ia) AS na, sum(ib) AS nb FROM g GROUP BY 1),
f AS (SELECT population, na, nb, sum(ia) OVER (PARTITION BY population ORDER BY v) / na AS fa, sum(ib) OVER (PARTITION BY population ORDER BY v) / nb AS fb FROM g JOIN t USING (population))
SELECT population, round(max(abs(fa - fb)), 9) AS distance, CAST(max(na) AS BIGINT) AS n_control, CAST(max(nb) AS BIGINT) AS n FROM f GROUP BY 1""")
def kolmogorov_smirnov_to_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type against the control, ``view``."""
    return P.ks_to_control(_table(spark, sf_dir, "events"), "event_type", F.col("value"), "view").withColumn("distance", _r("distance", 9))


@registered("""
SELECT l_suppkey AS sample, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
 round(sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity), 4) AS through_origin FROM lineitem GROUP BY 1""")
def linear_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(
        F.count("*").alias("n"), _r(F.regr_slope(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("slope"), _r(F.regr_intercept(F.col("l_extendedprice"), F.col("l_quantity")), 3).alias("intercept"), _r(F.regr_r2(F.col("l_extendedprice"), F.col("l_quantity"))).alias("r2"), _r(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum(F.col("l_quantity") * F.col("l_quantity")), 4).alias("through_origin")
    )


@registered("""
WITH a AS (SELECT o_orderpriority AS measure, o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
m AS (SELECT measure, count(*) FILTER (WHERE g = 'F') AS na, count(*) FILTER (WHERE g = 'O') AS nb, avg(v) FILTER (WHERE g = 'F') AS ma, avg(v) FILTER (WHERE g = 'O') AS mb, var_samp(v) FILTER (WHERE g = 'F') AS va, var_samp(v) FILTER (WHERE g = 'O') AS vb FROM a GROUP BY 1),
r AS (SELECT measure, g, rank() OVER (PARTITION BY measure ORDER BY v) + (count(*) OVER (PARTITION BY measure, v) - 1) / 2.0 AS r FROM a),
u AS (SELECT measure, sum(r) FILTER (WHERE g = 'F') AS rs FROM r GROUP BY 1)
SELECT measure, na, nb, round(ma - mb, 4) AS difference, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS welch_t,
 round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df, round(rs - na * (na + 1) / 2.0, 1) AS mann_whitney_u FROM m JOIN u USING (measure)""")
def two_group_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderpriority").alias("measure"), F.col("o_orderstatus").alias("g"), F.col("o_totalprice").alias("v"))
    f, o = (F.when(F.col("g") == k, F.col("v")) for k in "FO")
    m = a.groupBy("measure").agg(F.count(f).alias("na"), F.count(o).alias("nb"), F.avg(f).alias("ma"), F.avg(o).alias("mb"), F.var_samp(f).alias("va"), F.var_samp(o).alias("vb"))
    ranks = a.groupBy("measure", "v").agg(F.count("*").alias("c"), F.count(f).alias("cf"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("measure").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = ranks.withColumn("r", below + (F.col("c") + 1) / 2).groupBy("measure").agg(F.sum(F.col("r") * F.col("cf")).alias("rs"))
    c = {k: F.col(k) for k in ("na", "nb", "ma", "mb", "va", "vb", "rs")}
    sa, sb = c["va"] / c["na"], c["vb"] / c["nb"]
    df = F.pow(sa + sb, F.lit(2.0)) / (F.pow(sa, F.lit(2.0)) / (c["na"] - 1) + F.pow(sb, F.lit(2.0)) / (c["nb"] - 1))
    return m.join(u, "measure").select("measure", "na", "nb", _r(c["ma"] - c["mb"], 4).alias("difference"), _r((c["ma"] - c["mb"]) / F.sqrt(sa + sb)).alias("welch_t"), _r(df, 4).alias("df"), _r(c["rs"] - c["na"] * (c["na"] + 1) / 2, 1).alias("mann_whitney_u"))


@registered("""
WITH p AS (SELECT l_returnflag AS family, l_suppkey AS test, avg(l_discount) AS p FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, test, round(max(least(1.0, p * (m - r + 1))) OVER (PARTITION BY family ORDER BY r), 6) AS holm, round(min(least(1.0, p * m / r)) OVER (PARTITION BY family ORDER BY r DESC), 6) AS bh FROM r""")
def adjusted_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("test")).agg(F.avg("l_discount").alias("p"))
    return P.holm_and_bh(p, "p", ["family"], "test").select("family", "test", _r("holm").alias("holm"), _r("bh").alias("bh"))


@registered("""
SELECT row_number() OVER (ORDER BY event_type, event_id) - 1 AS merged_id, dense_rank() OVER (ORDER BY event_type) AS source, event_id AS source_event_id, value FROM events WHERE value >= 20""")
def pooled_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenated populations with their origins; offsets are prefix sums of the sources' counts."""
    e = _table(spark, sf_dir, "events").where("value >= 20")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"))
    order = Window.orderBy("event_type")  # one row a source
    offsets = counts.select("event_type", F.row_number().over(order).alias("source"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    block = F.floor(F.col("event_id") / 1000)
    blocks = e.groupBy("event_type", block.alias("block")).agg(F.count("*").alias("n"))
    starts = blocks.select("event_type", "block", F.coalesce(F.sum("n").over(Window.partitionBy("event_type").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("event_type", "block").orderBy("event_id")) - 1
    return e.withColumn("block", block).withColumn("inside", inside).join(starts, ["event_type", "block"]).join(F.broadcast(offsets), "event_type").select((F.col("offset") + F.col("start") + F.col("inside")).alias("merged_id"), "source", F.col("event_id").alias("source_event_id"), "value")


@registered("""
WITH a AS (SELECT event_id FROM events WHERE value >= 100), b AS (SELECT event_id FROM events WHERE user_id % 3 = 0)
SELECT 'both' AS operation, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'rejected', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def population_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    a, b = e.where("value >= 100").select("event_id"), e.where("user_id % 3 = 0").select("event_id")
    parts = {"both": a.join(b, "event_id", "left_semi"), "either": a.union(b).distinct(), "rejected": a.join(b, "event_id", "left_anti")}
    out = None
    for n, d in parts.items():
        row = d.agg(F.count("*").alias("n")).select(F.lit(n).alias("operation"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@registered(f"""
WITH b AS (SELECT event_type AS sample, least(floor((t - t0) / w), 63)::INT AS bin, CASE WHEN isfinite(x) THEN x END AS v FROM {_E}, (SELECT min({_EVENTS_T}) AS t0, (max({_EVENTS_T}) - min({_EVENTS_T})) / 64 AS w FROM events))
SELECT sample, bin, count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(100.0 * count(*) FILTER (WHERE v > 100) / count(v), 6) AS pct_positive FROM b GROUP BY 1, 2 HAVING count(v) >= 5""")
def kinetics_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    span = e.agg(F.min("t").alias("t0"), ((F.max("t") - F.min("t")) / 64).alias("w"))
    v = finite(F.col("x"))
    bin_of = F.least(F.floor((F.col("t") - F.col("t0")) / F.col("w")), F.lit(63)).cast("int")
    g = e.join(F.broadcast(span)).groupBy(F.col("event_type").alias("sample"), bin_of.alias("bin"))
    return g.agg(F.count(v).alias("n"), _r(F.avg(v)).alias("mean"), _r(F.percentile(v, 0.5)).alias("median"), _r(100.0 * F.count_if(v > 100) / F.nullif(F.count(v), F.lit(0))).alias("pct_positive")).where("n >= 5")


@registered(f"""
WITH b AS (SELECT event_type AS sample, least(floor((t - t0) / w), 63)::INT AS bin, CASE WHEN isfinite(x) THEN x END AS v FROM {_E}, (SELECT min({_EVENTS_T}) AS t0, (max({_EVENTS_T}) - min({_EVENTS_T})) / 64 AS w FROM events)),
g AS (SELECT sample, bin, count(*) AS events, count(v) AS n, count(*) FILTER (WHERE v > 100) AS responders, avg(v) AS mean, quantile_cont(v, 0.5) AS median FROM b GROUP BY 1, 2)
SELECT sample, bin, coalesce(events, 0) AS events, coalesce(n, 0) AS n, coalesce(responders, 0) AS responders, round(CASE WHEN n >= 5 THEN mean END, 6) AS mean, round(CASE WHEN n >= 5 THEN median END, 6) AS median, round(CASE WHEN n >= 5 THEN 100.0 * responders / n END, 6) AS pct_positive
FROM (SELECT DISTINCT event_type AS sample FROM events) CROSS JOIN (SELECT CAST(unnest(range(64)) AS INT) AS bin) LEFT JOIN g USING (sample, bin)""")
def kinetics_all_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.time_bins(_events(spark, sf_dir).withColumnRenamed("event_type", "sample"), "sample", F.col("t"), F.col("x"), 64, 100.0, 5)
    return out.withColumns({c: _r(c) for c in ("mean", "median", "pct_positive")})


@registered("""
WITH w AS (SELECT chr(CAST(65 + l_suppkey % 8 AS INT)) || lpad(CAST(l_suppkey // 8 % 12 + 1 AS VARCHAR), 2, '0') AS well, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
SELECT well, count(*) AS replicates, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.5), 6) AS median, round(greatest(0, least(1, (avg(m) - 24) / 3)), 6) AS fraction FROM w GROUP BY 1""")
def plate_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    well = F.concat(F.char(65 + k % 8), F.lpad((F.floor(k / 8) % 12 + 1).cast("string"), 2, "0"))
    m = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m")).withColumn("well", well)
    return m.groupBy("well").agg(F.count("*").alias("replicates"), _r(F.avg("m")).alias("mean"), _r(F.percentile("m", 0.5)).alias("median"), _r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.avg("m") - 24) / 3))).alias("fraction"))


@registered("""
SELECT s.s_suppkey AS sample, n.n_name AS nation, r.r_name AS region, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) - avg(avg(l_quantity)) OVER (PARTITION BY r.r_name), 6) AS above_region
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2, 3""")
def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate before the joins: keywords meet one row a sample."""
    m = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"))
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = m.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    mean = j.groupBy("r_name").agg(F.avg("m").alias("region_mean"))
    return j.join(mean, "r_name").select(F.col("s_suppkey").alias("sample"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "n", _r("m").alias("mean"), _r(F.col("m") - F.col("region_mean")).alias("above_region"))


@registered("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(event_type || ':' || user_id) AS row_id, CASE WHEN regexp_matches(ltrim(event_type), '^[=+@\t\r-]') THEN '''' || event_type ELSE event_type END AS safe FROM events""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2(F.concat_ws(":", t, F.col("user_id").cast("string")).cast("binary"), 256).alias("row_id"), safe_text(t).alias("safe"))
