"""Queries of gates beyond the simple shapes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import cohorts as C, gates as G, grids as D, populations as P
from eventmill.queries.registry import SECONDS, registered, rounded as _r, seconds, table as _table


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("d"), F.col("l_tax").alias("w"))


_L = "(SELECT l_suppkey AS sample, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS d, l_tax AS w FROM lineitem)"


@registered(f"""
WITH p AS (SELECT sample, x - 25 AS dx, (y - 35) / 1.5 AS dy FROM {_L}),
a AS (SELECT sample, dx, dy, (atan2(dy, dx) - 0.3 + 4 * pi()) % (2 * pi()) AS turn FROM p),
l AS (SELECT sample, CASE WHEN dx = 0 AND dy = 0 THEN 2 WHEN turn < 1.3 THEN 2 WHEN turn < 2.6 THEN 1 WHEN turn < 4.2 THEN 4 ELSE 3 END AS label FROM a)
SELECT sample, label, count(*) AS n FROM l GROUP BY 1, 2""")
def spider_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sectors between arms at 0.3, 1.6, 2.9 and 4.5 radians on scaled axes."""
    label = G.spider_label(F.col("x"), F.col("y"), (25.0, 35.0), (1.0, 1.5), (0.3, 1.6, 2.9, 4.5))
    return _lineitem(spark, sf_dir).groupBy("sample", label.alias("label")).agg(F.count("*").alias("n"))


@registered(f"""
WITH l AS (SELECT sample, y >= 30 + 2 * (sqrt(greatest(x, 20)) - sqrt(20)) AS up, x >= 20 + 1.5 * (sqrt(greatest(y, 30)) - sqrt(30)) AS rt FROM {_L})
SELECT sample, CASE WHEN up AND NOT rt THEN 1 WHEN up THEN 2 WHEN rt THEN 3 ELSE 4 END AS label, count(*) AS n FROM l GROUP BY 1, 2""")
def curly_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = G.curly_label(F.col("x"), F.col("y"), (20.0, 30.0), (1.5, 2.0))
    return _lineitem(spark, sf_dir).groupBy("sample", label.alias("label")).agg(F.count("*").alias("n"))


@registered(f"""
WITH c AS (SELECT sample, count(*) AS t, count(*) FILTER (WHERE x < 20) AS low, count(*) FILTER (WHERE x >= 20) AS high,
 count(*) FILTER (WHERE x >= 20 AND d < 0.05 AND y >= 40) AS q1, count(*) FILTER (WHERE x >= 20 AND d >= 0.05 AND y >= 40) AS q2,
 count(*) FILTER (WHERE x >= 20 AND d >= 0.05 AND y < 40) AS q3, count(*) FILTER (WHERE x >= 20 AND d < 0.05 AND y < 40) AS q4 FROM {_L} GROUP BY 1)
SELECT sample, unnest(['B −', 'B +', 'Q Q1', 'Q Q2', 'Q Q3', 'Q Q4']) AS population, unnest([low, high, q1, q2, q3, q4]) AS n FROM c""")
def linked_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bisector and, below its upper half, a quadrant family: together all rows of their parents."""
    tree = [*G.linked_family("B", [(F.col("x"), 20.0)]), *G.linked_family("Q", [(F.col("d"), 0.05), (F.col("y"), 40.0)], "B +")]
    return P.gate_counts(_lineitem(spark, sf_dir), "sample", tree).select("sample", "population", "n")


@registered(f"""
WITH m AS (SELECT sample, x >= 10 AND x < 30 AS a, d >= 0.03 AND d < 0.08 AS b, y >= 20 AS p FROM {_L})
SELECT sample, unnest(['a and not b', 'not a or b', 'below']) AS population, unnest([count(*) FILTER (WHERE a AND NOT b), count(*) FILTER (WHERE NOT a OR b), count(*) FILTER (WHERE p AND (a <> NOT b))]) AS n FROM m GROUP BY sample""")
def operand_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = [
        G.Gate("a", G.interval(F.col("x"), 10.0, 30.0)), G.Gate("b", G.interval(F.col("d"), 0.03, 0.08)), G.Gate("p", G.interval(F.col("y"), 20.0)),
        G.Gate("a and not b", operands=("a", "b"), op="and", operand_complements=(False, True)), G.Gate("not a or b", operands=("a", "b"), op="or", operand_complements=(True, False)),
        G.Gate("below", operands=("a", "b"), op="xor", operand_complements=(False, True), parent="p"),
    ]
    return P.gate_counts(_lineitem(spark, sf_dir), "sample", tree).where(F.col("population").isin("a and not b", "not a or b", "below")).select("sample", "population", "n")


_RING = [(round(25 + 18 * math.cos(k * math.tau / 90) * (1 + 0.3 * (k % 3)), 6), round(40 + 30 * math.sin(k * math.tau / 90) * (1 + 0.3 * (k % 3)), 6)) for k in range(90)]
_CROSSED = " + ".join(f"(CASE WHEN (y >= {min(a[1], b[1])}) AND (y < {max(a[1], b[1])}) AND x < {a[0]} + (y - {a[1]}) * ({b[0] - a[0]}) / ({b[1] - a[1]}) THEN 1 ELSE 0 END)" for a, b in zip(_RING, [*_RING[1:], _RING[0]]) if a[1] != b[1])


@registered(f"SELECT sample, count(*) FILTER (WHERE ({_CROSSED}) % 2 = 1) AS n FROM {_L} GROUP BY 1")
def freehand_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of 90 vertices that crosses itself."""
    return _lineitem(spark, sf_dir).groupBy("sample").agg(F.count_if(G.polygon(F.col("x"), F.col("y"), _RING)).alias("n"))


@registered(f"""
SELECT sample, count(*) FILTER (WHERE x >= 10) AS plotted, count(*) FILTER (WHERE x >= 10 AND d >= 0.05) AS highlighted, count(*) FILTER (WHERE x >= 10 AND d >= 0.05 AND x BETWEEN 15 AND 40 AND y BETWEEN 10 AND 60) AS visible,
 round(100.0 * count(*) FILTER (WHERE x >= 10 AND d >= 0.05) / nullif(count(*) FILTER (WHERE x >= 10), 0), 6) AS percent FROM {_L} GROUP BY 1""")
def backgates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.backgate_counts(_lineitem(spark, sf_dir), ["sample"], G.interval(F.col("x"), 10.0), G.interval(F.col("d"), 0.05), F.col("x"), F.col("y"), (15.0, 40.0, 10.0, 60.0)).withColumn("percent", _r("percent"))


@registered(f"""
SELECT sample, count(*) AS n, count(*) AS n_finite, count(*) FILTER (WHERE x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 60) AS visible, count(*) FILTER (WHERE NOT (x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 60)) AS outside FROM {_L} GROUP BY 1""")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.view_counts(_lineitem(spark, sf_dir), ["sample"], F.col("x"), F.col("y"), (10.0, 40.0, 10.0, 60.0))


@registered(f"SELECT sample, count(*) FILTER (WHERE x >= 5 AND x < 45 AND y >= 10 AND y < 60) AS n FROM {_L} GROUP BY 1")
def control_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate with raw limits of a detector, of events that are finite in all detectors."""
    inside = G.control_selection(G.interval(F.col("x"), 5.0, 45.0), F.col("y"), 10.0, 60.0, [F.col("x"), F.col("y"), F.col("d"), F.col("w")])
    return _lineitem(spark, sf_dir).groupBy("sample").agg(F.count_if(inside).alias("n"))


@registered(f"""
WITH s AS (SELECT event_type, user_id, event_id, value, {SECONDS} AS t FROM events), m AS (SELECT min(t) AS a, max(t) AS b FROM s),
r AS (SELECT unnest(['early', 'late']) AS range, unnest([0.0, 0.4]) AS lo, unnest([0.4, 1.0]) AS hi)
SELECT event_type AS sample, range, count(*) AS population_count, count(*) AS finite_count, count(*) FILTER (WHERE value > 100) AS responder_count
FROM s, m, r WHERE t >= a + lo * (b - a) AND (t < a + hi * (b - a) OR hi = 1.0) GROUP BY 1, 2""")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent time ranges part all events; the domain's end is inside."""
    from eventmill.operators import kinetics as K

    e = _table(spark, sf_dir, "events").withColumns({"sample": F.col("event_type"), "clock": seconds()})
    a, b = e.agg(F.min("clock"), F.max("clock")).first()
    cut = a + 0.4 * (b - a)
    return K.range_counts(e, "sample", "clock", F.col("value"), F.lit(True), [("early", a, cut), ("late", cut, b)], (a, b), 100.0)


@registered("""
WITH c AS (SELECT event_type, event_id FROM events WHERE value >= 50 AND value < 150)
SELECT event_type AS sample, 'captured' AS part, count(*) AS n FROM c GROUP BY 1 UNION ALL
SELECT event_type, 'rejected', count(*) FROM events WHERE event_id NOT IN (SELECT event_id FROM c) GROUP BY 1""")
def captured_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population frozen as ids, and what is outside it."""
    e = _table(spark, sf_dir, "events")
    snapshot = C.captured(e, "event_type", "event_id", G.interval(F.col("value"), 50.0, 150.0))
    parts = [C.in_captured(e, "event_type", "event_id", snapshot, inside).groupBy(F.col("event_type").alias("sample")).agg(F.count("*").alias("n")).select("sample", F.lit(name).alias("part"), "n") for name, inside in (("captured", True), ("rejected", False))]
    return parts[0].unionByName(parts[1])


@registered("""
SELECT s_suppkey AS sample, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name || ' ' || n_name), lower('Nation_1'))""")
def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name or tags hold a text, whatever its case."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).where(G.text_filter("Nation_1", F.col("s_name"), F.col("n_name"))).select(F.col("s_suppkey").alias("sample"), F.col("s_name").alias("name"))


@registered(f"""
WITH g AS (SELECT least(floor((x - 1) / 49 * 32), 31)::INT AS bx, least(floor((y - 0) / 120 * 32), 31)::INT AS by_, count(*) AS n FROM {_L} WHERE x BETWEEN 1 AND 50 AND y BETWEEN 0 AND 120 GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS run FROM g),
t AS (SELECT max(n) AS cut FROM r WHERE run >= 0.5 * (SELECT count(*) FROM {_L}))
SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS events, (SELECT cut FROM t) AS threshold FROM g, t WHERE n >= cut""")
def density_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densest cells that hold half of all finite events, ties inside."""
    rows = _lineitem(spark, sf_dir)
    cells = D.grid_counts(rows, [], F.col("x"), F.col("y"), (1.0, 50.0, 0.0, 120.0), 32)
    total = rows.agg(F.count("*").alias("total"))
    return D.highest_density(cells, [], [0.5], total).select("cells", "events", "threshold")
