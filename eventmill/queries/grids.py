"""Queries of density grids, extents, samples and magnetic gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import gates as G, grids as D
from eventmill.queries.registry import registered, rounded as _r, table as _table

_L = "(SELECT l_suppkey AS sample, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@registered("""
WITH q AS (SELECT event_type AS sample, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM events GROUP BY 1) SELECT sample, round(lo - (hi - lo) * 0.04, 6) AS low, round(hi + (hi - lo) * 0.04, 6) AS high FROM q""")
def axis_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of an axis for each sample."""
    e = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    return D.extents(e, ["sample"], F.col("value")).select("sample", _r("low").alias("low"), _r("high").alias("high"))


_GRID = f"g AS (SELECT least(floor((x - 1) / 49 * 24), 23)::INT AS bx, least(floor(y / 120 * 24), 23)::INT AS \"by\", count(*) AS n FROM {_L} WHERE x BETWEEN 1 AND 50 AND y BETWEEN 0 AND 120 GROUP BY 1, 2)"


@registered(f"""WITH {_GRID}, k AS (SELECT d, exp(-0.5 * d * d) AS e FROM (SELECT unnest(range(-4, 5)) AS d)), w AS (SELECT d, e / (SELECT sum(e) FROM k) AS w FROM k),
a AS (SELECT bx + d AS bx, "by", sum(n * w) AS v FROM g, w WHERE bx + d BETWEEN 0 AND 23 GROUP BY 1, 2), b AS (SELECT bx, "by" + d AS "by", sum(v * w) AS v FROM a, w WHERE "by" + d BETWEEN 0 AND 23 GROUP BY 1, 2)
SELECT CAST(bx AS INT) AS bx, CAST("by" AS INT) AS "by", coalesce(n, 0) AS n, round(v * (SELECT sum(n) FROM g) / (SELECT sum(v) FROM b), 6) AS density FROM b LEFT JOIN g USING (bx, "by")""")
def smoothed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A density grid under Gaussian weights that keep its total."""
    cells = D.grid_counts(_lineitem(spark, sf_dir), [], F.col("x"), F.col("y"), (1.0, 50.0, 0.0, 120.0), 24)
    return D.smoothed(cells, [], 24, 1.0).select("bx", "by", "n", _r("density").alias("density"))


_LEVELS = f"""{_GRID}, t AS (SELECT count(*) AS total FROM {_L}), r AS (SELECT n, sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS run FROM g),
c AS (SELECT CAST(unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS coverage), l AS (SELECT coverage, max(n) FILTER (WHERE run >= coverage * total - 1e-9) AS threshold FROM c, r, t GROUP BY 1)"""


@registered(f"""WITH {_LEVELS}
SELECT coverage, threshold, count(*) AS cells, CAST(sum(n) AS BIGINT) AS events, round(sum(n) / max(total), 6) AS estimated, count(*) FILTER (WHERE n = threshold) AS tied FROM l JOIN g ON n >= threshold, t GROUP BY 1, 2""")
def probability_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The densest cells for several shares of all events."""
    rows = _lineitem(spark, sf_dir)
    cells = D.grid_counts(rows, [], F.col("x"), F.col("y"), (1.0, 50.0, 0.0, 120.0), 24)
    out = D.highest_density(cells, [], [0.1, 0.3, 0.5, 0.7, 0.9], rows.agg(F.count("*").alias("total")))
    return out.withColumn("estimated", _r("estimated")).where("threshold IS NOT NULL")


@registered(f"""WITH {_LEVELS}, b AS (SELECT bx, "by", (SELECT count(DISTINCT threshold) FROM l WHERE threshold <= n) AS band FROM g)
SELECT band, count(*) AS cells, CAST(sum(n) AS BIGINT) AS events FROM b JOIN g USING (bx, "by") GROUP BY 1""")
def zebra_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and events between the levels."""
    rows = _lineitem(spark, sf_dir)
    cells = D.grid_counts(rows, [], F.col("x"), F.col("y"), (1.0, 50.0, 0.0, 120.0), 24)
    levels = D.highest_density(cells, [], [0.1, 0.3, 0.5, 0.7, 0.9], rows.agg(F.count("*").alias("total")))
    return D.bands(cells, levels, []).groupBy("band").agg(F.count("*").alias("cells"), F.sum("n").alias("events"))


@registered(f"""WITH {_LEVELS}, e AS (SELECT sample, CASE WHEN x BETWEEN 1 AND 50 THEN least(floor((x - 1) / 49 * 24), 23)::INT END AS bx, CASE WHEN y BETWEEN 0 AND 120 THEN least(floor(y / 120 * 24), 23)::INT END AS "by" FROM {_L})
SELECT sample, count(*) AS n FROM e LEFT JOIN g USING (bx, "by") WHERE n IS NULL OR n < (SELECT min(threshold) FROM l) GROUP BY 1""")
def density_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside the outermost level."""
    rows = _lineitem(spark, sf_dir)
    box = (1.0, 50.0, 0.0, 120.0)
    cells = D.grid_counts(rows, [], F.col("x"), F.col("y"), box, 24)
    levels = D.highest_density(cells, [], [0.1, 0.3, 0.5, 0.7, 0.9], rows.agg(F.count("*").alias("total")))
    out = D.outliers(rows, D.bands(cells, levels, []), F.col("x"), F.col("y"), box, 24)
    return out.groupBy("sample").agg(F.count("*").alias("n"))


@registered("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
o AS (SELECT event_type, n, row_number() OVER (ORDER BY event_type) AS i, count(*) OVER () AS m FROM c)
SELECT event_type AS sample, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r JOIN o USING (event_type) WHERE k <= 603 // m + (i <= 603 % m)::INT GROUP BY 1""")
def balanced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """603 events dealt equally to all samples, here the first by id; sampling is the feature."""
    out = D.balanced_sample(_table(spark, sf_dir, "events"), "event_type", ["event_id"], 603, by_id=True)
    return out.groupBy(F.col("event_type").alias("sample")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@registered("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE k IN (SELECT CAST(floor(i * ((SELECT max(n) FROM r) - 1) / 499.0) AS BIGINT) FROM (SELECT unnest(range(500)) AS i))""")
def spaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 events at evenly spaced ranks; sampling is the feature."""
    return D.evenly_spaced(_table(spark, sf_dir, "events"), "event_id", 500).select("event_id")


@registered(None)
def displayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 1,000 events for display, the same ones each time; sampling is the feature."""
    return D.display_sample(_table(spark, sf_dir, "events"), ["event_id"], 1000).select("event_id", "value")


@registered(None)
def magnetic_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ellipse moved to the nearest maximum of its own counts, and what it then holds of each sample."""
    rows = _lineitem(spark, sf_dir)
    shape = lambda x, y: G.ellipse(x, y, (20.0, 30.0), (6.0, 12.0))
    dx, dy = D.magnetic_shift(rows, shape, F.col("x"), F.col("y"), (20.0, 30.0), (12.0, 24.0), 0.5)
    told = rows.groupBy("sample").agg(F.count_if(shape(F.col("x"), F.col("y"))).alias("anchored"), F.count_if(shape(F.col("x") - dx, F.col("y") - dy)).alias("moved"))
    return told.withColumns({"dx": F.lit(dx), "dy": F.lit(dy)})


@registered(None)
def density_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region around a seed that belongs to the densest half."""
    rows = _lineitem(spark, sf_dir)
    inside = D.density_gate(rows, F.col("x"), F.col("y"), (1.0, 50.0, 0.0, 120.0), 24, 0.5, (10.0, 12.0))
    return rows.groupBy("sample").agg(F.count_if(inside).alias("n"))


@registered("""
WITH RECURSIVE e AS (SELECT event_type, CAST(least(floor((value + 0.003) / 491 * 16), 15) AS INT) AS cx, CAST(least(floor((user_id - 0.3) / 150.6 * 16), 15) AS INT) AS cy FROM events WHERE value BETWEEN -0.003 AND 490.997 AND user_id BETWEEN 0.3 AND 150.9),
c AS (SELECT cx, cy, count(*) AS n FROM e GROUP BY 1, 2), l AS (SELECT n, sum(n * k) OVER (ORDER BY n DESC) AS run FROM (SELECT n, count(*) AS k FROM c GROUP BY 1)),
t AS (SELECT max(n) AS level FROM l WHERE run >= 0.6 * (SELECT count(*) FROM events WHERE isfinite(value)) - 1e-9),
i AS (SELECT cx, cy FROM c, t WHERE n >= level),
r(cx, cy) AS (SELECT cx, cy FROM i WHERE (cx, cy) = (SELECT (cx, cy) FROM c ORDER BY n DESC, cy, cx LIMIT 1) UNION SELECT i.cx, i.cy FROM r JOIN i ON abs(i.cx - r.cx) + abs(i.cy - r.cy) = 1)
SELECT event_type, count(*) AS n, count(r.cx) AS inside FROM e LEFT JOIN r USING (cx, cy) GROUP BY 1""")
def density_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the view inside the rings of the dense region around the fullest cell; none if the view does not hold the region's share of all events."""
    e = _table(spark, sf_dir, "events")
    x, y, bounds = F.col("value"), F.col("user_id").cast("double"), (-0.003, 490.997, 0.3, 150.9)
    top = D.grid_counts(e, [], x, y, bounds, 16).orderBy(F.desc("n"), "by", "bx").first()
    bx, by = (top["bx"], top["by"]) if top else (0, 0)
    seed = (bounds[0] + (bx + 0.5) * 491 / 16, bounds[2] + (by + 0.5) * 150.6 / 16)
    try:
        outer, holes = D.density_polygon(e, x, y, bounds, 16, 0.6, seed)
        inside = G.polygon_with_holes(x, y, outer, holes)
    except D.Uncovered:
        inside = F.lit(False)
    seen = e.where(x.between(*bounds[:2]) & y.between(*bounds[2:]))
    return seen.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))
