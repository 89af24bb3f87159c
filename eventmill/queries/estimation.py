"""Queries of spillover and spreading estimation and of peak models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import estimation as E, mixtures as M, peak_models as P, refinement as R, scatter as S
from eventmill.queries.registry import registered, rounded as _r, table as _table

_ROLE = "CASE WHEN l_quantity >= 35 THEN 'positive' WHEN l_quantity < 10 THEN 'negative' END"
_DETECTORS = {"q": "l_quantity", "p": "l_extendedprice / 1000", "d": "l_discount * 100"}


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("l_quantity") >= 35, "positive").when(F.col("l_quantity") < 10, "negative")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("control"), role.alias("role"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("p"), (F.col("l_discount") * 100).alias("d")).where("role IS NOT NULL")


_STATS = f"""
e AS (SELECT l_returnflag AS control, {_ROLE} AS role, l_quantity AS q, l_extendedprice / 1000 AS p, l_discount * 100 AS d FROM lineitem),
l AS (SELECT control, role, unnest(['q', 'p', 'd']) AS detector, unnest([q, p, d]) AS v FROM e WHERE role IS NOT NULL),
m AS (SELECT control, role, detector, count(*) AS n, quantile_cont(v, 0.5) AS median FROM l GROUP BY 1, 2, 3),
s AS (SELECT l.control, l.role, l.detector, 1.4826 * quantile_cont(abs(v - median), 0.5) AS robust_sd FROM l JOIN m USING (control, role, detector) GROUP BY 1, 2, 3)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.control_statistics(_controls(spark, sf_dir), "control", "role", {d: F.col(d) for d in "qpd"}, {"q": 50.0})


@registered(f"""WITH {_STATS} SELECT m.control, m.role, m.detector, n, round(median, 6) AS median, round(robust_sd, 6) AS robust_sd, (SELECT count(*) FROM l WHERE l.control = m.control AND l.role = m.role AND l.detector = m.detector AND m.detector = 'q' AND v >= 50 * 0.9999) AS saturated FROM m JOIN s USING (control, role, detector)""")
def control_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and robust deviations of every control and detector in one job."""
    return _stats(spark, sf_dir).select("control", "role", "detector", "n", _r("median").alias("median"), _r("robust_sd").alias("robust_sd"), "saturated")


@registered(f"""WITH {_STATS}, x AS (SELECT m.control, m.detector, max(median) FILTER (WHERE role = 'positive') - max(median) FILTER (WHERE role = 'negative') AS delta, max(robust_sd) AS noise FROM m JOIN s USING (control, role, detector) GROUP BY 1, 2),
o AS (SELECT control, delta AS signal, noise FROM x WHERE detector = 'q')
SELECT control, detector, round(delta, 6) AS delta, round(delta / signal, 6) AS coefficient, round(signal / o.noise, 6) AS separation FROM x JOIN o USING (control)""")
def spillover_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of medians over that of the primary detector."""
    stats = _stats(spark, sf_dir)
    primaries = stats.select("control").distinct().withColumn("primary", F.lit("q"))
    return E.separations(stats, primaries).select("control", "detector", _r("delta").alias("delta"), _r("coefficient").alias("coefficient"), _r("separation").alias("separation"))


@registered(f"""WITH {_STATS}, x AS (SELECT control, detector, max(median) FILTER (WHERE role = 'positive') - max(median) FILTER (WHERE role = 'negative') AS delta FROM m GROUP BY 1, 2)
SELECT a.control AS one, b.control AS other, round(sum(a.delta * b.delta) / sqrt(sum(a.delta * a.delta) * sum(b.delta * b.delta)), 9) AS cosine FROM x a JOIN x b ON a.detector = b.detector AND a.control < b.control GROUP BY 1, 2""")
def signature_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the signatures of the controls are."""
    stats = _stats(spark, sf_dir)
    names = sorted(r[0] for r in stats.select("control").distinct().collect())
    rows = E.separations(stats, stats.select("control").distinct().withColumn("primary", F.lit("q")))
    told = E.signature_cosines(E.matrix_of(rows, names, ["q", "p", "d"]), names)
    return spark.createDataFrame(told, "one string, other string, cosine double").withColumn("cosine", _r("cosine", 9))


@registered("""
WITH r AS (SELECT l_suppkey AS sample, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
b AS (SELECT sample, y, CASE WHEN k < (n // 16 + 1) * (n % 16) THEN k // (n // 16 + 1) ELSE n % 16 + (k - (n // 16 + 1) * (n % 16)) // (n // 16) END AS bin FROM r)
SELECT sample, CAST(bin AS INT) AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bins of equal counts by one channel for each sample."""
    rows = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "sample")
    b = E.equal_count_bins(rows, ["sample"], "l_quantity", ["l_orderkey", "l_linenumber", "l_extendedprice"], 16)
    return b.groupBy("sample", "bin").agg(F.count("*").alias("n"))


@registered("""
WITH e AS (SELECT l_returnflag AS k, l_extendedprice AS x, l_quantity + l_discount AS y, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS i, row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS j FROM e),
b AS (SELECT k, max(x) FILTER (WHERE i = round_even(n * 0.01, 0) - 1) AS xl, max(x) FILTER (WHERE i = n - round_even(n * 0.01, 0)) AS xh, max(y) FILTER (WHERE j = round_even(n * 0.01, 0) - 1) AS yl, max(y) FILTER (WHERE j = n - round_even(n * 0.01, 0)) AS yh FROM r GROUP BY 1)
SELECT k AS control, count(*) AS n, round(min(x), 4) AS least, round(max(x), 4) AS most FROM e JOIN b USING (k) WHERE x > xl AND x < xh AND y > yl AND y < yh GROUP BY 1""")
def trimmed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One percent off both ends of both axes."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("control"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") + F.col("l_discount")).alias("y"))
    return E.trimmed_pairs(rows, ["control"], "x", "y").groupBy("control").agg(F.count("*").alias("n"), _r(F.min("x"), 4).alias("least"), _r(F.max("x"), 4).alias("most"))


@registered(None)
def robust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust lines of price on quantity; the tests hold them against a plain loop."""
    rows = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "control")
    return E.huber_lines(rows, ["control"], "l_quantity", "l_extendedprice")


@registered(None)
def spreading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How one channel's height widens the others; the tests recover a known widening."""
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("control"), F.lit("p").alias("primary"), (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"), "l_orderkey", "l_linenumber")
    return E.spreading(rows, "control", "primary", {n: F.col(n) for n in "pqd"}, ["l_orderkey", "l_linenumber", "q"], 64)


@registered("""
WITH k AS (SELECT s_suppkey AS sample, CASE s_suppkey % 4 WHEN 0 THEN '2,A,B,1,0.1,0.2,1' WHEN 1 THEN '2,A,A,1,0,0,1' WHEN 2 THEN '2,A,B,1,x,0,1' ELSE '1,A,' || s_nationkey END AS t FROM supplier)
SELECT sample, CASE sample % 4 WHEN 0 THEN 'A,B' WHEN 3 THEN 'A' END AS names, round(CASE sample % 4 WHEN 0 THEN 2.3 WHEN 3 THEN CAST(split_part(t, ',', 3) AS DOUBLE) END, 6) AS total FROM k""")
def embedded_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spillover keywords as matrices; a wrong size, a repeated name or text gives none."""
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, "2,A,B,1,0.1,0.2,1").when(k == 1, "2,A,A,1,0,0,1").when(k == 2, "2,A,B,1,x,0,1").otherwise(F.concat(F.lit("1,A,"), F.col("s_nationkey").cast("string")))
    out = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), E.embedded_matrix(text).alias("m"))
    total = F.aggregate(F.flatten("m.matrix"), F.lit(0.0), lambda a, x: a + x)
    return out.select("sample", F.when(F.col("m").isNotNull(), F.array_join("m.names", ",")).alias("names"), _r(F.when(F.col("m").isNotNull(), total)).alias("total"))


@registered("""
SELECT l_suppkey AS sample, round(avg(l_quantity * 0.01), 6) AS time, round(avg(pow(10, l_discount * 100 * 4.0 / 10) * 1.0), 4) AS logged, round(avg(l_extendedprice / 8.0), 4) AS gained FROM lineitem GROUP BY 1""")
def preprocessed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time by its step, a log amplifier undone, a gain taken off."""
    c = E.preprocessed({"Time": F.col("l_quantity"), "logged": F.col("l_discount") * 100, "gained": F.col("l_extendedprice")}, 0.01, {"logged": (4.0, 0.0, 10.0)}, {"gained": 8.0})
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(_r(F.avg(c["Time"])).alias("time"), _r(F.avg(c["logged"]), 4).alias("logged"), _r(F.avg(c["gained"]), 4).alias("gained"))


@registered("""
WITH c AS (SELECT l_suppkey AS sample, CAST(floor(l_quantity / 10) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sample, sum(n / pow(2, g)) AS p, sum(CASE WHEN g > 0 THEN n / pow(2, g) ELSE 0 END) AS q, sum(n) AS t, sum(CASE WHEN g > 0 THEN n ELSE 0 END) AS o, sum(g * n / pow(2, g)) AS d FROM c GROUP BY 1)
SELECT sample, round(p, 6) AS precursors, round(q / p, 9) AS precursor_frequency, round(100 * q / p, 6) AS percent_divided, round(o / t, 9) AS observed_divided_fraction, round(d / p, 9) AS division_index, round(d / q, 9) AS proliferation_index, round(t / p, 9) AS expansion_index, round(o / q, 9) AS replication_index FROM s""")
def generation_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division figures of counts by generation."""
    c = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample"), F.floor(F.col("l_quantity") / 10).alias("g")).agg(F.count("*").alias("n"))
    out = M.generation_indices(c, ["sample"], "g", "n")
    return out.select("sample", *[_r(x, 6 if x in ("precursors", "percent_divided") else 9).alias(x) for x in out.columns[1:]])


@registered(None)
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and assigned events of each part of every sample's histogram; the tests recover known shares."""
    e = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    return M.part_counts(M.cell_cycle(e, "sample", F.col("value"), 0.5, 120.0, 128))


@registered(None)
def generation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of dye generations, from the highest values as undivided control."""
    e = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    return M.part_counts(M.proliferation(e, "sample", F.col("value"), F.col("value") > 100, 4, 128, -4.0, 10.0))


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("control"), (F.col("l_extendedprice") / 100).alias("x"), (F.col("l_quantity") * 20 + F.col("l_tax") * 100).alias("y"))


@registered(None)
def scatter_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in and out of each control's density clean-up gate; the tests hold it against a plain version of the whole table."""
    rows = _scatter(spark, sf_dir)
    gates = S.scatter_cleanup(rows, "control", F.col("x"), F.col("y"), (1200.0, 1200.0))
    inside = S.cleaned(F.col("control"), F.col("x"), F.col("y"), gates)
    return rows.groupBy("control").agg(F.count("*").alias("events"), F.count_if(inside).alias("kept"))


@registered(None)
def constrained_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and assigned events of each phase under linked widths and a synchronous wave; the tests recover known shares and check that no event is lost."""
    e = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    out = P.cell_cycle(e, "sample", F.col("value"), 0.5, 120.0, 128, P.CycleModel(wave=True))
    return M.part_counts(out).join(out.groupBy("sample").agg(F.max(F.col("parameters")["outside"]).cast("long").alias("outside")), "sample")


@registered(None)
def background_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of dye generations, calibrated from the highest values as undivided and the lowest as unstained control."""
    e = _table(spark, sf_dir, "events").withColumn("sample", F.col("event_type"))
    v = F.col("value")
    out = P.dye_generations(e, "sample", v, -50.0, 600.0, 20.0, P.DyeModel(generations=4), v > 100, v < 3, 128)
    return M.part_counts(out).join(out.groupBy("sample").agg(F.max(F.col("parameters")["outside"]).cast("long").alias("outside")), "sample")


def _stains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stains from prices, each with a known part of itself in the other detectors; quantities, discounts and taxes are the noise."""
    rows = _table(spark, sf_dir, "lineitem")
    k = F.element_at(F.create_map(*[F.lit(v) for pair in (("A", 0), ("N", 1), ("R", 2)) for v in pair]), F.col("l_returnflag"))
    mixed = [F.col("l_extendedprice") * F.element_at(F.array(*[F.lit(float(v)) for v in _SPILL[:, j]]), k + 1) for j in range(3)]
    noise = [F.col("l_quantity"), F.col("l_discount") * 500, F.col("l_tax") * 600]
    return rows.select(F.element_at(F.array(*map(F.lit, "XYZ")), k + 1).alias("control"), *[(m + n).alias(d) for m, n, d in zip(mixed, noise, "XYZ")])


_SPILL = np.array([[1.0, 0.12, 0.03], [0.05, 1.0, 0.2], [0.01, 0.08, 1.0]])


@registered(None)
def refined_spillover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refined matrix of three stains; the tests hold it against the matrix that mixed them."""
    got = R.refined_spillover(_stains(spark, sf_dir), "control", list("XYZ"))
    return spark.createDataFrame([(a, b, float(got.matrix[i, j])) for i, a in enumerate("XYZ") for j, b in enumerate("XYZ")], "stain string, detector string, coefficient double")


@registered(None)
def refined_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signatures of two of the stains over three detectors, from rough ones."""
    rough = np.array([[1.0, 0.3, 0.1], [0.2, 1.0, 0.3]])
    got = R.refined_signatures(_stains(spark, sf_dir), "control", ["X", "Y"], list("XYZ"), rough)
    return spark.createDataFrame([(a, b, float(got.matrix[i, j])) for i, a in enumerate("XY") for j, b in enumerate("XYZ")], "stain string, detector string, share double")
