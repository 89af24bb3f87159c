"""Queries of distribution comparisons and group tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import comparison as K
from eventmill.queries.registry import registered, rounded as _r, table as _table


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.against_control(_table(spark, sf_dir, "events"), "event_type", F.col("value"), "view")


_CURVES = """
e AS (SELECT event_type AS population, value AS v FROM events WHERE isfinite(value)),
u AS (SELECT population, v, 0 AS c, 1 AS t FROM e WHERE population <> 'view' UNION ALL SELECT p.population, e.v, 1, 0 FROM (SELECT DISTINCT population FROM e WHERE population <> 'view') p, e WHERE e.population = 'view'),
g AS (SELECT population, v, sum(c) AS c, sum(t) AS t FROM u GROUP BY 1, 2),
n AS (SELECT population, sum(c) AS nc, sum(t) AS nt FROM g GROUP BY 1),
f AS (SELECT population, v, nc, nt, sum(c) OVER w / nc AS fc, sum(t) OVER w / nt AS ft FROM g JOIN n USING (population) WINDOW w AS (PARTITION BY population ORDER BY v)),
k AS (SELECT population, max(abs(fc - ft)) AS ks, greatest(0, max(fc - ft)) AS pos FROM f GROUP BY 1),
p AS (SELECT f.population, min(v) AS at FROM f JOIN k USING (population) WHERE fc - ft = pos GROUP BY 1),
q AS (SELECT f.population, fc AS cd, ft AS td, v AS at FROM f JOIN p ON f.population = p.population AND f.v = p.at),
x AS (SELECT f.population, max((fc * td - cd * ft) / nullif(cd * cd, 0)) AS correction FROM f JOIN q ON f.population = q.population AND f.v <= q.at GROUP BY 1)"""


@registered(f"""WITH {_CURVES},
a AS (SELECT f.population, min(v) AS ks_at FROM f JOIN k USING (population) WHERE abs(fc - ft) = ks GROUP BY 1),
s AS (SELECT f.population, fc - ft AS ks_signed FROM f JOIN a ON f.population = a.population AND f.v = a.ks_at)
SELECT k.population, CAST(nc AS BIGINT) AS n_control, CAST(nt AS BIGINT) AS n, round(ks, 9) AS ks_distance, round(ks_at, 6) AS ks_at, round(ks_signed, 9) AS ks_signed, round(100 * pos, 6) AS overton_percent,
 round(CASE WHEN pos > 0 THEN 100 * least(1, pos / cd) ELSE 0 END, 6) AS enhanced_percent, round(CASE WHEN pos > 0 THEN 100 * least(1, pos / cd + greatest(0, coalesce(correction, 0))) ELSE 0 END, 6) AS ens_percent
FROM k JOIN n USING (population) JOIN a USING (population) JOIN s USING (population) JOIN q USING (population) LEFT JOIN x USING (population)""")
def distribution_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type against the control: distance with place and sign, cumulative subtraction and its corrections."""
    out = K.distribution_effects(_counts(spark, sf_dir), ["population"])
    return out.select("population", "n_control", "n", _r("ks_distance", 9).alias("ks_distance"), _r("ks_at").alias("ks_at"), _r("ks_signed", 9).alias("ks_signed"), _r("overton_percent").alias("overton_percent"), _r("enhanced_percent").alias("enhanced_percent"), _r("ens_percent").alias("ens_percent"))


@registered(f"""WITH {_CURVES}, b AS (SELECT population, min(v) AS lo, max(v) AS hi FROM g GROUP BY 1),
h AS (SELECT population, least(floor((v - lo) / (hi - lo) * 64), 63) AS bin, sum(c) AS c, sum(t) AS t FROM g JOIN b USING (population) GROUP BY 1, 2),
m AS (SELECT population, max(c) AS pc, max(t) AS pt, sum(t) AS n FROM h GROUP BY 1)
SELECT population, round(100.0 * sum(greatest(0, t - c * pt / pc)) / max(n), 6) AS excess_percent FROM h JOIN m USING (population) GROUP BY 1""")
def histogram_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target has over the control on shared bins, scaled to its peak."""
    return K.histogram_excess(K.shared_histograms(_counts(spark, sf_dir), ["population"], 64), ["population"]).withColumn("excess_percent", _r("excess_percent"))


@registered(f"""WITH {_CURVES}, b AS (SELECT population, min(v) AS lo, max(v) AS hi FROM g GROUP BY 1),
h AS (SELECT population, least(floor((v - lo) / (hi - lo) * 16), 15)::INT AS bin, sum(c) AS c, sum(t) AS t FROM g JOIN b USING (population) GROUP BY 1, 2),
z AS (SELECT b.population, r.bin, coalesce(c, 0) AS c, coalesce(t, 0) AS t FROM b CROSS JOIN (SELECT CAST(unnest(range(16)) AS INT) AS bin) r LEFT JOIN h ON h.population = b.population AND h.bin = r.bin),
s AS (SELECT *, c / sum(c) OVER (PARTITION BY population) AS cs, t / sum(t) OVER (PARTITION BY population) AS ts FROM z)
SELECT population, bin, round(cs, 9) AS c_share, round(ts, 9) AS t_share, round(sum(cs) OVER w, 9) AS c_cdf, round(sum(ts) OVER w, 9) AS t_cdf, round(ts - cs, 9) AS difference FROM s WINDOW w AS (PARTITION BY population ORDER BY bin)""")
def comparison_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, cumulative fractions and differences by shared bin."""
    out = K.display_curves(K.shared_histograms(_counts(spark, sf_dir), ["population"], 16), ["population"])
    return out.select("population", "bin", *[_r(c, 9).alias(c) for c in ("c_share", "t_share", "c_cdf", "t_cdf", "difference")])


_PROBABILITY = """
e AS (SELECT event_type AS population, value AS v FROM events WHERE isfinite(value)),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, lag(v) OVER (ORDER BY v) AS w, count(*) OVER () AS n FROM e WHERE population = 'view'),
c AS (SELECT DISTINCT w / 2 + v / 2 AS cut FROM o WHERE w < v AND i IN (SELECT k * n // 32 FROM (SELECT max(n) AS n FROM o), (SELECT unnest(range(1, 32)) AS k))),
b AS (SELECT e.population, e.v, (SELECT count(*) FROM c WHERE cut <= e.v) AS bin FROM (SELECT DISTINCT population, v FROM e) e),
h AS (SELECT e.population, bin, count(*) AS n FROM e JOIN b USING (population, v) GROUP BY 1, 2),
a AS (SELECT bin, n AS c FROM h WHERE population = 'view'),
z AS (SELECT p.population, a.bin, c, coalesce(h.n, 0) AS t FROM (SELECT DISTINCT population FROM e WHERE population <> 'view') p CROSS JOIN a LEFT JOIN h ON h.population = p.population AND h.bin = a.bin),
s AS (SELECT *, c / sum(c) OVER (PARTITION BY population) AS fa, t / sum(t) OVER (PARTITION BY population) AS fb FROM z),
r AS (SELECT population, count(*) AS bins, min(c) AS least_control, sum(pow(fa - fb, 2) / nullif(fa + fb, 0)) AS x2, least(sum(c), sum(t)) AS ev FROM s GROUP BY 1)"""


@registered(f"""WITH {_PROBABILITY}
SELECT population, bins, least_control, round(x2, 9) AS chi_squared, round(greatest(0, (x2 - bins / ev) / (sqrt(bins) / ev)), 4) AS tx, round(greatest(0, (2 - bins / ev) / (sqrt(bins) / ev)), 4) AS most_tx FROM r""")
def probability_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi squared and T(X) over bins of equal control counts."""
    out = K.probability_binning(_counts(spark, sf_dir), ["population"], 32)
    return out.select("population", "bins", "least_control", _r("chi_squared", 9).alias("chi_squared"), _r("tx", 4).alias("tx"), _r("most_tx", 4).alias("most_tx"))


@registered("""
WITH e AS (SELECT event_type AS population, value AS v FROM events WHERE isfinite(value)), p AS (SELECT DISTINCT population FROM e),
u AS (SELECT p.population, e.v, (e.population <> p.population)::INT AS c, (e.population = p.population)::INT AS t FROM p, e),
g AS (SELECT population, v, sum(c) AS c, sum(t) AS t FROM u GROUP BY 1, 2), n AS (SELECT population, sum(c) AS nc, sum(t) AS nt FROM g GROUP BY 1),
f AS (SELECT population, nc, nt, sum(c) OVER w / nc AS fc, sum(t) OVER w / nt AS ft FROM g JOIN n USING (population) WINDOW w AS (PARTITION BY population ORDER BY v))
SELECT population, CAST(max(nc) AS BIGINT) AS n_control, CAST(max(nt) AS BIGINT) AS n, round(max(abs(fc - ft)), 9) AS ks_distance FROM f GROUP BY 1""")
def control_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each control sample against the pool of all others."""
    return K.leave_one_out_distances(_table(spark, sf_dir, "events"), "event_type", F.col("value")).select("population", "n_control", "n", _r("ks_distance", 9).alias("ks_distance"))


@registered("""
WITH c AS (SELECT event_id FROM events WHERE (event_type = 'view' AND value < 200) OR (event_type = 'view' AND value > 50)), t AS (SELECT event_id FROM events WHERE value >= 100)
SELECT (SELECT count(*) FROM c) AS n_a, (SELECT count(*) FROM t) AS n_b, (SELECT count(*) FROM c WHERE event_id IN (SELECT event_id FROM t)) AS shared""")
def shared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls pooled without repeats, and what they share with a target."""
    e = _table(spark, sf_dir, "events")
    view = F.col("event_type") == "view"
    pool = K.pooled_controls(e, ["event_id"], [view & (F.col("value") < 200), view & (F.col("value") > 50)])
    return K.shared_counts(pool, e.where("value >= 100"), ["event_id"])


_GROUPS = "SELECT o_orderpriority AS measure, o_orderstatus AS g, o_totalprice AS v, o_custkey % 400 AS pair FROM orders WHERE o_orderstatus IN ('F', 'O')"


@registered(f"""
WITH a AS ({_GROUPS}), m AS (SELECT measure, count(*) FILTER (WHERE g = 'F') AS na, count(*) FILTER (WHERE g = 'O') AS nb, avg(v) FILTER (WHERE g = 'F') AS ma, avg(v) FILTER (WHERE g = 'O') AS mb, var_samp(v) FILTER (WHERE g = 'F') AS va, var_samp(v) FILTER (WHERE g = 'O') AS vb,
 quantile_cont(v, 0.5) FILTER (WHERE g = 'F') - quantile_cont(v, 0.5) FILTER (WHERE g = 'O') AS md FROM a GROUP BY 1)
SELECT measure, na AS n_a, nb AS n_b, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(ma - mb, 4) AS mean_difference, round(md, 4) AS median_difference, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS statistic FROM m""")
def welch_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups for each measure; p-values and intervals are tested against tables."""
    o = _table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "measure", "o_orderstatus": "g"})
    out = K.compare_groups(o, "measure", "g", F.col("o_totalprice"), "F", "O", "welch")
    return out.select("measure", "n_a", "n_b", *[_r(c, 6 if c == "statistic" else 4).alias(c) for c in ("mean_a", "mean_b", "mean_difference", "median_difference", "statistic")])


@registered(f"""
WITH a AS ({_GROUPS}), r AS (SELECT measure, g, rank() OVER (PARTITION BY measure ORDER BY v) + (count(*) OVER (PARTITION BY measure, v) - 1) / 2.0 AS r FROM a)
SELECT measure, count(*) FILTER (WHERE g = 'F') AS n_a, count(*) FILTER (WHERE g = 'O') AS n_b, round(sum(r) FILTER (WHERE g = 'F') - count(*) FILTER (WHERE g = 'F') * (count(*) FILTER (WHERE g = 'F') + 1) / 2.0, 1) AS statistic FROM r GROUP BY 1""")
def rank_sum_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "measure", "o_orderstatus": "g"})
    return K.compare_groups(o, "measure", "g", F.col("o_totalprice"), "F", "O", "mann_whitney").select("measure", "n_a", "n_b", _r("statistic", 1).alias("statistic"))


_PAIRS = """
a AS (SELECT o_orderpriority AS measure, o_orderstatus AS g, c_nationkey AS pair, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3),
d AS (SELECT measure, max(v) FILTER (WHERE g = 'F') - max(v) FILTER (WHERE g = 'O') AS d FROM a GROUP BY measure, pair HAVING count(*) = 2)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = o.where(F.col("o_orderstatus").isin("F", "O")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("measure"), F.col("o_orderstatus").alias("g"), F.col("c_nationkey").alias("pair")).agg(F.avg("o_totalprice").alias("v"))


@registered(f"WITH {_PAIRS} SELECT measure, count(*) AS pairs, round(avg(d), 4) AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic FROM d GROUP BY 1")
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups joined by a pair key."""
    out = K.compare_groups(_paired(spark, sf_dir), "measure", "g", F.col("v"), "F", "O", "paired_t", "pair")
    return out.select("measure", "pairs", _r("mean_difference", 4).alias("mean_difference"), _r("statistic").alias("statistic"))


@registered(f"""WITH {_PAIRS}, r AS (SELECT measure, d, rank() OVER (PARTITION BY measure ORDER BY abs(d)) + (count(*) OVER (PARTITION BY measure, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0)
SELECT measure, CAST(count(*) AS BIGINT) AS pairs, round(least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)), 1) AS statistic FROM r GROUP BY 1""")
def signed_rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compare_groups(_paired(spark, sf_dir), "measure", "g", F.col("v"), "F", "O", "wilcoxon", "pair").select("measure", "pairs", _r("statistic", 1).alias("statistic"))


@registered("""
SELECT l_suppkey AS sample, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared,
 round(regr_r2(l_extendedprice, l_quantity) / (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 2), 3) AS f_statistic FROM lineitem GROUP BY 1""")
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares with its F test."""
    out = K.linear_fits(_table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "sample"), ["sample"], F.col("l_quantity"), F.col("l_extendedprice"))
    return out.select("sample", "n", _r("slope", 4).alias("slope"), _r("intercept", 3).alias("intercept"), _r("r_squared").alias("r_squared"), _r("f_statistic", 3).alias("f_statistic"))


@registered("""
WITH o AS (SELECT event_type AS sample, least(floor(value / 25), 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1, 2), e AS (SELECT *, avg(n) OVER (PARTITION BY sample) AS p FROM o)
SELECT sample, round(sqrt(avg(pow(n - p, 2))), 6) AS rmsd, round(sum(pow(n - p, 2) / p), 4) AS pearson, round(2 * sum(n * ln(n / p) - (n - p)), 4) AS deviance FROM e GROUP BY 1""")
def fit_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far counts lie from a flat prediction."""
    from pyspark.sql import Window

    from eventmill.operators import populations as P

    h = P.histogram(_table(spark, sf_dir, "events"), ["event_type"], F.col("value"), 0.0, 500.0, 20).withColumnRenamed("event_type", "sample")
    h = h.withColumn("p", F.avg("n").over(Window.partitionBy("sample")))
    return K.fit_diagnostics(h, ["sample"], "n", "p").select("sample", _r("rmsd").alias("rmsd"), _r("pearson", 4).alias("pearson"), _r("deviance", 4).alias("deviance"))


@registered(None)
def tree_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0's vectors as control of all others on three axes; the tests hold the tree against a plain one."""
    v = _table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(3)])
    return K.tree_comparison(v.where("label = 0"), v.where("label <> 0"), "label", ["x0", "x1", "x2"], 8)
