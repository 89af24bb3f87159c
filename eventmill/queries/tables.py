"""Queries of statistics tables, formulas, pivots and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import gates as G, tables as T
from eventmill.queries.registry import registered, rounded as _r, table as _table

_X = "CASE WHEN l_discount = 0.07 THEN 'NaN'::DOUBLE ELSE l_extendedprice END"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_discount") == 0.07, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return _table(spark, sf_dir, "lineitem").withColumn("x", x)


def _tree() -> list[G.Gate]:
    return [G.Gate("A", G.interval(F.col("l_quantity"), 10.0, 40.0)), G.Gate("B", G.interval(F.col("l_discount"), 0.02, 0.07), "A")]


_TABLE = f"""
e AS (SELECT l_suppkey AS sample, {_X} AS x, l_quantity >= 10 AND l_quantity < 40 AS a, l_quantity >= 10 AND l_quantity < 40 AND l_discount >= 0.02 AND l_discount < 0.07 AS b FROM lineitem),
h AS (SELECT sample, 'All events' AS population, 0 AS place, x FROM e UNION ALL SELECT sample, 'A', 1, x FROM e WHERE a UNION ALL SELECT sample, 'B', 2, x FROM e WHERE b),
v AS (SELECT *, CASE WHEN isfinite(x) THEN x END AS v FROM h),
s AS (SELECT sample, population, place, count(*) AS n, count(v) AS nf, avg(v) AS mean, quantile_cont(v, 0.5) AS med, stddev_samp(v) AS sd, var_samp(v) AS var, exp(avg(ln(v))) AS gm, exp(stddev_samp(ln(v))) AS gs, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.9) AS p90 FROM v GROUP BY 1, 2, 3),
d AS (SELECT v.sample, v.population, quantile_cont(abs(v - med), 0.5) AS mad FROM v JOIN s ON v.sample = s.sample AND v.population = s.population GROUP BY 1, 2),
t AS (SELECT s.*, mad, max(CASE WHEN place = 0 THEN n END) OVER (PARTITION BY s.sample) AS total, max(CASE WHEN place = 1 THEN n END) OVER (PARTITION BY s.sample) AS na FROM s JOIN d ON s.sample = d.sample AND s.population = d.population)"""


@registered(f"""WITH {_TABLE}
SELECT sample, population, place, n AS events, round(100.0 * n / CASE place WHEN 2 THEN na ELSE total END, 6) AS of_parent, round(100.0 * n / total, 6) AS of_total, nf AS n_finite, n - nf AS n_bad, round(mean, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS sd, round(var, 1) AS variance,
 round(100 * sd / abs(mean), 6) AS cv, round(148.26 * mad / abs(med), 6) AS robust_cv, round(mad, 4) AS mad, round(gm, 4) AS geometric_mean, round(gs, 6) AS geometric_sd, round(lo, 4) AS least, round(hi, 4) AS most, round(p90, 4) AS p90 FROM t""")
def statistics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 17 statistics of the root and every population of every sample."""
    x = F.col("x")
    of = {"n_finite": "finite_count", "n_bad": "nonfinite_count", "mean": "mean", "median": "median", "sd": "std", "variance": "variance", "cv": "cv", "robust_cv": "robust_cv", "mad": "mad", "geometric_mean": "geometric_mean", "geometric_sd": "geometric_std", "least": "min", "most": "max"}
    columns = [T.Statistic("events"), T.Statistic("of_parent", "percent_parent"), T.Statistic("of_total", "percent_total"), *[T.Statistic(n, s, x) for n, s in of.items()], T.Statistic("p90", "percentile", x, 90.0)]
    out = T.statistics_table(_rows(spark, sf_dir), "l_suppkey", _tree(), columns).drop("path")
    digits = {"of_parent": 6, "of_total": 6, "cv": 6, "robust_cv": 6, "geometric_sd": 6, "variance": 1}
    return out.select(*[_r(c, digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@registered(f"""WITH {_TABLE}
SELECT sample, population, n AS events, round(med, 4) AS median, max(n) FILTER (WHERE sample = 3) OVER (PARTITION BY population) AS control_events FROM t""")
def control_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with the value of the same population in the control sample."""
    columns = [T.Statistic("events"), T.Statistic("median", "median", F.col("x")), T.Statistic("control_events", control=3)]
    return T.statistics_table(_rows(spark, sf_dir), "l_suppkey", _tree(), columns).select("sample", "population", "events", _r("median", 4).alias("median"), "control_events")


@registered(f"""WITH {_TABLE}, o AS (SELECT *, row_number() OVER (ORDER BY sample, place) - 1 AS position FROM t),
c AS (SELECT population, max(med) AS cm FROM t WHERE sample = 3 GROUP BY 1), g AS (SELECT avg(mean) AS m, stddev_samp(mean) AS s, quantile_cont(mean, 0.5) AS q, count(mean) AS k, sum(n) AS sn FROM t), f AS (SELECT n AS n5 FROM o WHERE position = 4)
SELECT sample, population, position, round(med / cm, 6) AS over_control, round((mean - m) / s, 6) AS z, round(n - lag(n) OVER (ORDER BY position), 6) AS step, round(n * 1.0 / n5, 6) AS over_fifth,
 CAST(CASE WHEN n > 100 AND NOT population = 'B' THEN 1 ELSE 0 END AS DOUBLE) AS chosen, round(100.0 * n / sn + k + sinh(0.01 * q / q), 6) AS mixed FROM o LEFT JOIN c USING (population), g, f""")
def table_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over the rows of a table: control, offset, row, whole-column figures and conditions."""
    t = T.statistics_table(_rows(spark, sf_dir), "l_suppkey", _tree(), [T.Statistic("n"), T.Statistic("med", "median", F.col("x")), T.Statistic("mean", "mean", F.col("x"))])
    t = T.ordered(t)
    formulas = {
        "over_control": 'col("med") / control("med", "3")',
        "z": '(col("mean") - mean(col("mean"))) / sd(col("mean"))',
        "step": 'col("n") - offset("n", -1)',
        "over_fifth": 'col("n") / row("n", 5)',
        "chosen": 'ifelse(col("n") > 100 and not col("population") == "B", 1, 0)',
        "mixed": '100 * col("n") / sum(col("n")) + n(col("mean")) + sinh(0.01 * median(col("mean")) / median(col("mean")))',
    }
    for name, text in formulas.items():
        t = T.with_formula(t, name, text)
    return t.select("sample", "population", "position", *[_r(n).alias(n) for n in formulas])


@registered("""
WITH v AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, c_mktsegment AS segment, o_totalprice AS price, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT priority, status, segment, 'price' AS measure, price AS x FROM v UNION ALL SELECT priority, status, segment, 'balance', balance FROM v),
g AS (SELECT priority, status, segment, measure, stddev_samp(x) AS value, count(x) AS n FROM l GROUP BY 1, 2, 3, 4)
SELECT a.priority, b.status, b.segment, m.measure, round(value, 4) AS value, coalesce(n, 0) AS n FROM (SELECT DISTINCT priority FROM v) a CROSS JOIN (SELECT DISTINCT status, segment FROM v) b CROSS JOIN (SELECT unnest(['price', 'balance']) AS measure) m LEFT JOIN g USING (priority, status, segment, measure)""")
def pivoted_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row and two column dimensions, two measures, standard deviations with their counts."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"))
    return T.pivot_measures(rows, ["priority"], ["status", "segment"], ["price", "balance"], "std").withColumn("value", _r("value", 4))


@registered("""
WITH t AS (SELECT s_name AS name, n_name AS nation, CASE WHEN s_acctbal > 0 THEN round(s_acctbal, 2) END AS balance, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT name, nation, balance, count(*) OVER () AS total FROM t ORDER BY balance DESC NULLS LAST, position LIMIT 20 OFFSET 10""")
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a sorted table, missing values last, with the total of all rows; the page is the feature."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.when(F.col("s_acctbal") > 0, _r("s_acctbal", 2)).alias("balance"), F.col("s_suppkey").alias("position"))
    return T.page(rows, "balance", 10, 20, descending=True).select("name", "nation", "balance", "total")


@registered(f"""WITH {_TABLE} SELECT unnest(['events', 'median', 'mean']) AS name, unnest([min(n)::DOUBLE, round(min(med), 4), round(min(mean), 4)]) AS least, unnest([max(n)::DOUBLE, round(max(med), 4), round(max(mean), 4)]) AS most FROM t""")
def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.statistics_table(_rows(spark, sf_dir), "l_suppkey", _tree(), [T.Statistic("events"), T.Statistic("median", "median", F.col("x")), T.Statistic("mean", "mean", F.col("x"))])
    return T.column_ranges(t, ["events", "median", "mean"]).select("name", _r("least", 4).alias("least"), _r("most", 4).alias("most"))


_KEYWORDS = """
k AS (SELECT s_suppkey AS sample, 'metadata' AS source, CASE WHEN s_suppkey % 3 = 0 THEN '$Nation' ELSE 'NATION' END AS key, n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0
 UNION ALL SELECT s_suppkey, 'metadata', 'nation', 'other' FROM supplier WHERE s_suppkey % 11 = 0 UNION ALL SELECT s_suppkey, 'metadata', '$NATION', 'more' FROM supplier WHERE s_suppkey % 22 = 0
 UNION ALL SELECT s_suppkey, 'tags', 'Nation', 'tagged' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'tags', 'balance', CASE WHEN s_suppkey % 4 = 0 THEN 'n/a' ELSE CAST(s_acctbal AS VARCHAR) END FROM supplier)"""


def _keywords(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    i = F.col("s_suppkey")
    named = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    row = lambda df, source, key, value: df.select(i.alias("sample"), F.lit(source).alias("source"), key.alias("key"), value.alias("value"))
    parts = [
        row(named.where(i % 7 != 0), "metadata", F.when(i % 3 == 0, "$Nation").otherwise("NATION"), F.col("n_name")),
        row(s.where(i % 11 == 0), "metadata", F.lit("nation"), F.lit("other")),
        row(s.where(i % 22 == 0), "metadata", F.lit("$NATION"), F.lit("more")),
        row(s.where(i % 5 == 0), "tags", F.lit("Nation"), F.lit("tagged")),
        row(s, "tags", F.lit("balance"), F.when(i % 4 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return s.select(i.alias("sample")), out


@registered(f"""WITH {_KEYWORDS},
c AS (SELECT sample, source, max(value) FILTER (WHERE key = 'nation') AS ex, count(*) FILTER (WHERE key = 'nation') AS ne, count(*) AS n, max(value) AS one FROM k WHERE lower(ltrim(key, '$')) = 'nation' GROUP BY 1, 2),
f AS (SELECT sample, arg_min(struct_pack(ex, ne, n, one), CASE source WHEN 'tags' THEN 1 ELSE 2 END) AS r FROM c GROUP BY 1),
b AS (SELECT sample, max(TRY_CAST(value AS DOUBLE)) AS balance FROM k WHERE key = 'balance' GROUP BY 1)
SELECT s_suppkey AS sample, CASE WHEN r.ne > 0 THEN r.ex WHEN r.n = 1 THEN r.one END AS nation, CASE WHEN r IS NULL THEN 'missing' WHEN r.ne = 0 AND r.n > 1 THEN 'ambiguous' END AS issue, round(balance, 4) AS balance, CASE WHEN balance IS NULL THEN 'not a number' END AS balance_issue
FROM supplier LEFT JOIN f ON f.sample = s_suppkey LEFT JOIN b ON b.sample = s_suppkey""")
def keyword_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by exact key, then without case and $, tags before metadata; every sample has its row."""
    samples, keywords = _keywords(spark, sf_dir)
    nation = T.keyword_column(samples, keywords, "nation").withColumnsRenamed({"value": "nation"})
    balance = T.keyword_column(samples, keywords, "tag:balance", numeric=True).withColumnsRenamed({"value": "balance", "issue": "balance_issue"})
    return nation.join(balance, "sample").select("sample", "nation", "issue", _r("balance", 4).alias("balance"), "balance_issue")


@registered(f"""WITH {_KEYWORDS} SELECT 'nation' AS name, 'missing' AS message, count(*) AS rows FROM supplier WHERE s_suppkey NOT IN (SELECT sample FROM k WHERE lower(ltrim(key, '$')) = 'nation') HAVING count(*) > 0
UNION ALL SELECT 'nation', 'ambiguous', count(*) FROM (SELECT sample FROM k WHERE lower(ltrim(key, '$')) = 'nation' GROUP BY 1 HAVING count(*) FILTER (WHERE source = 'tags') = 0 AND count(*) FILTER (WHERE key = 'nation') = 0 AND count(*) > 1) HAVING count(*) > 0""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, keywords = _keywords(spark, sf_dir)
    return T.status_tally(T.keyword_column(samples, keywords, "nation").withColumnRenamed("issue", "nation"), ["nation"])


@registered("""
WITH c AS (SELECT l_suppkey AS sample, count(*) AS n FROM lineitem WHERE l_quantity >= 10 GROUP BY 1), r AS (SELECT l_suppkey AS sample, count(*) FILTER (WHERE l_quantity >= 10) + (l_suppkey % 10 = 0)::INT AS reported FROM lineitem GROUP BY 1)
SELECT r.sample, n, CAST(reported AS BIGINT) AS reported FROM r LEFT JOIN c USING (sample) WHERE n IS DISTINCT FROM reported""")
def reconciled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported counts that differ from those of the populations."""
    l = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "sample")
    computed = l.where("l_quantity >= 10").groupBy("sample").agg(F.count("*").alias("n"))
    reported = l.groupBy("sample").agg(F.count_if(F.col("l_quantity") >= 10).alias("n")).withColumn("n", F.col("n") + (F.col("sample") % 10 == 0).cast("int"))
    return T.reconciled(computed, reported, ["sample"])


@registered("""
SELECT CASE WHEN regexp_matches(p, '^\\s*[=+@\\t\\r-]') THEN '''' || p ELSE p END AS label, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN '=' WHEN 1 THEN '  -' WHEN 2 THEN chr(9) ELSE '' END || p_type AS p FROM part) GROUP BY 1""")
def safe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of an export that no spreadsheet takes for a formula."""
    k = F.col("p_size") % 5
    label = F.concat(F.when(k == 0, "=").when(k == 1, "  -").when(k == 2, "\t").otherwise(""), F.col("p_type"))
    rows = _table(spark, sf_dir, "part").select(label.alias("label"), F.col("p_size").alias("hidden"))
    return T.export_columns(rows, hidden=("hidden",)).groupBy("label").agg(F.count("*").alias("n"))
