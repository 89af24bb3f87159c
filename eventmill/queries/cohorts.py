"""Queries of pooled cohorts, merged events, sources and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import cohorts as C, gates as G
from eventmill.queries.registry import registered, rounded as _r, table as _table


@registered("""
WITH m AS (SELECT l_quantity >= 10 AND l_quantity < 40 AS a, l_discount >= 0.02 AND l_discount < 0.07 AS b FROM lineitem),
c AS (SELECT count(*) AS t, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE a AND b) AS nb FROM m)
SELECT 'A' AS population, na AS n, round(100.0 * na / t, 6) AS pct_parent, round(100.0 * na / t, 6) AS pct_total, true AS complete FROM c UNION ALL SELECT 'B', nb, round(100.0 * nb / na, 6), round(100.0 * nb / t, 6), true FROM c UNION ALL SELECT 'C', NULL, NULL, NULL, false FROM c""")
def pooled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations over the whole cohort; one that is not mapped in every sample has no figures."""
    tree = [G.Gate("A", G.interval(F.col("l_quantity"), 10.0, 40.0)), G.Gate("B", G.interval(F.col("l_discount"), 0.02, 0.07), "A"), G.Gate("C", G.interval(F.col("l_tax"), 0.01, 0.05), "A")]
    rows = _table(spark, sf_dir, "lineitem")
    # C is missing in the trees of some samples
    flags = rows.select((F.col("l_suppkey") % 2 == 0).alias("has")).agg(F.min("has").alias("complete")).select(F.lit("C").alias("population"), "complete")
    return C.pooled_counts(rows, "l_suppkey", tree, flags).withColumns({"pct_parent": _r("pct_parent"), "pct_total": _r("pct_total")})


@registered("""
WITH c AS (SELECT l_suppkey AS sample, count(*) AS events, count(*) FILTER (WHERE l_quantity >= 30) AS selected FROM lineitem GROUP BY 1)
SELECT sample, row_number() OVER (ORDER BY sample) AS source, CAST(coalesce(sum(events) OVER (ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, events, selected FROM c
UNION ALL SELECT NULL, 0, 0, CAST(sum(events) AS BIGINT), CAST(sum(selected) AS BIGINT) FROM c""")
def pooled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source brings to a pooled view, where it begins, and the totals."""
    return C.source_counts(_table(spark, sf_dir, "lineitem"), "l_suppkey", G.interval(F.col("l_quantity"), 30.0))


@registered("""
SELECT row_number() OVER (ORDER BY event_type, event_id) - 1 AS merged_id, dense_rank() OVER (ORDER BY event_type) AS "CF_Source", event_id AS "CF_EventID", round(asinh(value / 5), 6) AS signal, dense_rank() OVER (ORDER BY event_type) AS code FROM events WHERE value >= 10""")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations of all sources as one table on a scale, with origins and a code for a keyword."""
    from eventmill.functions.columns import scale

    e = _table(spark, sf_dir, "events")
    out = C.merged(e, "event_type", "event_id", {"signal": _r(scale(F.col("value"), "asinh", cofactor=5.0)), "kind": F.col("event_type")}, F.col("value") >= 10, 1000)
    from pyspark.sql import Window

    names = e.select("event_type").distinct()
    samples = names.select(F.col("event_type").alias("sample"), F.row_number().over(Window.orderBy("event_type")).alias("position"), F.col("event_type").alias("keyword"))
    return C.with_code(out, samples, "kind", "keyword", "code").drop("kind")


@registered("""
WITH m AS (SELECT row_number() OVER (ORDER BY event_type, event_id) - 1 AS merged_id, event_type AS source_name, event_id AS "CF_EventID" FROM events) SELECT * FROM m WHERE merged_id >= 1000 AND merged_id < 1500""")
def origin_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a stretch of merged events comes from; the stretch is the feature."""
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "events")
    m = C.merged(e, "event_type", "event_id", {}, None, 1000)
    sources = e.select("event_type").distinct().select(F.row_number().over(Window.orderBy("event_type")).alias("CF_Source"), F.col("event_type").alias("name"))
    return C.origins(m, sources, 1000, 1500)


@registered("""
WITH d AS (SELECT event_type, event_id FROM events UNION ALL SELECT event_type, event_id FROM events WHERE value > 300)
SELECT dense_rank() OVER (ORDER BY event_type) AS "CF_Source", event_id AS "CF_EventID", times FROM (SELECT event_type, event_id, count(*) AS times FROM d GROUP BY 1, 2) QUALIFY times > 1""")
def repeated_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins that a merged table has twice."""
    e = _table(spark, sf_dir, "events")
    return C.unordered_origins(C.merged(e.unionByName(e.where("value > 300")), "event_type", "event_id", {}, None, 1000))


@registered("""
WITH p AS (SELECT s_suppkey AS sample, unnest(['a', 'b', 'c']) AS parameter, unnest(['raw', CASE WHEN s_suppkey % 50 = 1 THEN 'a * 2' ELSE 'a + 1' END, CASE WHEN s_suppkey = 5 THEN NULL ELSE 'raw' END]) AS definition FROM supplier)
SELECT parameter, min(definition) AS definition FROM p WHERE definition IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sample) = (SELECT count(*) FROM supplier) AND min(definition) = max(definition)""")
def common_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that every sample has with one definition."""
    i = F.col("s_suppkey")
    cells = F.array(F.struct(F.lit("a").alias("parameter"), F.lit("raw").alias("definition")), F.struct(F.lit("b").alias("parameter"), F.when(i % 50 == 1, "a * 2").otherwise("a + 1").alias("definition")), F.struct(F.lit("c").alias("parameter"), F.when(i != 5, "raw").alias("definition")))
    p = _table(spark, sf_dir, "supplier").select(i.alias("sample"), F.explode(cells).alias("c")).select("sample", "c.*").where("definition IS NOT NULL")
    return C.common_parameters(p)


@registered("""
WITH g AS (SELECT s_suppkey AS sample, 'g' || s_suppkey AS gate FROM supplier WHERE s_suppkey % 6 <> 0 UNION ALL SELECT s_suppkey, 'h' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 1),
c AS (SELECT sample, count(*) AS n, max(gate) AS gate FROM g GROUP BY 1)
SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 9 = 0 THEN CASE WHEN s_suppkey % 6 <> 0 THEN 'g' || s_suppkey END WHEN s_suppkey % 13 = 0 THEN NULL WHEN n = 1 THEN gate END AS gate,
 CASE WHEN s_suppkey % 9 = 0 THEN CASE WHEN s_suppkey % 6 <> 0 THEN 'overridden' ELSE 'unavailable' END WHEN s_suppkey % 13 = 0 THEN 'unavailable' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status
FROM supplier LEFT JOIN c ON c.sample = s_suppkey""")
def mapped_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path in every sample's tree: mapped, missing, ambiguous, overridden or unavailable."""
    i = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier")
    path = F.array(F.lit("A"), F.lit("B")).alias("path")
    gate = lambda k: F.concat(F.lit(k), i.cast("string")).alias("gate")
    gates = s.where(i % 6 != 0).select(i.alias("sample"), gate("g"), path).unionByName(s.where(i % 10 == 1).select(i.alias("sample"), gate("h"), path))
    overrides = s.where(i % 9 == 0).select(i.alias("sample"), gate("g"))
    gone = s.where(i % 13 == 0).select(i.alias("sample"))
    return C.mapped_populations(s.select(i.alias("sample")), gates, ["A", "B"], overrides, gone)


@registered("SELECT s_suppkey AS sample, CAST(floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 8) AS BIGINT) AS batch FROM supplier")
def sample_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_suppkey").alias("position"))
    return C.batches(s, 8).select("sample", "batch")


@registered("""
WITH s AS (SELECT s_suppkey AS sample, s_nationkey AS k, s_suppkey % 4 AS d FROM supplier), f AS (SELECT k, d, count(*) AS n, max(sample) AS sample FROM s GROUP BY 1, 2)
SELECT 'keyword:' || b.k AS batch, prototype, CASE WHEN n = 1 THEN f.sample END AS sample, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status
FROM (SELECT DISTINCT k FROM s) b CROSS JOIN (SELECT unnest(['one', 'two']) AS prototype, unnest([1, 2]) AS d) p LEFT JOIN f ON f.k = b.k AND f.d = p.d""")
def keyword_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each keyword value; prototypes meet the member with their discriminator."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 4).alias("d"))
    prototypes = s.where("d IN (1, 2)").select("d").distinct().select(F.when(F.col("d") == 1, "one").otherwise("two").alias("prototype"), "d")
    return C.keyword_batches(s, "k", "d", prototypes)


@registered("""
WITH a AS (SELECT l_suppkey AS sample, l_quantity AS signal, l_tax AS other FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL SELECT l_suppkey, l_extendedprice / 1000, l_discount FROM lineitem WHERE l_suppkey % 2 = 1)
SELECT sample, count(*) AS n, round(avg(signal), 6) AS signal, round(avg(other), 6) AS other FROM a GROUP BY 1""")
def harmonised_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two panels with names of their own as one."""
    l = _table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1000)
    even, odd = l.where("l_suppkey % 2 = 0"), l.where("l_suppkey % 2 = 1")
    out = C.harmonised([(even, {"sample": "l_suppkey", "signal": "l_quantity", "other": "l_tax"}), (odd, {"sample": "l_suppkey", "signal": "l_extendedprice", "other": "l_discount"})])
    return out.groupBy("sample").agg(F.count("*").alias("n"), _r(F.avg("signal")).alias("signal"), _r(F.avg("other")).alias("other"))


@registered("""
WITH b AS (SELECT s_suppkey AS sample, 'CD4' AS name, 'FL1' AS source FROM supplier WHERE s_suppkey % 2 = 0), a AS (SELECT s_suppkey AS sample, 'CD4' AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'FL2' ELSE 'FL1' END AS source FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT sample, name, b.source AS previous, a.source AS source, CASE WHEN b.source IS NULL THEN 'added' WHEN a.source IS NULL THEN 'removed' WHEN a.source = b.source THEN 'retained' ELSE 'rebound' END AS action FROM b FULL JOIN a USING (sample, name)""")
def alias_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier")
    before = s.where(i % 2 == 0).select(i.alias("sample"), F.lit("CD4").alias("name"), F.lit("FL1").alias("source"))
    after = s.where(i % 3 != 0).select(i.alias("sample"), F.lit("CD4").alias("name"), F.when(i % 5 == 0, "FL2").otherwise("FL1").alias("source"))
    return C.alias_review(before, after)


@registered("""
WITH s AS (SELECT s_suppkey AS sample, s_name AS sample_name, CASE s_suppkey % 3 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['a', 'b'] ELSE ['c'] END AS panel FROM supplier),
q AS (SELECT n_nationkey AS source, upper('Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0')) AS name, CASE WHEN n_nationkey % 2 = 0 THEN ['a', 'c'] ELSE ['b'] END AS requires FROM nation)
SELECT source, sample, lower(name) = lower(sample_name) AS name_matches FROM q, s WHERE list_has_all(panel, requires)""")
def suggested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose panel has all channels that a source requires."""
    i, k = F.col("s_suppkey"), F.col("n_nationkey")
    panel = F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(i % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    samples = _table(spark, sf_dir, "supplier").select(i.alias("sample"), F.col("s_name").alias("name"), panel.alias("panel"))
    requires = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b")))
    sources = _table(spark, sf_dir, "nation").select(k.alias("source"), F.upper(F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).alias("name"), requires.alias("requires"))
    return C.suggested_samples(sources, samples)


@registered("""
SELECT l_suppkey AS sample, count(*) AS n, round(avg(CASE WHEN l_suppkey % 3 = 0 THEN l_quantity WHEN l_suppkey % 3 = 1 THEN (l_quantity - 0.1 * l_tax * 100) / 0.98 END), 6) AS q,
 count(*) FILTER (WHERE l_suppkey % 3 = 2) AS undefined FROM lineitem GROUP BY 1""")
def compensation_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's own choice of matrix; outputs of a matrix that is not there are NaN, never raw."""
    import numpy as np

    from eventmill.functions.columns import compensate, finite

    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    c = compensate([q, t], np.array([[1.0, 0.2], [0.1, 1.0]]))
    k = F.col("l_suppkey") % 3
    choice = F.when(k == 0, "uncompensated").when(k == 1, "matrix").otherwise("gone")
    out = C.compensation_choice(_table(spark, sf_dir, "lineitem"), "l_suppkey", choice, {"uncompensated": {"q": q}, "matrix": {"q": c[0]}})
    return out.groupBy(F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("n"), _r(F.avg(finite(F.col("q")))).alias("q"), F.count_if(F.isnan("q")).alias("undefined"))


@registered("""
SELECT event_id, CASE WHEN value >= 50 THEN round(ln(value), 6) END AS fitted, value < 50 AS unmapped FROM events""")
def results_beside_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved result joined to its events; NaN where an event was not mapped."""
    e = _table(spark, sf_dir, "events")
    result = e.where("value >= 50").select("event_id", F.log("value").alias("fitted"))
    out = C.with_result(e, result, ["event_id"], ["fitted"])
    return out.select("event_id", _r(F.when(~F.isnan("fitted"), F.col("fitted"))).alias("fitted"), F.isnan("fitted").alias("unmapped"))


@registered("SELECT DISTINCT event_type AS sample FROM events WHERE event_id % 1000 = 7 AND value IS NOT NULL")
def changed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose content differs from a saved fingerprint, whatever the order of rows."""
    e = _table(spark, sf_dir, "events")
    saved = C.content_fingerprints(e.repartition(3), "event_type", ["event_id", "value"])
    edited = e.withColumn("value", F.when(F.col("event_id") % 1000 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return C.changed_samples(C.content_fingerprints(edited, "event_type", ["event_id", "value"]), saved)


@registered("""
WITH e AS (SELECT event_id, floor(event_id / 500) AS dataset, sha256(CAST(floor(event_id / 500) AS VARCHAR)) AS digest FROM events) SELECT CAST(dataset AS BIGINT) AS dataset, count(*) AS n FROM e WHERE dataset % 3 <> 0 GROUP BY 1""")
def new_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets that are not yet imported, by digest and place."""
    e = _table(spark, sf_dir, "events").withColumn("dataset", F.floor(F.col("event_id") / 500))
    e = e.withColumn("digest", F.sha2(F.col("dataset").cast("string"), 256))
    known = e.where("dataset % 3 = 0").select("digest", "dataset").distinct()
    return e.join(known, ["digest", "dataset"], "left_anti").groupBy("dataset").agg(F.count("*").alias("n"))


@registered("""
WITH e AS (SELECT event_type AS sample, CASE WHEN event_id % 41 = 0 THEN 'NaN'::DOUBLE ELSE value END AS a, CASE WHEN event_id % 59 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS b FROM events)
SELECT sample, count(*) AS rows, count(*) FILTER (WHERE NOT isfinite(a)) AS bad_a, count(*) FILTER (WHERE NOT isfinite(b)) AS bad_b FROM e GROUP BY 1""")
def nonfinite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each sample and the values of each column that are not finite."""
    from eventmill.sources.events import audit

    a = F.when(F.col("event_id") % 41 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    b = F.when(F.col("event_id") % 59 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return audit(_table(spark, sf_dir, "events").withColumns({"sample": F.col("event_type"), "a": a, "b": b}), "sample", ["a", "b"])
