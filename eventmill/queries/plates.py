"""Queries of plates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import plates as P
from eventmill.queries.registry import registered, rounded as _r, table as _table

_WELL = "chr(CAST(65 + l_suppkey % 8 AS INT)) || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE ' 0' END || CAST(l_suppkey // 8 % 12 + 1 AS VARCHAR)"
_CANON = "chr(CAST(65 + k % 8 AS INT)) || lpad(CAST(k // 8 % 12 + 1 AS VARCHAR), 2, '0')"


def _written(k):
    """Wells as people write them."""
    mark = F.when(k % 3 == 0, "").when(k % 3 == 1, "-").otherwise(" 0")
    return F.concat(F.char(65 + k % 8), mark, (F.floor(k / 8) % 12 + 1).cast("string"))


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("sample"), P.canonical_well(_written(k)).alias("well"))


@registered(f"""
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 17 = 0 THEN 'Z99x' WHEN s_suppkey % 19 = 0 THEN 'AF48' ELSE {_CANON.replace('k', 's_suppkey').replace('chr(CAST', 'chr(CAST')} END AS w, s_suppkey % 2 AS plate FROM supplier),
g AS (SELECT *, w <> 'Z99x' AS good FROM s), f AS (SELECT plate, max(w = 'AF48' AND good) AS big FROM g GROUP BY 1), n AS (SELECT plate, w, count(*) AS n FROM g WHERE good GROUP BY 1, 2)
SELECT 'plate ' || g.plate AS plate, CASE WHEN good THEN g.w END AS well, k AS sample, CASE WHEN big THEN 1536 ELSE 96 END AS format, CASE WHEN NOT good THEN 'not a well' WHEN n.n > 1 THEN 'several samples' END AS issue
FROM g JOIN f USING (plate) LEFT JOIN n ON n.plate = g.plate AND n.w = g.w AND good""")
def discovered_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples placed by their well keyword, with what keeps some from it."""
    k = F.col("s_suppkey")
    well = F.when(k % 17 == 0, "Z99x").when(k % 19 == 0, "AF48").otherwise(_written(k))
    rows = _table(spark, sf_dir, "supplier").select(k.alias("sample"), F.concat(F.lit("plate "), (k % 2).cast("string")).alias("plate"), well.alias("well"))
    return P.discover(rows)


_MEASURES = f"""
m AS (SELECT l_suppkey AS k, avg(l_quantity) AS q, CASE WHEN l_suppkey % 9 <> 0 THEN avg(l_extendedprice) END AS p FROM lineitem GROUP BY 1),
l AS (SELECT {_CANON} AS well, 'quantity' AS measure, q AS v FROM m UNION ALL SELECT {_CANON}, 'price', p FROM m),
w AS (SELECT well, measure, quantile_cont(v, 0.5) AS value, count(v) AS available, count(*) AS replicates FROM l GROUP BY 1, 2)"""


def _measured(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    m = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(F.avg("l_quantity").alias("quantity"), F.when(F.col("sample") % 9 != 0, F.avg("l_extendedprice")).alias("price"))
    long = m.select("sample", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in ("quantity", "price")])).alias("c")).select("sample", "c.*")
    return P.well_measures(_assignments(spark, sf_dir), long, "median", strict)


@registered(f"""WITH {_MEASURES}
SELECT well, measure, round(CASE WHEN available = replicates THEN value END, 4) AS value, available, replicates, CASE WHEN available = 0 THEN 'undefined' WHEN available < replicates THEN 'replicates missing' END AS issue FROM w""")
def well_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of a well's samples, none where a replicate is missing."""
    return _measured(spark, sf_dir, True).withColumn("value", _r("value", 4))


@registered(f"""WITH {_MEASURES}, d AS (SELECT measure, CASE WHEN measure = 'quantity' THEN 24.0 ELSE min(value) END AS low, CASE WHEN measure = 'quantity' THEN 26.5 ELSE max(value) END AS high FROM w GROUP BY 1)
SELECT well, measure, round(CASE WHEN value IS NOT NULL THEN greatest(0, least(1, (value - low) / (high - low))) END, 6) AS fraction, coalesce(value < low OR value > high, false) AS clipped FROM w JOIN d USING (measure)""")
def well_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the domain of their measure, one of them given."""
    m = _measured(spark, sf_dir, False)
    given = m.where("measure = 'quantity'").select("measure").distinct().select("measure", F.lit(24.0).alias("low"), F.lit(26.5).alias("high"))
    return P.normalised(m, given).select("well", "measure", _r("fraction").alias("fraction"), "clipped")


@registered(f"""
WITH s AS (SELECT s_suppkey AS k, s_nationkey % 3 AS c FROM supplier) SELECT {_CANON} AS well, CASE WHEN min(c) = max(c) THEN 'class ' || min(c) ELSE '<mixed>' END AS label FROM s GROUP BY 1""")
def well_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.concat(F.lit("class "), (F.col("s_nationkey") % 3).cast("string")).alias("label"))
    return P.well_labels(_assignments(spark, sf_dir), labels)


@registered(f"""
WITH p AS (SELECT {_CANON} AS well, k AS sample, k FROM (SELECT s_suppkey AS k FROM supplier)),
a AS (SELECT well, 'dose' AS key, CASE WHEN substr(well, 1, 1) = 'A' THEN NULL ELSE substr(well, 2) END AS after FROM (SELECT DISTINCT well FROM p) UNION ALL SELECT 'H13', 'dose', '1'),
t AS (SELECT s_suppkey AS sample, 'dose' AS key, CASE WHEN s_suppkey % 4 = 0 THEN '05' WHEN s_suppkey % 4 = 1 THEN '' ELSE lpad(CAST(s_suppkey // 8 % 12 + 1 AS VARCHAR), 2, '0') END AS before FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT a.well, p.sample, a.key, before, after, CASE WHEN p.sample IS NULL THEN 'empty' WHEN before IS NOT DISTINCT FROM after OR coalesce(before, '') <> '' THEN 'unchanged' WHEN after IS NULL THEN 'delete' ELSE 'set' END AS change
FROM a LEFT JOIN p ON p.well = a.well LEFT JOIN t ON t.sample = p.sample AND t.key = a.key""")
def annotation_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned annotations against the tags that samples have; only missing or blank ones are filled."""
    a = _assignments(spark, sf_dir)
    planned = a.select("well").distinct().select("well", F.lit("dose").alias("key"), F.when(F.substring("well", 1, 1) != "A", F.substring("well", 2, 9)).alias("value"))
    planned = planned.unionByName(planned.agg(F.lit("H13").alias("well"), F.lit("dose").alias("key"), F.lit("1").alias("value")))
    k = F.col("s_suppkey")
    tags = _table(spark, sf_dir, "supplier").where(k % 5 != 0).select(k.alias("sample"), F.lit("dose").alias("key"), F.when(k % 4 == 0, "05").when(k % 4 == 1, "").otherwise(F.lpad((F.floor(k / 8) % 12 + 1).cast("string"), 2, "0")).alias("value"))
    return P.annotation_review(planned, a, tags, fill_missing=True)


@registered("""
WITH w AS (SELECT l_suppkey AS k, CAST(round(avg(l_quantity), 2) AS DECIMAL(18,8)) AS start FROM lineitem GROUP BY 1)
SELECT k AS sample, CAST(k % 4 AS BIGINT) AS step, CAST(CASE k % 4 WHEN 0 THEN start WHEN 1 THEN start * 0.5 WHEN 2 THEN start * 0.25 ELSE start * 0.125 END AS DOUBLE) AS value FROM w""")
def dilutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halving dilutions from each sample's own start, in exact decimals."""
    w = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(_r(F.avg("l_quantity"), 2).alias("start")).withColumn("step", F.col("sample") % 4)
    return P.dilution_of(w, F.col("start"), F.lit(0.5), F.col("step").cast("int")).select("sample", "step", F.col("value").cast("double").alias("value"))


@registered("""
WITH k AS (SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 2 = 0 THEN 'Plate ID' ELSE 'PLATE_ID' END AS key, ' P' || s_nationkey || ' ' AS value FROM supplier UNION ALL SELECT s_suppkey, 'plate-id', 'other' FROM supplier WHERE s_suppkey % 10 = 0)
SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 10 <> 0 THEN 'P' || s_nationkey END AS value, CASE WHEN s_suppkey % 10 = 0 THEN 'conflicting' END AS issue FROM supplier""")
def plate_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by letters and digits alone; different values conflict."""
    s, k = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    words = s.select(k.alias("sample"), F.lit("metadata").alias("source"), F.when(k % 2 == 0, "Plate ID").otherwise("PLATE_ID").alias("key"), F.concat(F.lit(" P"), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("value"))
    words = words.unionByName(s.where(k % 10 == 0).select(k.alias("sample"), F.lit("metadata").alias("source"), F.lit("plate-id").alias("key"), F.lit("other").alias("value")))
    return P.plate_keyword(s.select(k.alias("sample")), words, "plate id")


@registered(f"""
WITH p AS (SELECT {_CANON} AS well, k FROM (SELECT s_suppkey AS k FROM supplier)) SELECT well IN (SELECT well FROM p WHERE substr(well, 1, 1) < 'E' AND CAST(substr(well, 2) AS INT) <= 6) AS kept, count(*) AS samples FROM p GROUP BY 1""")
def resized_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plate of 4 x 6 wells keeps of a plate of 96."""
    kept, gone = P.resized(_assignments(spark, sf_dir), 4, 6)
    part = lambda rows, flag: rows.groupBy(F.lit(flag).alias("kept")).agg(F.count("*").alias("samples"))
    return part(kept, True).unionByName(part(gone, False))
