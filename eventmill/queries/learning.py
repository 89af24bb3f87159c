"""Queries of learning on vectors with many channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import learning as L
from eventmill.queries.registry import registered, rounded as _r, table as _table


def _vectors(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(n)])


@registered("""
WITH l AS (SELECT unnest(['x0', 'x1', 'x2', 'one']) AS feature, unnest([embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, 1.0]) AS v FROM embeddings)
SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, stddev_pop(v) > greatest(abs(avg(v)), 1) * 1e-12 AS varies FROM l GROUP BY 1""")
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, deviations, and whether a feature varies at all."""
    out = L.feature_statistics(_vectors(spark, sf_dir), {"x0": F.col("x0"), "x1": F.col("x1"), "x2": F.col("x2"), "one": F.lit(1.0)})
    return out.select("feature", "n", _r("mean").alias("mean"), _r("sd").alias("sd"), "varies")


@registered("""
SELECT label, count(*) AS n, round(covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE), 9) AS c01, round(var_pop(embedding[1]::DOUBLE), 9) AS v0, round(2 * ln(max(embedding[1]::DOUBLE) - min(embedding[1]::DOUBLE)) + ln(var_pop((embedding[1]::DOUBLE) / 1.0) / pow(max(embedding[1]::DOUBLE) - min(embedding[1]::DOUBLE), 2)), 6) AS log_variance FROM embeddings GROUP BY 1""")
def covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances by label, by sums that each task makes of its rows."""
    v = _vectors(spark, sf_dir)
    out = []
    for (label,) in v.select("label").distinct().collect():  # labels are few
        mine = v.where(F.col("label").eqNullSafe(F.lit(label)))
        n, _, cov = L.moments(mine, ["x0", "x1"])
        log = L.log_variances(mine, ["x0"]).first().log_variance
        out.append((label, n, float(cov[0, 1]), float(cov[0, 0]), log))
    rows = spark.createDataFrame(out, "label int, n long, c01 double, v0 double, log_variance double")
    return rows.select("label", "n", _r("c01", 9).alias("c01"), _r("v0", 9).alias("v0"), _r("log_variance").alias("log_variance"))


@registered(None)
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first two components of all 64 channels; the tests hold them against a full decomposition."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(64)])
    out, _ = L.principal_components(v, [f"x{k}" for k in range(64)])
    return out.select("vec_id", "PC1", "PC2")


_CODES = np.array([[0.1 * ((7 * i + 3 * j) % 5 - 2) for j in range(4)] for i in range(6)])


@registered(f"""
WITH c AS (SELECT unnest({[i + 1 for i in range(6)]}) AS code, unnest({[list(map(float, r)) for r in _CODES.round(6)]}) AS w),
d AS (SELECT vec_id, code, list_sum([pow(embedding[k]::DOUBLE - w[k], 2) for k in range(1, 5)]) AS d FROM embeddings, c)
SELECT vec_id, CAST(arg_min(code, d) AS INT) AS code, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's closest of a few codes."""
    out = L.nearest_code(_vectors(spark, sf_dir), [f"x{k}" for k in range(4)], _CODES.round(6))
    return out.select("vec_id", "code", _r("distance").alias("distance"))


_KNN = """
d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_sum([pow(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE, 2) for k in range(1, 65)]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM d QUALIFY rank <= 6)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_neighbours(_table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), 6)


@registered(f"WITH {_KNN} SELECT id, neighbour, CAST(rank AS INT) AS rank FROM k")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six closest other vectors of each vector."""
    return _neighbours(spark, sf_dir)


@registered(f"""WITH {_KNN}, j AS (SELECT a.id AS u, a.neighbour AS v, count(*) AS c FROM k a JOIN k b ON b.id = a.id JOIN k c ON c.id = a.neighbour AND c.neighbour = b.neighbour GROUP BY 1, 2)
SELECT least(u, v) AS u, greatest(u, v) AS v, round(sum(c / (12.0 - c)) / 2, 9) AS weight FROM j GROUP BY 1, 2""")
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges weighted by common neighbours."""
    return L.neighbour_graph(_neighbours(spark, sf_dir), 6).withColumn("weight", _r("weight", 9))


@registered(None)
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the neighbour graph; the tests recover separated groups."""
    v = _table(spark, sf_dir, "embeddings")
    graph = L.neighbour_graph(_neighbours(spark, sf_dir), 6)
    return L.communities(graph, v.select(F.col("vec_id").alias("id")), minimum=5, restarts=5)


@registered(None)
def map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by metacluster of a self-organizing map, for each label; the tests recover separated groups."""
    v = _vectors(spark, sf_dir, 64)
    columns = [f"x{k}" for k in range(64)]
    codes = L.self_organizing_map(v, columns)
    out = L.with_metaclusters(L.nearest_code(v, columns, codes), L.consensus_clusters(codes, 10))
    return L.cluster_counts(out, "label", "metacluster")


@registered("""
WITH c AS (SELECT label AS sample, CAST(vec_id % 3 AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT sample, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY sample), 6) AS percent FROM c""")
def cluster_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").withColumn("kind", F.col("vec_id") % 3)
    return L.cluster_counts(v, "label", "kind").withColumn("percent", _r("percent"))
