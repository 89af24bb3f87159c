"""Queries of clocks, acquisition quality and time courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventmill.operators import acquisition as A, gates as G, kinetics as K
from eventmill.queries.registry import RESET_SECONDS, SECONDS, registered, reset_seconds, rounded as _r, seconds, table as _table

#: A clock that runs slowly for a while, so that rates differ.
_SLOW = f"{SECONDS} + 900 * greatest(0, least(event_id - 6000, 700))"


def _slow():
    return seconds() + 900 * F.greatest(F.lit(0), F.least(F.col("event_id") - 6000, F.lit(700)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a signal that is NaN for every 97th id and jumps for some."""
    x = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id").between(3000, 3500), F.col("value") + 400).otherwise(F.col("value"))
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), "event_id", "ts", "value", x.alias("x"))


_E = "(SELECT event_type AS sample, event_id, ts, value, CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE WHEN event_id BETWEEN 3000 AND 3500 THEN value + 400 ELSE value END AS x FROM events)"


@registered(f"""
WITH e AS (SELECT sample, event_id, {RESET_SECONDS} AS t FROM {_E}),
d AS (SELECT sample, t, isfinite(t) AND t >= 0 AS valid, CASE WHEN isfinite(t) AND t >= 0 AND lag(t) OVER w >= 0 THEN t - lag(t) OVER w END AS step FROM e WINDOW w AS (PARTITION BY sample ORDER BY event_id)),
k AS (SELECT sample, quantile_cont(step, 0.5) AS tick FROM d WHERE step > 0 GROUP BY 1)
SELECT sample, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE step < 0) AS resets, count(*) FILTER (WHERE step = 0) AS repeats, count(*) FILTER (WHERE step > 20 * tick) AS gaps,
 round(max(tick), 4) AS tick, round(max(step) FILTER (WHERE step > 0), 4) AS largest_step, round(sum(step) FILTER (WHERE step > 0), 3) AS duration FROM d JOIN k USING (sample) GROUP BY 1""")
def time_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each sample's clock in the order of events."""
    return A.time_diagnostics(_events(spark, sf_dir), "sample", reset_seconds()).withColumns({"tick": _r("tick", 4), "largest_step": _r("largest_step", 4), "duration": _r("duration", 3)})


@registered(f"""
WITH e AS (SELECT sample, event_id, {RESET_SECONDS} AS t FROM {_E}),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY sample ORDER BY event_id) AS step FROM e),
k AS (SELECT sample, quantile_cont(step, 0.5) AS tick FROM d WHERE step > 0 GROUP BY 1)
SELECT event_id, sample, round(2 * (t + coalesce(sum(CASE WHEN step < 0 THEN tick - step ELSE 0 END) OVER (PARTITION BY sample ORDER BY event_id), 0)) + 5, 2) AS clock FROM d JOIN k USING (sample)""")
def calibrated_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resets unwrapped, then multiplied and moved."""
    return A.unwrapped_clock(_events(spark, sf_dir), "sample", reset_seconds(), "unwrap", 2.0, F.lit(5.0)).select("event_id", "sample", _r("clock", 2).alias("clock"))


_RATES = f"""
e AS (SELECT sample, event_id, {_SLOW} AS t FROM {_E}),
z AS (SELECT sample, min(event_id) AS e0, greatest(200, ceil((max(event_id) - min(event_id) + 1) / 1024.0)) AS size FROM e GROUP BY 1),
d AS (SELECT sample, event_id, t, CAST(floor((event_id - e0) / size) AS BIGINT) AS bin, t - lag(t) OVER (PARTITION BY sample ORDER BY event_id) AS step FROM e JOIN z USING (sample)),
k AS (SELECT sample, quantile_cont(step, 0.5) AS tick FROM d WHERE step > 0 GROUP BY 1),
b AS (SELECT sample, bin, count(*) AS n, arg_min(t, event_id) AS t0, arg_max(t, event_id) AS t1 FROM d GROUP BY 1, 2),
r AS (SELECT *, n / nullif(coalesce(lead(t0) OVER (PARTITION BY sample ORDER BY bin), t1 + tick) - t0, 0) AS rate FROM b JOIN k USING (sample)),
l AS (SELECT *, CASE WHEN n >= 50 AND count(*) FILTER (WHERE n >= 50) OVER (PARTITION BY sample) >= 8 THEN ln(rate) END AS lr FROM r),
m AS (SELECT sample, quantile_cont(lr, 0.5) AS c FROM l GROUP BY 1),
s AS (SELECT sample, quantile_cont(abs(lr - c), 0.5) AS mad FROM l JOIN m USING (sample) GROUP BY 1),
o AS (SELECT l.sample, bin, n, rate, lr, c, abs(lr - c) / greatest(1.4826 * mad, ln(1.5) / 5) AS score FROM l JOIN m ON l.sample IS NOT DISTINCT FROM m.sample JOIN s ON l.sample IS NOT DISTINCT FROM s.sample)"""


@registered(f"""WITH {_RATES}
SELECT sample, bin, n, round(rate, 6) AS rate, round(score, 4) AS rate_score, coalesce(score > 5 AND abs(lr - c) >= ln(1.5), false) AS rate_outlier FROM o""")
def rate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rates of acquisition bins, and those that are odd by score and by fold."""
    binned = A.with_bins(_events(spark, sf_dir), "sample", 200)
    return A.rate_bins(binned, "sample", _slow()).select("sample", "bin", "n", _r("rate").alias("rate"), _r("rate_score", 4).alias("rate_score"), "rate_outlier")


_SIGNALS = f"""
e AS (SELECT sample, event_id, CASE WHEN isfinite(x) AND value >= 1 THEN x END AS v FROM {_E}),
z AS (SELECT sample, min(event_id) AS e0, greatest(200, ceil((max(event_id) - min(event_id) + 1) / 1024.0)) AS size FROM e GROUP BY 1),
b AS (SELECT sample, CAST(floor((event_id - e0) / size) AS BIGINT) AS bin, count(v) AS finite_count, quantile_cont(v, [0.1, 0.5, 0.9]) AS q FROM e JOIN z USING (sample) GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN finite_count >= 20 AND count(*) FILTER (WHERE finite_count >= 20) OVER (PARTITION BY sample) >= 8 THEN q END AS k FROM b),
w AS (SELECT sample, quantile_cont(k[3] - k[1], 0.5) AS shift, quantile_cont(k[1], 0.5) AS c1, quantile_cont(k[2], 0.5) AS c2, quantile_cont(k[3], 0.5) AS c3 FROM u GROUP BY 1),
m AS (SELECT sample, quantile_cont(abs(k[1] - c1), 0.5) AS d1, quantile_cont(abs(k[2] - c2), 0.5) AS d2, quantile_cont(abs(k[3] - c3), 0.5) AS d3 FROM u JOIN w USING (sample) GROUP BY 1)"""


@registered(f"""WITH {_SIGNALS}
SELECT sample, bin, finite_count, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90,
 round(greatest(abs(k[1] - c1) / greatest(1.4826 * d1, shift / 5), abs(k[2] - c2) / greatest(1.4826 * d2, shift / 5), abs(k[3] - c3) / greatest(1.4826 * d3, shift / 5)), 4) AS score,
 coalesce(greatest(abs(k[1] - c1) / greatest(1.4826 * d1, shift / 5), abs(k[2] - c2) / greatest(1.4826 * d2, shift / 5), abs(k[3] - c3) / greatest(1.4826 * d3, shift / 5)) > 5, false) AS outlier
FROM u JOIN w USING (sample) JOIN m USING (sample)""")
def signal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a channel by acquisition bin, scored against all bins of the sample."""
    binned = A.with_bins(_events(spark, sf_dir), "sample", 200)
    out = A.signal_bins(binned, "sample", {"x": F.col("x")}, F.col("value") >= 1, min_bin_events=20)
    return out.select("sample", "bin", "finite_count", _r("p10").alias("p10"), _r("p50").alias("p50"), _r("p90").alias("p90"), _r("score", 4).alias("score"), "outlier")


@registered(f"""
SELECT r.sample, r.bin, r.n, coalesce(bad, false) OR coalesce(odd, false) AS suggested, concat_ws('; ', CASE WHEN bad THEN 'rate' END, CASE WHEN odd THEN 'signal: x' END) AS reasons
FROM (WITH {_RATES} SELECT sample, bin, n, coalesce(score > 5 AND abs(lr - c) >= ln(1.5), false) AS bad FROM o) r
JOIN (WITH {_SIGNALS} SELECT sample, bin, coalesce(greatest(abs(k[1] - c1) / greatest(1.4826 * d1, shift / 5), abs(k[2] - c2) / greatest(1.4826 * d2, shift / 5), abs(k[3] - c3) / greatest(1.4826 * d3, shift / 5)) > 5, false) AS odd FROM u JOIN w USING (sample) JOIN m USING (sample)) s ON r.sample = s.sample AND r.bin = s.bin""")
def acquisition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which acquisition bins are suggested for exclusion, and why."""
    binned = A.with_bins(_events(spark, sf_dir), "sample", 200)
    rates = A.rate_bins(binned, "sample", _slow())
    signals = A.signal_bins(binned, "sample", {"x": F.col("x")}, F.col("value") >= 1, min_bin_events=20)
    return A.bin_report(rates, signals, "sample")


@registered(f"""WITH {_SIGNALS}, g AS (SELECT sample, bin, q[2] AS med FROM b WHERE finite_count >= 20),
r AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY bin) AS i, rank() OVER (PARTITION BY sample ORDER BY med) + (count(*) OVER (PARTITION BY sample, med) - 1) / 2.0 AS j FROM g)
SELECT sample, count(*) AS bins, round(CASE WHEN count(*) >= 8 AND count(DISTINCT j) > 1 THEN corr(i, j) END, 6) AS order_correlation FROM r GROUP BY 1""")
def signal_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = A.with_bins(_events(spark, sf_dir), "sample", 200)
    s = A.signal_bins(binned, "sample", {"x": F.col("x")}, F.col("value") >= 1, min_bin_events=20)
    return A.drift(s, "sample", 20).select("sample", "bins", _r("order_correlation").alias("order_correlation"))


_FLAGS = f"""
e AS (SELECT sample, event_id, x, value, {RESET_SECONDS} AS t, value >= 1 AS p, value AS area, CASE WHEN event_id % 31 = 0 THEN value * 0.3 ELSE value * 0.93 END AS height FROM {_E}),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY sample ORDER BY event_id) AS step, lag(t) OVER (PARTITION BY sample ORDER BY event_id) >= 0 AS before, CASE WHEN p AND area > 0 AND height > 0 THEN ln(area) - ln(height) END AS lr FROM e),
m AS (SELECT sample, quantile_cont(lr, 0.5) AS c FROM d GROUP BY 1), q AS (SELECT sample, quantile_cont(abs(lr - c), 0.5) AS mad FROM d JOIN m USING (sample) GROUP BY 1),
f AS (SELECT d.sample, event_id, CASE WHEN NOT p THEN 16 ELSE (NOT isfinite(x))::INT + 2 * coalesce(NOT (isfinite(t) AND t >= 0) OR (step < 0 AND before), false)::INT + 4 * (coalesce(value >= 400, false))::INT
 + 8 * (lr IS NULL OR abs(lr - c) / greatest(1.4826 * mad, 0.15 / 5, abs(c) * 1e-12) > 5)::INT END AS flags FROM d JOIN m USING (sample) JOIN q USING (sample))"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.when(F.col("event_id") % 31 == 0, F.col("value") * 0.3).otherwise(F.col("value") * 0.93)
    return A.quality_flags(_events(spark, sf_dir), "sample", reset_seconds(), {"x": F.col("x")}, F.col("value") >= 1, {"value": (F.col("value"), 400.0)}, (F.col("value"), height))


@registered(f"WITH {_FLAGS} SELECT sample, event_id, flags FROM f")
def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality bits of every event: not finite, time, saturation, pulse shape, outside the population."""
    return _flagged(spark, sf_dir).select("sample", "event_id", "flags")


@registered(f"""WITH {_FLAGS} SELECT sample, count(*) AS n, count(*) FILTER (WHERE flags & 16 = 0) AS population, count(*) FILTER (WHERE flags & 1 <> 0) AS nonfinite, count(*) FILTER (WHERE flags & 2 <> 0) AS time, count(*) FILTER (WHERE flags & 4 <> 0) AS saturation, count(*) FILTER (WHERE flags & 8 <> 0) AS pulse FROM f GROUP BY 1""")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flag_counts(_flagged(spark, sf_dir), "sample")


@registered(f"""WITH {_FLAGS}, z AS (SELECT sample, min(event_id) AS e0, greatest(200, ceil((max(event_id) - min(event_id) + 1) / 1024.0)) AS size FROM f GROUP BY 1),
r AS (SELECT f.sample, CASE WHEN flags & 16 = 0 THEN NOT (flags & 5 <> 0 OR floor((event_id - e0) / size) IN (1, 3)) END AS kept FROM f JOIN z USING (sample))
SELECT sample, count(*) FILTER (WHERE kept) AS retained, count(*) FILTER (WHERE NOT kept) AS rejected, count(*) FILTER (WHERE kept IS NULL) AS outside FROM r GROUP BY 1""")
def quality_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a review keeps and rejects, by flags and excluded bins."""
    binned = A.with_bins(_flagged(spark, sf_dir), "sample", 200)
    excluded = binned.where(F.col("bin").isin(1, 3)).select("sample", "bin").distinct()
    r = A.review(binned, "sample", ("nonfinite", "saturation"), excluded)
    return r.groupBy("sample").agg(F.count_if("kept").alias("retained"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if(F.col("kept").isNull()).alias("outside"))


@registered(f"""WITH {_FLAGS}, z AS (SELECT sample, min(event_id) AS e0, greatest(200, ceil((max(event_id) - min(event_id) + 1) / 1024.0)) AS size FROM f GROUP BY 1)
SELECT event_id, CAST(floor((event_id - e0) / size) AS BIGINT) AS bin, (flags & 16 = 0)::INT AS in_source, (flags & 1 <> 0)::INT AS nonfinite, (flags & 2 <> 0)::INT AS time, (flags & 4 <> 0)::INT AS saturation, (flags & 8 <> 0)::INT AS pulse,
 CASE WHEN flags & 16 = 0 THEN flags & 15 = 0 END AS kept FROM f JOIN z USING (sample)""")
def quality_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event with a 0 or 1 for each flag and whether the review keeps it."""
    binned = A.with_bins(_flagged(spark, sf_dir), "sample", 200)
    none = binned.where(F.lit(False)).select("sample", "bin")
    return A.event_report(A.review(binned, "sample", tuple(G.FLAGS), none))


_BINS = f"""
e AS (SELECT sample, {SECONDS} AS t, CASE WHEN isfinite(x) THEN x END AS v, value >= 1 AS p FROM {_E}),
m AS (SELECT sample, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1),
c AS (SELECT sample, least(floor((t - lo) / (hi - lo) * 48), 47)::INT AS bin, v FROM e JOIN m USING (sample) WHERE p),
g AS (SELECT sample, bin, count(*) AS population_count, count(v) AS finite_count, count(*) FILTER (WHERE v > 100) AS responder_count, quantile_cont(v, 0.5) FILTER (WHERE v > 100) AS med FROM c GROUP BY 1, 2),
a AS (SELECT m.sample, b.bin, lo + (hi - lo) * b.bin / 48 AS start, lo + (hi - lo) * (b.bin + 0.5) / 48 AS center, coalesce(population_count, 0) AS population_count, coalesce(finite_count, 0) AS finite_count, coalesce(responder_count, 0) AS responder_count, CASE WHEN responder_count >= 4 THEN med END AS raw_value
 FROM m CROSS JOIN (SELECT CAST(unnest(range(48)) AS INT) AS bin) b LEFT JOIN g ON g.sample = m.sample AND g.bin = b.bin),
i AS (SELECT *, bin - count(raw_value) OVER (PARTITION BY sample ORDER BY bin) AS run FROM a),
f AS (SELECT *, CASE WHEN raw_value IS NOT NULL THEN avg(raw_value) OVER (PARTITION BY sample, run, raw_value IS NULL ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS value FROM i)"""


def _course(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("clock", seconds())
    levels = e.select("sample").distinct().withColumn("threshold", F.lit(100.0))
    c = K.time_course(e, "sample", "clock", F.col("x"), F.col("value") >= 1, 48, "median", 4, thresholds=levels, above_only=True)
    return K.smoothed(c, "sample", 3)


@registered(f"WITH {_BINS} SELECT sample, bin, round(start, 3) AS start, population_count, finite_count, responder_count, round(raw_value, 6) AS raw_value, round(value, 6) AS value FROM f")
def time_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responders' median in every time bin, averaged inside measured runs."""
    return _course(spark, sf_dir).select("sample", "bin", _r("start", 3).alias("start"), "population_count", "finite_count", "responder_count", _r("raw_value").alias("raw_value"), _r("value").alias("value"))


@registered(f"""WITH {_BINS}, n AS (SELECT sample, bin, center, value, lead(center) OVER w AS c2, lead(value) OVER w AS v2 FROM f WINDOW w AS (PARTITION BY sample ORDER BY bin)),
u AS (SELECT min(lo) AS t0, max(hi) AS t1 FROM m),
r AS (SELECT unnest(['first', 'rest']) AS range, unnest([t0, t0 + 0.3 * (t1 - t0)]) AS a, unnest([t0 + 0.3 * (t1 - t0), t1]) AS b FROM u),
x AS (SELECT *, value IS NOT NULL AND center >= a AND center < b AS inside, greatest(center, a) AS p, least(c2, b) AS q FROM n, r),
y AS (SELECT *, CASE WHEN value IS NOT NULL AND v2 IS NOT NULL AND p < q THEN q - p END AS span FROM x)
SELECT sample, range, count(*) FILTER (WHERE inside) AS points, round(max(value) FILTER (WHERE inside), 6) AS peak, round(avg(value) FILTER (WHERE inside), 6) AS mean, round(CASE WHEN count(*) FILTER (WHERE inside) >= 2 THEN regr_slope(value, center) FILTER (WHERE inside) END, 9) AS slope,
 round(sum(span * (value + (v2 - value) * ((p + q) / 2 - center) / (c2 - center))), 2) AS auc, round(coalesce(sum(span), 0), 2) AS covered_duration FROM y GROUP BY 1, 2""")
def curve_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, mean, slope and area of the curve in named ranges, gaps left out."""
    c = _course(spark, sf_dir)
    a, b = c.agg(F.min("start"), F.max("end")).first()
    cut = a + 0.3 * (b - a)
    s = K.curve_summaries(c, "sample", [("first", a, cut), ("rest", cut, b)])
    return s.select("sample", "range", "points", _r("peak").alias("peak"), _r("mean").alias("mean"), _r("slope", 9).alias("slope"), _r("auc", 2).alias("auc"), _r("covered_duration", 2).alias("covered_duration"))


@registered(f"""
WITH e AS (SELECT sample, {SECONDS} AS t, CASE WHEN isfinite(x) THEN x END AS v FROM {_E}), m AS (SELECT sample, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), u AS (SELECT min(t) AS a, min(t) + 0.2 * (max(t) - min(t)) AS b FROM e)
SELECT sample, round(quantile_cont(v, 0.95), 6) AS threshold, count(v) AS baseline_count FROM e, u WHERE t >= a AND t < b GROUP BY 1""")
def baseline_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of the signal in the first fifth of the time."""
    e = _events(spark, sf_dir).withColumn("clock", seconds())
    a, b = e.agg(F.min("clock"), F.max("clock")).first()
    return K.baseline_threshold(e, "sample", "clock", F.col("x"), F.lit(True), a, a + 0.2 * (b - a), 95.0).withColumn("threshold", _r("threshold"))


@registered("""
WITH e AS (SELECT unnest([0.0, 5, 20, 50, 90, 200, 491]) AS lo, unnest([5.0, 20, 50, 90, 200, 491, NULL]) AS hi)
SELECT CAST(CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 1 WHEN value < 50 THEN 2 WHEN value < 90 THEN 3 WHEN value < 200 THEN 4 ELSE 5 END AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 491 GROUP BY 1""")
def irregular_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = K.bin_lookup(F.col("value"), [0.0, 5.0, 20.0, 50.0, 90.0, 200.0, 491.0])
    return _table(spark, sf_dir, "events").groupBy(at.alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")


@registered("SELECT event_id, round(event_id / 12.5, 6) AS clock FROM events")
def estimated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of an assumed rate, where no clock is."""
    return _table(spark, sf_dir, "events").select("event_id", _r(A.estimated_time(F.col("event_id"), 12.5)).alias("clock"))


@registered(None)
def suggested_time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts between prominent peaks of each sample's curve; the tests hold it against a plain search."""
    return K.suggested_ranges(_course(spark, sf_dir), "sample")
