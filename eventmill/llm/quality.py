"""Quality by importance resampling with hashed n-gram models.

Two bags of hashed unigrams and bigrams are counted: one of target text (a bounded sample
of documents labelled good, about ``SAMPLE`` by a hash of their id), one of all raw text.
A document's log weight is the sum of the log ratios of the two models over its n-grams, the
log of its importance weight. Gumbel noise of its own for each row is added, and the k largest
keys are selected: a draw without replacement in proportion to the weights. ``temper`` makes
the weight the mean log ratio times a stated number of n-grams instead, so that length does not
decide. k is ``fraction`` of all rows; by default the share of the labelled documents that are
labelled good.

Defined results: a text that is null or has no token has log weight 0, texts may be of any
length; without target documents every weight is 0, and without labels every row is selected;
repeated rows and null ids are drawn each for itself; equal keys are ranked by ``row``, the
number that a row gets when weights are written; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.llm.bpe import Remembered
from eventmill.llm.texts import pieces
from eventmill.plans.scratch import materialize

BUCKETS, SAMPLE = 10_000, 4000
ROWS_A_RANGE, MOST_RANGES = 50_000, 4096

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_EDGE = re.compile(r"\s")
_hashes = Remembered(lambda t: crc32(t.encode("utf-8", "replace")))


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of all unigrams and bigrams of the whole text."""
    text = (text or "").lower()
    rows = []
    for a, b in pieces(text, _EDGE):
        tokens = _TOKEN.findall(text, a, b)
        rows.append(np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens)))
        _hashes.trim()
    h = np.concatenate(rows)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([h, pairs]) % np.uint64(BUCKETS)


def models(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log ratio of the target and the raw model by bucket; ``docs(doc_id, text)``, ``target(doc_id)`` bounded."""
    marked = docs.join(F.broadcast(target.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", "good")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, is_good in zip(b["text"], b["good"]):
                c = np.bincount(ngrams(text).astype(np.int64), minlength=BUCKETS)
                raw += c
                if is_good is True or is_good == 1:
                    good += c
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "good": good})

    sums = marked.mapInPandas(counted, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in sums.collect():  # BUCKETS rows
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    if good.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def weight_of(grams: np.ndarray, ratio: np.ndarray, temper: float | None = None) -> float:
    """Log weight of a text with these n-grams."""
    if not len(grams):
        return 0.0
    logs = ratio[grams.astype(np.int64)]
    return float(logs.sum() if temper is None else logs.mean() * temper)


def log_weight(text: Column, ratio: np.ndarray, spark, temper: float | None = None) -> Column:
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = shared.value
        for texts in batches:
            yield pd.Series([weight_of(ngrams(t), r, temper) for t in texts], dtype=float)

    return weighed(text)


def gumbel(key: Column, seed: int = 31) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def ranked(rows: DataFrame, n: int, key: str = "key", unique: str = "row") -> DataFrame:
    """Adds ``rank``, 1 for the largest key, over range partitions and their prefix counts."""
    parts = min(MOST_RANGES, max(4, n // ROWS_A_RANGE))
    dealt = rows.repartitionByRange(parts, F.desc(key), unique).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    counts = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}  # MOST_RANGES rows
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    starts = rows.sparkSession.createDataFrame(before, "__part int, __start long")
    w = Window.partitionBy("__part").orderBy(F.desc(key), unique)
    return dealt.join(F.broadcast(starts), "__part").withColumn("rank", F.row_number().over(w) + F.col("__start")).drop("__part", "__start")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float | None = None, sample: int = SAMPLE, temper: float | None = None) -> DataFrame:
    """``doc_id, log_weight, key, rank, selected`` of every row; ``labels(doc_id, quality)``."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n_good = good.count()
    if fraction is None:
        told = labels.where("quality IS NOT NULL").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
        fraction = 1.0 if told is None else told
    draw = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 40)) / float(1 << 40)
    target = good.where(draw < min(1.0, sample / max(1, n_good))).limit(2 * sample)
    ratio = models(text, target)
    weight = log_weight(F.col("text"), ratio, docs.sparkSession, temper)
    rows = materialize(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", weight.alias("log_weight")), "weights")
    n = rows.count()
    keyed = rows.withColumn("key", F.col("log_weight") + gumbel(F.col("row")))
    k = round(fraction * n)
    return ranked(keyed, n).select("doc_id", "log_weight", "key", "rank", (F.col("rank") <= k).alias("selected"))
