"""How much near-dedup runs and hands on."""

import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventmill.llm import minhash
from eventmill.plans import components, skew


def test_heavy_keys_are_read_in_a_few_jobs(spark):
    rows = spark.range(0, 40_000, 1, 40).select((F.col("id") % 20_000).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n")).repartition(40)
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "heavy keys")
    try:
        assert skew.heavy_keys(counts, ["k"], "n", 40_000) == {}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10


def test_a_join_without_heavy_keys_has_the_plan_of_one_with_them(spark):
    many, one = spark.range(100).withColumn("v", F.col("id") * 3), spark.range(50)
    for heavy in ({}, {5: 3}):
        got = skew.join_by_cells(many, one, ["id"], F.col("v"), heavy)
        assert got.count() == 50
        assert re.search(r"__cell#\d+ = __cell#\d+", got._jdf.queryExecution().optimizedPlan().toString())


def test_stars_take_no_round(spark, monkeypatch):
    made, plain = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: made.append(label) or plain(df, label))
    edges = [(0, k) for k in range(1, 30)] + [(50, 60), (50, 70)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(30)} | {50: 50, 60: 50, 70: 50}
    assert made == ["edges", "least"]


def test_first_words_of_documents_of_one_length_are_half_as_many():
    w = minhash.word_hashes(" ".join(f"w{k}" for k in range(180)))
    common = np.zeros(8, np.int32)
    assert len(minhash.first_words(w, w, common, 180)) == 21
    assert len(minhash.first_words(w, w, common, 20)) == 37


def test_word_hashes_are_one_to_one_with_words(monkeypatch):
    text = "Ab ab bA ½ x_1 naïve naive 日本 日 \ud800 áb " + "long" * 100 + " " + " ".join(f"{k}z z{k}" for k in range(3000))
    words = re.findall(r"\w+", text.lower())
    whole = minhash.word_hashes(text)
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words)) == len(set(zip(whole.tolist(), words)))
    monkeypatch.setattr(minhash, "PIECE", 50)
    assert (minhash.word_hashes(text) == whole).all()
    assert not len(minhash.word_hashes(None)) and not len(minhash.word_hashes(" - "))


def test_documents_of_several_cells_meet_in_one(spark, monkeypatch):
    """Texts of two passages and ends of their own share many buckets, whose centres make many cells."""
    rng = np.random.default_rng(8)
    passages = [[f"p{j}x{k}" for k in range(60)] for j in range(2)]
    texts = []
    for b in range(60):
        own = [f"o{w}" for w in rng.integers(0, 40, rng.integers(8, 16))]
        texts.append(" ".join([*passages[0][: rng.integers(20, 60)], *own, *passages[1][rng.integers(0, 40) :]]))
    met, plain = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, label: met.append(t := plain(df, label)) or t if label == "met" and "root1" in df.columns else plain(df, label))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, rounds=1).collect()}

    words = [minhash.word_hashes(t) for t in texts]
    want = {k: k for k in got}
    for j in got:
        for i in range(j):
            if want[i] != want[j] and minhash.aligned(words[i], words[j])[0]:
                low, high = sorted((want[i], want[j]))
                want = {k: low if c == high else c for k, c in want.items()}
    assert got == want and 1 < len(set(want.values())) < len(texts)
    alone = [k for k in got if list(got.values()).count(got[k]) == 1]  # row ids are the ids here
    cells = met[0].where(F.col("root1").isin(alone) & F.col("root2").isin(alone)).groupBy("root1", "root2").agg(F.count_distinct("cell").alias("n")).collect()
    assert len(cells) > 20 and {r.n for r in cells} == {1}


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_hashes_of_a_part_of_the_rows(kind):
    want = [[1, 2**64 - 1], [], [7], [5, 6, 7]]
    rows = pa.array([np.array(x, "<u8").tobytes() for x in want], kind)
    for a in range(5):
        for n in range(5 - a):
            assert [x.tolist() for x in minhash._hashes(rows.slice(a, n))] == want[a : a + n]
    assert [x.tolist() for x in minhash._hashes(pa.array([], kind))] == []
    assert minhash._numbers([np.array(x, np.uint64) for x in want]).to_pylist() == [[1, -1], [], [7], [5, 6, 7]]
