"""Document fingerprints: a canonical exact digest.

A text is brought to Unicode NFKC, case-folded, normalised again, and its runs of white
space become one space. Two 64-bit xxhash words with different seeds give a 128-bit
bucket. Inside a bucket of several documents the canonical bytes are compared: where a
bucket holds different texts, its fingerprints carry the SHA-256 of the text besides.

Everything runs in the JVM: normalisation and case folding call Spark's own ICU library
through ``java_method``.

Defined results: null text counts as empty; an empty table gives no rows; a null ``doc_id``
counts as smaller than all ids; among rows with one ``doc_id`` the next one is by the
text's bucket. The only document of a table is its own next one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.plans.scratch import materialize

_SPACE = "[\\s\\x{85}\\p{Z}]+"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded."""

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    whole = F.coalesce(text, F.lit(""))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(whole), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), _SPACE, " "))


def _words(canon: Column, bits: int) -> tuple[Column, Column]:
    h1, h2 = F.xxhash64(F.lit(1), canon), F.xxhash64(F.lit(2), canon)
    if bits >= 128:
        return h1, h2
    return F.pmod(h1, F.lit(1 << bits)), F.lit(0).cast("long")


def _hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def _label(h1: Column, h2: Column, split: Column, sha: Column) -> Column:
    return F.when(split, F.concat(_hex(h1, h2), F.lit("-"), F.substring(sha, 1, 32))).otherwise(_hex(h1, h2))


def _digests(docs: DataFrame, bits: int) -> DataFrame:
    canon = docs.withColumn("canon", canonical(F.col("text")))
    h1, h2 = _words(F.col("canon"), bits)
    return canon.withColumns({"h1": h1, "h2": h2, "sha": F.sha2(F.col("canon").cast("binary"), 256)})


def _split(rows: DataFrame) -> DataFrame | None:
    """Buckets that hold more than one text, by the bytes themselves; None if there are none.

    Copies collapse before the shuffle, so a hot text does not gather its rows.
    """
    texts = rows.groupBy("h1", "h2", "canon").agg(F.count("*").alias("n"))
    split = texts.groupBy("h1", "h2").agg(F.count("*").alias("texts")).where("texts > 1")
    split = materialize(split.select("h1", "h2", F.lit(True).alias("split")), "split-buckets")
    return None if split.isEmpty() else split


def _marked(rows: DataFrame, split: DataFrame | None, h1: str, h2: str, name: str) -> DataFrame:
    if split is None:
        return rows.withColumn(name, F.lit(False))
    known = split.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("split").alias(name))
    return rows.join(known, [h1, h2], "left").fillna(False, [name])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """``doc_id, fingerprint`` for each row. Equal canonical texts, and only they, have equal fingerprints."""
    rows = _digests(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bits)
    marked = _marked(rows.drop("text"), _split(rows), "h1", "h2", "split")
    return marked.select("doc_id", _label(F.col("h1"), F.col("h2"), F.col("split"), F.col("sha")).alias("fingerprint"))


#: Rows for each range of ids, and the most ranges: their bounds are one array of the plan.
ROWS_A_RANGE, MOST_RANGES = 1000, 8192


def _ranges(ids: DataFrame) -> tuple[Column, DataFrame]:
    """The number of a row's range of ids, and ``doc_id, guest_of``: the largest id of a range is a guest in the next one.

    The ranges hold about equally many rows. The overall largest id is a guest of the least range.
    """
    n = ids.count()
    count = max(1, min(MOST_RANGES, n // ROWS_A_RANGE))
    cuts = ids.agg(F.percentile_approx("key", [k / count for k in range(1, count)] or [0.5], 10 * count).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts)) if count > 1 else []
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    bounds = F.expr("array(" + ",".join(f"{c}L" if c != -(1 << 63) else "-9223372036854775808" for c in cuts) + ")")
    at = F.lit(0)
    if cuts:  # binary search for the number of bounds that are not above the key
        at = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda low, step: F.when((low + step <= len(cuts)) & (F.get(bounds, low + step - 1) <= F.col("key")), low + step).otherwise(low),
        )
    most = sorted((r.at, r.most) for r in ids.groupBy(at.alias("at")).agg(F.max("key").alias("most")).collect())
    guests = [(key, most[(k + 1) % len(most)][0]) for k, (_, key) in enumerate(most)]
    return at, ids.sparkSession.createDataFrame(guests, "key long, guest_of int")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses.

    The edited text is the text with its last half replaced by as many of the first code
    points of the next document in descending order of ids. A digest is like another
    (1.0) or not (0.0).
    """
    least = -(1 << 63)
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    at, guests = _ranges(source.select("key"))
    rows = _digests(source, bits)
    split = _split(rows)
    rows = _marked(rows, split, "h1", "h2", "split").drop("canon")
    # one row a range goes to a second one: bounded by MOST_RANGES
    placed = rows.join(F.broadcast(guests), "key", "left").withColumn("at", F.explode(F.array_compact(F.array(at, F.col("guest_of"))))).withColumn(
        "guest", F.col("at") != at
    )
    only = len(guests.take(2)) == 1
    if only:  # one range: the largest id is a guest of its own range
        again = rows.join(F.broadcast(guests), "key").withColumns({"at": F.lit(0), "guest": F.lit(True)})
        placed = rows.withColumns({"at": F.lit(0), "guest_of": F.lit(0), "guest": F.lit(False)}).unionByName(again)
    order = Window.partitionBy("at").orderBy("guest", F.desc("key"), "h1", "h2")
    after = F.lead(F.struct("text", "h1", "h2", "sha", "split")).over(order)
    told = placed.withColumn("after", after).where(~F.col("guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    told = told.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("after.text"), F.lit(1), half)))
    told = told.withColumn("ecanon", canonical(F.col("edited")))
    e1, e2 = _words(F.col("ecanon"), bits)
    told = told.withColumns({"e1": e1, "e2": e2, "esha": F.sha2(F.col("ecanon").cast("binary"), 256)})
    told = _marked(told, split, "e1", "e2", "esplit")
    same_bucket = (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2"))
    same = same_bucket & F.when(same_bucket, canonical(F.col("text")) == F.col("ecanon")).otherwise(False)
    fingerprint = _label(F.col("h1"), F.col("h2"), F.col("split"), F.col("sha"))
    following = _label(F.col("after.h1"), F.col("after.h2"), F.col("after.split"), F.col("after.sha"))
    return told.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.alias("fingerprint"),
        _label(F.col("e1"), F.col("e2"), F.col("esplit") | (same_bucket & ~same), F.col("esha")).alias("edited_fingerprint"),
        same.cast("double").alias("near_edited"),
        (fingerprint == following).cast("double").alias("near_next"),
    )
