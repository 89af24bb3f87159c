"""Exact dedup by deterministic block naming.

The normalised text is cut into blocks of fixed size. Distinct blocks are sorted and get
integer names; then names of adjacent blocks are paired, and the distinct pairs are sorted
and named again, until every document has one name. By induction two documents have the
same (level, name) if and only if they have the same sequence of blocks, hence the same
normalised text: no identity rests on a hash.

A block's text travels once, to be sorted and named, copies collapsed before the shuffle.
Documents find the names by a 128-bit address of the block. Naming sees it when two
different blocks share an address, and then takes other addresses and begins again.

Defined results: null text counts as empty; an empty text is one empty block, so all empty
texts are one group; repeated rows are rows of their own; a null ``doc_id`` sorts after
all others; exactly one row of a group is kept, also where rows repeat whole. An empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventmill.plans.scratch import materialize

#: Runs of the characters that the normal form lacks: space and U+0009 to U+000D.
FOLDED = "[\\x20\\x09-\\x0D]+"

#: Code points a block: most documents have one, the others few.
BLOCK = 4096


def normal_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), FOLDED, "")


def _digest(normal: Column) -> Column:
    return F.sha2(normal.cast("binary"), 256)


def _blocks(normal: Column, size: int) -> Column:
    """The text in order, ``size`` code points a block; an empty text is one empty block."""
    cut = F.regexp_extract_all(normal, F.lit(f"((?s).{{1,{size}}})"), F.lit(1))
    return F.when(F.length(normal) <= size, F.array(normal)).otherwise(cut)


def _address(block: Column, bits: int, attempt: int) -> Column:
    """Two 64-bit words, other ones at each attempt. Few bits are for tests only."""
    words = [F.xxhash64(F.lit(2 * attempt + k), block) for k in (0, 1)]
    if bits < 128:
        words = [F.pmod(words[0], F.lit(1 << min(bits, 62))), F.lit(0).cast("long")]
    return F.struct(words[0].alias("a1"), words[1].alias("a2"))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Sort distinct keys inside the partitions that grouped them, and number them there.

    A number is met once over all partitions; ``materialize`` fixes it.
    """
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(normal: DataFrame, block: int, bits: int, attempt: int) -> DataFrame:
    """``a1, a2, name`` of every distinct block."""
    spread = normal.select(F.explode(_blocks(F.col("normal"), block)).alias("block"))
    distinct = spread.groupBy("block").agg(F.count("*").alias("n"))
    a = _address(F.col("block"), bits, attempt)
    return materialize(_numbered(distinct, "block").select(a.alias("a"), "name").select("a.a1", "a.a2", "name"), "block-names")


def identities(docs: DataFrame, block: int = BLOCK, bits: int = 128) -> DataFrame:
    """``docs(doc_id, text)`` to ``row, doc_id, n_chars, text_sha256, level, name``, a row each."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    normal = docs.select("doc_id", F.length(whole).cast("long").alias("n_chars"), normal_form(F.col("text")).alias("normal"))
    attempt = 0
    while True:
        names = _first_names(normal, block, bits, attempt)
        if names.groupBy("a1", "a2").count().where("count > 1").isEmpty():
            break
        attempt, bits = attempt + 1, min(128, 2 * bits)

    rows = materialize(
        normal.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "n_chars",
            _digest(F.col("normal")).alias("text_sha256"),
            F.transform(_blocks(F.col("normal"), block), lambda b: _address(b, bits, attempt)).alias("blocks"),
        ),
        "block-rows",
    )
    n = F.size("blocks")
    level = F.when(n > 1, F.ceil(F.log2(n.cast("double")))).otherwise(0).cast("int").alias("level")
    levels = rows.agg(F.max(level)).first()[0] or 0
    state = (
        rows.select("row", level, F.posexplode("blocks").alias("pos", "b"))
        .select("row", "level", "pos", "b.a1", "b.a2")
        .join(names, ["a1", "a2"])
        .select("row", "level", "pos", "name")
    )
    done = []
    for k in range(levels + 1):
        state = materialize(state, "names")
        done.append(state.where(F.col("level") == k).select("row", "level", "name"))
        if k < levels:
            odd = F.col("pos") % 2 == 1
            pairs = materialize(
                state.where(F.col("level") > k)
                .groupBy("row", "level", F.shiftright("pos", 1).alias("pos"))
                .agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right")),
                "pairs",
            )
            numbered = _numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("n")).drop("n"), "left", "right")
            state = pairs.join(materialize(numbered, "pair-names"), ["left", "right"]).select("row", "level", "pos", "name")
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return rows.drop("blocks").join(named, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Of equal texts the row with the most code points in the original text stays, then the
    smallest id.
    """
    named = materialize(identities(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), block, bits), "identities")
    first = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")
    groups = materialize(named.groupBy("level", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one for each group."""
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("__em_id"), F.col("text_sha256").alias("__em_sha"), F.col("n_chars").alias("__em_n")
    )
    whole = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__em_sha": _digest(normal_form(F.col(text_col))), "__em_n": F.length(whole).cast("long"), "__em_id": F.col(id_col)})
    cond = [keyed[c].eqNullSafe(stay[c]) for c in ("__em_id", "__em_sha", "__em_n")]
    kept = keyed.join(stay, cond, "left_semi")
    # rows that repeat whole share a key, of which one stays
    return kept.dropDuplicates(["__em_id", "__em_sha", "__em_n"]).select(*[F.col(f"`{c}`") for c in docs.columns])
