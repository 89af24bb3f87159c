"""The registered queries of this subpackage, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventmill.llm import bpe, byte_bpe, chat, exact_dedup, fingerprints, langid, minhash, packing, pii, prefix_trie, quality, search, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, sf_dir))


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("position")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("n_chars")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(_documents(spark, sf_dir), _byte_bpe())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _byte_bpe())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encoded_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), mixed=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_personal_data, op3_language_id, op4_quality, op5_document_fingerprints, op6_chat_repair, op7_exact_dedup, op8_bpe_round_trip, op9_near_dedup, op10_packing, op11_lexical_search, op12_byte_bpe_round_trip, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": r"""
            WITH n AS (
                SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                       regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
                FROM documents)
            SELECT doc_id,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY normal) AS group_size,
                   row_number() OVER w = 1 AS kept,
                   sha256(normal) AS text_sha256
            FROM n
            WINDOW w AS (PARTITION BY normal ORDER BY n_chars DESC, doc_id)""",
        "op11_lexical_search": r"""
            WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
                 b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
                 d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
                 c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
                 m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, c),
                 p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
                 q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
                 w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
                 s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
                       FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
                 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
            SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
        "op13_prefix_trie": r"""
            WITH turns AS (
                SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
                       concat(length(coalesce(role, '')), ':', coalesce(role, ''), length(coalesce(text, '')), ':', coalesce(text, '')) AS turn,
                       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
                FROM conversations WHERE conv_id IS NOT NULL),
            convs AS (
                SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS head,
                       xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h
                FROM turns),
            mixed AS (
                SELECT c.conv_id, 0 AS part, t.k, t.turn, t.words FROM convs c JOIN turns t ON t.conv_id = c.head AND t.k <= c.h
                UNION ALL
                SELECT c.conv_id, 1, t.k, t.turn, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
            placed AS (SELECT conv_id, row_number() OVER w AS d, turn, words FROM mixed WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
            prefixes AS (
                SELECT conv_id, d, words, sha256(string_agg(sha256(turn), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS node,
                       max(d) OVER (PARTITION BY conv_id) = d AS ends
                FROM placed),
            paths AS (
                SELECT conv_id, d, words, node, ends, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY d), '') AS above FROM prefixes
                UNION ALL
                SELECT conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM placed p WHERE p.conv_id = convs.conv_id), NULL FROM convs),
            nodes AS (
                SELECT node, min(d) AS depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
                       sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
                FROM paths GROUP BY node),
            inner_nodes AS (SELECT above, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
            below AS (
                SELECT a.node AS top, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (i.n_children IS NULL) AS leaves
                FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.node = n.node
                JOIN paths a ON a.conv_id = n.conv_id AND a.d <= p.d
                LEFT JOIN inner_nodes i ON i.above = n.node
                GROUP BY a.node)
            SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(i.n_children, 0) AS n_children,
                   b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
            FROM nodes n JOIN below b ON b.top = n.node LEFT JOIN nodes u ON u.node = n.above LEFT JOIN inner_nodes i ON i.above = n.node""",
    }
