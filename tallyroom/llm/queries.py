"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyroom.llm import byte_bpe, collocations, conversation_trie, exact_dedup, html_text, kd_search, mips, ngram_jaccard, packing, quality, suffix_tree, token_file, toxicity, word_bpe
from tallyroom.llm.common import Scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(documents(spark, sf_dir), 3, "0.9")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'token-files').base}/data"
    token_file.write_tokens(documents(spark, sf_dir), folder, word_bpe.default_path(), 2)
    return token_file.read_tokens(spark, folder)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe.default_path(), 1)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(documents(spark, sf_dir))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_token_files, op3_toxicity, op4_quality, op5_packing, op6_mips, op7_exact_dedup, op8_byte_bpe, op9_suffix_tree, op10_html_text, op11_collocations, op12_kd_search, op13_conversation_trie)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a decimal number, bit by bit: 3988292384 is the reflected polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(length(CAST(conv_id AS VARCHAR))),
    lambda i: list_transform(range(8), lambda b: (ascii(substr(CAST(conv_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1)) >> CAST(b AS INTEGER)) & 1)))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""

ORACLE_SQL = {
    "op7_exact_dedup": f"""
        WITH h AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)
    """,
    "op12_kd_search": """
        WITH v AS (
            SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
        d AS (SELECT len(v) AS dim FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
        w AS (SELECT vec_id, v FROM v JOIN d ON len(v) = dim),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
            FROM w AS q JOIN w AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
    "op13_conversation_trie": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
        c AS (
            SELECT n.conv_id, base, h, least(h, coalesce(b.own, 0)) AS lent FROM (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM n) AS n
            LEFT JOIN (SELECT conv_id AS base, own FROM n) AS b USING (base)),
        r AS (
            SELECT c.conv_id, k AS depth, role, text FROM c JOIN t ON t.conv_id = base AND k <= lent
            UNION ALL SELECT conv_id, k - h + lent, role, text FROM c JOIN t USING (conv_id) WHERE k > h),
        p AS (
            SELECT conv_id, depth, length(text) AS chars, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
            UNION ALL SELECT conv_id, 0, 0, [] FROM c),
        l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
        m AS (
            SELECT path, depth, min(conv_id) AS id, count(*) AS n_convs, max(chars) AS chars,
                coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l.depth IS NOT NULL), '') AS ends
            FROM p LEFT JOIN l USING (conv_id, depth) GROUP BY path, depth),
        q AS (SELECT p.conv_id, p.depth, m.id FROM p JOIN m USING (path, depth)),
        u AS (SELECT m.*, q.id AS up FROM m LEFT JOIN q ON q.conv_id = m.id AND q.depth = m.depth - 1),
        k AS (SELECT up AS id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
        v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (id, depth)),
        s AS (SELECT q.id, q.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM v JOIN q ON q.conv_id = v.id AND q.depth <= v.depth GROUP BY ALL)
        SELECT id AS conv_id, depth, up AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM v JOIN s USING (id, depth)
    """,
    "op11_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        f AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k)) GROUP BY ALL HAVING count(*) >= 30),
        x AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        c AS (SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM x)),
        s AS (
            SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score, j
            FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = head JOIN f AS r ON r.lang = c.lang AND r.phrase = rest
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
        u AS (
            SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f
                FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM x))) GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM s JOIN n USING (lang) LEFT JOIN u USING (lang, phrase) WHERE u.f IS NULL OR 100 * u.f < 80 * a
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
    """,
}
