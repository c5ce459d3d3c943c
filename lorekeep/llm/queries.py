"""The queries opN_<name> over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, ivfpq, minhash, packing, polytope, secrets, shards, toxicity, unigram, webtext


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ivfpq.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = chat.canonical_rows(table(spark, sf_dir, "conversations"))
    rows = given.select("conv_id", "turn", "role", "text").unionAll(chat.probe(spark))
    return chat.digests(chat.written(chat.gathered(rows)))


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cross_polytope, op2_line_blocks, op3_ivf_pq, op4_ownership, op5_minhash, op6_packing, op7_factorization, op8_unigram, op9_chat, op10_jump_shards)}


_REACH = "reach(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b), c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"

_OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH},
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.low, vec_id) AS component_id, coalesce(c.low, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

# Links count on the sizes of whole sets; equal sets are one class first.
_OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY g) ELSE doc_id END AS rep FROM s), f AS (SELECT doc_id AS rep, len(g) AS n, unnest(g) AS g FROM s WHERE doc_id IN (SELECT rep FROM k)),
e AS (SELECT x.rep AS a, y.rep AS b FROM f x JOIN f y ON x.g = y.g AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY x.rep, y.rep HAVING 100 * count(*) >= 85 * (max(x.n) + max(y.n) - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), {_REACH}
SELECT doc_id, n AS n_shingles, coalesce(c.low, rep) AS component_id, coalesce(c.low, rep) = doc_id AS kept FROM k LEFT JOIN c ON c.a = k.rep"""

# A control string's first character gets a backslash: so many characters more.
_ESCAPES = " + ".join(f"len(regexp_extract_all(text, '[<\\[]\\\\*{x}'))" for x in ("\\|", "/?s>", "<", "/?SYS>>", "/?INST\\]"))
_OP9 = f"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length(role) + length(text) + {_ESCAPES}) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the exact operators that it can express. The others are held against brute force, round trips or held-out rows in tests/llm."""
    return {"op1_cross_polytope": _OP1, "op5_minhash": _OP5, "op9_chat": _OP9}
