"""The contract's queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import counts

    return counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import idfiles

    docs = _table(spark, sf_dir, "documents")
    files = idfiles.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return idfiles.read_ids(spark, files, docs.select("doc_id"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secretscan

    return secretscan.digest(secretscan.scan(_table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.remainder() == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op4_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import maxscore

    vectors = maxscore.quantise(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shuffle

    dealt = shuffle.shuffle(_table(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngramjoin

    return ngramjoin.join_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_vector_near_duplicates": op2_vector_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_max_score": op4_max_score,
    "op5_token_counts": op5_token_counts,
    "op6_id_files": op6_id_files,
    "op7_secret_scan": op7_secret_scan,
    "op8_shuffle_shards": op8_shuffle_shards,
    "op9_pack": op9_pack,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op4_max_score": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op2_vector_near_duplicates": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v),
        links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
        reach(id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.node),
        least AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT l.id AS vec_id, coalesce(c.n, 0) AS n_links, l.component_id, l.id = l.component_id AS kept FROM least l LEFT JOIN counts c ON c.a = l.id
    """,
    "op10_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        sizes AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        one AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        reach(id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.node)
        SELECT id AS doc_id, n AS n_shingles, min(node) AS component_id FROM reach JOIN sizes ON doc_id = id GROUP BY id, n
    """,
}
