"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.llm import (
    class_lm, decontamination, language, licenses, mixing, phrases, sharding, simhash, token_counts, token_files,
    topk, toxicity, whitening,
)
from postvet.llm.common import table
from postvet.session import new_shared_path

SHARDS = 24
TOKEN_LIMIT = 1024
QUERY_EVERY = 50
TOP = 5
END_ID = 1
COMPONENTS = 8
PHRASES = 2000


def tokenizer_path(name: str) -> str:
    """Where the installed package keeps a public tokenizer file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), SHARDS)


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "license", "start", F.round("gain", 6).alias("gain"),
        F.array_join("missing", " ").alias("missing"), F.array_join("extra", " ").alias("extra"),
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT
    )


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_files.token_files(
        docs, new_shared_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"), END_ID
    )


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), TOP)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    found = toxicity.score_texts(docs, model, ["doc_id"])
    return found.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict_languages(docs, language.fit(docs))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, folder, "documents"), words=4, radius=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.score_texts(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), COMPONENTS).withColumn(
        "deviation", F.expr("try_cast(deviation AS bigint)")
    )


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.top_phrases(table(spark, folder, "documents"), PHRASES)


QUERIES = {
    f.__name__: f for f in (
        op1_sharding, op2_licenses, op3_mixing, op4_token_counts, op5_decontamination, op6_token_files,
        op7_topk, op8_toxicity, op9_language, op10_simhash, op11_class_lm, op12_whitening, op13_phrases,
    )
}

# Queries left out have no plain SQL twin: hashing, models, tokenizers, graph search.
ORACLES = {
    "op7_topk": f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
            FROM v q JOIN v d ON q.vec_id <> d.vec_id
            WHERE q.vec_id % {QUERY_EVERY} = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= {TOP}
    """,
    "op13_phrases": f"""
        WITH lines AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), pieces AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM lines
        ), spots AS (
            SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces
        ), one AS (
            SELECT lang, ws[i] AS w1, count(*) AS f FROM spots GROUP BY ALL
        ), two AS (
            SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM spots WHERE i < len(ws) GROUP BY ALL
        ), three AS (
            SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f
            FROM spots WHERE i + 1 < len(ws) GROUP BY ALL HAVING count(*) >= 10
        ), total AS (
            SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY ALL
        ), cuts AS (
            SELECT lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
            FROM two p JOIN one x USING (lang, w1) JOIN one y ON y.lang = p.lang AND y.w1 = p.w2
            WHERE p.f >= 10 AND NOT EXISTS (
                SELECT 1 FROM three t WHERE t.lang = p.lang AND 100 * t.f >= 50 * p.f
                AND (t.w1 = p.w1 AND t.w2 = p.w2 OR t.w2 = p.w1 AND t.w3 = p.w2))
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
            FROM three t JOIN one x USING (lang, w1) JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
            UNION ALL
            SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
            FROM three t JOIN two x USING (lang, w1, w2) JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
        ), scored AS (
            SELECT *, ((1000000 * a::HUGEINT * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n, score
        FROM lowest JOIN total USING (lang)
        QUALIFY rank <= {PHRASES}
    """,
}
