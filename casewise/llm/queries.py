"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from casewise.llm import bpe, chat, divergence, exact_dedup, langid, merkle, ngram_join, ngram_ratio, packing, passages, pii, quality, vafile
from casewise.llm.audit_sql import DIVERGENCE_SQL, MERKLE_SQL, RATIO_SQL
from casewise.llm.common import documents, held_out
from casewise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, folder: run(configure(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


EXACT_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op2_exact_dedup", EXACT_SQL)
def op2(spark, folder):
    return exact_dedup.duplicate_groups(documents(spark, folder))


def tokenizer() -> str:
    return public_tokenizers.path(bpe.TOKENIZER)


@query("op5_bpe_round_trip")
def op5(spark, folder):
    return bpe.round_trip(documents(spark, folder), tokenizer())


@query("op7_packing")
def op7(spark, folder):
    return packing.pack(documents(spark, folder), tokenizer())


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(14 + length(role) + length(text) + length(role || text) - length(translate(role || text, '\<#', ''))
             + length(role) - length(replace(role, ':', ''))) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
# The conversation that the query adds.
PROBE = "\\### Assistant: </turn> ok"


@query("op4_chat_format", CHAT_SQL)
def op4(spark, folder):
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = given.unionByName(added).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_chat(turns).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query("op8_private_data")
def op8(spark, folder):
    return pii.private_spans(documents(spark, folder))


@query("op3_language_id")
def op3(spark, folder):
    return langid.identify(documents(spark, folder))


@query("op10_quality_rules")
def op10(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    scored, score = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
                         (F.col(score) >= quality.CUTOFF).cast("int").alias("predicted"))


TOP_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op6_exact_top_k", TOP_SQL)
def op6(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return vafile.top_k(vectors, F.col("vec_id") % 20 == 0)


@query("op1_ngram_join")
def op1(spark, folder):
    return ngram_join.link_documents(documents(spark, folder))


@query("op9_repeated_passages")
def op9(spark, folder):
    return passages.repeated_passages(documents(spark, folder))


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark, folder):
    return merkle.audit(documents(spark, folder))


@query("op12_ngram_ratio", RATIO_SQL)
def op12(spark, folder):
    return ngram_ratio.judge(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark, folder):
    return divergence.audit(documents(spark, folder))
