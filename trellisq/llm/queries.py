"""The pN_ queries of the problems on texts and vectors, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellisq.llm import chunk, leaks, lookalike, nearest, tokenize
from trellisq.sources import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return chunk.split_texts(table(spark, d, "rag_documents")).where("piece_no = 0").select("id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunk.split_texts(table(spark, d, "rag_documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.similar_pairs(table(spark, d, "rag_documents")).select("id_a", "id_b")


def p7_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar rows of each row whose id is divisible by 100, against all rows of its group."""
    return nearest.most_similar(table(spark, d, "rag_documents")).select("query_id", "rank", "neighbour_id", "similarity")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.with_form(table(spark, d, "documents")).select("doc_id", "form")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of those that look the same."""
    return lookalike.lookalike_classes(table(spark, d, "documents"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p7_found": p7_found, "p7_nearest": p7_nearest, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_forms": p10_forms, "p10_classes": p10_classes}

ORACLES = {
    "p7_found": """
with v as (
  select id, source_model_id, embedding_model, embedding from rag_documents
  where len(embedding) = 1024 and list_max(list_transform(embedding, lambda x: abs(x))) > 0
)
select a.id as id_a, b.id as id_b from v a join v b
on a.source_model_id = b.source_model_id and a.embedding_model = b.embedding_model and a.id < b.id
where list_cosine_similarity(a.embedding, b.embedding) >= 0.92
""",
    "p4_found": r"""
select id from rag_documents
where length(trim(regexp_replace(document_text, '[ \t\r\n]+', ' ', 'g'), ' ')) > 1500
""",
}
