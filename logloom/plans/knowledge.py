"""Load, chunk, retrieve and assemble context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.retrieval import context_text, load_once, retrieve_with_fallback


def load_knowledge(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Chunks of the documents whose content is new."""
    fresh = load_once(docs, seen)
    return chunk_documents(fresh).join(fresh.select("doc_id", "md5"), "doc_id")


def retrieve(queries: DataFrame, corpus: DataFrame, docs: DataFrame, k: int = 3, min_score: float | None = None) -> DataFrame:
    """``query_id, source, rank, item_id, score``; see ``retrieve_with_fallback``."""
    return retrieve_with_fallback(queries, corpus, docs, k, min_score)


def contexts(found: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One context text per query from its ranked hits."""
    ranked = found.where(F.col("rank").isNotNull()).select("query_id", "rank", F.col("item_id").alias(key))
    return context_text(ranked.join(docs.select(key, "text", "source"), key))
