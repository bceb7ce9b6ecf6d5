"""What enters the index: non-blank chunks whose text is new in its knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from passagery.functions.text import is_blank, text_hash
from passagery.operators.embedding import embed, hashing_model

CONTENT_KEY = ["kb_id", "chunk_type", "text_hash"]


def new_chunks(chunks: DataFrame, existing: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """First chunk per (knowledge base, chunk type, text), without texts already indexed.

    Copies are dropped within each task before the shuffle, so a text that makes up a large share of all chunks
    reaches its reducer once per task.
    """
    order = order or ["doc_id", "chunk_index"]
    rows = chunks.filter(~is_blank(F.col("text"))).withColumn("text_hash", text_hash(F.col("text")))
    first = Window.partitionBy(*CONTENT_KEY).orderBy(*order)
    kept = rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") == 1).drop("copy")
    if existing is None:
        return kept
    return kept.join(existing.select(*CONTENT_KEY).distinct(), CONTENT_KEY, "left_anti")


def index_chunks(chunks: DataFrame, existing: DataFrame | None = None, load=hashing_model) -> DataFrame:
    """New chunks with their vectors; only what is kept is embedded."""
    return embed(new_chunks(chunks, existing), "text", load)
