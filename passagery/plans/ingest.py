"""Ingest of a batch of documents: results per document, and the chunks to store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from passagery.functions import codes
from passagery.functions.text import is_blank
from passagery.operators import chunking as C
from passagery.operators.catalog import chunk_counts
from passagery.operators.indexing import new_chunks
from passagery.session import materialize
from passagery.sources.sinks import clear_kb, overwrite_partitions, read_chunks


def ingest(docs: DataFrame, strategy: Column | str | None = None, params: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
    """`docs` (doc_id, tenant_id, kb_id, text, ...) to (results, chunks). A document without text is a failed row."""
    usable = ~is_blank(F.col("text"))
    chunks = C.chunk(docs.filter(usable), strategy, params)
    name = F.lit(strategy) if strategy is None or isinstance(strategy, str) else strategy
    chunks = chunks.withColumn("params_snapshot", codes.params_snapshot(codes.normalize_strategy(name), params))
    counted = chunk_counts(docs.select("doc_id", "kb_id", usable.alias("success")), chunks)
    results = counted.withColumn("status", F.when(F.col("success"), "COMPLETED").otherwise("FAILED")).withColumn(
        "message", F.when(~F.col("success"), F.lit("no text in document"))
    )
    return results, chunks


def reprocess(docs: DataFrame, path: str, tenant_id: int, kb_id: int, strategy: str | None = None) -> None:
    """Chunk one knowledge base anew and replace exactly its folder, or drop it when no chunk is left."""
    mine = docs.filter((F.col("tenant_id") == tenant_id) & (F.col("kb_id") == kb_id))
    _, chunks = ingest(mine, strategy)
    stored = read_chunks(docs.sparkSession, path)
    fresh = materialize(new_chunks(chunks).select(*stored.columns), "reprocessed")
    if fresh.isEmpty():
        clear_kb(docs.sparkSession, path, tenant_id, kb_id)
    else:
        overwrite_partitions(fresh, path)
