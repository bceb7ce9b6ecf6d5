"""Knowledge bases, documents, processing states and chunk lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagery import constants as K
from passagery.functions import codes
from passagery.operators.ordered import BUCKET_ROWS, DENSE, by_density, previous


def list_kbs(kbs: DataFrame, documents: DataFrame, tenant_id: int | None = None) -> DataFrame:
    """Knowledge bases, of one tenant if given, with their number of documents, which are counted before the join;
    newest first where the time of creation is known."""
    if tenant_id is not None:
        kbs = kbs.filter(F.col("tenant_id") == tenant_id)
    counts = documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_documents"))
    listed = kbs.join(counts, "kb_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
    return listed.orderBy(F.col("create_time").desc(), F.col("kb_id").desc()) if "create_time" in kbs.columns else listed


def kb_config(kbs: DataFrame, dims: dict[str, int]) -> DataFrame:
    family = codes.embedding_family(F.col("embedding_model"))
    return kbs.select(
        "kb_id", codes.collection_name(F.col("tenant_id"), F.col("kb_id")).alias("collection_name"),
        family.alias("model_family"), codes.lookup(dims, family, F.lit(None).cast("int")).alias("vector_dim"),
    )


def facet_filter(df: DataFrame, keyword: str | None, text_cols: list[str], facets: dict[str, object] | None = None) -> DataFrame:
    """Case-insensitive substring on any text column and equality on facets; an empty keyword or `all` passes."""
    condition = F.lit(True)
    if keyword:
        matches = [F.coalesce(F.lower(F.col(c)).contains(keyword.lower()), F.lit(False)) for c in text_cols]
        condition = matches[0]
        for m in matches[1:]:
            condition = condition | m
    for column, value in (facets or {}).items():
        if value != "all":
            condition = condition & (F.col(column) == F.lit(value))
    return df.filter(condition)


def list_documents(documents: DataFrame, kb_id: int | None = None, newest: int | None = None) -> DataFrame:
    """Documents of a knowledge base, or of every one, newest upload first."""
    mine = documents if kb_id is None else documents.filter(F.col("kb_id") == kb_id)
    rows = mine.orderBy("kb_id", F.col("upload_time").desc(), F.col("doc_id").desc())
    return rows.limit(newest) if newest else rows


def latest_status(events: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Last status per document by (event time, sequence): an aggregate, so a busy document is combined map-side."""
    last = F.max_by("status", F.struct("event_time", "seq"))
    return events.groupBy(doc).agg(last.alias("status"), F.count(F.lit(1)).alias("n_events"))


def valid_transition(before: Column, after: Column) -> Column:
    """The first state is PENDING, each state is followed by the next, and FAILED may follow any unfinished state."""
    following = {a: b for a, b in zip(K.STATUS_ORDER, K.STATUS_ORDER[1:])}
    step = after == codes.lookup(following, before, F.lit("-"))
    fail = (after == K.FAILED) & ~F.coalesce(before, F.lit("")).isin("", K.FAILED, "COMPLETED")
    return F.when(before.isNull(), after == K.STATUS_ORDER[0]).otherwise(step | fail)


def check_transitions(events: DataFrame, cut: Column, doc: str = "doc_id", rows: int = BUCKET_ROWS) -> DataFrame:
    """Status changes that the state machine does not allow. A history may be divided between values of `cut`, a
    monotone expression of the event time; it is divided where its rows are many."""
    divided = by_density(events, [doc], cut, rows)
    found = previous(divided, [doc], ["event_time", "seq"], F.col(DENSE), {"before": F.col("status")}).drop(DENSE)
    return found.filter(~valid_transition(F.col("before"), F.col("status")))


def status_facets(documents: DataFrame) -> DataFrame:
    return documents.groupBy(codes.document_facet(F.col("process_status")).alias("facet")).agg(F.count(F.lit(1)).alias("n_documents"))


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def get_chunks(chunks: DataFrame, doc_id: int | None = None, chunk_id: str | None = None, parent: str | None = None, version: str | None = None) -> DataFrame:
    """Chunks by document, id, parent or version, in chunk order."""
    wanted = {"doc_id": doc_id, "chunk_id": chunk_id, "parent_chunk_id": parent, "version": version}
    rows = chunks
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy("doc_id", "chunk_index")
