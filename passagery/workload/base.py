"""Inputs shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from passagery.functions import text as T
from passagery.operators import chunking as C, embedding as E
from passagery.operators.keyword import Bm25Index, build_bm25_index
from passagery.operators.postings import PostingsIndex, build_postings
from passagery.plans.search import Corpus
from passagery.session import materialize, shared_dir
from passagery.sources.tables import spread
from passagery.workload.registry import Tables


def kb_of_source(source: str = "source"):
    return F.regexp_extract(source, "([0-9]+)", 1).cast("int")


def documents(t: Tables) -> DataFrame:
    return spread(t.documents, "doc_id")


def corpus_chunks(t: Tables) -> DataFrame:
    """Text-model chunks of all documents; the source of a document is its knowledge base."""
    docs = documents(t).select("doc_id", "lang", kb_of_source().alias("kb_id"), "text")
    return C.chunk_text_model(docs).withColumn("text_hash", T.text_hash(F.col("text")))


_built: dict[tuple, object] = {}


def once(t: Tables, what: str, make: Callable[[], object], reads: tuple[str, ...] = ("documents",)):
    """What `make` writes for a state of the tables it `reads` is written once an application and then read again."""
    spark = t.spark

    def changed(name: str) -> int:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{name}.parquet")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()

    key = (spark.sparkContext.applicationId, shared_dir(spark), t.folder, *map(changed, reads), what)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def stored_chunks(t: Tables) -> DataFrame:
    """The chunk table as it lies in storage: chunked once, then read column by column."""
    return once(t, "chunks", lambda: materialize(corpus_chunks(t), "chunks"))


def benchmark_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def embedded_queries(t: Tables) -> DataFrame:
    return once(t, "queries", lambda: materialize(E.embed(benchmark_queries(t)), "queries"), ("benchmark",))


def embedded_chunks(t: Tables) -> DataFrame:
    return once(t, "embedded", lambda: materialize(E.embed(stored_chunks(t)), "embedded"))


def embedded_corpus(t: Tables, scope: str | None = None) -> Corpus:
    return Corpus(embedded_chunks(t), lambda: corpus_index(t, scope))


def corpus_index(t: Tables, scope: str | None = None) -> Bm25Index:
    return once(t, f"index by {scope}", lambda: build_bm25_index(stored_chunks(t), scope=scope))


def corpus_postings(t: Tables, scope: str | None = None) -> PostingsIndex:
    return once(t, f"postings by {scope}", lambda: build_postings(corpus_index(t, scope)))
