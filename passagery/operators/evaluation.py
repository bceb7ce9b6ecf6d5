"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagery.functions.text import is_blank, tokens
from passagery.session import materialize

def containment_truth(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (query_id, doc_id) where the document contains the query text verbatim, on word boundaries.

    Such a document has every word of the query. The rarest of them is the join key, so a query meets only the
    documents that hold its rarest word, and those are then checked in full.
    """
    words_of = lambda c: F.array_distinct(tokens(F.col(c)))
    asked = queries.filter(~is_blank(F.col("text"))).select("query_id", F.col("text").alias("query_text"))
    words = asked.select("query_id", F.explode(words_of("query_text")).alias("term"))
    doc_terms = docs.select("doc_id", F.explode(words_of("text")).alias("term")).join(
        words.select("term").distinct(), "term", "left_semi"
    )
    usage = doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    anchor = (
        words.join(usage, "term", "left").groupBy("query_id")
        .agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    )
    # written first: a small set of pairs is then broadcast to the document scan
    pairs = materialize(doc_terms.join(anchor, "term").select("query_id", "doc_id"), "pairs").join(asked, "query_id")
    checked = pairs.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "query_text"))
    aligned = F.size(F.array_except(words_of("query_text"), words_of("text"))) == 0
    return checked.filter(aligned).select("query_id", "doc_id")


def recall_at_k(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries with a true document among their first k rows; queries without truth do not count."""
    first = (
        ranked.select("query_id", "doc_id", "rank").join(truth, ["query_id", "doc_id"])
        .groupBy("query_id").agg(F.min("rank").alias("best"))
    )
    judged = truth.select("query_id").distinct().join(first, "query_id", "left")
    counts = judged.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("best") <= k).alias("n_hit")) for k in ks]).alias("hits"),
    )
    return counts.select("n_queries", F.inline("hits")).withColumn(
        "recall", F.round(F.when(F.col("n_queries") > 0, F.col("n_hit") / F.col("n_queries")), 6)
    )
