"""Fusion, deduplication, thresholds and final ranking of candidate rows.

Candidates: query_id, path, rank (from 1), score, and identity columns doc_id, chunk_id, text_hash, record_id, text.
Every step is keyed by query, so one partitioning by query serves the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagery import constants as K
from passagery.functions.text import null_if_blank, tokens
from passagery.session import materialize

EPS = 1e-10
DIGITS = 12


def path_order(path: Column) -> Column:
    return F.when(path == "vector", 0).otherwise(1)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def limit_candidates(cands: DataFrame, k: int) -> DataFrame:
    return cands.filter(F.col("rank") <= 2 * k)


def text_identity(df: DataFrame, compat: bool = False) -> Column:
    """Identity of a candidate by its text: the hash of all of it, or with `compat` its first 64 characters."""
    text = null_if_blank(_optional(df, "text"))
    return F.concat(F.lit("txt:"), F.substring(text, 1, 64) if compat else F.sha2(text, 256))


def fusion_key(df: DataFrame, compat: bool = False) -> Column:
    """Identity of a candidate: text hash, else chunk, else record, else the text."""
    tagged = lambda tag, name: F.concat(F.lit(tag), null_if_blank(_optional(df, name)))
    return F.coalesce(
        tagged("hash:", "text_hash"), tagged("cid:", "chunk_id"), tagged("id:", "record_id"), text_identity(df, compat), F.lit("")
    )


def minmax(df: DataFrame, by: list[str], score: str = "score") -> Column:
    """Score scaled to 0..1 within its group; a group without spread is all 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    scaled = F.when(high - low <= EPS, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))
    return F.when(F.col(score).isNotNull(), scaled)


def top_ranked(df: DataFrame, k: int, order: list[Column], out: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def _fuse(cands: DataFrame, k: int, gain: Column, combine: str, out: str) -> DataFrame:
    keyed = cands.withColumn("fusion_key", fusion_key(cands)).withColumn("gain", gain)
    total = F.sum("gain") if combine == "sum" else F.max("gain")
    place = F.struct(path_order(F.col("path")).alias("path_ord"), F.col("rank").alias("path_rank"))
    carried = [c for c in cands.columns if c not in ("query_id", "path", "rank", "score")]
    fused = keyed.groupBy("query_id", "fusion_key").agg(
        F.round(total, DIGITS).alias(out), F.min(place).alias("place"),
        F.min_by(F.struct(*carried), place).alias("row"), F.count(F.lit(1)).alias("n_paths"),
    )
    ranked = top_ranked(fused, k, [F.col(out).desc(), F.col("place"), F.col("fusion_key")])
    return ranked.select("query_id", "fusion_key", "rank", out, "n_paths", "row.*")


def rrf_fuse(cands: DataFrame, k: int, rrf_k: int = K.RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (rrf_k + rank) over the paths."""
    constant = rrf_k if rrf_k > 0 else K.RRF_K
    return _fuse(limit_candidates(cands, k), k, 1.0 / (F.lit(float(constant)) + F.col("rank")), "sum", "rrf_score")


def weighted_fuse(cands: DataFrame, k: int, wv: float = 0.5, wb: float = 0.5, combine: str = "max") -> DataFrame:
    """Scores scaled per path, weighted by path, and combined on collision."""
    limited = limit_candidates(cands, k)
    scaled = limited.withColumn("scaled", minmax(limited, ["query_id", "path"]))
    weight = F.when(F.col("path") == "vector", F.lit(wv)).otherwise(F.lit(wb))
    fused = _fuse(scaled, k, F.coalesce(F.col("scaled"), F.lit(0.0)) * weight, combine, "weighted_score")
    return fused.drop("scaled")


def dedup_instances(cands: DataFrame, mode: str = "rrf") -> DataFrame:
    """One row per (document, chunk): gains add up in rank fusion, the best counts in weighted fusion."""
    has_ids = null_if_blank(_optional(cands, "doc_id")).isNotNull() & null_if_blank(_optional(cands, "chunk_id")).isNotNull()
    pair = F.concat(_optional(cands, "doc_id"), F.lit("_"), _optional(cands, "chunk_id"))
    fallback = F.coalesce(
        F.concat(F.lit("id:"), null_if_blank(_optional(cands, "record_id"))), text_identity(cands), F.lit("")
    )
    keyed = cands.withColumn("instance", F.when(has_ids, pair).otherwise(fallback))
    place = F.struct(F.col("rank"), path_order(F.col("path")).alias("path_ord"))
    carried = [c for c in cands.columns if c not in ("query_id", "rank", "gain")]
    total = F.max("gain") if mode == "weighted" else F.sum("gain")
    merged = keyed.groupBy("query_id", "instance").agg(
        F.round(total, DIGITS).alias("gain"), F.min("rank").alias("rank"), F.min_by(F.struct(*carried), place).alias("row")
    )
    return merged.select("query_id", "instance", "gain", "rank", "row.*")


def dedup_content(cands: DataFrame, gain: str = "gain") -> DataFrame:
    """One row per text: the best gain, on a tie the better rank. Rows without a hash are all kept."""
    hashed = F.coalesce(
        F.concat(F.lit("hash:"), null_if_blank(_optional(cands, "text_hash"))), F.concat(F.lit("row:"), _optional(cands, "chunk_id"))
    )
    w = Window.partitionBy("query_id", "content").orderBy(F.col(gain).desc(), F.col("rank"), F.col("chunk_id"))
    return (
        cands.withColumn("content", hashed).withColumn("copy", F.row_number().over(w)).filter(F.col("copy") == 1).drop("copy", "content")
    )


def fuse(cands: DataFrame, k: int, mode: str = "rrf", rrf_k: int = K.RRF_K, wv: float = 0.5, wb: float = 0.5) -> DataFrame:
    """The hybrid chain: limit, gain per path, two deduplication rounds, ranking. A path without rows needs no
    special case: the other path's rows are then simply all there are."""
    limited = limit_candidates(cands, k)
    if mode == "weighted":
        weight = F.when(F.col("path") == "vector", F.lit(wv)).otherwise(F.lit(wb))
        gain = F.coalesce(minmax(limited, ["query_id", "path"]), F.lit(0.0)) * weight
    else:
        gain = 1.0 / (F.lit(float(rrf_k if rrf_k > 0 else K.RRF_K)) + F.col("rank"))
    single = dedup_content(dedup_instances(limited.withColumn("gain", gain), mode))
    ranked = single.withColumnRenamed("rank", "path_rank")
    return top_ranked(ranked, k, [F.col("gain").desc(), F.col("path_rank"), F.col("chunk_id")])


def dedup_cross_kb(cands: DataFrame) -> DataFrame:
    """One row per chunk over several knowledge bases: the higher score, on a tie the earlier one."""
    doc, chunk, record, hashed = (_optional(cands, c) for c in ("doc_id", "chunk_id", "record_id", "text_hash"))
    key = F.coalesce(
        F.concat(doc, F.lit("|"), chunk), F.concat(F.lit("rid:"), record), F.concat(doc, F.lit("|"), hashed),
        F.concat(F.lit("id:"), _optional(cands, "id")),
    )
    w = Window.partitionBy("query_id", "dedup_key").orderBy(F.coalesce(F.col("score"), F.lit(0.0)).desc(), F.col("position"))
    return (
        cands.withColumn("dedup_key", key).withColumn("copy", F.row_number().over(w)).filter(F.col("copy") == 1).drop("copy", "dedup_key")
    )


def whitelist(cands: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keep candidates of allowed documents; `allowed` holds doc_id, or (query_id, doc_id)."""
    keys = [c for c in ("query_id", "doc_id") if c in allowed.columns]
    return cands.join(allowed.select(*keys), keys, "left_semi")


def similarity_filter(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """Rows at or above the threshold; rows without a score stay; a threshold outside (0, 1] filters nothing."""
    if threshold is None or not 0.0 < threshold <= 1.0:
        return df
    return df.filter(F.col(score).isNull() | (F.col(score) >= threshold))


def term_coverage(query: Column, text: Column) -> Column:
    """Share of the distinct query words that the text contains."""
    words = F.array_distinct(tokens(query))
    found = F.size(F.array_intersect(words, tokens(text)))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(F.lit(0.0))


def rerank(cands: DataFrame, relevance: Column, top_n: int | None = None) -> DataFrame:
    """Reorder by relevance. A lone candidate counts 1; when no candidate of a query got a relevance the order stays."""
    w = Window.partitionBy("query_id")
    scored = cands.withColumn("relevance", relevance).withColumn("n_cands", F.count(F.lit(1)).over(w))
    scored = scored.withColumn("relevance", F.when(F.col("n_cands") == 1, F.lit(1.0)).otherwise(F.col("relevance")))
    any_score = F.count("relevance").over(w) > 0
    scored = scored.withColumn("sort_key", F.when(any_score, F.coalesce(F.col("relevance"), F.lit(0.0))))
    order = Window.partitionBy("query_id").orderBy(F.col("sort_key").desc_nulls_last(), F.col("rank"))
    ranked = scored.withColumn("new_rank", F.row_number().over(order))
    if top_n is not None:
        ranked = ranked.filter(F.col("new_rank") <= top_n)
    return ranked.drop("sort_key", "n_cands", "rank").withColumnRenamed("new_rank", "rank")


def rerank_in_batches(
    cands: DataFrame, scorer: Callable[[str, list[str]], list[float]], size: int = K.RERANK_BATCH, top_n: int | None = None
) -> DataFrame:
    """Rerank by a scorer of a query and at most `size` texts at a time; needs `query_text` and `text`.

    Batches follow the old order. A batch on which the scorer fails, or gives no score for, keeps its old order and counts
    0; then all batches are merged by score. A query all of whose batches fail keeps its order, a lone candidate counts
    1. A task holds one batch at a time, so neither the pool of a query nor the number of queries is bounded. Null texts
    are empty.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    batch = F.floor((place - 1) / size).cast("int")
    placed = cands.withColumn("__place", place).withColumn("__batch", batch)
    kind = cands.schema["query_id"].dataType.simpleString()

    def score(key, rows):
        rows = rows.sort_values("__place")
        try:
            found = list(scorer(rows["query_text"].iloc[0], rows["text"].fillna("").tolist()))
        except Exception:  # whatever a remote model may raise: the batch keeps its order
            found = []
        values = [float(x) for x in found[: len(rows)]]
        return rows[["query_id", "__place"]].assign(__relevance=values + [None] * (len(rows) - len(values)))

    scored = placed.select("query_id", "__place", "__batch", "query_text", "text").groupBy("query_id", "__batch").applyInPandas(
        score, f"query_id {kind}, __place int, __relevance double")
    rows = placed.drop("__batch").join(scored, ["query_id", "__place"])
    return rerank(rows, F.col("__relevance"), top_n).drop("__place", "__relevance")


def parent_enhance(cands: DataFrame, chunks: DataFrame) -> DataFrame:
    """Give child candidates the text of their parent, looked up in the full chunk table.

    The candidates are written first, so their size is known: the chunk table is reduced to the wanted parents by a
    semi join with a small set before any of its text moves.
    """
    cands = materialize(cands, "candidates")
    wanted = cands.filter((F.col("chunk_type") == "child") & F.col("parent_chunk_id").isNotNull()).select("parent_chunk_id").distinct()
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text")).join(
        wanted, "parent_chunk_id", "left_semi"
    )
    child = (F.col("chunk_type") == "child") & null_if_blank(F.col("parent_text")).isNotNull()
    return (
        cands.join(parents, "parent_chunk_id", "left")
        .withColumn("parent_enhanced", child)
        .withColumn("text", F.when(child, F.col("parent_text")).otherwise(F.col("text")))
        .drop("parent_text")
    )


def finalize(cands: DataFrame, k: int) -> DataFrame:
    """Final order by relevance, else score; the first k; score shown is the one ranked by."""
    relevance = F.col("relevance") if "relevance" in cands.columns else F.lit(None).cast("double")
    shown = cands.withColumn("shown_score", F.coalesce(relevance, F.col("score")))
    ranked = top_ranked(shown.withColumnRenamed("rank", "prior"), k, [F.coalesce(F.col("shown_score"), F.lit(0.0)).desc(), F.col("prior"), F.col("chunk_id")])
    return ranked.drop("score", "prior").withColumnRenamed("shown_score", "score")
