"""Search plans: recall, fusion, reranking and projection as one lazy chain over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagery import constants as K
from passagery.operators import fusion as X
from passagery.operators.keyword import Bm25Index, bm25_search
from passagery.operators.vector import scoped_vector_search, vector_search
from passagery.session import materialize

MODES = ("VECTOR_ONLY", "BM25_ONLY", "HYBRID")


@dataclass
class SearchConfig:
    fusion_mode: str = "rrf"
    rrf_k: int = K.RRF_K
    vector_weight: float = 0.5
    bm25_weight: float = 0.5
    k1: float = K.BM25_K1
    b: float = K.BM25_B
    rerank: bool = False
    rerank_multiplier: int = 3


@dataclass
class Corpus:
    """Chunks with identity columns and vectors, and their keyword index or what builds it when it is first read."""

    chunks: DataFrame
    index: Bm25Index | Callable[[], Bm25Index]
    identity: list[str] = field(default_factory=lambda: ["doc_id", "text_hash"])

    def keywords(self) -> Bm25Index:
        if callable(self.index):
            self.index = self.index()
        return self.index


def normalize_mode(mode: Column) -> Column:
    name = F.upper(F.trim(mode))
    return F.when(name.isin(*MODES), name).otherwise(F.lit("VECTOR_ONLY"))


def recall_size(k: Column, rerank: Column, mode: Column, multiplier: int = 3) -> Column:
    """Pool of a single-base search: enlarged only when a hybrid search is reranked."""
    base = F.when(k > 0, k).otherwise(K.SEARCH_K)
    return F.when(rerank & (mode == "HYBRID"), base * multiplier).otherwise(base)


def recall_size_multi(k: Column, has_whitelist: Column, expand: Column | None = None) -> Column:
    base = F.when(k > 0, k).otherwise(K.SEARCH_K)
    factor = F.lit(2) if expand is None else F.when(expand > 0, expand).otherwise(2)
    return base * factor * F.when(has_whitelist, 3).otherwise(1)


def attach(cands: DataFrame, chunks: DataFrame, columns: list[str], settle: bool = True) -> DataFrame:
    """Bring chunk columns to ranked rows. Ranking carries ids only; text is read once, for the ids that won.

    The winners are written first: their size is then known from the files, and a small set is broadcast to the
    chunk scan, so that the chunk table itself is not shuffled for a few rows.
    """
    rows = materialize(cands, "winners") if settle else cands
    return rows.join(chunks.select("chunk_id", *columns), "chunk_id")


def vector_path(queries: DataFrame, corpus: Corpus, k: int, where: Column | None = None, least: float | None = None) -> DataFrame:
    hits = vector_search(queries, corpus.chunks, k, where, least=least)
    return hits.select("query_id", F.lit("vector").alias("path"), "chunk_id", "rank", "score")


def bm25_path(queries: DataFrame, corpus: Corpus, k: int, config: SearchConfig, where: Column | None = None) -> DataFrame:
    allowed = corpus.chunks.filter(where).select("chunk_id") if where is not None else None
    hits = bm25_search(queries.select("query_id", "text"), corpus.keywords(), k, config.k1, config.b, allowed)
    return hits.select("query_id", F.lit("bm25").alias("path"), "chunk_id", "rank", "score")


def hybrid_search(
    queries: DataFrame, corpus: Corpus, k: int = K.SEARCH_K, config: SearchConfig | None = None, where: Column | None = None
) -> DataFrame:
    """Both paths take 2k candidates, fused to k."""
    cfg = config or SearchConfig()
    pool = vector_path(queries, corpus, 2 * k, where).unionByName(bm25_path(queries, corpus, 2 * k, cfg, where))
    known = attach(pool, corpus.chunks, corpus.identity)
    fused = X.fuse(known, k, cfg.fusion_mode, cfg.rrf_k, cfg.vector_weight, cfg.bm25_weight)
    return fused.select("query_id", "chunk_id", *corpus.identity, "rank", F.col("gain").alias("score"))


def search(
    queries: DataFrame, corpus: Corpus, k: int = K.SEARCH_K, config: SearchConfig | None = None, where: Column | None = None
) -> DataFrame:
    """Each query row names its own mode. One vector and one keyword search, of 2k rows, serve all modes: a single-path
    query takes the first k of its path, a hybrid one fuses both."""
    cfg = config or SearchConfig()
    moded = queries.withColumn("mode", normalize_mode(F.col("mode")))
    vector = vector_path(moded.filter("mode <> 'BM25_ONLY'"), corpus, 2 * k, where)
    keyword = bm25_path(moded.filter("mode <> 'VECTOR_ONLY'"), corpus, 2 * k, cfg, where)
    pool = materialize(vector.unionByName(keyword).join(moded.select("query_id", "mode"), "query_id"), "pool")
    single = pool.filter((F.col("mode") != "HYBRID") & (F.col("rank") <= k)).select("query_id", "chunk_id", "rank", "score")
    known = pool.filter("mode = 'HYBRID'").drop("mode").join(corpus.chunks.select("chunk_id", *corpus.identity), "chunk_id")
    fused = X.fuse(known, k, cfg.fusion_mode, cfg.rrf_k, cfg.vector_weight, cfg.bm25_weight)
    hits = single.unionByName(fused.select("query_id", "chunk_id", "rank", F.col("gain").alias("score")))
    return hits.join(moded.select("query_id", "mode"), "query_id")


def search_kb(
    queries: DataFrame, corpus: Corpus, k: int = K.SEARCH_K, config: SearchConfig | None = None, relevance=X.term_coverage
) -> DataFrame:
    """Hybrid search of one collection with an enlarged pool, reranking and the final cut."""
    cfg = config or SearchConfig(rerank=True)
    pool = k * cfg.rerank_multiplier if cfg.rerank else k
    hits = attach(hybrid_search(queries, corpus, pool, cfg), corpus.chunks, ["text"])
    if not cfg.rerank:
        return X.finalize(hits, k)
    asked = hits.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    return X.rerank(asked, relevance(F.col("query_text"), F.col("text")), k).drop("query_text")


def search_scoped(queries: DataFrame, corpus: Corpus, k: int, config: SearchConfig | None = None) -> DataFrame:
    """Each row (query_id, kb_id, text, embedding, mode) searches its own base in its own mode, vector by default.

    A (query, base) pair ranks like a query of its own, so that all bases and modes are one vector and one keyword job.
    The keyword index must be scoped by base. Rows: (query_id, kb_id, chunk_id, rank, score).
    """
    cfg = config or SearchConfig()
    pair = F.concat_ws("@", F.col("kb_id").cast("string"), F.col("query_id").cast("string"))
    mode = normalize_mode(F.col("mode")) if "mode" in queries.columns else F.lit("VECTOR_ONLY")
    asked = queries.filter(F.col("kb_id").isNotNull()).withColumn("pair", pair).withColumn("mode", mode)
    vector = scoped_vector_search(asked.filter("mode <> 'BM25_ONLY'"), corpus.chunks, "kb_id", 2 * k)
    words = asked.filter("mode <> 'VECTOR_ONLY'").select("query_id", "text", F.col("kb_id").alias("scope"))
    keyword = bm25_search(words, corpus.keywords(), 2 * k, cfg.k1, cfg.b).withColumnRenamed("scope", "kb_id")
    row = lambda df, path: df.select(pair.alias("pair"), F.lit(path).alias("path"), "chunk_id", "rank", "score")
    hits = row(vector, "vector").unionByName(row(keyword, "bm25")).join(asked.select("pair", "mode"), "pair")
    pool = attach(hits.withColumnRenamed("pair", "query_id"), corpus.chunks, corpus.identity)
    fused = X.fuse(pool.filter("mode = 'HYBRID'").drop("mode"), k, cfg.fusion_mode, cfg.rrf_k, cfg.vector_weight, cfg.bm25_weight)
    single = pool.filter((F.col("mode") != "HYBRID") & (F.col("rank") <= k)).select("query_id", "chunk_id", "rank", "score")
    both = single.unionByName(fused.select("query_id", "chunk_id", "rank", F.col("gain").alias("score")))
    return both.withColumnRenamed("query_id", "pair").join(asked.select("pair", "query_id", "kb_id"), "pair").drop("pair")


def search_base(
    queries: DataFrame, corpus: Corpus, k: int = K.SEARCH_K, config: SearchConfig | None = None, relevance=X.term_coverage
) -> DataFrame:
    """One base per query in the query's mode; only a hybrid search enlarges its pool and is reranked."""
    cfg = config or SearchConfig(rerank=True)
    factor = cfg.rerank_multiplier if cfg.rerank else 1
    mode = normalize_mode(F.col("mode"))
    hits = search_scoped(queries, corpus, k * factor, cfg)
    asked = hits.join(queries.select("query_id", mode.alias("mode"), F.col("text").alias("query_text")), "query_id")
    columns = ["query_id", "kb_id", "mode", "chunk_id", "rank", "score"]
    plain = asked.filter((F.col("rank") <= k) & ((F.col("mode") != "HYBRID") | F.lit(not cfg.rerank))).select(*columns)
    if not cfg.rerank:
        return plain
    texts = attach(asked.filter("mode = 'HYBRID'"), corpus.chunks, ["text"])
    ranked = X.rerank(texts, relevance(F.col("query_text"), F.col("text")), k)
    return plain.unionByName(ranked.select(*columns))


def multi_kb_recall(queries: DataFrame, index: Bm25Index, size: int, k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """Top rows of every knowledge base named by a query (`kb_ids`), in one job; an empty base adds nothing."""
    scattered = queries.select("query_id", "text", F.explode("kb_ids").alias("scope"))
    return bm25_search(scattered, index, size, k1, b).withColumnRenamed("scope", "kb_id")


def multi_search(
    queries: DataFrame,
    chunks: DataFrame,
    index: Bm25Index,
    k: int = K.SEARCH_K,
    allowed: DataFrame | None = None,
    expand: int = 2,
    relevance=None,
    parents: DataFrame | None = None,
    by_mode: bool = False,
) -> DataFrame:
    """Several knowledge bases: recall, whitelist, cross-base deduplication, rank, parent texts, cut.

    Recall is by keywords, or with `by_mode` in the mode of each query (then with an embedding).
    """
    size = k * expand * (3 if allowed is not None else 1)
    if by_mode:
        recalled = search_scoped(queries.withColumn("kb_id", F.explode("kb_ids")), Corpus(chunks, index), size)
    else:
        recalled = multi_kb_recall(queries, index, size)
    base_no = queries.select("query_id", F.posexplode("kb_ids").alias("kb_pos", "kb_id"))
    placed = recalled.join(base_no, ["query_id", "kb_id"])
    extra = [c for c in ("doc_id", "text_hash", "chunk_type", "parent_chunk_id", "text") if c in chunks.columns]
    rows = attach(placed, chunks, extra).withColumn("position", F.struct("kb_pos", "rank"))
    if allowed is not None:
        rows = X.whitelist(rows, allowed)
    single = X.dedup_cross_kb(rows)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("position"))
    single = single.withColumn("rank", F.row_number().over(by_score)).drop("position", "kb_pos")
    if relevance is not None:
        asked = single.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
        single = X.rerank(asked, relevance(F.col("query_text"), F.col("text"))).drop("query_text")
    cut = single.filter(F.col("rank") <= k)
    return X.parent_enhance(cut, parents) if parents is not None else cut
