"""Registered queries: fusion, deduplication, reranking and the search chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagery.functions.text import text_hash
from passagery.operators import chunking as C, fusion as X
from passagery.operators.embedding import embed
from passagery.operators.keyword import bm25_search, build_bm25_index
from passagery.plans import search as P
from passagery.session import materialize
from passagery.workload import base, sqlgen as S
from passagery.workload.registry import Tables, query
from passagery.workload.retrieval import BY_MODE_SQL, FUSED_SQL, SCATTER_SQL, SCOPED_SQL, by_mode, scattered, scoped_corpus
from passagery.workload.text import HIER_SQL, multi_part_texts


def candidates(t: Tables, k: int = 10):
    """Both retrieval paths with k rows each and the identity of every chunk."""
    corpus, queries = base.embedded_corpus(t), base.embedded_queries(t)
    pool = P.vector_path(queries, corpus, k).unionByName(P.bm25_path(queries, corpus, k, P.SearchConfig()))
    return P.attach(pool, corpus.chunks, ["doc_id", "text_hash"])


POOL = (S.VECTORS, S.bm25(), S.pool(10))


@query(S.retrieval(*POOL) + " SELECT query_id, path, count(*) AS n FROM pool WHERE rank <= 6 GROUP BY ALL")
def candidate_limits(t: Tables):
    return X.limit_candidates(candidates(t), 3).groupBy("query_id", "path").agg(F.count(F.lit(1)).alias("n"))


RANKED_SQL = """
sums AS (SELECT query_id, text_hash, round(sum(1.0 / (60.0 + rank)), 12) AS s, min({{'po': po, 'rank': rank}}) AS place, count(*) AS n_paths,
         arg_min(chunk_id, {{'po': po, 'rank': rank}}) AS chunk_id FROM pool WHERE rank <= 10 GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY {order}, place, text_hash))::INTEGER AS rank FROM sums)"""


@query(S.retrieval(*POOL, RANKED_SQL.format(order="s DESC"))
       + " SELECT query_id, chunk_id, rank, round(s, 8) AS rrf_score, n_paths FROM r WHERE rank <= 5")
def rrf_fusion(t: Tables):
    fused = X.rrf_fuse(candidates(t), 5)
    return fused.select("query_id", "chunk_id", "rank", F.round("rrf_score", 8).alias("rrf_score"), "n_paths")


def weighted_sql(combine: str, wv: float, wb: float) -> str:
    return S.retrieval(*POOL, f"""
lim AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM pool WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id, path)),
sums AS (SELECT query_id, text_hash, round({combine}(CASE WHEN hi - lo <= 1e-10 THEN 1.0 ELSE (score - lo) / (hi - lo) END
           * CASE WHEN path = 'vector' THEN {wv} ELSE {wb} END), 12) AS s, min({{'po': po, 'rank': rank}}) AS place,
         arg_min(chunk_id, {{'po': po, 'rank': rank}}) AS chunk_id FROM lim GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place, text_hash))::INTEGER AS rank FROM sums)""") + (
        " SELECT query_id, chunk_id, rank, round(s, 6) AS weighted_score FROM r WHERE rank <= 5"
    )


@query(weighted_sql("max", 0.5, 0.5))
def weighted_fusion(t: Tables):
    fused = X.weighted_fuse(candidates(t), 5)
    return fused.select("query_id", "chunk_id", "rank", F.round("weighted_score", 6).alias("weighted_score"))


@query(weighted_sql("sum", 0.4, 0.6))
def weighted_fusion_sum(t: Tables):
    fused = X.weighted_fuse(candidates(t), 5, 0.4, 0.6, "sum")
    return fused.select("query_id", "chunk_id", "rank", F.round("weighted_score", 6).alias("weighted_score"))


@query(S.retrieval(*POOL) + """ SELECT query_id, path, chunk_id, round(CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-10 THEN 1.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 5) AS scaled FROM pool WINDOW w AS (PARTITION BY query_id, path)""")
def minmax_scores(t: Tables):
    rows = candidates(t)
    return rows.select("query_id", "path", "chunk_id", F.round(X.minmax(rows, ["query_id", "path"]), 5).alias("scaled"))


@query(S.retrieval(*POOL, FUSED_SQL.format(limit=10))
       + " SELECT query_id, chunk_id, round(gain, 8) AS gain, path_rank AS rank FROM single")
def instance_dedup(t: Tables):
    rows = candidates(t).withColumn("gain", 1.0 / (60.0 + F.col("rank")))
    return X.dedup_instances(rows).select("query_id", "chunk_id", F.round("gain", 8).alias("gain"), "rank")


@query(S.retrieval(*POOL, FUSED_SQL.format(limit=10)) + " SELECT query_id, chunk_id, text_hash FROM content")
def content_dedup(t: Tables):
    rows = candidates(t).withColumn("gain", 1.0 / (60.0 + F.col("rank")))
    return X.dedup_content(X.dedup_instances(rows)).select("query_id", "chunk_id", "text_hash")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'hash:' || sha256(text) WHEN role = 'system' AND text <> '' THEN 'txt:' || sha256(text)
  WHEN turn % 3 = 1 THEN 'cid:' || turn ELSE 'id:' || conv_id END AS fusion_key FROM conversations""")
def fusion_keys(t: Tables):
    assistant = F.col("role") == "assistant"
    rows = t.conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "user", text_hash(F.col("text"))).otherwise(" ").alias("text_hash"),
        F.when(assistant & (F.col("turn") % 3 == 1), F.col("turn").cast("string")).alias("chunk_id"),
        F.when(assistant, F.col("conv_id").cast("string")).alias("record_id"), "text",
    )
    return rows.select("conv_id", "turn", X.fusion_key(rows).alias("fusion_key"))


CROSS_SQL = """
twice AS (SELECT query_id, scope, chunk_id, score, kb_pos, rank FROM r UNION ALL SELECT query_id, scope, chunk_id, score * 1.5, kb_pos + 10, rank FROM r WHERE rank > 1),
one AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, kb_pos, rank) = 1)"""


@query(S.retrieval(S.bm25("kb_id"), SCATTER_SQL, S.top("hits", 4, "r", "query_id, scope", "query_id, scope, chunk_id, score, kb_pos"), CROSS_SQL)
       + " SELECT query_id, chunk_id, kb_pos, round(score, 7) AS score FROM one")
def cross_kb_dedup(t: Tables):
    """Candidates that reach the pool twice, the second time with a higher score for all but the first rank."""
    chunks = base.stored_chunks(t)
    hits = P.multi_kb_recall(scattered(t), base.corpus_index(t, "kb_id"), 4)
    placed = hits.join(scattered(t).select("query_id", F.posexplode("kb_ids").alias("kb_pos", "kb_id")), ["query_id", "kb_id"])
    again = placed.filter(F.col("rank") > 1).withColumn("score", F.col("score") * 1.5).withColumn("kb_pos", F.col("kb_pos") + 10)
    rows = P.attach(placed.unionByName(again), chunks, ["doc_id"])
    single = X.dedup_cross_kb(rows.withColumn("position", F.struct("kb_pos", "rank")))
    return single.select("query_id", "chunk_id", "kb_pos", F.round("score", 7).alias("score"))


def good_documents(t: Tables):
    return t.labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


@query(S.retrieval(*POOL) + """ SELECT query_id, path, chunk_id FROM pool
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""")
def document_whitelist(t: Tables):
    return X.whitelist(candidates(t), good_documents(t)).select("query_id", "path", "chunk_id")


@query(S.retrieval(*POOL) + """ SELECT query_id, path, chunk_id FROM pool WHERE NOT (path = 'vector' AND score < 0.75)""")
def similarity_threshold(t: Tables):
    """Keyword candidates carry no similarity and stay."""
    rows = candidates(t).withColumn("score", F.when(F.col("path") == "vector", F.col("score")))
    return X.similarity_filter(rows, 0.75).select("query_id", "path", "chunk_id")


COVER = f"""(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), {S.TOK})), list_distinct(regexp_extract_all(lower(c.text), {S.TOK}))))
  / len(list_distinct(regexp_extract_all(lower(q.text), {S.TOK})))::DOUBLE)"""


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r"), f"""
rel AS (SELECT r.query_id, r.chunk_id, r.rank AS prior, {COVER} AS relevance FROM r JOIN queries q USING (query_id) JOIN chunks c USING (chunk_id))""") + """
SELECT query_id, chunk_id, prior, round(relevance, 6) AS relevance, (row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, prior))::INTEGER AS rank
FROM rel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, prior) <= 4""")
def rerank_by_coverage(t: Tables):
    chunks = base.stored_chunks(t)
    hits = bm25_search(base.benchmark_queries(t), base.corpus_index(t), 10)
    rows = P.attach(hits, chunks, ["text"]).join(
        base.benchmark_queries(t).withColumnRenamed("text", "query_text"), "query_id"
    ).withColumn("prior", F.col("rank"))
    ranked = X.rerank(rows, X.term_coverage(F.col("query_text"), F.col("text")), 4)
    return ranked.select("query_id", "chunk_id", "prior", F.round("relevance", 6).alias("relevance"), "rank")


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r"), """
rel AS (SELECT r.*, CASE WHEN length(c.text) > 600 AND length(q.text) > 150 THEN c.chunk_index::DOUBLE END AS relevance,
        max(CASE WHEN length(c.text) > 600 AND length(q.text) > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY r.query_id) AS any_rel,
        count(*) OVER (PARTITION BY r.query_id) AS n
  FROM r JOIN queries q USING (query_id) JOIN chunks c USING (chunk_id))""") + """
SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_rel = 1 THEN coalesce(relevance, 0) ELSE 0 END DESC, rank))::INTEGER AS rank FROM rel""")
def rerank_with_gaps(t: Tables):
    """A scorer that misses some rows (they count 0) and fails for short queries (their order stays)."""
    chunks = base.stored_chunks(t)
    hits = bm25_search(base.benchmark_queries(t), base.corpus_index(t), 10)
    rows = P.attach(hits, chunks, ["text", "chunk_index"]).join(
        base.benchmark_queries(t).withColumnRenamed("text", "query_text"), "query_id"
    )
    known = (F.length("text") > 600) & (F.length("query_text") > 150)
    return X.rerank(rows, F.when(known, F.col("chunk_index").cast("double"))).select("query_id", "chunk_id", "rank")


@query(S.retrieval(S.bm25(), S.top("bm", 45, "r"), """
b AS (SELECT r.*, (r.rank - 1) // 20 AS batch, 1.0::DOUBLE / (1 + abs(length(c.text) - length(q.text))) AS close, length(c.text) AS n
  FROM r JOIN queries q USING (query_id) JOIN chunks c USING (chunk_id)),
f AS (SELECT *, first_value(n) OVER (PARTITION BY query_id, batch ORDER BY rank) % 3 = 0 AS failed, count(*) OVER (PARTITION BY query_id) AS pool FROM b),
v AS (SELECT *, CASE WHEN pool = 1 THEN 1.0 WHEN NOT failed THEN close END AS relevance FROM f)""") + """
SELECT query_id, chunk_id, round(relevance, 6) AS relevance,
  (row_number() OVER (PARTITION BY query_id ORDER BY coalesce(relevance, 0) DESC, rank))::INTEGER AS rank FROM v""")
def reranked_in_batches(t: Tables):
    """Up to three batches a query, scored by closeness of length; the scorer fails where the first text's length is a
    multiple of three."""
    def closeness(asked: str, texts: list[str]) -> list[float]:
        if len(texts[0]) % 3 == 0:
            raise ConnectionError("no answer")
        return [1.0 / (1 + abs(len(text) - len(asked))) for text in texts]

    hits = bm25_search(base.benchmark_queries(t), base.corpus_index(t), 45)
    rows = P.attach(hits, base.stored_chunks(t), ["text"]).join(base.benchmark_queries(t).withColumnRenamed("text", "query_text"), "query_id")
    return X.rerank_in_batches(rows, closeness).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "rank")


def hierarchical_corpus(t: Tables):
    return C.chunk_hierarchical(multi_part_texts(t)).withColumn("text_hash", text_hash(F.col("text")))


HIER_BM = (
    HIER_SQL + ", chunks AS (SELECT *, 0 AS kb_id FROM hier), kid AS (SELECT * FROM chunks WHERE chunk_type = 'child'), " + S.QUERIES
    + "," + S.bm25("0", "kid") + "," + S.top("bm", 5, "r")
)


@query(HIER_BM + """ SELECT r.query_id, r.chunk_id, r.rank, md5(p.text) AS text_md5, true AS parent_enhanced
FROM r JOIN chunks c USING (chunk_id) JOIN chunks p ON p.chunk_id = c.pid""")
def parent_texts(t: Tables):
    corpus = materialize(C.chunk_hierarchical(multi_part_texts(t)), "chunks")
    kids = corpus.filter(F.col("chunk_type") == "child")
    hits = bm25_search(base.benchmark_queries(t), build_bm25_index(kids), 5)
    rows = P.attach(hits, corpus, ["text", "chunk_type", "parent_chunk_id"])
    full = X.parent_enhance(rows, corpus)
    return full.select("query_id", "chunk_id", "rank", F.md5("text").alias("text_md5"), "parent_enhanced")


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r")) + """
SELECT query_id, chunk_id, round(s, 6) AS score, (row_number() OVER w)::INTEGER AS rank FROM (
  SELECT r.*, CASE WHEN rank % 2 = 0 THEN score * 2 ELSE score END AS s FROM r)
WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, rank, chunk_id) QUALIFY row_number() OVER w <= 3""")
def final_ranking(t: Tables):
    hits = bm25_search(base.benchmark_queries(t), base.corpus_index(t), 10)
    rows = hits.withColumn("relevance", F.when(F.col("rank") % 2 == 0, F.col("score") * 2))
    return X.finalize(rows, 3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


MULTI_SQL = f"""
one AS (SELECT r.*, c.doc_id, (row_number() OVER (PARTITION BY r.query_id ORDER BY score DESC, kb_pos, r.rank))::INTEGER AS prior
        FROM r JOIN chunks c USING (chunk_id) WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)),
rel AS (SELECT one.*, CASE WHEN count(*) OVER (PARTITION BY query_id) = 1 THEN 1.0 ELSE {COVER} END AS relevance
        FROM one JOIN queries q USING (query_id) JOIN chunks c USING (chunk_id)),
done AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, prior))::INTEGER AS final FROM rel)"""


@query(S.retrieval(S.bm25("kb_id"), SCATTER_SQL, S.top("hits", 18, "r", "query_id, scope", "query_id, scope, chunk_id, score, kb_pos"), MULTI_SQL)
       + " SELECT query_id, scope AS kb_id, chunk_id, doc_id, final AS rank, round(relevance, 6) AS relevance FROM done WHERE final <= 3")
def multi_kb_search(t: Tables):
    chunks = base.stored_chunks(t)
    hits = P.multi_search(scattered(t), chunks, base.corpus_index(t, "kb_id"), 3, good_documents(t), relevance=X.term_coverage)
    return hits.select("query_id", "kb_id", "chunk_id", "doc_id", "rank", F.round("relevance", 6).alias("relevance"))


KIDS_SQL = HIER_SQL + """, chunks AS (SELECT doc_id, (doc_id % 20)::INTEGER AS kb_id, text, sha256(text) AS text_hash, chunk_id, pid FROM hier WHERE chunk_type = 'child'),
""" + ",\n".join((S.QUERIES, S.VECTORS, S.bm25("kb_id"), SCATTER_SQL, SCOPED_SQL, S.pool(36, "vec2", "bm2"), FUSED_SQL.format(limit=36), BY_MODE_SQL, """
r AS (SELECT a.query_id, a.scope, chunk_id, rank, score, kb_pos FROM ranked JOIN modes USING (query_id, mode) JOIN asked a ON a.query_id = asked_id AND a.scope = kb_id WHERE rank <= 18)""", MULTI_SQL))


@query(KIDS_SQL + """ SELECT d.query_id, d.scope AS kb_id, d.chunk_id, d.final AS rank, md5(h.text) AS text_md5, true AS parent_enhanced
FROM done d JOIN chunks c USING (chunk_id) JOIN hier h ON h.chunk_id = c.pid WHERE final <= 3""")
def multi_kb_search_by_mode(t: Tables):
    """Children of several bases in the mode of each query, whitelisted, reranked, and shown with the text of their parents."""
    corpus = materialize(hierarchical_corpus(t).withColumn("kb_id", (F.col("doc_id") % 20).cast("int")), "chunks")
    kids = materialize(embed(corpus.filter(F.col("chunk_type") == "child")), "children")
    asked = materialize(embed(by_mode(scattered(t))), "asked")
    hits = P.multi_search(
        asked, kids, build_bm25_index(kids, scope="kb_id"), 3, good_documents(t), relevance=X.term_coverage, parents=corpus, by_mode=True)
    return hits.select("query_id", "kb_id", "chunk_id", "rank", F.md5("text").alias("text_md5"), "parent_enhanced")


@query(S.retrieval(S.VECTORS, S.bm25(), S.pool(30), FUSED_SQL.format(limit=30), f"""
rel AS (SELECT fused.*, {COVER} AS relevance FROM fused JOIN queries q USING (query_id) JOIN chunks c USING (chunk_id) WHERE rank <= 15)""") + """
SELECT query_id, chunk_id, (row_number() OVER w)::INTEGER AS rank, round(relevance, 6) AS relevance FROM rel
WINDOW w AS (PARTITION BY query_id ORDER BY relevance DESC, rank) QUALIFY row_number() OVER w <= 5""")
def single_kb_search(t: Tables):
    hits = P.search_kb(base.embedded_queries(t), base.embedded_corpus(t), 5)
    return hits.select("query_id", "chunk_id", "rank", F.round("relevance", 6).alias("relevance"))


ONE_BASE_SQL = """
asked AS (SELECT query_id, (length(text) % 20)::INTEGER AS scope FROM queries)"""


@query(S.retrieval(S.VECTORS, S.bm25("kb_id"), ONE_BASE_SQL, SCOPED_SQL, S.pool(18, "vec2", "bm2"), FUSED_SQL.format(limit=18), BY_MODE_SQL, f"""
own AS (SELECT asked_id AS query_id, kb_id, mode, chunk_id, rank, score FROM ranked JOIN modes USING (query_id, mode) WHERE rank <= 9),
rel AS (SELECT own.*, count(*) OVER (PARTITION BY query_id) AS n, {COVER} AS relevance FROM own JOIN queries q USING (query_id)
        JOIN chunks c USING (chunk_id) WHERE mode = 'HYBRID'),
again AS (SELECT query_id, kb_id, mode, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 1 THEN 1.0 ELSE relevance END DESC, rank))::INTEGER AS rank FROM rel)""")
       + """ SELECT query_id, kb_id, mode, chunk_id, rank FROM own WHERE mode <> 'HYBRID' AND rank <= 3
UNION ALL SELECT query_id, kb_id, mode, chunk_id, rank FROM again WHERE rank <= 3""")
def single_kb_by_mode(t: Tables):
    """One base for each query, in the query's mode; hybrid results are reranked from a larger pool."""
    asked = by_mode(base.embedded_queries(t)).withColumn("kb_id", (F.length("text") % 20).cast("int"))
    return P.search_base(asked, scoped_corpus(t), 3).select("query_id", "kb_id", "mode", "chunk_id", "rank")
