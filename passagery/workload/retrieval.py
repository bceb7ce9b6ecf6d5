"""Registered queries: embedding, vector, keyword and hybrid retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from passagery.functions import codes, text as T, vectors
from passagery.functions.filters import filter_expr
from passagery.operators import embedding as E, keyword as B, postings as PO, vector as V
from passagery.operators.evaluation import containment_truth, recall_at_k as recall
from passagery.plans import search as P
from passagery.session import materialize
from passagery.workload import base, sqlgen as S
from passagery.workload.registry import Tables, query


@query(S.retrieval(S.hashed("documents", "doc_id", "dv")) + """
SELECT id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * i)), 5) AS weighted_sum,
  round(list_dot_product(e, e), 5) AS norm, len(e)::INTEGER AS dim FROM dv""")
def embeddings_of_documents(t: Tables):
    rows = E.embed(base.documents(t).select("doc_id", "text"))
    weights = F.array(*[F.lit(float(i)) for i in range(1, 65)])
    e = F.col("embedding")
    return rows.select(
        "doc_id", F.round(vectors.dot(e, weights), 5).alias("weighted_sum"), F.round(vectors.dot(e, e), 5).alias("norm"),
        F.size(e).alias("dim"),
    )


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'bge-m3' WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'openai'
  ELSE 'tongyi' END AS family FROM customer""")
def embedding_families(t: Tables):
    wish = (
        F.when(F.col("c_mktsegment") == "BUILDING", "BAAI/bge-large").when(F.col("c_mktsegment") == "MACHINERY", "text-embedding-3")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "my-Ada-2").when(F.col("c_mktsegment") == "FURNITURE", " ")
    )
    return t.customer.select("c_custkey", codes.embedding_family(wish).alias("family"))


@query("""SELECT a.vec_id, round(list_dot_product(e1, e2) / (sqrt(list_dot_product(e1, e1)) * sqrt(list_dot_product(e2, e2))), 6) AS cosine
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e1 FROM embeddings) a
JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS e2 FROM embeddings) b USING (vec_id)""")
def neighbour_cosine(t: Tables):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


EMB_SQL = f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, {S.cosine('a.v', 'b.v')} AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


def vectors_as_chunks(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "label", "embedding")


def vectors_as_queries(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")


@query(EMB_SQL + ", " + S.top("s", 5, "r") + " SELECT query_id, chunk_id, rank, round((1.0 + score) / 2.0, 6) AS score FROM r")
def vector_topk(t: Tables):
    hits = V.vector_search(vectors_as_queries(t), vectors_as_chunks(t), 5, skip_self=True)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(EMB_SQL + ", f AS (SELECT * FROM s WHERE label IN (1, 3, 5) OR label >= 8), " + S.top("f", 5, "r")
       + " SELECT query_id, chunk_id, rank, round((1.0 + score) / 2.0, 6) AS score FROM r")
def vector_topk_filtered(t: Tables):
    where = filter_expr(("or", ("in", "label", [1, 3, 5]), ("not", ("lt", "label", 8))))
    hits = V.vector_search(vectors_as_queries(t), vectors_as_chunks(t), 5, where, skip_self=True)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(EMB_SQL + ", " + S.top("s", 5, "r") + " SELECT query_id, chunk_id, rank, round((1.0 + score) / 2.0, 6) AS score FROM r")
def vector_topk_grid(t: Tables):
    """The same search with a query set above the broadcast bound."""
    hits = V.vector_search(vectors_as_queries(t), vectors_as_chunks(t), 5, skip_self=True, broadcast_bytes=64 * 8 * 128)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_topk_ann(t: Tables):
    """Six of eight clusters: the given vectors have no clusters, so that fewer lose true neighbours."""
    index = V.build_cluster_index(vectors_as_chunks(t), n_clusters=8)
    hits = V.vector_search_ann(vectors_as_queries(t), index, 5, n_probe=6, skip_self=True)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_ann_recall(t: Tables):
    """The share of the true five nearest that three and six probed clusters of eight find."""
    index = V.build_cluster_index(vectors_as_chunks(t), n_clusters=8)
    truth = V.vector_search(vectors_as_queries(t), vectors_as_chunks(t), 5, skip_self=True).select("query_id", "chunk_id")
    truth = materialize(truth, "truth")  # met once for each number of probes
    rows = None
    for n_probe in (3, 6):
        hits = V.vector_search_ann(vectors_as_queries(t), index, 5, n_probe=n_probe, skip_self=True)
        met = truth.join(hits.select("query_id", "chunk_id", F.lit(1).alias("met")), ["query_id", "chunk_id"], "left")
        row = met.agg(F.lit(n_probe).alias("n_probe"), F.round(F.count("met") / F.count(F.lit(1)), 6).alias("recall"))
        rows = row if rows is None else rows.unionAll(row)
    return rows


@query(EMB_SQL + ", " + S.top("s", 5, "r") + " SELECT query_id, chunk_id, rank, round((1.0 + score) / 2.0, 6) AS score FROM r")
def vector_topk_all_clusters(t: Tables):
    """Probing every cluster of the stored index is the exact search."""
    index = V.build_cluster_index(vectors_as_chunks(t), n_clusters=8)
    hits = V.vector_search_ann(vectors_as_queries(t), index, 5, n_probe=8, skip_self=True)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {S.CHUNKS}, tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {S.TOK})) AS term FROM chunks)
SELECT term, count(*) AS total_tf, count(DISTINCT chunk_id) AS df FROM tok GROUP BY term""")
def index_terms(t: Tables):
    index = base.corpus_index(t)
    return index.postings.groupBy("term").agg(F.sum("tf").alias("total_tf"), F.count(F.lit(1)).alias("df"))


@query(f"""WITH {S.CHUNKS} SELECT kb_id AS scope, count(*) AS n,
round(avg(len(regexp_extract_all(lower(text), {S.TOK}))), 6) AS avg_dl FROM chunks GROUP BY kb_id""")
def index_stats(t: Tables):
    return base.corpus_index(t, "kb_id").stats.select("scope", "n", F.round("avg_dl", 6).alias("avg_dl"))


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r")) + " SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r")
def bm25_topk(t: Tables):
    hits = B.bm25_search(base.benchmark_queries(t), base.corpus_index(t), 10)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r")) + " SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r")
def bm25_topk_grid(t: Tables):
    """The same search with a query set above the broadcast bound."""
    hits = B.bm25_search(base.benchmark_queries(t), base.corpus_index(t), 10, broadcast_terms=500, block_rows=1000)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {S.CHUNKS}, tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), {S.TOK})) AS term FROM chunks)
SELECT term, count(*) AS total_tf, count(DISTINCT chunk_id) AS df, max(n)::INTEGER AS most FROM (SELECT term, chunk_id, count(*) OVER (PARTITION BY term, chunk_id) AS n FROM tok) GROUP BY term""")
def stored_postings(t: Tables):
    """Every term as its stored blocks hold it."""
    tfs = F.aggregate("tfs", F.lit(0).cast("long"), lambda total, n: total + n)
    return base.corpus_postings(t).blocks.groupBy("term").agg(
        F.sum(tfs).alias("total_tf"), F.sum(F.size("places")).alias("df"), F.max(F.array_max("tfs")).alias("most"))


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r")) + " SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r")
def postings_topk(t: Tables):
    """The keyword search on the stored inverted index."""
    hits = PO.postings_search(base.benchmark_queries(t), base.corpus_postings(t), 10)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(S.retrieval(S.bm25(), "ok AS (SELECT b.* FROM bm b JOIN chunks c USING (chunk_id) WHERE (lang = 'en' AND NOT kb_id > 9) OR kb_id = 15)",
                   S.top("ok", 5, "r")) + " SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r")
def bm25_topk_filtered(t: Tables):
    tree = ("or", ("and", ("eq", "lang", "en"), ("not", ("gt", "kb_id", 9))), ("eq", "kb_id", 15))
    index = B.build_bm25_index(base.corpus_chunks(t), carry=["lang", "kb_id"])
    hits = B.bm25_search(base.benchmark_queries(t), index, 5, where=filter_expr(tree))
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, (quality = 1 AND toxic <> 1) OR NOT (quality >= 1) AS keep, doc_id > 10 AND doc_id <= 100000 AS in_range FROM labels""")
def filter_trees(t: Tables):
    keep = ("or", ("and", ("eq", "quality", 1), ("ne", "toxic", 1)), ("not", ("gte", "quality", 1)))
    span = ("and", ("gt", "doc_id", 10), ("lte", "doc_id", 100000))
    return t.labels.select("doc_id", filter_expr(keep).alias("keep"), filter_expr(span).alias("in_range"))


@query(S.retrieval(S.VECTORS, S.top("vec", 5, "r")) + " SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r")
def text_vector_search(t: Tables):
    hits = V.vector_search(base.embedded_queries(t), base.embedded_chunks(t), 5)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


FUSED_SQL = """
single AS (SELECT query_id, doc_id, chunk_id, any_value(text_hash) AS text_hash, round(sum(1.0 / (60 + rank)), 12) AS gain, min(rank) AS path_rank
           FROM pool WHERE rank <= {limit} GROUP BY ALL),
content AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY query_id, text_hash ORDER BY gain DESC, path_rank, chunk_id) = 1),
fused AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, path_rank, chunk_id))::INTEGER AS rank FROM content)"""


@query(S.retrieval(S.VECTORS, S.bm25(), S.pool(10), FUSED_SQL.format(limit=10))
       + " SELECT query_id, chunk_id, doc_id, rank, round(gain, 8) AS score FROM fused WHERE rank <= 5")
def hybrid_topk(t: Tables):
    hits = P.hybrid_search(base.embedded_queries(t), base.embedded_corpus(t), 5)
    return hits.select("query_id", "chunk_id", "doc_id", "rank", F.round("score", 8).alias("score"))


@query(S.retrieval(S.VECTORS, S.bm25(), S.pool(10), """
lim AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM pool WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id, path)),
gains AS (SELECT *, (CASE WHEN hi - lo <= 1e-10 THEN 1.0 ELSE (score - lo) / (hi - lo) END) * (CASE WHEN path = 'vector' THEN 0.7 ELSE 0.3 END) AS g FROM lim),
single AS (SELECT query_id, doc_id, chunk_id, any_value(text_hash) AS text_hash, round(max(g), 12) AS gain, min(rank) AS path_rank FROM gains GROUP BY query_id, doc_id, chunk_id),
content AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY query_id, text_hash ORDER BY gain DESC, path_rank, chunk_id) = 1),
fused AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, path_rank, chunk_id))::INTEGER AS rank FROM content)""")
       + " SELECT query_id, chunk_id, rank, round(gain, 6) AS score FROM fused WHERE rank <= 5")
def hybrid_topk_weighted(t: Tables):
    config = P.SearchConfig(fusion_mode="weighted", vector_weight=0.7, bm25_weight=0.3)
    hits = P.hybrid_search(base.embedded_queries(t), base.embedded_corpus(t), 5, config)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def moded(queries):
    names = F.array(*[F.lit(m) for m in ("VECTOR_ONLY", "bm25_only", "HYBRID", "fuzzy")])
    return queries.withColumn("mode", F.element_at(names, (F.length("text") % 4 + 1).cast("int")))


@query(S.retrieval(S.VECTORS, S.bm25(), S.pool(10), FUSED_SQL.format(limit=10), """
modes AS (SELECT query_id, ['VECTOR_ONLY', 'BM25_ONLY', 'HYBRID', 'VECTOR_ONLY'][length(text) % 4 + 1] AS mode FROM queries)""") + """
SELECT query_id, mode, chunk_id, rank, round(score, 6) AS score FROM (
  SELECT query_id, 'VECTOR_ONLY' AS mode, chunk_id, rank, score FROM vtop UNION ALL SELECT query_id, 'BM25_ONLY', chunk_id, rank, score FROM btop
  UNION ALL SELECT query_id, 'HYBRID', chunk_id, rank, gain FROM fused) JOIN modes USING (query_id, mode) WHERE rank <= 5""")
def search_by_mode(t: Tables):
    hits = P.search(moded(base.embedded_queries(t)), base.embedded_corpus(t), 5)
    return hits.select("query_id", "mode", "chunk_id", "rank", F.round("score", 6).alias("score"))


TEMP_SQL = S.hashed("uploads", "chunk_id", "uv") + "," + S.hashed("asks", "query_id", "av")


UPLOADS_SQL = """
all_up AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS chunk_id, turn // 4 AS upload_no, text FROM conversations WHERE role = 'assistant'),
held AS (SELECT session_id, upload_no, count(*) AS n_chunks, coalesce(sum(count(*)) OVER (PARTITION BY session_id ORDER BY upload_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM all_up GROUP BY session_id, upload_no),
uploads AS (SELECT a.* FROM all_up a JOIN held USING (session_id, upload_no) WHERE before < 5)"""


def upload_no():
    """Assistant texts of neighbouring turns stand in for the chunks of one uploaded file."""
    return F.floor(F.col("turn") / 4).cast("bigint")


def session_uploads(t: Tables):
    """Assistant texts stand in for the chunks of a session's uploaded files, user texts for its questions."""
    rows = t.conversations.withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    temp = rows.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("session_id"), F.col("key").alias("chunk_id"), upload_no().alias("upload_no"), "text"
    )
    asks = rows.filter(F.col("role") == "user").select(F.col("conv_id").alias("session_id"), F.col("key").alias("query_id"), "text")
    return E.embed(asks), E.embed(temp)


@query(f"""WITH {UPLOADS_SQL},
asks AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'), {TEMP_SQL},
s AS (SELECT a.query_id, u.chunk_id, {S.cosine('av.e', 'uv.e')} AS score FROM asks a JOIN uploads u USING (session_id)
      JOIN av ON av.id = a.query_id JOIN uv ON uv.id = u.chunk_id), {S.top('s', 2, 'r')}
SELECT query_id, chunk_id, rank, round(score, 6) + 0.0 AS cosine FROM r""")
def session_temp_recall(t: Tables):
    asks, temp = session_uploads(t)
    return V.temp_recall(asks, temp, 2).select("query_id", "chunk_id", "rank", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {UPLOADS_SQL} SELECT session_id, upload_no, n_chunks, before < 5 AS admitted,
CASE WHEN before < 5 THEN NULL ELSE 'limit of 5 reached' END AS reason FROM held""")
def temp_uploads(t: Tables):
    """Which uploads of a session are admitted, and why the others are refused."""
    rows = t.conversations.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("session_id"), upload_no().alias("upload_no"))
    return V.admit_uploads(rows)


@query("""SELECT o_orderkey AS query_id,
  (CASE WHEN k > 0 THEN k ELSE 5 END * CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 3 ELSE 1 END)::INTEGER AS pool,
  (CASE WHEN k > 0 THEN k ELSE 5 END * 2 * CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 1 END)::INTEGER AS multi_pool
FROM (SELECT *, (o_custkey % 10 - 2)::INTEGER AS k FROM orders)""")
def recall_sizes(t: Tables):
    k = (F.col("o_custkey") % 10 - 2).cast("int")
    mode = F.when(F.col("o_orderpriority").startswith("1"), "HYBRID").otherwise("VECTOR_ONLY")
    return t.orders.select(
        F.col("o_orderkey").alias("query_id"), P.recall_size(k, F.col("o_orderstatus") == "F", mode).cast("int").alias("pool"),
        P.recall_size_multi(k, F.col("o_orderstatus") == "O").cast("int").alias("multi_pool"),
    )


def scattered(t: Tables):
    """Every query asks three knowledge bases, one of which does not exist."""
    first = (F.length("text") % 20).cast("int")
    return base.benchmark_queries(t).withColumn("kb_ids", F.array(first, ((first + 7) % 20).cast("int"), F.lit(999)))


SCATTER_SQL = """
asked AS (SELECT query_id, unnest([(length(text) % 20)::INTEGER, ((length(text) % 20 + 7) % 20)::INTEGER, 999]) AS scope, unnest([0, 1, 2]) AS kb_pos FROM queries),
hits AS (SELECT b.*, kb_pos FROM bm b JOIN asked USING (query_id, scope))"""


@query(S.retrieval(S.bm25("kb_id"), SCATTER_SQL, S.top("hits", 4, "r", "query_id, scope", "query_id, scope, chunk_id, score"))
       + " SELECT query_id, scope AS kb_id, chunk_id, rank, round(score, 6) AS score FROM r")
def multi_kb_candidates(t: Tables):
    hits = P.multi_kb_recall(scattered(t), base.corpus_index(t, "kb_id"), 4)
    return hits.select("query_id", "kb_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


SCOPED_SQL = """
vec2 AS (SELECT a.scope || '@' || v.query_id AS query_id, v.chunk_id, v.score FROM vec v JOIN chunks c USING (chunk_id)
         JOIN asked a ON a.query_id = v.query_id AND a.scope = c.kb_id),
bm2 AS (SELECT b.scope || '@' || b.query_id AS query_id, b.chunk_id, b.score FROM bm b JOIN asked USING (query_id, scope)),
modes AS (SELECT a.scope || '@' || query_id AS query_id, query_id AS asked_id, scope AS kb_id,
          ['VECTOR_ONLY', 'BM25_ONLY', 'HYBRID'][length(text) % 3 + 1] AS mode FROM asked a JOIN queries USING (query_id))"""
BY_MODE_SQL = """
ranked AS (SELECT query_id, 'VECTOR_ONLY' AS mode, chunk_id, rank, score FROM vtop UNION ALL SELECT query_id, 'BM25_ONLY', chunk_id, rank, score FROM btop
           UNION ALL SELECT query_id, 'HYBRID', chunk_id, rank, gain FROM fused)"""


def by_mode(queries: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(m) for m in P.MODES])
    return queries.withColumn("mode", F.element_at(names, (F.length("text") % 3 + 1).cast("int")))


def scoped_corpus(t: Tables) -> P.Corpus:
    return base.embedded_corpus(t, "kb_id")


@query(S.retrieval(S.VECTORS, S.bm25("kb_id"), SCATTER_SQL, SCOPED_SQL, S.pool(8, "vec2", "bm2"), FUSED_SQL.format(limit=8), BY_MODE_SQL)
       + """ SELECT asked_id AS query_id, kb_id, mode, chunk_id, rank, round(score, 6) AS score FROM ranked JOIN modes USING (query_id, mode) WHERE rank <= 4""")
def multi_kb_by_mode(t: Tables):
    """Every base that a query names is searched in the query's mode."""
    asked = by_mode(E.embed(scattered(t)))
    hits = P.search_scoped(asked.withColumn("kb_id", F.explode("kb_ids")), scoped_corpus(t), 4)
    return hits.join(asked.select("query_id", "mode"), "query_id").select(
        "query_id", "kb_id", "mode", "chunk_id", "rank", F.round("score", 6).alias("score"))


TRUTH_SQL = f"""truth AS (SELECT q.query_id, d.doc_id FROM queries q JOIN documents d ON contains(d.text, q.text) AND list_has_all(regexp_extract_all(lower(d.text), {S.TOK}), regexp_extract_all(lower(q.text), {S.TOK})))"""


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r"), TRUTH_SQL, """
hit AS (SELECT t.query_id, min(r.rank) AS best FROM truth t JOIN chunks c USING (doc_id) JOIN r ON r.query_id = t.query_id AND r.chunk_id = c.chunk_id GROUP BY t.query_id)""") + """
SELECT k, n AS n_queries, found AS n_hit, CASE WHEN n > 0 THEN round(found / n::DOUBLE, 6) END AS recall FROM (
  SELECT k, (SELECT count(DISTINCT query_id) FROM truth) AS n, (SELECT count(*) FROM hit WHERE best <= k) AS found FROM (SELECT unnest([5, 10]) AS k))""")
def recall_at_k(t: Tables):
    """Documents -> chunks -> keyword index -> all benchmark queries -> recall at 5 and 10."""
    chunks = base.stored_chunks(t)
    hits = B.bm25_search(base.benchmark_queries(t), base.corpus_index(t), 10)
    ranked = P.attach(hits, chunks, ["doc_id"])
    truth = containment_truth(base.benchmark_queries(t), base.documents(t).select("doc_id", "text"))
    return recall(ranked, truth, [5, 10])


@query(S.retrieval(S.bm25(), S.top("bm", 10, "r"), f"truth AS (SELECT q.query_id, d.doc_id FROM queries q JOIN documents d ON contains(d.text, q.text) WHERE length(d.text) > 5000)", """
hit AS (SELECT t.query_id, min(r.rank) AS best FROM truth t JOIN chunks c USING (doc_id) JOIN r ON r.query_id = t.query_id AND r.chunk_id = c.chunk_id GROUP BY t.query_id)""") + """
SELECT k, n AS n_queries, found AS n_hit, CASE WHEN n > 0 THEN round(found / n::DOUBLE, 6) END AS recall FROM (
  SELECT k, (SELECT count(DISTINCT query_id) FROM truth) AS n, (SELECT count(*) FROM hit WHERE best <= k) AS found FROM (SELECT unnest([5, 10]) AS k))""")
def recall_at_k_long_documents(t: Tables):
    chunks = base.stored_chunks(t)
    hits = B.bm25_search(base.benchmark_queries(t), B.build_bm25_index(chunks), 10)
    ranked = P.attach(hits, chunks, ["doc_id"])
    long_docs = base.documents(t).filter(F.length("text") > 5000).select("doc_id", "text")
    return recall(ranked, containment_truth(base.benchmark_queries(t), long_docs), [5, 10])
