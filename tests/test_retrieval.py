"""Search and fusion against brute force and hand-made candidates."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagery.functions.filters import filter_expr
from passagery.functions.text import tokens
from passagery.operators import fusion as X, keyword as B, postings as PO, vector as V
from passagery.operators.embedding import embed
from passagery.operators.topk import BestK
from passagery.workload import load_all
from passagery.workload.registry import QUERIES
from tests.conftest import DATA

RNG = np.random.default_rng(1)
DIM = 16
CORPUS = RNG.normal(size=(300, DIM)).astype(np.float32)
CORPUS[50:150] = CORPUS[10]  # a third of the corpus are copies
CORPUS[7] = 0.0
ASKED = RNG.normal(size=(40, DIM)).astype(np.float32)
ASKED[3] = CORPUS[10]


def frames(spark):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(CORPUS)], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ASKED)], "query_id long, embedding array<float>")
    return asked, corpus.repartition(5)


def brute(k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    score = np.round(unit(ASKED.astype(float)) @ unit(CORPUS.astype(float)).T, 9)
    return {(q, r + 1): int(c) for q in range(len(ASKED)) for r, c in enumerate(np.lexsort((np.arange(300), -score[q]))[:k])}


def found(df):
    return {(r["query_id"], r["rank"]): r["chunk_id"] for r in df.collect()}


@pytest.mark.parametrize("bound", [64 << 20, 8 * DIM * 7])
def test_vector_search_is_exact_with_and_without_broadcast(spark, bound):
    asked, corpus = frames(spark)
    assert found(V.vector_search(asked, corpus, 6, broadcast_bytes=bound)) == brute(6)


def test_probing_all_clusters_is_exact_and_few_have_good_recall(spark):
    asked, corpus = frames(spark)
    index = V.build_cluster_index(corpus, n_clusters=6)
    full = found(V.vector_search_ann(asked, index, 6, n_probe=6, block_rows=40))
    assert full == brute(6)
    some = found(V.vector_search_ann(asked, index, 6, n_probe=3))
    truth = brute(6)
    hits = sum(len({some.get((q, r)) for r in range(1, 7)} & {truth[q, r] for r in range(1, 7)}) for q in range(40))
    assert hits / 240 > 0.6


def test_registered_probe_finds_nine_tenths_of_the_given_neighbours(spark):
    load_all()
    pairs = lambda name: {(r["query_id"], r["chunk_id"]) for r in QUERIES[name](spark, DATA).collect()}
    truth, got = pairs("vector_topk"), pairs("vector_topk_ann")
    assert len(truth & got) / len(truth) >= 0.9
    recall = {r["n_probe"]: r["recall"] for r in QUERIES["vector_ann_recall"](spark, DATA).collect()}
    assert recall[6] == pytest.approx(len(truth & got) / len(truth), abs=1e-6) and recall[3] < recall[6]


def test_wrong_length_and_null_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id long, embedding array<float>")
    rows = V.vector_search(asked, corpus, 10).orderBy("rank").collect()
    assert [(r["chunk_id"], r["cosine"], r["score"]) for r in rows] == [(1, 1.0, 1.0), (2, 0.0, 0.5), (4, 0.0, 0.5)]
    assert V.vector_search(asked.limit(0), corpus, 3).count() == 0


WORDS = ["the"] * 30 + ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]


def docs_and_queries(spark):
    rng = np.random.default_rng(2)
    docs = [(f"d{i:03d}", int(i % 3), " ".join(rng.choice(WORDS, size=rng.integers(1, 40)))) for i in range(200)]
    docs += [("dup1", 0, "alpha beta"), ("dup2", 0, "alpha beta"), ("empty", 0, " .. ")]
    asked = [(i, " ".join(rng.choice(WORDS, size=4)) + " Alpha") for i in range(15)]
    return docs, asked, spark.createDataFrame(docs, "chunk_id string, kb_id int, text string"), spark.createDataFrame(asked, "query_id long, text string")


def brute_bm25(docs, asked, k, scoped):
    tok = lambda s: re.findall(r"[^\W_]+", s.lower())
    out = {}
    for scope in sorted({d[1] for d in docs}) if scoped else [None]:
        pool = [d for d in docs if scope is None or d[1] == scope]
        counts = {d[0]: Counter(tok(d[2])) for d in pool}
        df = Counter(t for c in counts.values() for t in c)
        n, avg = len(pool), sum(sum(c.values()) for c in counts.values()) / len(pool)
        for q, text in asked:
            score = {}
            for name, c in counts.items():
                dl = sum(c.values())
                s = sum(
                    qtf * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avg))
                    for t, qtf in Counter(tok(text)).items() if c[t]
                )
                if s:
                    score[name] = round(s, 6)
            for r, name in enumerate(sorted(score, key=lambda d: (-score[d], d))[:k]):
                out[q, scope or 0, r + 1] = name
    return out


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("bound", [1_000_000, 9])
def test_bm25_equals_brute_force(spark, scoped, bound):
    docs, asked, d, q = docs_and_queries(spark)
    index = B.build_bm25_index(d.repartition(6), scope="kb_id" if scoped else None)
    hits = B.bm25_search(q, index, 7, broadcast_terms=bound, block_rows=30)
    got = {(r["query_id"], r["scope"], r["rank"]): r["chunk_id"] for r in hits.collect()}
    assert got == brute_bm25(docs, asked, 7, scoped)


def test_stored_index_gives_the_same(spark, tmp_path):
    docs, asked, d, q = docs_and_queries(spark)
    index = B.build_bm25_index(d, scope="kb_id")
    B.save_bm25_index(index, str(tmp_path / "index"))
    again = B.load_bm25_index(spark, str(tmp_path / "index"))
    pick = lambda i: sorted(map(tuple, B.bm25_search(q, i, 3).select("query_id", "scope", "chunk_id", "rank").collect()))
    assert pick(index) == pick(again)


def cands(spark, rows):
    return spark.createDataFrame(rows, "query_id int, path string, rank int, score double, doc_id int, chunk_id string, text_hash string")


def test_rrf_adds_both_paths_and_ignores_row_order(spark):
    rows = [(1, "vector", 1, 0.9, 1, "a", "ha"), (1, "vector", 2, 0.8, 2, "b", "hb"), (1, "bm25", 1, 7.0, 2, "b", "hb"), (1, "bm25", 2, 6.0, 3, "c", "hc")]
    expected = [("b", 1 / 62 + 1 / 61), ("a", 1 / 61), ("c", 1 / 62)]
    for given in (rows, rows[::-1]):
        got = X.rrf_fuse(cands(spark, given), 5).orderBy("rank").collect()
        assert [(r["chunk_id"], pytest.approx(r["rrf_score"])) for r in got] == expected


def test_same_text_under_two_ids_is_kept_once(spark):
    rows = [(1, "vector", 1, 0.9, 1, "a", "h"), (1, "bm25", 1, 5.0, 2, "b", "h"), (1, "bm25", 2, 4.0, 1, "a", "h")]
    fused = X.fuse(cands(spark, rows), 5).collect()
    assert [(r["chunk_id"], pytest.approx(r["gain"])) for r in fused] == [("a", 1 / 61 + 1 / 62)]


def test_weighted_with_equal_scores_counts_one(spark):
    rows = [(1, "vector", 1, 0.5, 1, "a", "ha"), (1, "vector", 2, 0.5, 2, "b", "hb"), (1, "bm25", 1, 3.0, 2, "b", "hb")]
    got = {r["chunk_id"]: r["weighted_score"] for r in X.weighted_fuse(cands(spark, rows), 5, 0.6, 0.4).collect()}
    assert got == {"a": pytest.approx(0.6), "b": pytest.approx(0.6)}


def test_one_empty_path_leaves_the_other(spark):
    rows = [(1, "bm25", i, 9.0 - i, i, f"c{i}", f"h{i}") for i in range(1, 8)]
    got = X.fuse(cands(spark, rows), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c1", "c2", "c3"]


def test_thresholds(spark):
    df = spark.createDataFrame([(1, None), (2, 0.4), (3, 1.0)], "id int, score double")
    keep = lambda t: sorted(r["id"] for r in X.similarity_filter(df, t).collect())
    assert keep(None) == keep(0.0) == keep(1.5) == [1, 2, 3] and keep(0.5) == keep(1.0) == [1, 3]


def test_rerank_single_failed_and_missing(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, None), (2, "b", 1, None), (2, "c", 2, None), (3, "d", 1, None), (3, "e", 2, 0.2)], "query_id int, chunk_id string, rank int, rel double"
    )
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["relevance"]) for r in X.rerank(rows, F.col("rel")).collect()}
    assert got == {(1, 1): ("a", 1.0), (2, 1): ("b", None), (2, 2): ("c", None), (3, 1): ("e", 0.2), (3, 2): ("d", None)}


def test_parent_text_replaces_child_text_only(spark):
    chunks = spark.createDataFrame([("p", "whole"), ("q", " ")], "chunk_id string, text string")
    rows = spark.createDataFrame(
        [(1, "c1", "child", "p", "part"), (1, "c2", "child", "q", "kept"), (1, "f", "flat", None, "flat")],
        "query_id int, chunk_id string, chunk_type string, parent_chunk_id string, text string",
    )
    got = {r["chunk_id"]: (r["text"], r["parent_enhanced"]) for r in X.parent_enhance(rows, chunks).collect()}
    assert got == {"c1": ("whole", True), "c2": ("kept", False), "f": ("flat", False)}


def test_filter_trees_reject_unknown_operators():
    with pytest.raises(ValueError):
        filter_expr(("like", "a", "b"))


def test_embedding_is_unit_and_null_stays_null(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    rows = [r["embedding"] for r in embed(df).collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-6 and rows[1] is None and not any(rows[2])


def test_vectors_of_different_length_never_meet(spark):
    from passagery.operators.vector import vector_search

    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.8, 0.2, 0.0])]
    for order in (rows, rows[::-1]):
        chunks = spark.createDataFrame(order, "chunk_id long, embedding array<double>").coalesce(1)
        queries = spark.createDataFrame([(10 * i, v) for i, v in order if i in (1, 3)], "query_id long, embedding array<double>")
        got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in vector_search(queries, chunks, 5).collect() if r["cosine"] > 0)
        assert got == [(10, 1, 1), (10, 2, 2), (30, 1, 3), (30, 2, 4)]


def test_uploads_are_admitted_whole_until_the_pool_is_full(spark):
    from passagery.operators.vector import admit_uploads, temp_recall

    chunks = [(1, 0, f"a{i}", [1.0, float(i)]) for i in range(40)] + [(1, 1, "late", [1.0, 5.0])]
    temp = spark.createDataFrame(chunks, "session_id long, upload_no long, chunk_id string, embedding array<double>")
    assert {r["upload_no"]: r["admitted"] for r in admit_uploads(temp).collect()} == {0: True, 1: False}
    asked = spark.createDataFrame([(7, 1, [0.0, 1.0])], "query_id long, session_id long, embedding array<double>")
    assert [r["chunk_id"] for r in temp_recall(asked, temp, 2).orderBy("rank").collect()] == ["a39", "a38"]


@pytest.mark.parametrize("block", [3])
def test_postings_with_block_maxima_equal_the_full_scan(spark, block):
    """A term of every chunk, rare terms, ties by copies, repeated query terms, unknown terms, two scopes."""
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = ["all " + " ".join(draw.choice(words, draw.integers(1, 40), p=share / share.sum())) for _ in range(250)] + ["all w1 w2 w3"] * 60
    chunks = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "chunk_id long, kb int, text string").repartition(3)
    asked = [(0, "all"), (1, "w50 w59 all"), (2, "w1 w1 w2 w40"), (3, "unknown"), (4, " ".join(words)), (5, ""), (6, "w3 w2 w1 all all")]
    for scope in (None, "kb"):
        forward = B.build_bm25_index(chunks, scope=scope)
        index = PO.build_postings(forward, buckets=8, block=block)
        for queries in ([spark.createDataFrame(asked, "query_id long, text string")] + (
                [spark.createDataFrame([(*row, 1) for row in asked], "query_id long, text string, scope int")] if scope else [])):
            row = lambda r: (r.query_id, r.scope, r["rank"], r.chunk_id, round(r.score, 5))
            for k in (1, 5, 400):
                assert sorted(map(row, PO.postings_search(queries, index, k).collect())) == sorted(map(row, B.bm25_search(queries, forward, k).collect()))


def test_postings_in_many_shards_and_slices_equal_the_full_scan(spark, monkeypatch):
    """A chunk lies in one shard; queries are dealt over slices; ids are strings and a scope has none of the terms."""
    monkeypatch.setattr(PO, "SHARD_ROWS", 16)
    monkeypatch.setattr(PO, "CELL_TERMS", 20)
    docs, asked, chunks, queries = docs_and_queries(spark)
    forward = B.build_bm25_index(chunks.repartition(3), scope="kb_id")
    index = PO.build_postings(forward, buckets=4, block=5)
    assert index.shards.count() >= 12
    held = index.blocks.select("shard", F.explode("ids").alias("id"))
    assert held.groupBy("id").agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()
    got = {(r["query_id"], r["scope"], r["rank"]): r["chunk_id"] for r in PO.postings_search(queries, index, 7).collect()}
    assert got == brute_bm25(docs, asked, 7, True)


def test_postings_search_reads_its_own_buckets_only(spark):
    texts = [f"common filler{i % 50} " + ("needle " * 9 if i == 7 else "") for i in range(400)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    index = PO.build_postings(B.build_bm25_index(chunks), buckets=32)
    hits = PO.postings_search(spark.createDataFrame([(1, "needle")], "query_id long, text string"), index, 3)
    assert [(r.chunk_id, r["rank"]) for r in hits.collect()] == [(7, 1)]
    text = hits._jdf.queryExecution().executedPlan().toString()
    blocks = [line for line in text.split("\n") if "FileScan parquet" in line and "tfs" in line]
    assert blocks and all("PartitionFilters: [isnotnull(bucket" in line or "PartitionFilters: [bucket" in line or "IN" in line.split("PartitionFilters")[1][:80] for line in blocks)
    assert index.blocks.filter(PO.bucket_of(F.lit("needle"), 32) == F.col("bucket")).count() < index.blocks.count() / 8


def test_postings_leave_out_levels_below_the_floor(spark):
    """The frequent term is not essential once the rare ones fill the result: its blocks name no candidates."""
    texts = ["common"] * 2000 + ["rare common"] * 40
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    forward = B.build_bm25_index(chunks)
    index = PO.build_postings(forward)
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    seen = []
    original, PO.materialize = PO.materialize, lambda df, label: seen.append((label, original(df, label))) or seen[-1][1]
    try:
        hits = [r.chunk_id for r in PO.postings_search(asked, index, 5).orderBy("rank").collect()]
    finally:
        PO.materialize = original
    assert hits == [2000, 2001, 2002, 2003, 2004] and dict(seen)["candidates"].count() == 40


def test_vectors_by_scope_broadcast_and_in_cells_are_the_same(spark):
    asked, corpus = frames(spark)
    corpus = corpus.withColumn("kb_id", F.expr("CASE WHEN chunk_id % 3 = 0 THEN 7 ELSE chunk_id % 5 END").cast("int"))
    asked = asked.crossJoin(spark.createDataFrame([(0,), (7,), (99,), (None,)], "kb_id int"))
    row = lambda r: (r.query_id, r.kb_id, r["rank"], r.chunk_id)
    wide = V.scoped_vector_search(asked, corpus, "kb_id", 4).collect()
    cells = V.scoped_vector_search(asked, corpus, "kb_id", 4, block_rows=20, broadcast_bytes=64).collect()
    assert sorted(map(row, wide)) == sorted(map(row, cells)) and len(wide) == 40 * 2 * 4
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    score = np.round(unit(ASKED.astype(float)) @ unit(CORPUS.astype(float)).T, 9)
    sevens = np.arange(0, 300, 3)
    assert {(r.query_id, r["rank"]): r.chunk_id for r in wide if r.kb_id == 7} == {
        (q, n + 1): int(sevens[c]) for q in range(40) for n, c in enumerate(np.lexsort((sevens, -score[q][sevens]))[:4])}


def test_reranked_batches_fail_and_merge_each_for_itself(spark):
    rows = [(1, i, i, f"t{i}", "q") for i in range(1, 8)] + [(2, 1, 1, "lone", "q"), (3, 1, 1, "x", "bad"), (3, 2, 2, None, "bad")]
    cands = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, text string, query_text string")

    def scorer(asked, texts):
        if asked == "bad" or "t4" in texts:
            raise ValueError("down")
        return [float(text[1:]) if text[1:].isdigit() else 0.5 for text in texts][:2]

    got = {(r.query_id, r["rank"]): (r.chunk_id, r.relevance) for r in X.rerank_in_batches(cands, scorer, size=3).collect()}
    assert [got[1, n][0] for n in range(1, 8)] == [7, 2, 1, 3, 4, 5, 6] and got[1, 4][1] is None
    assert got[2, 1] == (1, 1.0) and [got[3, n] for n in (1, 2)] == [(1, None), (2, None)]


def test_search_in_several_cells_of_bounded_size(spark):
    """The bound of the broadcast does not size the cells: many cells, and one, give the rows of the broadcast form."""
    asked, corpus = frames(spark)
    for cell_rows in (17, 1 << 14):
        assert found(V.vector_search(asked, corpus, 6, broadcast_bytes=64, cell_rows=cell_rows)) == found(V.vector_search(asked, corpus, 6))
    docs, queried, chunks, q = docs_and_queries(spark)
    for scope in (None, "kb_id"):
        index = B.build_bm25_index(chunks, scope=scope)
        rows = B.bm25_search(q, index, 7, broadcast_terms=5, block_rows=30, cell_terms=12).collect()
        assert {(r["query_id"], r["scope"], r["rank"]): r["chunk_id"] for r in rows} == brute_bm25(docs, queried, 7, scope is not None)


def test_best_of_float_scores_equals_a_full_sort():
    from passagery.operators.topk import BestK

    draw = np.random.default_rng(5)
    ids = np.sort(draw.choice(10**6, 3000, replace=False))
    for score in (draw.normal(size=(20, 3000)), np.round(draw.normal(size=(20, 3000)), 1), np.zeros((20, 3000))):
        score[:, ::7] = -np.inf
        score[3, 5:] = -np.inf
        best = BestK(5)
        best.add_floats(100, score, ids, 1000)
        rows, got, names = best.result()
        for row in range(20):
            held = [(-int(np.rint(s * 1000)), i) for s, i in zip(score[row].tolist(), ids.tolist()) if s > -np.inf]
            assert [(-g, n) for r, g, n in zip(rows.tolist(), got.tolist(), names.tolist()) if r == 100 + row] == sorted(held)[:5]


def test_block_product_in_single_precision_gives_the_scores_of_double_precision(monkeypatch):
    monkeypatch.setattr(V, "COMPACT_ROWS", 500)
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(5000, 16))
    vectors[100:2000:3], vectors[2500] = vectors[7], 0.0
    vectors[3000:4000] = vectors[11] + draw.normal(size=(1000, 16)) * 1e-7
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    ids = draw.permutation(10**5)[:5000]
    asked = np.concatenate([np.arange(150), [2500, 3000, 3500]])
    best = V._Best(ids[asked], vectors[asked], 5, True)
    for part in np.array_split(draw.permutation(5000), 3):
        best.add(ids[part], vectors[part])
    assert best.rough.dtype == np.float32
    rows, got, names = best.best.result()
    for place, own in enumerate(asked.tolist()):
        scaled = np.rint((vectors @ vectors[own]) * V.SCALE).astype(np.int64)
        expected = sorted((-s, i) for s, i in zip(scaled.tolist(), ids.tolist()) if i != ids[own])[:5]
        held = [(-s, i) for r, s, i in zip(rows.tolist(), got.tolist(), names.tolist()) if r == place]
        assert [i for _, i in held] == [i for _, i in expected] and all(abs(a - b) <= 1 for (a, _), (b, _) in zip(held, expected))


def test_recall_searches_its_truth_once(spark):
    plan = QUERIES["vector_ann_recall"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and " MapInArrow" not in plan


def test_index_rows_hold_sorted_terms_and_their_counts(spark):
    texts = ["b a b ab B", "", None, "é z a é", " .. ", "a " * 700]
    chunks = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(texts)], "chunk_id long, kb int, text string").coalesce(1)
    forward = B.build_bm25_index(chunks, scope="kb", carry=["text"]).forward
    assert forward.columns == ["scope", "chunk_id", "text", "dl", "terms", "tfs"]
    assert [tuple(r)[3:] for r in forward.orderBy("chunk_id").collect()] == [
        (5, ["a", "ab", "b"], [1, 1, 3]), (0, [], []), (None, None, None), (4, ["a", "z", "é"], [1, 1, 2]), (0, [], []), (700, ["a"], [700])]
    assert "MapInArrow" in B.build_bm25_index(chunks, settle=False).forward._jdf.queryExecution().executedPlan().toString()


def test_index_is_made_without_python_and_searches_count_the_words_of_queries_only(spark):
    """The words stored for a search are those of the regular expression, whatever else a text holds."""
    texts = ["Ab-c 1٣x_y", "É È—ß…z​İK", "日本、語 \U0001d400\U0001f600a", "", " .,\t\n", "áb ①½ x" * 2, None, "plain ascii, twice ascii"]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    index = B.build_bm25_index(chunks)
    assert index.rows.columns == ["scope", "chunk_id", "token_text"]
    assert "MapInArrow" not in index.rows._jdf.queryExecution().executedPlan().toString()
    listed = dict(chunks.select("chunk_id", tokens(F.col("text"))).collect())
    for name, dl, terms, tfs in index.forward.select("chunk_id", "dl", "terms", "tfs").collect():
        words = listed[name]
        assert (dl, terms, tfs) == ((None, None, None) if words is None else (
            len(words), sorted(set(words), key=str.encode), [words.count(w) for w in sorted(set(words), key=str.encode)]))
    asked = spark.createDataFrame([(1, "ascii É x 語 nowhere")], "query_id int, text string")
    stored = B.Bm25Index(index.forward)
    few, many, again = (sorted(map(tuple, B.weighted_terms(asked, i, broadcast_terms=n).collect())) for i, n in ((index, 99), (index, 0), (stored, 99)))
    assert few == many == again and len(few) == 4


def test_what_cannot_reach_the_best_rows_known_is_left_out_of_them():
    rng = np.random.default_rng(5)
    score = np.where(rng.random((3, 900)) < 0.5, 0.0, np.round(rng.random((3, 900)), 2))
    ids = np.array([f"{i:04d}" for i in rng.permutation(900)])
    best = BestK(7, 4)
    for start in range(0, 900, 50):
        order = np.argsort(ids[start : start + 50]) + start
        best.add_above(np.array([0, 2, 3]), score[:, order], ids[order], 10**6)
    rows, found, names = best.result()
    for slot, row in zip((0, 2, 3), score):
        mine = sorted((-round(s * 10**6), i) for s, i in zip(row, ids) if s)[:7]
        assert [(-s, n) for s, n in zip(found[rows == slot], names[rows == slot])] == mine


def test_parent_texts_writes_no_hash_that_it_never_reads(spark, monkeypatch):
    from passagery.workload import fusion as W

    load_all()
    written, write = [], W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, label: written.append(df.columns) or write(df, label))
    assert QUERIES["parent_texts"](spark, DATA).count()
    assert [columns for columns in written if "text_hash" in columns] == [] and "chunk_id" in written[0]


def test_postings_hold_places_and_not_the_ids_of_chunks(spark, tmp_path):
    """Ids of 32 characters are stored once a chunk; the ids come back, with ties in their order, and counts above two bytes hold."""
    draw = np.random.default_rng(9)
    texts = [" ".join(draw.choice([f"w{i}" for i in range(80)], 40)) for _ in range(600)] + ["w1 w2"] * 7 + ["w3 " * 70_000]
    chunks = spark.createDataFrame(list(enumerate(texts)), "n long, text string").select(F.md5(F.col("n").cast("string")).alias("chunk_id"), "text")
    forward = B.build_bm25_index(chunks)
    index = PO.build_postings(forward, str(tmp_path / "index"), buckets=2)
    held = index.blocks.select(F.sum(F.size("places"))).first()[0]
    assert sum(p.stat().st_size for p in (tmp_path / "index" / "blocks").rglob("*.parquet")) < 4 * held + 64 * len(texts)
    assert index.names.select(F.explode("names")).distinct().count() == len(texts) and dict(index.stored.dtypes)["places"] == "array<smallint>"
    assert index.blocks.filter("term = 'w3'").select(F.max(F.array_max("tfs"))).first()[0] == 70_000
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3"), (3, "w4 w5 w6")], "query_id long, text string")
    row = lambda r: (r.query_id, r["rank"], r.chunk_id, round(r.score, 5))
    assert sorted(map(row, PO.postings_search(asked, index, 9).collect())) == sorted(map(row, B.bm25_search(asked, forward, 9).collect()))


def test_candidates_of_a_shard_are_cut_by_its_own_best(spark):
    """Every chunk names the terms of the query, but few can reach the best k of their shard."""
    draw = np.random.default_rng(4)
    texts = [" ".join(draw.choice([f"w{i}" for i in range(60)], 30)) for _ in range(2000)]
    forward = B.build_bm25_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    index, seen = PO.build_postings(forward), []
    asked = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)))], "query_id long, text string")
    original, PO.materialize = PO.materialize, lambda df, label: seen.append((label, original(df, label))) or seen[-1][1]
    try:
        hits = [(r["rank"], r.chunk_id) for r in PO.postings_search(asked, index, 5).collect()]
    finally:
        PO.materialize = original
    assert sorted(hits) == sorted((r["rank"], r.chunk_id) for r in B.bm25_search(asked, forward, 5).collect())
    assert dict(seen)["candidates"].count() <= 300


def test_equal_vectors_are_searched_once_and_all_of_them_are_found(spark, monkeypatch):
    asked, corpus = frames(spark)
    twice = asked.unionAll(asked.withColumn("query_id", F.col("query_id") + 100))
    monkeypatch.setattr(V, "FOLD_QUERIES", 1)
    met, scan = [], V._scan
    monkeypatch.setattr(V, "_scan", lambda table, c, *more: met.append((table.num_rows, c.count())) or scan(table, c, *more))
    for k in (1, 6, 400):
        rows = V.vector_search(twice, corpus, k).collect()
        known = brute(k)
        assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in rows} == known | {(q + 100, rank): c for (q, rank), c in known.items()}
    assert set(met) == {(40, 200)}


def test_queries_in_slices_equal_brute_force_and_a_threshold_only_drops_lower_scores(spark, monkeypatch):
    asked, corpus = frames(spark)
    monkeypatch.setattr(V, "LEAST_SLICE", 1)
    met, scan = [], V._scan
    monkeypatch.setattr(V, "_scan", lambda table, *more: met.append(table.num_rows) or scan(table, *more))
    row = lambda r: (r["query_id"], r["rank"], r["chunk_id"], r["score"])
    whole = sorted(map(row, V.vector_search(asked, corpus, 6, broadcast_bytes=8 * DIM * 10).collect()))
    assert {x[:2]: x[2] for x in whole} == brute(6) and len(met) == 4 and sum(met) == 40
    cut = [row(r) for r in V.vector_search(asked, corpus, 6, least=0.8).collect() if r["score"] >= 0.8]
    assert 0 < len(cut) < len(whole) and sorted(cut) == [x for x in whole if x[3] >= 0.8]


def test_small_blocks_of_a_scope_keep_few_pairs():
    """Blocks of fewer strips than k rows take a floor as well, and what a task holds is cut long before a million pairs."""
    draw = np.random.default_rng(8)
    queries, vectors = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (draw.normal(size=(300, 16)), draw.normal(size=(20_000, 16))))
    best, ids = V._Best(np.arange(300), queries, 8, False), np.array([f"{i:06d}" for i in range(20_000)], dtype=object)
    most = 0
    for start in range(0, 20_000, 500):
        best.add(ids[start : start + 500], vectors[start : start + 500])
        most = max(most, best.best.rows)
    rows, score, names = best.best.result()
    full = np.rint(queries @ vectors.T * V.SCALE).astype(np.int64)
    assert sorted(zip(rows.tolist(), score.tolist())) == sorted((q, s) for q in range(300) for s in np.sort(full[q])[-8:].tolist())
    assert most < 40_000 and all(full[q, int(name)] == s for q, s, name in zip(rows, score, names))


def test_frequent_terms_name_no_chunks_once_floors_are_known(spark, monkeypatch):
    """Terms that cannot lift a chunk are added up for chunks that the rare terms name only; the result is that of all sums."""
    draw = np.random.default_rng(6)
    words, share = np.array([f"w{i}" for i in range(400)]), 1 / np.arange(1, 401)
    texts = [" ".join(draw.choice(words, 60, p=share / share.sum())) for _ in range(1500)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, " ".join(draw.choice(words, 12, p=share / share.sum()))) for q in range(30)], "query_id long, text string")
    index = B.build_bm25_index(chunks)
    terms = B._Terms(B.weighted_terms(asked, index).toArrow())
    rows = pa.RecordBatch.from_pandas(index.rows.toPandas())
    best, plain = BestK(5, len(terms.queries)), BestK(5, len(terms.queries))
    added, dense = [], B._dense_scores
    monkeypatch.setattr(B, "_dense_scores", lambda *args: added.append((args[0].starts[-1], len(args[2]))) or dense(*args))
    for start in range(0, 1500, 300):
        terms.score(rows.slice(start, 300), best, 1.2, 0.75)
    monkeypatch.setattr(B, "MOST_NEAR", 1 << 40)  # always all sums
    terms.score(rows, plain, 1.2, 0.75)
    assert all((x == y).all() for x, y in zip(best.result(), plain.result()))
    assert min(n for n, _ in added) < max(n for n, _ in added) / 2
