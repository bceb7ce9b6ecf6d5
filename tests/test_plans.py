"""The physical plans that the scale claims rest on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from passagery.operators import chunking as C, indexing as I, keyword as B, sessions as H, topk as TK, vector as V, versions as VE
from passagery.workload import base, derived as R
from passagery.workload.registry import QUERIES, Tables
from passagery.workload import load_all
from tests.conftest import DATA

load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, DATA)


def test_chunking_reads_two_columns_and_does_not_shuffle(tables):
    text = plan(C.chunk_text_model(tables.documents.select("doc_id", "text")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Exchange" not in text


def test_filters_reach_the_scan(tables):
    text = plan(tables.documents.filter(F.col("lang") == "en").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text


def test_searches_shuffle_only_their_winners(tables):
    corpus = base.embedded_corpus(tables)
    vector = plan(V.vector_search(base.embedded_queries(tables), corpus.chunks, 5))
    keyword = plan(B.bm25_search(base.benchmark_queries(tables), corpus.keywords(), 5))
    for text in (vector, keyword):
        exchange, scan = text.index("Exchange hashpartitioning(query_id"), text.index("MapInArrow")
        assert exchange < scan and "Exchange" not in text[scan:]
        assert text.count("WindowGroupLimit") == 4  # before and after both exchanges of the merge
    assert "text:string" not in vector and "embedding" not in keyword


def test_searches_by_base_do_not_move_the_corpus(spark, tables, tmp_path):
    base.embedded_chunks(tables).write.partitionBy("kb_id").parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    asked = base.embedded_queries(tables).withColumn("kb_id", F.lit(3))
    text = plan(V.scoped_vector_search(asked, stored, "kb_id", 5))
    scan = text.index("MapInArrow")
    chunks = next(line for line in text[scan:].split("\n") if "FileScan" in line and "chunk_id" in line)
    assert "Exchange" not in text[scan:text.index(chunks)] and "kb_id" in chunks.split("PartitionFilters: ")[1].split("]")[0]


def test_newest_and_first_rows_are_limited_before_the_shuffle(tables):
    messages = R.messages(tables)
    for df in (
        I.new_chunks(base.corpus_chunks(tables)), H.trim_history(messages), VE.retain_versions(R.changes(tables), ["doc_id"], R.VERSION_ORDER, 3),
    ):
        text = plan(df)
        assert "Final" in text and "Partial" in text.split("Exchange", 1)[1]


def test_histories_are_partitioned_by_bucket_too(tables):
    text = plan(VE.version_chain(R.changes(tables), ["doc_id"], R.VERSION_ORDER, F.year("l_shipdate")))
    assert "hashpartitioning(doc_id" in text and "__bucket" in text


@pytest.mark.parametrize("name", ["kb_roles", "multi_kb_candidates", "recall_at_k", "hybrid_topk", "visible_tenants", "version_diff", "cited_sources"])
def test_no_row_is_paired_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_ranked_rows_are_cut_in_groups_before_they_meet(spark):
    hits = spark.range(5000).selectExpr("id % 1 AS query_id", "id AS chunk_id", "(id * 7919 % 1000) / 1000.0 AS cosine")
    best = TK.merged(hits, ["query_id"], "cosine", "chunk_id", 7)
    expected = sorted(((i * 7919 % 1000), -i) for i in range(5000))[::-1][:7]
    assert [(r["chunk_id"], r["rank"]) for r in best.orderBy("rank").collect()] == [(-i, n + 1) for n, (_, i) in enumerate(expected)]
    text = plan(best)
    assert text.count("Exchange hashpartitioning(query_id") == 2 and "__group" in text.split("hashpartitioning(", 2)[2]
