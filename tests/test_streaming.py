"""Streams in many micro-batches give what one batch gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from passagery.operators import chunking as C, indexing as I, sessions as H
from passagery.streaming import jobs as J, runner as R, stateful as Z
from tests.conftest import DATA


def split_stream(df, folder, order, n=5):
    """The rows as `n` files in order, one per micro-batch."""
    spark = df.sparkSession
    ids = df.select(F.expr(f"percentile_approx({order}, array({','.join(str(i / n) for i in range(1, n))}), 10000)")).first()[0]
    for i in range(n):
        low, high = (None if i == 0 else ids[i - 1]), (None if i == n - 1 else ids[i])
        part = df if low is None else df.filter(F.col(order) > low)
        part = part if high is None else part.filter(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_lockouts_over_batches(spark, events, tmp_path):
    failed = (F.col("event_id") % 3 > 0).alias("failed")
    stream = split_stream(events, str(tmp_path / "e"), "event_id").select("user_id", "event_id", "ts", failed)
    got = R.appended(Z.lockout_stream(stream, 3, 1440), "locks")
    expected = H.lockouts(events.withColumn("failed", failed), ["user_id"], "ts", "event_id", F.col("failed"), 3, 1440)
    pick = lambda df: sorted(map(tuple, df.select("user_id", "event_id", "since", "locked_until").collect()))
    assert pick(got) == pick(expected) and pick(got)


def test_ingest_over_batches_stores_each_text_once(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.lit(1).alias("kb_id"), "text")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    out = J.ingest_stream(split_stream(docs, str(tmp_path / "d"), "doc_id"))
    got = sorted(r[0] for r in spark.read.parquet(out).select("text_hash").collect())
    expected = sorted(r[0] for r in I.new_chunks(C.chunk_text_model(docs)).select("text_hash").collect())
    assert got == expected
    assert spark.read.parquet(out).select("batch").distinct().count() > 1


def test_sessions_over_batches_are_those_closed_by_the_watermark(spark, events, tmp_path):
    stream = split_stream(events, str(tmp_path / "s"), "event_id")
    got = R.appended(J.sliding_sessions(stream, "user_id", "ts"), "sessions")
    numbered = H.sessionize(events, ["user_id"], "ts")
    runs = numbered.groupBy("user_id", "session_no").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n_events"))
    mark = events.agg(F.max("ts")).first()[0]
    closed = runs.filter(F.col("last") + F.expr("INTERVAL 1 HOUR") <= F.lit(mark) - F.expr("INTERVAL 10 MINUTES"))
    pick = lambda df: sorted(map(tuple, df.select("user_id", "start", "n_events").collect()))
    assert pick(got) == pick(closed) and pick(got)


def test_answers_may_arrive_in_pieces_and_lapse(spark, tmp_path):
    rows = []
    for answer in range(6):
        for seq, word in enumerate(["one ", "two ", "three"]):
            rows.append((answer * 10 + seq * 100, answer, 0, seq, "content", word))
        if answer != 4:
            rows.append((answer * 10 + 400, answer, 0, 9, "error" if answer == 2 else "done", None))
    rows.append((90_000, 99, 0, 0, "content", "later"))
    rows.append((90_100, 4, 0, 9, "done", None))
    df = spark.createDataFrame(rows, "at long, session_id long, turn long, seq int, type string, content string").withColumn("ts", F.timestamp_seconds(F.col("at") + 1700000000))
    got = {r["session_id"]: r["answer"] for r in R.appended(Z.answer_stream(split_stream(df, str(tmp_path / "a"), "at", 6)), "answers").collect()}
    full = "one two three"
    assert {k: v for k, v in got.items() if k != 4} == {0: full, 1: full, 3: full, 5: full}
    assert got.get(4, "") in ("", full)


def test_dedup_and_status_over_batches(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.lit(1).alias("kb_id"), "text")
    stream = split_stream(docs, str(tmp_path / "x"), "doc_id").withColumn("at", F.timestamp_seconds(F.col("doc_id") + 1700000000))
    got = R.appended(J.dedup_stream(stream, "at", "1 day").select("kb_id", "text_hash"), "dedup")
    assert got.count() == docs.select("text").distinct().count()
    states = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq")).withColumn("no", F.col("seq") * 1000 + F.col("doc_id"))
    states = states.withColumn("status", F.concat(F.lit("S"), F.col("seq"))).withColumn("event_time", F.timestamp_seconds("seq"))
    last = R.updated(J.latest_status_stream(split_stream(states, str(tmp_path / "y"), "no")), "status", ["doc_id"])
    assert [tuple(r) for r in last.select("status", "n_events").distinct().collect()] == [("S3", 4)]


def test_a_table_in_a_folder_of_parts_streams_like_one_file(spark, tmp_path):
    from passagery.streaming.runner import appended, stream_table

    spark.range(40).repartition(4).write.parquet(str(tmp_path / "parts.parquet"))
    stream = stream_table(spark, str(tmp_path), "parts", files_per_batch=1)
    assert sorted(r["id"] for r in appended(stream, "parts").collect()) == list(range(40))
    spark.range(0).write.parquet(str(tmp_path / "none.parquet"))
    assert appended(stream_table(spark, str(tmp_path), "none"), "none").count() == 0
