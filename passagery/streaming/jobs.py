"""The time-dependent behaviours as streaming transformations; each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from passagery import constants as K
from passagery.functions.text import text_hash
from passagery.operators import chunking as C
from passagery.operators.indexing import CONTENT_KEY, new_chunks
from passagery.streaming.runner import run_available, write_batch


def ingest_stream(docs: DataFrame, label: str = "ingest", strategy: str | None = None, params: Mapping | None = None) -> str:
    """Continuous ingest: new files become chunks; texts already stored for a knowledge base are not stored again.

    Returns the folder of stored chunks.
    """

    def step(batch: DataFrame, number: int, out: str) -> None:
        spark = batch.sparkSession
        fresh = new_chunks(C.chunk(batch, strategy, params))
        if number > 0:
            # earlier batches only: a repeated batch must not see its own first attempt
            stored = spark.read.parquet(out).filter(F.col("batch") < number).select(*CONTENT_KEY)
            fresh = fresh.join(stored, CONTENT_KEY, "left_anti")
        write_batch(fresh, number, out)

    return run_available(docs, label, step=step)


def sliding_sessions(events: DataFrame, key: str, ts: str, ttl_seconds: int = K.SESSION_TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Sessions that end when their lifetime passes without an event; later events than the watermark are dropped."""
    window = F.session_window(ts, f"{ttl_seconds} seconds")
    return (
        events.withWatermark(ts, late).groupBy(key, window).agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
    )


def dedup_stream(chunks: DataFrame, ts: str, within: str) -> DataFrame:
    """First chunk per knowledge base and text; the state of a text expires after `within`."""
    hashed = chunks.withColumn("text_hash", text_hash(F.col("text")))
    return hashed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["kb_id", "text_hash"])


def latest_status_stream(events: DataFrame) -> DataFrame:
    last = F.max_by("status", F.struct("event_time", "seq"))
    return events.groupBy("doc_id").agg(last.alias("status"), F.count(F.lit(1)).alias("n_events"))


def call_rates(calls: DataFrame, caller: str, ts: str, window: str = "1 second", limit: int = 5, late: str = "10 seconds") -> DataFrame:
    """Calls per caller and fixed window, with those above the limit marked."""
    counted = calls.withWatermark(ts, late).groupBy(caller, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n_calls"))
    return counted.select(caller, F.col("w.start").alias("start"), "n_calls", (F.col("n_calls") > limit).alias("over_limit"))


def trend_stream(events: DataFrame, ts: str, window: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")


def partial_event_rows(session: Column, turn: Column, text: Column, end: Column) -> Column:
    """A text as its stream of word events, closed by an event of type `end`."""
    event = lambda seq, kind, content: F.struct(
        session.alias("session_id"), turn.alias("turn"), seq.cast("int").alias("seq"), kind.alias("type"), content.alias("content")
    )
    words = F.split(text, "(?<= )", -1)
    body = F.transform(words, lambda w, i: event(i + 1, F.lit("content"), w))
    return F.concat(body, F.array(event(F.size(words) + 1, end, F.lit(None).cast("string"))))
