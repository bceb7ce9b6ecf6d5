"""Registered queries: streams over the given tables, run to the end of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagery import constants as K
from passagery.functions import text as T
from passagery.operators import chunking as C
from passagery.streaming import jobs as J, runner as R, stateful as Z
from passagery.workload import base, sqlgen as S
from passagery.workload.chat import DEDUP_SQL, SESSION_SQL, lock_sql, shown_locks
from passagery.workload.catalog import EVENTS_SQL
from passagery.workload.registry import Tables, query

STAMP = "yyyy-MM-dd HH:mm:ss"


def event_stream(t: Tables):
    return R.stream_table(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def document_stream(t: Tables):
    docs = R.stream_table(t.spark, t.folder, "documents")
    return docs.select("doc_id", base.kb_of_source().alias("kb_id"), "text")


@query(f"WITH {S.CHUNKS}, {DEDUP_SQL} SELECT chunk_id, kb_id, text_hash FROM firsts", name="stream_ingest")
def stream_ingest(t: Tables):
    out = J.ingest_stream(document_stream(t))
    return t.spark.read.parquet(out).select("chunk_id", "kb_id", "text_hash")


@query(f"""WITH {SESSION_SQL.format(gap=3600)}, s AS (SELECT user_id, session_no, min(ts) AS a, max(ts) AS b, count(*) AS n_events FROM n GROUP BY ALL)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started, n_events FROM s
WHERE b + INTERVAL 3600 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(t: Tables):
    rows = R.appended(J.sliding_sessions(event_stream(t), "user_id", "ts"), "sessions")
    return rows.select("user_id", F.date_format("start", STAMP).alias("started"), "n_events")


@query(f"WITH {S.CHUNKS} SELECT DISTINCT kb_id, text_hash FROM chunks")
def stream_dedup(t: Tables):
    """Chunks of the document stream; the arrival time of a document is derived from its number."""
    chunks = C.chunk_text_model(document_stream(t)).withColumn("arrived", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")))
    return R.appended(J.dedup_stream(chunks, "arrived", "3650 days").select("kb_id", "text_hash"), "dedup")


@query(lock_sql(2, 4320))
def stream_lockouts(t: Tables):
    events = event_stream(t).select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return shown_locks(R.appended(Z.lockout_stream(events, 2, 4320), "lockouts"))


@query(f"WITH {EVENTS_SQL} SELECT doc_id, arg_max(status, seq) AS status, count(*) AS n_events FROM status_events GROUP BY doc_id")
def stream_status(t: Tables):
    orders = R.stream_table(t.spark, t.folder, "orders")
    full = F.array(*[F.lit(s) for s in K.STATUS_ORDER])
    st = F.when(F.col("o_orderstatus") == "F", full).when(F.col("o_orderstatus") == "O", F.slice(full, 1, 6)).otherwise(
        F.array(F.lit("PENDING"), F.lit("PARSING"), F.lit("FAILED"))
    )
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_orderpriority", F.posexplode(st).alias("seq", "status"))
    kept = rows.filter(~(F.col("o_orderpriority").startswith("1") & (F.col("status") == "PARSING")))
    events = kept.select("doc_id", "seq", (F.col("o_orderdate") + F.make_interval(hours=F.col("seq") * 5)).alias("event_time"), "status")
    return R.updated(J.latest_status_stream(events), "status", ["doc_id"])


@query("SELECT conv_id AS session_id, turn, text AS answer FROM conversations WHERE role = 'assistant' AND length(text) <= 900")
def stream_answers(t: Tables):
    rows = R.stream_table(t.spark, t.folder, "conversations").filter(F.col("role") == "assistant")
    end = F.when(F.length("text") <= 900, "done").when(F.length("text") <= 1500, "error").otherwise("pause")
    events = rows.select(F.inline(J.partial_event_rows(F.col("conv_id"), F.col("turn"), F.col("text"), end)))
    timed = events.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("session_id") * 60 + F.col("turn")))
    return R.appended(Z.answer_stream(timed), "answers")


@query("""WITH w AS (SELECT event_type AS caller, time_bucket(INTERVAL 1 HOUR, ts) AS a, count(*) AS n_calls FROM events GROUP BY ALL)
SELECT caller, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n_calls, n_calls > 4 AS over_limit FROM w
WHERE a + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)""")
def stream_call_rates(t: Tables):
    calls = event_stream(t).withColumnRenamed("event_type", "caller")
    rows = R.appended(J.call_rates(calls, "caller", "ts", "1 hour", 4), "rates")
    return rows.withColumn("start", F.date_format("start", STAMP))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS a, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM w WHERE a + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_type = 'view')""")
def stream_trend(t: Tables):
    views = event_stream(t).filter(F.col("event_type") == "view")
    return R.appended(J.trend_stream(views, "ts"), "trend").withColumn("start", F.date_format("start", STAMP))
