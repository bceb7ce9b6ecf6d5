"""Chat sessions and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagery import constants as K
from passagery.functions import codes
from passagery.functions.text import estimate_tokens, is_blank
from passagery.operators.context import parse_citations
from passagery.operators.ordered import BUCKET_ROWS, DENSE, by_density, counts_since, disjoint_windows, gap_sessions
from passagery.session import materialize


def list_sessions(sessions: DataFrame, user_id: int | None = None, tenant_id: int | None = None) -> DataFrame:
    """Sessions of a user, or of every user, that are not deleted, latest access first."""
    mine = sessions.filter(F.col("deleted") == 0)
    if user_id is not None:
        mine = mine.filter(F.col("user_id") == user_id)
    if tenant_id is not None:
        mine = mine.filter(F.col("tenant_id") == tenant_id)
    return mine.orderBy("user_id", F.col("last_access_time").desc(), "session_id")


def session_history(messages: DataFrame) -> DataFrame:
    """Messages with parsed citations, in order of creation."""
    shown = messages.filter(F.col("deleted") == 0).withColumn("citations", parse_citations(F.col("citations")))
    return shown.orderBy("session_id", "create_time", "message_id")


def rebuild_sessions(sessions: DataFrame, messages: DataFrame, requests: DataFrame, page_size: int = 10000) -> DataFrame:
    """Sessions with their ordered messages, for requests whose tenant and user own the session.

    Messages are ordered within pages of `page_size` turns; a second level joins the pages of a session to one row.
    """
    owned = requests.join(sessions, ["session_id", "tenant_id", "user_id"]).filter(F.col("deleted") == 0)
    page = F.floor(F.col("turn") / page_size)
    nested = (
        messages.filter(F.col("deleted") == 0).withColumn("page", page).groupBy("session_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
        .groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("page", "messages"))).alias("pages"))
        .select("session_id", F.flatten(F.transform("pages", lambda p: p["messages"])).alias("messages"))
    )
    return owned.join(nested, "session_id", "left")


def to_rounds(messages: DataFrame) -> DataFrame:
    """Pair each user message with the assistant message at the next turn: an equi-join, not a window."""
    ask = messages.filter(F.col("role") == "USER").select("session_id", "turn", F.col("text").alias("question"))
    reply = messages.filter(F.col("role") == "ASSISTANT").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return ask.join(reply, ["session_id", "turn"], "left")


def explode_rounds(rounds: DataFrame) -> DataFrame:
    """The rows a round writes: the question, and the answer unless it is blank."""
    row = lambda no, role, text: F.struct(F.lit(no).alias("step"), F.lit(role).alias("role"), F.col(text).alias("text"))
    rows = F.filter(
        F.array(row(0, "USER", "question"), row(1, "ASSISTANT", "answer")), lambda r: (r["role"] == "USER") | ~is_blank(r["text"])
    )
    return rounds.select("session_id", "turn", F.inline(rows)).select(
        "session_id", (F.col("turn") + F.col("step")).alias("turn"), "role", "text"
    )


def first_user_text(messages: DataFrame) -> DataFrame:
    asked = messages.filter(F.col("role") == "USER")
    return asked.groupBy("session_id").agg(F.min_by("text", "turn").alias("first_text"))


def session_titles(messages: DataFrame) -> DataFrame:
    return first_user_text(messages).withColumn("title", codes.session_title(F.col("first_text"))).drop("first_text")


def upsert_sessions(heads: DataFrame, rounds: DataFrame) -> DataFrame:
    """Session heads after new rounds: a title is set once, the last model named wins, access time moves forward."""
    news = rounds.groupBy("session_id").agg(
        F.min_by("question", "round_no").alias("first_question"),
        F.max_by("model_name", F.when(F.col("model_name").isNotNull(), F.col("round_no"))).alias("new_model"),
        F.max("round_time").alias("new_time"),
    )
    merged = heads.join(news, "session_id", "full_outer")
    title = F.when(is_blank(F.col("title")), codes.session_title(F.col("first_question"))).otherwise(F.col("title"))
    return merged.select(
        "session_id", title.alias("title"), F.coalesce("new_model", "model_name").alias("model_name"),
        F.greatest("last_access_time", "new_time").alias("last_access_time"),
    )


def soft_delete(rows: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    """Mark rows of the given sessions as deleted; nothing is removed."""
    gone = ids.select(key).distinct().withColumn("gone", F.lit(1))
    return rows.join(gone, key, "left").withColumn("deleted", F.coalesce("gone", "deleted")).drop("gone")


def trim_history(messages: DataFrame, rounds: int = K.HISTORY_ROUNDS, tokens: int = K.HISTORY_TOKENS) -> DataFrame:
    """The latest `rounds` rounds that fit the token budget. The row cap comes first and is applied map-side."""
    back = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    recent = messages.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= 2 * rounds)
    total = F.sum(estimate_tokens(F.col("text"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return recent.withColumn("used_tokens", total).filter(F.col("used_tokens") <= tokens)


def sessionize(events: DataFrame, keys: list[str], ts: str, gap_seconds: int = K.SESSION_TTL_SECONDS, tie: str = "event_id", bucket: Column | None = None, rows: int = BUCKET_ROWS) -> DataFrame:
    """Number the sliding-expiry sessions of each key: a gap of at least the lifetime starts a new one. Buckets follow
    the number of rows in minutes, or are given."""
    cut = by_density(events, keys, F.date_trunc("minute", ts), rows) if bucket is None else events.withColumn(DENSE, bucket)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return gap_sessions(cut, keys, [ts, tie], F.col(DENSE), micros, gap_seconds * 1_000_000, "session_no").drop(DENSE)


def resolve_tenant(requests: DataFrame, kbs: DataFrame) -> DataFrame:
    """Tenant of the knowledge base asked, else the user's own id."""
    known = kbs.select("kb_id", F.col("tenant_id").alias("kb_tenant"))
    return requests.join(known, "kb_id", "left").withColumn("tenant_id", F.coalesce(F.col("kb_tenant").cast("bigint"), F.col("user_id"))).drop("kb_tenant")


def lockouts(
    events: DataFrame, keys: list[str], ts: str, tie: str, failed: Column, limit: int = K.LOCK_FAILURES, minutes: int = K.LOCK_MINUTES,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Attempts that lock an account: the last of `limit` failures without a success between them.

    While it is locked, attempts are refused and not counted, up to and including the moment the lock ends; the first
    later one starts from a count of 0. A row that could lock is one with `limit` failures in a row up to it. From the
    first of these to the end of its lock it is a window, and an account is locked by the windows that follow one
    another without touching. Adds `since`, the time of the first failure counted, and `locked_until`.
    """
    order = [ts, tie]
    cut = by_density(events.select(*keys, *order, failed.alias("failed")), keys, F.date_trunc("minute", ts), rows)
    streaks = counts_since(cut, keys, order, F.col(DENSE), {"streak": (F.col("failed"), ~F.col("failed"))})
    failures = materialize(streaks.filter("failed").select(*keys, *order, "seq", "streak"), "failures")
    first = failures.select(*keys, (F.col("seq") + (limit - 1)).alias("seq"), F.col(ts).alias("since"))
    full = failures.filter(F.col("streak") >= limit).join(first, [*keys, "seq"])
    full = full.withColumn("locked_until", F.col(ts) + F.expr(f"INTERVAL {minutes} MINUTES"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    locks = disjoint_windows(full, keys, "seq", micros("since"), micros("locked_until"), F.floor(F.col("seq") / rows))
    return locks.select(*keys, *order, "since", "locked_until")
