"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and its own reply is the only
trainable text. What follows the last reply closes the conversation in a record without trainable text, so that the
output holds every turn and can be read back.

A turn is written `### role: text </turn>` and a line feed. In texts and roles a backslash is doubled, one is put
between two `#`, and one into `</turn>`; in roles colons get one too. So no text holds a control string, and dropping
the backslashes gives it back.

Turns are dealt by range of (conversation, turn) and packed into blocks of at most `TURNS` turns, or `CHARS` characters
where one turn has no more. An example is one or more parts in order: whole blocks of context that went before, and the
part with the reply. So neither a conversation nor an example is ever held whole: a conversation with any share of the
rows lies over many tasks and a part is bounded. Examples of n turns hold n * n / 2 turns together, which is what the
expansion means; nothing is written for it, parts are made as they are read.

Turns go by `turn`, null first, ties by role, then text; rows repeated are turns repeated. Null texts and roles are
empty. A null conv_id is one conversation without a name. Very long texts are one part. An empty table gives no rows.
Only conv_id, turn, role and text are read, so that no further column can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

TURNS, CHARS = 32, 1 << 15
REPLY = "assistant"
START, STOP = "### ", " </turn>\n"
HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=#)", r"#\\")
    return F.replace(text, F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each formatted turn of a part."""
    for turn in text.split(STOP)[:-1]:
        head = HEADER.match(turn)
        yield unescaped(head[1]), unescaped(turn[head.end():])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id and turn of each row, the formatted turn, and the places of its trainable characters."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 empty("role").alias("role"), empty("text").alias("text"))
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    made = plain.select("*", head.alias("head"), escaped(F.col("text")).alias("body"))
    start = F.when(F.col("role") == REPLY, F.char_length("head"))
    return made.select("conv_id", "turn", "role", "text", F.concat("head", "body", F.lit(STOP)).alias("segment"),
                       start.alias("start"), (start + F.char_length("body")).alias("stop"))


def blocks(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Runs of turns of one conversation in order: conv_id, task and place in it, turns and replies of the conversation
    before the block, `alone` where the block is known to be the whole conversation, and the turns."""
    small_batches(conversations.sparkSession)
    segment = "struct<segment:string,start:int,stop:int>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task, place = TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.struct([("segment", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        names = ["conv_id", "task", "place", "replies", "alone", "turns"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), kind]
        held, chars, current, replies, opened, first = [], 0, None, 0, True, True

        def block(ended: bool) -> tuple:
            nonlocal held, chars, place, replies, opened
            row = (current, task, place, replies, opened and ended and not first, held)
            place, replies = place + 1, replies + sum(t["start"] is not None for t in held)
            held, chars, opened = [], 0, False
            return row

        def batch_of(rows: list) -> object:
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != current:
                    out.append(block(True))
                    replies, opened, first = 0, True, False
                elif held and (len(held) == TURNS or chars + len(row["segment"]) > CHARS):
                    out.append(block(False))
                current, chars = row.pop("conv_id"), chars + len(row["segment"])
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([block(False)])

    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "copy"]
    dealt = formatted(conversations).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(
        tasks, *order).sortWithinPartitions(*order)
    made = scratch.write(dealt.select("conv_id", "segment", "start", "stop").mapInArrow(
        run, f"conv_id long, task int, place long, replies long, alone boolean, turns array<{segment}>"), "blocks")

    # replies of the earlier tasks of a conversation that crosses tasks: two such conversations a task at most
    crossing = made.where("NOT alone").groupBy("conv_id", "task").agg(
        F.sum(F.size(F.filter("turns", lambda t: t["start"].isNotNull()))).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    earlier = crossing.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), before.alias("before"))
    return made.join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")), "left").select(
        "conv_id", "task", "place", (F.col("replies") + F.coalesce("before", F.lit(0))).alias("replies"), "alone", "turns")


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, task, place, text, start, stop): the parts of each example, ordered by task and place.

    Examples count from 1 within their conversation. `start` and `stop` are the trainable code points of `text`, null
    in parts without any. What follows the last reply is an example without trainable text.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    made = scratch.write(blocks(conversations, scratch), "numbered")
    joined = lambda turns: F.array_join(F.transform(turns, lambda t: t["segment"]), "")
    spot = F.explode(F.sequence(F.lit(1), F.size("turns")))
    spots = made.select("*", spot.alias("at")).withColumn("turn", F.col("turns")[F.col("at") - 1]).where(
        "turn.start IS NOT NULL OR at = size(turns)")
    until = F.slice("turns", 1, F.col("at") - 1)
    shift = F.char_length(joined(until))
    told = F.size(F.filter(F.slice("turns", 1, F.col("at")), lambda t: t["start"].isNotNull()))
    reply = F.col("turn.start").isNotNull()
    own = spots.select(
        "conv_id", (F.col("replies") + told + F.when(reply, 0).otherwise(1)).alias("example"), "task", "place", "alone",
        joined(F.slice("turns", 1, F.col("at"))).alias("text"), (shift + F.col("turn.start")).alias("start"),
        (shift + F.col("turn.stop")).alias("stop"))

    # a block that ends without a reply closes the conversation only if no block follows
    ends = made.where("NOT alone").groupBy("conv_id").agg(F.max(F.struct("task", "place")).alias("last")).select(
        F.col("conv_id").alias("c"), "last")
    closing = own.where("start IS NULL AND NOT alone").join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).where(
        F.struct("task", "place") == F.col("last")).drop("c", "last")
    kept = own.where("start IS NOT NULL OR alone").unionByName(closing)

    thin = kept.where("NOT alone").select("conv_id", "example", F.col("task").alias("t"), F.col("place").alias("p"))
    context = made.where("NOT alone").select(F.col("conv_id").alias("c"), "task", "place", joined(F.col("turns")).alias("text"))
    earlier = thin.join(context, F.col("conv_id").eqNullSafe(F.col("c"))).where(
        "task < t OR (task = t AND place < p)").select(
        "conv_id", "example", "task", "place", "text", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"))
    return kept.drop("alone").unionByName(earlier)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of formatted conversations.

    Turns are those of the last record of a conversation, which holds them all; replies are what the masks of all
    records leave. Both digests run over the sorted parts of a conversation as a stream, a part at a time.
    """
    small_batches(parts.sparkSession)
    last = parts.groupBy("conv_id").agg(F.max("example").alias("last"), F.sum(F.char_length("text")).alias("formatted_chars"))
    named = last.select(F.col("conv_id").alias("c"), "last", "formatted_chars")
    loss = F.when(F.col("start").isNotNull(), F.expr("substring(text, start + 1, stop - start)"))
    seen = parts.join(named, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "example", "task", "place", "formatted_chars", loss.alias("loss"),
        F.when(F.col("example") == F.col("last"), F.col("text")).alias("text")).where("loss IS NOT NULL OR text IS NOT NULL")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state = None

        def close() -> tuple:
            conv, n, turns, chars, replies, total = state
            return conv, n, turns.hexdigest(), chars, replies.hexdigest(), total

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        out.append(close())
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), row["formatted_chars"]]
                if row["loss"] is not None:
                    reply = unescaped(row["loss"])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                for role, text in turns_of(row["text"] or ""):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=fields)
        if state is not None:
            yield pa.record_batch([pa.array([x], k) for x, k in zip(close(), kinds)], names=fields)

    return seen.repartition("conv_id").sortWithinPartitions("conv_id", "example", "task", "place").select(
        "conv_id", "formatted_chars", "loss", "text").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
