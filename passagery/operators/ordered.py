"""Running values over long ordered histories.

A plain window over a key puts all rows of that key into one task. Here a history is cut into buckets by a
monotone expression of its order (a day, a month, a range of numbers): rows are processed per (key, bucket), and
one small row per bucket carries the state on. A key that holds a third of the data is spread over its buckets.
Rows are shuffled once in full; the bucket summaries come from a narrow second read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from passagery.session import materialize

BUCKET = "__bucket"
DENSE = "__dense"
BUCKET_ROWS = 50_000


def by_density(df: DataFrame, keys: list[str], slice_: Column, rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `DENSE`, a bucket of about `rows` rows per key, cut between values of `slice_`, a monotone expression of the order.

    Slices are counted and the counts summed per key, so that a busy hour is cut as finely as its slices allow while
    quiet months share a bucket. Only the slices after a key's first bucket are written and joined: their table is
    empty or small unless most keys are long, and its size is known from its files.
    """
    cut = df.withColumn("__slice", slice_)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    place = F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / rows).alias(DENSE)
    later = materialize(counts.select(*keys, "__slice", place).filter(F.col(DENSE) > 0), "slices")
    return cut.join(later, [*keys, "__slice"], "left").withColumn(DENSE, F.coalesce(DENSE, F.lit(0))).drop("__slice")


def earlier(keys: list[str]):
    """All earlier buckets of the same key."""
    return Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def so_far(keys: list[str], order: list[str]):
    """All rows up to the current one within its bucket."""
    return Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Add the value of the preceding row of the same key, per key in the given order."""
    cut = df.withColumn(BUCKET, bucket)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    rows = cut.select("*", *[F.lag(e).over(local).alias(n) for n, e in values.items()], F.row_number().over(local).alias("__no"))
    place = F.struct(*[F.col(c) for c in order])
    last = cut.groupBy(*keys, BUCKET).agg(*[F.max_by(e, place).alias(f"__{n}") for n, e in values.items()])
    before = Window.partitionBy(*keys).orderBy(BUCKET)
    carried = last.select(*keys, BUCKET, *[F.lag(f"__{n}").over(before).alias(f"__{n}") for n in values])
    joined = rows.join(carried, [*keys, BUCKET])
    for n in values:
        joined = joined.withColumn(n, F.when(F.col("__no") == 1, F.col(f"__{n}")).otherwise(F.col(n)))
    return joined.drop(BUCKET, "__no", *[f"__{n}" for n in values])


def counts_since(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, counters: dict[str, tuple[Column, Column]], first_resets: bool = False
) -> DataFrame:
    """Add `seq` (row number) and, per counter (counted, reset), the number of counted rows since the last reset row.

    That number is the running count minus the running count at the last reset. Both only grow, so a bucket is
    summed up by its two maxima, and the state before a bucket is a sum and a maximum over the earlier summaries.
    With `first_resets` the first row of a key resets every counter.
    """
    cut = df.withColumn(BUCKET, bucket)
    local = so_far(keys, order)
    one = lambda c: F.when(c, 1).otherwise(0)
    counted = cut.select(
        "*", F.row_number().over(local.orderBy(*order)).alias("seq"),
        *[F.sum(one(c)).over(local).alias(f"__n_{n}") for n, (c, _) in counters.items()],
    )
    rows = counted.select(
        "*", *[F.max(F.when(r, F.col(f"__n_{n}"))).over(local).alias(f"__b_{n}") for n, (_, r) in counters.items()]
    )
    place = F.struct(*[F.col(c) for c in order])
    totals = rows.groupBy(*keys, BUCKET).agg(
        F.max("seq").alias("__seq"),
        *[F.max(f"__n_{n}").alias(f"__n_{n}") for n in counters], *[F.max(f"__b_{n}").alias(f"__b_{n}") for n in counters],
        *[F.min_by(one(c), place).alias(f"__f_{n}") for n, (c, _) in counters.items()],
    )
    before, upto = earlier(keys), Window.partitionBy(*keys).orderBy(BUCKET)
    summed = totals.select(
        *keys, BUCKET, *[f"__b_{n}" for n in counters], F.coalesce(F.sum("__seq").over(before), F.lit(0)).alias("__c_seq"),
        *[F.coalesce(F.sum(f"__n_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in counters],
        *[F.first(f"__f_{n}").over(upto).alias(f"__f_{n}") for n in counters],
    )
    carried = summed.select(
        *keys, BUCKET, "__c_seq", *[f"__c_{n}" for n in counters], *[f"__f_{n}" for n in counters],
        *[F.max(F.col(f"__b_{n}") + F.col(f"__c_{n}")).over(before).alias(f"__p_{n}") for n in counters],
    )
    joined = rows.join(carried, [*keys, BUCKET]).withColumn("seq", F.col("seq") + F.col("__c_seq"))
    for n in counters:
        total = F.col(f"__n_{n}") + F.col(f"__c_{n}")
        start = F.col(f"__f_{n}") if first_resets else F.lit(0)
        base = F.greatest(F.col(f"__b_{n}") + F.col(f"__c_{n}"), F.col(f"__p_{n}"), start)
        joined = joined.withColumn(n, total - base)
    helpers = [f"__{kind}_{n}" for n in counters for kind in "nbcfp"]
    return joined.drop(BUCKET, "__c_seq", *helpers)


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], bucket: Column, clock: Column, gap: int, out: str) -> DataFrame:
    """Add the number of the gap-separated run each row belongs to, per key; `clock` is the position in time."""
    cut = df.withColumn(BUCKET, bucket).withColumn("__clock", clock)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    gaps = cut.withColumn("__step", F.col("__clock") - F.lag("__clock").over(local))
    starts = F.sum(F.when(F.col("__step") >= gap, 1).otherwise(0)).over(so_far(keys, order))
    rows = gaps.withColumn("__starts", starts)
    totals = rows.groupBy(*keys, BUCKET).agg(
        F.min("__clock").alias("__first"), F.max("__clock").alias("__last"), F.max("__starts").alias("__n")
    )
    order_b = Window.partitionBy(*keys).orderBy(BUCKET)
    step = F.col("__first") - F.lag("__last").over(order_b)
    opened = totals.withColumn("__opens", F.when(step.isNull() | (step >= gap), 1).otherwise(0))
    carried = opened.select(
        *keys, BUCKET, (F.col("__opens") + F.coalesce(F.sum(F.col("__opens") + F.col("__n")).over(earlier(keys)), F.lit(0))).alias("__base")
    )
    joined = rows.join(carried, [*keys, BUCKET]).withColumn(out, F.col("__base") + F.col("__starts"))
    return joined.drop(BUCKET, "__clock", "__step", "__starts", "__base")


def _chain(since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of the last window picked, as a step function of the time up to which no window may start: entered
    before `starts[i]` it is `ends[i]`, entered later it stays what it was. Entries beyond the first window's end do
    not occur, because an entry is the end of an earlier window."""
    following = np.searchsorted(since, until, side="right")
    last = until.copy()
    for i in range(len(since) - 1, -1, -1):
        if following[i] < len(since):
            last[i] = last[following[i]]
    reach = slice(0, min(following[0] + 1, len(since)))
    starts, ends = since[reach], last[reach]
    keep = np.append(ends[1:] != ends[:-1], True)
    return starts[keep], ends[keep]


def _steps(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.drop(columns=["since", "until"])
    chains = [_chain(np.asarray(a), np.asarray(b)) for a, b in zip(pdf["since"], pdf["until"])]
    return out.assign(starts=[c[0].tolist() for c in chains], ends=[c[1].tolist() for c in chains])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a bucket is entered with: the step functions of the earlier buckets applied in turn."""
    ordered = pdf.sort_values(BUCKET)
    reached, now = [], np.iinfo(np.int64).min
    for starts, ends in zip(ordered["starts"], ordered["ends"]):
        reached.append(now)
        place = np.searchsorted(np.asarray(starts), now, side="right")
        now = int(ends[place]) if place < len(starts) else now
    return ordered.drop(columns=["starts", "ends"]).assign(entry=np.array(reached, dtype="int64"))


def disjoint_windows(df: DataFrame, keys: list[str], number: str, since: Column, until: Column, bucket: Column) -> DataFrame:
    """The rows picked when windows [since, until] (long) are taken per key in the order of `number`, each that starts
    after the end of the one taken before; both ends must rise with `number`.

    What a bucket does to the end of the last window taken is a step function, found in the bucket alone. The
    functions of a key are applied one after the other, which gives what each bucket is entered with, and the buckets
    pick their rows side by side. Keys with one bucket, nearly all, are done without Python.
    """
    row = F.struct(F.col(number).alias("no"), since.alias("since"), until.alias("until"), F.struct(*df.columns).alias("row"))
    lists = df.withColumn(BUCKET, bucket).groupBy(*keys, BUCKET).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists = materialize(lists, "windows")
    many = lists.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kinds = T.StructType([f for f in lists.schema.fields if f.name != "rows"])
    wide = lambda *more: T.StructType([*kinds.fields, *more])
    longs = T.ArrayType(T.LongType())
    crowded = lists.join(many, keys, "left_semi").select(*keys, BUCKET, F.col("rows.since").alias("since"), F.col("rows.until").alias("until"))
    # a row is a bucket already: no shuffle, and no call of Python for each of very many buckets
    steps = crowded.mapInPandas(lambda parts: map(_steps, parts), wide(T.StructField("starts", longs), T.StructField("ends", longs)))
    entries = steps.groupBy(*keys).applyInPandas(_entries, wide(T.StructField("entry", T.LongType())))
    begin = F.coalesce("entry", F.lit(int(np.iinfo(np.int64).min)))
    kind = lists.schema["rows"].dataType.simpleString()
    picked = F.aggregate(
        "rows", F.struct(begin.alias("end"), F.array().cast(kind).alias("taken")),
        lambda a, r: F.when(r["since"] > a["end"], F.struct(r["until"].alias("end"), F.array_append(a["taken"], r).alias("taken"))).otherwise(a),
        lambda a: F.transform(a["taken"], lambda r: r["row"]),
    )
    return lists.join(entries, [*keys, BUCKET], "left").select(F.inline(picked)).select(*df.columns)
