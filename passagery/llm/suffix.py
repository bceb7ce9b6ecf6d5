"""Repeated passages by sparse suffix arrays.

A suffix is retained where the hash of a few words is least among its neighbours, so that equal passages retain equal
suffixes. In any `least` equal words stands a retained suffix that shares its first `HEAD` words; suffixes sorted by
that head have their partners next to them, and those without an equal neighbour are gone. Around each suffix that is
left, the match is extended left and right: every window of `least` words that holds its head is sorted in the same
way, and windows with a neighbour from another text make up the repeated passages.

Work is on distinct texts; a text of `least` words or more that several rows have is a repeat as a whole. Words are
compared by 64-bit hashes. Sorting deals equal keys out over tasks by text and place, so that a passage of any number
of documents is split; what meets at the borders of partitions is settled from the groups that stand there.

Each row of a partition's first group and the last row it holds go to that settling, whatever the layout of batches.

Null and empty texts and those shorter than a passage have no repeats. What repeats within one text alone is none.
Rows repeated under one doc_id are copies of each other like any. A null doc_id is reported as null. An empty table
gives no rows. Very long texts are hashed whole; ties between partners go to the one of least number. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, texts

LEAST, HEAD, GRAM = 50, 26, 8
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of any number of words of a text, from one running sum modulo 2 ** 64."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, text: str):
        import xxhash

        tokens = text.encode().split()
        self.n = len(tokens)
        if len(Rolling.powers) <= self.n:
            size = 2 * self.n + 1024
            for name, base in (("powers", MULTIPLIER), ("inverses", INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(Rolling, name, np.cumprod(factors))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, self.n)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * Rolling.powers[:self.n])))

    def runs(self, length: int) -> np.ndarray:
        """The hash of the `length` words from each place on where so many are left."""
        count = max(0, self.n - length + 1)
        return mixed((self.sums[length:length + count] - self.sums[:count]) * Rolling.inverses[:count])


def retained(rolling: Rolling, least: int) -> np.ndarray:
    """Places of the suffixes that are kept: least word-gram hash in some window of starts."""
    window = least - HEAD + 1
    grams = rolling.runs(GRAM)[:max(0, rolling.n - HEAD + 1)]
    if rolling.n < least:
        return np.empty(0, np.int64)
    parts = []
    for i in range(0, len(grams) - window + 1, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[i:i + (1 << 16) + window - 1], window)
        parts.append(i + np.arange(len(view)) + view.argmin(axis=1))
    return np.unique(np.concatenate(parts))


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """Each row's text hashes, number of words, and retained suffixes (place, head)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, places, heads = [], [], []
            for text in batch.column("text").to_pylist():
                rolling = Rolling(text)
                at = retained(rolling, least)
                sizes.append(rolling.n)
                places.append(at)
                heads.append(rolling.runs(HEAD)[at].view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind))
                     for x, kind in ((places, pa.int32()), (heads, pa.int64()))]
            yield pa.record_batch([*batch.columns[:3], pa.array(sizes, pa.int64()), *lists],
                                  names=["doc_id", "t1", "t2", "n_words", "places", "heads"])

    return hashed(docs).select("doc_id", "t1", "t2", "text").mapInArrow(
        run, "doc_id long, t1 long, t2 long, n_words long, places array<int>, heads array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))


def _neighbours(batches: Iterator) -> Iterator:
    """Rows sorted by key, text, place: those whose key another text shares, and the outer groups of the partition."""
    import pyarrow as pa

    names = ["key", "text_no", "place"]
    held, first, several, least_no = [np.empty(0, np.int64)] * 3, True, False, 0

    def out(rows: list[np.ndarray], matched: np.ndarray, edge: np.ndarray, near: np.ndarray):
        keep = matched | edge
        return pa.record_batch([*[pa.array(x[keep]) for x in rows], pa.array(near[keep]), pa.array(matched[keep]), pa.array(edge[keep])],
                               names=[*names, "near", "matched", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate((h, batch.column(name).to_numpy().astype(np.int64))) for h, name in zip(held, names)]
        starts = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows[0]))))
        low, high = rows[1][starts], rows[1][np.append(starts[1:], len(rows[0])) - 1]
        if several:
            low[0] = least_no  # seen in an earlier batch
        multi, last = low != high, len(starts) - 1
        is_low = rows[1] == low[group]
        second = rows[1][np.minimum(starts + np.add.reduceat(is_low.astype(np.int64), starts), np.append(starts[1:], len(group)) - 1)]
        near = np.where(is_low, second[group], low[group])
        # of a group that may go on, the last row waits; while it is of one text alone, all of it waits
        several, least_no = bool(multi[last]), int(low[last])
        cut = len(group) - 1 if several else starts[last]
        edge = (group == 0) & first
        if cut:
            yield out([x[:cut] for x in rows], multi[group][:cut], edge[:cut], near[:cut])
        first &= last == 0
        held = [x[cut:] for x in rows]
    n = len(held[0])
    if n:
        yield out(held, np.full(n, several), np.ones(n, bool), np.full(n, least_no) if several else held[1])


def repeated(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(text_no, place, near): the rows of (key, text_no, place) whose key another text has; `near` is such a text."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "text_no", "place"]
    found = scratch.write(rows.select(*order).repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(
        _neighbours, "key long, text_no long, place long, near long, matched boolean, edge boolean"), name)
    borders = found.where("edge").groupBy("key").agg(
        F.min(F.least("near", "text_no")).alias("low"), F.max(F.greatest("near", "text_no")).alias("high")).where("low <> high")
    near = F.when(F.col("low").isNull(), F.col("near")).when(F.col("text_no") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    # a partition has two outer keys at most, so the borders are few; a key over several partitions keeps one centre
    return found.join(F.broadcast(borders), "key", "left").where("matched OR low IS NOT NULL").select(
        "text_no", "place", near.alias("near"))


def windows(held: DataFrame, least: int) -> DataFrame:
    """(key, text_no, place) of every window of `least` words that holds the head of a suffix in `places`."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            parts = []
            for number, places, text in zip(*columns):
                keys = Rolling(text).runs(least)
                marks = np.zeros(len(keys) + 1, np.int64)
                at = np.array(places, np.int64)
                np.add.at(marks, np.clip(at - (least - HEAD), 0, len(keys)), 1)
                np.add.at(marks, np.clip(at + 1, 0, len(keys)), -1)
                starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                parts.append((keys[starts].view(np.int64), np.full(len(starts), number, np.int64), starts))
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["key", "text_no", "place"])

    return held.select("text_no", "places", "text").mapInArrow(run, "key long, text_no long, place long")


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, start_word, end_word, match_id, class_id, matches): the maximal stretches of each document that lie in
    runs of `least` words or more found in another row too, and the doc_id of a row with such a run.

    `class_id` is the smallest doc_id with the same text. `matches` lists the runs of the stretch by partner, each as
    (start_word, end_word, match_id) with the partner's class; texts that share a window form a star around one of
    them, so that no text is cut off from another it shares words with. A text that several rows have is one stretch
    as a whole in each of them, and the row of its class_id alone lists what it shares with other texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix")
    rows = scratch.write(suffixes(docs, least), "rows")
    distinct = scratch.write(rows.dropDuplicates(["t1", "t2"]).select(
        F.monotonically_increasing_id().alias("text_no"), "t1", "t2", "places", "heads"), "distinct")
    heads = distinct.select("text_no", F.explode(F.arrays_zip("places", "heads")).alias("s")).select(
        F.col("s.heads").alias("key"), "text_no", F.col("s.places").cast("long").alias("place"))
    left = repeated(scratch.write(heads, "heads"), scratch, "sorted_heads")
    numbered = distinct.select("text_no", "t1", "t2")
    regions = scratch.write(left.groupBy("text_no").agg(F.collect_set("place").alias("places")).join(
        numbered, "text_no"), "regions")
    scratch.drop("heads", "sorted_heads")

    whole = hashed(docs).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    spread = scratch.write(windows(whole.join(regions, ["t1", "t2"]), least), "windows")
    found = scratch.write(repeated(spread, scratch, "sorted_windows"), "found")
    scratch.drop("windows", "sorted_windows", "regions")
    in_text = Window.partitionBy("text_no").orderBy("place")
    opened = F.coalesce((F.col("place") > F.lag("place").over(in_text) + least).cast("int"), F.lit(1))
    by_partner = Window.partitionBy("text_no", "near").orderBy("place")
    broken = F.coalesce((F.col("place") > F.lag("place").over(by_partner) + 1).cast("int"), F.lit(1))
    runs = found.withColumn("opened", opened).withColumn("stretch", F.sum("opened").over(in_text)).withColumn(
        "broken", broken).withColumn("run", F.sum("broken").over(by_partner)).groupBy(
        "text_no", "stretch", "near", "run").agg(
        F.min("place").alias("start_word"), (F.max("place") + least).alias("end_word"))

    named = scratch.write(rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id")).join(
        numbered, ["t1", "t2"]), "named")
    partner = named.select(F.col("text_no").alias("near"), F.col("first_id").alias("match_id"))
    part = F.struct("start_word", "end_word", "match_id")
    inside = scratch.write(runs.join(partner, "near").groupBy("text_no", "stretch").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("match_id").alias("match_id"),
        F.array_sort(F.collect_list(part)).alias("matches")), "inside")
    single = inside.join(named.where("copies = 1").select("text_no", F.col("first_id").alias("doc_id")), "text_no").select(
        "doc_id", "start_word", "end_word", "match_id", F.col("doc_id").alias("class_id"), "matches")
    shared = inside.groupBy("text_no").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    copies = named.where("copies > 1").join(shared, "text_no", "left").select("t1", "t2", "first_id", "last_id", "matches")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    return single.unionAll(
        rows.select("doc_id", "t1", "t2", "n_words").where(F.col("n_words") >= least).join(copies, ["t1", "t2"]).select(
            "doc_id", F.lit(0).cast("long"), F.col("n_words"), F.when(is_first, F.col("last_id")).otherwise(F.col("first_id")),
            "first_id", F.when(is_first, F.col("matches"))))
