"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. A batch is reduced to one entry for each line key; the entries are merge-joined with the
live runs, keys that no run holds are fresh, and the batch becomes a run of its own, bucketed and sorted by hash. When
a level holds `fanout` runs they are merged into one run of the next level. Each document lies in one batch, so the
document counts of all entries of a key add up. DataFrame functions only.

Keys are compared by 128 bits of hash. Null and empty texts are one empty line. Rows repeated under one doc_id are one
document when counted and are all treated alike; rows without doc_id take no part and stay whole. A table without long
lines loses nothing, an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, ascii_lower

HASH = ["h1", "h2"]
ENTRY = "h1 long, h2 long, n_docs long, keeper long, fresh boolean"


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


def long_lines(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """One row for each line whose key is long enough: document, place, hashes of the key, batch."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keyed = lines.select("doc_id", "text_hash", "place", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc_id", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


class Runs:
    """Sorted runs by level; entries are (h1, h2, n_docs, keeper, fresh)."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int, fanout: int):
        self.spark, self.scratch, self.buckets, self.fanout = spark, scratch, buckets, fanout
        self.levels: list[list[str]] = [[]]

    def _live(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _save(self, entries: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        (entries.repartition(self.buckets, *HASH).write.option("path", f"{self.scratch.root}/{name}")
         .bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name))
        return name

    def add(self, entries: DataFrame) -> None:
        """Merge-join the entries with every live run, mark those that none holds as fresh, and store them as a run."""
        fresh = F.lit(True)
        for i, name in enumerate(self._live()):
            known = self.spark.table(name).where("fresh").select(*HASH, F.lit(True).alias(f"in_{i}"))
            entries = entries.join(known, HASH, "left")
            fresh = fresh & F.col(f"in_{i}").isNull()
        self.levels[0].append(self._save(entries.select(*HASH, "n_docs", "keeper", fresh.alias("fresh"))))
        self._compact(0)

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fanout:
            return
        merged = merge(self.all(self.levels[level]))
        name, old = self._save(merged), self.levels[level]
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(name)
        self._forget(old)
        self._compact(level + 1)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(*names)

    def all(self, names: list[str] | None = None) -> DataFrame:
        """The entries of several runs, read as plain files: a union of bucketed scans claims a partitioning that its
        rows do not have."""
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.scratch.root}/{name}" for name in names or self._live()])

    def close(self) -> None:
        self._forget(self._live())


def merge(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*HASH).agg(
        F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))


def frequent_lines(keyed: DataFrame, scratch: Scratch, batches: int, fanout: int, buckets: int, min_docs: int) -> DataFrame:
    """Keys of at least `min_docs` documents, with the largest doc_id that holds each."""
    runs = Runs(keyed.sparkSession, scratch, buckets, fanout)
    for batch in range(batches):
        held = keyed.where(F.col("batch") == batch)
        runs.add(held.groupBy(*HASH).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")))
    found = scratch.write(merge(runs.all()).where(F.col("n_docs") >= min_docs).select(*HASH, "keeper"), "frequent")
    runs.close()
    return found


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 6, fanout: int = 3,
               buckets: int | None = None) -> DataFrame:
    """`row` (the input row), `n_lines`, `n_dropped` and `kept_text`: lines of frequent keys stay in one document only."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = scratch.write(long_lines(plain, batches, min_chars).hint("rebalance", "batch"), "keyed", by=["batch"])
    frequent = frequent_lines(keyed, scratch, batches, fanout, buckets, min_docs)
    dropped = keyed.join(frequent, HASH).where("doc_id <> keeper").groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set("place")).alias("places"))
    whole = docs.select(F.struct("*").alias("row"), text.alias("text")).select(
        "row", "text", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    lines = F.split("text", "\n")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places")), lambda i: F.get("lines", i))
    out = whole.join(dropped, ["doc_id", "text_hash"], "left").select("row", "text", "places", lines.alias("lines"))
    return out.select(
        "row", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
