"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets its Hamming distances to many references. References of a block differ from zero in
that block only, so distance to the reference less distance to zero depends on the bits of the block alone; two
fingerprints that differ in at most `radius` bits agree on all but `radius` blocks, and hence in all those
coordinates. The coordinates of the blocks that may agree are the join keys, so no pair in range is lost and no pair
is made elsewhere. A candidate pair goes on if its largest coordinate difference is within the radius, and is then
verified bit by bit.

A key shared by more than `max_group` fingerprints makes no pairs: its members link over midpoints. Two fingerprints
differ in at most two bits exactly if a value exists that differs from both in at most one, and no such value has more
than 65 neighbours. For a larger radius the midpoint walk is over values one bit away repeatedly, so only 2 is offered.

A text without words has fingerprint zero and links like any other; fewer words than a shingle give one shingle of all.
Null texts are empty. Copies and repeated rows share a fingerprint and a component. A null doc_id never names a
component; the component of rows without any doc_id is null. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import components

BITS, RADIUS, BLOCKS, REFERENCES = 64, 2, 5, 8
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, width: int) -> int:
    import numpy as np
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the 64-bit fingerprint of the shingles of `width` words of each row, as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t or "", width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


def references() -> list[tuple[int, int]]:
    """(block, reference) with the reference as a signed long; the first reference is zero."""
    draw, out, width = random.Random(SEED), [(-1, 0)], -(-BITS // BLOCKS)
    for block in range(BLOCKS):
        low, high = block * width, min(BITS, (block + 1) * width)
        for _ in range(REFERENCES):
            bits = sum(draw.getrandbits(1) << i for i in range(low, high))
            out.append((block, bits - (1 << BITS) if bits >> (BITS - 1) else bits))
    return out


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """`fps` with `dist`, the distances to all references, and `blocks`, one hash of the local coordinates a block."""
    refs = references()
    table = fps.withColumn("dist", F.array(*[_distance(F.col("fp"), F.lit(r)).cast("tinyint") for _, r in refs]))
    local = [F.xxhash64(*[F.col("dist")[i] - F.col("dist")[0] for i, (b, _) in enumerate(refs) if b == block])
             for block in range(BLOCKS)]
    return table.withColumn("blocks", F.array(*local))


def close(fps: DataFrame, scratch: Scratch, max_group: int = 64) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of node ids: the pairs in range of keys that make pairs, and the links over midpoints of the others.

    `fps` is (node, fp) with distinct non-null nodes and distinct fingerprints.
    """
    table = scratch.write(pivot_table(fps), "pivots")
    choices = list(itertools.combinations(range(BLOCKS), BLOCKS - RADIUS))
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("blocks")[b] for b in choice]) for i, choice in enumerate(choices)])
    keyed = scratch.write(table.select("node", "fp", "dist", F.explode(keys).alias("key")), "keyed")
    sizes = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    grouped = scratch.write(keyed.join(sizes, "key"), "grouped")
    scratch.drop("pivots", "keyed", "sizes")

    small = grouped.where(F.col("n") <= max_group)
    other = small.select("key", F.col("node").alias("node2"), F.col("fp").alias("fp2"), F.col("dist").alias("dist2"))
    apart = F.array_max(F.zip_with("dist", "dist2", lambda x, y: F.abs(x - y)))
    pairs = small.join(other, "key").where("fp < fp2").where(apart <= RADIUS).where(
        _distance(F.col("fp"), F.col("fp2")) <= RADIUS).select(F.col("node").alias("a"), F.col("node2").alias("b"))

    crowded = grouped.where(F.col("n") > max_group).select("node", "fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(BITS)]
    midpoints = crowded.select("node", F.explode(F.array(*flips)).alias("midpoint"))
    stars = midpoints.groupBy("midpoint").agg(F.collect_list("node").alias("near")).where(F.size("near") > 1)
    over = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
    return pairs, over.where("a <> b")


def links(fps: DataFrame, scratch: Scratch, max_group: int = 64) -> DataFrame:
    """(a, b) of node ids: for every two fingerprints in range a path of links that are all in range."""
    pairs, over = close(fps, scratch, max_group)
    return pairs.unionAll(over)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each input row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    printed = scratch.write(fingerprints(docs, width), "printed")
    distinct = scratch.write(printed.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    linked = scratch.write(links(distinct.where("node IS NOT NULL").select("node", "fp"), scratch), "links")
    scratch.drop("grouped")
    roots = components(linked, scratch)
    classes = scratch.write(distinct.join(roots, "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component_id")), "classes")
    return printed.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The rows of one document of each component, that of the smallest doc_id; of rows repeated under it, one stays.
    Rows without doc_id stay, since no id can name them. `found` is (doc_id, component_id), by default near_duplicates."""
    found = near_duplicates(docs) if found is None else found
    keepers = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keeper")).distinct()
    id_of = F.col("row.doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row")).withColumn("id", id_of).withColumn("text_hash", F.xxhash64("row.text"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("text_hash"))
    kept = rows.where("id IS NOT NULL").join(keepers, F.col("id") == F.col("_keeper"), "left_semi")
    return kept.withColumn("place", place).where("place = 1").select("row.*").unionAll(
        rows.where("id IS NULL").select("row.*"))
