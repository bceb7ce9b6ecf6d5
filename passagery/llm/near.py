"""Near duplicates by the exact similarity of their word shingles.

Texts with the same set of shingles are one class. Each class gets a SimHash fingerprint of its set, and classes whose
fingerprints are in range by the pivot distance table of `simhash` may be similar. As texts at the bound mostly differ
in more bits than any lossless key of a fingerprint allows, each class also gets `BANDS` keys of `ROWS` least hashes;
classes that share a key may be similar as well. Whichever found them, classes are linked if the Jaccard similarity of
their sets, counted exactly, reaches the bound. Two texts at similarity 0.8 share a key with probability 0.9993, closer ones more surely. Before sets are read, sizes
must fit and the sketches (a byte of each of the least hashes) must agree in all but 4.5 standard deviations; a pair at
0.8 fails that once in some 300 thousand cases.

A key or fingerprint of at most `max_group` classes makes their pairs. Larger ones, and what fingerprints link over
midpoints, are joined to families by the classes they share, and a family is compared whole, in cells of two blocks of bounded size: a task walks from class to class over those not
reached yet, so a family of close copies costs one comparison a member, and only links that join something leave the
task. No pair of a family is left out, whatever its size, and the number of stages does not depend on the data but for
the few rounds in which components settle.

Shingles are lower-cased in ASCII; a text of fewer words has one shingle of all, a text without words the empty set,
and all such texts are alike. Null texts are empty, very long ones are hashed in chunks. Rows repeated, and texts that
tie, are of one class; the component is named by its smallest doc_id. A null doc_id never names a component; the
component of rows without any doc_id is null. Only doc_id and text are read, so that no further column can clash. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import components
from .simhash import BITS, close

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED, CHUNK = 24, 6, 42, 1 << 12
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22


def shingles(text: str, width: int):
    """Sorted distinct hashes of the shingles of a text."""
    import xxhash

    tokens = text.encode().lower().split()
    count = max(1, len(tokens) - width + 1) if tokens else 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[len(ends) - count:].tolist())), np.uint64, count))


def fingerprint(held: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes, as a signed long; that of the empty set is zero."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(held), CHUNK):
        counts += np.unpackbits(held[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(held), bitorder="little").view("<i8")[0])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, a hash of the text, `node`, which stands for the set of shingles, and its size, fingerprint, sketch and keys
    of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        draw = np.random.default_rng(SEED)
        factors, shifts = (draw.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
        factors |= np.uint64(1)
        for batch in batches:
            nodes, sizes, prints, sketches, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                held = shingles(text, width)
                least = np.full(BANDS * ROWS, ~np.uint64(0))
                for i in range(0, len(held), CHUNK):
                    np.minimum(least, ((held[i:i + CHUNK] ^ shifts) * factors).min(axis=1), out=least)
                nodes.append(xxhash.xxh64_intdigest(held.tobytes(), SEED))
                sizes.append(len(held))
                prints.append(fingerprint(held))
                sketches.append(least.astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))])
            flat = pa.array(np.array(keys, np.uint64).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(nodes) + 1, BANDS), pa.int32()), flat)
            yield pa.record_batch([batch.column("doc_id"), batch.column("t"), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                                   pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()), lists],
                                  names=["doc_id", "t", "node", "size", "fp", "sketch", "keys"])

    return hashed(docs).mapInArrow(run, "doc_id long, t long, node long, size long, fp long, sketch binary, keys array<long>")


def hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, held): the sorted shingles of the texts in `wanted`, which is (t, node)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            held = [shingles(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(held, pa.list_(pa.int64()))], names=["node", "held"])

    asked = hashed(docs).select("t", "text").join(wanted, "t")
    return asked.groupBy("t", "node").agg(F.first("text").alias("text")).select("node", "text").mapInArrow(run, "node long, held array<long>")


def agreeing(similarity: float) -> int:
    """Bytes of two sketches that agree at least where the sets are similar."""
    n = BANDS * ROWS
    return math.ceil(n * similarity - 4.5 * math.sqrt(n * similarity * (1 - similarity)))


def likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = (matrix(batch.column(name)) for name in ("sketch_a", "sketch_b"))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((a == b).sum(1) >= agreeing(similarity)))

    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def matrix(sketches) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), BANDS * ROWS)


def similar(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    side = lambda name: held.select(F.col("node").alias(name), F.col("held").alias(f"held_{name}"))
    both = F.size(F.array_intersect("held_a", "held_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        both / (F.size("held_a") + F.size("held_b") - both) >= similarity).select("a", "b")


def walk(sets: list[np.ndarray], likely: np.ndarray, split: int, similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the similar sets. `likely` is [place, place] among all of them, or with `split`
    [place before it, place from it on]."""
    def alike(x: int, y: int) -> bool:
        a, b = sorted((sets[x], sets[y]), key=len)
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        return both / (len(a) + len(b) - both) >= similarity

    left, out = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        queue = [start] if left[start] else []
        left[start] = False
        while queue:
            x = queue.pop()
            if not split:
                near = np.flatnonzero(likely[x] & left)
            elif x < split:
                near = split + np.flatnonzero(likely[x] & left[split:])
            else:
                near = np.flatnonzero(likely[:, x - split] & left[:split])
            for y in near.tolist():
                if alike(x, y):
                    left[y] = False
                    out.append((x, y))
                    queue.append(y)
    return out


def within(families: DataFrame, classes: DataFrame, held: DataFrame, similarity: float, block: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the classes of each family, which is (node, root)."""
    members = families.join(classes.select("node", "size", "sketch"), "node")
    plan = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    full = scratch.write(members.join(plan, "root").join(held, "node").where("size > 0").withColumn(
        "own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select("root", "own", "blocks", "node", "sketch", "held"), "members")
    cell = ["root", "i", "j"]
    left = full.select("root", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "node", "sketch", "held")
    right = full.where("own > 0").select(
        F.col("root").alias("root"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"),
        *[F.col(c).alias(c) for c in ("node", "sketch", "held")])

    def meet(left, right):
        import pyarrow as pa

        if not left.num_rows or (left["i"][0] != left["j"][0] and not right.num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sides = [left] if left["i"][0] == left["j"][0] else [left, right]
        nodes = np.concatenate([t["node"].to_numpy() for t in sides])
        sets = [np.array(x, np.int64).view(np.uint64) for t in sides for x in t["held"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        sketches = np.concatenate([matrix(t["sketch"]) for t in sides])
        split = left.num_rows if len(sides) == 2 else 0
        rows, columns = slice(0, split or None), slice(split, None)
        likely = np.zeros((len(nodes[rows]), len(nodes[columns])), bool)
        for x in range(0, len(likely), 256):
            part = sketches[rows][x:x + 256]
            same = np.zeros((len(part), likely.shape[1]), np.uint8)
            for place in range(BANDS * ROWS):
                same += part[:, place, None] == sketches[columns][None, :, place]
            a, b = sizes[rows][x:x + 256, None], sizes[columns][None]
            likely[x:x + 256] = (same >= agreeing(similarity)) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
        links = np.array(walk(sets, likely, split, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[links[:, 0]], "b": nodes[links[:, 1]]})

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, "a long, b long")


def by_fingerprint(classes: DataFrame, max_group: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes whose fingerprints are in range, and links (a, b) that are to be compared as families. The
    empty set, which is one class, takes no part."""
    scratch = Scratch(classes.sparkSession, "prints")
    members = classes.where("size > 0").select("fp", "node")
    heads = scratch.write(members.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
    pairs, over = close(heads.select(F.col("head").alias("node"), "fp"), scratch, max_group)
    pairs = scratch.write(pairs.unionAll(heads.where(f"n BETWEEN 2 AND {max_group}").select(F.col("head").alias("a"), F.col("head").alias("b"))), "pairs")
    over = scratch.write(over, "over")
    scratch.drop("grouped")

    held = members.join(heads, "fp").select("head", "node", "n")
    side = lambda name: held.where(f"n <= {max_group}").select(F.col("head").alias(name), F.col("node").alias(f"node_{name}"))
    ends = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]
    met = pairs.join(side("a"), "a").join(side("b"), "b").select(*ends).where("a < b")

    many = heads.where(f"n > {max_group}").select("head")
    wide = over.unionAll(pairs.join(many.withColumnRenamed("head", "a"), "a", "left_semi")).unionAll(
        pairs.join(many.withColumnRenamed("head", "b"), "b", "left_semi"))
    whole = wide.select(F.explode(F.array("a", "b")).alias("head")).unionAll(many).distinct()
    shared = held.join(whole, "head", "left_semi").select(F.col("head").alias("a"), F.col("node").alias("b")).where("a <> b")
    return met, wide.unionAll(shared)


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, max_group: int = 64, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each input row; the component is named by its smallest doc_id."""
    scratch = Scratch(docs.sparkSession, "near")
    printed = scratch.write(signatures(docs, width), "printed")
    first = [F.first(c).alias(c) for c in ("size", "fp", "sketch", "keys")]
    classes = scratch.write(printed.groupBy("node").agg(F.min("t").alias("t"), F.min("doc_id").alias("doc_id"), *first), "classes")
    keyed = classes.select("node", F.explode("keys").alias("key"))
    sizes = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "sizes")
    grouped = scratch.write(keyed.join(sizes, "key"), "grouped")

    small = grouped.where(F.col("n") <= max_group)
    pairs = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    met, wide = by_fingerprint(classes, max_group)
    candidates = scratch.write(likely(pairs.unionAll(met).distinct(), classes, similarity), "candidates")
    crowded = grouped.where((F.col("n") > max_group) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    families = scratch.write(components(crowded.unionAll(wide).distinct(), scratch, "families"), "families")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node")).unionAll(families.select("node")).distinct()
    held = scratch.write(sets(docs, wanted.join(classes, "node").select("t", "node"), width), "held")
    links = scratch.write(similar(candidates, held, similarity).unionAll(within(families, classes, held, similarity, block, scratch)), "links")
    scratch.drop("held", "grouped", "sizes", "members", "candidates")

    roots = scratch.write(components(links, scratch), "roots")
    named = classes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = scratch.write(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    ids = scratch.write(named.join(least, "root").select("node", "component_id"), "ids")
    return printed.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")
