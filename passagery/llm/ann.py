"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Equal vectors are one entry that names its `k + 1` smallest ids, which is all that a result of `k` can need. Entries
are normalised, turned by a random rotation and dealt to lists by nearest centre; a query probes its nearest lists.
Within a list the rotated vectors stand in column blocks: after each block, a candidate whose partial distance is too
large for its dimensions (a hypothesis test at `EPSILON` deviations against the distance of the best so far) is
abandoned. Survivors are scored exactly, by cosine in double precision on the original vectors.

Centres are fitted on at most 64 entries a list, with half the square root of the number of entries as number
of lists (at most 4096); every entry is indexed. A query probes a share of the lists: the default of 0.7 is what
vectors without any clusters need for a recall above 0.9 in small tables too, clustered ones need far less. A list is cut into blocks, and the queries that probe it into slices, of bounded
size, so that a list of any share of the rows meets any number of queries in bounded tasks.

Vectors that are null, zero or hold null or non-finite components take no part; vectors of different length never
meet. Rows repeated under one id count once. An id with several vectors is searched by each of them. Fewer than `k`
candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagery.session import ship_package

from .common import Scratch

EPSILON, COLUMNS, ROWS = 2.1, 16, 1024
TRAIN_PER_LIST, MOST_LISTS = 64, 4096
BLOCK = 4096
KEYS = ["dim", "list", "block", "part"]


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rows of any scale as rotated unit vectors."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return unit.astype(np.float32) @ rotation(vectors.shape[1])


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant of each row."""
    return (centres**2).sum(1)[None] - 2 * x @ centres.T


def fit(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    draw = np.random.default_rng(len(x))
    centres = x[draw.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([nearest_centres(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres).astype(np.float32)
    return centres


def scan(query: np.ndarray, blocks: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the k nearest rows to a rotated query; `blocks` holds the rotated rows by blocks of columns."""
    n, dim = len(blocks[0]), sum(b.shape[1] for b in blocks)
    parts = np.split(query, np.cumsum([b.shape[1] for b in blocks])[:-1])
    best, best_at = np.empty(0, np.float32), np.empty(0, np.int64)
    for start in range(0, n, ROWS):
        alive = np.arange(start, min(n, start + ROWS))
        partial, done = np.zeros(len(alive), np.float32), 0
        bound = best[-1] if len(best) == k else np.inf
        for block, part in zip(blocks, parts):
            held = block[alive] if done else block[start:start + ROWS]
            partial = partial + ((held - part) ** 2).sum(1)
            done += len(part)
            if done < dim and bound < np.inf:
                stay = partial <= bound * (done / dim) * (1 + EPSILON / math.sqrt(done)) ** 2 + 1e-6
                alive, partial = alive[stay], partial[stay]
        best, best_at = np.concatenate([best, partial]), np.concatenate([best_at, alive])
        keep = np.argsort(best, kind="stable")[:k]
        best, best_at = best[keep], best_at[keep]
    return best_at


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows @ query / (np.sqrt((rows * rows).sum(1)) * math.sqrt(query @ query))


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(rep, vec, dim, ids): distinct vectors, the smallest id of each, and its k + 1 smallest."""
    order = Window.partitionBy("vec").orderBy("id")
    few = vectors.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")).select(
        "rep", "vec", F.size("vec").alias("dim"), "ids")


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec) in double precision of the rows that take part."""
    out = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where("id IS NOT NULL AND vec IS NOT NULL").where(finite & F.exists("vec", lambda x: x != 0.0))


@dataclass
class Centres:
    """Centres by dimension, and the number of ids in each list once the index is dealt."""

    by_dim: dict[int, np.ndarray]
    held: dict[tuple[int, int], int]


def train(index: DataFrame) -> Centres:
    """Fit the lists of each dimension on a bounded sample, chosen by a hash of the id."""
    by_dim = {}
    for row in index.groupBy("dim").count().collect():
        lists = min(MOST_LISTS, math.ceil(math.sqrt(row["count"]) / 2))
        taken = index.where(F.col("dim") == row["dim"]).select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(
            TRAIN_PER_LIST * lists).toPandas()
        by_dim[row["dim"]] = fit(rotated(np.stack(taken["vec"])), lists)
    return Centres(by_dim, {})


def deal(table: DataFrame, centres: Centres, share: float, least: int) -> DataFrame:
    """The rows with `list`: the nearest `share` of the lists, one at least, and as many as hold `least` ids together."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for dim, part in batch.groupby("dim"):
                own, parts = centres.by_dim.get(dim), []
                if own is None:
                    continue
                for i in range(0, len(part), 1024):
                    rows = part.iloc[i:i + 1024]
                    order = np.argsort(nearest_centres(rotated(np.stack(rows["vec"])), own), axis=1, kind="stable")
                    count = np.full(len(rows), max(1, math.ceil(share * len(own))))
                    if least:
                        sizes = np.array([centres.held.get((dim, j), 0) for j in range(len(own))])
                        count = np.maximum(count, np.minimum((np.cumsum(sizes[order], axis=1) < least).sum(1) + 1, len(own)))
                    parts.append(rows.assign(list=[o[:c].tolist() for o, c in zip(order, count)]))
                yield pd.concat(parts)

    from pyspark.sql import types as T

    schema = T.StructType([*table.schema.fields, T.StructField("list", T.ArrayType(T.LongType()))])
    return table.mapInPandas(run, schema).withColumn("list", F.explode("list"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of `vectors` found for each of `queries`, its own id left out.

    Both are (id, vec) as `usable` gives them.
    """
    spark = ship_package(vectors.sparkSession)
    scratch = Scratch(spark, "ann")
    index = scratch.write(entries(vectors, k), "entries")
    centres = train(index)
    dealt = scratch.write(deal(index, centres, 0.0, 0), "dealt")
    sizes = {(r["dim"], r["list"]): (r["n"], r["held"]) for r in dealt.groupBy("dim", "list").agg(
        F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect()}
    centres.held = {key: held for key, (_, held) in sizes.items()}

    query = F.concat_ws("-", F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit("second"), "vec")))
    asked = scratch.write(queries.distinct().select(
        F.col("id").alias("query_id"), "vec", F.size("vec").alias("dim"), query.alias("query")), "asked")
    points = asked.select("query", "vec", "dim").distinct()
    probing = scratch.write(deal(points, centres, share, k + 1), "probing")
    plan = probing.groupBy("dim", "list").agg(F.count("*").alias("n")).collect()
    cuts = spark.createDataFrame(
        [(r["dim"], r["list"], -(-sizes[r["dim"], r["list"]][0] // BLOCK), -(-r["n"] // BLOCK))
         for r in plan if (r["dim"], r["list"]) in sizes], "dim int, list long, blocks int, parts int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = dealt.join(F.broadcast(cuts), ["dim", "list"]).select(
        "dim", "list", "rep", "vec", "ids", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"),
        every("parts").alias("part"))
    probes_of = probing.join(F.broadcast(cuts), ["dim", "list"]).select(
        "dim", "list", "query", "vec", F.pmod(F.xxhash64("query"), "parts").cast("int").alias("part"), every("blocks").alias("block"))

    def meet(key, held, probing):
        import pandas as pd

        if not len(held) or not len(probing):
            return pd.DataFrame({"query": [], "ids": [], "score": []})
        original, own = np.stack(held["vec"]), np.stack(probing["vec"])
        turned = rotated(original)
        blocks = [np.ascontiguousarray(turned[:, i:i + COLUMNS]) for i in range(0, turned.shape[1], COLUMNS)]
        near = [scan(query, blocks, k + 1) for query in rotated(own)]
        scores = [cosine(vec, original[at]) for vec, at in zip(own, near)]
        return pd.DataFrame({"query": np.repeat(probing["query"].to_numpy(), [len(at) for at in near]),
                             "ids": held["ids"].to_numpy()[np.concatenate(near)], "score": np.concatenate(scores)})

    met = rows.groupBy(*KEYS).cogroup(probes_of.groupBy(*KEYS)).applyInPandas(
        meet, "query string, ids array<long>, score double")
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    found = scratch.write(met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select(
        "query", F.explode("ids").alias("vec_id"), "score").groupBy("query").agg(
        F.collect_list(F.struct("vec_id", "score")).alias("near")), "found")
    pairs = asked.join(found, "query").select("query_id", F.explode("near").alias("n")).select(
        "query_id", "n.*").where("query_id <> vec_id")
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
