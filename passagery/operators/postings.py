"""An inverted index stored by term buckets, with block maxima, and exact top-k that leaves blocks out.

Chunks are inverted in shards of about `SHARD_ROWS` rows as they are read, without a shuffle: a chunk lies in one shard.
A posting's gain (its BM25 score without the term's weight) is cut into `LEVELS` impact levels. The postings of a term
at one level of a shard lie in blocks of at most `BLOCK_POSTINGS`, each with its greatest gain, so a term found in every
chunk is spread over as many rows as it needs. A posting is the place of its chunk in the shard (two bytes) and a count;
ids and lengths of chunks are held once a shard, in a folder of their own. Blocks, and a small table of (term, level)
figures, are stored in folders by a hash of the term, for which the blocks are shuffled once: a search reads the folders
of its own terms only.

A search first adds up the least gains of the best levels. The k-th partial score found there is a floor for the
result. Terms whose greatest gains together stay below the floor cannot lift a chunk into the result alone (they are
not essential), and a level of an essential term is left out where its own best and the best of all other terms stay
below it. What remains names the candidates, less those that even the best of all that was left out cannot lift to the
floor, or to the k-th best partial score of their shard; only they are scored in full. The result is that of a full scan. Blocks meet the terms of all queries shard by
shard, so a block is sent once, not once a query, and no pair of a query and a posting leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagery import constants as K
from passagery.operators.keyword import DIGITS, SCOPE, Bm25Index, idf, query_terms, scope_stats
from passagery.operators.topk import merged, to_numpy
from passagery.session import materialize, scratch_path

BUCKETS, LEVELS, BLOCK_POSTINGS = 64, 32, 128
SHARD_ROWS, CELL_TERMS = 1 << 14, 1 << 18
SEED_FACTOR = 4
#: bits of a place in a shard, which holds less than twice `SHARD_ROWS`; the folder of ids and lengths
PLACE_BITS, NAMES = 15, -1
#: scores are ranked by `DIGITS` digits, so what is below the floor by less than one unit may tie with it
SLACK = 10.0**-DIGITS + 1e-9


@dataclass
class PostingsIndex:
    """`stored`: (bucket, shard, scope, term, level, best, places, tfs, names), of which a row without a term, in the folder
    `NAMES`, holds the ids and the lengths (as tfs) of the chunks of a shard; `levels`: (bucket, scope, term, level, n, best);
    `shards`: (shard); `stats`: (scope, n, avg_dl). The gains hold for `k1` and `b`."""

    stored: DataFrame
    levels: DataFrame
    shards: DataFrame
    stats: DataFrame
    buckets: int
    id_col: str
    k1: float
    b: float

    @property
    def blocks(self) -> DataFrame:
        """The postings; `ids` are numbers of chunks, made of shard and place."""
        numbers = F.transform("places", lambda place: F.shiftleft("shard", PLACE_BITS) + place)
        return self.stored.filter(F.col("bucket") != NAMES).drop("names").withColumn("ids", numbers)

    @property
    def names(self) -> DataFrame:
        return self.stored.filter(F.col("bucket") == NAMES).select("shard", "tfs", "names")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def gain(tf: Column, dl: Column, avg_dl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avg_dl))


def build_postings(
    index: Bm25Index, path: str | None = None, buckets: int = BUCKETS, block: int = BLOCK_POSTINGS, k1: float = K.BM25_K1, b: float = K.BM25_B,
) -> PostingsIndex:
    """Invert a forward index and store it below `path`."""
    spark = index.forward.sparkSession
    path = path or scratch_path(spark, "postings")
    scope_stats(index).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    figures = stats.select(SCOPE, "avg_dl")
    forward = index.forward.select(SCOPE, F.col(index.id_col).alias("id"), "dl", "terms", "tfs").join(F.broadcast(figures) if _few(stats) else figures, SCOPE)
    bucket = F.when(F.col("term").isNull(), NAMES).otherwise(bucket_of(F.col("term"), buckets))
    rows = _inverted(forward, block, k1, b).withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("term", "level")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/blocks").filter(F.col("bucket") != NAMES)
    levels = stored.groupBy("bucket", SCOPE, "term", "level").agg(F.sum(F.size("places")).alias("n"), F.max("best").cast("double").alias("best"))
    levels.hint("rebalance", "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/levels")
    stored.select("shard").distinct().write.mode("overwrite").parquet(f"{path}/shards")
    return load_postings(spark, path, buckets, index.id_col, k1, b)


def _inverted(forward: DataFrame, block: int, k1: float, b: float) -> DataFrame:
    """Blocks of the rows (scope, id, dl, terms, tfs, avg_dl), inverted in shards of about `SHARD_ROWS` as they come."""
    kind = {f.name: f.dataType for f in forward.schema}
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField(SCOPE, kind[SCOPE]), T.StructField("term", T.StringType()),
        T.StructField("level", T.IntegerType()), T.StructField("best", T.FloatType()), T.StructField("places", T.ArrayType(T.ShortType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("names", T.ArrayType(kind["id"])),
    ])
    arrow_schema = to_arrow_schema(schema)

    def invert(rows: pa.Table, shard: int) -> pa.RecordBatch:
        scopes = rows.column(SCOPE).combine_chunks().dictionary_encode()
        terms, tfs = (rows.column(name).combine_chunks() for name in ("terms", "tfs"))
        lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(rows.num_rows), lengths)
        words = terms.flatten().dictionary_encode()
        word, tf = words.indices.to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        dl = to_numpy(rows.column("dl"))
        value = gain(tf, dl[place].astype(np.float64), to_numpy(rows.column("avg_dl"))[place], k1, b)
        level = np.minimum(np.floor(value / (k1 + 1.0) * LEVELS), LEVELS - 1).astype(np.int32)
        scope = scopes.indices.to_numpy(zero_copy_only=False)[place]
        order = np.lexsort((place, level, word, scope))
        place, word, level, scope, value = place[order], word[order], level[order], scope[order], value[order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (word[1:] != word[:-1]) | (level[1:] != level[:-1]) | (scope[1:] != scope[:-1])
        run = np.flatnonzero(first)
        first |= (np.arange(len(order)) - run[np.cumsum(first) - 1]) % block == 0
        start = np.flatnonzero(first)
        offsets = pa.array(np.append(start, len(order)).astype(np.int32))
        best = np.nextafter(np.maximum.reduceat(value, start).astype(np.float32), np.float32(np.inf))
        columns = [
            pa.array(np.full(len(start), shard, dtype=np.int64)), scopes.dictionary.take(pa.array(scope[start])), words.dictionary.take(pa.array(word[start])),
            pa.array(level[start]), pa.array(best), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int16))),
            pa.ListArray.from_arrays(offsets, pa.array(tf[order].astype(np.int32))), pa.nulls(len(start), arrow_schema.field("names").type),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    def named(rows: pa.Table, shard: int) -> pa.RecordBatch:
        whole = lambda column, kind: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), column.combine_chunks().cast(kind))
        known = {"shard": pa.array([shard]), "tfs": whole(rows.column("dl"), pa.int32()), "names": whole(rows.column("id"), arrow_schema.field("names").type.value_type)}
        return pa.RecordBatch.from_arrays([known[f.name].cast(f.type) if f.name in known else pa.nulls(1, f.type) for f in arrow_schema], schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, shard = [], 0, TaskContext.get().partitionId() << 20
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(start, SHARD_ROWS))
                rows += held[-1].num_rows
                if rows >= SHARD_ROWS:
                    yield from whole(held, shard)
                    held, rows, shard = [], 0, shard + 1
        if held:
            yield from whole(held, shard)

    def whole(held: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        if pc.sum(pc.list_value_length(rows.column("terms"))).as_py():
            yield invert(rows, shard)
            yield named(rows, shard)

    return forward.mapInArrow(run, schema)


def load_postings(spark: SparkSession, path: str, buckets: int = BUCKETS, id_col: str = "chunk_id", k1: float = K.BM25_K1, b: float = K.BM25_B) -> PostingsIndex:
    return PostingsIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "levels", "shards", "stats")), buckets, id_col, k1, b)


def _few(stats: DataFrame, most: int = 100_000) -> bool:
    """Whether there are few enough scopes to send their figures to the tasks."""
    return stats.count() <= most


def postings_search(queries: DataFrame, index: PostingsIndex, k: int = K.SEARCH_K, query_id: str = "query_id") -> DataFrame:
    """Top-k per query and scope: rows (query_id, scope, chunk_id, score, rank), as `bm25_search` gives them.

    A `scope` column of the queries restricts each to one scope. Queries without a known term have no rows.
    """
    k = k if k > 0 else K.SEARCH_K
    asked = materialize(query_terms(queries, query_id).withColumn("bucket", bucket_of(F.col("term"), index.buckets)), "asked_terms")
    wanted = [row["bucket"] for row in asked.select("bucket").distinct().collect()]  # at most one row per bucket
    mine = F.col("bucket").isin(wanted)
    slot = [query_id, SCOPE]
    keys = ["term", SCOPE] if SCOPE in queries.columns else ["term"]

    levels = index.levels.filter(mine).drop("bucket").join(asked.drop("bucket"), keys)
    of_term = Window.partitionBy(*slot, "term")
    rows = levels.join(index.stats.withColumnRenamed("n", "n_chunks"), SCOPE).withColumn("df", F.sum("n").over(of_term))
    weight = idf(F.col("n_chunks"), F.col("df")) * F.col("qtf")
    rows = rows.withColumn("weight", weight).withColumn("bound", F.col("weight") * F.col("best"))
    plan = materialize(rows.withColumn("most", F.max("bound").over(of_term)).select(*slot, "term", "level", "n", "avg_dl", "weight", "bound", "most"), "plan")

    # levels of greatest gain, until they hold a few times k postings
    by_bound = Window.partitionBy(*slot).orderBy(F.col("bound").desc(), "term", "level")
    before = F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = plan.withColumn("before", before).filter(F.col("before") < SEED_FACTOR * k)
    partial = _scored(index, seeds, mine, slot).groupBy(*slot, "id").agg(F.sum("part").alias("score"))
    kth = F.row_number().over(Window.partitionBy(*slot).orderBy(F.col("score").desc()))
    floor = partial.withColumn("place", kth).filter(F.col("place") == k).select(*slot, F.col("score").alias("floor"))

    terms = plan.groupBy(*slot, "term").agg(F.first("most").alias("most"))
    rising = Window.partitionBy(*slot).orderBy("most", "term")
    terms = terms.withColumn("up_to", F.sum("most").over(rising)).withColumn("all", F.sum("most").over(Window.partitionBy(*slot)))
    judged = plan.join(terms.drop("most"), [*slot, "term"]).join(floor, slot, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    keeps = (F.col("up_to") >= F.col("floor")) & (F.col("bound") + F.col("all") - F.col("most") >= F.col("floor"))
    # a term's blocks are read from the level `low` on; what lies below gives a chunk `cap` at most
    low = F.min(F.when(F.col("keep"), F.col("level")))
    judged = judged.withColumn("keep", keeps).groupBy(*slot, "term").agg(
        F.first("avg_dl").alias("avg_dl"), F.first("weight").alias("weight"), F.first("floor").alias("floor"), low.alias("low"),
        F.coalesce(F.max(F.when(~F.col("keep"), F.col("bound"))), F.lit(0.0)).alias("cap"))
    asking = materialize(judged.withColumn("rest", F.sum("cap").over(Window.partitionBy(*slot))), "asking")

    kinds = {query_id: queries.schema[query_id].dataType, SCOPE: index.stats.schema[SCOPE].dataType, "shard": T.LongType(), "place": T.ShortType()}
    fields = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    slices = F.lit(max(-(-asking.count() // CELL_TERMS), 1))
    every = F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    cell = ["shard", "slice"]
    asking = asking.withColumn("slice", F.pmod(F.xxhash64(*slot), slices).cast("int"))
    lists = index.stored.filter(mine).select("shard", SCOPE, "term", "level", "places", "tfs")
    with_names = lambda found, *more: found.select("*", every).unionByName(index.names.select("shard", "tfs", *more, every), allowMissingColumns=True).groupBy(*cell)
    lowest = asking.filter("low IS NOT NULL").groupBy(SCOPE, "term").agg(F.min("low").alias("low"))
    essential = lists.join(lowest, [SCOPE, "term"]).filter(F.col("level") >= F.col("low")).drop("low")
    sent = asking.crossJoin(index.shards).select(*cell, *slot, "term", "avg_dl", "weight", "low", "cap", "rest", "floor")
    named = with_names(essential).cogroup(sent.filter("low IS NOT NULL").groupBy(*cell))
    candidates = materialize(named.applyInArrow(_candidates(query_id, fields, k, index.k1, index.b), fields), "candidates")

    scored = T.StructType([*fields.fields[:-1], T.StructField("id", index.stored.schema["names"].dataType.elementType), T.StructField("score", T.DoubleType())])
    known = candidates.withColumn("slice", F.pmod(F.xxhash64(*slot), slices).cast("int"))
    wanted = sent.unionByName(known, allowMissingColumns=True).groupBy(*cell)
    asked_for = lists.join(asking.select(SCOPE, "term").distinct(), [SCOPE, "term"], "left_semi")
    full = with_names(asked_for, "names").cogroup(wanted).applyInArrow(_full(query_id, scored, index.k1, index.b), scored)
    return merged(full.select(*slot, F.col("id").alias(index.id_col), F.round("score", DIGITS).alias("score")), slot, "score", index.id_col, k)


class _Lists:
    """The postings of one shard, those of a term side by side, and the lengths of its chunks by place."""

    def __init__(self, blocks: pa.Table) -> None:
        whole = pc.is_null(blocks.column("term"))
        self.shard = blocks.column("shard")[0].as_py()
        self.chunks = blocks.filter(whole)
        self.dls = to_numpy(pc.list_flatten(self.chunks.column("tfs"))).astype(np.float64)
        blocks = blocks.filter(pc.invert(whole)).select([SCOPE, "term", "level", "places", "tfs"]).combine_chunks().sort_by([(SCOPE, "ascending"), ("term", "ascending")])
        lengths = to_numpy(pc.list_value_length(blocks.column("places")))
        ends = np.cumsum(lengths)
        self.places = to_numpy(pc.list_flatten(blocks.column("places")))
        self.tfs = to_numpy(pc.list_flatten(blocks.column("tfs"))).astype(np.float64)
        self.levels = np.repeat(to_numpy(blocks.column("level")), lengths)
        self.spans: dict = {}
        for key, a, z in zip(zip(blocks.column(SCOPE).to_pylist(), blocks.column("term").to_pylist()), ends - lengths, ends):
            self.spans[key] = (self.spans.get(key, (a, z))[0], z)

    def parts(self, scope, term, avg_dl: float, weight: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the chunks that have a term, its part of their scores and its levels there."""
        at = slice(*self.spans.get((scope, term), (0, 0)))
        places = self.places[at]
        return places, weight * gain(self.tfs[at], self.dls[places], avg_dl, k1, b), self.levels[at]


def _found(schema: pa.Schema, parts: list) -> pa.Table:
    """Rows of (query, scope, shard, ids, further columns)."""
    tables = [pa.Table.from_arrays([
        *(pa.array([value] * len(ids), f.type) for value, f in zip(head, schema)), *(pa.array(c).cast(f.type) for c, f in zip((ids, *more), list(schema)[len(head):]))
    ], schema=schema) for *head, ids, more in parts]
    return pa.concat_tables([schema.empty_table(), *tables])


def _candidates(query_id: str, schema: T.StructType, k: int, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Chunks of a shard that the essential levels name and that may reach the floor and the best k of the shard."""
    arrow_schema = to_arrow_schema(schema)

    def meet(blocks: pa.Table, asking: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asking.num_rows:
            return arrow_schema.empty_table()
        lists, out = _Lists(blocks), []
        for (query, scope), rows in asking.to_pandas().groupby([query_id, SCOPE], sort=False):
            sure, most = np.zeros(len(lists.dls)), np.full(len(lists.dls), rows["rest"].iloc[0])
            seen = np.zeros(len(lists.dls), dtype=bool)
            for row in rows.itertuples():
                places, part, levels = lists.parts(scope, row.term, row.avg_dl, row.weight, k1, b)
                met = levels >= row.low
                places, part = places[met], part[met]
                most[places] += part - row.cap
                sure[places] += part
                seen[places] = True
            floor, found = rows["floor"].iloc[0], np.flatnonzero(seen)
            if len(found) > k:
                floor = max(floor, np.partition(sure[found], len(found) - k)[len(found) - k] - SLACK)
            out.append((query, scope, lists.shard, found[most[found] >= floor - 1e-9], ()))
        return _found(arrow_schema, out)

    return meet


def _full(query_id: str, schema: T.StructType, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Whole scores of the candidates of a shard that reach the floor."""
    arrow_schema = to_arrow_schema(schema)

    def meet(blocks: pa.Table, asking: pa.Table) -> pa.Table:
        known = asking.filter(pc.is_valid(asking.column("place")))
        if not blocks.num_rows or not known.num_rows:
            return arrow_schema.empty_table()
        lists, out = _Lists(blocks), []
        names = lists.chunks.column("names").combine_chunks().flatten()
        wanted = {slot: rows["place"].to_numpy() for slot, rows in known.select([query_id, SCOPE, "place"]).to_pandas().groupby([query_id, SCOPE], sort=False)}
        terms = asking.filter(pc.is_null(asking.column("place"))).drop_columns(["place"]).to_pandas()
        for slot, rows in terms.groupby([query_id, SCOPE], sort=False):
            if slot not in wanted:
                continue
            score = np.zeros(len(lists.dls))
            for row in rows.itertuples():
                places, part, _ = lists.parts(slot[1], row.term, row.avg_dl, row.weight, k1, b)
                score[places] += part
            place = wanted[slot]
            place = place[score[place] >= rows["floor"].iloc[0] - 1e-9]
            out.append((*slot, lists.shard, names.take(pa.array(place)), (score[place],)))
        return _found(arrow_schema, out)

    return meet


def _scored(index: PostingsIndex, plan: DataFrame, mine: Column, slot: list[str]) -> DataFrame:
    """(slot, id, part) of the postings at the (term, level) pairs of the plan, each with the least part of its level; only
    their folders are read."""
    joined = index.blocks.filter(mine).select(SCOPE, "term", "level", "ids").join(plan.select(*slot, "term", "level", "weight"), [SCOPE, "term", "level"])
    part = F.col("weight") * F.col("level") * ((index.k1 + 1.0) / LEVELS)
    return joined.select(*slot, F.explode("ids").alias("id"), part.alias("part"))
