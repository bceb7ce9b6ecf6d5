"""BM25 over a batch of queries.

The index keeps one row per chunk with its words, made row by row without a shuffle. Searching scans it twice: query terms
are counted, then a task scores its chunks against all of them and keeps the best k per query, so neither postings
nor (query, chunk) pairs are shuffled, and a term found in every chunk is no hot key. Query terms are broadcast
after their number has been checked; a larger query set is met slice by slice in a grid of bounded cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagery import constants as K
from passagery.functions import text as X
from passagery.operators.topk import BestK, merged, to_numpy
from passagery.session import materialize

SCOPE = "scope"
DIGITS = 6
SCALE = 10**DIGITS
MAX_BLOCK_ROWS = 1 << 16
BROADCAST_TERMS = 1_000_000
CELL_TERMS = 1 << 18
STEP_BYTES, LEAST_STEP = 1 << 20, 64
MOST_NEAR, PAIRS = 16, 1 << 15
COUNTED = 1 << 24
WORD = np.arange(256) >= 128
WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True


@dataclass
class Bm25Index:
    """`forward`: one row per chunk (scope, id, dl, terms, tfs, carried columns). `listed`, when there, is what it is counted
    from: (scope, id, carried columns, token_text), which searches read, as they count query terms only."""

    forward: DataFrame
    id_col: str = "chunk_id"
    listed: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """Rows (scope, id, token_text) as searches hand them to Python: all words of a chunk in one string."""
        if self.listed is not None:
            return self.listed.select(SCOPE, self.id_col, "token_text")
        repeated = F.flatten(F.zip_with("terms", "tfs", lambda term, tf: F.array_repeat(term, tf)))
        return self.forward.select(SCOPE, self.id_col, F.array_join(repeated, " ").alias("token_text"))

    def narrowed(self, cut: Callable[[DataFrame], DataFrame]) -> Bm25Index:
        return Bm25Index(cut(self.forward), self.id_col, None if self.listed is None else cut(self.listed))

    def settled(self) -> Bm25Index:
        """With the counted rows written, for what reads all of them more than once."""
        return self if self.listed is None else Bm25Index(materialize(self.forward, "bm25"), self.id_col, self.listed)

    @property
    def postings(self) -> DataFrame:
        pairs = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
        return self.forward.select(SCOPE, self.id_col, "dl", pairs).select(
            SCOPE, self.id_col, "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")
        )

    @property
    def terms(self) -> DataFrame:
        listed = self.forward.select(SCOPE, F.explode("terms").alias("term"))
        return listed.groupBy(SCOPE, "term").agg(F.count(F.lit(1)).alias("df"))

    @property
    def stats(self) -> DataFrame:
        return self.forward.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows of a `token_text`, one after another, and the number of words before each row and at the end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return pa.array([], pa.string()), np.zeros(1, dtype=np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.empty(0, dtype=np.uint8)
    places = places - places[0]
    inside = WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = places[1:] > places[:-1]
    heads, ends = places[:-1][filled], places[1:][filled] - 1
    first[heads], last[ends] = inside[heads], inside[ends]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.searchsorted(starts, places)


def _counted(listed: DataFrame) -> DataFrame:
    """`dl`, the sorted distinct `terms` and their counts `tfs` in place of `token_text`, a batch of rows at a time."""
    kept = [f for f in listed.schema.fields if f.name != "token_text"]
    whole = T.IntegerType()
    schema = T.StructType([*kept, T.StructField("dl", whole), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(whole))])
    arrow_schema = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, n = batch.column("token_text"), batch.num_rows
            none = texts.is_null()
            words, starts = _words(texts)
            lengths, words = np.diff(starts), words.dictionary_encode()
            order = pc.sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            key = np.repeat(np.arange(n, dtype=np.int64), lengths) * max(len(order), 1) + place[words.indices.to_numpy(zero_copy_only=False)]
            found, counts = np.unique(key, return_counts=True)
            row, term = np.divmod(found, max(len(order), 1))
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            listed_terms = pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(order[term])), mask=none)
            tfs = pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)), mask=none)
            dl = pa.array(lengths.astype(np.int32), mask=none.to_numpy(zero_copy_only=False))
            columns = [*(batch.column(f.name) for f in kept), dl, listed_terms, tfs]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    return listed.mapInArrow(count, schema)


def build_bm25_index(
    chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", scope: str | None = None,
    carry: list[str] | None = None, settle: bool = True,
) -> Bm25Index:
    """Statistics are kept per `scope` (one knowledge base is one collection); without it there is one scope.

    `carry` keeps columns for filtering. With `settle` the words are written once, as searching reads them twice.
    """
    scope_value = F.col(scope) if scope else F.lit(0)
    listed = chunks.select(scope_value.alias(SCOPE), id_col, *(carry or []), X.token_text(F.col(text_col)).alias("token_text"))
    if settle:
        listed = materialize(listed, "words")
    return Bm25Index(_counted(listed), id_col, listed)


def save_bm25_index(index: Bm25Index, path: str) -> None:
    """Store the index by scope, so that a search of a few knowledge bases reads only their folders."""
    index.forward.write.mode("overwrite").partitionBy(SCOPE).parquet(path)


def load_bm25_index(spark: SparkSession, path: str, id_col: str = "chunk_id") -> Bm25Index:
    return Bm25Index(spark.read.parquet(path), id_col)


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """Terms of each query with their number of occurrences; a `scope` column restricts a query to one scope."""
    keys = [query_id] + ([SCOPE] if SCOPE in queries.columns else [])
    return (
        queries.select(*keys, F.explode(X.tokens(F.col(text_col))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _figures(index: Bm25Index, vocabulary: pa.Array) -> DataFrame:
    """Rows (scope, term, df) of the broadcast terms alone, and for each scope a row without term (df: its chunks, dl: their
    words, held: those that have a text). A task sends one row for each term that it met."""
    shared = index.forward.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [T.StructField("term", T.StringType()), *(T.StructField(name, T.LongType()) for name in ("df", "dl", "held"))]
    schema = T.StructType([T.StructField(SCOPE, index.forward.schema[SCOPE].dataType), *fields])
    arrow_schema = to_arrow_schema(schema)

    def emit(counts: dict) -> Iterator[pa.RecordBatch]:
        for scope, (df, sums) in counts.items():
            met = np.flatnonzero(df)
            none = np.zeros(len(met), dtype=np.int64)
            terms = [*shared.value.take(pa.array(met)).to_pylist(), None]
            columns = [[scope] * len(terms), terms, np.append(df[met], sums[0]), np.append(none, sums[1]), np.append(none, sums[2])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        width = max(len(shared.value), 1)
        for batch in batches:
            scopes = batch.column(0).dictionary_encode(null_encoding="encode")
            of_row = scopes.indices.to_numpy(zero_copy_only=False)
            present = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            words, starts = _words(batch.column(1))
            lengths = np.diff(starts)
            codes = pc.index_in(words, value_set=shared.value)
            hit = codes.is_valid().to_numpy(zero_copy_only=False)
            key = np.sort(np.repeat(np.arange(len(lengths)), lengths)[hit] * width + codes.drop_null().to_numpy())
            row, code = np.divmod(key[np.diff(key, prepend=-1) > 0], width)
            for number, scope in enumerate(scopes.dictionary.to_pylist()):
                mine = of_row == number
                if scope not in counts:
                    counts[scope] = np.zeros(len(shared.value), dtype=np.int64), np.zeros(3, dtype=np.int64)
                df, sums = counts[scope]
                df += np.bincount(code[mine[row]], minlength=len(df))
                sums += mine.sum(), lengths[mine].sum(), present[mine].sum()
                if len(counts) * width > COUNTED:
                    yield from emit(counts)
                    counts = {}
        yield from emit(counts)

    found = index.rows.select(SCOPE, "token_text").mapInArrow(count, schema)
    return found.groupBy(SCOPE, "term").agg(*(F.sum(name).alias(name) for name in ("df", "dl", "held")))


def _stats(figures: DataFrame) -> DataFrame:
    return figures.filter(F.col("term").isNull()).select(SCOPE, F.col("df").alias("n"), F.try_divide("dl", "held").alias("avg_dl"))


def scope_stats(index: Bm25Index) -> DataFrame:
    """The same rows as `index.stats`, without the terms of chunks where only their words are stored."""
    return index.stats if index.listed is None else _stats(_figures(index, pa.array([], pa.string())))


def weighted_terms(queries: DataFrame, index: Bm25Index, query_id: str = "query_id", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Rows (query, scope, term, avg_dl, weight). Only terms that some query has are counted in the index."""
    wanted = materialize(query_terms(queries, query_id), "wanted")
    keys = [SCOPE, "term"] if SCOPE in queries.columns else ["term"]
    if wanted.count() <= broadcast_terms:
        vocabulary = pa.array(wanted.select("term").distinct().toArrow().column(0).to_pylist(), pa.string())
        figures = materialize(_figures(index, vocabulary), "figures")
        terms = figures.filter(F.col("term").isNotNull()).select(SCOPE, "term", "df")
        stats = _stats(figures)
    else:
        counted = index.settled()
        terms, stats = counted.terms, counted.stats
    used = terms.join(wanted.select(*keys).distinct(), keys, "left_semi")
    weights = used.join(stats, SCOPE).select(SCOPE, "term", "avg_dl", idf(F.col("n"), F.col("df")).alias("idf"))
    return wanted.join(weights, keys).select(
        query_id, SCOPE, "term", "avg_dl", (F.col("idf") * F.col("qtf")).alias("weight")
    )


class _ScopeTerms:
    """Query terms of one scope: for each term the queries that have it and their weights."""

    def __init__(self, terms: np.ndarray, slots: np.ndarray, weights: np.ndarray, avg_dl: float) -> None:
        vocabulary, codes = np.unique(terms, return_inverse=True)
        order = np.argsort(codes, kind="stable")
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.slots, self.weights, self.avg_dl, self.codes = slots[order], weights[order], avg_dl, codes[order]
        self.starts = np.searchsorted(self.codes, np.arange(len(vocabulary) + 1))
        self.by_slot = np.argsort(self.slots, kind="stable")
        self.slot_starts = np.searchsorted(self.slots[self.by_slot], np.arange(slots.max(initial=-1) + 2))


class _Essential:
    """Query terms without those that cannot lift a chunk into the result.

    `most` is the greatest gain of each term in a block. The terms of a query whose greatest gains together stay below its
    floor (`rest`) name no chunks; a chunk counts only if the other terms give it `least`.
    """

    def __init__(self, scope: _ScopeTerms, most: np.ndarray, floors: np.ndarray) -> None:
        bound = scope.weights * most[scope.codes]
        order = np.lexsort((bound, scope.slots))
        slot, up_to = scope.slots[order], np.cumsum(bound[order])
        before = scope.slot_starts[:-1][slot]
        up_to -= np.where(before > 0, up_to[before - 1], 0.0)
        free = up_to < floors[slot] - 3.0 / SCALE
        rest = np.zeros(len(floors))
        np.maximum.at(rest, slot[free], up_to[free])
        kept = np.sort(order[~free])
        self.slots, self.weights, self.whole = scope.slots[kept], scope.weights[kept], len(kept) == len(order)
        self.starts = np.searchsorted(scope.codes[kept], np.arange(len(scope.vocabulary) + 1))
        self.least = np.maximum(floors - rest - 3.0 / SCALE, np.finfo(float).tiny)


def _spans(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from `starts[i]` to before `starts[i + 1]` for each i of `which`, after the place of that i."""
    width = np.diff(starts)[which]
    owner = np.repeat(np.arange(len(which)), width)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + starts[which][owner]


def _dense_scores(terms: _ScopeTerms | _Essential, rows: np.ndarray, codes: np.ndarray, gain: np.ndarray, n: int, n_slots: int) -> np.ndarray:
    """Scores (query, chunk) of a few chunks from their matching postings."""
    posting, entry = _spans(terms.starts, codes)
    return np.bincount(terms.slots[entry] * n + rows[posting], terms.weights[entry] * gain[posting], minlength=n_slots * n).reshape(n_slots, n)


def _whole_scores(scope: _ScopeTerms, slots: np.ndarray, rows: np.ndarray, places: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Scores of single (query, chunk) pairs; `places` are the sorted numbers of (chunk, term) in the block."""
    pair, entry = _spans(scope.slot_starts, slots)
    entry = scope.by_slot[entry]
    key = rows[pair] * len(scope.vocabulary) + scope.codes[entry]
    at = np.minimum(np.searchsorted(places, key), len(places) - 1)
    hit = places[at] == key
    return np.bincount(pair[hit], scope.weights[entry[hit]] * gain[at[hit]], minlength=len(slots))


class _Terms:
    """Query terms of all scopes, ready for scoring; every (query, scope) is one slot."""

    def __init__(self, weighted: pa.Table) -> None:
        frame = weighted.to_pandas()
        frame.columns = ["query", SCOPE, "term", "avg_dl", "weight"]
        slots = frame[["query", SCOPE]].drop_duplicates().reset_index(drop=True)
        numbered = slots.reset_index().merge(frame, on=["query", SCOPE])
        self.queries, self.scope_of = slots["query"].to_numpy(), slots[SCOPE].to_numpy()
        self.scopes: dict = {}
        for value, part in numbered.groupby(SCOPE):
            numbers = np.unique(part["index"].to_numpy())
            local = np.searchsorted(numbers, part["index"].to_numpy())
            terms = _ScopeTerms(part["term"].to_numpy(), local, part["weight"].to_numpy(), float(part["avg_dl"].iloc[0]))
            self.scopes[value] = (terms, numbers)

    def score(self, block: pa.RecordBatch, best: BestK, k1: float, b: float) -> None:
        """Score chunks (scope, id, token_text); each scope present only against its own query terms."""
        owner = to_numpy(block.column(0))
        for value in np.unique(owner):
            if value not in self.scopes:
                continue
            terms, numbers = self.scopes[value]
            mine = block.filter(pa.array(owner == value))
            for start in range(0, mine.num_rows, MAX_BLOCK_ROWS):
                _score_block(mine.slice(start, MAX_BLOCK_ROWS), terms, numbers, best, k1, b)

    def result(self, best: BestK, schema: pa.Schema) -> pa.RecordBatch:
        found = best.result()
        if found is None:
            return pa.RecordBatch.from_pylist([], schema=schema)
        slots, score, ids = found
        columns = [self.queries[slots], self.scope_of[slots], ids, score / SCALE]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schemas(queries: DataFrame, index: Bm25Index, query_id: str) -> tuple[T.StructType, pa.Schema]:
    kinds = [(query_id, queries.schema[query_id].dataType), (SCOPE, index.forward.schema[SCOPE].dataType),
             (index.id_col, index.forward.schema[index.id_col].dataType), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    return schema, to_arrow_schema(schema)


def _scan(index: Bm25Index, weighted: pa.Table, k: int, k1: float, b: float, schemas) -> DataFrame:
    """Score every chunk against the broadcast query terms; each task emits at most k rows per query and scope."""
    spark_schema, arrow_schema = schemas
    forward = index.rows
    shared = forward.sparkSession.sparkContext.broadcast(_Terms(weighted))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        best = BestK(k, len(terms.queries))
        for batch in batches:
            if batch.num_rows:
                terms.score(batch, best, k1, b)
        yield terms.result(best, arrow_schema)

    return forward.mapInArrow(scan, spark_schema)


def _grid(index: Bm25Index, weighted: DataFrame, cell_terms: int, block_rows: int, k: int, k1: float, b: float, query_id: str, schemas) -> DataFrame:
    """The same for a query set too large to broadcast: slices of the queries of a scope meet blocks of its chunks in cells
    of bounded size, and each cell emits its best k rows per query. A chunk is sent once for each slice of its own scope."""
    spark_schema, arrow_schema = schemas
    count = lambda df, most, name: df.groupBy(SCOPE).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # one row per scope; written, so that its size is known before the chunks are joined to it
    plan = materialize(count(weighted, cell_terms, "slices").join(count(index.rows, block_rows, "blocks"), SCOPE), "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    asked = weighted.join(plan, SCOPE).withColumn("cell_q", slot(query_id, "slices")).withColumn("cell_c", every("blocks"))
    held = index.rows.join(plan, SCOPE).withColumn("cell_c", slot(index.id_col, "blocks")).withColumn("cell_q", every("slices"))
    cells = [SCOPE, "cell_q", "cell_c"]
    asked_columns, held_columns = [query_id, SCOPE, "term", "avg_dl", "weight"], [SCOPE, index.id_col, "token_text"]
    left = asked.select(*cells[1:], *asked_columns).groupBy(*cells)
    right = held.select(*cells[1:], *held_columns).groupBy(*cells)

    def meet(terms: pa.Table, chunks: pa.Table) -> pa.Table:
        if not terms.num_rows or not chunks.num_rows:
            return arrow_schema.empty_table()
        prepared = _Terms(terms.select(asked_columns))
        best = BestK(k, len(prepared.queries))
        for batch in chunks.select(held_columns).to_batches():
            prepared.score(batch, best, k1, b)
        return pa.Table.from_batches([prepared.result(best, arrow_schema)])

    return left.cogroup(right).applyInArrow(meet, spark_schema)


def _score_block(block: pa.RecordBatch, scope: _ScopeTerms, numbers: np.ndarray, best: BestK, k1: float, b: float) -> None:
    """Chunks are scored a few at a time, so that the scores of all queries stay in the cache of a core. Once a query has k
    rows, only its rare terms are added up for all chunks, and whole scores are made for the chunks that these name."""
    ids = to_numpy(block.column(1))
    order = np.argsort(ids, kind="stable")
    block, ids = block.take(pa.array(order)), ids[order]
    n, (words, starts) = block.num_rows, _words(block.column(2))
    codes = pc.index_in(words, value_set=scope.vocabulary)
    hit = codes.is_valid().to_numpy(zero_copy_only=False)
    places = np.repeat(np.arange(n), np.diff(starts))[hit] * len(scope.vocabulary) + codes.drop_null().to_numpy()
    found, counts = np.unique(places, return_counts=True)
    rows, codes = np.divmod(found, len(scope.vocabulary))
    tf, dl = counts.astype(np.float64), np.diff(starts).astype(np.float64)
    gain = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl[rows] / scope.avg_dl))
    most = np.zeros(len(scope.vocabulary))
    np.maximum.at(most, codes, gain)
    step, essential = max(LEAST_STEP, STEP_BYTES // (8 * len(numbers))), None
    for turn, first in enumerate(range(0, n, step)):
        size = min(step, n - first)
        mine = slice(*np.searchsorted(rows, (first, first + size)))
        if turn & (turn - 1) == 0:  # the floors rise fast at first
            essential = _Essential(scope, most, best.floors[numbers] / SCALE)
        score = _dense_scores(essential, rows[mine] - first, codes[mine], gain[mine], size, len(numbers))
        if not essential.whole:
            near = np.flatnonzero(score >= essential.least[:, None])
            if len(near) <= score.size // MOST_NEAR:
                for at in range(0, len(near), PAIRS):
                    slots, columns = np.divmod(near[at : at + PAIRS], size)
                    whole = _whole_scores(scope, slots, columns + first, found, gain)
                    best.add_pairs(numbers[slots], whole, ids[columns + first], SCALE)
                continue
            score = _dense_scores(scope, rows[mine] - first, codes[mine], gain[mine], size, len(numbers))
        best.add_above(numbers, score, ids[first : first + size], SCALE)


def bm25_search(
    queries: DataFrame,
    index: Bm25Index,
    k: int = K.SEARCH_K,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    where: Column | DataFrame | None = None,
    query_id: str = "query_id",
    broadcast_terms: int = BROADCAST_TERMS,
    block_rows: int = MAX_BLOCK_ROWS,
    cell_terms: int = CELL_TERMS,
) -> DataFrame:
    """Top-k per query (and scope): rows (query_id, scope, chunk_id, score, rank).

    Up to `broadcast_terms` query terms are sent to all tasks. More of them meet the chunks in cells of `cell_terms` terms and
    `block_rows` chunks, whatever the bound of the broadcast, as every chunk is sent once for each slice of the terms.

    `where` is a predicate over carried columns or a set of allowed chunk ids. It applies before ranking; the
    statistics stay those of the collection.
    """
    k = k if k > 0 else K.SEARCH_K
    weighted = materialize(weighted_terms(queries, index, query_id, broadcast_terms), "terms")
    searched = index
    if isinstance(where, DataFrame):
        searched = index.narrowed(lambda df: df.join(where.select(index.id_col), index.id_col, "left_semi"))
    elif where is not None:
        searched = index.narrowed(lambda df: df.filter(where))
    n_terms, schemas = weighted.count(), _schemas(queries, index, query_id)
    if n_terms <= broadcast_terms:
        scores = _scan(searched, weighted.toArrow(), k, k1, b, schemas)
    else:
        scores = _grid(searched, weighted, max(cell_terms, 1), block_rows, k, k1, b, query_id, schemas)
    return merged(scores, [query_id, SCOPE], "score", index.id_col, k)
