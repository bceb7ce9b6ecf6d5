"""Exact and cluster-probed vector top-k.

A task multiplies a block of corpus vectors with a block of query vectors and keeps only the best k per query,
so no pair ever leaves a task unless it is among that task's best. A query set of checked size is broadcast and
the corpus is not shuffled at all. A larger query set is broadcast in a few slices of that size, each met by a scan of
the corpus; one of more slices meets the corpus block by block in a grid of bounded cells.

Scores are rounded to `DIGITS` before ranking and ties go to the lower id: copies of one text score the same
on every partitioning of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from passagery import constants as K
from passagery.functions.vectors import cosine
from passagery.operators.topk import BLOCK_BYTES, COMPACT_ROWS, STRIP, BestK, merged, to_numpy
from passagery.session import materialize, scratch_path

DIGITS = 9
SCALE = 10**DIGITS
CELL_ROWS, MOST_CELL_ROWS, MANY_CELLS = 1 << 14, 1 << 16, 256
BLOCK_QUERIES, BLOCK_VECTORS = 256, 4096
#: queries are sent in slices if these hold so many rows at least and are not more than this
LEAST_SLICE, MOST_SLICES = 1 << 14, 16
#: as many queries make it worth while to look for equal vectors; they are folded if this share is left at most
FOLD_QUERIES, FOLD_SHARE = 1 << 16, 0.8


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision; a vector of another length or without norm becomes zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    fits = lengths == dim
    out = np.zeros((len(column), dim))
    if fits.any():
        kept = column.filter(pa.array(fits))
        out[fits] = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


class _Best:
    """Best rows per query of one task.

    Blocks are multiplied in single precision. What may reach the k-th best score known of its query, allowing for the
    greatest error of that product, is scored again in double precision, so the result is that of double precision.
    What scores less than `least` may be left out.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool, least: float = -np.inf) -> None:
        self.query_ids, self.queries, self.best, self.most = query_ids, queries, BestK(k), 0
        self.slack = np.float32((queries.shape[1] + 8) * 2.0**-22 + 4.0 / SCALE)
        self.rough, self.floor = queries.astype(np.float32), np.full(len(queries), least - 2 * self.slack, np.float32)
        self.position = {q: i for i, q in enumerate(query_ids.tolist())} if skip_self else None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rough = vectors.astype(np.float32)
        own = None if self.position is None else np.array([self.position.get(c, -1) for c in ids.tolist()])
        for start in range(0, len(self.queries), BLOCK_QUERIES):
            for left in range(0, len(ids), BLOCK_VECTORS):
                columns = slice(left, left + BLOCK_VECTORS)
                self._block(start, left, ids, vectors, rough[columns], None if own is None else own[columns])

    def _block(self, start: int, left: int, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, own: np.ndarray | None) -> None:
        held = slice(start, start + BLOCK_QUERIES)
        score = self.rough[held] @ rough.T
        if own is not None:
            here = np.flatnonzero((own >= start) & (own < start + len(score)))
            score[own[here] - start, here] = -np.inf
        k, floor = self.best.k, self.floor[held]
        # few queries find more in a block once their floors are known, and only these are looked at
        hit = np.flatnonzero(score.max(axis=1) >= floor)
        if len(hit) < len(score):
            score, floor = score[hit], floor[hit]
        near = score >= floor[:, None]
        if np.count_nonzero(near) > 2 * k * len(score) and score.shape[1] > k:
            strips = score.shape[1] // STRIP
            tops = score[:, : strips * STRIP].reshape(len(score), STRIP, strips).max(axis=1) if strips > k else score
            floor = np.maximum(floor, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 2 * self.slack)
            near = score >= floor[:, None]
            self.floor[start + hit] = floor
        flat = np.flatnonzero(near)
        rows, columns = np.divmod(flat[score.ravel()[flat] > -np.inf], score.shape[1])
        for at in range(0, len(rows), COMPACT_ROWS):
            x, y = hit[rows[at : at + COMPACT_ROWS]] + start, columns[at : at + COMPACT_ROWS] + left
            exact = np.einsum("ij,ij->i", self.queries[x], vectors[y])
            self.best.parts.append((x, np.rint(exact * SCALE).astype(np.int64), ids[y]))
            self.best.rows += len(x)
            if self.best.rows > self.most:
                self._settle()

    def _settle(self) -> None:
        """Cut to the best k of each query; the last of k is the floor from now on."""
        self.best.compact()
        rows, score, _ = self.best.parts[0]
        full = np.flatnonzero(np.bincount(rows, minlength=len(self.floor)) >= self.best.k)
        last = np.searchsorted(rows, full, side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], (score[last] / SCALE).astype(np.float32) - 2 * self.slack)
        self.most = min(2 * self.best.rows + COMPACT_ROWS // 64, COMPACT_ROWS + self.best.rows)

    def table(self, schema: pa.Schema) -> pa.RecordBatch:
        found = self.best.result()
        if found is None:
            return pa.RecordBatch.from_pylist([], schema=schema)
        rows, score, ids = found
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[rows], schema.field(0).type),
                pa.array(ids, schema.field(1).type),
                pa.array(score / SCALE, pa.float64()),
            ],
            schema=schema,
        )


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]


def _schemas(queries: DataFrame, chunks: DataFrame, query_id: str, id_col: str) -> tuple[T.StructType, pa.Schema]:
    q, c = queries.schema[query_id].dataType, chunks.schema[id_col].dataType
    spark_schema = T.StructType([
        T.StructField(query_id, q), T.StructField(id_col, c), T.StructField("cosine", T.DoubleType()),
    ])
    return spark_schema, pa.schema([(query_id, _arrow(q)), (id_col, _arrow(c)), ("cosine", pa.float64())])


def _final(partial: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    return merged(partial, [query_id], "cosine", id_col, k).withColumn("score", (F.col("cosine") + 1.0) / 2.0)


def _cell_topk(cells_q: DataFrame, cells_c: DataFrame, keys: list[str], schemas, dim: int, k: int, skip_self: bool):
    """Meet query and corpus blocks of equal cell keys; both sides of a cell are bounded by construction."""
    spark_schema, arrow_schema = schemas
    width = len(keys)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow_schema.empty_table()
        best = _Best(to_numpy(left.column(width)), _matrix(left.column(width + 1), dim), k, skip_self)
        best.add(to_numpy(right.column(width)), _matrix(right.column(width + 1), dim))
        return pa.Table.from_batches([best.table(arrow_schema)])

    return cells_q.groupBy(*keys).cogroup(cells_c.groupBy(*keys)).applyInArrow(meet, spark_schema)


def _spread(df: DataFrame, id_col: str, own: str, own_n, other: str, other_n) -> DataFrame:
    """Give each row its own block number and repeat it for every block of the other side."""
    slot = F.pmod(F.xxhash64(F.col(id_col)), own_n).cast("int")
    others = F.explode(F.sequence(F.lit(0), (other_n - 1).cast("int")))
    return df.withColumn(own, slot).withColumn(other, others)


def vector_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = K.SEARCH_K,
    where=None,
    query_id: str = "query_id",
    id_col: str = "chunk_id",
    skip_self: bool = False,
    broadcast_bytes: int = BLOCK_BYTES,
    cell_rows: int = CELL_ROWS,
    least: float | None = None,
) -> DataFrame:
    """Exact top-k by cosine: rows (query_id, chunk_id, cosine, rank, score). The filter applies before ranking.

    Queries up to `broadcast_bytes` are sent to all tasks, more of them in up to `MOST_SLICES` slices of that size with a scan
    of the corpus for each. Beyond that they meet the corpus in cells of `cell_rows` rows of each side, or up to
    `MOST_CELL_ROWS` where `MANY_CELLS` remain, as every row is sent once for each block of the other side. With `least`,
    rows of a lower score may be left out. Equal vectors, where there are many, are searched once.

    Each length of query vectors, as of different models, is searched on its own; a corpus vector of another length has
    cosine 0 there, whatever the order of the rows.
    """
    k = k if k > 0 else K.SEARCH_K
    if where is not None:
        chunks = chunks.filter(where)
    q = queries.select(query_id, "embedding").filter(F.size("embedding") > 0)
    c = chunks.select(id_col, "embedding").filter(F.col("embedding").isNotNull())
    schemas = _schemas(queries, chunks, query_id, id_col)
    # as many rows as there are lengths
    kinds = q.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("embedding"), 0.02).alias("unlike")).collect()
    if not kinds:
        return _final(q.sparkSession.createDataFrame([], schemas[0]), query_id, id_col, k)
    n_q, unlike = sum(row["n"] for row in kinds), sum(row["unlike"] for row in kinds)
    copies_q = copies_c = None
    if n_q >= FOLD_QUERIES and not skip_self:
        if unlike <= FOLD_SHARE * n_q:
            q, copies_q = _folded(q, query_id)
        n_c, unlike = c.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("embedding"), 0.02)).first()
        if unlike <= FOLD_SHARE * n_c:
            c, copies_c = _folded(c, id_col, k)
    parts = []
    for dim in sorted(row["dim"] for row in kinds):
        fits = F.size("embedding") == dim
        parts.append(_best_of_length(q.filter(fits), c, dim, schemas, k, query_id, id_col, skip_self, broadcast_bytes, cell_rows, -np.inf if least is None else 2.0 * least - 1.0))
    found = reduce(DataFrame.unionAll, parts)
    if copies_c is not None:
        best = merged(found, [query_id], "cosine", id_col, k).withColumnRenamed(id_col, "alike")
        found = best.join(copies_c, "alike").select(query_id, id_col, "cosine")
    hits = _final(found, query_id, id_col, k)
    if copies_q is None:
        return hits
    return hits.withColumnRenamed(query_id, "alike").join(copies_q, "alike").select(query_id, *(name for name in hits.columns if name != query_id))


def _folded(df: DataFrame, id_col: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, embedding) with the lowest id of those of equal vectors, and rows (alike, id) that name the others by it:
    all, or the `most` lowest, of which the best `most` of a search come. The best of the folded rows hold the best of all,
    as no row is better than the lowest of its equals."""
    same = Window.partitionBy("embedding")
    rows = df.withColumn("alike", F.min(id_col).over(same))
    if most is not None:
        rows = df.withColumn("copy", F.row_number().over(same.orderBy(id_col))).filter(F.col("copy") <= most).withColumn("alike", F.min(id_col).over(same)).drop("copy")
    held = materialize(rows.withColumn("embedding", F.when(F.col("alike") == F.col(id_col), F.col("embedding"))), "folded")
    return held.filter(F.col("embedding").isNotNull()).select(id_col, "embedding"), held.select("alike", id_col)


def _best_of_length(q: DataFrame, c: DataFrame, dim: int, schemas, k: int, query_id: str, id_col: str, skip_self: bool, broadcast_bytes: int, cell_rows: int, least: float) -> DataFrame:
    """Each task's best rows per query, all vectors being of one length."""
    limit = max(broadcast_bytes // (8 * dim), 1)
    head = q.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return _scan(head, c, dim, schemas, k, skip_self, least)
    q = materialize(q, "asked")
    n_q = q.count()
    slices = -(-n_q // limit)
    if limit >= LEAST_SLICE and slices <= MOST_SLICES:
        slot = F.pmod(F.xxhash64(query_id), F.lit(slices))
        return reduce(DataFrame.unionAll, [_scan(q.filter(slot == i).toArrow(), c, dim, schemas, k, skip_self, least) for i in range(slices)])
    n_c = c.count()
    # a row is sent once for each block of the other side: larger cells as soon as there are enough of them
    while 2 * cell_rows <= MOST_CELL_ROWS and -(-n_q // (2 * cell_rows)) * -(-n_c // (2 * cell_rows)) >= MANY_CELLS:
        cell_rows *= 2
    grid_q, grid_c = F.lit(-(-n_q // cell_rows)), F.lit(max(-(-n_c // cell_rows), 1))
    cells_q = _spread(q, query_id, "cell_q", grid_q, "cell_c", grid_c).select("cell_q", "cell_c", query_id, "embedding")
    cells_c = _spread(c, id_col, "cell_c", grid_c, "cell_q", grid_q).select("cell_q", "cell_c", id_col, "embedding")
    return _cell_topk(cells_q, cells_c, ["cell_q", "cell_c"], schemas, dim, k, skip_self)


def _scan(asked: pa.Table, c: DataFrame, dim: int, schemas, k: int, skip_self: bool, least: float) -> DataFrame:
    """Each task's best rows for the broadcast queries (id, embedding)."""
    spark_schema, arrow_schema = schemas
    shared = c.sparkSession.sparkContext.broadcast((to_numpy(asked.column(0)), _matrix(asked.column(1), dim)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, k, skip_self, least)
        for batch in batches:
            if batch.num_rows:
                best.add(to_numpy(batch.column(0)), _matrix(batch.column(1), dim))
        yield best.table(arrow_schema)

    return c.mapInArrow(scan, spark_schema)


class ClusterIndex:
    """Corpus rows stored by the number of their nearest centre, and the centres (as many as asked for)."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, id_col: str) -> None:
        self.rows, self.centres, self.id_col = rows, centres, id_col


def build_cluster_index(
    chunks: DataFrame, n_clusters: int = 16, id_col: str = "chunk_id", seed: int = 7, max_iter: int = 8
) -> ClusterIndex:
    """Centres are fitted on all rows; every row is then assigned once and stored in the folder of its cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = chunks.filter(F.col("embedding").isNotNull()).withColumn("point", array_to_vector("embedding"))
    model = KMeans(featuresCol="point", predictionCol="cluster", k=n_clusters, seed=seed, maxIter=max_iter).fit(rows.select("point"))
    path = scratch_path(chunks.sparkSession, "clusters")
    assigned = model.transform(rows).drop("point")
    assigned.hint("rebalance", "cluster").write.partitionBy("cluster").parquet(path)
    stored = chunks.sparkSession.read.schema(assigned.schema).parquet(path)
    return ClusterIndex(stored, np.array(model.clusterCenters()), id_col)


def nearest_clusters(queries: DataFrame, centres: np.ndarray, n_probe: int) -> DataFrame:
    """One row per query and probed cluster."""
    take = min(n_probe, len(centres))
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def probes(vectors):
        import pandas as pd

        points = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
        c = shared.value
        distance = (c**2).sum(axis=1) - 2.0 * points @ c.T
        return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :take].astype(np.int32)))

    return queries.withColumn("cluster", F.explode(probes("embedding")))


def vector_search_ann(
    queries: DataFrame,
    index: ClusterIndex,
    k: int = K.SEARCH_K,
    n_probe: int = 4,
    query_id: str = "query_id",
    skip_self: bool = False,
    block_rows: int = CELL_ROWS,
) -> DataFrame:
    """Approximate top-k: exact within the `n_probe` nearest clusters of each query.

    Clusters above `block_rows` rows, and clusters probed by more queries than that, are met in several cells.
    """
    id_col = index.id_col
    q = nearest_clusters(queries.select(query_id, "embedding").filter(F.col("embedding").isNotNull()), index.centres, n_probe)
    probed = [row["cluster"] for row in q.select("cluster").distinct().collect()]  # at most one row per cluster
    c = index.rows.filter(F.col("cluster").isin(probed)).select(id_col, "embedding", "cluster")
    partial = _within(q, c, "cluster", index.centres.shape[1], _schemas(queries, index.rows, query_id, id_col), k, skip_self, block_rows)
    return _final(partial, query_id, id_col, k)


def _within(q: DataFrame, c: DataFrame, scope: str, dim: int, schemas, k: int, skip_self: bool, block_rows: int) -> DataFrame:
    """Best rows per query of the corpus rows of its own scope; each scope is cut into cells of bounded size."""
    query_id, id_col = schemas[1].names[:2]
    blocks = lambda df, name: df.groupBy(scope).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    plan = blocks(q, "blocks_q").join(blocks(c, "blocks_c"), scope)
    keys = [scope, "cell_q", "cell_c"]
    cells_q = _spread(q.join(plan, scope), query_id, "cell_q", F.col("blocks_q"), "cell_c", F.col("blocks_c"))
    cells_c = _spread(c.join(plan, scope), id_col, "cell_c", F.col("blocks_c"), "cell_q", F.col("blocks_q"))
    return _cell_topk(
        cells_q.select(*keys, query_id, "embedding"), cells_c.select(*keys, id_col, "embedding"), keys, schemas, dim, k, skip_self
    )


def scoped_vector_search(
    queries: DataFrame, chunks: DataFrame, scope: str, k: int = K.SEARCH_K, query_id: str = "query_id", id_col: str = "chunk_id",
    block_rows: int = CELL_ROWS, broadcast_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact top-k of every (query, scope) row of `queries` among the chunks of that scope, all scopes in one job.

    The queries are sent to the tasks with their scopes while they fit `broadcast_bytes`; a task multiplies the rows of
    each scope it holds with the queries of that scope only, so the corpus is not shuffled, and a scan stored by scope
    reads the folders asked for. A larger query set meets the corpus in cells of its scopes.
    """
    q = queries.select(query_id, scope, "embedding").filter(F.size("embedding") > 0)
    c = chunks.select(id_col, scope, "embedding").filter(F.col("embedding").isNotNull())
    pair = F.concat_ws("@", F.col(scope).cast("string"), F.col(query_id).cast("string"))
    asked = q.select(pair.alias("pair"), scope, "embedding")
    schemas = _schemas(asked, c, "pair", id_col)
    lengths = sorted(row["n"] for row in q.select(F.size("embedding").alias("n")).distinct().collect())
    parts = [q.sparkSession.createDataFrame([], schemas[0])]
    for dim in lengths:
        fits = asked.filter(F.size("embedding") == dim)
        limit = max(broadcast_bytes // (8 * dim), 1)
        head = fits.limit(limit + 1).toArrow()
        if head.num_rows <= limit:
            parts.append(_scan_scopes(head, c, scope, dim, schemas, k))
        else:
            parts.append(_within(fits, c, scope, dim, schemas, k, False, block_rows))
    hits = _final(reduce(DataFrame.unionAll, parts), "pair", id_col, k)
    return hits.join(q.select(pair.alias("pair"), query_id, scope), "pair").drop("pair")


def _scan_scopes(asked: pa.Table, c: DataFrame, scope: str, dim: int, schemas, k: int) -> DataFrame:
    """Each task's best rows for the queries (pair, scope, embedding), block by block against those of the same scope."""
    spark_schema, arrow_schema = schemas
    names, owners, vectors = to_numpy(asked.column(0)), asked.column(1).to_pylist(), _matrix(asked.column(2), dim)
    held: dict = {}
    for place, owner in enumerate(owners):
        held.setdefault(owner, []).append(place)
    scopes = list(held)
    shared = c.sparkSession.sparkContext.broadcast({owner: (names[at], vectors[at]) for owner, at in held.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, _Best] = {}
        for batch in batches:
            owner = batch.column(1)
            for value in pc.unique(owner).to_pylist():
                if value not in shared.value:
                    continue
                mine = batch.filter(pc.equal(owner, pa.scalar(value, owner.type)))
                if value not in best:
                    best[value] = _Best(*shared.value[value], k, False)
                best[value].add(to_numpy(mine.column(0)), _matrix(mine.column(2), dim))
        for one in best.values():
            yield one.table(arrow_schema)

    return c.filter(F.col(scope).isin(scopes)).mapInArrow(scan, spark_schema)


def admit_uploads(temp_chunks: DataFrame, limit: int = K.TEMP_DOC_MAX) -> DataFrame:
    """Uploads (session_id, upload_no) in order of arrival, with `admitted` and the `reason` of a refusal.

    An upload is admitted, whole, while its session holds fewer than `limit` chunks.
    """
    sizes = temp_chunks.groupBy("session_id", "upload_no").agg(F.count(F.lit(1)).alias("n_chunks"))
    before = Window.partitionBy("session_id").orderBy("upload_no").rowsBetween(Window.unboundedPreceding, -1)
    admitted = F.coalesce(F.sum("n_chunks").over(before), F.lit(0)) < limit
    return sizes.withColumn("admitted", admitted).withColumn(
        "reason", F.when(~F.col("admitted"), F.lit(f"limit of {limit} reached"))
    )


def temp_recall(
    queries: DataFrame, temp_chunks: DataFrame, k: int = K.TEMP_K, id_col: str = "chunk_id", limit: int = K.TEMP_DOC_MAX
) -> DataFrame:
    """Best own-session chunks per query, of all chunks of the admitted uploads."""
    admitted = admit_uploads(temp_chunks, limit).filter("admitted").select("session_id", "upload_no")
    pool = temp_chunks.join(admitted, ["session_id", "upload_no"], "left_semi").select(
        "session_id", id_col, F.col("embedding").alias("chunk_vector")
    )
    scored = queries.select("query_id", "session_id", "embedding").join(pool, "session_id").select(
        "query_id", "session_id", id_col,
        F.round(cosine(F.col("embedding"), F.col("chunk_vector")), DIGITS).alias("cosine"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
