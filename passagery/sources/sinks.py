"""Chunk and index storage: partitioned Parquet, rewritten only where touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passagery.session import materialize

PARTITIONS = ["tenant_id", "kb_id"]


def write_chunks(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append chunks, one folder per (tenant, knowledge base).

    Rows are rebalanced by folder: small folders get one file, and a dominant knowledge base is split over as many
    writers as its size asks for.
    """
    df.hint("rebalance", *PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_chunks(spark: SparkSession, path: str, tenant_id: int | None = None, kb_ids: list[int] | None = None):
    """Scan with partition pruning on tenant and knowledge base."""
    df = spark.read.parquet(path)
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if kb_ids is not None:
        df = df.filter(F.col("kb_id").isin(kb_ids))
    return df


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that stay; a predicate that is null for a row does not delete it."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def delete_document(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Cascade: the same id set removed from chunks, versions and documents."""
    return {name: delete_ids(df, ids, key) for name, df in tables.items()}


def overwrite_partitions(df: DataFrame, path: str) -> None:
    """Replace exactly the (tenant, knowledge base) folders that `df` has rows for."""
    df.hint("rebalance", *PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_kb(spark: SparkSession, path: str, tenant_id: int, kb_id: int) -> None:
    """Drop the folder of one knowledge base; no other is read."""
    drop_folder(spark, f"{path}/tenant_id={tenant_id}/kb_id={kb_id}")


def _rewrite(spark: SparkSession, path: str, gone: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrite exactly the folders that hold rows of `gone` with the rows that `keep` leaves, and drop those left empty.

    The rows that stay are written aside first, as a folder cannot be read while it is replaced.
    """
    touched = gone.select(*PARTITIONS).distinct().collect()  # one row per knowledge base
    if not touched:
        return
    stored = spark.read.parquet(path)
    kinds = ", ".join(f"{c} {dict(stored.dtypes)[c]}" for c in PARTITIONS)
    folders = spark.createDataFrame([tuple(r) for r in touched], kinds)
    left = materialize(keep(stored.join(folders, PARTITIONS, "left_semi")).select(*stored.columns), "kept")
    full = {tuple(r) for r in left.select(*PARTITIONS).distinct().collect()}
    overwrite_partitions(left, path)
    for tenant_id, kb_id in {tuple(r) for r in touched} - full:
        clear_kb(spark, path, tenant_id, kb_id)


def delete_stored(spark: SparkSession, path: str, predicate: Column) -> None:
    """Delete the stored rows for which the predicate holds."""
    _rewrite(spark, path, spark.read.parquet(path).filter(predicate), lambda df: delete_where(df, predicate))


def delete_stored_ids(spark: SparkSession, path: str, ids: DataFrame, key: str) -> None:
    """Delete the stored rows whose key is among `ids`."""
    gone = spark.read.parquet(path).join(ids.select(key), key, "left_semi")
    _rewrite(spark, path, gone, lambda df: delete_ids(df, ids, key))
