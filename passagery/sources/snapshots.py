"""Several stored tables that change together.

Every change writes new folders beside the old ones and then a small table that lists, for each table and knowledge
base, the folder that holds its rows. That list is the state: it counts once its job has committed (its success
marker is there), so readers and a job that died midway see all of a change or nothing of it. The list has a row for
each table and base and is the only thing that passes through the driver. One writer at a time; old folders stay
readable for those who began before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from passagery.sources.sinks import PARTITIONS, delete_ids, delete_where

FOLDERS = [f"in_{c}" for c in PARTITIONS]
LISTED = "table string, tenant_id bigint, kb_id bigint, folder string"
UNKNOWN = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the name of a folder for null


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed states, oldest first."""
    system, place = _files(spark, f"{root}/states")
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return sorted(int(n) for n in names if system.exists(_files(spark, f"{root}/states/{n}/_SUCCESS")[1]))


def _listed(spark: SparkSession, root: str, version: int | None) -> list[tuple]:
    known = versions(spark, root)
    number = known[-1] if version is None else version
    if number not in known:
        raise ValueError(f"no state {number} below {root}")
    return [tuple(r) for r in spark.read.schema(LISTED).parquet(f"{root}/states/{number}").collect()]


def _put(df: DataFrame, root: str, table: str) -> list[tuple]:
    """Write rows to folders of a change of their own; returns what the list says of them."""
    spark, path = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}/{table}"
    copied = df.withColumns({f: F.col(c).cast("bigint") for f, c in zip(FOLDERS, PARTITIONS)})
    copied.hint("rebalance", *FOLDERS).write.partitionBy(*FOLDERS).parquet(path)
    kinds = ", ".join(f"{f} bigint" for f in FOLDERS)
    written = spark.read.schema(kinds).parquet(path).distinct().collect()  # one row for each base
    name = lambda v: UNKNOWN if v is None else v
    return [(table, *r, "/".join([path, *(f"{f}={name(v)}" for f, v in zip(FOLDERS, r))])) for r in written]


def _commit(spark: SparkSession, root: str, rows: list[tuple], kinds: dict[str, str]) -> int:
    number = max(versions(spark, root), default=0) + 1
    # schemas are rows too, so that a table without rows can be read
    listed = rows + [(t, None, None, kind) for t, kind in kinds.items()]
    spark.createDataFrame(listed, LISTED).coalesce(1).write.mode("overwrite").parquet(f"{root}/states/{number}")
    return number


def _split(listed: list[tuple]) -> tuple[list[tuple], dict[str, str]]:
    schema = lambda r: r[3].startswith("{")
    return [r for r in listed if not schema(r)], {r[0]: r[3] for r in listed if schema(r)}


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """The first state of tables that have the columns `tenant_id` and `kb_id`."""
    rows = [r for name, df in tables.items() for r in _put(df, root, name)]
    return _commit(spark, root, rows, {name: df.schema.json() for name, df in tables.items()})


def _scan(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(kind))
    paths = [r[3] for r in rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, table: str, tenant_id: int | None = None, kb_ids: list[int] | None = None, version: int | None = None) -> DataFrame:
    """A table of the newest state, or of an older one; only the folders asked for are read."""
    rows, kinds = _split(_listed(spark, root, version))
    mine = [r for r in rows if r[0] == table and tenant_id in (None, r[1]) and (kb_ids is None or r[2] in kb_ids)]
    return _scan(spark, mine, kinds[table])


def _change(spark: SparkSession, root: str, tables: list[str] | None, gone, keep) -> int:
    """Rewrite the folders with rows of `gone(df)` to those that `keep(df)` leaves, in all tables as one change."""
    rows, kinds = _split(_listed(spark, root, None))
    stay, fresh = [], []
    for table in kinds:
        mine = [r for r in rows if r[0] == table]
        hit = set()
        if tables is None or table in tables:
            found = gone(_scan(spark, mine, kinds[table])).select(*[F.col(c).cast("bigint") for c in PARTITIONS])
            hit = {tuple(r) for r in found.distinct().collect()}  # one row for each base
        touched = [r for r in mine if r[1:3] in hit]
        stay += [r for r in mine if r[1:3] not in hit]
        if touched:
            fresh += _put(keep(_scan(spark, touched, kinds[table])), root, table)
    return _commit(spark, root, stay + fresh, kinds)


def delete_documents(spark: SparkSession, root: str, ids: DataFrame, key: str = "doc_id", tables: list[str] | None = None) -> int:
    """The cascade: rows of the given documents leave all tables (or those named) in one change. Null ids match nothing."""
    wanted = ids.select(key).distinct()
    return _change(spark, root, tables, lambda df: df.join(wanted, key, "left_semi"), lambda df: delete_ids(df, wanted, key))


def delete_rows(spark: SparkSession, root: str, predicate: Column, tables: list[str] | None = None) -> int:
    """Rows for which the predicate holds leave the tables in one change."""
    return _change(spark, root, tables, lambda df: df.filter(predicate), lambda df: delete_where(df, predicate))
