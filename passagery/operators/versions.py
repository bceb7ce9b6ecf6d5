"""Version history of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagery import constants as K
from passagery.functions import codes
from passagery.operators.ordered import BUCKET_ROWS, DENSE, by_density, counts_since
from passagery.session import materialize


def version_chain(changes: DataFrame, keys: list[str], order: list[str], cut: Column, change: str = "change_type", rows: int = BUCKET_ROWS) -> DataFrame:
    """Version label of every change: the first is v1.0.0, then each change raises its part and resets the lower ones.
    A history may be divided between values of `cut`, a monotone expression of the order; it is where its rows are many."""
    kind = F.upper(F.col(change))
    is_major, is_patch = kind == "MAJOR", kind == "PATCH"
    is_minor = ~is_major & ~is_patch
    counters = {"n_major": (is_major, F.lit(False)), "n_minor": (is_minor, is_major), "n_patch": (is_patch, is_major | is_minor)}
    divided = by_density(changes, keys, cut, rows)
    numbered = counts_since(divided, keys, order, F.col(DENSE), counters, first_resets=True).drop(DENSE)
    label = codes.format_version(F.col("n_major") + 1, F.col("n_minor"), F.col("n_patch"))
    return numbered.withColumn("version", label).drop(*counters)


def activate_latest(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Exactly the newest version of each document is active. The newest is found by aggregation. The versions are read
    twice, so what makes them is written first."""
    return _newest_active(materialize(versions, "versions"), keys, order)


def _newest_active(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    place = F.struct(*[F.col(c) for c in order])
    newest = versions.groupBy(*keys).agg(F.max(place).alias("newest"))
    return versions.join(newest, keys).withColumn("current_active", place == F.col("newest")).drop("newest")


def current_version(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per document."""
    rest = [c for c in versions.columns if c not in keys]
    place = F.struct(*[F.col(c) for c in order])
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("row")).select(*keys, "row.*")


def history(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All versions, newest first within a document, as a range-partitioned sort."""
    return versions.orderBy(*keys, *[F.col(c).desc() for c in order])


def rollback(versions: DataFrame, targets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Make the target label the active one. A label may occur once per document; a missing label changes
    nothing and is reported by `rollback_errors`."""
    versions = materialize(versions, "versions")
    wanted = targets.select(*keys, F.col("version").alias("target"))
    hits = versions.join(wanted, keys).filter(F.col("version") == F.col("target")).select(*keys, "target").distinct()
    flagged = _newest_active(versions, keys, order).join(hits, keys, "left")
    active = F.when(F.col("target").isNotNull(), F.col("version") == F.col("target")).otherwise(F.col("current_active"))
    return flagged.withColumn("current_active", active).drop("target")


def rollback_errors(versions: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return targets.join(versions.select(*keys, "version").distinct(), [*keys, "version"], "left_anti")


def retain_versions(versions: DataFrame, keys: list[str], order: list[str], keep: int = K.KEEP_VERSIONS) -> DataFrame:
    """The newest `keep` versions per document; each task drops older rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return versions.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep)


def compare_versions(before: DataFrame, after: DataFrame, key: str = "doc_id", position: str = "chunk_index") -> DataFrame:
    """Added, modified and deleted chunks per document between two chunk sets."""
    a = before.select(key, position, F.col("text_hash").alias("hash_a"))
    b = after.select(key, position, F.col("text_hash").alias("hash_b"))
    both = a.join(b, [key, position], "full_outer")
    return both.groupBy(key).agg(
        F.count_if(F.col("hash_a").isNull()).alias("added"), F.count_if(F.col("hash_a") != F.col("hash_b")).alias("modified"),
        F.count_if(F.col("hash_b").isNull()).alias("deleted"),
    )
