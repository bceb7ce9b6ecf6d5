"""Starting streams and collecting what they wrote.

A stream is run over the data available and then stops. Results go to files in the shared folder, one folder per
micro-batch: a batch that is tried again replaces its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from passagery.session import scratch_path

SHUFFLE = "spark.sql.shuffle.partitions"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table, stored as a folder of part files or as one file, as a stream of bounded micro-batches."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@contextmanager
def stream_settings(spark: SparkSession):
    """Operator state on disk, as it outgrows memory long before the data does, and no more state partitions than
    a few per core: each of them is a store of its own."""
    partitions = min(int(spark.conf.get(SHUFFLE)), 4 * spark.sparkContext.defaultParallelism)
    wanted = {STORE: ROCKS, SHUFFLE: str(partitions)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def run_available(stream: DataFrame, label: str, mode: str = "append", step: Callable[[DataFrame, int, str], None] | None = None) -> str:
    """Process what is there; returns the folder written. `step` replaces the plain write of a micro-batch."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, label + "-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        (step or write_batch)(batch, number, out)

    with stream_settings(spark):
        job = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start()
        )
        job.awaitTermination()
    return out


def write_batch(batch: DataFrame, number: int, out: str) -> None:
    batch.write.mode("overwrite").parquet(f"{out}/batch={number}")


def appended(stream: DataFrame, label: str) -> DataFrame:
    """All rows that an append-mode stream has emitted."""
    out = run_available(stream, label)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def updated(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """The last state per key that an update-mode stream has emitted."""
    rest = [c for c in stream.columns if c not in keys]
    out = run_available(stream, label, "update")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = stream.sparkSession.read.schema(schema).parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")
