"""What the operators of this subpackage share: reading, text columns, and written intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagery.session import scratch_path, ship_package

#: fixed values: the white space that parts words
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that no further column can clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the built-in route, where both are the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small: a batch of very long texts must fit a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Written intermediates of one run below the shared folder; those the result does not read can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_path(spark, label)

    def write(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """Write once, read back with the same schema."""
        path = f"{self.root}/{name}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(path)
        reader = self.spark.read
        return reader.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
