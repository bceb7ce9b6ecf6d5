"""From raw documents to encoded training text, one written table after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagery.llm.bpe import encode
from passagery.llm.common import Scratch
from passagery.llm.lines import drop_lines
from passagery.llm.mixing import mix
from passagery.llm.near import near_duplicates
from passagery.llm.quality import keep_good
from passagery.llm.simhash import keep_one

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return keep_good(docs)


def fewer_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; `text` and `n_chars` follow."""
    kept = F.col("kept_text")
    new = {"text": kept, "n_chars": F.char_length(kept).cast("long")}
    return drop_lines(docs).select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, near_duplicates(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the number of tokens and the token ids of each text."""
    return encode(docs, carry=["doc_id", "source"]).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("lines", fewer_lines),
    ("simhash", one_of_each),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: the verdict of the quality rules comes from expectation-maximisation, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if place:
            scratch.drop(STAGES[place - 1][0])
    return docs
