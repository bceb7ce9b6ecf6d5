"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .ann import search, usable
from .bpe import encode
from .chat import examples, read_back
from .common import read
from .hardneg import mine, prepared
from .langid import fit, held_out, predict
from .lines import drop_lines
from .mixing import mix
from .pii import BASE, KINDS, find, listed
from .quality import judge
from .secrets import find_secrets
from .simhash import near_duplicates
from .suffix import passages
from .sql import CHAT, LINES, MIXING
from .whiten import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op7_line_dedup": LINES, "op9_mixing": MIXING, "op12_chat": CHAT}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "posterior")


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where("id % 50 = 0"), k=5)


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    network = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return spans.select("doc_id", "spans", base.alias("base")).select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return found.select("doc_id", "spans", base.alias("base")).select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query
def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"), least=50)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = prepared(read(spark, sf_dir, "embeddings"), "vec_id", moved, "embedding")
    return mine(rows, rows.where("id % 50 = 0")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = read(spark, sf_dir, "conversations").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in odd.schema])
    return read_back(examples(table.unionAll(odd)))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part")
    return out.select("id", "n", "deviation", "identity_error", each).select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error")
