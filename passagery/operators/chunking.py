"""Chunkers: document rows in, chunk rows out, in one projection and one generator (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from passagery import constants as K
from passagery.functions import codes, text as T

PIECE = "struct<chunk_type:string,parent_index:int,index_in_parent:int,text:string>"


def pack(parts: Column, sep: str, limit: int, oversize: Callable[[Column], Column], reset: bool = True) -> Column:
    """Greedy packing: join neighbours with `sep` while they fit, hand longer parts to `oversize`.

    The accumulator holds one open piece (at most `limit` characters) and the finished pieces.
    """
    empty = F.array().cast("array<string>")

    def state(cur: Column, size: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), size.alias("size"), out.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        cur, size, out, n = acc["cur"], acc["size"], acc["out"], F.length(part)
        joined = size + F.when(size > 0, F.lit(len(sep))).otherwise(F.lit(0)) + n
        closed = F.when(size > 0, F.array_append(out, cur)).otherwise(out)
        kept = (F.lit(""), F.lit(0)) if reset else (cur, size)
        return (
            F.when(joined <= limit, state(F.when(size > 0, F.concat(cur, F.lit(sep), part)).otherwise(part), joined, out))
            .when(n > limit, state(kept[0], kept[1], F.concat(closed, oversize(part))))
            .otherwise(state(part, n, closed))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["size"] > 0, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])

    return F.aggregate(parts, state(F.lit(""), F.lit(0), empty), step, finish)


def _single_char_pack(text: Column, delimiter: str, limit: int, overlap: int) -> Column:
    """The same packing for a one-character delimiter as one linear regex pass."""
    d = delimiter if delimiter.isalnum() or delimiter.isspace() else "\\" + delimiter
    pattern = f"(?s){d}*+((?>.{{0,{limit}}}(?={d}|\\z)|[^{d}]{{{limit + 1},}})){d}?"
    runs = F.filter(F.regexp_extract_all(text, F.lit(pattern), 1), lambda s: s != "")
    return F.flatten(
        F.transform(runs, lambda s: F.when(F.length(s) > limit, T.split_hard(s, limit, overlap)).otherwise(F.array(s)))
    )


def text_model_pieces(
    text: Column,
    delimiter: str = K.TEXT_DELIMITER,
    max_tokens: int = K.TEXT_MAX,
    overlap: int = K.TEXT_OVERLAP,
    compat: bool = False,
    single_pass: bool = True,
) -> Column:
    """Chunk texts of one document. `compat` repeats the open piece after a hard split and may lose tails."""
    if single_pass and not compat and len(delimiter) == 1:
        packed = _single_char_pack(text, delimiter, max_tokens, overlap)
    else:
        hard = T.split_hard_lossy if compat else T.split_hard
        packed = pack(
            T.split_literal(text, delimiter), delimiter, max_tokens,
            lambda p: hard(p, max_tokens, overlap), reset=not compat,
        )
    return F.when(F.length(text) <= max_tokens, F.array(text)).otherwise(packed)


def merge_short(paragraphs: Column, sep: str = K.PARENT_SEP, limit: int = K.PARENT_MAX) -> Column:
    """Neighbouring short paragraphs merged up to `limit`; an oversized paragraph stands alone."""
    return pack(paragraphs, sep, limit, lambda p: F.array(p))


def build_parents(merged: Column, limit: int = K.PARENT_MAX) -> Column:
    """Parent texts: merged blocks as they are, oversized ones cut at sentence ends.

    Packing merged blocks once more cannot join any two of them, so only the cut is left to do.
    """
    cut = lambda p: F.when(F.length(p) > limit, T.split_oversized(p, limit)).otherwise(F.array(p))
    return F.flatten(F.transform(merged, cut))


def split_children(parent: Column, sep: str = K.CHILD_SEP, limit: int = K.CHILD_MAX) -> Column:
    """Child texts of one parent; blank parts are skipped."""
    parts = F.filter(T.split_literal(parent, sep), lambda p: T.trim_control(p) != "")
    return pack(parts, sep, limit, lambda p: T.split_oversized(p, limit))


def hierarchical_parents(text: Column, parent_sep: str = K.PARENT_SEP, parent_max: int = K.PARENT_MAX) -> Column:
    return build_parents(merge_short(T.split_paragraphs(T.clean_text(text)), parent_sep, parent_max), parent_max)


def _piece(kind: str, parent: Column, child: Column, text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("chunk_type"), parent.cast("int").alias("parent_index"),
        child.cast("int").alias("index_in_parent"), text.alias("text"),
    ).cast(PIECE)


def flat_array(text: Column, params: Mapping) -> Column:
    pieces = text_model_pieces(
        text, params.get("delimiter", K.TEXT_DELIMITER), params.get("max_tokens", K.TEXT_MAX),
        params.get("overlap", K.TEXT_OVERLAP), params.get("compat", False), params.get("single_pass", True),
    )
    return F.transform(pieces, lambda t: _piece("flat", F.lit(None), F.lit(None), t))


def hierarchical_array(text: Column, params: Mapping) -> Column:
    """Each parent followed by its children."""
    parents = hierarchical_parents(text, params.get("parent_sep", K.PARENT_SEP), params.get("parent_max", K.PARENT_MAX))
    sep, limit = params.get("child_sep", K.CHILD_SEP), params.get("child_max", K.CHILD_MAX)
    family = lambda p, i: F.concat(
        F.array(_piece("parent", i, F.lit(None), p)),
        F.transform(split_children(p, sep, limit), lambda c, j: _piece("child", i, j, c)),
    )
    return F.flatten(F.transform(parents, family))


def chunk_path(kind: Column, chunk_index: Column, parent: Column, child: Column) -> Column:
    p, c = parent.cast("string"), child.cast("string")
    return (
        F.when(kind == "parent", F.concat(F.lit("p"), p))
        .when(kind == "child", F.concat(F.lit("p"), p, F.lit("c"), c))
        .otherwise(chunk_index.cast("string"))
    )


def chunk_id(doc: Column, version: Column, mode: Column, path: Column) -> Column:
    """Deterministic id: a retried task writes the same rows again."""
    return F.md5(F.concat_ws("|", doc.cast("string"), version, mode, path))


def chunk(
    df: DataFrame,
    strategy: Column | str | None = None,
    params: Mapping | None = None,
    doc_col: str = "doc_id",
    text_col: str = "text",
    version_col: str | None = None,
) -> DataFrame:
    """Chunk every document with the strategy of its row; other document columns are carried along."""
    given = dict(params or {})
    name = F.lit(strategy) if strategy is None or isinstance(strategy, str) else strategy
    mode = codes.normalize_strategy(name)
    body = F.col(text_col)
    flat, nested = flat_array(body, given), hierarchical_array(body, given)
    if isinstance(strategy, Column):
        pieces = F.when(F.col("chunk_mode") == K.HIERARCHICAL_MODEL, nested).otherwise(flat)
    else:
        known = (strategy or "").strip().lower().replace("-", "_")
        pieces = nested if known == K.HIERARCHICAL_MODEL else flat
    carried = [c for c in df.columns if c != text_col]
    version = F.col(version_col) if version_col else F.lit("v1.0.0")
    rows = (
        df.filter(F.length(body) > 0)
        .withColumn("chunk_mode", mode)
        .select(*carried, "chunk_mode", F.posexplode(pieces).alias("chunk_index", "piece"))
        .select(*carried, "chunk_mode", "chunk_index", "piece.*")
    )
    parent_id = chunk_id(
        F.col(doc_col), version, F.col("chunk_mode"), F.concat(F.lit("p"), F.col("parent_index").cast("string"))
    )
    path = chunk_path(F.col("chunk_type"), F.col("chunk_index"), F.col("parent_index"), F.col("index_in_parent"))
    return rows.withColumn(
        "chunk_id", chunk_id(F.col(doc_col), version, F.col("chunk_mode"), path)
    ).withColumn("parent_chunk_id", F.when(F.col("chunk_type") == "child", parent_id))


def chunk_text_model(df: DataFrame, text_col: str = "text", doc_col: str = "doc_id", **params) -> DataFrame:
    return chunk(df, K.TEXT_MODEL, params, doc_col, text_col)


def chunk_hierarchical(df: DataFrame, text_col: str = "text", doc_col: str = "doc_id", **params) -> DataFrame:
    return chunk(df, K.HIERARCHICAL_MODEL, params, doc_col, text_col)


def classify_chunk(mode: Column, kind: Column, parent: Column) -> Column:
    """Only hierarchical chunks are parents or children, and only children keep a parent id."""
    nested = mode == K.HIERARCHICAL_MODEL
    label = F.when(nested & kind.isin("parent", "child"), kind).otherwise("flat")
    return F.struct(label.alias("chunk_type"), F.when(label == "child", parent).alias("parent_chunk_id"))


def enrich_chunks(chunks: DataFrame, docs: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Attach owner, tenant, knowledge base and version of the document; keep both chunk positions."""
    return chunks.join(docs, doc_col).withColumn("text_hash", T.text_hash(F.col("text")))
