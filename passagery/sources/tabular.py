"""Tables and parts rendered as text.

Every text is built per (key, segment), where a segment is a fixed range of row numbers, so that a key that holds a
large share of all rows is spread over many groups; a second level joins the few segments of a key to its one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagery import constants as K
from passagery.functions import text as T

SEGMENT_ROWS = 1000


def cell_text(column: Column, dtype: str) -> Column:
    """Cell rendering: trimmed, literal "null" is blank, integral doubles without a fraction."""
    if dtype in ("double", "float"):
        whole = (column == F.floor(column)) & (F.abs(column) < 9.0e18)
        column = F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    body = T.trim_control(F.coalesce(column.cast("string"), F.lit("")))
    return F.when(F.lower(body) == "null", F.lit("")).otherwise(body)


def ordered_text(order: list[str], text: Column, sep: str) -> Column:
    """Texts of a bounded group joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], text.alias("body"))))
    return F.array_join(F.transform(pairs, lambda p: p["body"]), sep)


def assemble_parts(
    df: DataFrame, key: str, order: str, text: str = "text", sep: str = "\n\n", segment_parts: int = SEGMENT_ROWS
) -> DataFrame:
    """Parts of one document joined in order: one row (key, n_parts, text) for each document."""
    segment = F.floor(F.col(order) / segment_parts).cast("bigint")
    segments = (
        df.withColumn("segment", segment)
        .groupBy(key, "segment")
        .agg(F.count(F.lit(1)).alias("n_parts"), ordered_text([order], F.col(text), sep).alias("text"))
    )
    return segments.groupBy(key).agg(
        F.sum("n_parts").alias("n_parts"), ordered_text(["segment"], F.col("text"), sep).alias("text")
    )


def table_to_text(
    df: DataFrame,
    sheet: str,
    order: str,
    cols: dict[str, str],
    threshold: int = K.TABLE_ROW_LIMIT,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Each sheet as one text: a Markdown table up to `threshold` rows, else `header: value` lines.

    `cols` maps source columns to headers (blank header: a numbered one). Rows without any value are dropped.
    """
    types = dict(df.dtypes)
    headers = [h.strip() or f"{K.BLANK_HEADER}{i + 1}" for i, h in enumerate(cols.values())]
    cells = F.array(*[cell_text(F.col(c), types[c]) for c in cols])
    rows = (
        df.select(F.col(sheet).alias("sheet"), F.col(order).cast("bigint").alias("row_no"), cells.alias("cells"))
        .filter(F.exists("cells", lambda c: c != ""))
        .withColumn("segment", F.floor(F.col("row_no") / segment_rows).cast("bigint"))
    )
    sizes = rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_rows"))
    pairs = F.filter(
        F.zip_with(
            F.array(*[F.lit(h) for h in headers]), F.col("cells"),
            lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c)),
        ),
        lambda x: x.isNotNull(),
    )
    md_row = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    md_head = "| " + " | ".join(headers) + " |\n|" + " --- |" * len(headers) + "\n"
    small = F.col("n_rows") <= threshold
    lined = (
        rows.join(sizes, "sheet")
        .withColumn("mode", F.when(small, F.lit("markdown")).otherwise(F.lit("key_value")))
        .withColumn("line", F.when(small, md_row).otherwise(F.array_join(pairs, ", ")))
    )
    segments = lined.groupBy("sheet", "mode", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), ordered_text(["row_no"], F.col("line"), "\n").alias("body")
    )
    body = segments.groupBy("sheet", "mode").agg(
        F.sum("n_rows").alias("n_rows"), ordered_text(["segment"], F.col("body"), "\n").alias("body")
    )
    title = F.concat(F.lit("## "), F.col("sheet").cast("string"), F.lit("\n\n"))
    table = F.concat(title, F.lit(md_head), F.col("body"), F.lit("\n"))
    text = F.when(F.col("mode") == "markdown", table).otherwise(F.concat(title, F.col("body")))
    return body.select("sheet", "mode", "n_rows", text.alias("text"))


def workbook_text(sheets: DataFrame, workbook: str, order: str) -> DataFrame:
    """The sheets of each workbook joined by the break, in order: one row (workbook, n_sheets, text)."""
    return sheets.groupBy(workbook).agg(
        F.count(F.lit(1)).alias("n_sheets"), ordered_text([order], F.col("text"), K.SHEET_BREAK).alias("text")
    )
