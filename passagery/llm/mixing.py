"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size-of-source copies. Documents stand in an order that spreads sizes
evenly; the running sum of expected copies plus one random offset for each source yields a copy at every integer it
crosses. Ranks come from counts of bounded cells (source, size class, hash slice) and from places within a cell, so a
source of any share of the rows is never in one task. DataFrame functions only.

Null texts have size 0. A null source is a source of its own, last in order. Repeated rows stand side by side and each
is sampled for itself. A source without words gets target 0 and takes nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, words

CELL = ["source_key", "size_class", "slice"]


def source_key(source: Column) -> Column:
    """Never null, and in the order of the sources: by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sized: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """One row for each source: its size and the words it should give.

    Sources that reach `most` times their size are those of smallest size per weight: along that order, a source is
    capped as long as its cap lies below its share of what the capped ones before it leave.
    """
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sums.select("*", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.select("*", (left / weight_left).alias("level"))
    # the level rises along the order while sources are capped and falls from the first that is not
    capped = level.select("*", (F.col("cap") < F.col("level") * F.col("weight")).alias("capped"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * final))
    return capped.select("source_key", "source_size", target.alias("target"))


def offset(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on source and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / 2.0**32


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 42,
        carry: Sequence[str] = ("*",)) -> DataFrame:
    """`row` (the columns of the input row named by `carry`), `size`, `source_size`, `target` of its source, `copies`
    and `taken` (size times copies).

    Sizes are counted once and written with what is carried. The slices of a size class follow the number of rows, so
    that a cell stays small at any size of the table.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = scratch.write(docs.select(
        F.struct(*carry).alias("row"), F.size(words(text)).cast("long").alias("size"),
        source_key(F.col("source")).alias("source_key"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(text).alias("text_hash")), "sized")
    slices = 32 * max(1, math.ceil(sized.count() / 20_000_000))
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    celled = sized.select("*", F.floor(F.sqrt("size")).cast("long").alias("size_class"), (number % slices).alias("slice"))
    cells = celled.groupBy(*CELL).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("size_class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.write(
        cells.select(*CELL, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(
            targets(sized, weights, most), "source_key"), "starts")
    within = Window.partitionBy(*CELL).orderBy("size", "id", "text_hash")
    ranked = celled.join(starts, CELL).select("*", (F.col("start") + F.row_number().over(within)).alias("rank"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = ranked.select("*", each.alias("each"), offset(F.col("source_key"), seed).alias("offset"))
    crossed = [F.floor((F.col("rank") - k) * F.col("each") + F.col("offset")) for k in (0, 1)]
    copies = F.least(crossed[0] - crossed[1], F.lit(int(most)))
    return drawn.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"),
                        (F.col("size") * copies).cast("long").alias("taken"))
