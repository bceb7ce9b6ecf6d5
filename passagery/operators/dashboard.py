"""Usage figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dashboard_metrics(kbs: DataFrame, documents: DataFrame, chunks: DataFrame, questions: DataFrame, day: str, created: str = "create_time", ts: str = "ts") -> DataFrame:
    """Cards of a day, each with its change in percent: bases, documents and chunks there are at its end against the
    end of the day before, and the day's questions against those of the day before. What has no time was always there."""
    this, before = F.lit(day).cast("date"), F.date_sub(F.lit(day).cast("date"), 1)
    made, asked = F.to_date(F.col(created)), F.to_date(F.col(ts))

    def card(df: DataFrame, key: str, now: Column, prior: Column) -> DataFrame:
        counted = df.agg(F.count_if(now).alias("value"), F.count_if(prior).alias("prior"))
        change = F.when(F.col("prior") > 0, F.round((F.col("value") - F.col("prior")) * 100.0 / F.col("prior"), 4)).otherwise(0.0)
        return counted.select(F.lit(key).alias("key"), "value", change.alias("delta"))

    by = lambda end: made.isNull() | (made <= end)
    out = card(questions.filter((asked == this) | (asked == before)), "qa", asked == this, asked == before)
    for key, df in (("kb", kbs), ("doc", documents), ("chunk", chunks)):
        out = out.unionByName(card(df, key, by(this), by(before)))
    return out


def qa_trend(events: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """Twelve two-hour buckets of a day and of the day before, zero-filled."""
    spark = events.sparkSession
    this, prior = F.lit(day).cast("date"), F.date_sub(F.lit(day).cast("date"), 1)
    date = F.to_date(F.col(ts))
    slot = F.floor(F.hour(F.col(ts)) / 2).cast("int")
    counts = events.filter((date == this) | (date == prior)).groupBy(slot.alias("slot")).agg(
        F.count_if(date == this).alias("current"), F.count_if(date == prior).alias("previous")
    )
    spine = spark.range(12).select(F.col("id").cast("int").alias("slot"))
    filled = spine.join(counts, "slot", "left")
    return filled.select(
        "slot", F.format_string("%02d:00", F.col("slot") * 2).alias("label"), F.coalesce("current", F.lit(0)).alias("current"),
        F.coalesce("previous", F.lit(0)).alias("previous"),
    )


def doc_type_distribution(documents: DataFrame, kind: Column) -> DataFrame:
    """Documents per type and their share; the total is taken over the few type rows, not over the documents."""
    counts = documents.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def recent_activity(events: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    return events.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def answer_stats(messages: DataFrame, by: list[str]) -> DataFrame:
    """Response times and tokens of answers. The percentile is the exact discrete one: the least time that 95 of 100 answers
    do not exceed, read from the counts of each time."""
    counts = messages.groupBy(*by, "response_time").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"))
    timed = F.when(F.col("response_time").isNotNull(), F.col("n")).otherwise(0)
    group = Window.partitionBy(*by)
    placed = counts.withColumn("timed", timed).withColumn("all", F.sum("timed").over(group)).withColumn(
        "up_to", F.sum("timed").over(group.orderBy(F.col("response_time").asc_nulls_first())))
    reached = (F.col("timed") > 0) & (F.col("up_to") * 100 >= F.col("all") * 95)
    return placed.groupBy(*by).agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("response_time").cast("bigint") * F.col("n")) / F.max("all"), 6).alias("avg_response"),
        F.max("response_time").alias("max_response"), F.min(F.when(reached, F.col("response_time"))).alias("p95_response"),
        F.sum("tokens").alias("tokens"),
    )
