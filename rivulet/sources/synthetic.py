"""Generated packets: numbered payloads with digests, periodic clocks, and text by word or line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def packets(spark: SparkSession, streams: int = 1, most: int = 1000) -> DataFrame:
    """pid, seq, payload of `streams` streams with `most` packets each, made where they are needed."""
    n = spark.range(streams * most)
    return n.select((F.col("id") % streams).alias("pid"), F.expr(f"id div {streams}").alias("seq")).withColumn("payload", F.encode(F.format_string("stream %d packet %d", "pid", "seq"), "UTF-8"))


def digest(df: DataFrame) -> DataFrame:
    """pid, sha1 of its payloads in order. For test streams of bounded length."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "payload")))
    return df.groupBy("pid").agg(F.sha1(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["payload"]))).alias("sha1"))


def split_blocks(df: DataFrame, parts: int = 3) -> DataFrame:
    """Each packet as `parts` fragments with start and end flags."""
    size = F.ceil(F.length("payload") / parts).cast("int")
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("byte_offset", (F.col("part") * size).cast("long")).withColumn("payload", F.substring("payload", (F.col("part") * size + 1).cast("int"), size)).withColumn("start", F.col("part") == 0).withColumn("end", F.col("part") == parts - 1)


def frames(spark: SparkSession, count: int, num: int, den: int, timescale: int, every: int) -> DataFrame:
    """Counter frames at num/den a second with an event in every `every`-th."""
    return spark.range(count).select(F.col("id").alias("seq"), F.expr(f"id * {den} * {timescale} div {num}").alias("cts"), (F.col("id") % every == 0).alias("event"))


def words(texts: DataFrame, by_line: bool = False) -> DataFrame:
    """pid, seq, fragment: each word (or line) of a text as a packet."""
    parts = F.filter(F.split("text", r"\n" if by_line else r"\s+"), lambda x: x != "")
    return texts.select("pid", F.posexplode(parts).alias("seq", "fragment"))
