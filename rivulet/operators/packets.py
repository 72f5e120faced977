"""The packet table: one row per packet of a stream (pid), with ticks, random-access type, size and open properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators.scan import scan

#: Milliseconds of a chunk of a stream; a chunk is what one task takes of it.
CHUNK = 6 * 3_600_000


def chunk_of(ts: Column, ticks: int = CHUNK) -> Column:
    return F.floor(ts / ticks)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of `events`: pid is the user, cts milliseconds; signups and clicks are random-access points of type 1 and 2."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sap = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(0)
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select(F.col("user_id").alias("pid"), "event_id", ms.alias("cts"), sap.alias("sap"), F.length("props").cast("long").alias("size"), "event_type", "value", "props")


def timed(df: DataFrame) -> DataFrame:
    """Adds seq (0-based number in the stream) and dur (ticks to the next packet, 0 for the last)."""
    out = scan(df, ["pid"], ["cts", "event_id"], chunk_of(F.col("cts")), sums={"seq": F.lit(1)}, leads={"_next": F.col("cts")})
    return out.select(*df.columns, (F.col("seq") - 1).alias("seq"), F.coalesce(F.col("_next") - F.col("cts"), F.lit(0)).alias("dur"))


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(events(spark, sf_dir))


def order_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packets of their order: one day each, returned ones are random-access points."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("pid"), F.expr("unix_micros(cast(l_shipdate as timestamp)) div 1000").alias("cts"), F.lit(86_400_000).alias("dur"), (F.col("l_returnflag") == "R").cast("int").alias("sap"), F.col("l_quantity").cast("long").alias("size"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as captions of one second each, one every two seconds."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("pid"), F.col("turn").alias("seq"), (F.col("turn") * 2000).alias("start"), (F.col("turn") * 2000 + 1000).alias("end"), "role", "text")
