"""Files as packets and packets as files: byte ranges, session dumps, XML dumps, templated names, encrypted copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bytes(spark: SparkSession, path: str, first: int = 0, length: int | None = None) -> DataFrame:
    """path, size, data of whole files, or of a byte range of each."""
    data = F.col("content") if not first and length is None else F.substring("content", F.lit(first + 1), F.lit(length) if length is not None else F.length("content"))
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), data.alias("data"))


def write_session(packets: DataFrame, path: str, *skip: str) -> None:
    """A whole session (typed columns and property maps) as Parquet, sorted for time pruning; `skip` names properties that
    aren't kept."""
    if "props" in packets.columns and skip and packets.schema["props"].dataType.typeName() == "map":
        packets = packets.withColumn("props", F.map_filter("props", lambda k, _: ~k.isin(*skip)))
    packets.sortWithinPartitions("pid", "cts").write.mode("overwrite").parquet(path)


def read_session(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A session, or the part that begins in [start, end): the scan skips row groups outside."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col("cts") >= start)
    return df if end is None else df.where(F.col("cts") < end)


#: Texts that XML cannot carry as they are: control characters and U+FFFE, U+FFFF (not allowed), carriage returns (read as line
#: feeds), nothing or white space alone (read as null), white space at the ends.
_NOT_XML = r"[\x00-\x08\x0b-\x1f\uFFFE\uFFFF]|\A\s|\s\z|\A\z"


def write_xml(packets: DataFrame, path: str) -> None:
    """One element per packet, with a checksum of its text payload if there is one. A payload that XML cannot carry is written
    in Base64, as payload64."""
    if "payload" in packets.columns:
        data = F.encode("payload", "UTF-8")
        odd = F.col("payload").rlike(_NOT_XML)
        coded = F.when(odd, F.concat(F.lit("="), F.base64(data)))
        packets = packets.withColumn("crc", F.crc32(data)).withColumn("payload64", coded).withColumn("payload", F.when(~odd, F.col("payload")))
    packets.write.mode("overwrite").format("xml").option("rootTag", "packets").option("rowTag", "packet").save(path)


def read_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Packets of write_xml; a schema with payload gets it as it was."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    coded = ", payload64 string" if "payload" in names else ""
    df = spark.read.format("xml").option("rowTag", "packet").schema(schema + coded).load(path)
    if coded:
        df = df.withColumn("payload", F.coalesce("payload", F.decode(F.unbase64(F.substring("payload64", F.lit(2), F.length("payload64"))), "UTF-8")))
    return df.select(*names)


def write_named(packets: DataFrame, path: str, name: Column, mode: str = "errorifexists") -> None:
    """One folder for each name (a template's value)."""
    packets.withColumn("file", name).write.mode(mode).partitionBy("file").parquet(path)


def write_encrypted(files: DataFrame, path: str, key: Column) -> None:
    """Whole payloads by AES-GCM, one row a file."""
    files.withColumn("data", F.aes_encrypt("data", key)).write.mode("overwrite").parquet(path)


def read_encrypted(spark: SparkSession, path: str, key: Column) -> DataFrame:
    return spark.read.parquet(path).withColumn("data", F.aes_decrypt("data", key))
