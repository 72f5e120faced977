"""Operator 4, sharding by extendible hashing, in DataFrame functions only.

A document's key is the first 60 bits of the MD5 of its doc_id. The directory starts as one bucket; a bucket whose bytes
exceed the limit splits on its next bit, and only such buckets do. Byte sums do not grow when a bucket splits, so a
document's shard is its shortest hash prefix whose bucket fits. Each round aggregates STEP more bits of the buckets that
are still too large, so the data are summed once or twice whatever the number of shards, and no bucket meets in one task.

Defined cases: null text has no bytes; a null doc_id hashes as the empty text; rows with one doc_id share all bits and can't
be parted: their bucket ends at 60 bits, over the limit, and `fits` is false (as with one document larger than the limit);
an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, documents

BITS, STEP = 60, 12
#: Bytes of text in a shard of the registered query.
SHARD_BYTES = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and key: 60 hash bits as text of 0 and 1."""
    doc_id = F.col("doc_id").cast("long")
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15)
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lpad(F.conv(digest, 16, 2), BITS, "0").alias("key"))


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """prefix, shard_bytes and fits of every shard; rows: key, n_bytes."""
    found, open_rows, depth = None, rows.groupBy("key").agg(F.sum("n_bytes").alias("n_bytes")), 0
    while True:
        to = min(BITS, depth + STEP)
        leaves = open_rows.groupBy(F.substring("key", 1, to).alias("leaf")).agg(F.sum("n_bytes").alias("b"))
        first = depth if depth == 0 else depth + 1
        sums = leaves.select(F.explode(F.sequence(F.lit(first), F.lit(to))).alias("depth"), "leaf", "b").groupBy(F.expr("substring(leaf, 1, depth)").alias("prefix"), "depth").agg(F.sum("b").alias("shard_bytes"))
        sums = cut(sums, "buckets")
        fit = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS))
        # a bucket exists if it fits and its parent didn't; the root and this round's first level have no parent here that fits
        parent = sums.where(F.col("shard_bytes") > max_bytes).select(F.col("prefix").alias("p_prefix"), F.col("depth").alias("p_depth"))
        on = (F.col("p_depth") == F.col("depth") - 1) & (F.col("p_prefix") == F.expr("substring(prefix, 1, depth - 1)"))
        made = fit.where(F.col("depth") == first).unionByName(fit.where(F.col("depth") > first).join(parent, on, "left_semi"))
        found = made if found is None else found.unionByName(made)
        over = sums.where((F.col("depth") == to) & (F.col("shard_bytes") > max_bytes)).select(F.col("prefix").alias("o_prefix"))
        if to == BITS or not over.take(1):
            return found.select("prefix", "depth", "shard_bytes", (F.col("shard_bytes") <= max_bytes).alias("fits"))
        open_rows, depth = open_rows.join(over, F.expr(f"substring(key, 1, {to})") == F.col("o_prefix"), "left_semi"), to


def shards(docs: DataFrame, max_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (hash prefix), depth, shard_bytes, fits: one row per document."""
    rows = cut(keyed(docs), "keyed")
    found = cut(directory(rows, max_bytes), "directory")
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # 61 at most
    options = rows.withColumn("shard", F.explode(F.array(*[F.substring("key", 1, d) for d in depths]))) if depths else rows.withColumn("shard", F.lit(""))
    return options.join(found.withColumnRenamed("prefix", "shard"), "shard").select("doc_id", "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "fits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


ORACLE_SQL = f"""
with k as (select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
                  substr(bin(cast(('0x1' || substr(md5(cast(doc_id as varchar)), 1, 15)) as ubigint)), 2) as key from documents),
d as (select doc_id, n_bytes, key, unnest(range(0, 61)) as depth from k),
s as (select substr(key, 1, depth) as shard, depth, cast(sum(n_bytes) as bigint) as shard_bytes from d group by all),
best as (select k.doc_id, k.n_bytes, min(s.depth) as depth from k join s on s.shard = substr(k.key, 1, s.depth)
         where s.shard_bytes <= {SHARD_BYTES} or s.depth = 60 group by all)
select k.doc_id, k.n_bytes, s.shard, cast(s.depth as integer) as depth, s.shard_bytes, s.shard_bytes <= {SHARD_BYTES} as fits
from k join best using (doc_id) join s on s.depth = best.depth and s.shard = substr(k.key, 1, best.depth)
"""
