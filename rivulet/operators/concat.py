"""Sources on end, loops, splices, and orders of packets between streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.packets import chunk_of
from rivulet.operators.scan import ordered_fold, scan
from rivulet.operators.windows import unwrap_sequence


def concatenate(sources: list[DataFrame], per_stream: bool = False) -> DataFrame:
    """All sources on one timeline, with src (its number): each starts where the one before ends, by its last packet over
    all streams (per_stream: by that of the same stream). Columns that a source lacks are null.

    A source's start and end are one row (per stream); the offsets are a sum over the sources before."""
    tagged = [df.withColumn("src", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    by = ["pid"] if per_stream else []
    spans = rows.groupBy("src", *by).agg(F.min("cts").alias("_first"), (F.max(F.col("cts") + F.col("dur")) - F.min("cts")).alias("_len"))
    before = Window.partitionBy(*by).orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(F.col("src").alias("_s"), *[F.col(b).alias("_p") for b in by], "_first", F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_offset"))
    on = F.col("src") == F.col("_s")
    if per_stream:
        on = on & F.col("pid").eqNullSafe(F.col("_p"))
    else:
        offsets = F.broadcast(offsets)  # one row for each item of the list `sources`
    return rows.join(offsets, on).withColumn("cts", F.col("_offset") + F.col("cts") - F.col("_first")).drop("_s", "_p", "_first", "_offset")


def loop(df: DataFrame, times: int) -> DataFrame:
    """df played `times` times on end; turn counts from 0. The whole length is one aggregate row."""
    span = df.agg((F.max(F.col("cts") + F.col("dur")) - F.min("cts")).alias("_len"))
    turns = df.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("_one", F.lit(1))
    return turns.join(F.broadcast(span.withColumn("_one", F.lit(1))), "_one").withColumn("cts", F.col("cts") + F.col("turn") * F.col("_len")).drop("_one", "_len")


def splice(main: DataFrame, other: DataFrame, out_ts: int, in_ts: int | None = None, keep: bool = False) -> DataFrame:
    """main with other put in at out_ts. Without keep, main's packets from out_ts to in_ts go (in_ts None: what other covers);
    with it they follow, moved by other's length. spliced marks what came in."""
    span = other.agg(F.min("cts").alias("_first"), (F.max(F.col("cts") + F.col("dur")) - F.min("cts")).alias("_len")).withColumn("_one", F.lit(1))
    one = lambda df: df.withColumn("_one", F.lit(1)).join(F.broadcast(span), "_one", "left")
    shift = F.coalesce("_len", F.lit(0))
    back = F.lit(in_ts) if in_ts is not None else F.lit(out_ts) + shift
    moved = F.when(F.col("cts") < out_ts, F.col("cts")).otherwise(F.col("cts") + (shift if keep else out_ts + shift - back))
    rest = one(main) if keep else one(main).where((F.col("cts") < out_ts) | (F.col("cts") >= back))
    own = rest.withColumn("cts", moved).withColumn("spliced", F.lit(False))
    new = one(other).withColumn("cts", F.col("cts") - F.col("_first") + out_ts).withColumn("spliced", F.lit(True))
    return own.drop("_one", "_first", "_len").unionByName(new.drop("_one", "_first", "_len"), allowMissingColumns=True)


def file_order(name: str, by: str = "name", size: str = "size", date: str = "date") -> list[Column]:
    """Order of files: by name shorter ones first, then by bytes; by size or by date the smallest or oldest first, then by name."""
    first = {"name": [], "size": [F.col(size).asc()], "date": [F.col(date).asc()]}[by]
    return [*first, F.length(name).asc(), F.col(name).asc()]


def merged(streams: DataFrame) -> DataFrame:
    """All streams by time across timescales: a range-partitioned sort, no single task."""
    return streams.orderBy(F.col("dts") / F.col("timescale"), "pid", "seq")


def reorder(df: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Packets in the order of their 16-bit numbers (carried on over wraps), repeats dropped: the first arrival stays.
    Adds place, the unwrapped number."""
    out = unwrap_sequence(df, seq, order).withColumnRenamed("unwrapped", "place")
    first = F.row_number().over(Window.partitionBy("pid", "place").orderBy(*order))
    return out.withColumn("_r", first).where("_r = 1").drop("_r")


def interleave(df: DataFrame, most: int, order: list[str]) -> DataFrame:
    """pid, id, chunk: a track's chunk ends before the packet with which it would last longer than `most`. To write tracks
    interleaved, sort by (chunk, pid)."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        chunk, held = state
        if held and held + row["dur"] > most:
            chunk, held = chunk + 1, 0
        return (chunk, held + row["dur"]), [{"pid": row["pid"], "id": row["id"], "chunk": chunk}]

    return ordered_fold(df.select("pid", "id", *[c for c in order if c != "id"], "dur"), ["pid"], order, lambda: (0, 0), step, "pid long, id long, chunk long")


def fan_out(df: DataFrame, property_name: str, path: str) -> None:
    """One folder for each value of a property."""
    df.write.mode("overwrite").partitionBy(property_name).parquet(path)


def presentation_order(df: DataFrame, ts: str = "cts", tie: str = "event_id") -> DataFrame:
    """place: 0-based number of each packet of a stream by presentation time, whatever order it was sent in."""
    out = scan(df, ["pid"], [ts, tie], chunk_of(F.col(ts)), sums={"_n": F.lit(1)})
    return out.withColumn("place", F.col("_n") - 1).drop("_n")


def several(sources: list[DataFrame]) -> DataFrame:
    """Sources that play at once as one table; src numbers them, and columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)])


def append(first: DataFrame, second: DataFrame, aligned: bool = True) -> DataFrame:
    """second behind first. aligned: all of its streams move by one offset, so that they stay in step; else each stream follows
    on from its own end (a stream that first lacks follows from 0)."""
    if aligned:
        return concatenate([first, second])
    ends = first.groupBy(F.col("pid").alias("_p")).agg(F.max(F.col("cts") + F.col("dur")).alias("_end"))
    starts = second.groupBy(F.col("pid").alias("_q")).agg(F.min("cts").alias("_begin"))
    moved = second.join(starts, F.col("pid").eqNullSafe(F.col("_q"))).join(ends, F.col("pid").eqNullSafe(F.col("_p")), "left")
    moved = moved.withColumn("cts", F.col("cts") - F.col("_begin") + F.coalesce("_end", F.lit(0))).drop("_p", "_q", "_end", "_begin")
    return first.withColumn("src", F.lit(0)).unionByName(moved.withColumn("src", F.lit(1)))


def to_destinations(df: DataFrame, destinations: list[str]) -> DataFrame:
    """Every packet for every destination of a short list."""
    return df.withColumn("destination", F.explode(F.array(*map(F.lit, destinations))))
