"""Streams: segments, sessions, repeats, timed joins, reordering, and running them to the end of what there is."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.sources.scratch import shared_dir


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream. All files that are there make one batch: files have no order of time, and in a
    later batch whatever is older than the watermark of an earlier one would be dropped."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, into a shared folder, and gives its rows. Append mode: windows that the
    watermark hasn't passed are not among them."""
    spark = stream.sparkSession
    out, state = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def flushed(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream to the end of what there is now, and gives all its groups, those that the watermark hasn't
    passed too: input has ended, so they are whole. Each batch writes the groups anew; the last batch's are the result."""
    spark = stream.sparkSession
    out, state, last = shared_dir(spark, name), shared_dir(spark, f"{name}-state"), [-1]

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")
        last[0] = max(last[0], batch)

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[0]}") if last[0] >= 0 else spark.createDataFrame([], stream.schema)


def segments(stream: DataFrame, length: str, origin: str, late: str = "0 seconds") -> DataFrame:
    """Packets and bytes per stream and segment of fixed length; segments are anchored at origin, not at the epoch."""
    w = F.window("ts", length, startTime=origin)
    return stream.withWatermark("ts", late).groupBy("pid", w.alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes")).select("pid", F.col("w.start").alias("start"), "packets", "bytes")


def sessions(stream: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """Runs of packets without a gap as long as that."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("pid", w.alias("w")).agg(F.count(F.lit(1)).alias("packets")).select("pid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets")


def without_repeats(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First arrival of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def join_within(left: DataFrame, right: DataFrame, late: str, wait: str, how: str = "left_outer") -> DataFrame:
    """left (pid, ts, ...) with right (r_pid, r_ts, ...) of equal pid and r_ts in [ts, ts + wait]; a left row that finds none
    comes out alone once the watermark has passed."""
    on = F.expr(f"pid = r_pid AND r_ts >= ts AND r_ts <= ts + interval {wait}")
    return left.withWatermark("ts", late).join(right.withWatermark("r_ts", late), on, how)


def drain_join(left: DataFrame, right: DataFrame, late: str, wait: str, name: str) -> DataFrame:
    """`join_within` to the end of what there is now. left needs an event_id. Left rows that still wait for a match then find
    none, and so come out alone."""
    found = drain(join_within(left, right, late, wait, "left_outer"), name)
    waiting = drain(left, f"{name}-left").join(found.select("event_id").distinct(), "event_id", "left_anti")
    return found.unionByName(waiting, allowMissingColumns=True)


#: State of a reordered stream: the number that is due (-1 before any was given out), the highest number and the newest time so
#: far, and what waits: numbers and times.
_WAITING = "due long, top long, newest long, waiting array<long>, held array<long>"
#: Rows of one frame that is given out.
_FRAME = 1 << 16


def reorder(stream: DataFrame, most: int, delay_ms: int | None = None, arrival: Column | None = None) -> DataFrame:
    """pid, seq, ts, place in order of 16-bit seq, carried on over wraps: packets wait until they are next, or until `most` of
    their stream wait, or until the lowest is older by more than delay_ms than the newest arrival; then the lowest is given out
    and the gap counted as lost. The first number of a stream is the lowest of those that wait when one is first given out. Repeats and packets that are too late are dropped. Rows without seq or ts are dropped.

    arrival: the order in which a batch's packets came (whole numbers, nulls first; without it, ts), as a shuffle keeps none: one
    more than 32768 numbers from the highest so far would be taken for one of another turn. A task holds 24 bytes for each of a
    stream's packets in a batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, top, newest, waiting, held = state.get if state.exists else (-1, -1, 0, [], [])
        queue = dict(zip(waiting, held, strict=True))
        heap, out = list(queue), []
        heapq.heapify(heap)
        parts = [f[["came", "us", "seq"]].to_numpy(np.int64) for f in frames]
        rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        del parts
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))

        def given() -> pd.DataFrame:
            places, times = (np.array(x, np.int64) for x in zip(*out, strict=True))
            out.clear()
            return pd.DataFrame({"pid": pd.array([key[0]] * len(places), "Int64"), "seq": places % 65536, "us": times, "place": places})

        for first in range(0, len(order), _FRAME):
            _, times, numbers = rows[order[first : first + _FRAME]].T.tolist()
            for seq, us in zip(numbers, times, strict=True):
                near = top if top >= 0 else seq
                at = near + ((seq - near + 32768) % 65536) - 32768
                if at < due or at in queue:
                    continue
                queue[at] = us
                heapq.heappush(heap, at)
                top, newest = max(top, at), max(newest, us)
                while queue and (due in queue or len(queue) > most or delay_ms is not None and newest - queue[heap[0]] > 1000 * delay_ms):
                    at = heapq.heappop(heap)
                    out.append((at, queue.pop(at)))
                    due = at + 1
            if out:
                yield given()
        state.update((due, top, newest, list(queue), list(queue.values())))

    came = F.unix_micros("ts") if arrival is None else F.coalesce(arrival.cast("long"), F.lit(-(1 << 63)))
    whole = stream.where("seq is not null and ts is not null").select("pid", F.col("seq").cast("long").alias("seq"), F.unix_micros("ts").alias("us"), came.alias("came"))
    made = whole.groupBy("pid").applyInPandasWithState(run, "pid long, seq long, us long, place long", _WAITING, "append", GroupStateTimeout.NoTimeout)
    return made.select("pid", "seq", F.timestamp_micros("us").alias("ts"), "place")


def drain_reordered(stream: DataFrame, most: int, name: str, delay_ms: int | None = None, arrival: Column | None = None) -> DataFrame:
    """`reorder` to the end of what there is now; what then still waits is read from the stream's state and given out too."""
    spark = stream.sparkSession
    out, state = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    found = reorder(stream, most, delay_ms, arrival)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    given = spark.read.schema(found.schema).parquet(out)
    kept = spark.read.format("statestore").load(state).select(F.col("key.pid").cast("long").alias("pid"), F.col("value.groupState").alias("g"))
    rest = kept.select("pid", F.explode(F.arrays_zip("g.waiting", "g.held")).alias("w"))
    number = F.col("w.waiting")
    return given.unionByName(rest.select("pid", (number % 65536).alias("seq"), F.timestamp_micros("w.held").alias("ts"), number.alias("place")))
