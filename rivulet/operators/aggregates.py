"""Aggregates over packets: counters, rates, reassembly, digests, loss and jitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.packets import chunk_of
from rivulet.operators.scan import ordered_fold, scan


def counters(df: DataFrame, *by: str) -> DataFrame:
    """Packets, bytes, span, and average rates per second of time covered (ticks are ms). Partial sums come first."""
    span = F.max(F.col("cts") + F.col("dur")) - F.min("cts")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.min("cts").alias("first_cts"), F.max(F.col("cts") + F.col("dur")).alias("end_cts"), span.alias("_span"))
    seconds = F.nullif(F.col("_span"), F.lit(0))
    return out.withColumn("packet_rate", F.round(F.col("packets") * 1000.0 / seconds, 4)).withColumn("bit_rate", F.round(F.col("bytes") * 8000.0 / seconds, 4)).drop("_span")


def bit_rates(df: DataFrame, window_ms: int) -> DataFrame:
    """avg_rate and max_rate in bits a second over tumbling windows in which a stream has packets."""
    per = df.groupBy("pid", F.floor(F.col("cts") / window_ms).alias("w")).agg((F.sum("size") * 8000 / window_ms).alias("rate"))
    return per.groupBy("pid").agg(F.round(F.avg("rate"), 4).alias("avg_rate"), F.round(F.max("rate"), 4).alias("max_rate"), F.count(F.lit(1)).alias("windows"))


def reassemble(df: DataFrame, *by: str) -> DataFrame:
    """Blocks from their parts (part, payload, cts, dur, byte_offset, flags): payload in order, largest times, all flags; the
    offset of the first part if the parts follow on without a gap, else null. A block is one packet, and so is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("part", "payload", "byte_offset")))
    out = df.groupBy(*by).agg(parts.alias("_p"), F.max("cts").alias("cts"), F.max("dur").alias("dur"), F.bit_or("flags").alias("flags"))
    follows = F.forall(F.sequence(F.lit(1), F.size("_p")), lambda i: (i == 1) | (F.get("_p", i - 1)["byte_offset"] == F.get("_p", i - 2)["byte_offset"] + F.length(F.get("_p", i - 2)["payload"])))
    payload = F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["payload"]))
    return out.select(*by, payload.alias("payload"), "cts", "dur", "flags", F.when(follows, F.get("_p", F.lit(0))["byte_offset"]).alias("byte_offset"))


def constant_or_zero(c: str) -> Column:
    """The value if all rows share it, else 0: the default of a fragment."""
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0)


def fragments(df: DataFrame, *by: str) -> DataFrame:
    """Index rows of fragments: defaults, total duration, earliest time, end of the first random-access packet, counts."""
    first_sap = F.min_by(F.col("cts") + F.col("dur"), F.when(F.col("sap") > 0, F.col("cts")))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.sum("dur").alias("duration"), F.min("cts").alias("earliest"), first_sap.alias("first_sap_end"), constant_or_zero("dur").alias("default_dur"), constant_or_zero("size").alias("default_size"), F.count_if(F.col("sap") > 0).alias("saps"))


def least_duration(df: DataFrame, order: list[str]) -> DataFrame:
    """least_dur: shortest positive duration of the stream's packets before this one."""
    out = scan(df, ["pid"], order, chunk_of(F.col(order[0])), before_max={"_m": F.when(F.col("dur") > 0, -F.col("dur"))})
    return out.withColumn("least_dur", -F.col("_m")).drop("_m")


def block_digests(df: DataFrame, block: Column, value: Column, order: list[str]) -> DataFrame:
    """pid, block, sha1 of a block's values on end, in order. Blocks are bounded by the caller (as by number of packets)."""
    out = df.select("pid", block.alias("block"), F.struct(*order, value.alias("v")).alias("s"))
    return out.groupBy("pid", "block").agg(F.sha1(F.concat_ws("", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]))).alias("digest"))


def stream_digests(blocks: DataFrame) -> DataFrame:
    """pid, sha1 over its blocks' digests in order: one digest of a stream of any length, from digests of its blocks."""
    return blocks.groupBy("pid").agg(F.sha1(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda s: s["digest"]))).alias("digest"), F.count(F.lit(1)).alias("blocks"))


def losses(df: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """pid, received, lost: 16-bit sequence numbers missing between neighbours; repeats and late ones count as none."""
    near = scan(df, ["pid"], order, chunk_of(F.col(order[0])), lags={"_was": F.col(seq)})
    gap = F.pmod(F.col(seq) - F.col("_was"), F.lit(65536)) - 1
    return near.groupBy("pid").agg(F.count(F.lit(1)).alias("received"), F.coalesce(F.sum(F.when(gap.between(0, 32767), gap)), F.lit(0)).alias("lost"))


def jitter(df: DataFrame, order: list[str]) -> DataFrame:
    """pid, jitter: interarrival jitter after the last packet; each moves the estimate a sixteenth toward its difference in
    transit time, in whole numbers."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        _, last, j = state
        transit = row["arrival"] - row["ts"]
        if last is not None:
            j += abs(transit - last) - ((j + 8) >> 4)
        return (row["pid"], transit, j), []

    return ordered_fold(df.select("pid", *order, *[c for c in ("arrival", "ts") if c not in order]), ["pid"], order, lambda: (None, None, 0), step, "pid long, jitter long", lambda s: [{"pid": s[0], "jitter": s[2] >> 4}])


def manifest(df: DataFrame) -> DataFrame:
    """period with its sets, each with its qualities: nested from rows (period, set, quality, bandwidth). Each level is a
    presentation's own short list."""
    q = df.groupBy("period", "set").agg(F.array_sort(F.collect_list(F.struct("bandwidth", "quality"))).alias("qualities"))
    return q.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("set", "qualities"))).alias("sets"))


def best_quality(df: DataFrame, rate: Column, *by: str) -> DataFrame:
    """The quality of highest bandwidth within the rate, or the lowest of all if none is."""
    fits = F.max_by("quality", F.when(F.col("bandwidth") <= rate, F.struct("bandwidth", "quality")))
    return df.groupBy(*by).agg(F.coalesce(fits, F.min_by("quality", F.struct("bandwidth", "quality"))).alias("chosen"))


def next_quality(df: DataFrame, order: list[str], reserve: int, cushion: int) -> DataFrame:
    """rate_cap: share of the highest bandwidth that a buffer level allows: 0 up to reserve, all from reserve + cushion on."""
    return df.withColumn("rate_cap", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("buffer") - reserve) / cushion)))


def mix(df: DataFrame, at: str, value: str) -> DataFrame:
    """Sum of the streams' values at each time: partial sums first, whatever the number of streams."""
    return df.groupBy(at).agg(F.round(F.sum(value), 4).alias("mixed"), F.count_distinct("pid").alias("streams"))


def kinds(df: DataFrame, kind: str, size: str) -> DataFrame:
    """Count and total size by kind."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("count"), F.sum(size).alias("total"))


def latest_start(df: DataFrame) -> DataFrame:
    """The largest first time of all streams in seconds: where streams of different timescales can start together."""
    starts = df.groupBy("pid").agg(F.min(F.col("ts") / F.col("timescale")).alias("s"))
    return starts.agg(F.round(F.max("s"), 6).alias("start"))


def ranked_last(df: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    """The n last rows of each group by order. Windows with a row_number limit keep n rows per task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def count_value(df: DataFrame, column: str, value: object, *by: str) -> DataFrame:
    """How many rows of each group hold a value."""
    return df.groupBy(*by).agg(F.count_if(F.col(column).eqNullSafe(F.lit(value))).alias("count"))


def durations(df: DataFrame, ts: str = "cts") -> DataFrame:
    """pid, duration of each stream (its last end, from its first packet), and total, the longest of all."""
    per = df.groupBy("pid").agg((F.max(F.col(ts) + F.col("dur")) - F.min(ts)).alias("duration"))
    longest = per.agg(F.max("duration").alias("total"))  # one row
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(longest.withColumn("_one", F.lit(1))), "_one").drop("_one")


def field_statistics(df: DataFrame, props: str) -> DataFrame:
    """field, rows, distinct values and longest value of all fields of a property map."""
    each = df.select(F.explode(props).alias("field", "value"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("values"), F.max(F.length("value")).alias("longest"))


def gather_objects(parts: DataFrame) -> DataFrame:
    """One row per object (tsi, toi) from its parts (first, data, total), in any order and as often as they come: received
    bytes, complete, and data if complete. Repeats are skipped; parts that overlap others otherwise make it incomplete. An
    object is one file, and so is bounded."""
    once = parts.groupBy("tsi", "toi", "first").agg(F.first("data").alias("data"), F.max("total").alias("total"))
    rows = F.array_sort(F.collect_list(F.struct("first", "data")))
    found = once.groupBy("tsi", "toi").agg(rows.alias("parts"), F.max("total").alias("total"), F.sum(F.length("data")).alias("received"))
    end = F.aggregate("parts", F.lit(0).cast("long"), lambda at, p: F.when(p["first"].cast("long") == at, at + F.length(p["data"])).otherwise(F.lit(-1).cast("long")))
    complete = F.coalesce(end == F.col("total"), F.lit(False))
    data = F.aggregate("parts", F.lit(b""), lambda d, p: F.concat(d, p["data"]))
    return found.select("tsi", "toi", "received", complete.alias("complete"), F.when(complete, data).alias("data"))


def walk_manifest(periods: DataFrame, segment: int) -> DataFrame:
    """Segments of a presentation's periods (pid, period, duration) in order: number within the period, start on the
    presentation's own time, and duration (the last of a period may be shorter)."""
    placed = scan(periods, ["pid"], ["period"], F.floor(F.col("period") / 1000), sums={"_end": F.col("duration")})
    n = F.ceil(F.col("duration") / segment)
    rows = placed.where("duration > 0").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    own = F.col("number") * segment
    return rows.select("pid", "period", "number", (F.col("_end") - F.col("duration") + own).alias("start"), F.least(F.lit(segment), F.col("duration") - own).alias("duration"))
