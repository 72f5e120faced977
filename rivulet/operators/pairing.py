"""Joins between streams: on equal times, as of a time, and over ranges. All are equi-joins or scans, none lists all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.packets import chunk_of
from rivulet.operators.scan import ordered_fold, scan


def align_on_time(base: DataFrame, parts: dict[str, DataFrame], on: list[str], value: str) -> DataFrame:
    """base with one column for each part, found at equal times; a part that has none there is null."""
    for name, part in parts.items():
        base = base.join(part.select(*on, F.col(value).alias(name)), on, "left")
    return base


def gather_layers(df: DataFrame, at: list[str], layer: str, value: str) -> DataFrame:
    """One row per time with the layers' values in layer order. A time has as many entries as there are layers."""
    return df.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(layer).alias("l"), F.col(value).alias("v")))), lambda x: x["v"]).alias("layers"))


def as_of(left: DataFrame, right: DataFrame, value: str, forward: bool = False, tolerance: int | None = None, name: str = "matched", chunk: int | None = None) -> DataFrame:
    """left (pid, id, ts) with right's (pid, ts, value) at the nearest time at or before it (forward: at or after).

    Among right rows of equal time the largest value counts (forward: the smallest). No match, or one farther than
    tolerance: null. name and name_ts are added."""
    l = left.select("*", F.lit(None).cast("long").alias("_rt"), F.lit(None).cast(right.schema[value].dataType).alias("_rv"), F.lit(1 - 2 * forward).alias("_side"))
    keys = [c for c in left.columns if c not in ("pid", "ts")]
    r = right.select("pid", "ts", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in keys], F.col("ts").alias("_rt"), F.col(value).alias("_rv"), F.lit(0).alias("_side"))
    both = l.unionByName(r)
    pick = F.when(F.col("_side") == 0, F.struct(F.col("_rt").alias("t"), F.col("_rv").alias("v")))
    at = chunk_of(F.col("ts"), chunk) if chunk else chunk_of(F.col("ts"))
    order = ["ts", "_side", "_rv", *keys]
    found = scan(both, ["pid"], order, at, **({"nexts": {"_m": pick}} if forward else {"lasts": {"_m": pick}})).where("_side <> 0")
    near = F.lit(True) if tolerance is None else F.abs(F.col("_m.t") - F.col("ts")) <= tolerance
    return found.select(*left.columns, F.when(near, F.col("_m.v")).alias(name), F.when(near, F.col("_m.t")).alias(f"{name}_ts"))


def attach_captions(frames: DataFrame, captions: DataFrame, hold: int) -> DataFrame:
    """pid, id, ts, text of frames: each frame takes at most one caption, those at or before it in order; without a new one
    it repeats the last for `hold` ticks."""
    both = frames.select("pid", "ts", F.lit(1).alias("side"), "id", F.lit(None).cast("string").alias("text")).unionByName(captions.select("pid", "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), "text"))

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        queue, text, since = state
        if row["side"] == 0:
            return ((*queue, row["text"]), text, since), []
        if queue:
            text, since, queue = queue[0], row["ts"], queue[1:]
        elif since is not None and row["ts"] - since > hold:
            text = None
        return (queue, text, since), [{"pid": row["pid"], "id": row["id"], "ts": row["ts"], "text": text}]

    return ordered_fold(both, ["pid"], ["ts", "side", "id", "text"], lambda: ((), None, None), step, "pid long, id long, ts long, text string")


def clear_events(cues: DataFrame) -> DataFrame:
    """cues (pid, start, end, text) with an empty event at each end at which no cue starts. Gives pid, ts, text."""
    starts = cues.select("pid", F.col("start").alias("ts"), "text")
    ends = cues.select("pid", F.col("end").alias("ts")).distinct().join(starts.select("pid", "ts"), ["pid", "ts"], "left_anti")
    return starts.unionByName(ends.withColumn("text", F.lit("")))


def sample_at(times: DataFrame, samples: DataFrame) -> DataFrame:
    """times (pid, id, ts) with the sample (pid, ts, number) at or before; beyond a stream's last sample there is none."""
    last = samples.groupBy("pid").agg(F.max("ts").alias("_end"))
    return as_of(times, samples, "number", name="sample").join(last, "pid", "left").withColumn("sample", F.when(F.col("ts") <= F.col("_end"), F.col("sample"))).drop("_end", "sample_ts")


def sync_neighbours(df: DataFrame, order: list[str], number: str = "seq") -> DataFrame:
    """prev_sync and next_sync: numbers of the random-access packets around each packet, or its own where there is none."""
    own = F.when(F.col("sap") > 0, F.col(number))
    out = scan(df, ["pid"], order, chunk_of(F.col(order[0])), lasts={"prev_sync": own}, nexts={"next_sync": own})
    return out.withColumns({c: F.coalesce(c, number) for c in ("prev_sync", "next_sync")})


def on_segments(events: DataFrame, segment: int, origin: Column | int = 0) -> DataFrame:
    """events (pid, id, start, end) cut at a grid of `segment` ticks: one row per event and segment that it meets."""
    at = lambda x: F.floor((x - origin) / segment)
    rows = events.where("end > start").withColumn("seg", F.explode(F.sequence(at(F.col("start")), at(F.col("end") - 1))))
    low = origin + F.col("seg") * segment
    return rows.select("pid", "id", "seg", F.greatest("start", low).alias("start"), F.least("end", low + segment).alias("end"))


def fill_gaps(events: DataFrame, begin: int, finish: int, chunk: int) -> DataFrame:
    """Events (pid, start, end, id) and empty ones (id null) for every stretch of begin to finish that none covers."""
    rows = events.select("pid", "start", "end", "id")
    reach = scan(rows, ["pid"], ["start", "end", "id"], chunk_of(F.col("start"), chunk), before_max={"_reach": F.col("end")})
    before = reach.select("pid", F.coalesce("_reach", F.lit(begin)).alias("s"), F.col("start").alias("e"))
    after = rows.groupBy("pid").agg(F.max("end").alias("s")).withColumn("e", F.lit(finish).cast("long"))
    gaps = before.unionByName(after).where("s < e").select("pid", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(None).cast("long").alias("id"))
    return rows.unionByName(gaps)


def through_edits(times: DataFrame, edits: DataFrame) -> DataFrame:
    """times (pid, id, ts) on the media's own timeline. edits: pid, number, duration, media (-1: empty), rate (0: dwell),
    played one after another; a time beyond them, or in an empty edit, has no media time. A stream's edits are its own short
    list; the join is on pid and a scan finds the edit, so no pairs are listed."""
    placed = scan(edits, ["pid"], ["number"], F.lit(0), sums={"_end": F.col("duration")})
    placed = placed.select("pid", (F.col("_end") - F.col("duration")).alias("ts"), F.struct((F.col("_end") - F.col("duration")).alias("a"), F.col("_end").alias("b"), F.col("media").alias("m"), F.col("rate").alias("r")).alias("edit")).where("edit.b > edit.a")
    found = as_of(times, placed, "edit", name="edit")
    inside = (F.col("ts") < F.col("edit.b")) & (F.col("edit.m") >= 0)
    return found.select("pid", "id", "ts", F.when(inside, F.col("edit.m") + F.when(F.col("edit.r") == 0, 0).otherwise(F.col("ts") - F.col("edit.a"))).alias("media_ts"))


def utc_of(df: DataFrame, order: list[str]) -> DataFrame:
    """mapped: the packet's sender time, else its UTC, else the last known difference to ts carried on."""
    ts = order[0]
    own = F.coalesce(F.col("ntp_ms"), F.col("utc"))
    out = scan(df.withColumn("_shift", own - F.col(ts)), ["pid"], order, chunk_of(F.col(ts)), lasts={"_known": F.col("_shift")})
    return out.withColumn("mapped", F.coalesce(own, F.col("_known") + F.col(ts))).drop("_shift", "_known")


def remap_streams(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs the streams of a new source with existing outputs of the same type, first with first. One row per stream."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("stream_type").orderBy("pid"))
    o = old.select("stream_type", F.col("pid").alias("out_pid"), rank.alias("rank"))
    return new.select("stream_type", "pid", rank.alias("rank")).join(o, ["stream_type", "rank"], "left").drop("rank")
