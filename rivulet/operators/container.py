"""Tables of samples as containers index them: run-length times, chunks and offsets, fragments, segments, items, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.packets import chunk_of
from rivulet.operators.scan import count_marks, scan


def compact_times(df: DataFrame) -> DataFrame:
    """pid, run, delta, count from samples (pid, number, dur): equal neighbouring durations as one entry."""
    new = lambda a, b: F.when(a["d"] == b["d"], 0).otherwise(1)
    runs = count_marks(df, ["pid"], ["number"], chunk_of(F.col("number"), 100_000), {"d": F.col("dur")}, new, "run")
    return runs.groupBy("pid", "run", F.col("dur").alias("delta")).agg(F.count(F.lit(1)).alias("count"))


def expand_times(runs: DataFrame) -> DataFrame:
    """pid, number (from 0), ts, dur of every sample of a run-length table."""
    placed = scan(runs, ["pid"], ["run"], chunk_of(F.col("run"), 10_000), sums={"_n": F.col("count"), "_t": F.col("delta") * F.col("count")})
    rows = placed.where("count > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))))
    return rows.select("pid", (F.col("_n") - F.col("count") + F.col("_i")).alias("number"), (F.col("_t") - F.col("delta") * F.col("count") + F.col("delta") * F.col("_i")).alias("ts"), F.col("delta").alias("dur"))


def remove_samples(samples: DataFrame, gone: DataFrame) -> DataFrame:
    """samples (pid, number, ...) without those of gone (pid, number), numbered anew from 0."""
    left = samples.join(gone, ["pid", "number"], "left_anti")
    out = scan(left, ["pid"], ["number"], chunk_of(F.col("number"), 100_000), sums={"_n": F.lit(1)})
    return out.withColumn("number", F.col("_n") - 1).drop("_n")


def update_samples(samples: DataFrame, updates: DataFrame, *columns: str) -> DataFrame:
    """Values of updates (pid, number, columns) in place of the samples' own, where they are given."""
    new = updates.select("pid", "number", *[F.col(c).alias(f"_{c}") for c in columns])
    return samples.join(new, ["pid", "number"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def sample_offsets(samples: DataFrame, per_chunk: int) -> DataFrame:
    """chunk and offset of each sample: chunks hold per_chunk samples and follow on, samples follow on within them."""
    out = scan(samples, ["pid"], ["number"], chunk_of(F.col("number"), 100_000), sums={"_end": F.col("size")})
    return out.withColumn("chunk", F.floor(F.col("number") / per_chunk)).withColumn("offset", F.col("_end") - F.col("size")).drop("_end")


def merge_fragments(rows: DataFrame, fragment: DataFrame, track: DataFrame, *columns: str) -> DataFrame:
    """Samples of fragments with their defaults: the row's own value, else the fragment's, else the track's; and start,
    the sum of durations before. rows: pid, frag, number, columns (with dur); fragment: pid, frag, columns; track: pid, columns."""
    f = fragment.select("pid", "frag", *[F.col(c).alias(f"_f_{c}") for c in columns])
    t = track.select("pid", *[F.col(c).alias(f"_t_{c}") for c in columns])
    full = rows.join(f, ["pid", "frag"], "left").join(t, "pid", "left").withColumns({c: F.coalesce(c, f"_f_{c}", f"_t_{c}") for c in columns}).drop(*[f"_{s}_{c}" for s in "ft" for c in columns])
    out = scan(full, ["pid"], ["number"], chunk_of(F.col("number"), 100_000), sums={"_end": F.col("dur")})
    return out.withColumn("start", F.col("_end") - F.col("dur")).drop("_end")


def segments(df: DataFrame, ticks: int, at_sap: bool = True, order: list[str] | None = None) -> DataFrame:
    """segment: with at_sap a new one begins at the first random-access packet at or beyond each multiple of `ticks` since
    the stream's start; else it is the number of that multiple."""
    order = order or ["cts", "event_id"]
    begin = df.groupBy(F.col("pid").alias("_p")).agg(F.min(order[0]).alias("_b"))
    placed = df.join(begin, F.col("pid").eqNullSafe(F.col("_p"))).withColumn("_due", F.floor((F.col(order[0]) - F.col("_b")) / ticks)).drop("_p", "_b")
    if not at_sap:
        return placed.withColumnRenamed("_due", "segment")
    due = F.when(F.col("sap") > 0, F.col("_due"))
    out = scan(placed, ["pid"], order, chunk_of(F.col(order[0])), before_max={"_done": due})
    cut = F.when(due > F.coalesce("_done", F.lit(0)), 1).otherwise(0)
    return scan(out.withColumn("_cut", cut), ["pid"], order, chunk_of(F.col(order[0])), sums={"segment": F.col("_cut")}).drop("_due", "_done", "_cut")


def segment_index(df: DataFrame) -> DataFrame:
    """One row per segment: start, duration, bytes, packets, and whether it starts with a random-access packet."""
    starts = F.min_by("sap", F.struct("cts", "event_id"))
    return df.groupBy("pid", "segment").agg(F.min("cts").alias("start"), (F.max(F.col("cts") + F.col("dur")) - F.min("cts")).alias("duration"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("packets"), (starts > 0).alias("starts_with_sap"))


def items(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Items with how often others refer to them: (item_id, ...) and references (from_id, to_id)."""
    n = refs.groupBy(F.col("to_id").alias("item_id")).agg(F.count(F.lit(1)).alias("referred"))
    return pages.join(n, "item_id", "left").withColumn("referred", F.coalesce("referred", F.lit(0)))


def tile_rates(df: DataFrame, tiles: int, base: int = 10_000) -> DataFrame:
    """One row per tile of each stream (pid, bandwidth), tile 0 the base: the rest is shared evenly."""
    t = df.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles))))
    return t.withColumn("rate", F.when(F.col("tile") == 0, base).otherwise(F.expr(f"(bandwidth - {base}) div {tiles}")))


def override(df: DataFrame, **values: Column | int) -> DataFrame:
    """Sets metadata columns; the number -1 keeps what is there."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items() if isinstance(v, Column) or v != -1})


def retrack(df: DataFrame, order: list[str]) -> DataFrame:
    """Streams numbered anew from 1, in the order given. One row per stream is ranked, and joined back."""
    rank = F.row_number().over(Window.partitionBy("stream_type").orderBy(*order))
    return df.withColumn("track", rank)


def chapters(text: DataFrame) -> DataFrame:
    """pid, number, start (ms), name of chapter lists: lines `hh:mm:ss[.mmm] name`."""
    from rivulet.functions.timeline import parse_clock

    lines = text.select("pid", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"^\d+:\d{2}:\d{2}"))).alias("number", "line"))
    at = F.regexp_extract("line", r"^(\S+)", 1)
    at = F.when(at.contains("."), at).otherwise(F.concat(at, F.lit(".000")))
    return lines.select("pid", "number", parse_clock(at).alias("start"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("name"))


def insert_samples(samples: DataFrame, new: DataFrame) -> DataFrame:
    """samples with new ones (pid, number, ...) put in before the sample of their number (beyond the last: behind it), all
    numbered anew from 0. Several new ones at a number keep the order of `place`, if they have it."""
    place = F.col("place") if "place" in new.columns else F.lit(0)
    both = samples.withColumn("_new", F.lit(1)).withColumn("_place", F.lit(0)).unionByName(new.withColumn("_place", place).drop("place").withColumn("_new", F.lit(0)), allowMissingColumns=True)
    out = scan(both, ["pid"], ["number", "_new", "_place"], chunk_of(F.col("number"), 100_000), sums={"_n": F.lit(1)})
    return out.withColumn("number", F.col("_n") - 1).drop("_n", "_new", "_place")


def shadowed(samples: DataFrame, shadows: DataFrame, *columns: str) -> DataFrame:
    """Columns of each sample from the random-access sample that stands in for it (pid, number, shadow), as shadow_<column>."""
    there = samples.select("pid", F.col("number").alias("shadow"), *[F.col(c).alias(f"shadow_{c}") for c in columns])
    return samples.join(shadows, ["pid", "number"], "left").join(there, ["pid", "shadow"], "left")


def storage_offsets(samples: DataFrame, interleave: int | None = None) -> DataFrame:
    """Byte offset of each sample (pid, number, cts, size) in a file. Flat: track after track; interleaved: tracks take turns
    every `interleave` ticks. Running sums go over chunks of tracks or of turns, so no task holds the file."""
    turn = F.lit(0) if interleave is None else F.floor(F.col("cts") / interleave)
    one = samples.withColumn("_file", F.lit(0)).withColumn("_turn", turn)
    chunk = F.floor(F.col("pid") / 16) if interleave is None else F.col("_turn")
    out = scan(one, ["_file"], ["_turn", "pid", "number"], chunk, sums={"_end": F.col("size")})
    return out.withColumn("offset", F.col("_end") - F.col("size")).drop("_file", "_turn", "_end")


def change_items(items_of: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Items (item_id, ...) without those of gone (item_id), and with new ones in place of any of the same id."""
    left = items_of.join(gone.select("item_id").unionByName(new.select("item_id")), "item_id", "left_anti")
    return left.unionByName(new, allowMissingColumns=True)


def primary_item(items_of: DataFrame, item_id: int) -> DataFrame:
    return items_of.withColumn("is_primary", F.col("item_id") == item_id)


def item_groups(items_of: DataFrame, kind: Column) -> DataFrame:
    """group, members and the least item of each group of items."""
    return items_of.groupBy(kind.alias("group")).agg(F.count(F.lit(1)).alias("members"), F.min("item_id").alias("first"))
