"""Row filters over packets: random-access types, references, frame lists, time ranges and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators.scan import scan


def keep_saps(df: DataFrame, *types: int) -> DataFrame:
    return df.where(F.col("sap").isin(*types))


def keep_references(df: DataFrame, flag: str = "depended_on") -> DataFrame:
    return df.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def keep_frames(df: DataFrame, *frames: int, index: str = "seq") -> DataFrame:
    """A positive number v keeps the v-th packet of each stream (from 1); -k keeps every k-th from the first. With
    positive numbers alone nothing after the largest is read from sorted inputs."""
    wanted, every = [v - 1 for v in frames if v > 0], [-v for v in frames if v < 0]
    test = F.col(index).isin(*wanted) if wanted else F.lit(False)
    for k in every:
        test = test | (F.col(index) % k == 0)
    return df.where(test) if every or not wanted else df.where(F.col(index) <= max(wanted)).where(test)


def in_range(df: DataFrame, start: int, end: int, ts: str = "cts") -> DataFrame:
    """Packets that neither begin before start nor end after end."""
    t = F.col(ts)
    return df.where((t >= start) & (t + F.col("dur") <= end))


def seek_range(df: DataFrame, start: int, end: int, ts: str = "cts") -> DataFrame:
    """Packets that overlap the range: skip_begin is what a player skips of the first, dur is trimmed at the end."""
    t, d = F.col(ts), F.col("dur")
    inside = df.where((t + d > start) & (t < end))
    return inside.withColumn("skip_begin", F.greatest(F.lit(start) - t, F.lit(0))).withColumn("dur", F.least(d, F.lit(end) - t))


def slice_rows(df: DataFrame, first: int, last: int, index: str = "seq") -> DataFrame:
    """Packets number first to last (from 1) of each stream."""
    return df.where(F.col(index).between(first - 1, last - 1))


def first_ticks(df: DataFrame, ticks: int, ts: str = "cts") -> DataFrame:
    """The first `ticks` of each stream, measured from its first packet. The starts are one row a stream."""
    begin = df.groupBy(F.col("pid").alias("_pid")).agg(F.min(ts).alias("_begin"))
    return df.join(begin, F.col("pid").eqNullSafe(F.col("_pid"))).where(F.col(ts) - F.col("_begin") <= ticks).select(*df.columns)


def layers_up_to(df: DataFrame, most: int, layer: str = "layer") -> DataFrame:
    return df.where(F.col(layer) <= most)


def indexed(df: DataFrame, chunk: Column, order: list[str], name: str = "seq") -> DataFrame:
    """A 0-based number within each stream."""
    out = scan(df, ["pid"], order, chunk, sums={"_n": F.lit(1)})
    return out.withColumn(name, F.col("_n") - 1).drop("_n")


def forward(df: DataFrame, protected: bool | None = None, most: int | None = None, flag: str = "encrypted", layer: str = "layer") -> DataFrame:
    """Packets that are protected (False: clear ones; None: both), and of layers up to `most`. A null flag counts as clear."""
    out = df if protected is None else df.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) == protected)
    return out if most is None else layers_up_to(out, most, layer)


def split_layers(df: DataFrame, layer: str = "layer", step: int = 1000) -> DataFrame:
    """Each layer as a stream of its own: number pid * step + layer."""
    return df.withColumn("pid", F.col("pid") * step + F.col(layer))
