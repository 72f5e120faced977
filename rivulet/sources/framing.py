"""Byte streams as access units: fixed frames, transport packets, start codes, sync words and length prefixes.

All framings are column expressions over a binary column: frames are found where the bytes are, without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.binary import pack_uint, read_bits, read_uint


def fixed_frames(df: DataFrame, size: int, num: int, den: int, timescale: int) -> DataFrame:
    """pid, frame, cts, data: slices of `size` bytes (the last may be shorter) at num/den a second."""
    n = F.ceil(F.length("data") / size).cast("int")
    rows = df.where(F.length("data") > 0).select("pid", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"))
    return rows.select("pid", "frame", F.expr(f"frame * cast({den} * {timescale} as bigint) div {num}").alias("cts"), F.substring("data", F.col("frame") * size + 1, F.lit(size)).alias("data"))


def pcm_frames(df: DataFrame, samples: int, channels: int, bytes_per_sample: int, rate: int, timescale: int) -> DataFrame:
    """Slices of `samples` samples of raw audio."""
    return fixed_frames(df, samples * channels * bytes_per_sample, rate, samples, timescale)


def transport_packets(df: DataFrame, size: int = 188) -> DataFrame:
    """pid, number, stream (13 bits), start, counter, clock (27 MHz, null if none) of transport packets with their sync byte."""
    rows = fixed_frames(df, size, 1, 1, 1).where(F.length("data") == size)
    d = F.col("data")
    has_field = (read_bits(d, 26, 1) == 1) & (read_uint(d, 4, 1) > 6) & (read_bits(d, 43, 1) == 1)
    clock = F.when(has_field, read_bits(d, 48, 33) * 300 + read_bits(d, 87, 9))
    return rows.where(read_uint(d, 0, 1) == 0x47).select("pid", F.col("frame").alias("number"), read_bits(d, 11, 13).alias("stream"), (read_bits(d, 9, 1) == 1).alias("start"), read_bits(d, 28, 4).alias("counter"), clock.alias("clock"))


def start_code_units(data: Column) -> Column:
    """Hex texts of the units between start codes 000001 or 00000001."""
    # a code's hex digits are sought at even places only
    spaced = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    return F.transform(F.filter(F.split(spaced, "(?:00 )?00 00 01 "), lambda u: u != ""), lambda u: F.replace(u, F.lit(" "), F.lit("")))


def length_prefixed(units: Column, size: int = 4) -> Column:
    """Units (hex) on end, each after its length: the form inside files."""
    one = lambda u: F.concat(pack_uint((F.length(u) / 2).cast("long"), size), F.unhex(u))
    return F.aggregate(F.transform(units, one), F.lit(b""), lambda a, x: F.concat(a, x))


def with_start_codes(units: Column) -> Column:
    return F.unhex(F.concat_ws("", F.transform(units, lambda u: F.concat(F.lit("00000001"), u))))


#: Sampling rates by their index in headers of raw audio frames (fixed values).
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def adts_header(data: Column) -> Column:
    """struct(rate, channels, size) of a frame header with sync word FFF; null if there is none."""
    rate = F.get(F.array(*map(F.lit, ADTS_RATES)), read_bits(data, 18, 4).cast("int"))
    return F.when(read_bits(data, 0, 12) == 0xFFF, F.struct(rate.alias("rate"), read_bits(data, 23, 3).alias("channels"), read_bits(data, 30, 13).alias("size")))


def adts_wrap(data: Column, rate: int, channels: int) -> Column:
    """A raw frame after its 7-byte header."""
    size = F.length(data) + 7
    head = (0xFFF1 << 40) | (1 << 38) | (ADTS_RATES.index(rate) << 34) | (channels << 30)
    return F.concat(pack_uint(F.lit(head).cast("long").bitwiseOR(F.shiftleft(size.cast("long"), 13)).bitwiseOR(F.lit(0x1FFC).cast("long")), 7), data)


def image_header(data: Column) -> Column:
    """struct(format, width, height) of PNG, BMP and GIF files; null for others."""
    h = F.hex(F.substring(data, 1, 8))
    made = lambda name, w, ht: F.struct(F.lit(name).alias("format"), w.alias("width"), ht.alias("height"))
    return (
        F.when(h == "89504E470D0A1A0A", made("png", read_uint(data, 16, 4), read_uint(data, 20, 4)))
        .when(h.startswith("424D"), made("bmp", read_uint(data, 18, 4, True), read_uint(data, 22, 4, True)))
        .when(h.startswith("474946"), made("gif", read_uint(data, 6, 2, True), read_uint(data, 8, 2, True)))
    )
