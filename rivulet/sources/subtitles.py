"""Subtitle and playlist texts as rows, and rows as such texts.

A text is one file: it is taken apart by column functions in the task that holds it, and put together from its own cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import escape_entities, unescape_entities
from rivulet.functions.timeline import clock, parse_clock

_BLANK = r"\n[ \t]*\n\s*"
_LINE = r"((?:\d+:)?\d{1,2}:\d{2}[,.]\d{3})[ \t]*-->[ \t]*((?:\d+:)?\d{1,2}:\d{2}[,.]\d{3})[ \t]*([^\n]*)\n?"


def _blocks(text: str) -> Column:
    clean = F.replace(F.regexp_replace(F.col(text), "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.split(F.trim(clean), _BLANK), lambda b: b.rlike(r"-->"))


def _cues(df: DataFrame, text: str) -> DataFrame:
    rows = df.select("pid", F.posexplode(_blocks(text)).alias("number", "block"))
    got = lambda i: F.regexp_extract("block", _LINE, i)
    body = F.regexp_replace(F.col("block"), rf"(?s)^.*?{_LINE}", "")
    return rows.where(F.col("block").rlike(_LINE)).select("pid", F.col("number").cast("long").alias("number"), parse_clock(got(1)).alias("start"), parse_clock(got(2)).alias("end"), got(3).alias("settings"), F.regexp_replace(body, r"\s+\z", "").alias("text"))


def read_srt(df: DataFrame, text: str = "text") -> DataFrame:
    """pid, number, start, end (ms), text; style tags are kept in text."""
    return _cues(df, text).drop("settings")


def read_vtt(df: DataFrame, text: str = "text") -> DataFrame:
    """pid, number, start, end, settings, text; header, notes, styles and regions are passed over."""
    return _cues(df, text)


def strip_tags(text: Column) -> Column:
    """Without <i>, {\\an8} and the like."""
    return F.regexp_replace(text, r"<[^>]*>|\{\\[^}]*\}", "")


def read_sub(df: DataFrame, fps: float = 25.0, text: str = "text") -> DataFrame:
    """Lines {start frame}{end frame}text, `|` for line ends."""
    rows = df.select("pid", F.posexplode(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\{\d+\}\{\d+\}"))).alias("number", "line"))
    ms = lambda i: F.floor(F.regexp_extract("line", r"^\{(\d+)\}\{(\d+)\}", i).cast("long") * 1000 / fps)
    return rows.select("pid", F.col("number").cast("long").alias("number"), ms(1).alias("start"), ms(2).alias("end"), F.replace(F.regexp_replace("line", r"^\{\d+\}\{\d+\}", ""), F.lit("|"), F.lit("\n")).alias("text"))


def read_ssa(df: DataFrame, text: str = "text") -> DataFrame:
    """Dialogue lines: times h:mm:ss.cc, the text after the ninth comma, \\N for line ends, style overrides dropped."""
    rows = df.select("pid", F.posexplode(F.filter(F.split(text, r"\r?\n"), lambda x: x.startswith("Dialogue:"))).alias("number", "line"))
    part = F.split(F.regexp_replace("line", r"^Dialogue:\s*", ""), ",", 10)
    ms = lambda i: parse_clock(F.concat(F.trim(F.get(part, F.lit(i))), F.lit("0")))
    return rows.select("pid", F.col("number").cast("long").alias("number"), ms(1).alias("start"), ms(2).alias("end"), F.regexp_replace(F.regexp_replace(F.get(part, F.lit(9)), r"\{[^}]*\}", ""), r"\\[Nn]", "\n").alias("text"))


def read_ttml(df: DataFrame, text: str = "text") -> DataFrame:
    """<p begin end>: clock times or seconds (1.5s), <br/> for line ends, entities resolved."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<(?:\w+:)?p\b[^>]*>.*?</(?:\w+:)?p>"), F.lit(0))
    rows = df.select("pid", F.posexplode(parts).alias("number", "p"))

    def ms(name: str) -> Column:
        v = F.regexp_extract("p", rf'\b{name}="([^"]*)"', 1)
        return F.when(v.rlike(r"^\d+(\.\d+)?s$"), F.round(F.when(v.rlike(r"^\d+(\.\d+)?s$"), F.rtrim(v, F.lit("s"))).cast("double") * 1000).cast("long")).otherwise(parse_clock(v))

    body = F.regexp_replace(F.regexp_replace("p", r"<(?:\w+:)?br\s*/>", "\n"), r"<[^>]*>", "")
    end = F.coalesce(ms("end"), ms("begin") + ms("dur"))
    return rows.select("pid", F.col("number").cast("long").alias("number"), ms("begin").alias("start"), end.alias("end"), unescape_entities(body).alias("text"))


def _gathered(cues: DataFrame, one: Column, between: str) -> Column:
    """A file's cues in order, as one text: a file is one reader's, and so bounded."""
    return F.concat_ws(between, F.transform(F.array_sort(F.collect_list(F.struct("start", "number", one.alias("t")))), lambda c: c["t"]))


def srt_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat((number + 1).cast("string"), F.lit("\n"), clock(start, ","), F.lit(" --> "), clock(end, ","), F.lit("\n"), text, F.lit("\n"))


def vtt_cue(start: Column, end: Column, text: Column) -> Column:
    return F.concat(clock(start), F.lit(" --> "), clock(end), F.lit("\n"), text, F.lit("\n"))


def ttml_cue(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit('<p begin="'), clock(start), F.lit('" end="'), clock(end), F.lit('">'), F.replace(escape_entities(text), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))


def write_srt(cues: DataFrame) -> DataFrame:
    """pid, text: one file per stream, from cues (pid, number, start, end, text)."""
    c = F.col
    return cues.groupBy("pid").agg(_gathered(cues, srt_cue(c("number"), c("start"), c("end"), c("text")), "\n").alias("text"))


def write_vtt(cues: DataFrame) -> DataFrame:
    c = F.col
    return cues.groupBy("pid").agg(F.concat(F.lit("WEBVTT\n\n"), _gathered(cues, vtt_cue(c("start"), c("end"), c("text")), "\n")).alias("text"))


def write_ttml(cues: DataFrame) -> DataFrame:
    """All cues of a stream in one document; documents of one stream are merged so."""
    c = F.col
    return cues.groupBy("pid").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml"><body><div>'), _gathered(cues, ttml_cue(c("start"), c("end"), c("text")), ""), F.lit("</div></body></tt>")).alias("text"))


def attributes(line: Column) -> Column:
    """Attribute list NAME=value,NAME="quoted, value" as a map."""
    parts = F.regexp_extract_all(line, F.lit(r'([A-Z0-9-]+)=("[^"]*"|[^",]*)'), F.lit(0))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.btrim(F.regexp_replace(p, "^[^=]*=", ""), F.lit('"')).alias("v"))))


def read_playlist(df: DataFrame, text: str = "text") -> DataFrame:
    """pid, number, kind (`segment` or `variant`), uri, duration (s), attributes of playlists, master or media."""
    flat = F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"(?m)^\s*$\n?", "")
    pairs = F.regexp_extract_all(flat, F.lit(r"(?m)^#EXT(?:INF|-X-STREAM-INF):[^\n]*\n(?:#[^\n]*\n)*[^#\n][^\n]*"), F.lit(0))
    rows = df.select("pid", F.posexplode(pairs).alias("number", "pair"))
    variant = F.col("pair").startswith("#EXT-X-STREAM-INF")
    seconds = F.regexp_extract("pair", r"^#EXTINF:([0-9.]+)", 1)
    return rows.select("pid", F.col("number").cast("long").alias("number"), F.when(variant, "variant").otherwise("segment").alias("kind"), F.substring_index("pair", "\n", -1).alias("uri"), F.when(seconds != "", seconds).cast("double").alias("duration"), F.when(variant, attributes(F.regexp_replace(F.substring_index("pair", "\n", 1), "^[^:]*:", ""))).alias("attributes"))


def write_playlist(segments: DataFrame) -> DataFrame:
    """pid, text of media playlists from segments (pid, number, start, duration ms, uri)."""
    one = F.concat(F.lit("#EXTINF:"), F.format_string("%d.%03d", F.floor(F.col("duration") / 1000), F.col("duration") % 1000), F.lit(",\n"), F.col("uri"), F.lit("\n"))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:"), F.ceil(F.max("duration") / 1000).cast("string"), F.lit("\n"))
    return segments.groupBy("pid").agg(F.concat(head, _gathered(segments, one, ""), F.lit("#EXT-X-ENDLIST\n")).alias("text"))


def event_stream(df: DataFrame, text: str = "text") -> DataFrame:
    """pid, presentation_time, duration, id, message of <Event> elements of a manifest."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<Event\b[^>]*(?:/>|>.*?</Event>)"), F.lit(0))
    rows = df.select("pid", F.explode(parts).alias("e"))
    n = lambda name: F.expr(f"try_cast(regexp_extract(e, '\\\\b{name}=\"([0-9]+)\"', 1) as bigint)")
    return rows.select("pid", n("presentationTime").alias("presentation_time"), n("duration").alias("duration"), n("id").alias("id"), F.trim(unescape_entities(F.regexp_replace("e", r"<[^>]*>", ""))).alias("message"))


def cue_samples(cues: DataFrame) -> DataFrame:
    """Samples that follow on without overlapping, from cues (pid, number, start, end, text) that may overlap: one for each span
    between neighbouring starts and ends, with the texts of all cues shown then, in order; empty where there is none. A file's
    cues are one reader's, and so bounded."""
    gathered = cues.where("start < end").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("start", "number", "end", "text"))).alias("cues"))
    times = F.array_sort(F.array_distinct(F.flatten(F.transform("cues", lambda c: F.array(c["start"], c["end"])))))
    spans = gathered.withColumn("times", times).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("times") - 2)))
    at, until = F.get("times", F.col("i")), F.get("times", F.col("i") + 1)
    shown = F.transform(F.filter("cues", lambda c: (c["start"] <= at) & (c["end"] > at)), lambda c: c["text"])
    return spans.select("pid", at.alias("start"), until.alias("end"), F.concat_ws("\n", shown).alias("text"))
