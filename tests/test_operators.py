"""Operators on small literal tables: fixed expectations and properties."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.functions import binary, props, text, timeline
from rivulet.operators import concat, container, pairing, windows
from rivulet.operators.scan import scan
from rivulet.plans.pipeline import Pipeline, inspect
from rivulet.sources import framing, subtitles


def one(spark, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).first()


def test_scan_equals_windows_on_one_stream(spark):
    rng = random.Random(0)
    rows = [(rng.choice([1, 1, 1, None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "pid int, t long, v int")
    out = scan(df, ["pid"], ["t"], F.floor(F.col("t") / 7), sums={"s": F.col("v")}, before_max={"m": F.col("v")}, lasts={"l": F.col("v")}, lags={"g": F.col("v")}, nexts={"n": F.col("v")}, leads={"e": F.col("v")})
    for pid in (1, None):
        own = sorted((t, v) for p, t, v in rows if p == pid)
        got = {r["t"]: r for r in out.where(F.col("pid").eqNullSafe(F.lit(pid).cast("int"))).collect()}
        for i, (t, v) in enumerate(own):
            before, after = [x for _, x in own[:i] if x is not None], [x for _, x in own[i + 1 :] if x is not None]
            upto = before + [v] * (v is not None)
            r = got[t]
            assert r["s"] == (sum(upto) if upto else None) and r["m"] == max(before, default=None)
            assert r["l"] == (upto[-1] if upto else None) and r["g"] == (before[-1] if before else None)
            assert r["n"] == (v if v is not None else after[0] if after else None) and r["e"] == (after[0] if after else None)


def test_time_texts(spark):
    ms = lambda f, s: one(spark, x=f(F.lit(s)))["x"]
    assert ms(timeline.parse_time, "T1:2.5") == 62_005 and ms(timeline.parse_time, "T1:2.500") == 62_050
    assert ms(timeline.parse_range_time, "T1:2.500") == 62_500 and ms(timeline.parse_range_time, "T1:2.5000") == 62_000
    assert ms(timeline.parse_clock, "01:02:03,004") == 3_723_004 and ms(timeline.parse_clock, "x") is None
    for s, want in (("25/2", (25, 2)), ("30000-1001", (30000, 1001)), ("7", (7, 1)), ("2.50", (25, 10)), ("-0.5", (-5, 10)), ("x", None)):
        got = ms(timeline.parse_fraction, s)
        assert (tuple(got) if got else None) == want
    for s, want in (("2k", 2000), ("1.5m", 1_500_000), ("3sec", 3000), ("2min", 120_000), ("0x10", 16), ("+I", 2**31 - 1), ("q", None)):
        assert ms(timeline.parse_number, s) == want
    assert one(spark, x=timeline.rescale(F.lit(-7), 2, 1))["x"] == -3
    assert one(spark, x=timeline.rescale(F.lit(9_000_000_000_000_000_000), 90000, 1000))["x"] == 100_000_000_000_000_000
    assert one(spark, x=timeline.ntp_diff_ms(timeline.ntp_from_ms(F.lit(1_700_000_005_250).cast("long")), timeline.ntp_from_ms(F.lit(1_700_000_000_000).cast("long"))))["x"] in (5249, 5250)


LONG = "a very long string that exceeds the normal limit of the function, and goes on and on to break it, which is not so easy, so more and more"
#: Word, candidate and whether they are alike.
WORD_PAIRS = [
    ("abc", "abc", True), ("abc", "abcd", True), ("abcd", "abc", True), ("a:b:c", "xyz", False), ("abc", "x:y:z", False), ("abc", "xabcz", True),
    ("aabbc", "axayabaz", False), ("abc", "xyz", False), ("abcd", "aebfcd", True), (None, None, True), ("abc", None, False), (None, "abc", False),
    ("", "", True), ("abc", "", False), ("", "abc", False), (LONG, LONG, True), ("abc", LONG, False), ("éÿ\x01", "éÿ\x01", True), ("abc", "éÿ\x01", False),
    ("ab:c", "abxxxxxxxxxx", False), ("AbC", "xxaBcxxxxxx", True), ("height", "hieght", True), ("wxyz", "abcd", False), ("SIZE", "resize", True),
]


def plain_likeness(a, b):
    if a == b:
        return True
    if not a or not b:
        return False
    if (len(a) >= 3 and len(a) < len(b) and b.startswith(a)) or (len(b) >= 3 and len(b) < len(a) and a.startswith(b)):
        return True
    if 2 * len(a) < len(b):
        return (":" in a) == (":" in b) and a.lower() in b.lower()
    if (len(b) >= 3 and b.lower() in a.lower()) or (len(a) >= 3 and a.lower() in b.lower()):
        return True
    takers = [0] * len(a)
    for place, c in enumerate(b, 1):
        free = [i for i, x in enumerate(a) if x == c and not takers[i]]
        if free:
            takers[free[0]] = place
    if 2 * sum(t > 0 for t in takers) < len(a):
        return False
    run = sum(t == (takers[i - 1] + 1 if i else 1) for i, t in enumerate(takers))
    return (len(a) <= 4 and run >= 2) or (2 * run >= len(a) and 2 * run >= len(b))


def test_similar_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcA:") for _ in range(rng.randint(0, 9)))
    rows = WORD_PAIRS + [(a, b, plain_likeness(a, b)) for a, b in ((word(), word()) for _ in range(600))]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select("a", "b", "want", text.similar_words("a", "b").alias("got"))
    assert [r for r in df.collect() if r["want"] != r["got"]] == []


def test_large_numbers_stay_whole(spark):
    """Ids above 2^53 beside nulls, through every operator that hands rows to Python."""
    from rivulet.plans.pipeline import scripted

    big = 1 << 60
    frames = spark.createDataFrame([(big + 5, big + 1, 10), (big + 5, big + 3, 20)], "pid long, id long, ts long")
    cues = spark.createDataFrame([(big + 5, 5, "one")], "pid long, ts long, text string")
    got = {(r["pid"], r["id"], r["text"]) for r in pairing.attach_captions(frames, cues, 100).collect()}
    assert got == {(big + 5, big + 1, "one"), (big + 5, big + 3, "one")}
    rows = spark.createDataFrame([(big + 1,), (None,), (big + 3,)], "x long")
    assert {r["x"] for r in scripted(rows, lambda r: r, "x long").collect()} == {big + 1, None, big + 3}


def test_marks_over_chunks(spark):
    """Segments and runs across chunk borders, in streams of one row a chunk and of many."""
    rng = random.Random(12)
    rows, want = [], {}
    for pid in (1, None, 3):
        t = last = segment = 0
        for i in range(300):
            t += rng.choice([1, 5, 40_000_000, 90_000_000])
            segment += last != 0 and t > last + 20_000_000
            rows.append((pid, len(rows), t))
            want[len(rows) - 1], last = segment, t
    df = spark.createDataFrame(rows, "pid long, event_id long, cts long").repartition(5)
    assert {r["event_id"]: r["segment"] for r in windows.gap_segments(df, 20_000_000).collect()} == want


def test_encryption_of_whole_blocks(spark):
    """The published vectors of AES-128 in CBC; counter mode against its definition."""
    key, iv = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    clear = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    want = bytes.fromhex("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
    k, v = F.lit(key), F.lit(iv)
    parts = binary.encrypt_subsamples(F.lit(b"head" + clear + b"tail"), k, v, 4)
    r = one(spark, p=parts, back=binary.decrypt_subsamples(parts, k, v))
    assert bytes(r["p"][1]["cipher"]) == want and bytes(r["p"][1]["clear"]) == b"tail" and bytes(r["back"]) == b"head" + clear + b"tail"
    block = lambda n: F.substring(F.aes_encrypt(F.lit(bytes(8) + n.to_bytes(8, "big")), k, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(16))
    r = one(spark, s=binary.counter_mode(F.lit(bytes(35)), k, F.lit(bytes(8))), a=block(0), b=block(1), c=block(2), e=binary.counter_mode(F.lit(b""), k, F.lit(bytes(8))))
    assert bytes(r["s"]) == (bytes(r["a"]) + bytes(r["b"]) + bytes(r["c"]))[:35] and bytes(r["e"]) == b""


def test_urls(spark):
    j = lambda a, b: one(spark, x=text.url_join(F.lit(a), F.lit(b)))["x"]
    assert j("http://h/a/b.m3u8?q=1", "c/d.ts") == "http://h/a/c/d.ts" and j("http://h/a/b/c", "../x") == "http://h/a/x"
    assert j("http://h/a/b/c/d/e/f/g", "../../../../../../x?q=../y") == "http://h/x?q=../y" and j("http://h/a/b", "./c/./d") == "http://h/a/c/d"
    assert j("http://h/a", "http://o/z") == "http://o/z" and j("http://h/a/b", "/r") == "http://h/r"
    r = one(spark, e=text.url_escape(F.lit("a b/~&é%zz%41%")), x=text.url_extension(F.lit("p/q.MP4?x=.y")), u=text.url_unescape(F.lit("a%20b+%C3%A9")))
    assert r["e"] == "a%20b/~&%C3%A9%25zz%41%" and r["x"] == "mp4" and r["u"] == "a b+é"


def test_checksums_and_bits(spark):
    df = spark.createDataFrame([(b"123456789",), (b"",), (None,), (b"a" * 300,)], "d binary")
    assert [r["c"] for r in df.select(binary.crc32_msb("d").alias("c")).collect()] == [0x0376E6E7, 0xFFFFFFFF, None, binary.crc32_msb_of(b"a" * 300)]
    r = one(spark, u=binary.read_uint(F.lit(b"\x01\x02\x03"), 1, 2), le=binary.read_uint(F.lit(b"\x01\x02\x03"), 1, 2, True), b=binary.read_bits(F.lit(b"\x5a\xf0"), 4, 6), none=binary.read_uint(F.lit(b"\x01"), 0, 2), cc=binary.fourcc(binary.fourcc_number(F.lit("avc1"))))
    assert (r["u"], r["le"], r["b"], r["none"], r["cc"]) == (0x0203, 0x0302, 0b101011, None, "avc1")


def test_property_languages(spark):
    df = spark.createDataFrame([("video", 1, 640, "en"), ("video", 2, 1920, None), ("audio", 1, None, "fr")], "stream_type string, kind_rank int, width int, lang string")
    keep = lambda p: [(r["stream_type"], r["kind_rank"]) for r in df.where(props.predicate(p, df.columns)).collect()]
    assert keep("video2") == [("video", 2)] and keep("audio") == [("audio", 1)]
    assert keep("width+640") == [("video", 2), ("audio", 1)] and keep("width-1000#lang=!fr") == [("video", 1)]
    assert keep("unknown=3") == keep("") == keep("lang=*")
    with pytest.raises(ValueError):
        props.predicate("?", df.columns)


def test_caption_words(spark):
    chars = [(1, i, c) for i, c in enumerate("GP\nA C \n1 2")]
    got = [r["text"] for r in windows.words(spark.createDataFrame(chars, "pid long, ts long, fragment string")).orderBy("ts").collect()]
    assert got == ["GP\n", "GP\nA", "GP\nA C", "GP\nA C \n", "GP\nA C \n1", "GP\nA C \n1 2"]


def test_islands_are_stable_and_touching_stay_apart(spark):
    rows = [(1, 0, 5), (1, 5, 7), (1, 6, 9), (1, 20, 30), (1, 22, 25), (2, 1, 2)]
    df = spark.createDataFrame(rows, "pid long, start long, end long")
    once = windows.merge_intervals(df, 4)
    assert sorted(map(tuple, once.select("pid", "start", "end").collect())) == [(1, 0, 5), (1, 5, 9), (1, 20, 30), (2, 1, 2)]
    assert sorted(map(tuple, windows.merge_intervals(once, 4).select("pid", "start", "end").collect())) == sorted(map(tuple, once.select("pid", "start", "end").collect()))


def test_empty_intervals_of_events(spark):
    """No event in two seconds gives one empty interval; on a grid of one second, two."""
    none = spark.createDataFrame([(1, 0, 0, 7)], "pid long, start long, end long, id long")
    gaps = pairing.fill_gaps(none, 0, 180_000, 90_000).where("id is null")
    assert [(r["start"], r["end"]) for r in gaps.collect()] == [(0, 180_000)]
    assert sorted((r["start"], r["end"] - r["start"]) for r in pairing.on_segments(gaps.withColumn("id", F.lit(0)), 90_000).collect()) == [(0, 90_000), (90_000, 90_000)]


def test_reorder_of_a_shuffle_is_the_order(spark):
    """Numbers wrap, neighbours arrive swapped, one arrives twice."""
    seq = [(65_530 + i) % 65_536 for i in range(20)]
    arrive = [x for i in range(0, 20, 2) for x in (seq[i + 1], seq[i])] + [seq[4]]
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate(arrive)], "pid long, t long, n long")
    assert [r["n"] for r in concat.reorder(df, "n", ["t"]).orderBy("place").collect()] == seq


def test_captions_attach_once_each(spark):
    frames = spark.createDataFrame([(1, i, 10 * i) for i in range(6)], "pid long, id long, ts long")
    caps = spark.createDataFrame([(1, 5, "a"), (1, 6, "b")], "pid long, ts long, text string")
    assert [r["text"] for r in pairing.attach_captions(frames, caps, 20).orderBy("id").collect()] == [None, "a", "b", "b", "b", None]


def test_subtitle_texts(spark):
    df = lambda t: spark.createDataFrame([(1, t)], "pid long, text string")
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hi</i>\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nBye\r\n"
    assert [(r["start"], r["end"], r["text"]) for r in subtitles.read_srt(df(srt)).collect()] == [(1000, 2500, "<i>Hi</i>\nthere"), (3000, 4000, "Bye")]
    vtt = "WEBVTT\n\nNOTE x\n\nid1\n00:01.000 --> 00:02.000 align:left\nHi\n"
    assert [(r["start"], r["settings"], r["text"]) for r in subtitles.read_vtt(df(vtt)).collect()] == [(1000, "align:left", "Hi")]
    assert [(r["start"], r["end"], r["text"]) for r in subtitles.read_sub(df("{25}{50}a|b\n{75}{100}c")).collect()] == [(1000, 2000, "a\nb"), (3000, 4000, "c")]
    ssa = "[Script Info]\n[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Default,,0,0,0,,{\\b1}Hi, you\\Nthere"
    assert [(r["start"], r["end"], r["text"]) for r in subtitles.read_ssa(df(ssa)).collect()] == [(1500, 2000, "Hi, you\nthere")]
    ttml = '<tt><body><p begin="1.5s" dur="1s">a &amp; b<br/>c</p></body></tt>'
    assert [(r["start"], r["end"], r["text"]) for r in subtitles.read_ttml(df(ttml)).collect()] == [(1500, 2500, "a & b\nc")]
    master = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1280000,CODECS="a,b"\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=2\nhi.m3u8\n'
    got = subtitles.read_playlist(df(master)).collect()
    assert [(r["kind"], r["uri"]) for r in got] == [("variant", "low.m3u8"), ("variant", "hi.m3u8")] and got[0]["attributes"]["CODECS"] == "a,b"
    ev = '<EventStream><Event presentationTime="5" duration="2" id="9">QQ==</Event><Event presentationTime="8" id="3"/></EventStream>'
    assert [tuple(r)[1:] for r in subtitles.event_stream(df(ev)).collect()] == [(5, 2, 9, "QQ=="), (8, None, 3, "")]
    for t, want in ((srt, "srt"), (vtt, "vtt"), (ttml, "ttml"), (ssa, "ssa"), ("{1}{2}a", "sub"), (master, "m3u8"), ("zzz", None)):
        assert df(t).select(text.subtitle_format(F.col("text")).alias("f")).first()["f"] == want


def test_framing(spark):
    df = spark.createDataFrame([(1, b"\x00\x00\x00\x01\x67\x42\x00\x00\x01\x68\x01\xff")], "pid long, data binary")
    units = df.select(framing.start_code_units(F.col("data")).alias("u")).first()["u"]
    assert units == ["6742", "6801FF"]
    r = df.select(framing.length_prefixed(framing.start_code_units(F.col("data"))).alias("p")).first()["p"]
    assert bytes(r) == b"\x00\x00\x00\x02\x67\x42\x00\x00\x00\x03\x68\x01\xff"
    head = spark.createDataFrame([(b"x" * 20,)], "d binary").select(framing.adts_header(framing.adts_wrap(F.col("d"), 44100, 2)).alias("h")).first()["h"]
    assert tuple(head) == (44100, 2, 27)
    ts = bytes([0x47, 0x41, 0x00, 0x15]) + b"\xff" * 184
    got = framing.transport_packets(spark.createDataFrame([(1, ts * 2)], "pid long, data binary")).collect()
    assert [(r["stream"], r["start"], r["counter"], r["clock"]) for r in got] == [(0x100, True, 5, None)] * 2
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(spark.createDataFrame([(png,)], "d binary").select(framing.image_header(F.col("d")).alias("h")).first()["h"]) == ("png", 640, 480)


def test_run_lengths_round_trip_and_chapters(spark):
    s = spark.createDataFrame([(1, i, d) for i, d in enumerate([5, 5, 5, 2, 2, 9])], "pid long, number long, dur long")
    runs = container.compact_times(s)
    assert runs.count() == 3
    assert sorted((r["number"], r["ts"], r["dur"]) for r in container.expand_times(runs).collect()) == [(0, 0, 5), (1, 5, 5), (2, 10, 5), (3, 15, 2), (4, 17, 2), (5, 19, 9)]
    c = container.chapters(spark.createDataFrame([(1, "00:00:00 Start\n01:00:00.500 Next part\n")], "pid long, text string")).collect()
    assert [(r["start"], r["name"]) for r in c] == [(0, "Start"), (3_600_500, "Next part")]


def test_pipeline(spark):
    p = Pipeline().add("in", lambda: spark.range(10)).add("even", lambda df: df.where("id % 2 = 0"), "in").add("both", lambda a, b: a.union(b), ("in", "even"))
    assert p["both"].count() == 15 and [n for n, _, _ in p.describe()] == ["in", "even", "both"]
    with pytest.raises(KeyError):
        p.remove("in")
    with pytest.raises(KeyError):
        p.add("x", lambda df: df, "nothing")
    assert inspect(p["in"]).collect()[0]["present"] == 10
