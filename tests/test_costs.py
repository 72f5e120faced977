"""Operators that took a row, a block or a shuffle more than they need: the same results, without those."""

import random

from pyspark.sql import functions as F

from rivulet.functions import binary, text
from rivulet.operators import windows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_ranges_are_shuffled_less_often(spark):
    rng = random.Random(3)
    rows = [(p, s := rng.randrange(2000), s + 1 + rng.choice([5, 40, 900 * (p == 1)])) for p in (1, 2, 3, None) for _ in range(120)]
    df = spark.createDataFrame(rows, "pid long, start long, end long")
    for chunk, tolerance in ((1, 0), (50, 0), (50, 7), (10_000, 7)):
        want = []
        for p in (1, 2, 3, None):
            mine, reach = sorted(r[1:] for r in rows if r[0] == p), None
            for s, e in mine:
                if reach is None or s >= reach + tolerance:
                    want.append([p, s, e, 0])
                    reach = e
                reach = max(reach, e)
                want[-1][2:] = [reach, want[-1][3] + 1]
        got = [list(r) for r in windows.merge_intervals(df, chunk, tolerance).select("pid", "start", "end", "n").collect()]
        key = lambda r: (r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted(want, key=key)
    assert plan(windows.merge_intervals(df, 50)).count("Exchange hashpartitioning") <= 11


def test_words_of_whole_texts(spark):
    rng = random.Random(4)
    texts = ["", None, "a", " ", "\n", "a\n", "a b", "a  b\n\nc ", " x y\x1cz", "\U0001f600 a\n"] + ["".join(rng.choices("ab \n\t\xa0é", k=rng.randrange(40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "pid long, text string")
    one = spark.createDataFrame([(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(t or "")], "pid long, ts long, fragment string")
    rows = lambda d: sorted(map(tuple, d.select("pid", "ts", "text").collect()))
    assert rows(windows.words_of(df)) == rows(windows.words(one))
    assert "Exchange" not in plan(windows.words_of(df))


def test_counter_mode_takes_no_call_for_each_block(spark):
    key, vector = F.lit(b"0123456789abcdef"), F.lit(b"\x01\x02\x03\x04\x05\x06\x07\xff")
    sizes = [0, 1, 15, 16, 17, 31, 32, 33, 47, 48, 1000, 70_000]
    df = spark.createDataFrame([(n, random.Random(n).randbytes(n)) for n in sizes] + [(-1, None)], "n int, data binary")
    got = {r["n"]: (r["data"], r["made"]) for r in df.select("n", "data", binary.counter_mode(F.col("data"), key, vector).alias("made")).collect()}
    block = F.substring(F.aes_encrypt(F.concat(vector, F.unhex(F.lpad(F.hex("id"), 16, "0"))), key, F.lit("ECB"), F.lit("PKCS")), 1, 16)
    stream = b"".join(bytes(r[0]) for r in spark.range(5000).orderBy("id").select(block).collect())
    assert got[-1][1] is None
    assert all(bytes(got[n][1]) == bytes(x ^ y for x, y in zip(got[n][0], stream, strict=False)) for n in sizes)
    assert "transform(" not in plan(df.select(binary.counter_mode(F.col("data"), key, vector)))


def test_similar_words_take_no_nested_functions(spark):
    df = spark.createDataFrame([("abcd", "abdc", True), ("sound", "round", True), ("sound", "video", False), (None, "x", False), (None, None, True), ("", "x", False), ("aab", "xaab", True)], "a string, b string, want boolean")
    made = df.select("want", text.similar_words("a", "b").alias("got"))
    assert all(r["got"] == r["want"] for r in made.collect())
    assert "zip_with(" not in plan(made)
