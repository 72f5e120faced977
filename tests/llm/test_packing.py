import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rivulet.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def want_pieces(rows, size):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            out.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out, key=str)


def check(df, size):
    found = [tuple(r) for r in K.best_fit_packing(df, PATH, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    assert sorted((r[:5] for r in found), key=str) == want_pieces([(r["doc_id"], r["text"]) for r in df.collect()], size)
    by_seq = {}
    for r in found:
        by_seq.setdefault(r[5], []).append((r[6], r[3]))
    for placed in by_seq.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(by_seq), sum(r[3] for r in found)


def test_documents(docs):
    used, tokens = check(docs, 2048)
    assert used <= 1.03 * -(-tokens // 2048) + 1


def test_edges(edges, nothing):
    check(edges, 64)
    assert K.best_fit_packing(nothing, PATH).collect() == []


def test_large_ids_and_a_second_round(spark):
    """Ids beyond a double's reach stay whole beside a null one; groups that are packed apart lose little."""
    big = 1 << 60
    rows = [(big + 1, "one two"), (big + 3, "three"), (None, "four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in K.best_fit_packing(df, PATH, 64).collect()} == {big + 1, big + 3, None}
    rng = np.random.default_rng(5)
    lengths = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 64, 4000))]
    found = spark.createDataFrame(lengths, "doc_id long, piece int, start long, length long, ids_crc32 long")
    used = {k: K.pack(found, 64, k).select("sequence_id").distinct().count() for k in (100, 100_000)}
    assert used[100] <= 1.03 * used[100_000] + 1
    placed = K.pack(found, 64, 100).groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert all(r["sum(length)"] <= 64 for r in placed) and K.pack(found, 64, 100).select("doc_id").distinct().count() == 4000


def test_rule_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(2)
    size, lengths = 30, rng.integers(1, 31, 300)
    seq, offset = K.sum_of_squares(lengths, size)
    level: dict[int, int] = {}
    for s, q, o in zip(lengths.tolist(), seq.tolist(), offset.tolist(), strict=True):
        count = np.bincount([size - v for v in level.values() if v < size], minlength=size + 1)

        def cost(gap, count=count, s=s):
            after = count.copy()
            if gap < size:
                after[gap] -= 1
            if gap - s > 0:
                after[gap - s] += 1
            return int((after**2).sum())

        options = {g: cost(g) for g in {*np.flatnonzero(count).tolist(), size} if g >= s}
        assert level.get(q, 0) == o
        assert cost(size - o) == min(options.values())
        level[q] = o + s


def test_words_in_use_stay_known(monkeypatch):
    """A word that every text has is encoded once, however many others come and are forgotten; ids stay the library's."""
    monkeypatch.setattr(K, "CACHE_WORDS", 40)
    words, seen, plain = K.WordIds(PATH), [], K.WordIds._word
    monkeypatch.setattr(K.WordIds, "_word", lambda self, w: seen.append(w) or plain(self, w))
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for i in range(200):
        text = f"Always here, w{i} Über{i} x-{i}.y  it's日本 {chr(97 + i % 26) * (i % 9)}"
        assert words.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert max(len(words.words) + len(words.old_words), len(words.parts) + len(words.old_parts)) <= 40 + 16
    assert seen.count("Always") == 1 and seen.count("w7") == 1
