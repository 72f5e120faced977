import numpy as np

from rivulet.llm import language_id as L


def plain_marginals(scores, chain):
    """Forward-backward in its textbook form: label and neighbouring-pair probabilities of one row."""
    n, k = scores.shape
    f, b = np.zeros((n, k)), np.zeros((n, k))
    f[0] = scores[0]
    for t in range(1, n):
        f[t] = [scores[t, j] + np.logaddexp.reduce(f[t - 1] + chain[:, j]) for j in range(k)]
    for t in range(n - 2, -1, -1):
        b[t] = [np.logaddexp.reduce(chain[i] + scores[t + 1] + b[t + 1]) for i in range(k)]
    z = np.logaddexp.reduce(f[-1])
    pairs = sum((np.exp(f[t][:, None] + chain + (scores[t + 1] + b[t + 1])[None] - z) for t in range(n - 1)), np.zeros((k, k)))
    return np.exp(f + b - z), pairs


def test_forward_backward_in_blocks():
    rng = np.random.default_rng(0)
    lengths = [1, 0, 3, 70, 32, 33, 200, 0, 64]
    bounds = np.cumsum([0, *lengths])
    scores, chain = rng.normal(0, 3, (bounds[-1], 4)), rng.normal(0, 2, (4, 4))
    p = L.posteriors(scores, bounds, chain)
    pairs = np.zeros((4, 4))
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            want, own = plain_marginals(scores[a:b], chain)
            assert np.allclose(p[a:b], want, atol=1e-8)
            pairs += own
    assert np.allclose(L.expected_pairs(scores, bounds, chain), pairs, atol=1e-6)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_code_switching(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    crf = L.train(docs)
    text = {r["lang"]: r["text"] for r in docs.where("doc_id > 100 and n_chars > 600").collect()}
    mixed = " ".join(text["de"].split()[:40] + text["es"].split()[:40])
    _, _, p, _ = L.predictor(crf)([mixed])
    said = [crf.labels[i] for i in p.argmax(1)]
    assert said[:35].count("de") >= 32 and said[45:].count("es") >= 32


def test_edges(sf_dir, edges, nothing, spark):
    crf = L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = {r["doc_id"]: r for r in L.identify(edges, crf).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[1]["score"] == 0
    assert found[None]["held_out"] is False and found[6]["lang_pred"] in crf.labels
    assert L.identify(edges, crf).count() == 16
    assert L.identify(nothing).collect() == [] and L.identify(nothing, crf).collect() == []


def test_nothing_held_out_is_learned(spark):
    """A language that only held-out rows have is never predicted."""
    import zlib

    rows = [(i, "alpha beta gamma delta " * 5, "aa") if zlib.crc32(str(i).encode()) % 5 else (i, "uno dos tres cuatro " * 5, "bb") for i in range(200)]
    assert {r["lang_pred"] for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"aa"}


def test_long_tokens_are_taken_whole():
    """Pieces have all n-grams and affixes of a token, once."""
    from collections import Counter
    from zlib import crc32

    for n in (1, 2, 3, 23, 24, 25, 48, 49, 50, 200, 1001):
        word = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(n))
        w = f"^{word}$"
        want = [(w[:k], 0) for k in (2, 3, 4)] + [(w[-k:], 1) for k in (2, 3, 4)] + [(word[i : i + 2], 2) for i in range(n - 1)] + [(word[i : i + 3], 3) for i in range(n - 2)]
        got = [i for p in L.tokens(word) for i in L.features(p, {})]
        assert Counter(got) == Counter(crc32(x.encode(), k) % L.BUCKETS for x, k in want)
        assert len(L.tokens(word)) == -(-n // L.PIECE)


def test_text_without_spaces(spark):
    """The language of a text without spaces is that of its most, not of its beginning."""
    import random

    rng = random.Random(1)
    text = lambda at, n: "".join(chr(at + rng.randrange(80)) for _ in range(n))
    rows = [(i, text(0x4E00 if i % 2 else 0x3042, 300), "zh" if i % 2 else "ja") for i in range(400)]
    crf = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, _, p, bounds = L.predictor(crf)([text(0x3042, 30) + text(0x4E00, 300), text(0x4E00, 30) + text(0x3042, 300)])
    assert langs == ["zh", "ja"] and all(bounds[1:] - bounds[:-1] == 14)


def test_rare_languages_and_repeated_ids_are_sampled(spark):
    """A language of 1 in 2000 rows is learned, with one doc_id on most rows, and the sample stays bounded."""
    rows = [(1 if i % 3 else i, f"alpha beta gamma delta {i}", "aa") for i in range(8000)] + [(1, f"uno dos tres cuatro {i}", "bb") for i in range(4)] + [(1, "same text again", "cc")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = L.sample(docs, 300)
    count = {k: sum(x == k for x, _ in got) for k in ("aa", "bb", "cc")}
    assert count["bb"] == 4 and count["cc"] == 1 and 280 <= count["aa"] <= 300
    assert sorted(got) == sorted(L.sample(docs.repartition(3), 300))
    crf = L.train(docs)
    assert L.predictor(crf)(["uno dos tres cuatro", "alpha beta gamma"])[0] == ["bb", "aa"]
