import math
import re
import zlib
from collections import Counter

import numpy as np

from rivulet.llm import ngram_lm as N


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</end>"]


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if i is not None and not held(i)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    total, kinds = Counter(), Counter()
    for (a, _), c in two.items():
        total[a] += c
        kinds[a] += 1
    base = lambda w: (one[w] + 1) / (n + v + 1)

    def p(a, w):
        low = base(w)
        return low if not total[a] else max(two[a, w] - N.DISCOUNT, 0) / total[a] + N.DISCOUNT * kinds[a] / total[a] * low

    got = N.lm_scores(df).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = tokens(t)
        want.setdefault((i, len(w)), (held(i), sum(one[x] > 0 for x in w), sum(math.log10(base(x)) for x in w), sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], w, strict=False))))
    for r in got:
        is_held, known, low, score = want[r["doc_id"], r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (is_held, known, n)
        assert abs(r["base_score"] - low) <= 1e-6 * max(1, abs(low))
        # each token's probability and back-off are within half a step
        assert abs(r["score"] - score) <= math.log10(4 * (n + len(one) + 1)) / 255 * r["n_tokens"] + 1e-6
    return got


def test_documents(docs):
    got = check(docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(edges, nothing):
    check(edges)
    assert N.lm_scores(nothing).collect() == []


def test_only_held_out_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = N.lm_scores(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in got] == [(0, 0, 0.0)] * 3


def test_elias_fano():
    rng = np.random.default_rng(6)
    for n, universe in ((0, 1), (1, 1), (1, 1 << 62), (1000, 1000), (1000, 5000), (5000, 1 << 40), (3, 1 << 63)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64)) if n < universe else np.arange(n, dtype=np.uint64)
        a = N.EliasFano.arrays(values, universe)
        ef = N.EliasFano(a["low"], a["high"], a["zeros"], a["shape"])
        assert (ef.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(rng.integers(0, universe, 500, dtype=np.uint64), values)
        assert (ef.find(other) == -1).all()


def check_trigrams(df):
    """Scores of order 3 against plain counts, and that successors of three words are stored as ranks behind pointers."""
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [["<s>", *tokens(t)] for i, t in rows if i is not None and not held(i)]
    counts = [Counter(tuple(t[i : i + k]) for t in train for i in range(len(t) + 1 - k)) for k in (1, 2, 3)]
    one = {g[0]: c for g, c in counts[0].items() if g[0] != "<s>"}
    n, v = sum(one.values()), len(one)
    total, kinds = Counter(), Counter()
    for c in counts[1:]:
        for g, k in c.items():
            total[g[:-1]] += k
            kinds[g[:-1]] += 1

    def p(context, w):
        if not context:
            return (one.get(w, 0) + 1) / (n + v + 1)
        low = p(context[1:], w)
        if not total[context]:
            return low
        c = counts[len(context)][(*context, w)]
        return max(c - N.DISCOUNT, 0) / total[context] + N.DISCOUNT * kinds[context] / total[context] * low

    got = N.lm_scores(df, 3).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = ["<s>", *tokens(t)]
        want.setdefault((i, len(w) - 1), sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w))))
    for r in got:
        # up to three rounded factors a token, of half a step each
        assert abs(r["score"] - want[r["doc_id"], r["n_tokens"]]) <= 1.5 * math.log10(4 * (n + v + 1)) / 255 * r["n_tokens"] + 1e-6
    return got


def test_three_orders(docs, edges, nothing, monkeypatch):
    two = {r["doc_id"]: r["score"] for r in N.lm_scores(docs).collect()}
    got = check_trigrams(docs)
    assert any(abs(r["score"] - two[r["doc_id"]]) > 0.1 * r["n_tokens"] for r in got)
    check_trigrams(edges)
    assert N.lm_scores(nothing, 3).collect() == []
    monkeypatch.setattr(N, "SHARD_WORDS", 200)  # many shards
    assert sorted((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in got) == sorted((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in N.lm_scores(docs, 3).collect())


def test_the_query_has_three_orders(spark, sf_dir):
    got = {r["doc_id"]: r["score"] for r in N.query(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: r["score"] for r in N.lm_scores(N.documents(spark, sf_dir), 3).collect()}


def test_successors_of_nodes():
    rng = np.random.default_rng(1)
    for nodes, n, most in ((1, 0, 5), (3, 10, 7), (500, 4000, 300), (2000, 9000, 50_000)):
        keys = np.unique(rng.integers(0, nodes * most, n))
        children = N.Children(N.Children.arrays(keys // most, keys % most, nodes))
        assert (children.find(keys // most, keys % most)[0] == np.arange(len(keys))).all()
        assert (children.all_values(nodes) == keys % most).all()
        ask = rng.integers(0, nodes * most, 500)
        assert ((children.find(ask // most, ask % most)[0] >= 0) == np.isin(ask, keys)).all()


def test_counts_travel_as_runs(spark, docs):
    """Counts are shuffled as one row for each shard and merge, not one for each n-gram, and each level of a shard is one file."""
    import os

    train = docs.where("crc32(cast(doc_id as string)) % 7 <> 2").coalesce(2)
    model = N.train(train, 3)
    assert len(os.listdir(model.folder)) == 3 * (len(model.firsts) - 1)
    runs = N.counted_runs(train.select("text"), lambda: model.triples, model.triple_shard)
    assert runs.count() <= 2 * (len(model.firsts) - 1)
    keys, counts = N.from_runs(runs.toArrow())
    want = Counter()
    for r in train.collect():
        t = ["<s>", *tokens(r["text"])]
        want.update(zip(t, t[1:], t[2:], strict=False))
    assert len(keys) == len(want) and sorted(counts.tolist()) == sorted(want.values())


def test_runs_and_distinct_keys():
    rng = np.random.default_rng(3)
    for most in (1, 255, 256, 1 << 40, (1 << 63) - 1):
        x = rng.integers(0, most, 1000, endpoint=True)
        assert (N.unpacked_run(N.packed_run(x), 1000) == x).all()
    close = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([close, close ^ np.uint64(1), close])  # differ in the lowest bit alone
    for keys, most in ((near, 1 << 64), (close, 1 << 64), (near % np.uint64(50), 50), (near[:1], 1 << 64)):
        for got, want in zip(N.distinct(keys, most), np.unique(keys, return_inverse=True), strict=True):
            assert (got == want).all()


def test_elias_fano_of_uneven_sequences():
    """Full buckets, long gaps, and numbers side by side."""
    rng = np.random.default_rng(4)
    dense = np.arange(5000, dtype=np.uint64)
    for values in (dense, np.append(dense, np.uint64(1 << 50)), np.unique((2 ** rng.uniform(0, 50, 4000)).astype(np.uint64)), np.append(dense * np.uint64(3), (np.uint64(1) << np.uint64(40)) + dense)):
        universe = int(values[-1]) + 1
        a = N.EliasFano.arrays(values, universe)
        ef = N.EliasFano(a["low"], a["high"], a["zeros"], a["shape"], a["ones"])
        assert (ef.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(np.concatenate([values + np.uint64(1), values - np.uint64(1), rng.integers(0, universe, 500, dtype=np.uint64)]), values)
        assert (ef.find(other) == -1).all()
        assert (ef.access(np.arange(len(values))) == values).all()
        at, after = ef.access_two(np.arange(len(values) - 1))
        assert (at == values[:-1]).all() and (after == values[1:]).all()


def test_word_hashes_are_sums_over_bytes():
    """Each word's hash against its definition, words longer than the columns too."""
    import pyarrow as pa

    from rivulet.llm import common as C

    texts = ["", "Ab cD\tab", None, "x" * 255 + " " + "y" * 256 + "\n" + "z" * 257, "é日 " * 3, "w" * 1000, "a", "b"]
    for lower in (True, False):
        got, bounds = C.word_hashes(*C.text_bytes(pa.array(texts, pa.string())), lower)
        words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
        assert np.diff(bounds).tolist() == [len(w) for w in words]
        power, size = int(C._POWER), 1 << 64
        want = [sum(int(C._BYTE[b]) * pow(power, k + 1, size) for k, b in enumerate(w.lower() if lower else w)) % size for ws in words for w in ws]
        assert (got == C.mix(np.array(want, np.uint64))).all()
