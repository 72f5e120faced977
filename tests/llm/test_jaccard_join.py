import random
import re

import numpy as np

from rivulet.llm import jaccard_join as J

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in _WORD.findall(text or "")]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """{doc_id: (n_shingles, component_id)} by comparing every pair."""
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_documents(spark, docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(J.jaccard_components(docs)) == {(i, n, c) for i, (n, c) in want.items()}


def test_edges(edges):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    want = brute([r for r in rows if r[0] is not None])
    found = J.jaccard_components(edges)
    assert found.count() == len(rows)
    assert {x for x in got(found) if x[0] is not None} == {(i, n, c) for i, (n, c) in want.items()}
    assert [r["component_id"] for r in found.where("doc_id is null").collect()] == [6]


def test_empty(nothing):
    assert J.jaccard_components(nothing).collect() == []
    assert J.drop_near_copies(nothing).collect() == []


def test_thresholds_and_common_passages(spark):
    """Texts around the threshold, chains that link only through a middle, and a passage that most texts share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 80))]
        for cut in range(0, len(base) // 3, 2):
            rows.append((i, " ".join([*base[cut:], *(word() for _ in range(cut))])))
            i += 1
    for _ in range(40):
        rows.append((i, passage + " " + " ".join(word() for _ in range(rng.randint(5, 30)))))
        i += 1
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.jaccard_components(df)) == {(d, n, c) for d, (n, c) in want.items()}
    assert {r["doc_id"] for r in J.drop_near_copies(df).collect()} == {d for d, (_, c) in want.items() if d == c}


def test_names_that_clash_and_forgotten_folders(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, 5, "a"), (2, text + " more", 6, "b"), (3, "else", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _may long, _DROP string")
    own = str(tmp_path / f"keep-{'0' * 32}")
    df.write.parquet(own)
    docs = spark.read.parquet(own)
    assert sorted(map(tuple, J.drop_near_copies(docs).collect())) == [rows[0], rows[2]]
    assert docs.count() == 3  # the input's folder is not among those that are removed


def test_bitmaps_never_rule_out_a_link(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        a = rng.choice(1 << 40, rng.integers(1, 300), replace=False).astype(np.uint64)
        keep = a[rng.random(len(a)) > rng.random() * 0.3]
        b = np.union1d(keep, rng.choice(1 << 40, rng.integers(0, 20)).astype(np.uint64))
        both = len(np.intersect1d(a, b))
        rows.append((i, len(a), len(b), J.bitmap(a).tolist(), J.bitmap(b).tolist(), bool(100 * both >= 80 * (len(a) + len(b) - both))))
    df = spark.createDataFrame(rows, "i int, xn int, yn int, xbits array<long>, ybits array<long>, linked boolean")
    from pyspark.sql import functions as F

    assert df.where("linked").where(~F.expr(J.may_link("x", "y"))).count() == 0
    assert df.where(~F.expr(J.may_link("x", "y"))).count() > 0
