import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from rivulet.llm import token_counts as C
from rivulet.llm.byte_bpe import read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def count(text):
    return len(LIBRARY.encode_ordinary(text))


def test_random_edits(docs):
    rng, own = random.Random(4), C.counter(PATH, P.PATTERN)
    texts = [r["text"] or "" for r in docs.collect()][:30] + ["", " ", "\n" * 700, "a" * 900, "  a  " * 300, "it's 12 'll " * 90]
    for text in texts:
        tree = C.Tree(text, own)
        assert tree.tokens == count(text)
        for _ in range(25):
            a = rng.randint(0, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 5, 80, 1000])
            new = rng.choice(["", " ", "\n", "   ", "'s", "x", "word word", "é", "12", " \n ", "\n" * 300, "a" * 400])
            tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[max(min(b, len(text)), min(a, len(text))) :]
            assert tree.chars == len(text) and tree.tokens == count(text)


def test_only_regions_are_encoded():
    text = "some words of a long text, again and again. " * 5000
    tree = C.Tree(text, C.counter(PATH, P.PATTERN))
    tree.encoded = 0
    tree.edit(100_000, 100_004, "new")
    assert 0 < tree.encoded < 6 * C.LEAF_CHARS


def test_insertions_touch_few_nodes():
    """Edits that change the number of blocks renew the sums of a few paths, not of the whole tree."""
    rng = random.Random(8)
    text = "some words of a long text, again and again. " * 20_000
    tree = C.Tree(text, C.counter(PATH, P.PATTERN))
    assert len(tree.blocks) > 3000
    for size in (0, 37, 200, 1000):
        for _ in range(20):
            tree.touched = 0
            at = rng.randrange(tree.chars)
            tree.edit(at, at + rng.choice([0, 0, 700]), "put in " * (size // 7))
            assert tree.touched < 400


def test_kept_trees(docs, spark):
    """A table of trees, edited twice, counts what the edited texts hold and encodes little more than the edits."""
    changes = "doc_id long, seq int, start int, end int, new string"
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    trees = C.build_trees(docs, PATH, P.PATTERN)
    for turn in range(2):
        rows = [(i, 1, 5 * turn, 5 * turn + 3, "new words ") for i in list(texts)[::3]]
        done = C.edit_trees(trees, spark.createDataFrame(rows, changes), PATH, P.PATTERN)
        for i, _, a, b, new in rows:
            texts[i] = texts[i][:a] + new + texts[i][b:]
        got = done.collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: count(t) for i, t in texts.items()}
        assert all("".join(b["text"] for b in r["blocks"] or []) == texts[r["doc_id"]] for r in got)
        assert all(r["n_encoded"] < 10 * C.LEAF_CHARS for r in got if len(texts[r["doc_id"]]) > 10_000 and " " in texts[r["doc_id"]][:500])
        trees = spark.createDataFrame(got, done.schema)


def test_tables(docs, edges, nothing, spark):
    changes = spark.createDataFrame([(11, 1, 0, 3, "new "), (11, 2, 0, 0, "x"), (9, 1, 10, 50_000, ""), (404, 1, 0, 0, "x"), (2, 1, 5, 9, "put in")], "doc_id long, seq int, start int, end int, new string")
    gathered = C.gathered(edges, changes)
    found = {r["doc_id"]: r for r in C.count_with_edits(gathered, F.col("edits"), PATH, P.PATTERN).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in edges.collect()}
    assert all(found[i]["n_tokens"] == count(t) for i, t in texts.items())
    assert found[11]["n_tokens_edited"] == count("x" + "new " + texts[11][3:]) and found[9]["n_tokens_edited"] == count(texts[9][:10] + texts[9][50_000:])
    assert found[2]["n_tokens_edited"] == count("put in") and found[6]["n_tokens_edited"] == count(texts[6])
    assert C.count_with_edits(C.gathered(nothing, changes), F.col("edits"), PATH, P.PATTERN).collect() == []


def test_query(docs):
    got = {r["doc_id"]: r for r in C.count_with_edits(docs, C.sample_edits(F.coalesce("text", F.lit(""))), PATH, P.PATTERN).collect()}
    for r in docs.collect():
        t = r["text"] or ""
        n = len(t)

        def put(t, a, b, new):
            a = max(0, min(a, len(t)))
            return t[:a] + new + t[max(a, min(b, len(t))) :]

        t = put(put(put(t, n // 2, n // 2 + 12, " rewritten"), n // 3, n // 3, " An added sentence, don't you think?\n"), n - 8, n + 12, "")
        assert got[r["doc_id"]]["n_tokens_edited"] == count(t)
