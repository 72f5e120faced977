import hashlib

from rivulet.llm import exact_dedup as X


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def test_edges_and_documents(edges, docs):
    for df in (edges, docs):
        want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
        assert sorted(map(tuple, X.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == want


def test_drop(edges, nothing):
    left = X.drop_copies(edges)
    assert left.columns == edges.columns
    rows = left.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted([3, 2, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, (1 << 60) + 1, (1 << 60) + 3], key=str)
    assert X.exact_dedup(nothing).collect() == [] and X.drop_copies(nothing).collect() == []


def test_chunks_cover_texts(edges):
    from pyspark.sql import functions as F

    whole = edges.select(F.coalesce("text", F.lit("")).alias("t")).select("t", X.chunks(F.col("t")).alias("c"))
    assert whole.where(F.concat_ws("", "c") != F.hex(F.encode("t", "UTF-8"))).count() == 0
    assert whole.where(F.exists("c", lambda c: F.length(c) > 2 * X.MAX_BYTES)).count() == 0


def test_names_that_clash(spark):
    """Columns with the names that the operator uses inside come out as they went in."""
    rows = [(1, "a b", "s1", 7, True, "x"), (2, "a b", "s2", 8, False, "y"), (2, "c d", "s3", 9, None, None), (None, "e", "s4", 1, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _may long, _drop boolean, _STAYS string")
    assert sorted(map(tuple, X.drop_copies(df).collect()), key=str) == sorted(rows[1:], key=str)
