import hashlib

from rivulet.llm import sharding as S


def brute(rows, most):
    keyed = [(i, len((t or "").encode()), bin(int("1" + hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[3:]) for i, t in rows]
    out, queue = [], [("", keyed)]
    while queue:
        prefix, own = queue.pop()
        size = sum(n for _, n, _ in own)
        if size <= most or len(prefix) == S.BITS:
            out += [(i, n, prefix, len(prefix), size, size <= most) for i, n, _ in own]
        else:
            parts = [[r for r in own if r[2][len(prefix)] == b] for b in "01"]
            queue += [(prefix + b, p) for b, p in zip("01", parts, strict=True) if p]
    return sorted(out, key=str)


def test_against_splitting_one_bucket_at_a_time(docs, edges, nothing):
    for df, most in ((docs, 20_000), (docs, 300), (docs, 1 << 40), (edges, 3000)):
        want = brute([(r["doc_id"], r["text"]) for r in df.collect()], most)
        assert sorted(map(tuple, S.shards(df, most).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits").collect()), key=str) == want
    assert S.shards(nothing).collect() == []
