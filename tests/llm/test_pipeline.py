import re

import corpus_pipeline as C
from rivulet.llm import quality, secrets
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_packing import want_pieces


def plain(rows, model, common):
    """The five stages over (doc_id, text) rows, one row at a time."""
    rules = quality.Rules()
    kept = [(i, j[7]) for i, t in rows for j in [quality.judge(t or "", rules, common)] if j[6]]
    last = {}
    for i, t in kept:
        last[t] = max(i, last.get(t, i))
    kept = sorted({(i, t) for i, t in kept if last[t] == i})
    group = components(kept)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    out = []
    for i, t in kept:
        base = secrets.base_spans(t)
        out.append((i, secrets.redact(t, base + secrets.markov_spans(t, base, model))))
    return out


def test_stages(spark, sf_dir, docs):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    now = docs
    for i, (_, stage) in enumerate(C.STAGES[:3]):
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
    model = secrets.train(now)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], model, quality.furniture(docs, quality.Rules()))
    assert len(want) > 50
    got = C.run(spark, sf_dir)
    assert sorted(tuple(r) for r in got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(want_pieces(want, 2048))
    assert not any(re.search(r"AKIA[A-Z0-9]{16}", t) for _, t in want)


def test_edges(spark, edges, nothing, sf_dir):
    for df in (edges, nothing):
        now = df
        for _, stage in C.STAGES[:4]:
            now = stage(spark, now, sf_dir)
            assert now.columns == df.columns
        C.STAGES[4][1](spark, now, sf_dir).collect()
