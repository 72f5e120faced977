import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})
OURS = B.Encoder(B.read_ranks(PATH), P.PATTERN)


def check(df):
    want = sorted(((r["doc_id"], len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect() for i in [LIBRARY.encode_ordinary(r["text"] or "")]), key=str)
    assert sorted(map(tuple, B.byte_bpe(df, PATH, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == want


def test_documents_and_edges(docs, edges, nothing):
    check(docs)
    check(edges)
    assert B.byte_bpe(nothing, PATH, P.PATTERN).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r  'stremvldaAé1٣日🙂_-"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert OURS.encode(text) == LIBRARY.encode_ordinary(text)


def test_long_pretokens_stream():
    rng = random.Random(1)
    for n in (65, 200, 3000):
        for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "a", "éàü"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert OURS.encode(text) == LIBRARY.encode_ordinary(text)
            assert OURS.machine.short(text.encode()) == list(OURS.machine.stream(text.encode())) == LIBRARY.encode_ordinary(text)


@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_stream_decoding_is_decoding(data, cuts):
    stream = B.Utf8Stream()
    edges = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    text = "".join(stream.feed(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)) + stream.end()
    assert text == data.decode("utf-8", "replace")


def test_round_trip(edges):
    back = {(r["doc_id"], r["text"]) for r in B.decode(B.encode(edges, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in edges.collect()}
