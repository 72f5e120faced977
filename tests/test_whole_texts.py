"""Queries that run over every row and whole texts, against plain Python."""

import base64
import hashlib
import re

import pytest

from rivulet.plans import catalog

TEXTS = [None, "", "the", "Été the\u00a0end", "nothe there", "日本語 the 日本", "thé", "naïve\n\tcafé\u2003x \x0b y", "the_end", "a" * 300, "🙂" * 100 + " the🙂", "\x01\x7f ctrl"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_digests(spark, texts):
    got = {r["doc_id"]: r for r in catalog.QUERIES["digests_all"](spark, texts).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if t is not None:
            b = t.encode()
            assert (got[i]["sha1"], got[i]["b64"], got[i]["hex"]) == (hashlib.sha1(b).hexdigest(), base64.b64encode(b).decode(), b.hex().upper())


def test_tokens(spark, texts):
    got = {r["doc_id"]: (r["n"], r["has_the"]) for r in catalog.QUERIES["tokens_all"](spark, texts).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if t is not None:
            assert got[i] == (len([x for x in re.split("[ \t\r\n]+", t) if x]), bool(re.search(r"(?<!\w)the(?!\w)", t, re.ASCII)))
