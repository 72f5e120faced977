"""Texts through XML, and splices of every stream."""

from pyspark.sql import functions as F

from rivulet.plans import catalog

TEXTS = [None, "", " ", "plain", "<a b='c'>&amp;</a>", "]]>", " ends ", "two\nlines\r\nand\rmore", "\ttab\t", "a\x00b\x01\x0b\x1f", "\ufffe\uffff", "日本語 🙂", "12", "12.50", "true", "null", "=eA==", "<!-- x -->", "<packet>1</packet>", "<![CDATA[x]]>", "a  b", "\u00a0x\u2003", "\x85y\u2028z"]


def test_texts_through_xml(spark, tmp_path):
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["payload"], r["intact"]) for r in catalog.QUERIES["xml_payload_round_trip"](spark, str(tmp_path)).collect()}
    assert got == {i: (t, None if t is None else True) for i, t in enumerate(TEXTS)}


def test_every_error_is_spliced(spark, sf_dir):
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select("event_id").collect()}
    assert {r[0] for r in catalog.QUERIES["u3_splice_all"](spark, sf_dir).where(F.col("spliced")).select("event_id").collect()} == want
