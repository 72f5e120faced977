"""Operator 3, exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own bytes say so (where the low halves of the last three fall in a fixed set, as a hash of them, at
least MIN_BYTES in and at most MAX_BYTES), so equal passages of any script give equal chunks wherever they stand. Distinct chunks are gathered once, by 64-bit hash and length, and each such
identifier is verified: all its occurrences must have the same SHA-256, else SHA-256 digests are the identifiers. A
document is then its recipe, the ordered list of verified identifiers; the lists themselves are compared and moved, not texts.

Defined cases: null counts as empty, and the empty recipe is one group; a null doc_id sorts below all others; rows that
repeat a doc_id with the same text are copies of each other and share `kept`; an empty table gives no row; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import cut, documents, id_text, join_groups, unused, without_ids

MIN_BYTES, MAX_BYTES = 1024, 8192
#: A chunk ends after three bytes whose low hexadecimal digits are among these (about one place in 19), or at its longest.
_BREAK = "(?:.[03579B]){3}"


def chunks(text: Column) -> Column:
    """A text's chunks, as hexadecimal digits of their UTF-8 bytes."""
    pattern = f"(?:..){{{MIN_BYTES},{MAX_BYTES - 3}}}?{_BREAK}|.{{1,{2 * MAX_BYTES}}}"
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe: the document's ordered verified chunk identifiers. Written once, then read."""
    cut_up = id_text(docs).withColumn("parts", chunks(F.col("text")))
    listed = cut(
        cut_up.select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform("parts", lambda c: F.struct(F.xxhash64(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("parts"),
        ),
        "recipes",
    )
    store = listed.select(F.explode("parts").alias("c")).groupBy("c.h", "c.n").agg(F.min(F.hex("c.sha")).alias("low"), F.max(F.hex("c.sha")).alias("high"))
    # True only if two different chunks share a 64-bit hash and a length; then every identifier is the SHA-256
    clash = bool(store.where("low <> high").take(1))
    one = F.transform("parts", lambda c: F.hex(c["sha"]) if clash else F.concat_ws(":", F.hex(c["h"]), c["n"]))
    return listed.select("doc_id", "text_sha256", one.alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its group), group_size, kept, text_sha256."""
    listed = cut(recipes(docs).select("doc_id", "text_sha256", F.concat_ws(",", "recipe").alias("recipe")), "listed")
    groups = cut(listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    found = join_groups(listed, groups, ["recipe"], "group_size")
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    Ids of which no row stays are dropped by id alone, so that no text takes part in that join's other side, and texts are
    moved once at most. Only ids that keep a row and stand in several, and null ids, are told apart by text."""
    found = cut(exact_dedup(docs), "copies").select("doc_id", "kept", F.col("text_sha256").alias("sha"))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("stays"))
    odd_one = F.expr("stays and (n > 1 or doc_id is null)").alias("odd")
    marked = cut(ids.where("not stays or n > 1 or doc_id is null").select("doc_id", odd_one), "marked")
    left = without_ids(docs, marked.select("doc_id"))
    odd = marked.where("odd").select("doc_id")
    if not odd.take(1):
        return left
    own, sha, stays = (unused(docs, n) for n in ("_id", "_sha", "_stays"))
    stay = found.where("kept").join(odd.select(F.col("doc_id").alias(own)), F.expr(f"doc_id <=> {own}")).select(own, F.col("sha").alias(stays)).distinct()
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    same = F.expr(f"cast(doc_id as long) <=> {own} and {sha} = {stays}")
    several = docs.withColumn(sha, digest).join(stay, same, "left_semi").dropDuplicates(["doc_id", sha])
    return left.unionByName(several.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
