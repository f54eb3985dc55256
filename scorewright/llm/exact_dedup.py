"""Exact deduplication by whole normalised content, safe under skew.

Copies are combined in three steps, each of which groups by the full content and
not by its digest alone: within a map task (partial aggregation), within a salted
digest group, and over the winners of all salts.  A group of copies that holds a
third of all rows thus reaches no task whole.  Rows find their group by digest and
salt; should two contents ever share a digest, the query stops instead of merging
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.graph import salts_for
from scorewright.llm.textops import empty_text, take_rows, text_tag, written

# Fixed value: the characters that normalisation deletes.
DELETED = " \t\n\x0b\f\r"


def exact_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is the empty text.  The row with most code points stays, then the one
    with the smallest doc_id; a null doc_id loses against any other.  Rows that
    repeat the winning doc_id are all marked kept (the id is what identifies a row);
    an empty table gives no rows; only doc_id and text are read.  ``salts``: as many as keep
    every salt of a group bounded, unless given.
    """
    salts = salts or salts_for(docs.count())
    text = empty_text()
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.translate(text, DELETED, "").alias("norm"),
        F.char_length(text).alias("n_points"),
    ).withColumns(
        {"sha": F.sha2("norm", 256), "salt": F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(salts)).cast("int")}
    )
    order = F.struct((-F.col("n_points")).alias("least"), F.col("doc_id").isNull().alias("none"), "doc_id")
    local = base.groupBy("sha", "salt", "norm").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    whole = local.groupBy("sha", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    groups = whole.groupBy("sha").agg(
        F.first("best").alias("best"), F.first("n").alias("n"), F.count("*").alias("contents")
    )
    groups = groups.select(
        "sha",
        F.col("best.doc_id").alias("keep_id"),
        F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share a digest"))).otherwise(F.col("n")).alias("group_size"),
    )
    rows = written(base.select("doc_id", "sha", "salt"), "dedup-rows")
    routed = rows.groupBy("sha", "salt").agg(F.count("*").alias("_")).join(groups, "sha")
    return rows.join(routed, ["sha", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row of ``docs`` for each group of equal texts, with all its columns.

    Null text is the empty text.  The row with most code points stays, then the one with the
    smallest doc_id (null last), then the one whose text has the smallest digest; of rows that
    repeat id and text one is taken.  An empty table gives no rows; columns of any name are kept.
    """
    salts = salts or salts_for(docs.count())
    text = empty_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n_points"), text_tag().alias("tag"), F.translate(text, DELETED, "").alias("norm")
    ).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    salt = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(salts)).cast("int")
    order = F.struct((-F.col("n_points")).alias("least"), F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    local = rows.groupBy("sha", salt.alias("salt"), "norm").agg(F.min(order).alias("best"))
    best = local.groupBy("sha", "norm").agg(F.min("best").alias("best")).select("best.doc_id", "best.tag")
    times = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1")
    keep = best.alias("b").join(times.alias("t"), F.expr("b.doc_id <=> t.doc_id AND b.tag = t.tag"), "left")
    return take_rows(docs, written(keep.select("b.doc_id", "b.tag", F.coalesce("n", F.lit(1)).alias("n")), "keep"))
