"""Exact deduplication in three combining steps, safe for groups of any size.

1. Copies that a task reads are combined before anything is shuffled (partial aggregation).
2. Groups of (digest, salt, whole normalised text) are merged; the salt spreads a huge group over many tasks.
3. The winners of the salts, at most ``salts`` per group, meet under (digest, whole normalised text).

Rows are compared by their full normalised content in all three steps; the digest only places them.  The group
results then go back to the documents by thin (digest, salt) rows, so the texts are not shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.llm.common import BLANKS, free_name


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when identical after deleting ASCII white space; a null text counts as empty, and all empty
    texts form one group.  Of a group the row with the most code points, then the smallest id stays (a null id
    sorts first).  Repeated rows of one id are counted one by one and marked alike.  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("doc_id", F.length("text").alias("n_chars"), F.translate("text", BLANKS, "").alias("norm"))
            .select("doc_id", "n_chars", "norm", F.sha2("norm", 256).alias("text_sha256"),
                    F.xxhash64("norm").alias("probe"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")))
    salted = (rows.groupBy("text_sha256", "probe", "salt", "norm")
              .agg(F.count(F.lit(1)).alias("copies"),
                   F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id"))).alias("best")))
    same = Window.partitionBy("text_sha256", "norm")
    groups = salted.select("text_sha256", "probe", "salt", F.sum("copies").over(same).alias("group_size"),
                           F.min("best").over(same)["doc_id"].alias("keep_id"))
    return (rows.select("doc_id", "text_sha256", "probe", "salt").join(groups, ["text_sha256", "probe", "salt"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows of a kept id and text become one.

    Rows go back by id and text digest, so that different texts under one id, or without an id, all stay.  Columns of any
    name are kept as they are.
    """
    kept = exact_groups(docs, id_col, text_col, salts).where("kept") \
        .select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__kept_sha")).distinct()
    digest = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANKS, ""), 256)
    sha = free_name(docs, "__sha")
    own = docs.withColumn(sha, digest)
    same = own[id_col].eqNullSafe(kept["__kept"]) & (own[sha] == kept["__kept_sha"])
    return own.join(kept, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n"""
