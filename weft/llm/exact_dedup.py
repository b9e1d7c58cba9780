"""Exact deduplication that keeps frequent texts out of the shuffle.

Digests of normalised texts are made once. A Misra-Gries summary names the few
digests that may be frequent; exact counts over all rows verify them, and the
winners that really hold more than ``support`` of the rows (fewer than
``1 / support`` of them) are broadcast, so rows of heavy groups are settled where
they are read. All other digests take an ordinary shuffle: an aggregate that
combines on the map side, joined back by a join that can split large keys.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, frequent_values, settle, staged, text_of

#: The part of all rows beyond which a digest counts as heavy; the summary has as many counters as this has parts in one.
SUPPORT = 1 / 8192
BLANKS = "[\\x20\\x09-\\x0D]+"


def text_digest(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text with every run of blanks made one space."""
    return F.sha2(F.regexp_replace(text_of(text), BLANKS, " ").cast("binary"), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    * null text counts as the empty text; all empty texts are one group
    * the smallest id of a group stays; null ids come after all others, and a
      group of null ids only keeps them (``keep_id`` null)
    * rows that repeat both id and text are one document stored twice: they
      count in ``group_size`` and share one decision
    * an empty table gives an empty result; other columns, of any name, are ignored
    """
    rows = staged(docs.select(column(id_col).alias("_id"), text_digest(text_col).alias("_digest")), "digests")
    candidates = frequent_values(rows, "_digest", support)
    counts = rows.join(F.broadcast(candidates), "_digest").groupBy("_digest").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = staged(counts.where(F.col("group_size") > support * rows.count()), "winners")
    heavy = rows.join(F.broadcast(winners), "_digest")
    light = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
    # The key is written anew, so that the join does not take over the aggregate's partitions and can split a key.
    groups = light.groupBy("_digest").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")).select(F.concat("_digest", F.lit("")).alias("_d"), "keep_id", "group_size")
    light = light.join(groups, F.col("_digest") == F.col("_d")).drop("_d")
    return heavy.unionByName(light).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """``docs``, all its columns, with one row of each group of equal texts: that with the smallest id.

    * null and empty texts are one group; null ids come after all others
    * of rows that repeat the id and text that stays, one stays
    * an empty table gives an empty result; other columns may have any name
    """
    groups = exact_groups(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), support=support)
    marks = groups.where("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key")).agg(F.min(~F.col("kept")).alias("_drop"), F.count("*").alias("_n")).where("_drop OR _n > 1").drop("_n")
    return settle(docs, id_col, text_digest(text_col), marks)
