"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import delete_folder, shared_folder, written

#: Bits of the map that ``apart`` broadcasts: 2**17 rows of two longs at most, whatever it is made from.
MAP_BITS = 1 << 23
#: Rows with whole texts that a Python worker is sent at once: Spark's 10000 are tens of MB in the executor and again in its worker.
TEXT_ROWS = 1000


def staged(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with files that survive lost executors, and keeps a
    table that several branches need from being computed once a branch. Operators
    drop the tables that nothing reads any more; those that their lazy results
    read are the caller's to remove, by ``drop_staged`` once results are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"
    out = written(df, path, batch_rows, compression="zstd")
    out._staged_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of one table that ``staged`` returned, once nothing reads it any more."""
    delete_folder(df.sparkSession, df._staged_at)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table that ``staged`` left in the shared folder for this application."""
    delete_folder(spark, f"{shared_folder(spark)}/weft/{spark.sparkContext.applicationId}")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def apart(docs: DataFrame, key: Column, table: DataFrame, table_key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in ``table``, the others), by a broadcast bit map of bounded size.

    Only the others need a join, so the texts of the first are not moved. The more
    keys ``table`` has, the more rows are among the others; nothing is decided here.
    """
    place, word, bits = fresh(docs, "_place", "_word", "_bits")
    at = F.pmod(table_key, F.lit(MAP_BITS))
    words = table.select(F.floor(at / 64).cast("long").alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    words = staged(words, "map")
    marked = docs.withColumn(place, F.pmod(key, F.lit(MAP_BITS)))
    joined = marked.join(F.broadcast(words), F.floor(F.col(place) / 64).cast("long") == F.col(word), "left")
    hit = F.coalesce(F.getbit(F.col(bits), F.pmod(F.col(place), F.lit(64)).cast("int")), F.lit(0)) == 1
    return joined.where(~hit).drop(place, word, bits), joined.where(hit).drop(place, word, bits)


def among(docs: DataFrame, key: Column, table: DataFrame, table_key: Column) -> DataFrame:
    """Rows whose key may be in ``table``, and of the others those few that share a place of the bit map with one of its keys."""
    return apart(docs, key, table, table_key)[1]


def settle(docs: DataFrame, id_col: str, key: Column, marks: DataFrame) -> DataFrame:
    """``docs`` after the decisions in ``marks`` (``_id, _key, _drop``, each pair once).

    Rows whose id and key are marked to drop go; of rows that repeat a marked id
    and key that is not to drop, one stays; all other rows stay. A null id is
    an id like others.
    """
    marks = staged(marks, "marks")
    mine, m_id, m_key, m_drop = fresh(docs, "_key_of", "_mark_id", "_mark_key", "_mark_drop")
    keyed = docs.withColumn(mine, key)
    rest, some = apart(keyed, F.xxhash64(column(id_col), column(mine)), marks, F.xxhash64("_id", "_key"))
    told = marks.select(F.col("_id").alias(m_id), F.col("_key").alias(m_key), F.col("_drop").alias(m_drop))
    joined = some.join(told, column(id_col).eqNullSafe(F.col(m_id)) & (F.col(mine) == F.col(m_key)), "left")
    once = joined.where(~F.col(m_drop)).dropDuplicates([id_col, mine])
    return rest.unionAll(joined.where(F.col(m_drop).isNull()).drop(m_id, m_key, m_drop)).unionAll(once.drop(m_id, m_key, m_drop)).drop(mine)


def text_of(column: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(f"`{column}`") if isinstance(column, str) else column, F.lit(""))


def dealt_anew(column: str | Column) -> Column:
    """An integer column, written so that the planner takes it for another one.

    A join on an aggregate's key uses the aggregate's own exchange, and then a key
    with very many rows on the other side can't be split at run time. Joining on
    this costs an exchange of the aggregate's few rows and lets it be split.
    """
    return F.bitwise_not(F.bitwise_not(column))


def frequent_values(df: DataFrame, column: str, support: float) -> DataFrame:
    """Candidates for values that hold more than ``support`` of the rows.

    Spark's ``freqItems`` is the Misra-Gries summary (in the form of Karp,
    Shenker and Papadimitriou): each task keeps at most ``1 / support`` counters
    and the summaries are merged, so the result has at most ``1 / support`` rows
    however large ``df`` is. Every value above the support is in it; others may
    be too, so callers verify with exact counts.
    """
    found = df.stat.freqItems([column], support)
    return found.select(F.explode(F.col(f"{column}_freqItems")).alias(column)).distinct()
