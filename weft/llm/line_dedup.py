"""Line deduplication that returns bitmaps instead of text.

Lines become (digest, document, position) rows. Digests that a Misra-Gries
summary finds and a count verifies to hold more than ``support`` of all lines get
their first document from an aggregate that combines on the map side, and are
settled by a broadcast of fewer than ``1 / support`` rows. The rest are range-partitioned by digest and sorted by document and position, so
one pass over each partition meets every line's first occurrence first. What
leaves is a sparse bitmap of dropped lines per document.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, column, fresh, frequent_values, staged, text_of
from .exact_dedup import SUPPORT

BLANK_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_BITS = 62


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _row_key(text_col: str) -> Column:
    return F.xxhash64(text_of(text_col))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, support: float = SUPPORT) -> DataFrame:
    """Lines to drop: ``_id, _row, n_dropped, words``.

    ``words`` has ``(word, bits)`` pairs in order; bit ``b`` of word ``w`` stands
    for line ``62 * w + b`` from 0. Documents that lose nothing have no row.

    * a line's key is the line without blanks at its ends, A-Z in lower case
    * keys under ``min_chars`` code points never drop
    * rows with a null id hold no keys and lose no lines
    * rows that share an id are one document; each loses lines by the same rule
    * other columns, of any name, are ignored
    """
    lines = staged(
        docs.where(column(id_col).isNotNull())
        .select(column(id_col).alias("_id"), _row_key(text_col).alias("_row"), F.posexplode(F.split(ascii_lower(text_of(text_col)), "\n")).alias("_pos", "_line"))
        .withColumn("_key", F.btrim("_line", F.lit(BLANK_CHARS)))
        .where(F.char_length("_key") >= min_chars)
        .select(F.md5(F.col("_key").cast("binary")).alias("_digest"), "_id", "_row", "_pos"),
        "lines",
    )
    candidates = frequent_values(lines, "_digest", support)
    counts = lines.join(F.broadcast(candidates), "_digest").groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    winners = staged(counts.where(F.col("_n") > support * lines.count()).drop("_n"), "winners")
    heavy = lines.join(F.broadcast(winners), "_digest")
    seen = Window.partitionBy("_digest").orderBy("_id", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    light = (
        lines.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
        .repartitionByRange("_digest")
        .sortWithinPartitions("_digest", "_id", "_pos")
        .withColumn("_first", F.first("_id").over(seen))
    )
    word = F.floor(F.col("_pos") / WORD_BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, pmod(_pos, {WORD_BITS}))")
    return (
        heavy.unionByName(light)
        .where(F.col("_id") > F.col("_first"))
        .groupBy("_id", "_row", word.alias("_word"))
        .agg(F.bit_or(bit).alias("_bits"))
        .groupBy("_id", "_row")
        .agg(F.sum(F.bit_count("_bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct(F.col("_word").alias("word"), F.col("_bits").alias("bits")))).alias("words"))
    )


def apply_line_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` cut to the kept lines, and ``n_lines, n_dropped`` beside it (in place of columns of these names).

    Texts without a bitmap stay where they are read; only the others meet their bitmaps in a join.
    """
    docs = docs.drop("n_lines", "n_dropped")
    bitmaps = staged(bitmaps, "bitmaps")
    key, b_id, b_row, b_n, b_words = fresh(docs, "_row_key", "_b_id", "_b_row", "_b_n", "_b_words")
    table = bitmaps.select(
        F.col("_id").alias(b_id),
        F.col("_row").alias(b_row),
        F.col("n_dropped").alias(b_n),
        F.expr("transform(sequence(0, element_at(words, -1).word), w -> coalesce(element_at(map_from_entries(words), w), 0L))").alias(b_words),
    )
    rest, some = apart(docs.withColumn(key, _row_key(text_col)), F.xxhash64(column(id_col), F.col(key)), bitmaps, F.xxhash64("_id", "_row"))
    # Bitmaps grow with the documents, so they are never broadcast, at no size.
    joined = some.join(table.hint("merge"), (column(id_col) == F.col(b_id)) & (F.col(key) == F.col(b_row)), "left")
    lines = F.split(text_of(text_col), "\n")

    def stays(_, i):
        return F.coalesce(F.get(b_words, F.floor(i / WORD_BITS).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(WORD_BITS)))), F.lit(0)) == 0

    def cut(rows: DataFrame, dropped: Column, kept: Column) -> DataFrame:
        return rows.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": dropped.cast("long"), text_col: kept}).drop(key, b_id, b_row, b_n, b_words)

    some = cut(joined, F.coalesce(b_n, F.lit(0)), F.when(F.col(b_n).isNull(), text_of(text_col)).otherwise(F.array_join(F.filter(lines, stays), "\n")))
    return cut(rest, F.lit(0), text_of(text_col)).unionAll(some)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, support: float = SUPPORT) -> DataFrame:
    """``docs`` without repeated lines; see ``line_bitmaps`` and ``apply_line_bitmaps``. An empty table gives an empty result."""
    return apply_line_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars, support), id_col, text_col)
