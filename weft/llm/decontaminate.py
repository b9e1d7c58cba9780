"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over some words; its zeros are positions that don't count.
A document and an item overlap if a window of 13 words agrees in at least 80 % of
them; an item of fewer words is one window, all of it.

* Two masks over eight words together hit every 13-word window that differs in at
  most two words, wherever the two stand.
* A shorter item that may differ in s words has s + 1 masks, each with every
  (s + 1)-th of its words: s substitutions leave one of them whole.

Tests prove both for every permitted pattern. The hashes of the items' seeds and
of the documents' are joined, and the hits verified: some window that holds the
seed must agree in enough words. A bit map of the items' hashes, whose size is
bounded, keeps document seeds that can't hit out of the join; the more items, the
more pass it, and the join decides.

Seeds of a document (or an item) that have the same hash and the same words
around them are one before they are joined, so repeated words don't multiply.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import map_arrow
from .common import column, settle, staged, text_of
from .words import PIECE, hashed_words, mix, pieces_of, plain_text

MASKS = ("11101011", "11001111")
WINDOW, LEAST = 13, 0.8
#: Words around a seed of a 13-word window: all windows that hold it lie in them.
BEFORE, AROUND = WINDOW - len(MASKS[0]), 2 * WINDOW - len(MASKS[0])
#: The bit map has 16 bits a seed, and never more than 2 ** 27 (16 MB).
LEAST_BITS, MOST_BITS = 16, 27
CHUNK = 50_000


def needed(window: int) -> int:
    """Words of a window that must agree."""
    return math.ceil(LEAST * window - 1e-9)


def masks_of(window: int) -> tuple[str, ...]:
    """Masks that together hit a window of so many words whatever permitted words differ."""
    if window == WINDOW:
        return MASKS
    parts = window - needed(window) + 1
    return tuple("".join("1" if i % parts == k else "0" for i in range(window)) for k in range(parts))


def seed_hashes(words: np.ndarray, at: np.ndarray, mask: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a mask at every place where it fits into one text."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(len(words) - span + 1, int(mask, 2) + (window << 32), np.uint64)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - span + 1 + j]
    ends = np.repeat(at[1:], np.diff(at))[: len(out)]
    where = np.flatnonzero(np.arange(len(out)) + span <= ends)
    return where, mix(out[where])


def _around(words: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """[seed, word] the words of all windows that hold a seed; 0 where the text has none."""
    low, size = (BEFORE, AROUND) if window == WINDOW else (0, window)
    spot = place[:, None] + np.arange(-low, size - low)
    inside = (spot >= at[text][:, None]) & (spot < at[text + 1][:, None])
    out = np.zeros((len(place), AROUND), np.uint64)
    out[:, :size] = np.where(inside, words[np.clip(spot, 0, len(words) - 1)], np.uint64(0))
    return out


def _distinct(text: np.ndarray, place: np.ndarray, seed: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Rows that are the first of their text with their seed and words."""
    key = np.ascontiguousarray(np.concatenate([text[:, None].astype(np.uint64), seed[:, None], around], 1))
    order = np.argsort(place, kind="stable")
    _, first = np.unique(key[order].view([("", np.uint64)] * key.shape[1]).ravel(), return_index=True)
    return order[first]


def _seeds(text_col: str, keys: list[str], windows: tuple[int, ...], known, whole_only: bool):
    """Seeds of each text: ``keys``, then seed, window, place, words around. ``known`` is the bit map, if any; with ``whole_only`` a text of fewer than 13 words is one window."""

    def run(batches):
        bits = None if known is None else known.value
        for b in pieces_of(batches, text_col, PIECE):
            words, at = hashed_words(b.column(text_col))
            words[words == 0] = np.uint64(1)
            n_words = np.diff(at)
            for window in windows:
                found = []
                for mask in masks_of(window):
                    place, seed = seed_hashes(words, at, mask, window)
                    if bits is not None and len(seed):
                        slot = seed >> np.uint64(64 - int(math.log2(len(bits) * 8)))
                        on = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        place, seed = place[on], seed[on]
                    text = np.searchsorted(at, place, "right") - 1
                    if whole_only:
                        on = n_words[text] >= WINDOW if window == WINDOW else n_words[text] == window
                        place, seed, text = place[on], seed[on], text[on]
                    for low in range(0, len(place), CHUNK):
                        part = slice(low, low + CHUNK)
                        around = _around(words, at, text[part], place[part], window)
                        keep = _distinct(text[part], place[part], seed[part], around)
                        found.append((text[part][keep], place[part][keep], seed[part][keep], around[keep]))
                if not found:
                    continue
                text, place, seed, around = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = _distinct(text, place, seed, around)
                text, place, seed, around = text[keep], place[keep], seed[keep], around[keep]
                flat = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((np.arange(len(text) + 1) * AROUND * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(around))])
                cols = [*(b.column(c).take(pa.array(text)) for c in keys), pa.array(seed.view(np.int64)), pa.array(np.full(len(text), window, np.int32)), pa.array(place - at[text], pa.int64()), flat]
                yield pa.RecordBatch.from_arrays(cols, [*keys, "seed", "window", "place", "around"])

    return run


def _agreement(doc: np.ndarray, item: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(words that agree in the best full window of each pair, where it starts among the words around)."""
    same, inside = (doc == item) & (doc != 0), (doc != 0) & (item != 0)
    starts = AROUND - WINDOW + 1 if window == WINDOW else 1
    agree = np.stack([np.where(inside[:, s : s + window].all(1), same[:, s : s + window].sum(1), -1) for s in range(starts)], 1)
    return agree.max(1), agree.argmax(1)


def _verify(keys: list[str]):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                b = batch.slice(low, CHUNK)
                doc, item = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, AROUND) for c in ("around", "_around"))
                window = b.column("window").to_numpy()
                agree, shift = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for w in np.unique(window):
                    of = window == w
                    agree[of], shift[of] = _agreement(doc[of], item[of], int(w))
                    shift[of] -= BEFORE if w == WINDOW else 0
                good = np.flatnonzero(agree >= np.array([needed(int(w)) for w in window]))
                cols = [b.column(c).take(pa.array(good)) for c in keys]
                cols += [pa.array(x[good].astype(np.int64)) for x in (window, agree, b.column("place").to_numpy() + shift, b.column("_place").to_numpy() + shift)]
                yield pa.RecordBatch.from_arrays(cols, [*keys, "window", "agree", "word", "item_word"])

    return run


def _bit_map(seeds: DataFrame) -> np.ndarray:
    """Bytes of a map with a bit for each seed's leading bits."""
    n = seeds.count()
    size = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * n + 1))))
    slot = F.call_function("shiftrightunsigned", F.col("seed"), F.lit(64 - size))
    rows = seeds.groupBy(F.floor(slot / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``_id, _row, _item, window, agree, word, item_word``: the best window of each document and item."""
    spark = docs.sparkSession
    id_type, item_type = docs.select(column(id_col)).schema[0].dataType.simpleString(), benchmark.select(column(item_col)).schema[0].dataType.simpleString()
    tail = "seed long, window int, place long, around binary"
    items = benchmark.select(column(item_col).alias("_item"), plain_text(item_text_col).alias("_text"))
    seeds = staged(items.transform(map_arrow, _seeds("_text", ["_item"], tuple(range(1, WINDOW + 1)), None, True), f"_item {item_type}, {tail}"), "seeds")
    windows = tuple(sorted(r[0] for r in seeds.select("window").distinct().collect()))
    known = spark.sparkContext.broadcast(_bit_map(seeds))
    rows = docs.select(column(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row"), plain_text(text_col).alias("_text"))
    hits = rows.transform(map_arrow, _seeds("_text", ["_id", "_row"], windows, known, False), f"_id {id_type}, _row long, {tail}")
    theirs = seeds.select(F.col("seed").alias("_seed"), F.col("window").alias("_window"), "_item", F.col("place").alias("_place"), F.col("around").alias("_around"))
    pairs = hits.join(theirs, (F.col("seed") == F.col("_seed")) & (F.col("window") == F.col("_window")))
    good = pairs.transform(map_arrow, _verify(["_id", "_row", "_item"]), f"_id {id_type}, _row long, _item {item_type}, window long, agree long, word long, item_word long")
    best = F.min(F.struct((-F.col("agree") / F.col("window")).alias("r"), "word", "item_word", "window", "agree"))
    return good.groupBy("_id", "_row", "_item").agg(best.alias("best")).select("_id", "_row", "_item", "best.window", "best.agree", "best.word", "best.item_word")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that overlap: ``id_col, item_col, window, agree, word, item_word``.

    ``agree`` of ``window`` words are the same in the best window (the first of
    equals), which starts at ``word`` of the document and ``item_word`` of the item.

    * items of 1 to 12 words are one window; those of up to 4 words match whole
    * null and empty texts match nothing; null ids are reported as null
    * rows that share an id are reported by text, so an id may come more than once
      an item; rows that repeat an id and a text are one, items that share an id too
    * an empty table on either side gives an empty result; other columns, of any name, are ignored
    """
    return _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col).drop("_row").withColumnsRenamed({"_id": id_col, "_item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all its columns, without the rows that ``contamination`` finds.

    Null and empty texts stay, and so does every row if the benchmark is empty.
    Rows that repeat an id and a text go together. Columns may have any name.
    """
    marks = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col).select("_id", F.col("_row").alias("_key"), F.lit(True).alias("_drop")).distinct()
    return settle(docs, id_col, F.xxhash64(text_of(text_col)), marks)
