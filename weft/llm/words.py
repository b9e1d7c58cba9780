"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word is a run of letters and digits; ``plain_text`` has the JVM put a space in
place of everything else, so that here every byte above 127 is part of a word.
Hashes are polynomials over a word's bytes, modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import text_of

#: Bytes that are worked on at once, so that memory does not follow the batch.
PIECE = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_IS_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20177).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plain_text(column: str | Column) -> Column:
    """Lower case, everything but letters, marks and digits a space; null is empty."""
    text = text_of(column)
    lowered = F.lower(text)
    # Pure ASCII needs no regular expression: the byte table below parts its words the same way.
    return F.when(F.octet_length(text) == F.char_length(text), lowered).otherwise(F.regexp_replace(lowered, r"[^\p{L}\p{M}\p{N}]+", " "))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls; offsets start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words)."""
    data, at = raw_bytes(texts)
    hashes, begins = [], []
    breaks = at[1:-1]
    cut = 0
    while cut < len(data):
        end = min(len(data), cut + PIECE)
        while end < len(data) and _IS_WORD[data[end]]:  # a piece ends between words
            nxt = np.flatnonzero(~_IS_WORD[data[end : end + 4096]])
            end = end + int(nxt[0]) if len(nxt) else min(len(data), end + 4096)
        part = data[cut:end]
        is_word = _IS_WORD[part]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = is_word[:-1]
        inner = breaks[np.searchsorted(breaks, cut) : np.searchsorted(breaks, end)] - cut
        before[inner] = False
        first = is_word & ~before
        idx = np.flatnonzero(is_word)
        if len(idx):
            starts = np.flatnonzero(first)
            heads = np.flatnonzero(first[idx])
            length = np.diff(np.append(heads, len(idx)))
            place = np.arange(len(idx)) - np.repeat(heads, length)
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
                hashes.append(mix(np.add.reduceat(_VALUE[part[idx]] * powers[place], heads) + length.astype(np.uint64)))
            begins.append(starts + cut)
        cut = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), at)


def shingles(words: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's runs of ``n`` words, offsets). A text of 1 to n-1 words has one run, all of it."""
    count = np.diff(at)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    if not len(words):
        return np.zeros(0, np.uint64), out_at
    doc = np.repeat(np.arange(len(count)), runs)
    start = at[doc] + np.arange(out_at[-1]) - out_at[doc]
    out = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            inside = start + j < at[doc + 1]
            out = out * _STEP + np.where(inside, words[np.minimum(start + j, len(words) - 1)], np.uint64(j + 1))
    return mix(out), out_at


def sorted_unique(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values of each group in order, offsets, how often each occurs)."""
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    where = np.flatnonzero(new)
    return values[where], np.searchsorted(group[where], np.arange(len(at))), np.diff(np.append(where, len(values)))


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
