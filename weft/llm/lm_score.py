"""Language-model scoring by cross-entropy difference.

A target model and a background model, both bigram models with the same
vocabulary and smoothing, are counted over all documents: rows of the target
feed one, all other rows the other. They are matched: the larger one's counts are
scaled to as many tokens as the smaller one has, so a pair weighs against the
smoothing alike in both and neither gains by its size. No document is scored by
its own text: its pairs and their contexts are taken out of the model that it
feeds. (Unigrams, which only smooth, are of all documents.) A document's score is
the mean over its tokens of the background's loss less the target's: higher is
more like the target.

The vocabulary holds every word of the corpus. The counts are never in one place:

1. Words are counted in a shuffle of what each task has summed. The counts of
   heavy words (more than a quarter of a bucket of tokens) are broadcast, and so
   are those of the pairs of heavy words that are as frequent.
2. Each document's pairs are dealt to buckets of about ``bucket_tokens`` tokens by
   their second word, whose pairs, total and total as a context thus meet in one
   bucket. Pairs that end in a heavy word are dealt by the pair. Heavy pairs are
   settled from the broadcast counts and are not sent.
3. Each bucket counts what it got, and sends each document's share of the losses
   back to the piece of the input that the document is in.

Tasks exchange packed arrays, a row for each piece and bucket. What is broadcast
is at most four words and four pairs a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import map_arrow
from .common import column, drop_table, staged
from .words import hashed_words, mix, pieces_of, plain_text

#: What stands before a text's first token.
START = np.uint64(0x5354415254)
#: Strength of the unigrams behind the bigrams, and of the uniform distribution behind the unigrams.
STRENGTH, DISCOUNT = 8.0, 1.0
PIECE = 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pieces(batches):
    """Pieces whose rows can be named by 16 bits."""
    for b in pieces_of(batches, "_text", PIECE):
        for k in range(0, b.num_rows, 1 << 16):
            yield b.slice(k, 1 << 16)


def _pair_hash(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(word * _STEP + before)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted value, whether it is there)."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def _tokens(b: pa.RecordBatch, vocab: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(word, word before, whether the text ends with it, row, whether the row is of the target) of each token, and each text's number of tokens."""
    words, at = hashed_words(b.column("_text"))
    if vocab is not None:
        words = np.where(_find(vocab, words)[1], words, np.uint64(0))
    n = np.diff(at)
    before = np.empty(len(words), np.uint64)
    before[1:] = words[:-1]
    before[at[:-1][n > 0]] = START
    last = np.zeros(len(words), bool)
    last[at[1:][n > 0] - 1] = True
    target = b.column("_target").to_numpy(zero_copy_only=False).astype(bool)
    return words, before, last, np.repeat(np.arange(len(n)), n), np.repeat(target, n), n


def _totals(keys: np.ndarray, *amounts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    values, place = np.unique(keys, return_inverse=True)
    return values, [np.bincount(place, a, len(values)).astype(np.int64) for a in amounts]


def _vocabulary(rows: DataFrame, size: int) -> np.ndarray:
    """The ``size - 1`` most frequent words (ties by hash), sorted."""

    def count(batches):
        for b in _pieces(batches):
            values, n = np.unique(hashed_words(b.column("_text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    counts = rows.transform(map_arrow, count, "word long, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size - 1).select("word")
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


class _Counts:
    """What is known before pairs are dealt: size of the vocabulary, tokens and texts of each model, heavy words and pairs.

    ``totals``, ``contexts`` and ``pairs`` have a row for each model; model 0 is the target.
    """

    def __init__(self, size: int, tokens: np.ndarray, texts: np.ndarray, buckets: int):
        self.size, self.tokens, self.texts, self.buckets = size, tokens, texts, buckets
        self.words, self.totals, self.contexts = np.zeros(0, np.uint64), np.zeros((2, 0)), np.zeros((2, 0))
        self.pair_keys, self.pairs = np.zeros(0, np.uint64), np.zeros((2, 0))

    def is_heavy(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return _find(self.words, word)[1] & ((before == START) | _find(self.words, before)[1])

    @property
    def scale(self) -> np.ndarray:
        """What each model's counts are multiplied by, to match the smaller one. A model without a token is uniform."""
        return min((t for t in self.tokens if t > 0), default=1.0) / np.maximum(self.tokens, 1.0)

    def unigram(self, model: int, total: np.ndarray) -> np.ndarray:
        r = self.scale[model]
        return (r * total + DISCOUNT) / (r * self.tokens[model] + DISCOUNT * self.size)

    def of_pairs(self, model: int, n: np.ndarray, pair: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Loss of a text's ``n`` tokens of a pair, but for its context; ``pair`` is without the text's own."""
        return -n * np.log(self.scale[model] * pair + STRENGTH * self.unigram(model, total))

    def of_contexts(self, model: int, inner: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Loss of the ``inner`` tokens of a text that follow a word; ``context`` is without the text's own."""
        return inner * np.log(self.scale[model] * context + STRENGTH)


def _count(rows: DataFrame, vocab, vocab_size: int | None, bucket_tokens: int) -> _Counts:
    names = ["word", "target", "other", "inner_target", "inner_other"]
    kept = rows.sparkSession.sparkContext.broadcast(vocab)

    def words(batches):
        for b in _pieces(batches):
            word, _, last, _, target, n = _tokens(b, kept.value)
            values, sums = _totals(word, target, ~target, target & ~last, ~target & ~last)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (values.view(np.int64), *sums)], names)

    kind = ", ".join(f"{c} long" for c in names)
    table = staged(rows.transform(map_arrow, words, kind).groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]]), "words")
    all_ = table.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in names[1:]]).first()
    tokens, inner = np.array(all_[1:3], float), np.array(all_[3:5], float)
    buckets = max(64, int(tokens.sum()) // bucket_tokens)
    out = _Counts(vocab_size or all_[0] + 1, tokens, tokens - inner, buckets)
    least = max(1, int(tokens.sum()) // (4 * buckets))
    heavy = _columns(table.where(F.col("target") + F.col("other") > least).orderBy("word").toArrow(), *names)
    order = np.argsort(heavy[0].view(np.uint64))
    out.words, out.totals, out.contexts = heavy[0].view(np.uint64)[order], np.stack(heavy[1:3])[:, order].astype(float), np.stack(heavy[3:5])[:, order].astype(float)
    drop_table(table)
    shared = rows.sparkSession.sparkContext.broadcast(out)

    def pairs(batches):
        for b in _pieces(batches):
            word, before, _, _, target, _ = _tokens(b, kept.value)
            at = shared.value.is_heavy(word, before)
            values, sums = _totals(_pair_hash(word[at], before[at]), target[at], ~target[at])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (values.view(np.int64), *sums)], names[:3])

    found = rows.transform(map_arrow, pairs, "word long, target long, other long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("other").alias("other"))
    heavy = _columns(found.where(F.col("target") + F.col("other") > least).toArrow(), *names[:3])
    order = np.argsort(heavy[0].view(np.uint64))
    out.pair_keys, out.pairs = heavy[0].view(np.uint64)[order], np.stack(heavy[1:3])[:, order].astype(float)
    return out


def _deal(shared, kept):
    """A row for each piece (bucket below 0: ids, numbers of tokens and what is known of the losses) and for each piece and bucket."""

    def run(batches):
        c: _Counts = shared.value
        for b in _pieces(batches):
            word, before, last, row, _, n = _tokens(b, kept.value)
            # Each text's distinct pairs; a text's last token differs from others of its pair only in a count.
            pair = _pair_hash(word, before)
            order = np.lexsort((pair, row))
            new = np.ones(len(order), bool)
            new[1:] = (pair[order][1:] != pair[order][:-1]) | (row[order][1:] != row[order][:-1])
            start = np.flatnonzero(new)
            times = np.diff(np.append(start, len(order)))
            ends = np.add.reduceat(last[order].astype(np.int64), start) if len(start) else times
            first = order[start]
            word, before, row, pair = word[first], before[first], row[first], pair[first]
            feeds = b.column("_target").to_numpy(zero_copy_only=False).astype(bool)
            place, heavy = _find(c.words, word)
            at, settled = _find(c.pair_keys, pair)
            settled &= heavy
            # How often each text has each heavy word before another: what it has to take out of that context.
            of_heavy = np.flatnonzero(heavy)
            key, spot = np.unique(row[of_heavy] * max(1, len(c.words)) + place[of_heavy], return_inverse=True)
            inner = np.bincount(spot, (times - ends)[of_heavy], len(key))
            key_row, key_place = key // max(1, len(c.words)), key % max(1, len(c.words))
            known = []
            for m in (0, 1):
                own = feeds == (m == 0)
                loss = c.of_pairs(m, times[settled], c.pairs[m][at[settled]] - times[settled] * own[row[settled]], c.totals[m][place[settled]])
                context = c.of_contexts(m, inner, c.contexts[m][key_place] - inner * own[key_row])
                begin = np.where(n > 0, np.log(c.scale[m] * (c.texts[m] - own) + STRENGTH), 0)
                known.append(np.bincount(row[settled], loss, b.num_rows) + np.bincount(key_row, context, b.num_rows) + begin)
            piece, ids = int(b.column("_row")[0].as_py()), b.column("_id")
            yield _packed(piece, -1 - piece % c.buckets, ids, n.astype(np.int64), *known)
            left = np.flatnonzero(~settled)
            bucket = (mix(np.where(heavy[left], pair[left], word[left])) % np.uint64(c.buckets)).astype(np.int64)
            order = np.lexsort((before[left], word[left], bucket))
            left, bucket = left[order], bucket[order]
            flags = (feeds[row] + 2 * (ends > 0)).astype(np.uint8)  # a text has one last token
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                k = left[i:j]
                yield _packed(piece, int(bucket[i]), ids[:0], word[k], before[k], row[k].astype(np.uint16), times[k].astype(np.uint32), flags[k])

    return run


_BLOCKS = [f"c{k}" for k in range(5)]


def _packed(piece: int, bucket: int, ids: pa.Array, *arrays: np.ndarray) -> pa.RecordBatch:
    blocks = [pa.array([a.tobytes()], pa.binary()) for a in arrays] + [pa.array([None], pa.binary())] * (len(_BLOCKS) - len(arrays))
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([bucket], pa.int32()), listed, *blocks], ["piece", "bucket", "ids", *_BLOCKS])


def _of(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(column)]


def _settle(shared):
    """The losses of a bucket's pairs, summed by text."""

    def run(table: pa.Table) -> pa.Table:
        c: _Counts = shared.value
        if table.column("bucket")[0].as_py() < 0:
            return table
        none = table.column("ids").chunk(0).values[:0]
        parts = [_of(table, f"c{k}", kind) for k, kind in enumerate((np.uint64, np.uint64, np.uint16, np.uint32, np.uint8))]
        sizes = [len(x) for x in parts[0]]
        word, before, row, times, flags = (np.concatenate(p) for p in parts)
        times, target, ends = times.astype(np.int64), (flags & 1) == 1, (flags >> 1).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes) * (1 << 16) + row
        order = np.lexsort((text, before, word))
        w, p = word[order], before[order]
        new_word = np.ones(len(w), bool)
        new_word[1:] = w[1:] != w[:-1]
        new_pair = new_word.copy()
        new_pair[1:] |= p[1:] != p[:-1]
        of_word, of_pair = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
        of_word[order], of_pair[order] = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
        # Other parts of a heavy word are elsewhere; what follows it was settled where its text is.
        place, heavy = _find(c.words, w[new_word])
        light = ~heavy[of_word]
        # How often each text has each light word before another.
        own_key, own_spot = np.unique(np.stack([of_word[light], text[light]]), axis=1, return_inverse=True)
        inner = np.bincount(own_spot.ravel(), (times - ends)[light], own_key.shape[1])
        feeds = np.zeros(own_key.shape[1], bool)
        feeds[own_spot.ravel()] = target[light]
        spots, losses = np.concatenate([text, own_key[1]]), []
        for m in (0, 1):
            own = target == (m == 0)
            pair, total, context = np.bincount(of_pair, times * own), np.bincount(of_word, times * own), np.bincount(of_word, (times - ends) * own)
            total[heavy] = c.totals[m][place[heavy]]
            of_texts = c.of_contexts(m, inner, context[own_key[0]] - inner * (feeds == (m == 0)))
            losses.append(np.concatenate([c.of_pairs(m, times, pair[of_pair] - times * own, total[of_word]), of_texts]))
        order = np.argsort(spots >> 16, kind="stable")
        spots, losses = spots[order], [x[order] for x in losses]
        ends_at = np.searchsorted(spots >> 16, np.arange(len(sizes) + 1))
        out = []
        for k, piece in enumerate(table.column("piece").to_pylist()):
            here = slice(ends_at[k], ends_at[k + 1])
            rows, place = np.unique((spots[here] & 0xFFFF).astype(np.uint16), return_inverse=True)
            out.append(_packed(piece, 0, none, rows, *[np.bincount(place, x[here]).astype(np.float32) for x in losses]))
        return pa.Table.from_batches(out)

    return run


def _gather(id_col: str):
    """The sums of each of a piece's texts."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_numpy()
        head = table.slice(int(np.flatnonzero(bucket < 0)[0]), 1)
        n = _of(head, "c0", np.int64)[0]
        sums = [_of(head, f"c{m + 1}", np.float64)[0].copy() for m in (0, 1)]
        rest = table.filter(pa.array(bucket >= 0))
        for rows, *losses in zip(_of(rest, "c0", np.uint16), _of(rest, "c1", np.float32), _of(rest, "c2", np.float32), strict=True):
            for total, loss in zip(sums, losses, strict=True):
                total[rows] += loss
        ce = [s / np.maximum(n, 1) for s in sums]
        ids = head.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(n), pa.array(ce[0]), pa.array(ce[1]), pa.array(ce[1] - ce[0])], [id_col, "n_tokens", "ce_target", "ce_background", "score"])

    return run


def lm_scores(docs: DataFrame, is_target: Column, id_col: str = "doc_id", text_col: str = "text", vocab_size: int | None = None, bucket_tokens: int = 1 << 19) -> DataFrame:
    """``id_col, n_tokens, ce_target, ce_background, score`` for every row.

    ``vocab_size`` bounds the vocabulary to its most frequent words and one entry
    for all others; without it every word counts.

    * null and empty texts, and texts without a word: 0 tokens, all figures 0
    * a null ``is_target`` counts as false; null and repeated ids are scored like others
    * without target rows (or others) that model is uniform; an empty table gives an empty result
    * other columns, of any name, are ignored
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(column(id_col).alias("_id"), plain_text(text_col).alias("_text"), F.coalesce(is_target, F.lit(False)).alias("_target"))
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "texts")
    vocab = _vocabulary(rows, vocab_size) if vocab_size else None
    counts = _count(rows, vocab, vocab_size, bucket_tokens)
    shared, kept = context.broadcast(counts), context.broadcast(vocab)
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    blocks = f"piece long, bucket int, ids array<{id_type}>, " + ", ".join(f"{c} binary" for c in _BLOCKS)
    settled = rows.transform(map_arrow, _deal(shared, kept), blocks).groupBy("bucket").applyInArrow(_settle(shared), blocks)
    return settled.groupBy("piece").applyInArrow(_gather(id_col), f"`{id_col}` {id_type}, n_tokens long, ce_target double, ce_background double, score double")
