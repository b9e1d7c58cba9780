"""Toxicity by the nearest labelled examples.

Labelled examples, at most ``max_toxic`` and ``max_clean`` of them (those with
the smallest hash of their id), are indexed as TF-IDF vectors in an inverted
index whose posting lists are cut into blocks of examples; every block keeps its
largest weight. A document's largest possible cosine with any example of a block
follows from these, so blocks that can't hold one of the ``k`` nearest are never
opened, and the ``k`` found are exact. Their votes, weighted by cosine, are
calibrated on the examples themselves (each without its own vote).

The vectors span all words of the examples. A word weighs more the more its
presence depends on the label among them (likelihood ratio, against twice the log
of the number of words, which hardly a word exceeds by chance), but none weighs
nothing. idf comes from all documents.

Batches of documents go through the index together. A rare word has few postings,
which are gathered at once, so its part of the cosines is exact from the start; a
common word's postings are cut into blocks, as matrices. A block's bound for a
document is the common words' largest weights in it plus the largest of the exact
parts. The blocks of largest bound are opened first; what they hold sets the floor
under which no other block is opened. Examples are dealt to blocks by what they
have in common, which makes bounds tight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import map_arrow
from .common import column
from .linear import platt, sigmoid
from .words import hashed_words, pieces_of, plain_text, sorted_unique

BLOCK = 64
#: Words in more than this part of the examples are common.
COMMON = 16
#: Vectors that go through the index together.
BATCH = 64
#: Postings of rare words that are gathered at once, so that memory does not follow the length of texts.
GATHERED = 1 << 19


def _gather(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0]+1, ... for n[0] places, then low[1] and so on."""
    total = int(n.sum())
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total) if total else np.zeros(0, np.int64)


class BlockMaxIndex:
    """Examples as unit vectors: postings by word and block of examples."""

    def __init__(self, vocab: np.ndarray, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]):
        """``rows``: (word hashes, counts) of each example; neighbours in the list share blocks."""
        self.vocab, self.idf, self.size = vocab, idf, len(rows)
        self.n_blocks = max(1, -(-len(rows) // BLOCK))
        most = sum(len(h) for h, _ in rows)
        term, example, weight, end = np.zeros(most, np.int32), np.zeros(most, np.int32), np.zeros(most), 0
        for e, (h, c) in enumerate(rows):
            at, w = self.vector(h, c)
            term[end : end + len(at)], example[end : end + len(at)], weight[end : end + len(at)] = at, e, w
            end += len(at)
        term, example, weight = term[:end], example[:end], weight[:end]
        order = np.argsort(term, kind="stable")  # examples are in order already
        n = np.bincount(term, minlength=len(vocab))
        del term
        self._postings(n, example[order], weight[order])

    def _postings(self, n: np.ndarray, example: np.ndarray, weight: np.ndarray) -> None:
        """``n`` postings of each word, by word and example."""
        self.n, self.example, self.weight, self.entry_low = n, example.astype(np.int32), weight, None
        self.post_at = np.append(0, np.cumsum(n))
        common = np.flatnonzero(n > max(BLOCK, self.size // COMMON))
        self.dense_place = np.full(len(n), -1, np.int32)
        self.dense_place[common] = np.arange(len(common))
        self.blocks = [np.zeros((len(common), min(BLOCK, self.size - low))) for low in range(0, self.size, BLOCK)]
        # Word by word of the matrix, so that only the blocks are ever as large as it.
        for i, w in enumerate(common):
            here = slice(self.post_at[w], self.post_at[w + 1])
            block, place = np.divmod(self.example[here], BLOCK)
            cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            for j, end in zip(cut[:-1], cut[1:], strict=True):
                self.blocks[block[j]][i, place[j:end]] = weight[here][j:end]
        self.dense_max = np.stack([b.max(1) for b in self.blocks], axis=1) if self.size and len(common) else np.zeros((len(common), len(self.blocks)))

    def by_likeness(self) -> np.ndarray:
        """An order of the examples in which those of a block are alike in their common words."""
        return by_likeness(np.concatenate([b.T for b in self.blocks], dtype=np.float32)) if self.blocks else np.zeros(0, np.int64)

    def reorder(self, order: np.ndarray) -> None:
        """Put the examples in this order."""
        self.blocks = []  # room for the new ones
        place = np.empty(self.size, np.int32)
        place[order] = np.arange(self.size, dtype=np.int32)
        example = place[self.example]
        by = np.lexsort((example, np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)))
        self._postings(self.n, example[by], self.weight[by])

    def _cut_blocks(self) -> None:
        """Entries of words and blocks with their largest weights."""
        term = np.repeat(np.arange(len(self.n)), self.n)
        key = term * self.n_blocks + self.example // BLOCK
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        self.entry_block = (key[start] % self.n_blocks) if len(key) else key
        self.entry_low, self.entry_n = start, np.diff(np.append(start, len(key)))
        self.entry_max = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.term_at = np.searchsorted(key[start] // self.n_blocks, np.arange(len(self.n) + 1)) if len(key) else np.zeros(len(self.n) + 1, np.int64)

    def __getstate__(self) -> tuple:
        # Each executor keeps what is sent on disk: only the postings travel.
        return self.vocab, self.idf, self.size, self.n_blocks, self.n.astype(np.int32), self.example.astype(np.int32), self.weight

    def __setstate__(self, state: tuple) -> None:
        self.vocab, self.idf, self.size, self.n_blocks, n, example, weight = state
        self._postings(n.astype(np.int64), example.astype(np.int64), weight)

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the vocabulary, weights), of length 1 unless empty."""
        if not len(self.vocab):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        known = self.vocab[at] == hashes
        at = at[known]
        w = (1 + np.log(counts[known])) * self.idf[at]
        return at, w / max(1e-12, np.sqrt((w * w).sum()))

    def nearest_many(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each of many vectors."""
        out = []
        for low in range(0, len(vectors), BATCH):
            some = vectors[low : low + BATCH]
            if not self.size:
                out += [(np.zeros(0, np.int64), np.zeros(0))] * len(some)
                continue
            cosines = self._cosines(some, k)
            for cosine in cosines:
                floor = np.partition(cosine, self.size - k)[self.size - k] if self.size > k else 0.0
                found = np.flatnonzero((cosine > 0) & (cosine >= floor))
                order = found[np.lexsort((found, -cosine[found]))][:k]
                out.append((order, cosine[order]))
        return out

    def _cosines(self, some: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """[vector, example] cosines, exact wherever they may be among the ``k`` largest and less elsewhere."""
        terms, weights = (np.concatenate([v[c] for v in some]) for c in (0, 1))
        row = np.repeat(np.arange(len(some)), [len(v[0]) for v in some])
        dense = self.dense_place[terms]
        queries = np.zeros((len(some), len(self.dense_max)))
        queries[row[dense >= 0], dense[dense >= 0]] = weights[dense >= 0]
        terms, weights, row = terms[dense < 0], weights[dense < 0], row[dense < 0]
        n = self.post_at[terms + 1] - self.post_at[terms]
        exact = np.zeros(len(some) * self.size)
        ends = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(GATHERED, n.sum(), GATHERED), "right"), len(n)))
        for low, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            part = slice(low, end)
            post = _gather(self.post_at[terms[part]], n[part])
            exact += np.bincount(np.repeat(row[part], n[part]) * self.size + self.example[post], np.repeat(weights[part], n[part]) * self.weight[post], len(exact))
        exact = exact.reshape(len(some), self.size)
        if not len(self.dense_max):
            return exact
        starts = np.arange(0, self.size, BLOCK)
        bound = queries @ self.dense_max + np.maximum.reduceat(exact, starts, axis=1)
        opened = np.zeros(bound.shape, bool)
        first = max(2, -(-2 * k // BLOCK))
        chosen = np.zeros(bound.shape, bool)
        np.put_along_axis(chosen, np.argpartition(-bound, min(first, bound.shape[1]) - 1, axis=1)[:, :first], True, axis=1)
        for _ in range(2):
            for b in np.flatnonzero((chosen & ~opened).any(0)):
                who = np.flatnonzero(chosen[:, b] & ~opened[:, b])
                here = slice(starts[b], min(starts[b] + BLOCK, self.size))
                exact[who, here] += queries[who] @ self.blocks[b]
            opened |= chosen
            if self.size > k:
                # Unopened examples count with less than their cosine, so the k-th largest so far is a true floor.
                floor = np.partition(exact, self.size - k, axis=1)[:, self.size - k]
                chosen = bound >= floor[:, None] - 1e-9
            else:
                chosen = np.ones(bound.shape, bool)
        return exact

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest positive cosine (ties: first example), and their cosines. Exact."""
        if self.entry_low is None:
            self._cut_blocks()
        n = self.term_at[terms + 1] - self.term_at[terms]
        entry = _gather(self.term_at[terms], n)
        q = np.repeat(weights, n)
        block = self.entry_block[entry]
        bound = np.bincount(block, q * self.entry_max[entry], self.n_blocks)
        cosine = np.zeros(self.size)
        todo = bound > 0
        first = np.zeros(self.n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[: max(4, 2 * k // BLOCK)]] = True
        floor = 0.0
        for chosen in (first & todo, ~first & todo):
            chosen = chosen & (bound >= floor - 1e-9)
            if not chosen.any():
                continue
            open_ = chosen[block]
            e = entry[open_]
            post = _gather(self.entry_low[e], self.entry_n[e])
            cosine += np.bincount(self.example[post], np.repeat(q[open_], self.entry_n[e]) * self.weight[post], self.size)
            if self.size > k:
                floor = np.partition(cosine, self.size - k)[self.size - k]
        found = np.flatnonzero(cosine > 0)
        order = found[np.lexsort((found, -cosine[found]))][:k]
        return order, cosine[order]


def by_likeness(vectors: np.ndarray) -> np.ndarray:
    """An order of the rows in which those of a block are alike: halved again and again along the direction of largest spread."""
    order, todo = [], [np.arange(len(vectors))]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            order.append(part)
            continue
        x = vectors[part] - vectors[part].mean(0)
        way = x[np.argmax(np.einsum("ij,ij->i", x, x))]
        for _ in range(8):
            way = x.T @ (x @ way)
            way = way / max(1e-12, np.sqrt(way @ way))
        part = part[np.lexsort((part, x @ way))]
        cut = max(1, len(part) // (2 * BLOCK)) * BLOCK
        todo += [part[cut:], part[:cut]]
    return np.concatenate(order) if order else np.zeros(0, np.int64)


class Model:
    """Index, labels of its examples, and the calibration."""

    def __init__(self, index: BlockMaxIndex, ids: list, y: np.ndarray, prior: float, k: int):
        self.index, self.ids, self.y, self.prior, self.k = index, ids, y, prior, k
        self.slope, self.shift = 1.0, 0.0

    def margin(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the cosine-weighted votes, pulled to the prior by half a vote."""
        vote = (float(cosine @ self.y[near]) + 0.5 * self.prior) / (float(cosine.sum()) + 0.5)
        vote = min(max(vote, 1e-4), 1 - 1e-4)
        return float(np.log(vote / (1 - vote)))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, nearest examples, their cosines) of each text's (word hashes, counts)."""
        found = self.index.nearest_many([self.index.vector(h, c) for h, c in texts], self.k)
        return [(float(sigmoid(np.array(self.slope * self.margin(near, cosine) + self.shift))), near, cosine) for near, cosine in found]


def _g2(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Likelihood ratio of a word's presence in a of n_a and b of n_b examples."""
    out = np.zeros(len(a))
    n, total = a + b, n_a + n_b
    for seen, expected in ((a, n * n_a / total), (b, n * n_b / total), (n_a - a, (total - n) * n_a / total), (n_b - b, (total - n) * n_b / total)):
        out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return out


def _word_lists(batches):
    for b in pieces_of(batches, "_text"):
        values, at, n = sorted_unique(*hashed_words(b.column("_text")))
        where = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("_key"), pa.ListArray.from_arrays(where, pa.array(values.view(np.int64))), pa.ListArray.from_arrays(where, pa.array(n, pa.int32()))], ["_key", "words", "counts"])


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 2000, max_clean: int = 6000, k: int = 32) -> Model:
    """Index the examples. ``labels`` has only rows that may be learned from; null ids, null labels and ids with differing labels are not used."""
    known = labels.where(column(id_col).isNotNull() & column(label_col).isNotNull()).groupBy(column(id_col).alias("_key")).agg(F.min(label_col).cast("int").alias("_y"), F.max(label_col).cast("int").alias("_y2")).where("_y = _y2")
    sizes = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key").limit(most) for y, most in ((1, max_toxic), (0, max_clean))]
    # Never more than the two bounds, so it is broadcast and collected.
    sample = picked[0].unionByName(picked[1]).select("_key", "_y")
    y_of = {r[0]: r[1] for r in sample.collect()}
    key_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    keyed = docs.select(column(id_col).alias("_key"), plain_text(text_col).alias("_text"))
    ids = docs.sparkSession.createDataFrame([(x,) for x in y_of], f"_key {key_type}")
    table = keyed.join(F.broadcast(ids), "_key").transform(map_arrow, _word_lists, f"_key {key_type}, words array<long>, counts array<int>").toArrow()
    rows = sorted(((y_of[i], i, w.values.to_numpy().view(np.uint64), c.values.to_numpy()) for i, w, c in zip(table.column(0).to_pylist(), table.column(1), table.column(2), strict=True)), key=lambda r: (-r[0], r[1], len(r[2]))) if table.num_rows else []
    y = np.array([r[0] for r in rows], float)
    flat = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.uint64)
    vocab, inverse = np.unique(flat, return_inverse=True)
    a = np.bincount(inverse, np.repeat(y, [len(r[2]) for r in rows]), len(vocab)) if rows else np.zeros(0)
    b = np.bincount(inverse, minlength=len(vocab)) - a if rows else np.zeros(0)
    # Without both labels there is nothing to vote on.
    ratio = _g2(a, b, int(y.sum()), int(len(y) - y.sum())) if 0 < y.sum() < len(y) else np.zeros(0)
    vocab = vocab if len(ratio) else vocab[:0]
    del flat, inverse
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def count(batches):
        seen, total = np.zeros(len(shared.value), np.int64), 0
        for p in pieces_of(batches, "_text"):
            words, at = hashed_words(p.column("_text"))
            total += p.num_rows
            if len(shared.value):
                place = np.minimum(np.searchsorted(shared.value, words), len(shared.value) - 1)
                ok = shared.value[place] == words
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[ok]
                seen += np.bincount(np.unique(doc * len(shared.value) + place[ok]) % len(shared.value), minlength=len(shared.value))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], total))], ["term", "n"])

    counted = keyed.select("_text").transform(map_arrow, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(vocab) + 1)
    frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()  # the last is the number of texts
    idf = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1
    idf *= (1 + ratio) / (1 + ratio + 2 * np.log(max(2, len(vocab))))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    index = BlockMaxIndex(vocab, idf, [(r[2], r[3]) for r in rows])
    order = index.by_likeness()
    index.reorder(order)
    rows, y = [rows[i] for i in order], y[order]
    model = Model(index, [r[1] for r in rows], y, float(y.mean()) if rows else 0.0, k)
    if 0 < y.sum() < len(y):
        margins = []
        for e, (near, cosine) in enumerate(n for low in range(0, len(rows), BATCH) for n in model.index.nearest_many([model.index.vector(r[2], r[3]) for r in rows[low : low + BATCH]], k + 1)):
            other = near != e
            margins.append(model.margin(near[other][:k], cosine[other][:k]))
        # The examples hold more toxic ones than the labels do; weights restore the labels' share.
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.slope, model.shift = platt(np.array(margins), y, weight)
    else:
        model.slope, model.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    return model


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, evidence`` for every row; evidence lists the nearest examples (id, cosine), five at most.

    * null and empty texts, and texts without a word of the vocabulary, have no
      nearest examples and get the prior's calibrated score
    * null and repeated ids are scored like others; an empty table gives an empty result
    * other columns, of any name, are ignored
    """
    key_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_arrow = docs.select(column(id_col)).limit(0).toArrow().schema.field(0).type

    def score(batches):
        m = shared.value
        for b in pieces_of(batches, "_text"):
            words, at = hashed_words(b.column("_text"))
            if len(m.index.vocab):
                place = np.minimum(np.searchsorted(m.index.vocab, words), len(m.index.vocab) - 1)
                ok = m.index.vocab[place] == words
                at = np.concatenate([[0], np.cumsum(ok)])[at]
                words = words[ok]
            values, where, n = sorted_unique(words, at)
            got = m.scores([(values[i:j], n[i:j]) for i, j in zip(where[:-1], where[1:], strict=True)])
            p = np.array([g[0] for g in got])
            ids = [m.ids[e] for g in got for e in g[1][:5]]
            ends = np.concatenate([[0], np.cumsum([min(5, len(g[1])) for g in got])])
            pairs = pa.StructArray.from_arrays([pa.array(ids, id_arrow), pa.array([c for g in got for c in g[2][:5]], pa.float64())], ["id", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), evidence], ["_key", "score", "predicted", "evidence"])

    rows = docs.select(column(id_col).alias("_key"), plain_text(text_col).alias("_text"))
    return rows.transform(map_arrow, score, f"_key {key_type}, score double, predicted int, evidence array<struct<id:{key_type},cosine:double>>").withColumnRenamed("_key", id_col)
