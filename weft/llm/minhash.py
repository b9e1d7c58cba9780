"""Near-duplicate detection by DartMinHash.

A document is the multiset of its runs of five words, and a run's weight is how
often it occurs (with ``weighted`` off, the set). Darts are thrown into regions of
(element, weight, rank): each element has strips of weight [0, 1), [1, 2), [2, 4),
[4, 8) and so on, in each of which the same Poisson process of hashed darts falls
in every document; an element of weight w has those below w. A strip's width is
its rate, so the cost follows the darts that count and the logarithm of a weight,
not the weight. Darts up to a rank at which a document expects ``k ln k + 3 k`` of
them are thrown; each falls on one of ``k`` coordinates, and the earliest on a
coordinate is its value, so two documents agree on a coordinate with the
probability of their weighted Jaccard similarity (shared over all occurrences).
Bands of coordinates are joined, and candidates are verified by the
exact similarity.

With 30 bands of 5 a pair of similarity 0.8 misses every band with probability
7e-6.

Links are found without pairing all members of a bucket:

* documents with equal multisets are one node, however many copies there are
* in each bucket every node is compared with one leader; components follow
* where a bucket still spans several components, nodes of other components are
  compared with a further leader (``rounds`` times)
* what still spans several components is compared across them

Buckets hold numbers and sizes only; maps and then sets go to the pairs that are
left. Joins on buckets and on nodes are by sort-merge at every size, so that what
is moved grows with the rows and not with the planner's choice.

Before sets are fetched, a pair must pass two exact bounds: sizes within the
threshold, and a parity map. Every element flips one of 2048 bits, so the bits in
which two maps differ are a lower bound of how many elements the sets don't
share (a close one while those are fewer than the bits). No pair that could reach the threshold is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import map_arrow
from .common import TEXT_ROWS, among, apart, column, dealt_anew, drop_table, settle, staged, text_of
from .components import components
from .words import hashed_words, lists, mix, pieces_of, plain_text, shingles, sorted_unique

BANDS, ROWS = 30, 5
PARITY_WORDS = 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(elements: np.ndarray, weights: np.ndarray, at: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """[document, coordinate] values of the documents whose elements are ``elements[at[i]:at[i+1]]`` with weights over 0. Empty documents get zeros."""
    n_docs = len(at) - 1
    strips = 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), strips)
    nth = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    with np.errstate(over="ignore"):
        seed = mix(elements[element] + _GOLD * nth.astype(np.uint64))
    low = np.where(nth == 0, 0.0, 2.0 ** (nth - 1))
    width = np.where(nth == 0, 1.0, low)
    part = np.minimum(weights[element] - low, width)  # how much of its strip the element covers
    doc = np.repeat(np.repeat(np.arange(n_docs), np.diff(at)), strips)
    total = np.maximum(np.bincount(doc, part, n_docs), 1e-12)
    reach = (k * np.log(k) + 3 * k) / total
    best = np.full(n_docs * k, np.inf)
    value = np.zeros(n_docs * k, np.uint64)
    live = np.arange(len(element))
    while len(live):
        s, d, c, r, top = seed[live], doc[live], (part / width)[live], width[live], reach[doc[live]]
        state = s
        rank = np.zeros(len(live))
        ranks, cells, values = [], [], []
        while len(s):
            with np.errstate(over="ignore"):
                state = mix(state + _GOLD)
            rank = rank - np.log(_uniform(state)) / r
            on = rank <= top
            s, d, c, r, top, state, rank = s[on], d[on], c[on], r[on], top[on], state[on], rank[on]
            dart = mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            inside = (c >= 1) | (_uniform(mix(dart + np.uint64(1))) <= c)
            ranks.append(rank[inside])
            cells.append(d[inside] * k + (dart[inside] % np.uint64(k)).astype(np.int64))
            values.append(dart[inside])
        rank, cell, dart = np.concatenate(ranks), np.concatenate(cells), np.concatenate(values)
        np.minimum.at(best, cell, rank)
        first = rank == best[cell]
        value[cell[first]] = dart[first]
        # A document with a coordinate that no dart reached throws again, twice as far.
        short = np.isinf(best.reshape(n_docs, k)).any(1) & (np.diff(at) > 0)
        reach[short] *= 2
        live = np.flatnonzero(short[doc])
    return value.reshape(n_docs, k)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(values), 1))
    cut = values.reshape(len(values), bands, rows)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * _GOLD + cut[:, :, j])
    return out


def _occurrences(runs: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence of a run as an element of its own (the first, the second ...), so that multisets are compared as sets."""
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        values = np.where(nth == 0, np.repeat(runs, counts), mix(np.repeat(runs, counts) + _GOLD * nth.astype(np.uint64)))
    return values, np.concatenate([[0], np.cumsum(counts)])[at]


def _sketch(bands: int, rows: int, n: int, weighted: bool):
    def run(batches):
        seen: set[int] = set()
        for b in pieces_of(batches, "_text", 1 << 18):
            runs, runs_at, counts = sorted_unique(*shingles(*hashed_words(b.column("_text")), n))
            values, at = (_occurrences(runs, runs_at, counts)) if weighted else (runs, runs_at)
            size = np.diff(at)
            with np.errstate(over="ignore"):
                ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * _GOLD), dtype=np.uint64)])
                key = mix(ends[at[1:]] - ends[at[:-1]] + size.astype(np.uint64)).view(np.int64)
            # A task sends a set once, and that of a copy is null. It remembers a bounded number of sets; a copy of one that it no longer knows is sent again, and made one below.
            new = np.zeros(len(key), bool)
            for i in np.flatnonzero(size > 0):
                if key[i] not in seen:
                    new[i] = True
                    if len(seen) < 1_000_000:
                        seen.add(int(key[i]))
            take = np.repeat(new, size)
            some_at = np.concatenate([[0], np.cumsum(size[new])])
            sets = lists((values[take] >> np.uint64(32)).astype(np.uint32).view(np.int32), some_at, pa.int32())
            own = np.repeat(new, np.diff(runs_at))
            weights = counts[own].astype(float) if weighted else np.ones(int(own.sum()))
            keys = band_keys(signatures(runs[own], weights, np.concatenate([[0], np.cumsum(np.diff(runs_at)[new])]), bands * rows), bands, rows)
            buckets = lists(keys.ravel().view(np.int64), np.arange(len(keys) + 1) * bands, pa.int64())
            parity = np.zeros(len(some_at[:-1]) * PARITY_WORDS, np.uint64)
            spread = mix(values[take] + np.uint64(77))
            word = np.repeat(np.arange(len(some_at) - 1), np.diff(some_at)) * PARITY_WORDS + (spread % np.uint64(PARITY_WORDS)).astype(np.int64)
            np.bitwise_xor.at(parity, word, np.uint64(1) << (spread >> np.uint64(58)))
            maps = lists(parity.view(np.int64), np.arange(len(some_at)) * PARITY_WORDS, pa.int64())
            spot = pa.array(np.where(new, np.cumsum(new) - 1, 0), mask=~new)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), pa.array(key), pa.array(size, pa.int32()), sets.take(spot), buckets.take(spot), maps.take(spot)], ["_id", "_row", "_k", "_n", "_set", "_buckets", "_map"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, bands: int = BANDS, rows_per_band: int = ROWS, rounds: int = 2, weighted: bool = True) -> DataFrame:
    """One row per input row: ``id_col, class_id, class_size, kept, _row``.

    A class is a connected component of links, a link two texts whose multisets
    have a Jaccard similarity of ``threshold`` or more: the runs that both have,
    each as often as in the one that has it less, over each as often as in the one
    that has it more. ``class_id`` is its smallest id.

    * texts of one to four words have one run, all of it; texts without a word
      (null and empty too) are copies of each other
    * null ids come after all others; a class of null ids only has a null
      ``class_id`` and keeps them; rows that repeat an id and a text share a decision
    * ``_row`` is a hash of the text, to tell rows that repeat an id apart; of a
      class's rows with the smallest id, that with the smallest hash is kept
    * an empty table gives an empty result; other columns, of any name, are ignored

    Sets hold 32 bits of a run's hash, and a node is 64 bits of its set's. With
    ``weighted`` off, texts are sets.
    """
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    rows = staged(
        docs.select(column(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row"), plain_text(text_col).alias("_text")).transform(
            map_arrow, _sketch(bands, rows_per_band, shingle, weighted), f"_id {id_type}, _row long, _k long, _n int, _set array<int>, _buckets array<long>, _map array<long>"
        ),
        "sketches",
        TEXT_ROWS,
    )
    flat = rows.where("_buckets IS NOT NULL").select("_k", F.explode("_buckets").alias("bucket"))
    crowded = flat.groupBy("bucket").agg(F.min("_k").alias("lead"), F.max("_k").alias("most")).where("lead < most").select(dealt_anew("bucket").alias("_b"))
    met = staged(flat.join(crowded.hint("merge"), flat["bucket"] == crowded["_b"], "left_semi").distinct(), "buckets")
    involved = staged(met.select(dealt_anew("_k").alias("_i")).distinct(), "involved")
    # Most sets are in no shared bucket, and a bit map says so of nearly all of these before any set is moved. Joins are by sort-merge at every size.
    _, payload = apart(rows.where("_set IS NOT NULL").select("_k", "_n", "_map", "_set"), F.col("_k"), involved, F.col("_i"))
    nodes = staged(payload.join(involved.hint("merge"), payload["_k"] == involved["_i"], "left_semi").dropDuplicates(["_k"]), "nodes")
    drop_table(involved)
    shared = staged(met.join(nodes.select("_k", "_n").hint("merge"), "_k").select("bucket", "_k", "_n"), "buckets")
    drop_table(met)
    words = [F.get("_map", F.lit(w)).alias(f"m{w}") for w in range(PARITY_WORDS)]

    def sizes_fit(n1: str, n2: str) -> Column:
        return (F.col(n1) >= F.col(n2) * threshold - 1) & (F.col(n2) >= F.col(n1) * threshold - 1)

    def maps_fit(one: str, two: str) -> Column:
        """Few enough bits differ between the maps with these prefixes."""
        differ = sum((F.bit_count(F.col(f"{one}m{w}").bitwiseXOR(F.col(f"{two}m{w}"))) for w in range(PARITY_WORDS)), F.lit(0))
        return differ <= (1 - threshold) / (1 + threshold) * (F.col(f"{one}_n") + F.col(f"{two}_n")) + 1e-6

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])

    def mapped(pairs: DataFrame) -> DataFrame:
        """Of the distinct pairs ``a, b`` those whose maps are within the bound."""
        light = nodes.select("_k", "_n", *words)
        one, two = prefixed(light, "a"), prefixed(light, "b")
        return pairs.join(one.hint("merge"), F.col("a") == F.col("a_k")).join(two.hint("merge"), F.col("b") == F.col("b_k")).where(maps_fit("a", "b")).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        """``a, b, j`` of distinct pairs. Sets of nodes that are in no pair stay where they are."""
        pairs = staged(pairs, "pairs")
        some = among(nodes.select("_k", "_set"), F.col("_k"), pairs.select(F.explode(F.array("a", "b")).alias("_e")), F.col("_e"))
        one, two = some.select(F.col("_k").alias("a"), F.col("_set").alias("_sa")), some.select(F.col("_k").alias("b"), F.col("_set").alias("_sb"))
        both = F.size(F.array_intersect("_sa", "_sb"))
        out = staged(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", (both / (F.size("_sa") + F.size("_sb") - both)).alias("j")), "verified")
        drop_table(pairs)
        return out

    checked, roots = None, None
    for turn in range(rounds + 2):
        here = shared.withColumn("root", F.col("_k"))
        if roots is not None:
            here = shared.join(roots.hint("merge"), shared["_k"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "_k"))
        wide = here.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(dealt_anew("bucket").alias("_b"))
        open_ = staged(here.join(wide.hint("merge"), here["bucket"] == wide["_b"], "left_semi"), "open")
        if open_.isEmpty():
            break
        wider = None
        if turn <= rounds:
            # x -> x XOR h(bucket, turn) is a bijection, so its minimum is a random member on which all partial results agree.
            noise = F.xxhash64("bucket", F.lit(turn)) if turn else F.lit(0).cast("long")
            rank = F.col("_k").bitwiseXOR(noise)
            lead = open_.groupBy("bucket").agg(F.min(rank).alias("x"), F.min_by("root", rank).alias("lead_root"), F.min_by("_n", rank).alias("lead_n")).select(dealt_anew("bucket").alias("_b"), F.col("x").bitwiseXOR(noise).alias("pick"), "lead_root", "lead_n")
            met = open_.join(lead.hint("merge"), F.col("bucket") == F.col("_b")).where((F.col("root") != F.col("lead_root")) & sizes_fit("_n", "lead_n"))
            pairs = met.select(F.least("_k", "pick").alias("a"), F.greatest("_k", "pick").alias("b")).distinct()
        else:
            # All members are compared here, so both bounds hold in the join itself.
            wider = staged(open_.join(nodes.select(F.col("_k").alias("_i"), *words).hint("merge"), F.col("_k") == F.col("_i")).drop("_i"), "open")
            left, right = prefixed(wider, "a"), prefixed(wider, "b")
            near = (F.col("aroot") != F.col("broot")) & sizes_fit("a_n", "b_n") & maps_fit("a", "b")
            pairs = left.join(right.hint("merge"), (F.col("abucket") == F.col("bbucket")) & (F.col("a_k") < F.col("b_k")) & near).select(F.col("a_k").alias("a"), F.col("b_k").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        fresh = verify(mapped(pairs) if wider is None else pairs)
        drop_table(open_)
        if wider is not None:
            drop_table(wider)
        checked = fresh if checked is None else checked.unionByName(fresh)
        if roots is None or not fresh.where(F.col("j") >= threshold).isEmpty():
            roots = components(checked.where(F.col("j") >= threshold).select("a", "b"))
    drop_table(shared)
    drop_table(nodes)
    if roots is None:
        roots = docs.sparkSession.sql("SELECT 0L AS node, 0L AS root WHERE false")
    named = rows.select("_id", "_row", "_k").join(roots.hint("merge"), F.col("_k") == F.col("node"), "left").select("_id", "_row", F.coalesce("root", "_k").alias("_class"))
    named = staged(named, "classes")
    drop_table(rows)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    sizes = named.groupBy("_class").agg(first.alias("first"), F.count("*").alias("class_size")).select(dealt_anew("_class").alias("_c"), "first", "class_size")
    kept = F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_row") == F.col("first.row"))
    return named.join(sizes, named["_class"] == sizes["_c"]).select(F.col("_id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", kept.alias("kept"), "_row")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, **options) -> DataFrame:
    """``docs``, all its columns, with one row of each class: that with the smallest id (and of several rows with it, the one with the smallest hash of its text).

    * texts without a word, null and empty ones too, are one class
    * null ids come after all others; of rows that repeat the id and text that stays, one stays
    * an empty table gives an empty result; other columns may have any name
    """
    found = near_duplicates(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), threshold=threshold, **options)
    marks = found.where("class_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_key")).agg(F.min(~F.col("kept")).alias("_drop"), F.count("*").alias("_n")).where("_drop OR _n > 1").drop("_n")
    return settle(docs, id_col, F.xxhash64(text_of(text_col)), marks)
