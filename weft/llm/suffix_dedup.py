"""Removal of byte strings that occur twice, by induced sorting of sampled suffixes.

A string of ``length`` bytes is removed wherever it starts if it also starts
elsewhere in the corpus. Sorting every suffix would move many times the input, so
only sampled suffixes are sorted and the others are induced from them:

1. In each window of ``length`` bytes the leftmost smallest hash of a 32-byte
   gram names an anchor (about one byte in 64). It depends on the window's bytes
   alone, so equal windows have their anchors at equal places.
2. All windows around an anchor lie in its context (at most 168 bytes before, 200
   from it on). A context that occurs twice settles all of its windows. What is
   left are anchors that share their gram but not their context.
3. These contexts are dealt to shards by gram, and each shard is sorted by gram
   and suffix; the sorter merges runs that it spilled to disk. From the order of
   the suffixes at the anchors, with the common prefixes of neighbours, follow
   the orders one byte further left, and so on: suffixes with the same byte in
   front keep their order, their common prefixes grow by one. A window is
   repeated if a neighbour's common prefix reaches ``length``.
4. A task's memory holds one group of at most ``most`` contexts. The windows of a
   larger one are halved by where they start, each half keyed by the longer string
   that its windows share, until the groups fit or a key is a whole window, which
   a count settles. No group is too large, and results don't depend on ``most``.

Texts, anchors and contexts stay in tables; nothing but counts reaches the driver.
Two hashes name a text (96 bits together), a context (with its gram, 128) and a
half (96), so that chance equalities are not expected in a corpus of any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import map_arrow
from .common import column, dealt_anew, drop_table, staged, text_of
from .words import mix, pieces_of, raw_bytes

GRAM = 32
SEGMENT = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7331).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE_BITS = np.uint64(28)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step, and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * SEGMENT)
        with np.errstate(over="ignore"):
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                _POWERS[name] = np.cumprod(powers)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= w:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if w > size else out


def _anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, place, left, right, gram, context) of every anchor of the texts ``data[at[i]:at[i+1]]``."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return none
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n])])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        place = np.arange(len(gram), dtype=np.uint64)
        least = _window_min((gram >> _PLACE_BITS << _PLACE_BITS) | place, length - GRAM + 1)
        # A window counts if it ends in the text in which it starts.
        starts = np.repeat(at[1:], np.diff(at))[: len(least)] - np.arange(len(least)) >= length
        spot = (least[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
        new = np.ones(len(spot), bool)
        new[1:] = spot[1:] != spot[:-1]
        spot = np.unique(spot[new])
        if not len(spot):
            return none
        text = np.searchsorted(at, spot, "right") - 1
        low, high = np.maximum(spot - (length - GRAM), at[text]), np.minimum(spot + length, at[text + 1])
        left, right = spot - low, high - spot
        shape = left.astype(np.uint64) * np.uint64(1 << 32) + right.astype(np.uint64)
        context = mix(mix((sums[high] - sums[low]) * down[low]) + shape)
    return text, spot - at[text], left, right, gram[spot], context


def _find_anchors(length: int):
    names = ["key", "key2", "place", "left", "right", "gram", "context"]

    def out(b, found):
        text, place, left, right, gram, context = found
        ints = [pa.array(place, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))]
        return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(text)) for c in ("key", "key2")], *ints], names)

    def run(batches):
        for b in pieces_of(batches, "bytes", SEGMENT):
            data, at = raw_bytes(b.column("bytes"))
            if len(data) <= 2 * SEGMENT:
                yield out(b, _anchors(data, at, length))
                continue
            # One long text: segments, with all that windows starting in them can see.
            for cut in range(0, len(data), SEGMENT):
                low, high = max(0, cut - length), min(len(data), cut + SEGMENT + 2 * length)
                text, place, left, right, gram, context = _anchors(data[low:high], np.array([0, high - low]), length)
                place = place + low
                # Neighbours see these anchors too; each is emitted by the segment that its place is in, which holds its whole context.
                own = (place >= cut) & (place < cut + SEGMENT)
                yield out(b, (text[own], place[own], left[own], right[own], gram[own], context[own]))

    return run


def _cut_contexts(batches):
    """bytes around each wanted anchor of a text."""
    for b in pieces_of(batches, "bytes", SEGMENT):
        where = b.column("wanted")
        n = where.value_lengths().to_numpy(zero_copy_only=False)
        flat = where.flatten()
        data, at = raw_bytes(b.column("bytes"))
        text = np.repeat(np.arange(len(n)), n)
        low = at[text] + flat.field("place").to_numpy(zero_copy_only=False) - flat.field("left").to_numpy(zero_copy_only=False)
        size = (flat.field("left").to_numpy(zero_copy_only=False) + flat.field("right").to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        taken = data[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])] if len(size) else np.zeros(0, np.uint8)
        piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken))])
        yield pa.RecordBatch.from_arrays([flat.field("context"), flat.field("gram"), flat.field("left"), flat.field("right"), piece], ["context", "gram", "left", "right", "bytes"])


def _common_prefix(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (the first: 0)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def induce(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """[context, window] whether the window that starts ``o`` bytes before the anchor is repeated in its group.

    Contexts are sorted by group and by their suffix from ``low`` bytes before the
    anchor; a group's ``low`` and ``high`` bound the windows looked at.
    """
    n = len(group)
    size = np.diff(at)
    begin = at[:-1] + left - low
    span = np.arange(length)
    known = np.minimum(size - left + low, length)
    rows = np.where(span < known[:, None], data[np.minimum(begin[:, None] + span, len(data) - 1)], 0)
    prefix = _common_prefix(rows, known)
    prefix[1:][group[1:] != group[:-1]] = 0
    table = [prefix]
    while (1 << len(table)) < n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    flat = np.zeros((len(table), n), np.int64)
    for k, t in enumerate(table):
        flat[k, : len(t)] = t
    repeated = np.zeros((n, length - GRAM + 1), bool)
    live, kind = np.arange(n), np.cumsum(np.append(0, group[1:] != group[:-1]))
    for step in range(length - GRAM + 1):
        pair = kind[1:] == kind[:-1]
        i, j = live[:-1][pair], live[1:][pair]
        # Common prefix of two suffixes: the least between neighbours from one to the other.
        level = np.log2(np.maximum(j - i, 1)).astype(np.int64)
        common = np.minimum(flat[level, i + 1], flat[level, j - (1 << level) + 1])
        hit = common + step >= length
        o = low[i[hit]] + step
        repeated[i[hit], o] = True
        repeated[j[hit], o] = True
        # One byte further left: contexts that have it, in groups that still hold two.
        more = (left[live] - low[live] > step) & (high[live] - low[live] > step)
        together = np.zeros(len(live), bool)
        together[1:] |= pair
        together[:-1] |= pair
        on = more & together
        live, kind = live[on], kind[on]
        if len(live) < 2:
            break
        front = data[begin[live] - step - 1].astype(np.int64)
        order = np.argsort(kind * 256 + front, kind="stable")
        live = live[order]
        sort_key = (kind * 256 + front)[order]
        kind = np.cumsum(np.append(0, sort_key[1:] != sort_key[:-1]))
    return repeated


def _covered(repeated: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the runs of bytes, relative to the anchor, that repeated windows cover."""
    n, windows = repeated.shape
    change = np.zeros((n, windows - 1 + length + 1), np.int16)
    change[:, :windows] += repeated[:, ::-1]
    change[:, length : length + windows] -= repeated[:, ::-1]
    inside = np.cumsum(change, 1, dtype=np.int16) > 0
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), inside.astype(np.int8)], 1), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, begin - (windows - 1), end - (windows - 1)


def _induce_shard(length: int, batch_rows: int = 8192):
    def settle(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        col = {c: (pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v) for c, v in col.items()}
        num = {c: col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "low", "high", "left")}
        data, at = raw_bytes(col["bytes"])
        repeated = induce(num["group"], num["low"], num["high"], num["left"], data, at, length)
        parts = [_covered(repeated[k : k + batch_rows], length) for k in range(0, len(repeated), batch_rows)]
        row = np.concatenate([p[0] + k * batch_rows for k, p in enumerate(parts)])
        begin, end = (np.concatenate([p[c] for p in parts]) for c in (1, 2))
        return pa.RecordBatch.from_arrays([*[col[c].take(pa.array(row)) for c in ("context", "gram")], pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["context", "gram", "begin", "end"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            group = b.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), b.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if n >= batch_rows and held[-1].column("group")[-1].as_py() != group[low]:
                    yield settle(held)
                    held, n = [], 0
                held.append(b.slice(low, high - low))
                n += high - low
        if held:
            yield settle(held)

    return run


#: Names of a text.
KEYS = ["key", "key2"]


def _keyed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    return docs.select(*more, F.xxhash64(text_of(text_col)).alias("key"), F.hash(text_of(text_col)).alias("key2"), text_of(text_col).cast("binary").alias("bytes"))


def _united(parts: str) -> Column:
    """Sorted runs with those that overlap or touch made one."""

    def step(out, x):
        last = F.try_element_at(out, F.lit(-1))
        apart = F.coalesce(x["begin"] > last["end"], F.lit(True))
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.concat(out, F.array(x))).otherwise(F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(parts, F.expr("cast(array() as array<struct<begin:int,end:int>>)"), step)


def repeated_runs(docs: DataFrame, text_col: str = "text", length: int = 200, most: int = 4096) -> DataFrame:
    """``key, key2, runs``: for texts (named by two hashes) with repeated strings, the array of ``begin, end`` that cover them."""
    texts = _keyed(docs, text_col)
    anchors = staged(texts.where(F.octet_length("bytes") >= length).transform(map_arrow, _find_anchors(length), "key long, key2 int, place int, left int, right int, gram long, context long"), "anchors")
    # All of these take the values of one row of a context, any of them.
    contexts = staged(anchors.groupBy("context", "gram").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*KEYS, "place", "left", "right")]), "contexts")
    open_ = contexts.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select(dealt_anew("gram").alias("g"))
    whole = contexts.where((F.col("n") > 1) & (F.col("left") + F.col("right") >= length)).select("context", "gram", (-F.col("left")).alias("begin"), F.col("right").alias("end"))
    whole = staged(whole, "whole")
    wanted = contexts.join(open_, contexts["gram"] == open_["g"], "left_semi").groupBy(*KEYS).agg(F.collect_list(F.struct("context", "gram", "place", "left", "right")).alias("wanted")).select(F.col("key").alias("k"), F.col("key2").alias("k2"), "wanted")
    wanted = staged(wanted, "wanted")
    drop_table(contexts)
    # Copies of a text hash alike; the first of them that a task meets will do, as contexts are made distinct below.
    cut = texts.join(wanted, (texts["key"] == wanted["k"]) & (texts["key2"] == wanted["k2"])).select("bytes", "wanted").transform(map_arrow, _cut_contexts, "context long, gram long, left int, right int, bytes binary")
    pieces = staged(cut.dropDuplicates(["context", "gram"]), "pieces")
    drop_table(wanted)
    done = [anchors, whole, pieces]
    entries = pieces.select("*", F.col("gram").alias("group"), F.lit(0).alias("group2"), F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"))
    small, settled = [], []
    while True:
        sizes = staged(entries.groupBy("group", "group2").agg(F.count("*").alias("members")).where("members > 1").select(dealt_anew("group").alias("g"), dealt_anew("group2").alias("g2"), "members"), "sizes")
        done.append(sizes)
        big = sizes.where(F.col("members") > most)
        of_group = (F.col("group") == F.col("g")) & (F.col("group2") == F.col("g2"))
        inner, leaf = entries.where("low < high"), entries.where("low = high")
        settled.append(leaf.join(sizes, of_group, "left_semi").select("context", "gram", (-F.col("low")).alias("begin"), (F.lit(length) - F.col("low")).alias("end")))
        if big.isEmpty():
            small.append(inner)
            break
        small.append(inner.join(big, of_group, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        common = F.expr(f"substring(bytes, left - low + 1, low + {length} - high)")
        split = (
            inner.join(big, of_group, "left_semi")
            .select("context", "gram", "left", "right", "bytes", F.explode(halves).alias("half"))
            .select("context", "gram", "left", "right", "bytes", F.col("half.low").alias("low"), F.col("half.high").alias("high"))
            # Windows from high to low bytes before the anchor share what lies between; a context without such a window goes.
            .where((F.least("high", "left") >= F.greatest("low", F.lit(length) - F.col("right"))))
            .withColumns({"group": F.xxhash64("low", "high", common), "group2": F.hash("low", "high", common)})
        )
        entries = staged(split, "halves")
        done.append(entries)
    shards = small[0]
    for s in small[1:]:
        shards = shards.unionByName(s)
    shards = shards.repartition("group").withColumn("suffix", F.expr("substring(bytes, left - low + 1)")).sortWithinPartitions("group", "suffix").select("context", "gram", "group", "low", "high", "left", "bytes")
    induced = shards.transform(map_arrow, _induce_shard(length), "context long, gram long, begin int, end int")
    for s in settled:
        induced = induced.unionByName(s)
    # A context of a split group has a run from each of its parts; they are made one before they meet the anchors.
    parts = induced.unionByName(whole).groupBy("context", "gram").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("parts"))
    covered = staged(parts.select("context", "gram", F.inline(_united("parts"))), "covered")
    found = anchors.select(*KEYS, "place", "context", "gram").join(covered, ["context", "gram"])
    runs = staged(found.groupBy(*KEYS).agg(F.collect_set(F.struct((F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("end")).alias("end"))).alias("runs")), "runs")
    for table in (*done, covered):
        drop_table(table)
    return runs


def _strip(names: list[str]):
    def run(batches):
        for b in pieces_of(batches, "bytes"):
            data, at = raw_bytes(b.column("bytes"))
            removed, spans, shas, kept = [], [], [], []
            for k, found in enumerate(b.column("runs")):
                text = data[at[k] : at[k + 1]]
                if found.is_valid and len(found):
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, found.values.field("begin").to_numpy(), 1)
                    np.add.at(change, found.values.field("end").to_numpy(), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(text.tobytes())
                shas.append(hashlib.sha256(kept[-1]).hexdigest())
            cols = [*[b.column(c) for c in names], pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, most: int = 4096) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row.

    ``kept`` is what is left, as bytes: a cut may fall into a character.

    * null is the empty text; texts under ``length`` bytes lose nothing
    * a text that occurs twice loses all of it, in every row
    * null ids and rows that repeat an id are rows like others; an empty table
      gives an empty result
    * other columns, of any name, are ignored
    """
    runs = repeated_runs(docs, text_col, length, most)
    rows = _keyed(docs, text_col, column(id_col).alias("_id")).join(runs, KEYS, "left")
    kind = docs.select(column(id_col)).schema[0].dataType.simpleString()
    out = rows.select("_id", "bytes", "runs").transform(map_arrow, _strip(["_id"]), f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("_id", id_col)
