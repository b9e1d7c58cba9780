"""Best-fit packing into sequences of several permitted lengths.

Texts longer than the largest capacity are cut into pieces of that size. Pieces
are dealt to shards by a hash of their row, about ``shard_tokens`` tokens to a
shard, however large the corpus; each shard packs its pieces by best fit
decreasing:

* a piece goes into the open bin with the least room that still holds it
* if none does, each capacity that holds it is filled, on trial, with the largest
  remaining pieces that fit; the one that costs least per token then in it is opened
* when all is placed, every bin takes the cheapest capacity that holds what it has

A capacity costs what a model's step over it does: its tokens, their attention,
which grows with the square (``capacity ** 2 / reach``), and ``overhead``. Short
sequences are cheaper per token if they are full, long ones if short ones would
waste more.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import map_arrow
from .common import column, staged, text_of

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD, REACH = 16, 1 << 15


def word_count(text_col: str = "text") -> Column:
    """Tokens as runs of characters other than blanks (null and empty: 0)."""
    return F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cost_of(capacity: int, overhead: float = OVERHEAD, reach: float = REACH) -> float:
    return capacity + capacity * capacity / reach + overhead


class _Trial:
    """Fills bins, on trial, with the pieces that follow one in order of length."""

    def __init__(self, lengths: Sequence[int]):
        self.lengths, self.falling = lengths, [-n for n in lengths]
        self.run_end = list(range(1, len(lengths) + 1))
        for k in range(len(lengths) - 2, -1, -1):
            if lengths[k] == lengths[k + 1]:
                self.run_end[k] = self.run_end[k + 1]

    def fill(self, k: int, capacity: int) -> int:
        """Tokens in a bin that holds piece ``k`` and then always the largest later piece that fits."""
        room, i, n = capacity - self.lengths[k], k + 1, len(self.lengths)
        while room > 0 and i < n:
            i = bisect_left(self.falling, -room, i)
            if i < n:
                room -= self.lengths[i] * min(self.run_end[i] - i, room // self.lengths[i])
                i = self.run_end[i]
        return capacity - room


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, reach: float = REACH) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, place in its bin, capacity of each bin). Lengths must be in order, longest first, over 0, and fit the largest capacity."""
    caps = sorted(capacities)
    cost = {c: cost_of(c, overhead, reach) for c in caps}
    trial = _Trial(lengths)
    bins: list[int] = []
    places: list[int] = []
    used: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin) of bins that still have some, in order
    for k, n in enumerate(lengths):
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = min((c for c in caps if c >= n), key=lambda c: (cost[c] / trial.fill(k, c), c)), len(used)
            used.append(0)
        bins.append(b)
        places.append(used[b])
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, places, [min((c for c in caps if c >= u), key=lambda c: (cost[c], c)) for u in used]


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, reach: float = REACH, shard_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece: ``id_col, piece, first, n_tokens, shard, bin, place, capacity``.

    A piece is tokens ``first`` to ``first + n_tokens`` of its document, at
    ``place`` of bin ``(shard, bin)``.

    * texts without a token (null, empty) give no piece
    * null ids are packed like others; rows that repeat an id are packed each, and
      dealt to shards like rows with ids of their own
    * equal lengths are placed by id (null last), then by piece; an empty table gives no bin
    * other columns, of any name, are ignored
    """
    biggest = max(capacities)
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    sized = docs.select(column(id_col).alias("_id"), (word_count(text_col) if length is None else length).cast("long").alias("_n")).where("_n > 0")
    # Counting tokens is a pass over the texts. Rows are numbered before they are written, so the numbers stay.
    sized = staged(sized.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    total = sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    shards = max(1, round(total / shard_tokens))
    pieces = (
        sized.select("_id", "_row", "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {biggest})")).alias("piece"))
        .select("_id", "_row", "piece", (F.col("piece") * biggest).alias("first"), F.least(F.lit(biggest), F.col("_n") - F.col("piece") * biggest).alias("n_tokens"))
        .withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)))
        # Shards are small and many; a task takes some of them, one after another.
        .repartition("shard")
        .sortWithinPartitions("shard", F.desc("n_tokens"), F.asc_nulls_last("_id"), "piece", "_row")
        .drop("_row")
    )

    def place(batches):
        held: list[pa.RecordBatch] = []

        def done(parts):
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            bins, places, caps = best_fit(t.column("n_tokens").to_pylist(), capacities, overhead, reach)
            cols = [t.column(c) for c in ("_id", "piece", "first", "n_tokens", "shard")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(bins, pa.int64()), pa.array(places, pa.int64()), pa.array(np.asarray(caps)[bins], pa.int64())], ["_id", "piece", "first", "n_tokens", "shard", "bin", "place", "capacity"])

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), b.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column("shard")[0].as_py() != shard[low]:
                    yield done(held)
                    held = []
                held.append(b.slice(low, high - low))
        if held:
            yield done(held)

    out = pieces.transform(map_arrow, place, f"_id {id_type}, piece long, first long, n_tokens long, shard long, bin long, place long, capacity long")
    return out.withColumnRenamed("_id", id_col)
