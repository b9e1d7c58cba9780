"""Graphs that change by a stream of operations.

A stream of rows ``op, id, n1, n2, slot[, val]`` drives a sequence of snapshots:
each micro-batch becomes one ``Delta``, is checked and applied, and the new
snapshot is written under its batch's number. A batch that is run again after a
failure finds its snapshot and does nothing. Standing queries and watchers see
every snapshot with its change feed.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..operators.modify import EDGE_KEY, Delta, Modification, apply_delta, check_delta
from ..operators.session import BanVerdict, Session
from ..sources.persist import exists, load, save
from ..sources.store import folder_exists, names_in

OPS = ("add_node", "swap_node", "remove_edge", "swap_edge", "add_edge", "remove_node")


class Control(Enum):
    CONTINUE = 0
    PAUSE = 1
    STOP = 2


class Watcher:
    """Hears of changes and of searches; ``Control.STOP`` from ``on_bind`` or ``on_match`` ends a search. All of it does nothing unless overridden."""

    def on_change(self, kind: str, id: int | None, edge: tuple | None) -> None: ...

    def on_bind(self, node: int, row) -> Control:
        return Control.CONTINUE

    def on_unbind(self, node: int, row) -> None: ...

    def on_edge_test(self, row) -> None: ...

    def on_ban_verdict(self, ban: int, verdict: BanVerdict, row) -> None: ...

    def on_match(self, row) -> Control:
        return Control.CONTINUE


def notify(watcher: Watcher, done: Modification) -> None:
    """Tell a watcher of a modification: nodes added, nodes changed, edges added, removed, changed, nodes removed."""
    for r in done.changes().orderBy("seq", "id", *EDGE_KEY).toLocalIterator():
        watcher.on_change(r["kind"], r["id"], None if r["n1"] is None else (r["n1"], r["n2"], r["slot"]))


def watch_matches(watcher: Watcher, found: DataFrame) -> int:
    """Tell a watcher of matches until it stops; how many it heard of."""
    n = 0
    for row in found.toLocalIterator():
        n += 1
        if watcher.on_match(row) is Control.STOP:
            break
    return n


def watch_search(watcher: Watcher, session: Session) -> int:
    """Tell a watcher of a whole search, step by step; how many matches it heard of.

    Edge tests come first, then for each node the partial matches that it extends
    and those that end there, then what the bans say, then the matches. Rows are
    streamed to the driver one partition at a time, so this is for looking at
    searches, not for running them.
    """
    for row in session.edge_tests().toLocalIterator():
        watcher.on_edge_test(row)
    before = None
    for (step, frame), p in zip(session.trace(), session.query.order, strict=False):
        assert step == f"bind n{p}"
        if before is not None:
            for row in before.join(frame, before.columns, "left_anti").toLocalIterator():
                watcher.on_unbind(p, row)
        for row in frame.toLocalIterator():
            if watcher.on_bind(p, row) is Control.STOP:
                return 0
        before = frame
    for row in session.ban_verdicts().toLocalIterator():
        watcher.on_ban_verdict(row["ban"], BanVerdict[row["verdict"]], row)
    return watch_matches(watcher, session.matches())


def batch_delta(graph: Graph, rows: DataFrame) -> tuple[Delta, DataFrame, DataFrame]:
    """(delta, ids that must exist, names of new nodes) of a batch of operations. Ids of new nodes are given by the stream."""

    def of(op: str, keys: list[str], valued: bool) -> DataFrame:
        return rows.where(F.col("op") == op).select(*keys, *(["val"] if valued else []))

    node_val, edge_val = graph.node_value, graph.edge_value
    nodes = of("add_node", ["id"], False)
    if node_val:
        nodes = rows.where("op = 'add_node'").select("id", F.col("val").cast(graph.nodes.schema["val"].dataType).alias("val"))

    def edge(op: str, valued: bool) -> DataFrame:
        value = [F.col("val").cast(graph.edges.schema["val"].dataType).alias("val")] if valued else []
        return rows.where(F.col("op") == op).select(*EDGE_KEY, *value)

    swap = rows.where("op = 'swap_node'").select("id", *([F.col("val").cast(graph.nodes.schema["val"].dataType).alias("val")] if node_val else []))
    delta = Delta(nodes, swap, edge("remove_edge", False), edge("swap_edge", edge_val), edge("add_edge", edge_val), of("remove_node", ["id"], False))
    needed = delta.swap_nodes.select("id").unionByName(delta.remove_nodes).distinct()
    return delta, needed, nodes.select(F.col("id").alias("local"), "id")


class MutationStream:
    """Snapshots under ``path``: ``0`` is the start, batch k gives ``k + 1``. A path that holds snapshots is resumed at its last one."""

    def __init__(self, start: Graph, path: str):
        self.spark, self.path, self.kind = start.spark, path, start.kind
        if not exists(self.spark, f"{path}/0"):
            save(start, f"{path}/0")
        known = [int(v) for v in names_in(self.spark, path) if v.isdigit() and exists(self.spark, f"{path}/{v}")]
        self.latest = max(known)

    def snapshot(self, version: int | None = None) -> Graph:
        return load(self.spark, f"{self.path}/{self.latest if version is None else version}", self.kind)

    def apply(self, rows: DataFrame, batch: int, on_batch: Callable[[int, Graph, Modification], None] | None = None) -> None:
        """Apply a batch once, and call ``on_batch`` until it has returned once: again if a run died in it."""
        here = f"{self.path}/{batch + 1}"
        new = not exists(self.spark, here)
        if new or (on_batch is not None and not folder_exists(self.spark, f"{here}/told")):
            before = load(self.spark, f"{self.path}/{batch}", self.kind)
            rows = rows.persist()
            delta, needed, names = batch_delta(before, rows)
            if new:
                check_delta(before, delta, needed)
            after, done = apply_delta(before, delta, names)
            if new:
                save(after, here)
            self.latest = max(self.latest, batch + 1)
            if on_batch is not None:
                on_batch(batch, self.snapshot(batch + 1), done)
                self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{here}/told")
            rows.unpersist()
        self.latest = max(self.latest, batch + 1)

    def start(self, stream: DataFrame, checkpoint: str, on_batch: Callable[[int, Graph, Modification], None] | None = None, **trigger) -> StreamingQuery:
        """Drive the snapshots by a streaming table of operations."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, k: self.apply(rows, k, on_batch))
        return (writer.trigger(**trigger) if trigger else writer).start()
