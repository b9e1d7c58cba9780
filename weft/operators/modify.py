"""Changing a graph: validated, atomic batches that give a new snapshot.

A modification is a list of nodes in the operator language (``N`` new, ``X``
existing, ``~X`` removed, ``E`` new edge, ``e`` existing edge with a new value,
``~e`` removed edge). It becomes a ``Delta`` of small tables, which is checked
against the graph and applied by unions, anti-joins and keyed updates. A rewrite
rule makes the same tables from a table of matches, one copy of the template for
each match.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as err
from ..functions.pattern import MISSING, Node, walk
from ..model import FLIP, SRC, TGT
from ..sources.store import materialized
from .graph import Graph

EDGE_KEY = ["n1", "n2", "slot"]
KEY_TYPE = "n1 long, n2 long, slot string"


@dataclass
class Delta:
    """Tables of one batch. Ids are final."""

    add_nodes: DataFrame  # id[, val]
    swap_nodes: DataFrame  # id, val
    remove_edges: DataFrame  # n1, n2, slot
    swap_edges: DataFrame  # n1, n2, slot, val
    add_edges: DataFrame  # n1, n2, slot[, val]
    remove_nodes: DataFrame  # id


@dataclass
class Modification:
    """What a batch did."""

    new_node_ids: DataFrame  # local, id
    added_edges: DataFrame
    removed_nodes: DataFrame  # with their last value
    removed_edges: DataFrame  # cascaded ones too, with their last value
    swapped_node_vals: DataFrame  # id, old
    swapped_edge_vals: DataFrame  # n1, n2, slot, old

    def changes(self) -> DataFrame:
        """The change feed: seq, kind, id, n1, n2, slot, in the order in which watchers hear of them."""
        parts = [
            (self.new_node_ids.select("id"), "node_added"),
            (self.swapped_node_vals.select("id"), "node_changed"),
            (self.added_edges.select(*EDGE_KEY), "edge_added"),
            (self.removed_edges.select(*EDGE_KEY), "edge_removed"),
            (self.swapped_edge_vals.select(*EDGE_KEY), "edge_changed"),
            (self.removed_nodes.select("id"), "node_removed"),
        ]
        out = None
        for k, (frame, kind) in enumerate(parts):
            has = frame.columns
            rows = frame.select(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), *[(F.col(c) if c in has else F.lit(None)).cast("string" if c == "slot" else "long").alias(c) for c in ("id", "n1", "n2", "slot")])
            out = rows if out is None else out.unionByName(rows)
        return out


def check_fragment(ops: Sequence[Node]) -> None:
    """Raise if the fragment contradicts itself."""
    new: set[int] = set()
    exist: set[int] = set()
    translated: set[int] = set()
    removed: set[tuple[str, int]] = set()
    used: list[tuple[str, int]] = []
    for near, link, far in walk(ops):
        x = near if link is None else far
        if x.role == "N" and x.id is not None:
            if x.id in new:
                raise err.DuplicateNew(id=x.id)
            new.add(x.id)
        elif x.role == "X":
            if x.id in exist:
                raise err.DuplicateExist(id=x.id)
            exist.add(x.id)
        elif x.role == "T":
            if x.id in translated:
                raise err.DuplicateTranslated(id=x.id)
            translated.add(x.id)
        kind = {"X": "X", "x": "X", "T": "T", "t": "T"}.get(x.role)
        if kind and x.negated:
            removed.add((kind, x.id))
        if kind and (x.value is not MISSING or link is not None or (x.links and x is near)):
            used.append((kind, x.id))
    for near, link, far in walk(ops):
        x = near if link is None else far
        if x.role == "n" and x.id not in new:
            raise err.UndefinedNewRef(id=x.id)
        if x.role == "t" and x.id not in translated:
            raise err.UndefinedTranslatedRef(id=x.id)
    for kind, i in used:
        if (kind, i) in removed:
            raise (err.RemoveConflict if kind == "X" else err.TranslatedRemoveConflict)(id=i)


def free_ids(graph: Graph, k: int) -> DataFrame:
    """``rank`` (from 0), ``id``: the k smallest ids that no node has. They are all below node count + k."""
    ids = graph.spark.range(graph.node_count() + k)
    # Gaps are ranked where they lie, so no task holds all k of them.
    return ranked(ids.join(graph.nodes.select("id"), "id", "left_anti"), ["id"]).where(F.col("rank") < k)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0 in the given order, without bringing all rows into one partition."""
    rows = materialized(df.sort(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    firsts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")).orderBy("_p").collect()  # one row a partition
    starts, at = [], 0
    for r in firsts:
        starts.append((r["_p"], r["_first"], at))
        at += r["_n"]
    table = df.sparkSession.createDataFrame(starts, "_p int, _first long, _at long")
    return rows.join(F.broadcast(table), "_p").withColumn("rank", F.col("_m") - F.col("_first") + F.col("_at")).drop("_p", "_m", "_first", "_at")


def _oriented(a: Column, b: Column, slot: str) -> list[Column]:
    """n1, n2, slot of an edge whose slot is seen from a."""
    seen = F.lit(slot) if slot not in (SRC, TGT) else F.when(a < b, slot).when(a == b, SRC).otherwise(FLIP[slot])
    return [F.least(a, b).alias("n1"), F.greatest(a, b).alias("n2"), seen.alias("slot")]


class _Template:
    """Rows of every table of a delta, as columns over a table of matches (or one row)."""

    def __init__(self, graph: Graph, ops: Sequence[Node], base: DataFrame, ids: dict[int, Column], default=None):
        self.graph, self.base = graph, base
        self.nodes: list[tuple[int | None, Node]] = []
        self.ids = dict(ids)
        self.default = default
        self.rows = {f.name: [] for f in fields(Delta)}
        self.checked: list[Column] = []
        self._anonymous: dict[int, Column] = {}
        self._collect(ops)

    def node(self, x: Node) -> Column:
        if x.role in "Nn":
            return self._anonymous[id(x)] if x.id is None else self._anonymous[("N", x.id)]
        if x.role in "Xx":
            return F.lit(x.id).cast("long")
        return self.ids[x.id]

    def value(self, x, node: bool) -> list:
        type_ = (self.graph.nodes if node else self.graph.edges).schema
        if "val" not in type_.names:
            return []
        if x.value is MISSING and self.default is None:
            raise TypeError("a value is needed: the graph's values have no default")
        given = self.default if x.value is MISSING else x.value
        return [(given if isinstance(given, Column) else F.lit(given)).cast(type_["val"].dataType).alias("val")]

    def _collect(self, ops: Sequence[Node]) -> None:
        new = [x for near, link, far in walk(ops) for x in [near if link is None else far] if x.role == "N"]
        for k, x in enumerate(new):
            column = F.col(f"_new{k}")
            if x.id is None:
                self._anonymous[id(x)] = column
            else:
                self._anonymous[("N", x.id)] = column
            self.nodes.append((x.id, x))
        for near, link, far in walk(ops):
            x = near if link is None else far
            if x.role == "N":
                self.rows["add_nodes"].append([self.node(x).alias("id"), *self.value(x, True)])
            elif x.role in "XTxt":
                if x.negated:
                    self.rows["remove_nodes"].append([self.node(x).alias("id")])
                elif x.value is not MISSING:
                    self.rows["swap_nodes"].append([self.node(x).alias("id"), *self.value(x, True)])
                self.checked.append(self.node(x).alias("id"))
            if link is None:
                continue
            self.graph.kind.check(link.slot)
            key = _oriented(self.node(near), self.node(far), link.slot)
            if link.edge.negated:
                self.rows["remove_edges"].append(key)
            elif not link.edge.existing:
                self.rows["add_edges"].append([*key, *self.value(link.edge, False)])
            elif link.edge.value is not MISSING:
                self.rows["swap_edges"].append([*key, *self.value(link.edge, False)])

    def frames(self, base: DataFrame) -> Delta:
        g = self.graph
        node_val = [g.nodes.schema["val"]] if g.node_value else []
        edge_val = [g.edges.schema["val"]] if g.edge_value else []
        key = [T.StructField("n1", T.LongType()), T.StructField("n2", T.LongType()), T.StructField("slot", T.StringType())]
        one = [T.StructField("id", T.LongType())]
        types = {"add_nodes": one + node_val, "swap_nodes": one + node_val, "remove_nodes": one, "remove_edges": key, "swap_edges": key + edge_val, "add_edges": key + edge_val}
        out = {}
        for table, rows in self.rows.items():
            frame = None
            for row in rows:
                part = base.select(*row)
                frame = part if frame is None else frame.unionByName(part)
            out[table] = frame if frame is not None else g.spark.createDataFrame([], T.StructType(types[table]))
        return Delta(**out)

    def existing(self, base: DataFrame) -> DataFrame:
        frame = self.graph.spark.createDataFrame([], "id long")
        for c in self.checked:
            frame = frame.unionByName(base.select(c))
        return frame.distinct()


def check_delta(graph: Graph, delta: Delta, existing: DataFrame) -> None:
    """Raise before anything is changed."""
    ids = graph.nodes.select("id")
    if r := existing.join(ids, "id", "left_anti").first():
        raise err.NodeNotFound(id=r[0])
    keys = graph.edges.select(*EDGE_KEY)
    touched = delta.remove_edges.select(*EDGE_KEY).unionByName(delta.swap_edges.select(*EDGE_KEY))
    gone = delta.remove_nodes.select("id")
    for end in ("n1", "n2"):
        if r := touched.join(gone, touched[end] == gone["id"], "left_semi").first():
            raise err.CascadeConflict(n1=r["n1"], n2=r["n2"])
    if r := touched.join(keys, EDGE_KEY, "left_anti").first():
        raise err.EdgeNotFound(n1=r["n1"], n2=r["n2"], slot=r["slot"])
    if r := delta.swap_edges.select(*EDGE_KEY).join(delta.remove_edges, EDGE_KEY, "left_semi").first():
        raise err.SwapConflict(n1=r["n1"], n2=r["n2"], slot=r["slot"])
    if r := delta.swap_edges.groupBy(*EDGE_KEY).count().where("count > 1").first():
        raise err.SwapConflict(n1=r["n1"], n2=r["n2"], slot=r["slot"])
    added = delta.add_edges.select(*EDGE_KEY)
    if r := added.groupBy(*EDGE_KEY).count().where("count > 1").first():
        raise err.EdgeExists(n1=r["n1"], n2=r["n2"], slot=r["slot"])
    left = keys.join(delta.remove_edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    if r := added.join(left, EDGE_KEY, "left_semi").first():
        raise err.EdgeExists(n1=r["n1"], n2=r["n2"], slot=r["slot"])


def apply_delta(graph: Graph, delta: Delta, names: DataFrame) -> tuple[Graph, Modification]:
    """Nodes in, node values, edges out, edge values, edges in, nodes out (with their edges): a new snapshot."""
    nodes = graph.nodes.unionByName(delta.add_nodes)
    swapped_nodes = graph.spark.createDataFrame([], "id long")
    if graph.node_value:
        new = delta.swap_nodes.select("id", F.col("val").alias("_new"), F.lit(True).alias("_swap")).dropDuplicates(["id"])
        joined = nodes.join(new, "id", "left")
        swapped_nodes = joined.where("_swap").select("id", F.col("val").alias("old"))
        nodes = joined.select("id", F.when(F.col("_swap"), F.col("_new")).otherwise(F.col("val")).alias("val"))
    removed_edges = graph.edges.join(delta.remove_edges, EDGE_KEY, "left_semi")
    edges = graph.edges.join(delta.remove_edges, EDGE_KEY, "left_anti")
    swapped_edges = graph.spark.createDataFrame([], KEY_TYPE)
    if graph.edge_value:
        new = delta.swap_edges.select(*EDGE_KEY, F.col("val").alias("_new"), F.lit(True).alias("_swap"))
        joined = edges.join(new, EDGE_KEY, "left")
        swapped_edges = joined.where("_swap").select(*EDGE_KEY, F.col("val").alias("old"))
        edges = joined.select(*EDGE_KEY, F.when(F.col("_swap"), F.col("_new")).otherwise(F.col("val")).alias("val"))
    edges = edges.unionByName(delta.add_edges)
    gone = delta.remove_nodes.select("id").distinct()
    one, two = gone.withColumnRenamed("id", "_g1"), gone.withColumnRenamed("id", "_g2")
    cut = edges.join(one, F.col("n1") == F.col("_g1"), "left").join(two, F.col("n2") == F.col("_g2"), "left")
    cascaded = cut.where("_g1 IS NOT NULL OR _g2 IS NOT NULL").drop("_g1", "_g2")
    edges = cut.where("_g1 IS NULL AND _g2 IS NULL").drop("_g1", "_g2")
    done = Modification(names, delta.add_edges, nodes.join(gone, "id", "left_semi"), removed_edges.unionByName(cascaded), swapped_nodes, swapped_edges)
    return Graph(graph.kind, nodes.join(gone, "id", "left_anti"), edges), done


def modify(graph: Graph, *ops: Node, default=None) -> tuple[Graph, Modification]:
    """Apply one batch: (new graph, what it did). The old graph stays as it is, also if this raises."""
    check_fragment(ops)
    for near, link, far in walk(ops):
        x = near if link is None else far
        if x.role in "Tt":
            raise TypeError("nodes of a match need a rewrite, see rewrite()")
    plan = _Template(graph, ops, graph.nodes, {}, default)
    ids = [r["id"] for r in free_ids(graph, len(plan.nodes)).orderBy("rank").collect()] if plan.nodes else []
    base = graph.spark.range(1).select(*[F.lit(i).cast("long").alias(f"_new{k}") for k, i in enumerate(ids)])
    delta = plan.frames(base)
    check_delta(graph, delta, plan.existing(base))
    names = graph.spark.createDataFrame([(local, i) for (local, _), i in zip(plan.nodes, ids, strict=True)], "local long, id long")
    return apply_delta(graph, delta, names)


def resolve_with_bindings(ops: Sequence[Node], bindings: dict[int, int]) -> list[Node]:
    """The fragment with the nodes of one match put in as existing nodes."""

    def put(x: Node) -> Node:
        from copy import copy

        out = copy(x)
        out.links = [type(k)(k.edge, k.slot, put(k.node)) for k in x.links]
        if x.role in "Tt":
            out.role, out.id = {"T": "X", "t": "x"}[x.role], bindings[x.id]
        return out

    return [put(x) for x in ops]


def disjoint(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Matches that share no node, chosen so that every other match touches one of them.

    Each round keeps the matches that come first, by a hash and then by their ids,
    at all of their nodes and drops those that touch them; all steps are joins. The
    first of all that are left is always kept, so rounds end when none is left.
    """
    spare = materialized(found.distinct().withColumn("_h", F.xxhash64(*columns)))
    kept = spare.limit(0)
    rank = F.struct("_h", *columns)
    while not spare.isEmpty():
        ends = spare.select("_h", *columns, F.explode(F.array_distinct(F.array(*columns))).alias("_n"))
        first = ends.groupBy("_n").agg(F.min(rank).alias("_least"))
        lead = ends.join(first, "_n").groupBy("_h", *columns).agg(F.min(rank == F.col("_least")).alias("ok")).where("ok")
        chosen = materialized(spare.join(lead.select("_h", *columns), ["_h", *columns], "left_semi"))
        kept = kept.unionByName(chosen)
        taken = chosen.select(F.explode(F.array(*columns)).alias("_t")).distinct()
        touched = ends.join(taken, ends["_n"] == taken["_t"], "left_semi").select("_h", *columns).distinct()
        spare = materialized(spare.join(touched, ["_h", *columns], "left_anti"))
    return kept.drop("_h")


def rewrite(graph: Graph, found: DataFrame, *ops: Node, mode: str = "disjoint", default=None) -> tuple[Graph, Modification]:
    """Apply a template with ``T`` nodes at matches: ``first``, ``disjoint`` ones, or ``all`` (which may conflict and then raises)."""
    check_fragment(ops)
    columns = [c for c in found.columns if c[0] == "n" and c[1:].isdigit()]
    if mode == "first":
        found = found.orderBy(*columns).limit(1)
    elif mode == "disjoint":
        found = disjoint(found, columns)
    found = ranked(found, columns)
    plan = _Template(graph, ops, found, {int(c[1:]): F.col(c) for c in columns}, default)
    base = found
    k = len(plan.nodes)
    names = graph.spark.createDataFrame([], "local long, id long")
    if k:
        fresh = free_ids(graph, k * found.count())
        for i in range(k):
            ids = fresh.where(F.col("rank") % k == i).select(F.expr(f"rank div {k}").alias("rank"), F.col("id").alias(f"_new{i}"))
            base = base.join(ids, "rank")
        for i, (local, _) in enumerate(plan.nodes):
            names = names.unionByName(base.select(F.lit(local).cast("long").alias("local"), F.col(f"_new{i}").alias("id")))
    base = materialized(base)
    delta = plan.frames(base)
    check_delta(graph, delta, plan.existing(base))
    return apply_delta(graph, delta, names)
