"""Searching a graph: matches as DataFrames, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from enum import Enum
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as err
from ..functions.pattern import Cluster
from ..model import ANY, FLIP
from ..plans.compiler import Ban, CompiledQuery, PatternEdge, compile_query
from ..plans.lowering import Lowering, edge_test, lower, name
from .graph import PAIR_FLAG, PAIR_VALUE, Graph


class BanVerdict(Enum):
    """Why a ban lets a match pass, or that it doesn't."""

    SHARED_EDGE_FAIL = 0
    NO_CANDIDATE = 1
    FIRED = 2


class Search:
    """A compiled pattern. Patterns with context nodes need ``bind`` or a table of bindings."""

    def __init__(self, graph: Graph, clusters: Sequence[Cluster]):
        self.graph = graph
        self.query = compile_query(graph.kind, clusters)

    def session(self) -> Session:
        if self.query.free:
            raise err.BoundPatternInSession(nodes=self.query.free)
        return Session(self.graph, self.query)

    def bind(self, table: Mapping[int, int] | Sequence[tuple[int, int]]) -> Session:
        """Bind every context node to a node of the graph."""
        entries = list(table.items()) if isinstance(table, Mapping) else list(table)
        free = self.query.free
        bound: dict[int, int] = {}
        for p, g in entries:
            if p not in free:
                raise err.BindNotFound(node=p)
            if p in bound:
                raise err.BindDuplicate(node=p)
            bound[p] = g
        if lost := [p for p in free if p not in bound]:
            raise err.BindMissing(node=lost[0])
        strict = [p for p in free if self.query.nodes[p].morphism.value != (False, False, False)]
        for k, p in enumerate(strict):
            if any(bound[p] == bound[q] for q in strict[:k]):
                raise err.BindCollision(node=p)
        query = self.query.copy()
        for p, g in bound.items():
            query.nodes[p].pinned = g
        return Session(self.graph, query)

    def bind_all(self, bindings: DataFrame) -> DataFrame:
        """Matches of many bindings at once: ``bindings`` has a column n<id> for each context node; its other columns are kept.

        The search starts from the bindings. Ids that the graph lacks, nulls, and
        rows that give one id to nodes that must differ have no matches.
        """
        free = [name(p) for p in self.query.free]
        if lost := [c for c in free if c not in bindings.columns]:
            raise err.BindMissing(node=lost[0])
        found = lower(self.graph, self.query, bindings.select(*[F.col(c).cast("long").alias(c) for c in free]).distinct())
        return found.join(bindings, free)


class Session:
    """A search that is ready to run. Pinned ids that the graph lacks are an error, found by one lookup of all of them."""

    def __init__(self, graph: Graph, query: CompiledQuery, check_targets: bool = True):
        self.graph, self.query = graph, query
        pinned = sorted({x.pinned for x in query.nodes.values() if x.pinned is not None}) if check_targets else []
        if pinned:
            there = {r[0] for r in graph.nodes.where(F.col("id").isin(pinned)).select("id").distinct().collect()}
            if lost := [i for i in pinned if i not in there]:
                raise err.TargetMissing(id=lost[0])

    @property
    def indexed(self) -> str:
        """The caching tier of the graph that is searched."""
        return self.graph.tier

    @property
    def columns(self) -> list[str]:
        return [name(p) for p in sorted(self.query.order)]

    def matches(self) -> DataFrame:
        """One row for each mapping; lazy."""
        return lower(self.graph, self.query)

    def ordered(self, limit: int | None = None) -> DataFrame:
        """In search order, candidates ascending; with a limit a top-k, not a full sort."""
        out = self.matches().orderBy(*[name(p) for p in self.query.order])
        return out if limit is None else out.limit(limit)

    def first(self, k: int) -> DataFrame:
        return self.matches().limit(k)

    def count(self) -> int:
        return self.matches().count()

    def exists(self) -> bool:
        return not self.matches().isEmpty()

    def __iter__(self):
        return self.matches().toLocalIterator()

    # Translation

    def with_values(self, found: DataFrame | None = None, nodes: Sequence[int] | None = None) -> DataFrame:
        """Matches with v<id>, the value of each mapped node."""
        out = self.matches() if found is None else found
        for p in sorted(self.query.order) if nodes is None else nodes:
            values = self.graph.nodes.select(F.col("id").alias("_id"), F.col("val").alias(f"v{p}"))
            out = out.join(values, F.col(name(p)) == F.col("_id")).drop("_id")
        return out

    def pattern_edges(self) -> list[tuple[int, int, str]]:
        """The pattern's positive get edges; the slot is seen from the first end."""
        return [(x.a, x.b, x.slot) for x in self.query.get_edges(False)]

    def instantiated_edges(self, found: DataFrame | None = None) -> DataFrame:
        """n<id>..., a, b, slot, src, dst: the pattern's positive get edges with the ids of each match; an any-direction edge stays ANY."""
        found = self.matches() if found is None else found
        items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(slot).alias("slot"), F.col(name(a)).alias("src"), F.col(name(b)).alias("dst")) for a, b, slot in self.pattern_edges()]
        return found.select(*found.columns, F.inline(F.array(*items))) if items else found.limit(0).select("*", F.expr("inline(cast(array() as array<struct<a:int,b:int,slot:string,src:bigint,dst:bigint>>))"))

    def matched_edges(self, found: DataFrame | None = None, unclaimed: bool = False) -> DataFrame:
        """n<id>..., src, dst, slot[, val]: edges that the pattern's edges map to.

        An any-direction edge gives every occupied slot that fits; with
        ``unclaimed``, only those that no specific edge takes.
        """
        found = self.matches() if found is None else found
        out = None
        for x in self.query.get_edges(False):
            without = self.query.claimed(x.a, x.b) if unclaimed and x.slot == ANY else set()
            slots = [s for s in self.graph.kind.slots if s not in without] if x.slot == ANY else [x.slot]
            items = []
            for s in slots:
                one = PatternEdge(x.a, x.b, s, False, x.value, x.tests)
                value = [F.col(PAIR_VALUE[s]).alias("val")] if self.graph.edge_value else []
                items.append(F.when(edge_test(self.graph, one, x.a), F.struct(F.lit(s).alias("slot"), *value)))
            view = self.graph.pair.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.explode(F.array_compact(F.array(*items))).alias("_e"))
            rows = found.join(view, (F.col(name(x.a)) == F.col("_s")) & (F.col(name(x.b)) == F.col("_d"))).select(*found.columns, F.col("_s").alias("src"), F.col("_d").alias("dst"), "_e.*")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else found.limit(0).withColumns({"src": F.lit(0).cast("long"), "dst": F.lit(0).cast("long"), "slot": F.lit("")})

    def adjacents(self, p: int, found: DataFrame | None = None) -> DataFrame:
        """n<id>..., node (of the pattern), id, slot (seen from p)[, val]: the match's nodes that p's edges lead to."""
        found = self.matches() if found is None else found
        items = [F.struct(F.lit(x.other(p)).alias("node"), F.col(name(x.other(p))).alias("id"), F.lit(x.slot if p == x.a else FLIP[x.slot]).alias("slot")) for x in self.query.get_edges(False) if p in (x.a, x.b)]
        rows = found.select(*found.columns, F.inline(F.array(*items)))
        if not self.graph.node_value:
            return rows
        values = self.graph.nodes.select(F.col("id").alias("_id"), "val")
        return rows.join(values, rows["id"] == values["_id"]).drop("_id")

    # Tracing

    def trace(self) -> list[tuple[str, DataFrame]]:
        """(step, partial matches): what binding each node, then each ban, leaves."""
        steps = []
        work = Lowering(self.graph, self.query)
        for p in self.query.order:
            work.bind(p)
            steps.append((f"bind {name(p)}", work.out))
        work.global_rules()
        for k, b in enumerate(self.query.bans):
            verdicts = self._verdicts(work, b)
            steps.append((f"ban {k} fired", verdicts.where(F.col("verdict") == BanVerdict.FIRED.name).drop("verdict")))
            steps.append((f"ban {k} passed", work.out))
        steps.append(("match", work.out))
        return steps

    @staticmethod
    def _verdicts(work: Lowering, b: Ban) -> DataFrame:
        """Applies the ban: the matches before it, with a ``verdict`` on each."""
        before = work.out
        marked, tests = work.shared(b)
        inside = marked.select(*before.columns, reduce(and_, tests, F.lit(True)).alias("_in"))
        work.ban(b)
        passed = work.out.withColumn("_ok", F.lit(True))
        joined = inside.join(passed, before.columns, "left") if before.columns else inside.crossJoin(work.out.agg((F.count("*") > 0).alias("_ok")))
        verdict = F.when(~F.coalesce("_ok", F.lit(False)), BanVerdict.FIRED.name).when(F.col("_in"), BanVerdict.NO_CANDIDATE.name).otherwise(BanVerdict.SHARED_EDGE_FAIL.name)
        return joined.select(*before.columns, verdict.alias("verdict"))

    def ban_verdicts(self) -> DataFrame:
        """n<id>..., ban, verdict: what each ban says of every match that reaches it."""
        work = Lowering(self.graph, self.query)
        for p in self.query.order:
            work.bind(p)
        work.global_rules()
        out = None
        for k, b in enumerate(self.query.bans):
            rows = self._verdicts(work, b).withColumn("ban", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else work.out.limit(0).withColumns({"ban": F.lit(0), "verdict": F.lit("")})

    def edge_tests(self) -> DataFrame:
        """a, b, slot, negated, src, dst, passed: every adjacent pair against every get edge of the pattern."""
        out = None
        for negated in (False, True):
            for x in self.query.get_edges(negated):
                passed = edge_test(self.graph, x, x.a)
                rows = self.graph.pair.select(F.lit(x.a).alias("a"), F.lit(x.b).alias("b"), F.lit(x.slot).alias("slot"), F.lit(negated).alias("negated"), "src", "dst", (~passed if negated else passed).alias("passed"))
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.graph.spark.sql("SELECT 0 AS a, 0 AS b, '' AS slot, false AS negated, 0L AS src, 0L AS dst, false AS passed WHERE false")

    def explain_match(self, mapping: Mapping[int, int]) -> dict[str, bool]:
        """For one mapping, which steps it survives."""
        same: Column = F.lit(True)
        out = {}
        for step, frame in self.trace():
            here = same
            for p, g in mapping.items():
                if name(p) in frame.columns:
                    here = here & (F.col(name(p)) == g)
            out[step] = not frame.where(here).isEmpty()
        return out


def search(graph: Graph, *clusters: Cluster) -> Session:
    """Compile and make ready; patterns with context nodes are refused here, see ``Search.bind``."""
    return Search(graph, clusters).session()
