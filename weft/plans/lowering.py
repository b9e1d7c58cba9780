"""From a compiled query to joins.

Every match is a row ``n<id>, ...``. Nodes are bound one by one: a join with the
pair view along one edge, semi-joins for further edges, anti-joins for negated
edges and for pairs that must not be adjacent, then one anti-join for each ban.
Where morphisms are mixed, the node that comes later in the query's order rules a
pair, in whatever order they are joined. Only ids are carried. Which joins are broadcast or sorted, and how
skew is split, is left to the planner.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import MISSING, test_column
from ..model import ANY, Kind, Morphism
from ..operators.graph import PAIR_FLAG, PAIR_VALUE, Graph
from ..sources.store import materialized
from .compiler import Ban, CompiledQuery, PatternEdge, PatternNode

#: Rows of a ban's hits that are broadcast at most, some 100 MB.
BROADCAST_ROWS = 1_000_000


def name(p: int) -> str:
    return f"n{p}"


def _predicate(x: PatternNode | PatternEdge, value: Column, column: str) -> Column:
    parts = [F.coalesce(value == x.value, F.lit(False))] if x.value is not MISSING else []
    return reduce(and_, [*parts, *(test_column(f, value, column) for f in x.tests)])


def _slot_test(x: PatternEdge, slot: str) -> Column:
    """Whether one slot of a pair row holds a fitting edge."""
    has = F.coalesce(F.col(PAIR_FLAG[slot]), F.lit(False))
    return has & _predicate(x, F.col(PAIR_VALUE[slot]), PAIR_VALUE[slot]) if x.has_predicate else has


def edge_test(graph: Graph, x: PatternEdge, start: int, without: frozenset[str] = frozenset(), plain: bool = False) -> Column:
    """Whether a pair row oriented from ``start`` satisfies the edge, its sign left aside."""
    if x.slot != ANY:
        return _slot_test(x, x.from_(start))
    slots = [s for s in graph.kind.slots if s not in without]
    if not slots:
        return F.lit(False)
    if not x.has_predicate and (plain or not without):
        return F.col("n_slots") > 0
    return reduce(or_, [_slot_test(x, s) for s in slots])


class Lowering:
    """Grows a frame of partial matches. ``start`` has a column n<id> for context nodes that a table binds."""

    def __init__(self, graph: Graph, query: CompiledQuery, start: DataFrame | None = None):
        self.graph, self.query = graph, query
        self.bound: list[int] = []
        self.given = [p for p in query.order if start is not None and name(p) in start.columns]
        self._frame = start
        self._start = start is not None
        self._first: int | None = None
        self._bans = 0
        self.ring: list[int] = []
        self._next: int | None = None

    @property
    def out(self) -> DataFrame:
        """The matches so far. A first node without a condition of its own is read from the edges that leave it, so this asks for its candidates only where it is read alone."""
        if self._frame is None:
            self._frame = self.graph.spark.range(1).select() if self._first is None else self.candidates(self._first)
        return self._frame

    @out.setter
    def out(self, frame: DataFrame) -> None:
        self._frame = frame

    # Building blocks

    def candidates(self, p: int) -> DataFrame:
        """Ids that fit the node's own conditions, as column n<p>."""
        x = self.query.nodes[p]
        rows = self.graph.nodes
        if x.pinned is not None:
            rows = rows.where(F.col("id") == x.pinned)
        if x.has_predicate:
            if not self.graph.node_value:
                raise TypeError("nodes have no value to test")
            rows = rows.where(_predicate(x, F.col("val"), "val"))
        return rows.select(F.col("id").alias(name(p)))

    def _restricted(self, p: int) -> bool:
        x = self.query.nodes[p]
        return x.has_predicate or x.pinned is not None

    def pairs(self, src: int, dst: int, test: Column, *extra: str) -> DataFrame:
        """Pair rows that pass a test, as columns _s, _d."""
        return self.graph.pair.where(test).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), *extra)

    @staticmethod
    def on(src: str, dst: str) -> Column:
        return (F.col(src) == F.col("_s")) & (F.col(dst) == F.col("_d"))

    def between(self, p: int, q: int, negated: bool) -> list[PatternEdge]:
        return [x for x in self.query.get_edges(negated) if {x.a, x.b} == {p, q}]

    # Get clusters

    @property
    def whole(self) -> bool:
        """Whether the search is over the whole graph, so that its triangles and rings are worth finding first."""
        return not self._start and all(x.pinned is None for x in self.query.nodes.values())

    def apart(self, *nodes: int) -> bool:
        """Whether the images of all these nodes must differ."""
        return all(self.query.later(p, q).morphism.injective for p, q in combinations(nodes, 2))

    def find_ring(self) -> list[int]:
        """Four nodes that edges join to a ring, or none."""
        links = {p: [q for q in self.query.order if q != p and self.between(p, q, False)] for p in self.query.order}
        for a in self.query.order:
            for b, d in combinations(links[a], 2):
                for c in links[b]:
                    if c != a and c in links[d] and self.apart(a, b, c, d):
                        return [a, b, c, d]
        return []

    def run(self) -> DataFrame:
        if self.whole and (ring := self.find_ring()):
            self.ring = ring
            self.out = self.graph.squares.select(*[F.col(c).alias(name(p)) for c, p in zip("wxyz", ring, strict=True)])
        order = self.plan()
        for k, p in enumerate(order):
            self._next = order[k + 1] if k + 1 < len(order) else None
            self.bind(p)
        self.global_rules()
        for b in self.query.bans:
            self.ban(b)
        return self.out.select(*[name(p) for p in sorted(self.query.order)])

    def plan(self) -> list[int]:
        """Which node to join next: given and pinned ones, then by links into what is bound and by conditions. Matches don't depend on it."""
        rest = list(self.query.order)
        links = {p: {q for q in rest if q != p and self.between(p, q, False)} for p in rest}
        done = [p for p in rest if p in self.given or p in self.ring]
        rest = [p for p in rest if p not in done]

        def worth(p: int) -> tuple:
            node = self.query.nodes[p]
            return (len(links[p] & set(done)) > 0, node.pinned is not None, len(links[p] & set(done)), node.has_predicate, -self.query.order.index(p))

        while rest:
            done.append(max(rest, key=worth))
            rest.remove(done[-1])
        return done

    def _degree(self, p: int) -> Column | None:
        """What the degree of the node's image must be. It follows from edges and injectivity unless some nodes may share an image; Iso's equality never does."""
        node, need = self.query.nodes[p], self.query.degree(p)
        if node.pinned is not None and p != self.query.order[0]:
            return None
        if node.morphism is Morphism.ISO:
            return F.col("deg") == need
        shared = any(not self.query.nodes[q].morphism.injective for q in self.query.order)
        return F.col("deg") >= need if shared and node.morphism.injective and need else None

    def bind(self, p: int) -> None:
        col = name(p)
        linked = [q for q in self.bound if self.between(p, q, False)]
        fit = self._degree(p)
        loops = [(x, False) for x in self.between(p, p, False)] + [(x, True) for x in self.between(p, p, True)]
        apart = reduce(and_, [F.col(col) != F.col(name(q)) for q in self.bound if self.query.later(p, q).morphism.injective], F.lit(True))

        def together(q: int) -> Column:
            edges = self.between(p, q, False)
            test = reduce(and_, [edge_test(self.graph, x, q) for x in edges])
            return test & (F.col("n_slots") == len(edges)) if self.query.later(p, q).morphism.induced else test

        def adjacent(q: int) -> bool:
            """Whether being adjacent is all that is asked of the pair."""
            return self.graph.kind is Kind.UNDIR and not any(x.has_predicate for x in self.between(p, q, False))

        if p in self.given:
            # A table's ids are checked like candidates: they must be nodes.
            self.out = self.out.join(self.candidates(p), col, "left_semi").where(apart)
            for q in linked:
                self.out = self.out.join(self.pairs(q, p, together(q)), self.on(name(q), col), "left_semi")
        elif p in self.ring:
            if self._restricted(p):
                self.out = self.out.join(self.candidates(p), col, "left_semi")
            for q in linked:
                if not adjacent(q) or abs(self.ring.index(p) - self.ring.index(q)) == 2:
                    self.out = self.out.join(self.pairs(q, p, together(q)), self.on(name(q), col), "left_semi")
        elif not self.bound and not self.given and not (self._restricted(p) or loops or fit is not None):
            self._first = p
        elif not self.bound and not self.given:
            self.out = self.candidates(p)
        elif linked:
            first, *others = linked
            step = self.pairs(first, p, together(first)).withColumnRenamed("_d", col)
            if self._frame is None and self._next is not None and self.between(self._next, p, False) and not self.between(self._next, first, False):
                # Read from the end that is joined next, as that join's other side is, so that both share an exchange.
                edges = self.between(p, first, False)
                test = reduce(and_, [edge_test(self.graph, x, p) for x in edges])
                test = test & (F.col("n_slots") == len(edges)) if self.query.later(p, first).morphism.induced else test
                self.out = self.pairs(p, first, test).withColumnsRenamed({"_s": col, "_d": name(first)}).where(apart)
            elif self._frame is None:
                self.out = step.withColumnRenamed("_s", name(first)).where(apart)
            else:
                self.out = self.out.join(step, F.col(name(first)) == F.col("_s")).where(apart).drop("_s")
            for q in others:
                self.out = self.out.join(self.pairs(q, p, together(q)), self.on(name(q), col), "left_semi")
            if self._restricted(p):
                self.out = self.out.join(self.candidates(p), col, "left_semi")
        else:
            # No edge leads into what is bound: a product, as the pattern asks for it.
            self.out = self.out.crossJoin(self.candidates(p)).where(apart)
        for x, negated in loops:
            self.out = self.out.join(self.pairs(p, p, edge_test(self.graph, x, p)), self.on(col, col), "left_anti" if negated else "left_semi")
        for q in self.bound:
            for x in self.between(p, q, True):
                self.out = self.out.join(self.pairs(q, p, edge_test(self.graph, x, q)), self.on(name(q), col), "left_anti")
            if self.query.later(p, q).morphism.induced and q not in linked and not self._open(q, p, [r for r in linked if self.between(q, r, False)]):
                self.out = self.out.join(self.pairs(q, p, F.lit(True)), self.on(name(q), col), "left_anti")
        if fit is not None:
            self.out = self.out.join(self.graph.degrees.where(fit).select(F.col("id").alias(col)), col, "left_semi")
        self.bound.append(p)

    def _open(self, q: int, p: int, linked: list[int]) -> bool:
        """Drop matches in which q and p are adjacent, by the graph's triangles over a node next to both. False if that doesn't apply or isn't less than joining all pairs."""
        if not linked or not self.whole or not self.apart(q, linked[0], p):
            return False
        n = self.graph.triangles.count()
        if n > self.graph.edge_count():
            return False
        if n:
            on = reduce(and_, [F.col(name(r)) == F.col(c) for r, c in zip((q, linked[0], p), "xyz", strict=True)])
            self.out = self.out.join(self.graph.triangles, on, "left_anti")
        return True

    def global_rules(self) -> None:
        order = self.query.order
        if not order:
            return
        kinds = [self.query.nodes[p].morphism for p in order]
        rules = []
        total = F.col("_total")
        if all(m is Morphism.ISO for m in kinds):
            rules.append(total == len(order))
        if self.query.mixed and any(m.injective for m in kinds):
            rules.append(total >= len(order))
        if self.query.surjective:
            rules.append(total <= len(order))
            rules.append(F.size(F.array_distinct(F.array(*[name(p) for p in order]))) == total)
        if rules:
            count = self.graph.nodes.agg(F.count("*").alias("_total"))
            self.out = self.out.crossJoin(F.broadcast(count)).where(reduce(and_, rules)).drop("_total")

    # Bans

    def ban(self, b: Ban) -> None:
        """Drop the matches on which the ban fires."""
        extra, known = set(b.extra), list(self.bound)
        touching = [x for x in b.edges if (x.a in extra or x.b in extra) and all(p in extra or p in known for p in (x.a, x.b))]
        marked, tests = self.shared(b)
        if not extra:
            # Each match has the flags of its own pairs, so nothing has to be joined back.
            self.out = marked.where(~reduce(and_, tests, F.lit(True))).select(*[name(p) for p in known])
            return
        if self._simple(b, list(b.extra), touching, tests) or self._ringed(b, list(b.extra), touching, tests):
            return
        if self._bans:
            # The frame is read twice below; written out, a chain of bans stays linear.
            self.out = materialized(self.out)
            marked, tests = self.shared(b)
        self._bans += 1
        hits = marked.where(reduce(and_, tests, F.lit(True))).select(*[name(p) for p in known])
        left = list(b.extra)
        while left:
            p = next((p for p in left if any(not x.negated and x.a != x.b and x.other(p) in known for x in touching if p in (x.a, x.b))), left[0])
            hits = self._extend(hits, b, p, known, touching, last=len(left) == 1)
            left.remove(p)
            known.append(p)
        self._drop(hits)

    def shared(self, b: Ban) -> tuple[DataFrame, list[Column]]:
        """(matches with the flags of the ban's pairs of bound nodes, tests that all hold where that part of the ban does)."""
        mapped = set(self.bound)
        inside = [x for x in b.edges if x.a in mapped and x.b in mapped]
        here = sorted(p for p in set(b.nodes) if p in mapped)
        pairs = {(x.a, x.b) for x in inside}
        induced = b.morphism.induced and not b.implicit
        if induced:
            pairs |= {(p, q) for k, p in enumerate(here) for q in here[k + 1 :]}
        out, tests = self.out, []
        for k, (p, q) in enumerate(sorted(pairs)):
            # One row at most matches, so a left join gives every match its pair's slots.
            claimed = frozenset(self.query.claimed(p, q))
            own = [x for x in inside if (x.a, x.b) == (p, q)]
            flags = [edge_test(self.graph, x, p, claimed).alias(f"_f{k}_{i}") for i, x in enumerate(own)]
            view = self.graph.pair.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("n_slots").alias(f"_n{k}"), *flags)
            out = out.join(view, self.on(name(p), name(q)), "left").drop("_s", "_d")
            for i, x in enumerate(own):
                flag = F.coalesce(F.col(f"_f{k}_{i}"), F.lit(False))
                tests.append(~flag if x.negated else flag)
            if induced and p != q:
                tests.append(F.coalesce(f"_n{k}", F.lit(0)) - len(claimed) <= sum(not x.negated for x in own))
        return out, tests

    def _drop(self, hits: DataFrame) -> None:
        keys = [name(p) for p in self.bound]
        if not keys:
            # One empty match: it stays only if there is no hit.
            some = hits.limit(1).agg(F.count("*").alias("_hits"))
            self.out = self.out.crossJoin(F.broadcast(some)).where("_hits = 0").select()
        else:
            # A match is a unique key, so it needs no row number.
            gone = hits.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            self.out = self.out.join(gone, reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]), "left_anti")

    def _simple(self, b: Ban, left: list[int], touching: list[PatternEdge], tests: list[Column]) -> bool:
        """One further node behind one bound node: a single anti-join, its injectivity a residual of the join."""
        if len(left) != 1 or tests or not touching or any(x.negated or x.a == x.b for x in touching):
            return False
        p = left[0]
        ends = {x.other(p) for x in touching}
        if len(ends) != 1 or not ends <= set(self.bound):
            return False
        q = ends.pop()
        test = reduce(and_, [edge_test(self.graph, x, q, plain=True) for x in touching])
        step = self.pairs(q, p, test)
        if self._restricted(p):
            ok = self.candidates(p).withColumnRenamed(name(p), "_ok")
            step = step.join(ok, F.col("_d") == F.col("_ok"), "left_semi")
        on = F.col(name(q)) == F.col("_s")
        if b.morphism.injective:
            on = reduce(and_, [F.col("_d") != F.col(name(r)) for r in self.bound], on)
        self.out = self.out.join(step, on, "left_anti")
        return True

    def _ringed(self, b: Ban, left: list[int], touching: list[PatternEdge], tests: list[Column]) -> bool:
        """One further node next to two bound nodes that share another bound neighbour: the graph's rings of four tell where there is one, and the matches aren't extended."""
        if len(left) != 1 or tests or not self.whole or not b.morphism.injective or any(x.negated or x.a == x.b for x in touching):
            return False
        p = left[0]
        ends = sorted({x.other(p) for x in touching})
        if len(ends) != 2 or not set(ends) <= set(self.bound):
            return False
        q, s = ends
        r = next((r for r in self.bound if r not in ends and self.between(r, q, False) and self.between(r, s, False) and self.apart(r, q, s)), None)
        if r is None:
            return False
        hits = self.graph.squares.select(*[F.col(c).alias(f"_r{k}") for k, c in zip((r, q, p, s), "wxyz", strict=True)])
        for k in ends:
            test = reduce(and_, [edge_test(self.graph, x, k, plain=True) for x in touching if x.other(p) == k])
            hits = hits.join(self.pairs(k, p, test), self.on(f"_r{k}", f"_r{p}"), "left_semi")
        if self._restricted(p):
            hits = hits.join(self.candidates(p), F.col(f"_r{p}") == F.col(name(p)), "left_semi")
        others = [k for k in self.bound if k not in (r, q, s)]
        hits = materialized(hits.select(*[f"_r{k}" for k in ((r, q, s, p) if others else (r, q, s))]).distinct())
        if hits.count() <= BROADCAST_ROWS:
            hits = F.broadcast(hits)
        on = [F.col(name(k)) == F.col(f"_r{k}") for k in (r, q, s)] + [F.col(name(k)) != F.col(f"_r{p}") for k in others]
        self.out = self.out.join(hits, reduce(and_, on), "left_anti")
        return True

    def _extend(self, hits: DataFrame, b: Ban, p: int, known: list[int], touching: list[PatternEdge], last: bool) -> DataFrame:
        col = name(p)
        mine = [x for x in touching if p in (x.a, x.b) and (x.other(p) in known or x.a == x.b)]
        positive = [x for x in mine if not x.negated and x.a != x.b]
        loops = [x for x in mine if x.a == x.b]
        apart = reduce(and_, [F.col(col) != F.col(name(q)) for q in known], F.lit(True)) if b.morphism.injective else F.lit(True)
        starts = list(dict.fromkeys(x.other(p) for x in positive))
        if starts:
            for k, q in enumerate(starts):
                test = reduce(and_, [edge_test(self.graph, x, q, plain=True) for x in positive if x.other(p) == q])
                if k == 0:
                    hits = hits.join(self.pairs(q, p, test).withColumnRenamed("_d", col), F.col(name(q)) == F.col("_s")).where(apart).drop("_s")
                else:
                    hits = hits.join(self.pairs(q, p, test), self.on(name(q), col), "left_semi")
            if self._restricted(p):
                hits = hits.join(self.candidates(p), col, "left_semi")
        elif last and not mine:
            # No edge at all: such a node exists if more nodes fit than the image can hold.
            fit = self.candidates(p)
            hits = hits.crossJoin(F.broadcast(fit.agg(F.count("*").alias("_fit"))))
            if not b.morphism.injective or not known:
                return hits.where("_fit > 0").drop("_fit")
            if not self._restricted(p):
                return hits.where(F.col("_fit") > F.size(F.array_distinct(F.array(*[name(q) for q in known])))).drop("_fit")
            for k, q in enumerate(known):
                hits = hits.join(fit.select(F.col(col).alias(f"_i{k}")), F.col(name(q)) == F.col(f"_i{k}"), "left")
            image = F.size(F.array_distinct(F.array_compact(F.array(*[f"_i{k}" for k in range(len(known))]))))
            return hits.where(F.col("_fit") > image).drop("_fit", *[f"_i{k}" for k in range(len(known))])
        else:
            hits = hits.crossJoin(self.candidates(p)).where(apart)
        for x in mine:
            if x.negated and x.a != x.b:
                q = x.other(p)
                hits = hits.join(self.pairs(q, p, edge_test(self.graph, x, q, plain=True)), self.on(name(q), col), "left_anti")
        for x in loops:
            hits = hits.join(self.pairs(p, p, edge_test(self.graph, x, p, plain=True)), self.on(col, col), "left_anti" if x.negated else "left_semi")
        return hits


def lower(graph: Graph, query: CompiledQuery, start: DataFrame | None = None) -> DataFrame:
    """All matches as columns n<id>; with ``start``, those whose context nodes one of its rows binds."""
    return Lowering(graph, query, start).run()
