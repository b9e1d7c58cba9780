"""Property graphs as two DataFrames, with the views that searching needs.

``nodes`` has ``id`` (bigint) and, unless nodes have no value, ``val``; ``edges``
has ``n1 <= n2``, ``slot`` and maybe ``val``. (n1, n2, slot) is unique.
"""

from __future__ import annotations

from functools import cached_property
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as err
from ..model import FLIP, SRC, TGT, UND, Kind
from ..sources.store import materialized

PAIR_FLAG = {UND: "has_und", SRC: "has_src", TGT: "has_tgt"}
PAIR_VALUE = {UND: "v_und", SRC: "v_src", TGT: "v_tgt"}


def _packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns beside the keys as one column ``val``."""
    rest = [c for c in df.columns if c not in keys]
    if not rest or rest == ["val"]:
        return df.select(*keys, *rest)
    return df.select(*keys, F.struct(*rest).alias("val"))


class Graph:
    """An immutable snapshot; modifying gives a new one."""

    def __init__(self, kind: Kind, nodes: DataFrame, edges: DataFrame):
        self.kind = kind
        self.nodes = _packed(nodes.withColumn("id", F.col("id").cast("long")), ["id"])
        self.edges = _packed(edges.withColumns({c: F.col(c).cast("long") for c in ("n1", "n2")}).drop("eid"), ["n1", "n2", "slot"])
        self._tier = None
        self._pairs = None
        self.tier = "raw"

    # Construction

    @classmethod
    def from_frames(cls, kind: Kind, nodes: DataFrame, edges: DataFrame, check: bool = False) -> Graph:
        """From node and edge tables; columns beyond the keys become ``val`` (a struct if several)."""
        out = cls(kind, nodes, edges)
        if check:
            out.validate()
        return out

    @classmethod
    def from_edges(cls, kind: Kind, edges: DataFrame, check: bool = False) -> Graph:
        """Nodes are the end-points."""
        nodes = edges.select(F.explode(F.array("n1", "n2")).alias("id")).distinct()
        return cls.from_frames(kind, nodes, edges, check)

    @classmethod
    def from_count(cls, kind: Kind, n: int, edges: DataFrame, check: bool = False) -> Graph:
        """Nodes 0 to n-1."""
        return cls.from_frames(kind, edges.sparkSession.range(n), edges, check)

    @classmethod
    def from_pairs(cls, spark: SparkSession, kind: Kind, pairs, nodes=None, slot: str | None = None) -> Graph:
        """From Python lists: ``(a, b)`` or ``(a, b, value)`` edges from a to b, and ids, (id, value) pairs, or a count."""
        pairs = [tuple(p) for p in pairs]
        slot = slot or kind.slots[0]
        rows = []
        for p in pairs:
            a, b = p[0], p[1]
            s = slot if slot == UND or a <= b else (TGT if slot == SRC else SRC)
            rows.append((min(a, b), max(a, b), s, *p[2:]))
        wide = any(len(r) > 3 for r in rows)
        edges = spark.createDataFrame(rows, ["n1", "n2", "slot", "val"] if wide else "n1 long, n2 long, slot string")
        if nodes is None:
            return cls.from_edges(kind, edges, check=True)
        if isinstance(nodes, int):
            return cls.from_count(kind, nodes, edges, check=True)
        nodes = list(nodes)
        valued = bool(nodes) and isinstance(nodes[0], tuple)
        frame = spark.createDataFrame(nodes if valued else [(i,) for i in nodes], ["id", "val"] if valued else "id long")
        return cls.from_frames(kind, frame, edges, check=True)

    def validate(self) -> None:
        """Raise if ids or edges repeat, ends are missing, or slots don't fit the kind."""
        if r := self.duplicate_nodes().first():
            raise err.DuplicateNode(id=r[0])
        if r := self.duplicate_edges().first():
            raise err.DuplicateEdge(n1=r[0], n2=r[1], slot=r[2])
        if r := self.missing_endpoints().first():
            raise err.MissingEndpoint(n1=r[0], n2=r[1], slot=r[2])
        if r := self.edges.where(~F.col("slot").isin(*self.kind.slots) | (F.col("n1") > F.col("n2"))).first():
            raise TypeError(f"edge ({r['n1']}, {r['n2']}, {r['slot']}) doesn't fit kind {self.kind.name}")

    def duplicate_nodes(self) -> DataFrame:
        return self.nodes.groupBy("id").count().where("count > 1")

    def duplicate_edges(self) -> DataFrame:
        return self.edges.groupBy("n1", "n2", "slot").count().where("count > 1")

    def missing_endpoints(self) -> DataFrame:
        ids = self.nodes.select("id")
        keys = self.edges.select("n1", "n2", "slot")
        return keys.join(ids, keys["n1"] == ids["id"], "left_anti").unionByName(keys.join(ids, keys["n2"] == ids["id"], "left_anti")).distinct()

    # Views

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def node_value(self) -> bool:
        return "val" in self.nodes.columns

    @property
    def edge_value(self) -> bool:
        return "val" in self.edges.columns

    @cached_property
    def half(self) -> DataFrame:
        """src, dst, slot (seen from src), val: every edge from either end; a self-loop once if undirected, as SRC and TGT if directed."""
        rest = [c for c in self.edges.columns if c == "val"]
        there = self.edges.select(F.col("n1").alias("src"), F.col("n2").alias("dst"), "slot", *rest)
        flipped = F.when(F.col("slot") == SRC, TGT).when(F.col("slot") == TGT, SRC).otherwise(F.col("slot"))
        back = self.edges.where((F.col("n1") != F.col("n2")) | (F.col("slot") != UND)).select(F.col("n2").alias("src"), F.col("n1").alias("dst"), flipped.alias("slot"), *rest)
        return there.unionByName(back)

    @cached_property
    def pair(self) -> DataFrame:
        """One row for each ordered adjacent pair: src, dst, n_slots, has_*, v_*.

        Kinds with one slot need no grouping, so their pairs cost no shuffle.
        """
        if self.kind is Kind.UNDIR:
            values = [F.col("val").alias("v_und")] if self.edge_value else []
            out = self.half.select("src", "dst", F.lit(1).alias("n_slots"), F.lit(True).alias("has_und"), *values)
        elif self._pairs is not None:
            swap = {name[slot]: name[FLIP[slot]] for name in (PAIR_FLAG, PAIR_VALUE) for slot in self.kind.slots}
            back = self._pairs.where("src < dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.col(swap.get(c, c)).alias(c) for c in self._pairs.columns[2:]])
            out = self._pairs.unionByName(back)
        else:
            out = self._grouped(self.half)
        if self._tier == "pair":
            out = out.repartition("src").persist()
        return out

    def _grouped(self, half: DataFrame) -> DataFrame:
        """Rows of ``half`` as one row for each ordered pair."""
        aggs = [F.count("*").cast("int").alias("n_slots")]
        for slot in self.kind.slots:
            here = F.col("slot") == slot
            aggs.append(F.max(here).alias(PAIR_FLAG[slot]))
            if self.edge_value:
                aggs.append(F.first(F.when(here, F.col("val")), ignorenulls=True).alias(PAIR_VALUE[slot]))
        return half.groupBy("src", "dst").agg(*aggs)

    @property
    def _links(self) -> DataFrame:
        """Adjacent pairs of different nodes, once each, as lo < hi."""
        out = self.edges.where("n1 < n2").select(F.col("n1").alias("lo"), F.col("n2").alias("hi"))
        return out if self.kind is Kind.UNDIR else out.distinct()

    @cached_property
    def triangles(self) -> DataFrame:
        """x, y, z: all pairs adjacent; written once, in each of the six orders.

        A triangle is found at its middle id, from paths that ascend, so it costs no
        more rows than a third of the paths of two edges, and none where ids part
        the nodes into two sides.
        """
        up, on = self._links.withColumnsRenamed({"lo": "a", "hi": "b"}), self._links.withColumnsRenamed({"lo": "b", "hi": "c"})
        found = up.join(on, "b").join(self._links, (F.col("a") == F.col("lo")) & (F.col("c") == F.col("hi")), "left_semi")
        orders = F.array(*[F.struct(*[F.col(c).alias(x) for c, x in zip(cols, "xyz", strict=True)]) for cols in permutations("abc")])
        return materialized(found.select(F.explode(orders).alias("_t")).select("_t.*"))

    @cached_property
    def squares(self) -> DataFrame:
        """w, x, y, z: a ring of four different nodes; written once, in each of its eight orders.

        A ring is two paths of two edges that leave its extreme node and meet opposite
        it, so only paths below that node are made: those at the side of the graph
        with fewer neighbours each, and never more than half of all.
        """
        def weight(c: str) -> float:
            return self._links.groupBy(c).agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0.0

        down = weight("lo") > weight("hi")
        # With ids negated, the extreme node is the smallest.
        links = self._links.select((-F.col("hi")).alias("lo"), (-F.col("lo")).alias("hi")) if down else self._links
        step = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        paths = step.join(links.select(F.col("lo").alias("u"), F.col("hi").alias("w")), "u").where("w < v").select("v", "w", "u")
        paths = paths.unionByName(step.join(links.select(F.col("hi").alias("u"), F.col("lo").alias("w")), "u").select("v", "w", "u"))
        found = paths.join(paths.withColumnRenamed("u", "u2"), ["v", "w"]).where("u < u2")
        ring = ["v", "u", "w", "u2"]
        turned = [ring[k:] + ring[:k] for k in range(4)]
        orders = F.array(*[F.struct(*[(-F.col(c) if down else F.col(c)).alias(x) for c, x in zip(cols, "wxyz", strict=True)]) for cols in turned + [t[::-1] for t in turned]])
        return materialized(found.select(F.explode(orders).alias("_t")).select("_t.*"))

    @cached_property
    def degrees(self) -> DataFrame:
        """id, deg: distinct neighbours, 0 for isolated nodes."""
        d = self.half.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("deg"))
        ids = self.nodes.select("id")
        return ids.join(d, ids["id"] == d["src"], "left").select("id", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"))

    def index(self, tier: str = "pair") -> Graph:
        """A caching hint: ``raw`` caches nothing, ``pair`` the pair view, ``values`` the nodes too. Results never differ."""
        if tier not in ("raw", "pair", "values"):
            raise ValueError(tier)
        out = Graph(self.kind, self.nodes, self.edges)
        out._tier = None if tier == "raw" else "pair"
        out.tier = tier
        if tier == "values":
            # Grouped by value, so that a cached batch holds few values and an equality test skips most batches.
            out.nodes = out.nodes.repartitionByRange("val").sortWithinPartitions("val").persist() if out.node_value else out.nodes.persist()
        return out

    def stored(self) -> Graph:
        """The same graph with nodes and edges written once, in order of their ids: for graphs that are computed and then searched.

        Pairs of kinds with several slots are grouped and written once too, the
        smaller id first; the other direction is read from the same rows.
        """
        edges = materialized(self.edges.sortWithinPartitions("n1", "n2"), compression="zstd")
        out = Graph(self.kind, materialized(self.nodes.sortWithinPartitions("id"), compression="zstd"), edges)
        if self.kind is not Kind.UNDIR:
            one_way = out.half.where("src <= dst")
            out._pairs = materialized(out._grouped(one_way).sortWithinPartitions("src", "dst"), compression="zstd")
        return out

    # Lookups

    def get(self, id: int) -> DataFrame:
        """The node's row."""
        return self.nodes.where(F.col("id") == id)

    def _key(self, a: int, b: int, slot: str) -> Column:
        """Slot seen from a."""
        if a > b:
            slot = {SRC: TGT, TGT: SRC}.get(slot, slot)
        elif a == b and slot == TGT:
            slot = SRC
        return (F.col("n1") == min(a, b)) & (F.col("n2") == max(a, b)) & (F.col("slot") == slot)

    def get_edge(self, a: int, b: int, slot: str) -> DataFrame:
        return self.edges.where(self._key(a, b, slot))

    def set_value(self, id: int, value: Column) -> Graph:
        """The graph with another value at one node; ``value`` may read ``val``."""
        return Graph(self.kind, self.nodes.withColumn("val", F.when(F.col("id") == id, value).otherwise(F.col("val"))), self.edges)

    def set_edge_value(self, a: int, b: int, slot: str, value: Column) -> Graph:
        return Graph(self.kind, self.nodes, self.edges.withColumn("val", F.when(self._key(a, b, slot), value).otherwise(F.col("val"))))

    def set_rel(self, a: int, b: int, slots: dict[str, object]) -> Graph:
        """The graph with other edges between a and b: ``slots``, seen from a, maps each slot to a value (ignored where edges have none) or to None, which removes it; slots not named stay."""
        out = self.edges
        for slot, value in slots.items():
            self.kind.check(slot)
            if slot not in self.kind.slots:
                raise TypeError("a slot of the kind is needed")
            out = out.where(~self._key(a, b, slot))
            if value is not None:
                seen = {SRC: TGT, TGT: SRC}.get(slot, slot) if a > b else SRC if a == b and slot == TGT else slot
                row = self.spark.range(1).select(F.lit(min(a, b)).cast("long").alias("n1"), F.lit(max(a, b)).cast("long").alias("n2"), F.lit(seen).alias("slot"))
                if self.edge_value:
                    row = row.withColumn("val", (value if isinstance(value, Column) else F.lit(value)).cast(self.edges.schema["val"].dataType))
                out = out.unionByName(row)
        return Graph(self.kind, self.nodes, out)

    def has(self, id: int) -> bool:
        return not self.get(id).isEmpty()

    def has_edge(self, a: int, b: int, slot: str | None = None) -> bool:
        return not (self.edges_between(a, b) if slot is None else self.get_edge(a, b, slot)).isEmpty()

    def is_adjacent(self, a: int, b: int) -> bool:
        return self.has_edge(a, b)

    def edges_between(self, a: int, b: int) -> DataFrame:
        """Edges of the pair, slots seen from a."""
        return self.half.where((F.col("src") == a) & (F.col("dst") == b))

    def rel(self, a: int | None = None, b: int | None = None) -> DataFrame:
        """n1, n2 and what each slot holds: of one pair, or of all."""
        out = self.pair.where("src <= dst").withColumnsRenamed({"src": "n1", "dst": "n2"})
        return out if a is None else out.where((F.col("n1") == min(a, b)) & (F.col("n2") == max(a, b)))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def degree(self, id: int) -> int:
        return self.half.where(F.col("src") == id).select("dst").distinct().count()

    def neighbors(self, id: int) -> DataFrame:
        return self.half.where(F.col("src") == id).select(F.col("dst").alias("id")).distinct()

    def nodes_with_min_degree(self, k: int) -> DataFrame:
        return self.degrees.where(F.col("deg") >= k)

    def degree_histogram(self) -> DataFrame:
        return self.degrees.groupBy("deg").agg(F.count("*").alias("n"))

    def to_lists(self) -> tuple[list, list]:
        """All nodes and edges on the driver, for small graphs."""
        return [tuple(r) for r in self.nodes.orderBy("id").collect()], [tuple(r) for r in self.edges.orderBy("n1", "n2", "slot").collect()]
