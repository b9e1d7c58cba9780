"""One query for each operator on the fixture graphs, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as err
from . import fixtures
from .functions.pattern import E, N, N_, X, at, ban, e, get, n, t, x
from .functions.pattern import T as translated
from .model import Kind, Morphism
from .operators.graph import Graph
from .operators.modify import check_delta, disjoint, free_ids, modify, resolve_with_bindings, rewrite
from .operators.session import Search, Session, search
from .sources.dot import to_dot
from .sources.literal import graph
from .sources.parser import parse
from .sources.persist import PersistFailure, load, read_header, save
from .sources.store import shared_folder
from .streaming.changes import Control, MutationStream, Watcher, batch_delta, notify, watch_matches, watch_search

ISO, SUBISO, MONO, HOMO, EPI, EPIMONO = Morphism.ISO, Morphism.SUBISO, Morphism.MONO, Morphism.HOMO, Morphism.EPI, Morphism.EPIMONO
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _found(name: str, fixture: str, sql: str, *clusters) -> None:
    """Register a search; ``sql`` continues the fixture's tables."""
    QUERIES[name] = lambda spark, sf: search(fixtures.load(spark, sf, fixture), *clusters).matches()
    SQL[name] = fixtures.ctes(fixture) + sql


def _query(name: str, fixture: str | None, sql: str | None):
    def register(f):
        QUERIES[name] = f if fixture is None else lambda spark, sf: f(fixtures.load(spark, sf, fixture))
        if sql:
            SQL[name] = (fixtures.ctes(fixture) if fixture else "") + sql
        return f

    return register


# Searches: morphisms

_found("mono_triangle", "gn", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = b.dst AND c.dst = a.src WHERE a.src <> b.dst", get(MONO, N(0) ^ (N(1) ^ (N(2) ^ n(0)))))
_found("mono_edge", "gn", "SELECT src AS n0, dst AS n1 FROM pair WHERE src <> dst", get(MONO, N(0) ^ N(1)))
_found("homo_path", "gn", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst", get(HOMO, N(0) ^ (N(1) ^ N(2))))
_found(
    "subiso_path",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM pair c WHERE c.src = a.src AND c.dst = b.dst)",
    get(SUBISO, N(0) ^ (N(1) ^ N(2))),
)
_found(
    "epi_cover",
    "ge",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3, d.dst AS n4 FROM pair a JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = b.dst JOIN pair d ON d.src = c.dst WHERE a.s AND b.s AND c.s AND d.s AND (SELECT count(DISTINCT x) FROM (VALUES (a.src), (a.dst), (b.dst), (c.dst), (d.dst)) v(x)) = (SELECT count(*) FROM nodes)",
    get(EPI, N(0) >> (N(1) >> (N(2) >> (N(3) >> N(4))))),
)
_found(
    "epimono_cover",
    "ge",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3, d.dst AS n4 FROM pair a JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = b.dst JOIN pair d ON d.src = c.dst WHERE a.s AND b.s AND c.s AND d.s AND a.vs > 10 AND (SELECT count(DISTINCT x) FROM (VALUES (a.src), (a.dst), (b.dst), (c.dst), (d.dst)) v(x)) = 5 AND (SELECT count(*) FROM nodes) = 5",
    get(EPIMONO, N(0) & E().test(lambda v: v > 10) >> (N(1) >> (N(2) >> (N(3) >> N(4))))),
)
_found(
    "mixed_morphism",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM pair a JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = a.src WHERE a.src <> b.dst AND a.src <> a.dst AND c.dst <> a.src AND (SELECT count(*) FROM pair q WHERE q.src = a.src) >= 2 AND NOT EXISTS (SELECT 1 FROM pair d WHERE d.src = a.src AND d.dst = b.dst) AND a.vu >= 2",
    get(SUBISO, N(0) & E().test(lambda v: v >= 2) ^ (N(1) ^ N(2))),
    get(HOMO, n(0) ^ N(3)),
)
_found("disconnected_get", "gn", "SELECT a.id AS n0, b.id AS n1 FROM nodes a, nodes b WHERE a.id <> b.id", get(MONO, N(0), N(1)))
_found(
    "square_cycle",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM pair a JOIN nodes k ON k.id = a.src AND k.kind = 'order' JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = b.dst JOIN pair d ON d.src = c.dst AND d.dst = a.src WHERE a.src <> b.dst AND a.dst <> c.dst",
    get(MONO, N(0).test(lambda v: v["kind"] == "order") ^ (N(1) ^ (N(2) ^ (N(3) ^ n(0))))),
)

# Searches: directions and slots

_found("dir_chain", "ge", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst WHERE a.s AND b.s AND a.src <> a.dst AND a.dst <> b.dst AND a.src <> b.dst", get(MONO, N(0) >> (N(1) >> N(2))))
_found("dir_fanout", "gos", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.src WHERE a.s AND b.s AND a.dst <> b.dst", get(MONO, N(0) >> N(1) >> N(2)))
_found("dir_fanin", "gop", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.src WHERE a.t AND b.t AND a.dst <> b.dst", get(MONO, N(0) << N(1) << N(2)))
_found("dir_reciprocal", "ge", "SELECT src AS n0, dst AS n1 FROM pair WHERE s AND t AND src <> dst", get(MONO, N(0) >> N(1), n(1) >> n(0)))
_found("self_loop", "ge", "SELECT src AS n0 FROM pair WHERE src = dst AND s", get(MONO, N(0) >> n(0)))
_found("anyslot_edge", "gm", "SELECT src AS n0, dst AS n1 FROM pair WHERE src <> dst", get(MONO, N(0) % N(1)))
_found("anyslot_subiso", "gm", "SELECT src AS n0, dst AS n1 FROM pair WHERE src <> dst AND k = 1", get(SUBISO, N(0) % N(1)))
_found(
    "mixed_anydir_path",
    "gm",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst WHERE a.s AND b.u AND a.src <> b.dst AND a.src <> a.dst AND a.dst <> b.dst",
    get(MONO, N(0) >> N(1), n(1) ^ N(2)),
)
_found("multi_slot_pair", "gm", "SELECT src AS n0, dst AS n1 FROM pair WHERE src <> dst AND s AND u AND k = 2", get(SUBISO, N(0) >> N(1), n(0) ^ n(1)))

# Searches: predicates

_found("node_test", "gos", "SELECT a.src AS n0, a.dst AS n1 FROM pair a JOIN nodes x ON x.id = a.src JOIN nodes y ON y.id = a.dst WHERE a.s AND x.label IN ('1-URGENT', '2-HIGH') AND y.label = '7'", get(MONO, N(0).test("val.label in ('1-URGENT', '2-HIGH')") >> N(1).test(lambda v: v["label"] == "7")))
_found("edge_val", "gos", "SELECT src AS n0, dst AS n1 FROM pair WHERE vs = 50", get(MONO, N(0) & E().val(50.0) >> N(1)))
_found("edge_test", "gos", "SELECT src AS n0, dst AS n1 FROM pair WHERE vs >= 48", get(MONO, N(0) & E().test(lambda v: v >= 48) >> N(1)))
_found("anyslot_pred", "gm", "SELECT src AS n0, dst AS n1 FROM pair WHERE src <> dst AND (vu > 2 OR vs > 2 OR vt > 2)", get(MONO, N(0) & E().test(lambda v: v > 2) % N(1)))

# Searches: negation

_found("neg_edge", "gm", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE a.u AND a.src <> a.dst AND NOT a.s", get(MONO, N(0) ^ N(1), n(0) & (~E() >> n(1))))
_found("neg_edge_pred", "ge", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE a.s AND a.src <> a.dst AND NOT coalesce(a.vt % 2 = 0, false)", get(MONO, N(0) >> N(1), n(0) & (~E().test(lambda v: v % 2 == 0) << n(1))))
_found(
    "neg_edge_anyslot",
    "gm",
    "SELECT a.src AS n0, a.dst AS n1, c.id AS n2 FROM pair a, nodes c WHERE a.s AND a.src <> a.dst AND c.id NOT IN (a.src, a.dst) AND NOT EXISTS (SELECT 1 FROM pair b WHERE b.src = a.dst AND b.dst = c.id)",
    get(MONO, N(0) >> N(1), N(2), n(1) & (~E() % n(2))),
)
_found("neg_node_connected", "gup", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE NOT EXISTS (SELECT 1 FROM pair b WHERE b.src = a.src AND b.dst NOT IN (a.src, a.dst))", get(MONO, N(0) ^ N(1), n(0) ^ ~N_()))
_found(
    "neg_node_pair",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE NOT EXISTS (SELECT 1 FROM pair b, pair c WHERE b.src = a.src AND c.src = a.dst AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst) AND b.dst <> c.dst)",
    get(MONO, N(0) ^ N(1), n(0) ^ ~N_(), n(1) ^ ~N_()),
)
_found("neg_node_free", "gn", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.name = 'NATION_7' AND x.id NOT IN (a.src, a.dst))", get(MONO, N(0) ^ N(1), ~N_().test(lambda v: v["name"] == "NATION_7")))
_found(
    "neg_node_val",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE NOT EXISTS (SELECT 1 FROM pair b JOIN nodes x ON x.id = b.dst WHERE b.src = a.src AND b.dst NOT IN (a.src, a.dst) AND x.label = '1-URGENT')",
    get(MONO, N(0) ^ N(1), n(0) ^ ~N_().test(lambda v: v["label"] == "1-URGENT")),
)

# Searches: bans

_COMMON = "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.src WHERE a.s AND b.s AND a.dst <> b.dst AND NOT EXISTS (SELECT 1 FROM pair c JOIN pair d ON d.dst = c.dst WHERE c.src = a.dst AND d.src = b.dst AND c.t AND d.t AND c.dst NOT IN (a.src, a.dst, b.dst))"
_found("ban_common_neighbor", "gop", _COMMON, get(MONO, N(0) >> N(1) >> N(2)), ban(MONO, n(1) << N(3), n(2) << n(3)))
_found("ban_shared_edge", "gm", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst WHERE a.u AND b.s AND a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM pair c WHERE c.src = a.src AND c.dst = b.dst AND c.s)", get(MONO, N(0) ^ (N(1) >> N(2))), ban(MONO, n(0) >> n(2)))
_found("ban_anyslot_unclaimed", "gm", "SELECT src AS n0, dst AS n1 FROM pair WHERE src <> dst AND u AND NOT (s OR t)", get(MONO, N(0) ^ N(1)), ban(MONO, n(0) % n(1)))
_found("ban_subiso", "gm", "SELECT a.id AS n0, b.id AS n1 FROM nodes a, nodes b WHERE a.id <> b.id AND NOT EXISTS (SELECT 1 FROM pair p WHERE p.src = a.id AND p.dst = b.id AND p.k <= 1)", get(MONO, N(0), N(1)), ban(SUBISO, n(0) % n(1)))
_found("ban_homo", "gos", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE a.s AND NOT EXISTS (SELECT 1 FROM pair b WHERE b.src = a.dst AND b.t AND b.vt > 50)", get(MONO, N(0) >> N(1)), ban(HOMO, n(1) & E().test(lambda v: v > 50) << N(2)))
_found("ban_mono", "gos", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE a.s AND NOT EXISTS (SELECT 1 FROM pair b WHERE b.src = a.dst AND b.t AND b.vt > 50 AND b.dst <> a.src)", get(MONO, N(0) >> N(1)), ban(MONO, n(1) & E().test(lambda v: v > 50) << N(2)))
_found(
    "ban_two_clusters_or",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE NOT EXISTS (SELECT 1 FROM pair b JOIN nodes x ON x.id = b.dst WHERE b.src = a.src AND b.dst NOT IN (a.src, a.dst) AND x.label = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM pair b WHERE b.src = a.dst AND b.dst NOT IN (a.src, a.dst) AND b.vu >= 2)",
    get(MONO, N(0) ^ N(1)),
    ban(MONO, n(0) ^ N(2).test(lambda v: v["label"] == "1-URGENT")),
    ban(MONO, n(1) & E().test(lambda v: v >= 2) ^ N(3)),
)
_found(
    "ban_one_cluster_and",
    "gup",
    "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE NOT EXISTS (SELECT 1 FROM pair b JOIN nodes x ON x.id = b.dst, pair c WHERE b.src = a.src AND c.src = a.dst AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst) AND b.dst <> c.dst AND x.label = '1-URGENT' AND c.vu >= 2)",
    get(MONO, N(0) ^ N(1)),
    ban(MONO, n(0) ^ N(2).test(lambda v: v["label"] == "1-URGENT"), n(1) & E().test(lambda v: v >= 2) ^ N(3)),
)
_found("ban_pred", "gos", "SELECT a.src AS n0, a.dst AS n1 FROM pair a WHERE a.s AND NOT EXISTS (SELECT 1 FROM pair b JOIN nodes x ON x.id = b.dst WHERE b.src = a.src AND b.s AND b.dst NOT IN (a.src, a.dst) AND x.label = '3')", get(MONO, N(0) >> N(1)), ban(MONO, n(0) >> N(2).test(lambda v: v["label"] == "3")))
_found("fragments", "gn", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst JOIN nodes x ON x.id = a.src WHERE a.src <> b.dst AND x.region < 3", get(MONO, N(0).test("true") ^ N(1)), get(MONO, n(1) ^ N(2), n(0)), ban(MONO, n(0) ^ N(5).test(lambda v: v["region"] >= 3)))


@_query("iso_component", None, "SELECT CAST(a AS BIGINT) AS n0, CAST(b AS BIGINT) AS n1, CAST(c AS BIGINT) AS n2 FROM (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)) v(a, b, c)")
def _iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, Kind.UNDIR, N(0) ^ (N(1) ^ (N(2) ^ n(0))))
    return search(g, get(ISO, N(0) ^ (N(1) ^ (N(2) ^ n(0))))).matches()


@_query("text_pattern", "gn", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.dst WHERE a.src <> b.dst AND a.vu = 3 AND NOT EXISTS (SELECT 1 FROM nodes x JOIN pair c ON c.dst = x.id WHERE c.src = b.dst AND x.name IN ('NATION_3', 'NATION_8') AND x.id NOT IN (a.src, a.dst, b.dst))")
def _text(g: Graph) -> DataFrame:
    return search(g, *parse("get(Mono) { N(0) & E().val(3) ^ (N(1) ^ N(2)) } ban(Mono) { n(2) ^ N(7).test(\"val.name in ('NATION_3', 'NATION_8')\") }")).matches()


@_query("bound_context", "gos", "SELECT dst AS n0, src AS n1 FROM pair WHERE s AND dst = 1000000003")
def _bound(g: Graph) -> DataFrame:
    return Search(g, [get(MONO, X(0) << N(1))]).bind({0: 1_000_000_003}).matches()


@_query("bound_batch", "gos", "SELECT dst AS n0, src AS n1, dst % 7 AS tag FROM pair WHERE s AND dst > 1000000000")
def _batch(g: Graph) -> DataFrame:
    table = g.nodes.where("id > 1000000000").select(F.col("id").alias("n0"), (F.col("id") % 7).alias("tag"))
    return Search(g, [get(MONO, X(0) << N(1))]).bind_all(table).select("n0", "n1", "tag")


@_query("pinned_node", "gos", "SELECT dst AS n0, src AS n1 FROM pair WHERE s AND dst = 1000000005")
def _pinned(g: Graph) -> DataFrame:
    return search(g, get(MONO, at(0, 1_000_000_005) << N(1))).matches()


_found(
    "path_of_four",
    "gn",
    "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2, c.dst AS n3 FROM pair a JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = b.dst WHERE a.src <> b.dst AND a.dst <> c.dst AND a.src <> c.dst",
    get(MONO, N(0) ^ (N(1) ^ (N(2) ^ N(3)))),
)


@_query("node_val", "gos", "SELECT a.src AS n0, a.dst AS n1 FROM pair a JOIN nodes x ON x.id = a.src WHERE a.s AND x.label = '1-URGENT'")
def _node_val(g: Graph) -> DataFrame:
    labelled = Graph(g.kind, g.nodes.select("id", F.col("val.label").alias("val")), g.edges)
    return search(labelled, get(MONO, N(0).val("1-URGENT") >> N(1))).matches()


_found("edge_test_sql", "gos", "SELECT src AS n0, dst AS n1 FROM pair WHERE vs >= 48", get(MONO, N(0) & E().test("val >= 48 AND 'val' <> 'interval'") >> N(1)))
_found("node_test_pandas", "gn", "SELECT a.src AS n0, a.dst AS n1 FROM pair a JOIN nodes x ON x.id = a.src WHERE x.name LIKE '%1'", get(MONO, N(0).test(lambda v: _ends_in_one(v["name"])) ^ N(1)))


def _ends_in_one(name):
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(lambda s: s.str.endswith("1"), "boolean")(name)


@_query("bind_twice", "gos", "SELECT dst AS n0, src AS n1 FROM pair WHERE s AND dst IN (1000000003, 1000000004)")
def _bind_twice(g: Graph) -> DataFrame:
    pattern = Search(g, [get(MONO, X(0) << N(1))])
    return pattern.bind({0: 1_000_000_003}).matches().unionByName(pattern.bind({0: 1_000_000_004}).matches())


# Results

_PATH = get(MONO, N(0) >> N(1) >> N(2))


@_query("match_count", "gos", "SELECT count(*) AS n FROM pair a JOIN pair b ON b.src = a.src WHERE a.s AND b.s AND a.dst <> b.dst")
def _count(g: Graph) -> DataFrame:
    return search(g, _PATH).matches().agg(F.count("*").alias("n"))


@_query("match_ordered_limit", "gos", "SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM pair a JOIN pair b ON b.src = a.src WHERE a.s AND b.s AND a.dst <> b.dst ORDER BY 1, 2, 3 LIMIT 20")
def _ordered(g: Graph) -> DataFrame:
    return search(g, _PATH).ordered(20)


@_query("match_exists", "gos", "SELECT count(*) > 0 AS found FROM pair a JOIN pair b ON b.src = a.src WHERE a.s AND b.s AND a.dst <> b.dst")
def _exists(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(search(g, _PATH).exists(),)], "found boolean")


@_query("translate_nodes", "gos", "SELECT a.src AS n0, a.dst AS n1, x.label AS order_label, y.label AS supplier_label FROM pair a JOIN nodes x ON x.id = a.src JOIN nodes y ON y.id = a.dst WHERE a.s")
def _translate(g: Graph) -> DataFrame:
    return search(g, get(MONO, N(0) >> N(1))).with_values().select("n0", "n1", F.col("v0.label").alias("order_label"), F.col("v1.label").alias("supplier_label"))


_ANY = [get(MONO, N(0) >> N(1), n(0) % n(1))]
_SLOTS = "SELECT a.src AS n0, a.dst AS n1, a.src, a.dst, x.slot, h.val FROM pair a JOIN half h ON h.src = a.src AND h.dst = a.dst JOIN (VALUES ('SRC'), ('UND'), ('TGT')) x(slot) ON x.slot = h.slot WHERE a.s AND a.src <> a.dst"


@_query("matched_edges", "gm", _SLOTS + " UNION ALL SELECT src, dst, src, dst, 'SRC', vs FROM pair WHERE s AND src <> dst")
def _edges(g: Graph) -> DataFrame:
    return search(g, *_ANY).matched_edges()


@_query("matched_edges_unclaimed", "gm", _SLOTS + " AND h.slot <> 'SRC' UNION ALL SELECT src, dst, src, dst, 'SRC', vs FROM pair WHERE s AND src <> dst")
def _unclaimed(g: Graph) -> DataFrame:
    return search(g, *_ANY).matched_edges(unclaimed=True)


@_query("adjacents", "gm", "SELECT a.src AS n0, a.dst AS n1, 1 AS node, a.dst AS id, z.slot, x.name, x.region FROM pair a JOIN nodes x ON x.id = a.dst, (VALUES ('SRC'), ('ANY')) z(slot) WHERE a.s AND a.src <> a.dst")
def _adjacents(g: Graph) -> DataFrame:
    return search(g, *_ANY).adjacents(0).select("n0", "n1", "node", "id", "slot", "val.name", "val.region")


_FIRED = "a.s AND EXISTS (SELECT 1 FROM pair b WHERE b.src = a.dst AND b.t AND b.vt >= 50 AND b.dst <> a.src)"
_TRACE_SQL = f"""SELECT 'bind n0' AS step, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'bind n1', (SELECT count(*) FROM pair WHERE s)
UNION ALL SELECT 'ban 0 fired', (SELECT count(*) FROM pair a WHERE {_FIRED})
UNION ALL SELECT 'ban 0 passed', (SELECT count(*) FROM pair a WHERE a.s AND NOT ({_FIRED}))
UNION ALL SELECT 'match', (SELECT count(*) FROM pair a WHERE a.s AND NOT ({_FIRED}))"""


@_query("trace_steps", "gos", _TRACE_SQL)
def _trace(g: Graph) -> DataFrame:
    s: Session = search(g, get(MONO, N(1) << N(0)), ban(MONO, n(1) & E().test(lambda v: v >= 50) << N(2)))
    out = None
    for step, frame in s.trace():
        row = frame.agg(F.lit(step).alias("step"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# Graphs


@_query("build_pair_view", "gm", "SELECT src, dst, CAST(k AS INTEGER) AS n_slots, u AS has_und, s AS has_src, t AS has_tgt, vu AS v_und, vs AS v_src, vt AS v_tgt FROM pair")
def _pair(g: Graph) -> DataFrame:
    return g.pair.select("src", "dst", "n_slots", "has_und", "has_src", "has_tgt", "v_und", "v_src", "v_tgt")


@_query("export_nodes", "gos", "SELECT id, kind, label FROM nodes")
def _nodes(g: Graph) -> DataFrame:
    return g.nodes.select("id", "val.*")


@_query("export_edges", "gos", "SELECT n1, n2, slot, val FROM edges")
def _all_edges(g: Graph) -> DataFrame:
    return g.edges


@_query("graph_from_edges", "guu", "SELECT DISTINCT id FROM (SELECT n1 AS id FROM edges UNION ALL SELECT n2 FROM edges) t")
def _from_edges(g: Graph) -> DataFrame:
    return Graph.from_edges(Kind.UNDIR, g.edges).nodes


@_query("graph_counts", "gps", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _counts(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))


@_query("node_lookup", "gos", "SELECT id, kind, label FROM nodes WHERE id = 1000000007")
def _lookup(g: Graph) -> DataFrame:
    return g.get(1_000_000_007).select("id", "val.*")


@_query("edges_between", "gm", "SELECT src, dst, slot, val FROM half WHERE src = 5 AND dst = 0")
def _between(g: Graph) -> DataFrame:
    return g.edges_between(5, 0)


@_query("neighbors", "gn", "SELECT DISTINCT dst AS id FROM half WHERE src = 5")
def _neighbors(g: Graph) -> DataFrame:
    return g.neighbors(5)


_DEG = "SELECT x.id, count(DISTINCT h.dst) AS deg FROM nodes x LEFT JOIN half h ON h.src = x.id GROUP BY x.id"


@_query("degree", "gup", _DEG)
def _degree(g: Graph) -> DataFrame:
    return g.degrees


@_query("degree_histogram", "gps", f"SELECT deg, count(*) AS n FROM ({_DEG}) d GROUP BY deg")
def _histogram(g: Graph) -> DataFrame:
    return g.degree_histogram()


@_query("min_degree_nodes", "gps", f"SELECT id, deg FROM ({_DEG}) d WHERE deg >= 5")
def _min_degree(g: Graph) -> DataFrame:
    return g.nodes_with_min_degree(5)


@_query("rel_view", "gm", "SELECT src AS n1, dst AS n2, vu AS und, vs AS src_val, vt AS tgt_val FROM pair WHERE src <= dst")
def _rel(g: Graph) -> DataFrame:
    return g.rel().select("n1", "n2", F.col("v_und").alias("und"), F.col("v_src").alias("src_val"), F.col("v_tgt").alias("tgt_val"))


@_query("dup_edge_check", "gos", "SELECT n1, n2, slot, count(*) AS count FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE n1 % 10 = 0) t GROUP BY n1, n2, slot HAVING count(*) > 1")
def _dups(g: Graph) -> DataFrame:
    return Graph(g.kind, g.nodes, g.edges.unionByName(g.edges.where("n1 % 10 = 0"))).duplicate_edges()


@_query("missing_endpoint_check", "gos", "SELECT n1, n2, slot FROM edges WHERE n1 % 10 = 0")
def _missing(g: Graph) -> DataFrame:
    return Graph(g.kind, g.nodes.where("id >= 1000000000 OR id % 10 <> 0"), g.edges).missing_endpoints()


@_query("set_value", "gos", "SELECT id, CASE WHEN id = 1000000002 THEN 'changed' ELSE label END AS label FROM nodes")
def _set(g: Graph) -> DataFrame:
    return g.set_value(1_000_000_002, F.struct(F.col("val.kind").alias("kind"), F.lit("changed").alias("label"))).nodes.select("id", "val.label")


# Modification


def _plain(g: Graph) -> Graph:
    """Without values."""
    return Graph(g.kind, g.nodes.select("id"), g.edges.select("n1", "n2", "slot"))


@_query("modify_add_edges", "gn", "SELECT n1, n2, slot FROM edges UNION ALL SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), 'UND' FROM (VALUES (0, 1), (3, 25)) v(a, b)")
def _add(g: Graph) -> DataFrame:
    return modify(_plain(g), X(0) ^ X(1), X(3) ^ N(0))[0].edges


@_query("modify_remove_nodes_cascade", "gn", "SELECT n1, n2, slot FROM edges WHERE n1 NOT IN (0, 8) AND n2 NOT IN (0, 8)")
def _cascade(g: Graph) -> DataFrame:
    return modify(_plain(g), ~X(0), ~X(8))[0].edges


@_query("modify_swap_vals", "ge", "SELECT n1, n2, slot, CASE WHEN n1 = 0 AND n2 = 1 AND slot = 'SRC' THEN -1 ELSE val END AS val FROM edges WHERE NOT (n1 = 2 AND n2 = 3 AND slot = 'TGT')")
def _swap(g: Graph) -> DataFrame:
    return modify(Graph(g.kind, g.nodes, g.edges), X(0) & e().val(-1) >> X(1), X(3) & (~e() >> X(2)))[0].edges


@_query("modify_swap_node", "ge", "SELECT id, CASE WHEN id = 2 THEN 'other' ELSE name END AS name FROM nodes")
def _swap_node(g: Graph) -> DataFrame:
    named = Graph(g.kind, g.nodes.select("id", F.col("val.name").alias("val")), g.edges)
    return modify(named, X(2).val("other"))[0].nodes.withColumnRenamed("val", "name")


@_query("modify_new_ids", "gn", "SELECT CAST(a AS BIGINT) AS id FROM (VALUES (3), (4), (25), (26)) v(a)")
def _new_ids(g: Graph) -> DataFrame:
    return free_ids(Graph(g.kind, g.nodes.where("id NOT IN (3, 4)"), g.edges), 4).select("id")


@_query("change_feed", "gn", "SELECT kind, id, n1, n2, slot FROM (SELECT 'edge_removed' AS kind, CAST(NULL AS BIGINT) AS id, n1, n2, slot FROM edges WHERE n1 = 0 OR n2 = 0 UNION ALL SELECT 'node_removed', 0, NULL, NULL, NULL UNION ALL SELECT 'node_added', 25, NULL, NULL, NULL UNION ALL SELECT 'edge_added', NULL, 1, 25, 'UND') t")
def _feed(g: Graph) -> DataFrame:
    return modify(_plain(g), ~X(0), X(1) ^ N(7))[1].changes().drop("seq")


@_query(
    "rewrite_all",
    "gos",
    "SELECT n1, n2, slot FROM edges UNION ALL SELECT n1, n2, 'TGT' FROM edges WHERE val >= 50",
)
def _rewrite(g: Graph) -> DataFrame:
    found = search(g, get(MONO, N(0) & E().test(lambda v: v >= 50) >> N(1))).matches()
    return rewrite(_plain(g), found, translated(0), translated(1), t(1) >> t(0), mode="all")[0].edges


@_query("rewrite_new_nodes", "gos", "SELECT count(*) AS nodes, (SELECT count(*) FROM edges) + 2 * (SELECT count(*) FROM edges WHERE val >= 50) AS edges FROM (SELECT id FROM nodes UNION ALL SELECT n1 FROM edges WHERE val >= 50) t")
def _rewrite_nodes(g: Graph) -> DataFrame:
    found = search(g, get(MONO, N(0) & E().test(lambda v: v >= 50) >> N(1))).matches()
    out = rewrite(_plain(g), found, translated(0) >> (N(0) >> translated(1)), mode="all")[0]
    return out.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(out.edges.agg(F.count("*").alias("edges"))))


@_query("persist_roundtrip", "gos", "SELECT n1, n2, slot, val FROM edges")
def _persist(g: Graph) -> DataFrame:
    path = f"{shared_folder(g.spark)}/weft-graph/snapshot-{uuid.uuid4().hex}"
    save(g, path)
    read_header(g.spark, path)
    return load(g.spark, path, Kind.DIR).edges


@_query("rewrite_disjoint", "gop", "SELECT true AS apart, true AS maximal, true AS applied")
def _disjoint(g: Graph) -> DataFrame:
    """Chosen matches share no node, every other match touches one, and each is applied once."""
    found = search(g, get(MONO, N(0) >> N(1))).matches()
    chosen = disjoint(found, found.columns)
    ends = chosen.select(F.explode(F.array("n0", "n1")).alias("id"))
    apart = ends.groupBy("id").count().where("count > 1").isEmpty()
    touched = ends.distinct()
    loose = found.join(touched, found["n0"] == touched["id"], "left_anti").join(touched, found["n1"] == touched["id"], "left_anti")
    plain = _plain(g)
    new, _ = rewrite(plain, found, translated(0), translated(1), t(1) >> t(0))
    applied = new.edge_count() == plain.edge_count() + chosen.count()
    return g.spark.sql(f"SELECT {apart} AS apart, {loose.isEmpty()} AS maximal, {applied} AS applied")


# Graphs: further ways in and out


@_query("graph_from_count", "gn", "SELECT id, count(h.dst) AS deg FROM (SELECT id FROM nodes UNION ALL SELECT CAST(a AS BIGINT) FROM (VALUES (25), (26)) v(a)) x LEFT JOIN half h ON h.src = x.id GROUP BY id")
def _from_count(g: Graph) -> DataFrame:
    return Graph.from_count(Kind.UNDIR, 27, g.edges).degrees


@_query("graph_from_ids", "gn", "SELECT id FROM nodes")
def _from_ids(g: Graph) -> DataFrame:
    return Graph.from_frames(Kind.UNDIR, g.nodes.select("id"), g.edges, check=True).nodes


@_query("literal_ids", None, "SELECT CAST(a AS BIGINT) AS n1, CAST(b AS BIGINT) AS n2, s AS slot FROM (VALUES (0, 1, 'TGT'), (1, 2, 'SRC'), (0, 2, 'SRC')) v(a, b, s)")
def _literal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a name take the smallest free ids."""
    return graph(spark, Kind.DIR, N(1) >> N_(), n(1) >> N_(), n(0) >> n(2)).edges


@_query("read_header", "gos", "SELECT 'DIR' AS kind, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _header(g: Graph) -> DataFrame:
    path = f"{shared_folder(g.spark)}/weft-graph/snapshot-{uuid.uuid4().hex}"
    save(g, path)
    head = read_header(g.spark, path)
    return g.spark.sql(f"SELECT '{head['kind']}' AS kind, {head['node_count']}L AS nodes, {head['edge_count']}L AS edges")


@_query("dot_pattern", None, "SELECT 3 AS named, 2 AS arrows")
def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = to_dot(parse("get(Mono) { N(0) >> N(1), n(1) >> N(2) }"))
    return spark.sql(f"SELECT {sum(f'n{k}' in text for k in range(3))} AS named, {text.count('->')} AS arrows")


@_query("edge_lookup", "gm", "SELECT n1, n2, slot, val FROM edges WHERE n1 = 0 AND n2 = 5 AND slot = 'SRC'")
def _edge_lookup(g: Graph) -> DataFrame:
    return g.get_edge(5, 0, "TGT")


@_query("membership", "gn", "SELECT EXISTS (SELECT 1 FROM nodes WHERE id = 7) AS node, EXISTS (SELECT 1 FROM nodes WHERE id = 99) AS no_node, EXISTS (SELECT 1 FROM edges WHERE n1 = 0 AND n2 = 5) AS edge, EXISTS (SELECT 1 FROM pair WHERE src = 5 AND dst = 0) AS adjacent, EXISTS (SELECT 1 FROM pair WHERE src = 0 AND dst = 1) AS apart")
def _membership(g: Graph) -> DataFrame:
    return g.spark.sql(f"SELECT {g.has(7)} AS node, {g.has(99)} AS no_node, {g.has_edge(5, 0, 'UND')} AS edge, {g.is_adjacent(0, 5)} AS adjacent, {g.has_edge(0, 1)} AS apart")


@_query("set_edge_value", "gm", "SELECT n1, n2, slot, CASE WHEN n1 = 0 AND n2 = 5 AND slot = 'UND' THEN 77 ELSE val END AS val FROM edges")
def _set_edge(g: Graph) -> DataFrame:
    return g.set_edge_value(5, 0, "UND", F.lit(77)).edges


@_query("set_rel", "gm", "SELECT n1, n2, slot, val FROM edges WHERE NOT (n1 = 0 AND n2 = 5 AND slot IN ('UND', 'SRC')) UNION ALL SELECT 0, 5, 'SRC', 9")
def _set_rel(g: Graph) -> DataFrame:
    return g.set_rel(5, 0, {"UND": None, "TGT": 9}).edges


@_query("degree_after_change", "gn", "SELECT x.id, count(DISTINCT h.dst) AS deg FROM nodes x LEFT JOIN (SELECT src, dst FROM half WHERE 0 NOT IN (src, dst) UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 1) h ON h.src = x.id WHERE x.id <> 0 GROUP BY x.id")
def _degree_after(g: Graph) -> DataFrame:
    return modify(_plain(g), ~X(0), X(1) ^ X(2))[0].degrees


for _tier in ("raw", "pair", "values"):

    @_query(f"tier_{_tier}", "gn", "SELECT a.src AS n0, a.dst AS n1 FROM pair a JOIN nodes x ON x.id = a.src WHERE x.region = 2")
    def _tiered(g: Graph, tier: str = _tier) -> DataFrame:
        return search(g.index(tier), get(MONO, N(0).test(lambda v: v["region"] == 2) ^ N(1))).matches()


# Patterns and sessions: what they tell of themselves


@_query("instantiated_edges", "gm", "SELECT a.src AS n0, a.dst AS n1, z.* FROM pair a, (VALUES (0, 1, 'SRC'), (0, 1, 'ANY')) z(a, b, slot) WHERE a.s AND a.src <> a.dst")
def _instantiated(g: Graph) -> DataFrame:
    return search(g, *_ANY).instantiated_edges().drop("src", "dst")


@_query("query_introspection", "gm", "SELECT 3 AS nodes, 2 AS edges, 2 AS clusters, 4 AS first, false AS pinned, true AS contexts, 'raw' AS tier")
def _introspection(g: Graph) -> DataFrame:
    s = Search(g, [get(MONO, X(4) >> N(1)), get(HOMO, n(1) ^ N(2))]).bind({4: 0})
    q = Search(g, [get(MONO, X(4) >> N(1)), get(HOMO, n(1) ^ N(2))]).query
    return g.spark.sql(f"SELECT {q.node_count} AS nodes, {q.edge_count} AS edges, {q.cluster_count} AS clusters, {q.node_local_id(0)} AS first, {q.has_exist_nodes} AS pinned, {s.query.has_translated_nodes} AS contexts, '{s.indexed}' AS tier")


@_query("iterate", "gn", "SELECT count(*) AS n FROM pair WHERE src <> dst")
def _iterate(g: Graph) -> DataFrame:
    return g.spark.sql(f"SELECT {sum(1 for _ in search(g, get(MONO, N(0) ^ N(1))))}L AS n")


@_query("first_k", "gn", "SELECT 7 AS n, true AS matches")
def _first_k(g: Graph) -> DataFrame:
    rows = search(g, get(MONO, N(0) ^ N(1))).first(7)
    return rows.join(g.pair, (F.col("n0") == F.col("src")) & (F.col("n1") == F.col("dst"))).agg(F.count("*").cast("int").alias("n"), (F.count("*") > 0).alias("matches"))


@_query("explain_match", "gn", "SELECT * FROM (VALUES ('bind n0', true), ('bind n1', true), ('ban 0 fired', true), ('ban 0 passed', false), ('match', false)) v(step, there)")
def _explain(g: Graph) -> DataFrame:
    told = search(g, get(MONO, N(1) ^ N(0)), ban(MONO, n(0) ^ N(2))).explain_match({0: 0, 1: 5})
    return g.spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v})" for k, v in told.items()) + " t(step, there)")


@_query("ban_verdicts", "gm", "SELECT src AS n0, dst AS n1, 0 AS ban, CASE WHEN NOT s THEN 'SHARED_EDGE_FAIL' WHEN EXISTS (SELECT 1 FROM pair b WHERE b.src = pair.dst AND b.t AND b.dst <> pair.src) THEN 'FIRED' ELSE 'NO_CANDIDATE' END AS verdict FROM pair WHERE u AND src <> dst")
def _verdicts(g: Graph) -> DataFrame:
    return search(g, get(MONO, N(0) ^ N(1)), ban(MONO, n(0) >> n(1), n(1) << N(2))).ban_verdicts()


class _Log(Watcher):
    def __init__(self, stop_at: int | None = None):
        self.heard: dict[str, int] = {}
        self.stop_at = stop_at

    def _add(self, what: str) -> Control:
        self.heard[what] = self.heard.get(what, 0) + 1
        return Control.STOP if what == "match" and self.heard[what] == self.stop_at else Control.CONTINUE

    def on_change(self, kind, id, edge):
        self._add(kind)

    def on_bind(self, node, row):
        return self._add(f"bind {node}")

    def on_unbind(self, node, row):
        self._add("unbind")

    def on_edge_test(self, row):
        self._add("passed" if row["passed"] else "failed")

    def on_ban_verdict(self, ban, verdict, row):
        self._add(verdict.name)

    def on_match(self, row):
        return self._add("match")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v}L)" for k, v in self.heard.items()) + " t(what, n)")


@_query(
    "watch_search",
    "gm",
    """SELECT * FROM (SELECT 'bind 0' AS what, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'bind 1', (SELECT count(*) FROM pair WHERE s AND src <> dst)
UNION ALL SELECT 'unbind', (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM pair WHERE s AND src <> dst))
UNION ALL SELECT 'passed', (SELECT count(*) FROM pair WHERE s) UNION ALL SELECT 'failed', (SELECT count(*) FROM pair WHERE NOT s)
UNION ALL SELECT 'SHARED_EDGE_FAIL', (SELECT count(*) FROM pair WHERE s AND NOT u) UNION ALL SELECT 'FIRED', (SELECT count(*) FROM pair WHERE s AND u)
UNION ALL SELECT 'match', (SELECT count(*) FROM pair WHERE s AND NOT u)) t WHERE n > 0""",
)
def _watch(g: Graph) -> DataFrame:
    log = _Log()
    watch_search(log, search(g, get(MONO, N(1) << N(0)), ban(MONO, n(0) ^ n(1))))
    return log.table(g.spark)


@_query("watch_stop", "gn", "SELECT 'match' AS what, 3 AS n")
def _stop(g: Graph) -> DataFrame:
    log = _Log(stop_at=3)
    watch_matches(log, search(g, get(MONO, N(0) ^ N(1))).matches())
    return log.table(g.spark).select("what", F.col("n").cast("int").alias("n"))


@_query("watch_silent", "gn", "SELECT count(*) AS n FROM pair WHERE src <> dst")
def _silent(g: Graph) -> DataFrame:
    return g.spark.sql(f"SELECT {watch_matches(Watcher(), search(g, get(MONO, N(0) ^ N(1))).matches())}L AS n")


@_query("watch_changes", "gn", "SELECT 'edge_removed' AS what, count(*) AS n FROM edges WHERE n1 = 0 OR n2 = 0 UNION ALL SELECT 'node_removed', 1 UNION ALL SELECT 'node_added', 1 UNION ALL SELECT 'edge_added', 1")
def _watch_changes(g: Graph) -> DataFrame:
    log = _Log()
    notify(log, modify(_plain(g), ~X(0), X(1) ^ N(7))[1])
    return log.table(g.spark)


@_query("mutation_batches", "gn", "SELECT CAST(2 AS BIGINT) AS version, count(*) + 1 AS edges, 2 AS told FROM edges WHERE n1 <> 3 AND n2 <> 3")
def _batches(g: Graph) -> DataFrame:
    """Two batches, the first of them sent twice, and a second stream that resumes."""
    path, told = f"{shared_folder(g.spark)}/weft-graph/stream-{uuid.uuid4().hex}", []
    one = g.spark.sql("SELECT 'add_edge' AS op, CAST(NULL AS BIGINT) AS id, 0L AS n1, 1L AS n2, 'UND' AS slot")
    two = g.spark.sql("SELECT 'remove_node' AS op, 3L AS id, CAST(NULL AS BIGINT) AS n1, CAST(NULL AS BIGINT) AS n2, CAST(NULL AS STRING) AS slot")
    stream = MutationStream(_plain(g), path)
    for batch, rows in ((0, one), (0, one), (1, two)):
        stream.apply(rows, batch, lambda k, graph, done: told.append(k))
    resumed = MutationStream(_plain(g), path)
    return g.spark.sql(f"SELECT {resumed.latest}L AS version, {resumed.snapshot().edge_count()}L AS edges, {len(told)} AS told")


# Modification: references and fragments as data


@_query("modify_new_ref", "gn", "SELECT n1, n2, slot FROM edges UNION ALL SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), 'UND' FROM (VALUES (0, 25), (25, 26), (0, 26)) v(a, b)")
def _new_ref(g: Graph) -> DataFrame:
    return modify(_plain(g), X(0) ^ (N(1) ^ N(2)), n(2) ^ x(0))[0].edges


@_query("modify_fragment", "gn", "SELECT n1, n2, slot FROM edges WHERE NOT (n1 = 0 AND n2 = 5) UNION ALL SELECT 0, 1, 'UND'")
def _fragment(g: Graph) -> DataFrame:
    """A fragment with nodes of a match, put in place by hand."""
    ops = [translated(0) & (~e() ^ t(1)), translated(1), t(0) ^ X(1)]
    return modify(_plain(g), *resolve_with_bindings(ops, {0: 0, 1: 5}))[0].edges


# Rules: what is refused, and with which error


def _refused(name: str, error: type, attempt: Callable[[Graph], object], fixture: str = "gn") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = "nothing"
        try:
            attempt(fixtures.load(spark, sf_dir, fixture))
        except (err.WeftError, TypeError) as raised:
            got = type(raised).__name__
        return spark.sql(f"SELECT '{name}' AS rule, '{got}' AS error")

    QUERIES[name] = run
    SQL[name] = f"SELECT '{name}' AS rule, '{error.__name__}' AS error"


def _of(*clusters) -> Callable[[Graph], object]:
    return lambda g: search(g, *clusters)


def _with(table: dict | list, *clusters) -> Callable[[Graph], object]:
    return lambda g: Search(g, clusters).bind(table)


def _change(*ops) -> Callable[[Graph], object]:
    return lambda g: modify(_plain(g), *ops)


for _name, _error, _attempt in (
    ("src_duplicate_node", err.DuplicateNode, lambda g: Graph.from_frames(g.kind, g.nodes.unionByName(g.nodes), g.edges, check=True)),
    ("src_duplicate_edge", err.DuplicateEdge, lambda g: Graph.from_frames(g.kind, g.nodes, g.edges.unionByName(g.edges), check=True)),
    ("src_missing_endpoint", err.MissingEndpoint, lambda g: Graph.from_frames(g.kind, g.nodes.where("id <> 3"), g.edges, check=True)),
    ("literal_duplicate_id", err.DuplicateLocalId, lambda g: graph(g.spark, Kind.UNDIR, N(0) ^ N(0))),
    ("literal_undefined_ref", err.UndefinedRef, lambda g: graph(g.spark, Kind.UNDIR, N(0) ^ n(1))),
    ("literal_duplicate_edge", err.DuplicateEdge, lambda g: search(graph(g.spark, Kind.UNDIR, N(0) ^ N(1), n(1) ^ n(0)), get(MONO, N(0)))),
    ("val_duplicate_id", err.PatternDuplicateId, _of(get(MONO, N(4) ^ (N(5) ^ N(4))))),
    ("val_undefined_ref", err.PatternUndefinedRef, _of(get(MONO, N(4) ^ n(6)))),
    ("val_context_only_in_ban", err.ContextOnlyInBan, _of(get(MONO, N(4)), ban(MONO, n(4) ^ X(5)))),
    ("val_duplicate_edge", err.PatternDuplicateEdge, _of(get(MONO, N(4) ^ N(5), n(5) ^ n(4)))),
    ("val_conflicting_predicate", err.ConflictingPredicate, _of(get(MONO, N(4) ^ N(5)), get(MONO, n(4) & (E().val(1) ^ n(5))))),
    ("val_iso_not_sole", err.IsoNotSole, _of(get(ISO, N(4)), get(HOMO, N(5)))),
    ("val_redundant_in_ban", err.RedundantInBan, _of(get(MONO, N(4) ^ (N(5) ^ N(6))), ban(MONO, n(5) ^ n(6)))),
    ("val_covered_by_induced", err.CoveredByGet, _of(get(SUBISO, N(4) ^ N(5), n(5) ^ N(6)), ban(MONO, n(6) ^ n(4)))),
    ("val_covered_by_slots", err.CoveredByGet, _of(get(MONO, N(4) ^ N(5)), ban(MONO, n(4) % n(5)))),
    ("val_contradictory", err.Contradictory, _of(get(MONO, N(4) ^ N(5), n(5) & (~E() ^ n(4))))),
    ("val_contradictory_any", err.Contradictory, _of(get(MONO, N(4) ^ N(5), n(5) & (~E() % n(4))))),
    ("val_subsumed", err.Subsumed, _of(get(HOMO, N(4) ^ N(5)), ban(HOMO, n(5) ^ N(6)))),
    ("val_context_in_session", err.BoundPatternInSession, _of(get(MONO, N(4) ^ X(5)))),
    ("val_target_missing", err.TargetMissing, _of(get(MONO, at(0, 99) ^ N(1)))),
    ("val_wrong_kind", TypeError, _of(get(MONO, N(4) >> N(5)))),
    ("dsl_negated_start", TypeError, lambda g: ~N(4) & (E() ^ N(5))),
    ("dsl_existing_edge_to_new", TypeError, lambda g: X(4) & (e() ^ N(5))),
    ("bind_not_found", err.BindNotFound, _with({9: 1}, get(MONO, X(4) ^ N(5)))),
    ("bind_duplicate", err.BindDuplicate, _with([(4, 1), (4, 2)], get(MONO, X(4) ^ N(5)))),
    ("bind_missing", err.BindMissing, _with({4: 1}, get(MONO, X(4) ^ X(5)))),
    ("bind_collision", err.BindCollision, _with({4: 1, 5: 1}, get(MONO, X(4) ^ X(5)))),
    ("bind_target_missing", err.TargetMissing, _with({4: 99}, get(MONO, X(4) ^ N(5)))),
    ("mod_duplicate_new", err.DuplicateNew, _change(N(1), N(1))),
    ("mod_undefined_new_ref", err.UndefinedNewRef, _change(X(0) ^ n(1))),
    ("mod_duplicate_exist", err.DuplicateExist, _change(X(0), X(0))),
    ("mod_remove_conflict", err.RemoveConflict, _change(~X(0), x(0) ^ X(1))),
    ("mod_duplicate_translated", err.DuplicateTranslated, _change(translated(0), translated(0))),
    ("mod_undefined_translated_ref", err.UndefinedTranslatedRef, _change(X(0) ^ t(1))),
    ("mod_translated_remove_conflict", err.TranslatedRemoveConflict, _change(~translated(0), t(0) ^ X(1))),
    ("mod_node_not_found", err.NodeNotFound, _change(X(99))),
    ("mod_edge_not_found", err.EdgeNotFound, _change(X(0) & (~e() ^ X(1)))),
    ("mod_edge_exists", err.EdgeExists, _change(X(0) ^ X(5))),
    ("mod_cascade_conflict", err.CascadeConflict, lambda g: check_delta(_plain(g), *_conflicting(_plain(g)))),
    ("mod_swap_conflict", err.SwapConflict, lambda g: modify(g, X(0) & (e().val(1) ^ X(5)), x(0) & (~e() ^ x(5)))),
    ("persist_other_kind", PersistFailure, lambda g: _reload(g, Kind.DIR)),
    ("parse_error", err.ParseError, lambda g: parse("get(Mono) { N(0) ^ }")),
):
    _refused(_name, _error, _attempt)


def _conflicting(g: Graph):
    """A batch that removes node 0 and, by key, an edge at it."""
    rows = g.spark.sql("SELECT 'remove_node' AS op, 0L AS id, CAST(NULL AS BIGINT) AS n1, CAST(NULL AS BIGINT) AS n2, CAST(NULL AS STRING) AS slot UNION ALL SELECT 'remove_edge', NULL, 0L, 5L, 'UND'")
    return batch_delta(g, rows)[:2]


def _reload(g: Graph, kind: Kind) -> Graph:
    path = f"{shared_folder(g.spark)}/weft-graph/snapshot-{uuid.uuid4().hex}"
    save(g, path)
    return load(g.spark, path, kind)
