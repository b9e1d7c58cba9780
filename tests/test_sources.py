"""Construction, lookups, snapshots, text patterns, drawings, and the driver's entry points."""

import io
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from weft import errors as err
from weft import fixtures
from weft.functions.pattern import E, N, N_, ban, get, n
from weft.model import SRC, UND, Kind, Morphism
from weft.operators.graph import Graph
from weft.operators.session import Search, search
from weft.sources import dot
from weft.sources.literal import graph
from weft.sources.parser import parse
from weft.sources.persist import PersistFailure, load, read_header, save
from weft.sources.store import shared_folder

U, D, A = Kind.UNDIR, Kind.DIR, Kind.ANYDIR


def test_meet():
    for a in Morphism:
        for b in Morphism:
            m = a.meet(b)
            assert m.injective == (a.injective or b.injective) and m.surjective == (a.surjective or b.surjective) and m.induced == (a.induced or b.induced)


def test_construction(spark):
    assert Graph.from_pairs(spark, U, [(2, 1)]).to_lists() == ([(1,), (2,)], [(1, 2, UND)])
    assert Graph.from_pairs(spark, D, [(2, 1, 5)], 3).to_lists() == ([(0,), (1,), (2,)], [(1, 2, "TGT", 5)])
    assert Graph.from_pairs(spark, U, [], [(4, "a"), (7, "b")]).to_lists()[0] == [(4, "a"), (7, "b")]
    for kind, pairs, nodes in ((err.DuplicateEdge, [(0, 1), (1, 0)], None), (err.MissingEndpoint, [(0, 9)], [0, 1]), (err.DuplicateNode, [], [1, 1])):
        with pytest.raises(kind):
            Graph.from_pairs(spark, U, pairs, nodes)


def test_literals(spark):
    assert graph(spark, U, N_() ^ N_() ^ N(1)).to_lists() == ([(0,), (1,), (2,)], [(0, 1, UND), (0, 2, UND)])
    assert graph(spark, U, N(0).val("a") & E().val(1.5) ^ (N(1).val("b") & E().val(2.0) ^ N(2).val("c")), node_type="string", edge_type="double").to_lists() == ([(0, "a"), (1, "b"), (2, "c")], [(0, 1, UND, 1.5), (1, 2, UND, 2.0)])
    assert graph(spark, D, N(0) >> n(0)).degrees.collect()[0]["deg"] == 1
    for kind, frags in ((err.DuplicateLocalId, [N(0), N(0)]), (err.UndefinedRef, [N(0) ^ n(5)]), (err.DuplicateEdge, [N(0) ^ N(1), n(1) ^ n(0)])):
        with pytest.raises(kind):
            graph(spark, U, *frags)
    for kind, frag in ((U, N(0) >> N(1)), (D, N(0) ^ N(1)), (D, N(0) & (E() ^ N(1))), (U, N(0) & E() << N(1))):
        with pytest.raises(TypeError):
            graph(spark, kind, frag)
    with pytest.raises(TypeError):
        graph(spark, U, N(0), node_type="int")


def test_lookups(spark):
    g = graph(spark, A, N(0) ^ N(1), n(0) >> n(1), n(1) >> n(0), N(2) >> n(2), N(3))
    assert g.node_count() == 4 and g.edge_count() == 4
    assert g.has(3) and not g.has(9) and g.has_edge(1, 0, SRC) and not g.has_edge(0, 3)
    assert g.is_adjacent(0, 1) and g.degree(0) == 1 and g.degree(2) == 1 and g.degree(3) == 0
    assert [r["id"] for r in g.neighbors(0).collect()] == [1]
    assert g.edges_between(1, 0).count() == 3
    assert tuple(g.rel(1, 0).first())[:3] == (0, 1, 3)
    assert {r["deg"]: r["n"] for r in g.degree_histogram().collect()} == {0: 1, 1: 3}
    v = graph(spark, U, N(0).val(1) & E().val(5) ^ N(1).val(2), node_type="int", edge_type="int")
    assert v.set_value(1, F.col("val") * 10).to_lists()[0] == [(0, 1), (1, 20)]
    assert v.set_edge_value(1, 0, UND, F.lit(8)).to_lists()[1] == [(0, 1, UND, 8)]
    assert v.get_edge(1, 0, UND).first()["val"] == 5


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "g")
    g = graph(spark, D, N(0).val("a") >> N(1).val("b"), node_type="string")
    save(g, path)
    assert read_header(spark, path)["node_count"] == 2
    assert load(spark, path, D).to_lists() == g.to_lists()
    with pytest.raises(err.PersistError):
        load(spark, path, U)
    with pytest.raises(err.PersistError):
        load(spark, path, node_schema=T.StructType().add("id", "long").add("val", T.IntegerType()))
    with pytest.raises(err.PersistError):
        load(spark, str(tmp_path / "none"))


def test_text_and_dot(spark, monkeypatch, capsys):
    text = "get(Mono) { N(0) ^ (N(1) ^ !N_()), n(1) & !E() ^ N(2) } // note\nban(Morphism::Homo) { n(0) ^ N(3) }"
    got = parse(text)
    assert [(c.decision, c.morphism) for c in got] == [("get", Morphism.MONO), ("ban", Morphism.HOMO)]
    assert got[0].nodes[1].links[0].edge.negated and got[0].nodes[0].links[0].node.links[0].node.negated
    drawn = dot.to_dot(got)
    assert drawn.count("->") == 4 and "style=dashed" in drawn
    for bad in ("get(Nope) {}", "get(Mono) { N(0) ^ }", "get(Mono) { Q(1) }", "get(Mono) { N(0) # }"):
        with pytest.raises(err.ParseError):
            parse(bad)
    monkeypatch.setattr(sys, "stdin", io.StringIO(text))
    assert dot.main() == 0 and capsys.readouterr().out == drawn
    monkeypatch.setattr(sys, "stdin", io.StringIO("nonsense"))
    assert dot.main() == 1


def test_entry_points():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and "mono_triangle" in sql


def test_lineitem_graphs_are_whole(spark, tmp_path):
    """Every line item is in each of the three graphs made from them."""
    lines = [(o, s, p, q, d, f) for k, (o, s, q, d, f) in enumerate([(1, 1, 50.0, 0.1, "R"), (1, 2, 3.0, 0.0, "N"), (2, 2, 44.0, 0.08, "R"), (2, 2, 45.0, 0.09, "A"), (3, 1, 1.0, 0.05, "A")]) for p in [k % 3]]
    frames = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_returnflag string"),
        "orders": spark.createDataFrame([(1, 7, "1-URGENT"), (2, 7, "2-HIGH"), (3, 8, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {name: sorted(map(tuple, fixtures._frame(spark, str(tmp_path), f"{name}_edges").select("n1", "n2", "val").collect())) for name in ("gos", "gop", "gps")}
    s, p = 1000000000, 2000000000
    assert got["gos"] == [(1, s + 1, 50.0), (1, s + 2, 3.0), (2, s + 2, 89.0), (3, s + 1, 1.0)]
    assert got["gop"] == [(1, 2 * s, 50.0), (1, 2 * s + 1, 3.0), (2, 2 * s, 45.0), (2, 2 * s + 2, 44.0), (3, 2 * s + 1, 1.0)]
    assert got["gps"] == [(s + 1, p, 1), (s + 1, p + 1, 1), (s + 2, p, 1), (s + 2, p + 1, 1), (s + 2, p + 2, 1)]


def test_snapshots_of_a_run_that_died(spark, tmp_path):
    """What has no manifest is written over; what has one is not."""
    g = Graph.from_pairs(spark, Kind.UNDIR, [(0, 1), (1, 2)])
    path = f"file:{tmp_path}/snap"
    g.nodes.write.parquet(f"{path}/nodes")
    save(g, path)
    assert load(spark, path).edge_count() == 2
    with pytest.raises(PersistFailure):
        save(g, path)


def test_shared_folder_on_a_cluster():
    class Context:
        applicationId = "a"

        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getConf(self):
            return {"spark.checkpoint.dir": self.folder}

    class Session:
        def __init__(self, *args):
            self.sparkContext = Context(*args)

    assert shared_folder(Session("local[8]")).startswith("file:")
    assert shared_folder(Session("spark://m:7077", "hdfs://n/c/")) == "hdfs://n/c"
    for master in ("spark://m:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            shared_folder(Session(master))
