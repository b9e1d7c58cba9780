"""Modification, rewriting, change feeds and streams."""

import random

import pytest
from pyspark.sql import functions as F

from weft import errors as err
from weft.functions.pattern import E, N, N_, T, X, e, get, n, t, x
from weft.model import SRC, TGT, Kind, Morphism
from weft.operators.graph import Graph
from weft.operators.modify import disjoint, free_ids, modify, resolve_with_bindings, rewrite
from weft.operators.session import search
from weft.sources.literal import graph
from weft.streaming.changes import Control, MutationStream, Watcher, notify, watch_matches

U, D, A = Kind.UNDIR, Kind.DIR, Kind.ANYDIR


def lists(g):
    return [r["id"] for r in g.nodes.orderBy("id").collect()], sorted(tuple(r)[:3] for r in g.edges.collect())


def test_batch(spark):
    g = graph(spark, D, N(0) & E().val(1) >> (N(1) & E().val(2) >> N(2)), edge_type="int")
    new, done = modify(g, X(0) & E().val(7) >> N(5), X(1) & (e().val(9) >> X(2)), N_() & E().val(3) >> n(5))
    assert lists(new) == ([0, 1, 2, 3, 4], [(0, 1, SRC), (0, 3, SRC), (1, 2, SRC), (3, 4, TGT)])
    assert {(r["n1"], r["n2"]): r["val"] for r in new.edges.collect()} == {(0, 1): 1, (1, 2): 9, (0, 3): 7, (3, 4): 3}
    assert [tuple(r) for r in done.swapped_edge_vals.collect()] == [(1, 2, SRC, 2)]
    assert lists(g)[0] == [0, 1, 2]
    gone, done = modify(new, ~X(1), X(0) & (~e() >> x(3)))
    assert lists(gone) == ([0, 2, 3, 4], [(3, 4, TGT)])
    assert done.removed_edges.count() == 3
    heard = []

    class Log(Watcher):
        def on_change(self, kind, id, edge):
            heard.append((kind, id if edge is None else edge))

        def on_match(self, row):
            return Control.STOP

    notify(Log(), done)
    assert heard[-1] == ("node_removed", 1) and len(heard) == 4
    assert watch_matches(Log(), search(new, get(Morphism.MONO, N(0) >> N(1))).matches()) == 1


def test_errors_leave_the_graph_alone(spark):
    g = Graph.from_pairs(spark, U, [(0, 1), (1, 2)])
    cases = [
        (err.DuplicateNew, [N(1), N(1)]),
        (err.UndefinedNewRef, [X(0) ^ n(4)]),
        (err.DuplicateExist, [X(0), X(0)]),
        (err.RemoveConflict, [~X(0), x(0) ^ x(2)]),
        (err.NodeNotFound, [X(9)]),
        (err.NodeNotFound, [x(9) ^ N(0)]),
        (err.EdgeNotFound, [X(0) & (~e() ^ X(2))]),
        (err.EdgeExists, [X(0) ^ X(1)]),
        (err.EdgeExists, [X(0) ^ X(2), x(2) ^ x(0)]),
        (err.DuplicateTranslated, [T(0), T(0)]),
        (err.UndefinedTranslatedRef, [t(0) ^ N(1)]),
        (err.TranslatedRemoveConflict, [~T(0), t(0) ^ N(1)]),
    ]
    for kind, ops in cases:
        with pytest.raises(kind):
            modify(g, *ops)
    with pytest.raises(TypeError):
        N(0) & (e() ^ X(1))
    with pytest.raises(TypeError):
        modify(g, X(0) >> X(2))
    assert lists(g) == ([0, 1, 2], [(0, 1, "UND"), (1, 2, "UND")])


def test_free_ids_are_the_smallest(spark):
    g = Graph.from_frames(U, spark.createDataFrame([(1,), (2,), (5,)], "id long"), spark.createDataFrame([], "n1 long, n2 long, slot string"))
    assert [tuple(r) for r in free_ids(g, 4).select("rank", "id").orderBy("rank").collect()] == [(0, 0), (1, 3), (2, 4), (3, 6)]


@pytest.mark.parametrize("kind", [U, A])
def test_random_batches_against_a_model(spark, kind):
    rng = random.Random(kind.name)
    g = Graph.from_frames(kind, spark.range(5), spark.createDataFrame([], "n1 long, n2 long, slot string"))
    nodes, edges = set(range(5)), set()
    for _ in range(4):
        ops, drop = [], rng.choice(sorted(nodes))
        for a in sorted(nodes - {drop}):
            b = rng.choice(sorted(nodes - {drop}))
            key = (min(a, b), max(a, b), "UND")
            if a != b and key not in edges and not any(key == k for k, _ in ops):
                ops.append((key, x(a) ^ x(b)))
        free = min(set(range(100)) - nodes)
        g, _ = modify(g, *[o for _, o in ops], ~X(drop), N_())
        edges = {k for k in edges | {k for k, _ in ops} if drop not in k[:2]}
        nodes = nodes - {drop} | {free}
        assert lists(g) == (sorted(nodes), sorted(edges))
        degrees = {v: len({w for k in edges if v in k[:2] for w in k[:2]} - {v}) for v in nodes}
        want = {}
        for d in degrees.values():
            want[d] = want.get(d, 0) + 1
        assert {r["deg"]: r["n"] for r in g.degree_histogram().collect()} == want
        g = Graph(kind, spark.createDataFrame(g.nodes.collect(), g.nodes.schema), spark.createDataFrame(g.edges.collect(), g.edges.schema))


def test_rewrite(spark):
    g = Graph.from_pairs(spark, U, [(0, 1), (1, 2), (2, 3), (3, 4)])
    found = search(g, get(Morphism.MONO, N(0) ^ (N(1) ^ N(2)))).matches()
    closed, done = rewrite(g, found, T(0) ^ T(2), T(1), mode="first")
    assert closed.edge_count() == 5 and done.added_edges.count() == 1
    apart, _ = rewrite(g, found, T(0) & (~e() ^ T(1)), T(2))
    used = 4 - apart.edge_count()
    assert used == 1
    split, done = rewrite(g, search(g, get(Morphism.MONO, N(0) ^ N(1))).matches().where("n0 < n1"), T(0) & (~e() ^ T(1)), t(0) ^ (N(7) ^ t(1)), mode="all")
    assert split.node_count() == 9 and split.edge_count() == 8
    assert sorted(r["id"] for r in done.new_node_ids.collect()) == [5, 6, 7, 8]
    bound = resolve_with_bindings([T(0) ^ t(0)], {0: 3})
    assert (bound[0].role, bound[0].id, bound[0].links[0].node.role) == ("X", 3, "x")


def test_stream(spark, tmp_path):
    g = Graph.from_frames(D, spark.range(3), spark.createDataFrame([(0, 1, SRC)], "n1 long, n2 long, slot string"))
    schema = "op string, id long, n1 long, n2 long, slot string"
    source = tmp_path / "ops"
    batches = [[("add_node", 3, None, None, None), ("add_edge", None, 1, 3, SRC)], [("remove_node", 0, None, None, None), ("add_edge", None, 2, 3, TGT)]]
    counts = []
    stream = MutationStream(g, str(tmp_path / "graph"))

    def standing(batch, snapshot, done):
        counts.append((batch, search(snapshot, get(Morphism.MONO, N(0) >> N(1))).count(), done.changes().count()))

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        q = stream.start(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "check"), standing, availableNow=True)
        q.awaitTermination()
        assert stream.latest == k + 1
    assert counts == [(0, 2, 2), (1, 2, 3)]
    stream.apply(spark.createDataFrame(batches[1], schema), 1)  # a batch that is run again changes nothing
    assert lists(stream.snapshot()) == ([1, 2, 3], [(1, 3, SRC), (2, 3, TGT)])
    assert stream.snapshot(0).edges.where(F.col("n1") == 0).count() == 1


def test_disjoint_runs_until_no_match_is_left(spark):
    """A long path whose hashes fall in one direction takes many rounds; rows that repeat are one match."""
    rows = [(k, k + 1) for k in range(60)]
    found = spark.createDataFrame(rows + rows[:5], "n0 long, n1 long")
    chosen = [tuple(r) for r in disjoint(found, ["n0", "n1"]).collect()]
    ends = [x for r in chosen for x in r]
    assert len(ends) == len(set(ends))
    assert all(set(r) & set(ends) for r in rows)


def test_stream_calls_back_again_after_a_failure_and_resumes(spark, tmp_path):
    g = Graph.from_pairs(spark, U, [(0, 1), (1, 2)])
    path, told = f"file:{tmp_path}/stream", []
    rows = spark.sql("SELECT 'add_edge' AS op, CAST(NULL AS BIGINT) AS id, 0L AS n1, 2L AS n2, 'UND' AS slot")

    def fails_once(k, graph, done):
        told.append((k, done.added_edges.count()))
        if len(told) == 1:
            raise RuntimeError("lost")

    stream = MutationStream(g, path)
    with pytest.raises(RuntimeError):
        stream.apply(rows, 0, fails_once)
    again = MutationStream(g, path)
    assert again.latest == 1
    again.apply(rows, 0, fails_once)
    again.apply(rows, 0, fails_once)
    assert told == [(0, 1), (0, 1)] and again.snapshot().edge_count() == 3
