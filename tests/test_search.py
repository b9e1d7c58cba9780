"""Counts on small literal graphs, and random graphs against brute force."""

import itertools
import random

import pytest

from weft import errors as err
from weft.functions.pattern import E, N, N_, X, ban, get, n
from weft.model import Kind, Morphism
from weft.operators.graph import Graph
from weft.operators.session import Search, search
from weft.sources.literal import graph

ISO, SUBISO, MONO, HOMO, EPI, EPIMONO = Morphism.ISO, Morphism.SUBISO, Morphism.MONO, Morphism.HOMO, Morphism.EPI, Morphism.EPIMONO
U, D, A = Kind.UNDIR, Kind.DIR, Kind.ANYDIR


def undirected(spark, *pairs, n_nodes=None):
    return Graph.from_pairs(spark, U, pairs, n_nodes)


def mixed(spark, nodes, directed, undirected):
    frags = [N(i) for i in nodes] + [n(a) >> n(b) for a, b in directed] + [n(a) ^ n(b) for a, b in undirected]
    return graph(spark, A, *frags)


EDGE, PATH3, PATH4, TRIANGLE = [(0, 1)], [(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (0, 2)]
#: A triangle with a tail of two edges, a ring of five, and a hub with four spokes.
KITE, RING, HUB = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)], [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], [(0, 1), (0, 2), (0, 3), (0, 4)]


@pytest.mark.parametrize(
    "target,clusters,count",
    [
        (KITE, [get(MONO, N(5) ^ (N(6) ^ (N(7) ^ n(5))))], 6),
        (KITE, [get(SUBISO, N(5) ^ (N(6) ^ N(7)))], 6),
        (KITE, [get(MONO, N(5) ^ (N(6) ^ N(7)))], 12),
        (KITE, [get(HOMO, N(5) ^ (N(6) ^ N(7)))], 22),
        (RING, [get(ISO, N(1) ^ (N(2) ^ (N(3) ^ (N(4) ^ (N(5) ^ n(1))))))], 10),
        (RING, [get(EPIMONO, N(1) ^ (N(2) ^ (N(3) ^ (N(4) ^ N(5)))))], 10),
        (RING, [get(MONO, N(1) ^ N(2)), ban(MONO, n(1) ^ N(3), n(2) ^ n(3))], 10),
        (KITE, [get(MONO, N(1) ^ N(2)), ban(MONO, n(1) ^ N(3), n(2) ^ n(3))], 4),
        (KITE, [get(MONO, N(1) ^ (N(2) ^ N(3))), ban(MONO, n(3) ^ n(1))], 6),
        (HUB, [get(MONO, N(3) ^ ~N_())], 0),
        (HUB, [get(MONO, N(3) ^ N(4) ^ ~N_())], 4),
        (HUB, [get(MONO, N(3) ^ N(4) ^ N(5) ^ N(6) ^ N(7) ^ ~N_())], 24),
        (HUB, [get(SUBISO, N(3) ^ N(4) ^ N(5))], 12),
        (HUB, [get(MONO, N(3) ^ (N(4) ^ N(5))), get(HOMO, n(4) ^ N(6))], 48),
    ],
)
def test_undirected_counts(spark, target, clusters, count):
    assert search(undirected(spark, *target), *clusters).count() == count


def test_isolated_nodes(spark):
    g = undirected(spark, (0, 1), n_nodes=3)
    assert search(g, get(EPI, N(0) ^ N(1))).count() == 0
    assert search(g, get(SUBISO, N(0) ^ N(1)), ban(SUBISO, ~N_())).count() == 0


def test_directed_and_any_direction(spark):
    arc = Graph.from_pairs(spark, D, EDGE)
    assert search(arc, get(MONO, N(0) >> N(1))).count() == 1
    assert search(arc, get(MONO, N(0) % N(1))).count() == 2
    assert search(arc, get(MONO, N(0) >> N(1)), ban(MONO, n(0) << n(1))).count() == 1
    assert search(mixed(spark, range(3), [(0, 1)], [(1, 2)]), get(MONO, N(0) >> N(1), n(1) ^ N(2))).count() == 1
    assert search(mixed(spark, range(3), [(0, 1)], [(1, 2)]), get(MONO, N(0) % N(1))).count() == 4
    assert search(mixed(spark, range(4), [(0, 1), (1, 0)], []), get(MONO, N(0), N(1)), ban(SUBISO, n(0) % n(1))).count() == 12
    assert search(mixed(spark, range(3), [(0, 1)], []), get(MONO, N(0), N(1)), ban(SUBISO, n(0) % n(1))).count() == 4
    clusters = [get(MONO, N(0) >> N(1), N(2)), ban(SUBISO, n(0) % n(1), n(2))]
    assert search(mixed(spark, range(3), [(0, 1), (1, 0), (0, 2)], []), *clusters).count() == 3
    assert search(mixed(spark, range(3), [(0, 1), (1, 0)], []), *clusters).count() == 0
    assert search(mixed(spark, range(2), [(0, 1), (1, 0)], []), get(SUBISO, N(0) % N(1))).count() == 0


def test_values(spark):
    g = graph(spark, U, N(0).val(1) ^ N(1).val(42), node_type="int")
    got = search(g, get(MONO, N(0) & (~E() ^ ~N_().val(42)))).matches().collect()
    assert [r["n0"] for r in got] == [1]
    g = graph(spark, U, N(0).val(42) ^ N(1).val(42), node_type="int")
    assert search(g, get(MONO, N(0) & (~E() ^ ~N_().val(42)))).count() == 0
    g = graph(spark, U, N(0).val(10) ^ N(1).val(20), node_type="int")
    assert search(g, get(MONO, ~N_().val(10))).count() == 0
    assert search(g, get(MONO, ~N_().val(99))).count() == 1
    assert search(g, get(MONO, N(0).test(lambda v: v > 15))).count() == 1
    g = graph(spark, D, N(0) & E().val(10) >> (N(1) & E().val(20) >> N(2)), edge_type="int")
    assert search(g, get(MONO, N(0) & E().val(20) >> N(1))).count() == 1
    assert search(g, get(MONO, N(0) & E().test("val > 5") % N(1))).count() == 4
    assert search(g, get(MONO, N(0) >> N(1), N(2), n(1) & (~E().val(20) >> n(2)))).count() == 1


def test_errors(spark):
    g = undirected(spark, *TRIANGLE)
    cases = [
        (err.PatternDuplicateId, [get(MONO, N(0) ^ N(0))]),
        (err.PatternUndefinedRef, [get(MONO, N(0) ^ n(1))]),
        (err.ContextOnlyInBan, [get(MONO, N(0)), ban(MONO, n(0) ^ X(1))]),
        (err.PatternDuplicateEdge, [get(MONO, N(0) ^ N(1), n(0) ^ n(1))]),
        (err.ConflictingPredicate, [get(MONO, N(0) ^ N(1)), get(MONO, n(0) & (E().test("true") ^ n(1)))]),
        (err.IsoNotSole, [get(ISO, N(0)), get(MONO, N(1))]),
        (err.RedundantInBan, [get(MONO, N(0) ^ N(1)), ban(MONO, n(0) ^ n(1))]),
        (err.CoveredByGet, [get(SUBISO, N(0) ^ (N(1) ^ N(2))), ban(MONO, n(0) ^ n(2))]),
        (err.Contradictory, [get(MONO, N(0) ^ N(1), n(0) & (~E() ^ n(1)))]),
        (err.Subsumed, [get(MONO, N(0) ^ N(1)), ban(HOMO, n(0) ^ N(2))]),
        (err.BoundPatternInSession, [get(MONO, X(0) ^ N(1))]),
    ]
    for kind, clusters in cases:
        with pytest.raises(kind):
            search(g, *clusters)
    with pytest.raises(TypeError):
        search(g, get(MONO, N(0) >> N(1)))
    with pytest.raises(TypeError):
        ~N(0) & (E() ^ N(1))


def test_bindings(spark):
    g = undirected(spark, *PATH4)
    s = Search(g, [get(MONO, X(0) ^ N(1))])
    assert s.bind({0: 1}).count() == 2
    for kind, table in ((err.BindNotFound, {5: 1}), (err.BindMissing, {})):
        with pytest.raises(kind):
            Search(g, [get(MONO, X(0) ^ N(1))]).bind(table)
    with pytest.raises(err.BindCollision):
        Search(g, [get(MONO, X(0) ^ X(1))]).bind({0: 1, 1: 1})
    # A pattern can be bound again and again, and ids that the graph lacks are refused.
    assert [s.bind({0: k}).count() for k in (0, 2, 1)] == [1, 2, 2]
    with pytest.raises(err.TargetMissing):
        s.bind({0: 77})
    many = spark.createDataFrame([(0, "a"), (1, "b")], "n0 long, who string")
    assert Search(g, [get(MONO, X(0) ^ N(1))]).bind_all(many).groupBy("who").count().orderBy("who").collect() == [("a", 1), ("b", 2)]


def test_results(spark):
    g = mixed(spark, range(3), [(0, 1), (1, 0)], [(0, 1), (1, 2)])
    s = search(g, get(MONO, N(0) >> N(1), n(0) % n(1)))
    assert s.count() == 2
    assert s.matched_edges().count() == 2 * (1 + 3)
    assert s.matched_edges(unclaimed=True).count() == 2 * (1 + 2)
    assert s.adjacents(0).count() == 4
    # The order starts at node 1, the last of the largest degrees.
    assert [tuple(r) for r in search(undirected(spark, *PATH3), get(MONO, N(0) ^ N(1))).ordered(2).collect()] == [(1, 0), (0, 1)]
    assert s.explain_match({0: 0, 1: 1})["match"]
    assert not s.explain_match({0: 2, 1: 1})["match"]


# Brute force


def brute(kind, nodes, edges, pattern, morphism, negated=(), bans=()):
    """Mappings of a pattern {edges (a, b, slot)} by trying all of them; slots are seen from a."""
    held = {}
    for a, b, s in edges:
        held.setdefault((a, b), set()).add(s)
        held.setdefault((b, a), set()).add({"SRC": "TGT", "TGT": "SRC"}.get(s, s))
    deg = {v: len({b for (a, b) in held if a == v}) for v in nodes}
    names = sorted({x for a, b, _ in pattern for x in (a, b)})
    found = set()

    def ok(m, a, b, s):
        slots = held.get((m[a], m[b]), set())
        return bool(slots) if s == "ANY" else s in slots

    for image in itertools.product(nodes, repeat=len(names)):
        m = dict(zip(names, image, strict=True))
        if morphism.injective and len(set(image)) < len(image):
            continue
        if morphism.surjective and set(image) != set(nodes):
            continue
        if morphism is ISO and len(nodes) != len(names):
            continue
        if not all(ok(m, *e) for e in pattern) or any(ok(m, *e) for e in negated):
            continue
        if morphism.induced:
            good = True
            for p, q in itertools.combinations(names, 2):
                k = sum({a, b} == {p, q} for a, b, _ in pattern)
                good &= len(held.get((m[p], m[q]), ())) == k
            if not good:
                continue
        if morphism is ISO and any(deg[m[p]] != len({x for a, b, _ in pattern if p in (a, b) for x in (a, b)} - {p}) for p in names):
            continue
        fired = False
        for q, s, inj in bans:  # a further node behind q
            fired |= any(s in held.get((m[q], v), set()) or (s == "ANY" and held.get((m[q], v))) for v in nodes if not (inj and v in image))
        if not fired:
            found.add(image)
    return found


def random_edges(rng, kind, size, count):
    out = set()
    while len(out) < count:
        a, b = sorted(rng.sample(range(size), 2))
        out.add((a, b, rng.choice(kind.slots)))
    return sorted(out)


OPS = {"UND": lambda a, b: a ^ b, "SRC": lambda a, b: a >> b, "TGT": lambda a, b: a << b, "ANY": lambda a, b: a % b}
NEG = {"UND": lambda a, b: a & (~E() ^ b), "SRC": lambda a, b: a & (~E() >> b), "TGT": lambda a, b: a & (~E() << b), "ANY": lambda a, b: a & (~E() % b)}


@pytest.mark.parametrize("kind", [U, D, A])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, kind, seed):
    rng = random.Random(seed)
    size = 6
    edges = random_edges(rng, kind, size, 9)
    g = Graph.from_frames(kind, spark.range(size), spark.createDataFrame(edges, "n1 long, n2 long, slot string")).index("pair")
    for morphism in Morphism:
        slots = [rng.choice((*kind.slots, "ANY")) for _ in range(3)]
        pattern = [(0, 1, slots[0]), (1, 2, slots[1])]
        frags = [N(0), N(1), N(2), *(OPS[s](n(a), n(b)) for a, b, s in pattern)]
        want = brute(kind, range(size), edges, pattern, morphism)
        assert {tuple(r) for r in search(g, get(morphism, *frags)).matches().collect()} == want
        if not morphism.induced:
            neg = [(0, 2, slots[2])]
            want = brute(kind, range(size), edges, pattern, morphism, neg)
            got = search(g, get(morphism, *frags, NEG[slots[2]](n(0), n(2)))).matches().collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
        inj = rng.random() < 0.5
        want = brute(kind, range(size), edges, pattern, morphism, (), [(2, slots[2], inj)])
        if inj or slots[2] == "ANY":
            got = search(g, get(morphism, *frags), ban(MONO if inj else HOMO, OPS[slots[2]](n(2), N(9)))).matches().collect()
            assert {tuple(r) for r in got} == want


# Mixed morphisms, negation and bans with several nodes of their own


def held_slots(edges):
    held = {}
    for a, b, s in edges:
        held.setdefault((a, b), set()).add(s)
        held.setdefault((b, a), set()).add({"SRC": "TGT", "TGT": "SRC"}.get(s, s))
    return held


def all_mappings(nodes, edges, order, gets, negated, bans):
    """``gets``: (morphism, edges) of each cluster over all of ``order``; a pair is ruled by the node that comes later in ``order``."""
    held = held_slots(edges)
    rule = {p: [m for m, es in gets if any(p in e[:2] for e in es)] for p in order}
    need = {p: len({x for _, es in gets for a, b, _ in es if p in (a, b) for x in (a, b)} - {p}) for p in order}
    deg = {v: len({b for a, b in held if a == v}) for v in nodes}
    out = set()
    for image in itertools.product(nodes, repeat=len(order)):
        m = dict(zip(order, image, strict=True))
        good = all(s in held.get((m[a], m[b]), ()) for _, es in gets for a, b, s in es)
        good = good and not any(s in held.get((m[a], m[b]), ()) for a, b, s in negated)
        for k, p in enumerate(order):
            injective, induced = any(x.injective for x in rule[p]), any(x.induced for x in rule[p])
            good = good and not (injective and deg[m[p]] < need[p])
            for q in order[:k]:
                good = good and not (injective and m[p] == m[q])
                if good and induced:
                    good = len(held.get((m[p], m[q]), ())) == sum({a, b} == {p, q} for _, es in gets for a, b, _ in es)
        if good and not any(fires(held, nodes, m, b) for b in bans):
            out.add(tuple(m[p] for p in sorted(order)))
    return out


def fires(held, nodes, m, b):
    morphism, own, edges = b
    for image in itertools.product(nodes, repeat=len(own)):
        if morphism.injective and (len(set(image)) < len(image) or set(image) & set(m.values())):
            continue
        full = m | dict(zip(own, image, strict=True))
        if all(s in held.get((full[a], full[c]), ()) for a, c, s in edges):
            return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_mixed_against_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    kind = (U, D, A)[seed % 3]
    size = 6
    edges = random_edges(rng, kind, size, 10)
    g = Graph.from_frames(kind, spark.range(size), spark.createDataFrame(edges, "n1 long, n2 long, slot string"))

    def slot():
        return rng.choice(kind.slots)

    one, two = rng.choice([MONO, HOMO, SUBISO]), rng.choice([MONO, HOMO])
    first, second = [(0, 1, slot())], [(1, 2, slot())]
    frags = [get(one, OPS[first[0][2]](N(0), N(1))), get(two, OPS[second[0][2]](n(1), N(2)))]
    negated = [(0, 2, slot())] if seed % 2 and not one.induced else []
    if negated:
        frags[1] = get(two, OPS[second[0][2]](n(1), N(2)), NEG[negated[0][2]](n(0), n(2)))
        negated_rule = negated
    else:
        negated_rule = []
    bans = []
    for k in range(3):
        morphism, a, b, s, z = rng.choice([MONO, HOMO]), rng.randrange(3), rng.randrange(3), slot(), slot()
        x, y = 10 + 2 * k, 11 + 2 * k
        if rng.random() < 0.5 and a != b:
            # One node of its own between two of the match.
            bans.append((morphism, [x], [(a, x, s), (b, x, z)]))
        else:
            # A way of two further nodes.
            bans.append((morphism, [x, y], [(a, x, s), (x, y, z)]))
        named = set()

        def end(i, named=named):
            out = N(i) if i >= 10 and i not in named else n(i)
            named.add(i)
            return out

        clusters = [OPS[q](end(c), end(d)) for c, d, q in bans[-1][2]]
        frags.append(ban(morphism, *clusters))
    try:
        s = search(g, *frags)
    except err.PatternError:
        pytest.skip("the pattern is refused")
    want = all_mappings(range(size), edges, s.query.order, [(one, first), (two, second)], negated_rule, bans)
    got = [tuple(r) for r in s.matches().collect()]
    assert set(got) == want and len(got) == len(want)


def test_sql_tests_name_val_alone(spark):
    """Quoted text, names that hold ``val`` and fields of that name stay as they are."""
    edges = spark.sql("SELECT 0L AS n1, 1L AS n2, 'UND' AS slot, named_struct('kind', 'interval', 'val', 3) AS val UNION ALL SELECT 1L, 2L, 'UND', named_struct('kind', 'val', 'val', 9)")
    g = Graph(U, spark.range(3), edges)
    assert search(g, get(MONO, N(0) & E().test("val.kind = 'interval'") ^ N(1))).count() == 2
    assert search(g, get(MONO, N(0) & E().test("val.kind = 'val' and val.val > 5") ^ N(1))).count() == 2
    assert search(g, get(MONO, N(0) & E().test("val.val > 5 or val.kind like '%val'") ^ N(1))).count() == 4


def test_chains_of_bans_stay_linear(spark):
    g = undirected(spark, *KITE)
    joins = []
    for k in range(1, 5):
        bans = [ban(MONO, n(1) ^ (N(10 + 2 * i) ^ N(11 + 2 * i))) for i in range(k)]
        plan = search(g, get(MONO, N(1) ^ N(2)), *bans).matches()._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join "))
    assert max(joins) <= joins[0] + 1


def two_sided(spark):
    """Orders 0-19 and parts 100-111, some pairs of orders with two parts in common; DIR and UNDIR."""
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(20), 100 + rng.randrange(12)) for _ in range(70)})
    return pairs, undirected(spark, *pairs), Graph.from_pairs(spark, D, pairs).stored()


def joins(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_matches_are_not_moved_to_be_closed(spark):
    """Pairs that must not be adjacent, rings and common neighbours come from the graph's triangles and rings."""
    pairs, u, d = two_sided(spark)
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set()).add(a)
    path = search(u, get(SUBISO, N(0) ^ (N(1) ^ N(2)))).matches()
    assert sorted(map(tuple, path.collect())) == sorted((a, b, c) for b in to for a in to[b] for c in to[b] if a != c)
    assert joins(path) == 1
    ring = search(u, get(MONO, N(0) ^ (N(1) ^ (N(2) ^ (N(3) ^ n(0)))))).matches()
    assert sorted(map(tuple, ring.collect())) == sorted((a, b, c, e) for a in to for b in to[a] for c in to[b] for e in to[c] if a in to[e] and a != c and b != e)
    assert joins(ring) == 0
    apart = search(d, get(MONO, N(0) >> N(1) >> N(2)), ban(MONO, n(1) << N(3), n(2) << n(3))).matches()
    assert sorted(map(tuple, apart.collect())) == sorted((a, b, c) for a in range(20) for b in to.get(a, ()) for c in to.get(a, ()) if b != c and len(to[b] & to[c]) == 1)
    assert joins(apart) == 2


@pytest.mark.parametrize("flip", [1, -1])
def test_triangles_and_rings_of_a_graph(spark, flip):
    rng = random.Random(9)
    # One end has most of the edges, so that rings are taken from either end of the ids.
    pairs = sorted({tuple(sorted((flip * rng.randrange(12), flip * rng.randrange(4)))) for _ in range(30)} | {(0, 0)})
    to = {x: {b for p in pairs for a, b in (p, p[::-1]) if a == x and b != x} for p in pairs for x in p}
    g = undirected(spark, *pairs)
    assert sorted(map(tuple, g.triangles.collect())) == sorted((a, b, c) for a in to for b in to[a] for c in to[b] if c in to[a])
    assert sorted(map(tuple, g.squares.collect())) == sorted((a, b, c, e) for a in to for b in to[a] for c in to[b] for e in to[c] if a in to[e] and a != c and b != e)
