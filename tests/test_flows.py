"""Walks counted by edges against walks taken one by one."""

import random

import numpy as np
import pytest
from graphs_for_tests import adj, complete

from subweave.operators import motif
from subweave.operators.motif import Flows, Walks
from subweave.plans.pattern import by_name


def arrays(edges):
    both = sorted({e for a, b in edges for e in ((a, b), (b, a))})
    src, dst = np.array(both).T
    return np.searchsorted(src, np.arange(src.max() + 2)), dst


@pytest.mark.parametrize("ordered", [True, False])
@pytest.mark.parametrize("few", [0, 500])
def test_same_weights_as_walks_one_by_one(ordered, few):
    rng = random.Random(3)
    # triangles, and a tail whose edges are in none
    edges = [(a, b) for a, b in complete(9) if rng.random() < 0.5] + [(8, 9), (9, 10)]
    p = by_name("q0") if ordered else by_name("q0").unordered()
    graph = arrays(edges)
    one, all_ = Walks(*graph, p, 0.1), Flows(*graph, p, 0.1)
    want = one.run(np.arange(one.n), 20_000, np.random.default_rng(1))
    got = all_.run_all(20_000, np.random.default_rng(2), few)
    assert ((got == 0) == (want == 0)).all()
    assert np.abs(got - want).max() < 0.03 * want.max()
    assert (got == got[all_.back]).all()


def test_no_triangles_and_many_walks():
    p = by_name("q0")
    assert not Flows(*arrays([(0, 1), (1, 2)]), p, 0.1).run_all(1000, np.random.default_rng(0), 0).any()
    # 2.4 billion walks, which one by one do not end in time
    got = Flows(*arrays(complete(4)), p, 0.1).run_all(600_000_000, np.random.default_rng(0))
    assert (np.abs(got / got.mean() - 1) < 1e-3).all()


def expected(flows, walks):
    """The expectation of what met() returns, from how often each vertex is visited."""
    x = np.zeros(flows.n)
    for _ in range(300):
        x = walks + (1 - flows.stop) * flows.pulled(x / flows.degree)
    vu, vw = np.divmod(flows.key, len(flows.at))
    u, v = flows.came[vu], flows.at[vu]
    over = (1 - flows.stop) ** 2 * x[u] / flows.degree[u] / flows.degree[v]
    one = sum(np.bincount(e, over, len(flows.at)) for e in (vu, vw, flows.uw))
    return flows.ways * (one + one[flows.reverse])


SHAPES = {
    "lonely edges": [(0, 1), (2, 3), (3, 4), (2, 4), (5, 6), (6, 7), (5, 7), (7, 8), (9, 10)],
    "star": [(0, i) for i in range(1, 40)] + [(1, 2), (3, 4)],
    "ring": [(i, (i + k) % 60) for i in range(60) for k in (1, 2)],
    "tail": [*complete(6), *((i, i + 1) for i in range(5, 20))],
}


@pytest.mark.parametrize("name", SHAPES)
def test_lots_drawn_ahead_keep_the_expectation(name):
    flows = Flows(*arrays(SHAPES[name]), by_name("q0"), 0.1)
    want = expected(flows, 400_000)
    got = flows.met(400_000, np.random.default_rng(5), few=0)
    assert (np.abs(got - want) < 15 * np.sqrt(want)).all() and (got == got[flows.reverse]).all()


def test_too_many_lots_are_noticed(monkeypatch):
    """Lots for more walks than come leave places that owe; then all is done again."""
    flows, done = Flows(*arrays(SHAPES["ring"]), by_name("q0"), 0.1), []
    monkeypatch.setattr(motif, "MARGIN", -2.0)
    monkeypatch.setattr(Flows, "drawn", lambda self, pool, own, margin, drawn=Flows.drawn: drawn(self, pool, own, 6.0 if margin < -3 else margin))
    monkeypatch.setattr(Flows, "_rest", lambda self, *args, rest=Flows._rest: done.append(rest(self, *args)) or done[-1])
    got = flows.met(100_000, np.random.default_rng(5), few=0)
    assert done == [False, True]
    assert np.abs(got / expected(flows, 100_000) - 1).max() < 0.05


def test_parts_are_whole_components():
    edges = [(0, 9), (9, 4), (1, 2), (2, 7), (7, 1), (3, 5), (6, 8)]
    graph = arrays(edges)
    assert motif.labels(*graph).tolist() == [0, 1, 1, 3, 0, 3, 6, 1, 6, 0]
    for most, n in ((1, 4), (7, 3), (100, 1)):
        own = list(motif.parts(*graph, most))
        assert len(own) == n
        back = {(v[a], v[b]) for v, offsets, targets in own for a in range(len(v)) for b in targets[offsets[a] : offsets[a + 1]]}
        assert back == {e for a, b in edges for e in ((a, b), (b, a))}
    long = [(i, i + 1) for i in range(5000)]
    random.Random(1).shuffle(ids := list(range(5001)))
    assert not motif.labels(*arrays([(ids[a], ids[b]) for a, b in long])).any()


def test_parts_and_shares_give_the_same_rows(spark):
    """Many components as parts of their own, and all in one part of which tasks have shares."""
    edges = [(10 * k + a, 10 * k + b) for k in range(12) for a, b in [*complete(4), (3, 5)]]
    for most in (1, 1 << 20):
        got = {(r["src"], r["dst"]): r["w"] for r in motif._flows(adj(spark, edges), by_name("q0"), 3001, 0.1, 0, most).collect()}
        flows = Flows(*arrays([*complete(4), (3, 4)]), by_name("q0"), 0.1)
        want = {(a, b): w for a, b, w in zip(flows.at, flows.came, expected(flows, 3001), strict=True)}
        assert set(got) == {e for a, b in edges for e in ((a, b), (b, a))}
        for (a, b), w in got.items():
            assert abs(w - want.get((a % 10, b % 10), 0)) <= 0.1 * want.get((a % 10, b % 10), 0)


def test_sixty_times_the_table_is_sent(monkeypatch):
    """A graph of 35,242,800 edges is not walked by rows of single walks, which are 10,240 a vertex."""
    graph = type("Graph", (), {"count": lambda self: 35_242_800})()
    monkeypatch.setattr(motif, "_flows", lambda *args: "sent")
    assert motif.sampled_weights(graph, by_name("q0")) == "sent"
