"""Matching in blocks against brute force, with blocks and steps so small that all of their edges are met."""

import random

import duckdb
import pytest
from graphs_for_tests import adj, brute, complete

from subweave import queries
from subweave.operators import blocks, clean, match, motif, partition
from subweave.plans.pattern import CATALOGUE

PATTERNS = [p for p in CATALOGUE.values() if blocks.has_centre(p)]


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(11)
    # ids far apart, and a hub
    return [(a * 1000, b * 1000) for a, b in complete(12) if rng.random() < 0.45 or a == 3]


@pytest.fixture(scope="module")
def small(spark, edges):
    return adj(spark, edges)


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)


def blocks_of(small, p, k=1):
    """The blocks in this process, with steps of few rows."""
    import numpy as np

    rows = sorted((r.v, r.n) for r in clean.neighbours(small).collect())
    cuts = np.array([4000, 5000, 9000])
    for number in range(4):
        own = [(v, n) for v, n in rows if any(np.searchsorted(cuts, x, "right") == number for x in (v, *n))]
        yield blocks.Block(p, number, cuts, np.array([v for v, _ in own]), np.array([len(n) for _, n in own]), np.array([x for _, n in own for x in n]), k)


def test_all_but_no_pattern_have_centres():
    assert [p.name for p in CATALOGUE.values() if not blocks.has_centre(p)] == []


@pytest.mark.parametrize("p", PATTERNS, ids=lambda p: p.name)
def test_counts(small, edges, p, monkeypatch):
    monkeypatch.setattr(blocks, "STEP", 7)
    for own in (p, p.unordered()):
        want = len(brute(edges, own)) if p.n < 6 else match.count_lazily(small, own).first()["n"]
        assert sum(b.n_matches(False) for b in blocks_of(small, own)) == want
        assert sum(b.n_matches(True) for b in blocks_of(small, own)) == want


@pytest.mark.parametrize("name", ["q1_square", "q10_solar_square", "q4_house"])
def test_over_tasks(spark, small, edges, tiny, name):
    p = CATALOGUE[name]
    want = len(brute(edges, p))
    assert blocks.count(small, p).first()["n"] == blocks.count(small, p, closed=True).first()["n"] == want
    none = small.where("false")
    assert blocks.count(none, p).first()["n"] == 0


def test_blocks_shrink_until_their_neighbourhoods_fit(small, edges, tiny, monkeypatch):
    lists = clean.neighbours(small)
    few = len(blocks._cuts(lists))
    monkeypatch.setattr(blocks, "HELD", 40)
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 32)
    assert len(blocks._cuts(lists)) > few > 0
    p = CATALOGUE["q1_square"]
    assert blocks.count(small, p, closed=True).first()["n"] == len(brute(edges, p))


@pytest.mark.parametrize("name", ["q0_triangle", "q1_square", "q10_solar_square"])
def test_weights(small, tiny, name):
    for p in (CATALOGUE[name], CATALOGUE[name].unordered()):
        assert sorted(blocks.edge_weights(small, p).collect()) == sorted(motif.edge_weights(small, p).collect())


@pytest.mark.parametrize("name", ["q1_square", "q2_chordal_square", "q3_4_clique", "q4_house"])
def test_across_parts(spark, small, edges, tiny, name):
    p, k = CATALOGUE[name], 3
    part = partition.by_hash(clean.vertices(small), k)
    want = sum(len({v % k for v in m}) > 1 for m in brute(edges, p))
    assert blocks.inter_lazily(small, part, p).first()["n"] == want
    for share in (True, False):
        assert blocks.inter_by_sequences(small, part, p, share).first()["n"] == want
    assert sorted(blocks.seeded(small, part, p).collect()) == sorted(match.seeded(small, part, p).collect())


@pytest.mark.parametrize("name", sorted(queries.IN_BLOCKS))
def test_queries_shuffle_lists_not_partial_matches(spark, name):
    made = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    want = duckdb_rows(queries.ORACLE_SQL[name])
    assert sorted(map(tuple, made.collect())) == want


def duckdb_rows(sql):
    con = duckdb.connect()
    con.execute("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    return sorted(con.execute(sql).fetchall())
