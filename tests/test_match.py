"""All plans against closed forms, brute force and each other."""

import random

import pytest
from graphs_for_tests import adj, brute, complete

from subweave.operators import clean, match, partition
from subweave.plans import planner, reuse
from subweave.plans.pattern import CATALOGUE, Pattern, by_name
from subweave.plans.planner import Level

K6 = [20, 45, 90, 15, 360, 360, 180, 6, 180, 360, 90, 1, 180, 120]
K6_UNORDERED = [120, 360, 360, 360, 720, 720, 720, 720, 720, 720, 720, 720, 720, 720]
PATTERNS = list(CATALOGUE.values())


def n_of(df):
    return df.first()["n"]


@pytest.fixture(scope="module")
def k6(spark):
    return adj(spark, complete(6))


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(7)
    return [(a, b) for a, b in complete(9) if rng.random() < 0.6]


@pytest.fixture(scope="module")
def small(spark, edges):
    return adj(spark, edges)


@pytest.mark.parametrize("i", range(len(PATTERNS)))
def test_complete_graph(k6, i):
    p = PATTERNS[i]
    assert n_of(match.count_by_joins(k6, p)) == n_of(match.count_lazily(k6, p)) == K6[i]
    assert n_of(match.count_lazily(k6, p.unordered())) == K6_UNORDERED[i]


@pytest.mark.parametrize("i", range(len(PATTERNS)))
def test_against_brute_force(small, edges, i):
    p = PATTERNS[i]
    want = brute(edges, p)
    got = [tuple(r) for r in match.instances(small, p).collect()]
    assert sorted(got) == sorted(want)
    assert n_of(match.count_with_reuse(small, p)) == len(want)


@pytest.mark.parametrize("name", ["q2", "q5", "q9", "q13"])
@pytest.mark.parametrize("level", Level)
def test_levels_agree(small, edges, name, level):
    p = by_name(name)
    assert n_of(match.count_lazily(small, p, level=level)) == len(brute(edges, p))


@pytest.mark.parametrize("name", ["q2", "q5", "q6", "q10"])
def test_closed_forms(small, edges, name):
    p = by_name(name)
    assert n_of(match.count_direct(small, p)) == len(brute(edges, p))


def test_large_clique(spark):
    k20 = adj(spark, complete(20))
    assert n_of(match.count_lazily(k20, by_name("q5"))) == 13_953_600
    assert n_of(match.count_lazily(k20, by_name("q7"))) == 15_504


def test_orders_and_user_patterns(small, edges):
    p = Pattern("bull", 5, ((0, 1), (1, 2), (0, 2), (1, 3), (2, 4)), ((1, 2),))
    want = len(brute(edges, p))
    for order in planner.connected_orders(p)[::9]:
        assert n_of(match.count_lazily(small, p, order)) == want
    assert n_of(match.count_with_reuse(small, p, reuse.cheapest(p))) == want
    assert n_of(match.count_lazily(clean.by_degree(small), by_name("q3"))) == len(brute(edges, by_name("q3")))


@pytest.mark.parametrize("name", ["q0", "q1", "q2", "q8"])
def test_parts_add_up(small, edges, name):
    p = by_name(name)
    part = partition.by_hash(clean.vertices(small), 3)
    row = match.by_partition(small, part, p).first()
    want = brute(edges, p)
    assert row["total"] == len(want)
    assert row["intra"] == sum(len({v % 3 for v in m}) == 1 for m in want)
    assert n_of(match.inter_by_sequences(small, part, p)) == n_of(match.inter_by_sequences(small, part, p, share=False)) == row["inter"]
    assert n_of(match.inter_lazily(small, part, p, 8)) == row["inter"]
    assert sum(r["n"] for r in match.seeded(small, part, p).collect()) == row["inter"]


def test_nothing_to_match(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    for p in (by_name("q0"), by_name("q5")):
        assert n_of(match.count_by_joins(empty, p)) == n_of(match.count_lazily(empty, p)) == n_of(match.count_with_reuse(empty, p)) == 0
