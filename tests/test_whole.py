"""Queries over the whole table, against brute force on a small one."""

import random

from graphs_for_tests import brute

from subweave import queries
from subweave.plans.pattern import by_name


def lines(spark, path):
    """Few lines of a large quantity or returned; some line numbers are there twice."""
    rng = random.Random(3)
    rows = [(order, rng.randint(1, 25), rng.randint(1, 9), number, float(rng.randint(1, 50)), rng.choice("AAANNNR")) for order in range(40) for number in (1, 2, 2, 3, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return {tuple(sorted((x[1], y[1]))) for x in rows for y in rows if x[0] == y[0] and x[3] + 1 == y[3] and x[1] != y[1]}


def test_graph_of_all_lines(spark, tmp_path):
    edges = lines(spark, tmp_path)
    got = queries.QUERIES["edge_text"](spark, str(tmp_path)).collect()
    assert {tuple(sorted(map(int, r["value"].split("\t")))) for r in got} == edges
    for name in ("q0_triangle", "q3_4_clique_lazy", "q2_chordal_square_direct"):
        assert queries.QUERIES[name](spark, str(tmp_path)).first()["n"] == len(brute(edges, by_name(name.split("_")[0])))
    for name in ("fennel_partition", "label_partition"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == len({v for e in edges for v in e})


def test_chosen_vertices_and_pairs(spark, tmp_path):
    edges = lines(spark, tmp_path)
    both = {e for a, b in edges for e in ((a, b), (b, a))}
    near = {v: {b for a, b in both if a == v} for v, _ in both}
    hubs = {v for v in near if len(near[v]) > len(both) / len(near)}
    rows = lambda name: sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert rows("vertex_rows") == sorted(e for e in both if e[0] in hubs)
    assert rows("induced_subgraph") == sorted(e for e in both if set(e) <= hubs)
    assert rows("batch_intersections") == sorted((a, b, len(near[a] & near[b])) for a, b in both)
