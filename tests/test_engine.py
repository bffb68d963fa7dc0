import pytest
from graphs_for_tests import adj, brute, complete

from subweave import __main__ as cli
from subweave import engine
from subweave.operators import match
from subweave.plans.pattern import CATALOGUE, by_name


def test_algorithms_and_orders_agree(spark):
    edges = [(a, b) for a, b in complete(8) if (a + b) % 5]
    g, want = adj(spark, edges), len(brute(edges, by_name("q6")))
    for algorithm in engine.ALGORITHMS:
        for order in engine.ORDERS:
            assert engine.count(g, "q6", algorithm, order).first()["n"] == want
    assert engine.matches(g, "q6").count() == want
    assert engine.count(g, "q6", ordered=False).first()["n"] == match.count_embeddings(g, by_name("q6")).first()["n"]
    with pytest.raises(ValueError):
        engine.count(g, "q1", order=(0, 2, 1, 3))


def test_symmetry_factors():
    got = {p.name.split("_")[0]: match.symmetry_factor(p) for p in CATALOGUE.values()}
    assert got == {k: 4 if k == "q12" else len(by_name(k).automorphisms()) for k in got}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("".join(f"{a} {b}\n" for a, b in complete(6)))
    cli.main(["count", "--graph", str(tmp_path / "g.txt"), "--pattern", "q5"])
    cli.main(["explain", "--pattern", "q2"])
    out = capsys.readouterr().out
    assert "q5 lazy: 360" in out and "order 0213" in out


def test_weights_parts_and_conversion(spark, tmp_path, capsys):
    graph, out = tmp_path / "g.txt", str(tmp_path / "o")
    graph.write_text("".join(f"{a} {b}\n" for a, b in complete(6)))
    (tmp_path / "parts").write_text("0\n0\n0\n1\n1\n1\n")
    cli.main(["count", "--graph", str(graph), "--pattern", "q0", "--parts", str(tmp_path / "parts"), "--k", "2"])
    assert "2 within parts, 18 across, 20 in all" in capsys.readouterr().out
    cli.main(["weights", "--graph", str(graph), "--pattern", "q0", "--weights", "veweight", "--out", out])
    assert spark.read.text(f"{out}.veweight.triangle").first()["value"] == "6 15 011 1"
    cli.main(["weights", "--graph", str(graph), "--pattern", "line", "--out", out])
    assert spark.read.text(f"{out}.motifcut.uniform").count() == 31
    cli.main(["convert", "--graph", str(graph), "--out", out])
    assert spark.read.text(f"{out}.snap.txt").count() == 15
    cli.main(["profile", "--graph", str(graph), "--pattern", "q3"])
    assert "2 vertices: 15\n3 vertices: 20\n4 vertices: 15" in capsys.readouterr().out


def test_counts_by_degree(spark):
    edges = complete(7) + [(0, k) for k in range(7, 60)]
    g = adj(spark, edges)
    for name in ("q0", "q3", "q5"):
        assert {engine.count(g, name, by_degree=x).first()["n"] for x in (None, True, False)} == {match.count_by_joins(g, by_name(name)).first()["n"]}
    assert [by_name(x).totally_ordered() for x in ("q0", "q7", "q1", "q4")] == [True, True, False, False]
