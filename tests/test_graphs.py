"""Cleaning, partitions, weights, files and the one-pass partitioner."""

import random
import struct

import numpy as np
import pytest
from graphs_for_tests import adj, brute, complete

from subweave.operators import clean, motif, partition
from subweave.plans.pattern import CATALOGUE, LINE, by_name
from subweave.sources import graphs
from subweave.streaming import edges as stream
from subweave.streaming import fennel

SIMPLE = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 4), (3, 4)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_and_validate(spark):
    raw = spark.createDataFrame([(10, 20), (20, 10), (10, 10), (10, 30), (10, 40), (20, 30), (30, 77), (40, 77)], "src long, dst long")
    got = clean.cleaned(raw)
    assert rows(got) == rows(adj(spark, SIMPLE))
    assert [(r["v"], r["offset"], r["n"]) for r in clean.csr(got).orderBy("v").collect()] == [(0, 0, [1, 2, 3]), (1, 3, [0, 2]), (2, 5, [0, 1, 4]), (3, 8, [0, 4]), (4, 10, [2, 3])]
    assert rows(clean.cleaned(got)) == rows(got)
    assert tuple(clean.validated(got).first()) == (0, 0, 0)
    assert tuple(clean.validated(clean.symmetric(raw)).first()) == (73, 2, 3)


def test_numbers_in_stretches(spark):
    values = random.Random(1).sample(range(10_000), 500)
    got = clean.numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", stretch_rows=37)
    assert rows(got) == [(v, i) for i, v in enumerate(sorted(values))]


def test_partitions(spark):
    g = adj(spark, SIMPLE)
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)], "v long, pid int")
    assert rows(partition.relabelled_inside(g, part)) == [(0, 0, 1), (0, 1, 0), (1, 0, 2), (1, 1, 2), (1, 2, 0), (1, 2, 1)]
    assert rows(partition.crossing(g, part)) == [(0, 2), (0, 3), (1, 2), (2, 0), (2, 1), (3, 0)]
    assert tuple(partition.crossing_rate(g, part).first()) == (6, 12, 0.5)
    assert [tuple(r)[:3] for r in partition.statistics(g, part).orderBy("pid").collect()] == [(0, 2, 2), (1, 3, 4)]
    assert tuple(partition.checked(part, 2).first()) == (0, 0, True)


@pytest.mark.parametrize("k", [2, 3])
def test_partitioners_place_every_vertex(spark, k):
    g = adj(spark, [(a, b) for c in range(k) for a, b in [(x + 8 * c, y + 8 * c) for x, y in complete(8)]] + [(0, 8)])
    for part in (fennel.partitioned(clean.neighbours(g), k), partition.by_labels(g, k)):
        got = {r["v"]: r["pid"] for r in part.collect()}
        assert set(got) == set(range(8 * k)) and set(got.values()) <= set(range(k))
    own = {r["v"]: r["pid"] for r in fennel.partitioned(clean.neighbours(g), k).collect()}
    assert max(list(own.values()).count(p) for p in range(k)) <= 1.1 * 8 + 1
    crossing = sum(own[a] != own[b] for a, b in rows(g))
    assert crossing < len(rows(g)) / 2


def test_fennel_by_hand():
    state = fennel.Fennel(4, 3, 2)
    assert [state.put(0, [1]), state.put(1, [0, 2]), state.put(2, [1, 3]), state.put(3, [2])] == _fennel_by_hand()


def _fennel_by_hand():
    alpha, load, place, out = 2**0.5 * 3 / 4**1.5, [0, 0], {}, []
    for v, near in enumerate(([1], [0, 2], [1, 3], [2])):
        score = [sum(place.get(u) == p for u in near) - alpha * ((load[p] + 1) ** 1.5 - load[p] ** 1.5) if load[p] <= 1.1 * 4 / 2 else float("-inf") for p in range(2)]
        p = score.index(max(score))
        place[v], load[p] = p, load[p] + 1
        out.append(p)
    return out


def test_weights(spark):
    edges = [(a, b) for a, b in complete(7) if (a * b) % 3 != 1]
    g, p = adj(spark, edges), by_name("q2")
    want = {e: 0 for a, b in edges for e in ((a, b), (b, a))}
    found = brute(edges, p)
    for m in found:
        for a, b in p.edges:
            want[m[a], m[b]] += 1
            want[m[b], m[a]] += 1
    got = motif.edge_weights(g, p)
    assert {(r["src"], r["dst"]): r["w"] for r in got.collect()} == want
    assert motif.total_matches(got, p).first()["n"] == len(found)
    assert {r["w"] for r in motif.partitioner_weights(g, LINE).collect()} == {1}


@pytest.mark.parametrize(("walks", "most_sent", "stop", "names"), [(3000, 1 << 23, 0.1, ("q0", "q2")), (300, 0, 0.6, ("q0",))])
def test_sampled_weights(spark, walks, most_sent, stop, names):
    """Edges of matches are met and no others; walks leave a vertex's surroundings, so far triangles count for near starts."""
    ring = [(i, i + 1) for i in range(10, 16)]
    edges = [(a, b) for a, b in complete(6) if (a, b) != (0, 5)] + [(5, 10), *ring] + [(16, 20), (16, 21), (20, 21)]
    for name in names:
        exact = {(r["src"], r["dst"]): r["w"] for r in motif.edge_weights(adj(spark, edges), by_name(name)).collect()}
        got = {(r["src"], r["dst"]): r["w"] for r in motif.sampled_weights(adj(spark, edges), by_name(name), walks=walks, stop=stop, most_sent=most_sent).collect()}
        assert set(got) == set(exact)
        assert all((got[e] > 0) == (exact[e] > 0) for e in exact)
        assert all(got[a, b] == got[b, a] for a, b in got)


def test_walks_by_hand():
    """On one triangle every three steps without going back meet it: the expected number follows from the chances."""
    offsets, targets = np.array([0, 2, 4, 6]), np.array([1, 2, 0, 2, 0, 1])
    total = motif.Walks(offsets, targets, by_name("q0"), 0.1).run(np.arange(3), 20_000, np.random.default_rng(1))
    # after k steps 0.9^k of the walks are left; from the second step on half of the steps do not go back
    want = 3 * 20_000 * sum(0.9**k for k in range(2, 200)) / 2
    assert total.min() == total.max() and abs(total[0] / want - 1) < 0.02


def test_partitioner_rows(spark):
    w = motif.partitioner_weights(adj(spark, SIMPLE), by_name("q0"))
    assert [r["line"] for r in motif.metis_rows(w, True).orderBy("v").collect()] == ["3 2 2 3 2 4 1", "2 1 2 3 2", "3 1 2 2 2 5 1", "2 1 1 5 1", "2 3 1 4 1"]
    assert motif.metis_header(w).first()["line"] == "5 6 001"
    assert graphs.weight_path("g.bin", "weight", "q2_chordal_square") == "g.bin.weight.chordalsquare"
    assert graphs.weight_path("g.bin", "motifcut", "line") == "g.bin.motifcut.uniform"
    with pytest.raises(ValueError):
        graphs.weight_path("g.bin", "weight", "q13_triangle_in_diamond")


def test_edge_lists(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# comment\n\n5\t7\n7 9 extra\n5 5\n5 7\n")
    assert rows(graphs.read_graph(spark, str(tmp_path / "g.txt"), directed=True)) == [(0, 0), (0, 2), (0, 2), (2, 4)]
    assert len(rows(graphs.read_graph(spark, str(tmp_path / "g.txt")))) == 8


def test_large_ids(spark, tmp_path):
    big = 10**30
    (tmp_path / "g.lvid").write_text(f"# Nodes: 5 Edges: 10\n{big + 5} {big}\nx{big}-77\n{big}-77,{big + 5};{big}\n")
    assert rows(graphs.read_graph(spark, str(tmp_path / "g.lvid"), directed=True)) == [(0, 1), (0, 1), (1, 2)]
    (tmp_path / "odd.lvid").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        graphs.read_graph(spark, str(tmp_path / "odd.lvid"))
    (tmp_path / "across.lvid").write_text("9 8 7\n9\n")
    assert rows(graphs.read_graph(spark, str(tmp_path / "across.lvid"), directed=True)) == [(0, 1), (2, 0)]


def test_files_of_a_folder_are_read_in_their_order(spark, tmp_path):
    """Spark reads the larger file first; the order is that of the names."""
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts/part-00000").write_text("0\n0\n")
    (tmp_path / "parts/part-00001").write_text("1\n" * 50)
    assert rows(graphs.read_parts(spark, str(tmp_path / "parts"), 2)) == [(v, int(v > 1)) for v in range(52)]
    (tmp_path / "g.lvid").mkdir()
    (tmp_path / "g.lvid/part-00000").write_text("70 60 50\n")
    (tmp_path / "g.lvid/part-00001").write_text("40 " + "30 20 " * 50 + "\n")
    got = rows(graphs.read_graph(spark, str(tmp_path / "g.lvid"), directed=True))
    names = ["70", "60", "50", "40", *["30", "20"] * 50]
    ids = {x: i for i, x in enumerate(dict.fromkeys(names))}
    assert got == sorted((ids[a], ids[b]) for a, b in zip(names[::2], names[1::2], strict=False))


def test_blocks_of_a_file_are_read_in_their_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "parts").write_text("".join(f"{v // 100}\n" for v in range(1000)))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
        assert rows(graphs.read_parts(spark, str(tmp_path / "parts"), 10)) == [(v, v // 100) for v in range(1000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_clean_files(spark, tmp_path):
    (tmp_path / "g").write_text("# 0 0\n1 2\n3,4 x-1\t5\nno number\n6 7 8\n")
    graphs.write_clean(spark, str(tmp_path / "g"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out.clean")).collect()] == ["1\t2", "3\t4", "5\t6", "7\t8"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out.fail")).collect()] == ["x-1\tno"]
    (tmp_path / "odd").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        graphs.clean_lines(spark, str(tmp_path / "odd"))


def test_binary_files(spark, tmp_path):
    g = adj(spark, complete(6))
    graphs.write_graph(g, str(tmp_path / "k6"), "bin")
    data = (tmp_path / "k6.bin").read_bytes()
    assert struct.unpack_from("<4Q7Q", data) == (4, 8, 6, 30, 0, 5, 10, 15, 20, 25, 30)
    assert rows(graphs.read_graph(spark, str(tmp_path / "k6.bin"))) == rows(g)
    (tmp_path / "bad.bin").write_bytes(data[:-4])
    with pytest.raises(Exception, match="shorter"):
        graphs.read_binary(spark, str(tmp_path / "bad.bin")).collect()


def test_text_writers(spark, tmp_path):
    g = adj(spark, SIMPLE)
    graphs.write_graph(g, str(tmp_path / "g"), "txt")
    assert rows(graphs.read_edge_list(spark, str(tmp_path / "g.snap.txt"))) == rows(g)
    graphs.write_graph(g, str(tmp_path / "g"), "adj")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "g.adj.txt")).collect()][0] == "0\t1 2 3"
    assert spark.read.text(str(tmp_path / "g.info")).first()["value"] == "5 12"
    w = motif.edge_weights(g, by_name("q0"))
    graphs.write_lines(motif.total_matches(w, by_name("q0")).selectExpr("cast(n as string) line"), motif.cut_rows(w), ["src", "dst"], str(tmp_path / "cut"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "cut")).collect()][:2] == ["1", "0 1 1"]


def test_other_inputs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3 2 5 7\n5 1 3\n9 0\n")
    assert rows(graphs.read_adjacency(spark, str(tmp_path / "a.txt"))) == [(3, 5), (3, 7), (5, 3)]
    assert rows(graphs.read_adjacency(spark, f"{tmp_path / 'a.txt'},{tmp_path / 'a.txt'}")) == [(3, 5), (3, 5), (3, 7), (3, 7), (5, 3), (5, 3)]
    (tmp_path / "parts").write_text("0\n1\n1\n")
    assert rows(graphs.read_parts(spark, str(tmp_path / "parts"), 2)) == [(0, 0), (1, 1), (2, 1)]
    assert rows(graphs.in_memory(spark, {0: [1], 1: [0]})) == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        graphs.read_parts(spark, str(tmp_path / "parts"), 3)


def test_subgraphs(spark):
    g = adj(spark, complete(8))
    chosen = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v long")
    assert rows(clean.induced(g, chosen)) == rows(adj(spark, [(1, 2), (1, 5), (2, 5)]))
    assert len(rows(clean.rows_of(g, chosen))) == 21
    half = clean.sampled_vertices(g, 0.5)
    assert rows(half) == rows(clean.sampled_vertices(g, 0.5)) and len(rows(half)) < 56
    assert clean.first_edges(g, 3).count() == 3


def test_stream_of_edges(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 3)], "src long, dst long").write.parquet(source)
    read = spark.readStream.schema("src long, dst long").parquet(source)
    stream.append_to(read, out, str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_catalogue_names():
    assert len(CATALOGUE) == 14
