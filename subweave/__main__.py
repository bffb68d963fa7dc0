"""python -m subweave: count or profile a pattern in a graph file, clean or convert one, write weights for partitioners, or explain a plan."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave import engine
from subweave.operators import clean, match, motif
from subweave.plans.pattern import CATALOGUE, LINE, Pattern, by_name
from subweave.plans.planner import Level
from subweave.sources import graphs


def _write_weights(adj: DataFrame, pattern: Pattern, kind: str, out: str) -> None:
    path = graphs.weight_path(out, kind, pattern.name)
    if kind == "motifcut":
        weights = motif.edge_weights(adj, pattern)
        total = motif.total_matches(weights, pattern).select(F.col("n").cast("string").alias("line"))
        graphs.write_lines(total, motif.cut_rows(weights), ["src", "dst"], path)
        return
    weights, both = motif.partitioner_weights(adj, pattern), kind == "veweight"
    graphs.write_lines(motif.metis_header(weights, both), motif.metis_rows(weights, both), ["v"], path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("subweave")
    parser.add_argument("what", choices=["count", "profile", "clean", "convert", "weights", "explain", "patterns"])
    parser.add_argument("--graph", help="path of a graph file")
    parser.add_argument("--kind", help="txt, lvid, bin or adj; else by suffix")
    parser.add_argument("--directed", action="store_true", help="the file has both directions")
    parser.add_argument("--pattern", default="q0")
    parser.add_argument("--algorithm", default="lazy", choices=list(engine.ALGORITHMS))
    parser.add_argument("--order", default="hand", choices=list(engine.ORDERS))
    parser.add_argument("--level", default="LAZY", choices=[x.name for x in Level])
    parser.add_argument("--unordered", action="store_true", help="count all embeddings")
    parser.add_argument("--parts", help="path of a file with the part of each vertex: counts within parts and across")
    parser.add_argument("--k", type=int, default=1, help="how many parts the file has")
    parser.add_argument("--weights", default="motifcut", choices=["motifcut", "weight", "veweight"], help="what weights writes")
    parser.add_argument("--out", help="where clean, convert and weights write to; --out-kind says how")
    parser.add_argument("--out-kind", default="txt", choices=["txt", "adj", "bin"])
    o = parser.parse_args(args)
    if o.what == "patterns":
        print("\n".join(CATALOGUE))
        return
    if o.what == "explain":
        print(engine.explain(o.pattern, o.order, Level[o.level]))
        return
    spark = SparkSession.builder.appName("subweave").getOrCreate()
    edges = graphs.read_graph(spark, o.graph, o.directed, o.kind)
    if o.what == "convert":
        graphs.write_graph(edges, o.out, o.out_kind)
        return
    adj = clean.cleaned(edges).persist()
    if o.what == "clean":
        graphs.write_graph(adj, o.out, o.out_kind)
        print(tuple(clean.validated(adj).first()))
        return
    pattern = LINE if o.pattern == "line" else by_name(o.pattern)
    if o.what == "weights":
        _write_weights(adj, pattern, o.weights, o.out)
        return
    if o.what == "profile":
        for k, n in engine.profile(adj, pattern, o.order).items():
            print(f"{k} vertices: {n}")
        return
    if o.parts:
        part = graphs.read_parts(spark, o.parts, o.k, clean.vertices(adj))
        print("{} within parts, {} across, {} in all".format(*match.by_partition(adj, part, pattern).first()))
        return
    adj.count()
    began = time.perf_counter()
    n = engine.count(adj, o.pattern, o.algorithm, o.order, Level[o.level], not o.unordered).first()["n"]
    print(f"{o.pattern} {o.algorithm}: {n} in {time.perf_counter() - began:.2f} s")


if __name__ == "__main__":
    main()
