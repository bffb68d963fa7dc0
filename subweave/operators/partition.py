"""Graphs in parts: what lies inside a part and what crosses.

part has v and pid, one row per vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subweave.operators.clean import numbered
from subweave.store import stored


def by_hash(vertices: DataFrame, k: int, v: str = "v") -> DataFrame:
    """part by the vertex id modulo k."""
    return vertices.select(F.col(v).alias("v"), F.pmod(F.col(v), F.lit(k)).cast("int").alias("pid"))


def placed(adj: DataFrame, part: DataFrame) -> DataFrame:
    """adj with the parts of both ends: ps, pd."""
    a = part.select(F.col("v").alias("src"), F.col("pid").alias("ps"))
    b = part.select(F.col("v").alias("dst"), F.col("pid").alias("pd"))
    return adj.join(a, "src").join(b, "dst").select("src", "dst", "ps", "pd")


def inside(adj: DataFrame, part: DataFrame) -> DataFrame:
    """Edges within a part: pid, src, dst."""
    return placed(adj, part).where("ps = pd").select(F.col("ps").alias("pid"), "src", "dst")


def local_ids(part: DataFrame) -> DataFrame:
    """v, pid and local: 0.. in each part in the order of ids."""
    return numbered(part, "v", "local", within="pid").withColumn("local", F.col("local").cast("long"))


def relabelled_inside(adj: DataFrame, part: DataFrame) -> DataFrame:
    """Edges within a part under local ids: pid, src, dst."""
    ids = stored(local_ids(part), "local")
    a = ids.select(F.col("v").alias("src"), F.col("local").alias("ls"))
    b = ids.select(F.col("v").alias("dst"), F.col("local").alias("ld"))
    return inside(adj, part).join(a, "src").join(b, "dst").select("pid", F.col("ls").alias("src"), F.col("ld").alias("dst"))


def crossing(adj: DataFrame, part: DataFrame) -> DataFrame:
    """Edges between parts: src, dst."""
    return placed(adj, part).where("ps <> pd").select("src", "dst")


def crossing_rate(adj: DataFrame, part: DataFrame) -> DataFrame:
    """One row: crossing directed edges, all, and the share that crosses."""
    cross = F.count_if(F.col("ps") != F.col("pd"))
    return placed(adj, part).agg(cross.alias("crossing"), F.count("*").alias("edges"), (cross / F.count("*")).alias("rate"))


def statistics(adj: DataFrame, part: DataFrame) -> DataFrame:
    """A row per part: vertices, directed edges within, directed edges from it, and the share of those within."""
    edges = placed(adj, part).groupBy(F.col("ps").alias("pid")).agg(F.count_if(F.col("ps") == F.col("pd")).alias("intra_edges"), F.count("*").alias("edges"))
    n = part.groupBy("pid").agg(F.count("*").alias("n_vertices"))
    own = n.join(edges, "pid", "left").fillna(0, ["intra_edges", "edges"])
    return own.select("pid", "n_vertices", "intra_edges", "edges", F.when(F.col("edges") > 0, F.col("intra_edges") / F.col("edges")).otherwise(F.lit(0.0)).alias("intra_rate"))


def checked(part: DataFrame, k: int) -> DataFrame:
    """One row of what is wrong with a partition: vertices twice, parts below 0 or from k on, and whether part k - 1 is used."""
    twice = part.groupBy("v").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("twice"))
    outside = part.agg(F.count_if((F.col("pid") < 0) | (F.col("pid") >= k)).alias("outside"), (F.max("pid") + 1 == k).alias("all_used"))
    return twice.crossJoin(F.broadcast(outside))


def by_labels(adj: DataFrame, k: int, rounds: int = 5, slack: float = 1.1) -> DataFrame:
    """part by balanced label propagation, which scales where one pass in file order does not.

    All vertices start in a part by hash. In each round a vertex wants the part most of its neighbours are in (ties: the lowest);
    of those that want into a part as many move, by hash, as it has room for.
    """
    v = adj.select(F.col("src").alias("v")).distinct()
    part = v.select("v", F.pmod(F.xxhash64("v"), F.lit(k)).cast("int").alias("pid"))
    room = F.lit(slack / k)
    for _ in range(rounds):
        votes = adj.join(part.select(F.col("v").alias("dst"), "pid"), "dst").groupBy(F.col("src").alias("v"), "pid").count()
        best = votes.groupBy("v").agg(F.max(F.struct("count", (-F.col("pid")).alias("low"))).alias("b")).select("v", (-F.col("b.low")).alias("want"))
        sizes = part.groupBy("pid").agg(F.count("*").alias("size"))
        total = F.sum("size").over(Window.partitionBy())
        free = sizes.select(F.col("pid").alias("want"), F.greatest(F.lit(0), F.floor(total * room) - F.col("size")).alias("free"))
        wish = part.join(best, "v").where("want <> pid").groupBy("want").count()
        share = wish.join(free, "want").select("want", F.least(F.lit(1.0), F.col("free") / F.col("count")).alias("share"))
        moved = part.join(best, "v").join(F.broadcast(share), "want", "left")
        luck = F.pmod(F.xxhash64("v", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        part = stored(moved.select("v", F.when((F.col("want") != F.col("pid")) & (luck < F.coalesce("share", F.lit(0.0))), F.col("want")).otherwise(F.col("pid")).cast("int").alias("pid")), "parts")
    return part
