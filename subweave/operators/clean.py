"""From raw edges to a clean adjacency, its checks and its statistics.

adj has src and dst (bigint), both directions of every edge. Dense numbers are given by stretches of the order, so no task sees
all vertices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subweave.store import stored

#: Rows that are numbered in one task, and stretches at most.
STRETCH_ROWS, MOST_STRETCHES = 1 << 20, 4096


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions."""
    return edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).unionAll(edges.select(F.col(dst).cast("long").alias("src"), F.col(src).cast("long").alias("dst")))


def without_loops(adj: DataFrame) -> DataFrame:
    return adj.where("src <> dst")


def without_parallels(adj: DataFrame) -> DataFrame:
    return adj.distinct()


def vertices(adj: DataFrame) -> DataFrame:
    """v: every vertex with an edge."""
    return adj.select(F.col("src").alias("v")).unionAll(adj.select(F.col("dst").alias("v"))).distinct()


def stretch_of(bounds: list, value: Column) -> Column:
    """How many of the ascending bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    own = F.array(*map(F.lit, bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    go = lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(own, F.least(at + step, F.lit(len(bounds)))) <= value), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go)


def numbered(rows: DataFrame, by: str, name: str = "number", stretch_rows: int = STRETCH_ROWS, then: str | None = None, within: str | None = None) -> DataFrame:
    """The rows with a number from 0 in the order of a bigint column; rows that are equal there are in the order of then.

    within: a column of few values, for each of which numbers begin anew.
    """
    n = min(MOST_STRETCHES, math.ceil(rows.count() / stretch_rows))
    cuts = rows.select(F.percentile_approx(by, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    placed = rows.withColumn("_stretch", stretch_of(sorted(set(cuts or [])), F.col(by)))
    own = [within] if within else []
    before = Window.partitionBy(*own).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*own, "_stretch").count().select(*own, "_stretch", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(*own, "_stretch").orderBy(by, *([then] if then else [])))
    return placed.join(F.broadcast(bases), [*own, "_stretch"]).withColumn(name, F.col("_base") + nth - 1).drop("_stretch", "_base")


def _renamed(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """adj by the numbers of its vertices (v, number)."""
    ids = stored(ids.select("v", "number"), "ids")
    a = ids.select(F.col("v").alias("src"), F.col("number").alias("a"))
    b = ids.select(F.col("v").alias("dst"), F.col("number").alias("b"))
    return adj.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def relabelled(adj: DataFrame) -> DataFrame:
    """The same graph with vertices 0..k-1 in the order of their ids; vertices without edges are gone."""
    return _renamed(adj, numbered(vertices(adj), "v"))


def cleaned(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The whole preparation: both directions, no loops, no parallel edges, dense vertices."""
    return relabelled(stored(without_parallels(without_loops(symmetric(edges, src, dst))), "edges"))


def by_degree(adj: DataFrame) -> DataFrame:
    """The same graph with vertices numbered by degree, those of one degree by hash, then id.

    Counts stay; patterns whose order is total then grow from vertices of few neighbours. Which row stands for a match changes.
    """
    rank = degrees(adj).withColumn("key", F.col("degree") * (1 << 24) + F.pmod(F.xxhash64("v"), F.lit(1 << 24)))
    return _renamed(adj, numbered(rank, "key", then="v"))


def neighbours(adj: DataFrame) -> DataFrame:
    """v and its sorted neighbours n."""
    return adj.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("n"))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def validated(adj: DataFrame, n_vertices: int | None = None) -> DataFrame:
    """One row: vertices without edges (of 0..n_vertices-1, or of 0..the largest), self-loops, repeated edges. All 0 for a clean graph."""
    total = F.lit(n_vertices) if n_vertices is not None else F.coalesce(F.greatest(F.max("src"), F.max("dst")) + 1, F.lit(0))
    grouped = adj.groupBy("src", "dst").count()
    most = grouped.agg(
        total.alias("total"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("count"))), F.lit(0)).alias("self_loops"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("parallel_edges"),
    )
    used = vertices(adj).agg(F.count("*").alias("used"))
    return most.crossJoin(F.broadcast(used)).select((F.col("total") - F.col("used")).alias("dangling"), "self_loops", "parallel_edges")


def summary(adj: DataFrame) -> DataFrame:
    """One row: vertices with edges, directed edges, least and greatest degree."""
    return degrees(adj).agg(F.count("*").alias("n_vertices"), F.coalesce(F.sum("degree"), F.lit(0)).alias("n_edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def csr(adj: DataFrame) -> DataFrame:
    """v, the offset of its neighbours in the column array, and the neighbours: prefix sums of degrees by stretches."""
    n = neighbours(adj).withColumn("degree", F.size("n").cast("long"))
    rank = numbered(n, "v", "row").withColumn("stretch", F.floor(F.col("row") / STRETCH_ROWS))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = rank.groupBy("stretch").agg(F.sum("degree").alias("s")).select("stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return rank.join(F.broadcast(bases), "stretch").select("v", (F.col("base") + F.coalesce(F.sum("degree").over(inner), F.lit(0))).alias("offset"), "n")


def share_sql(v: str, seed: int = 0) -> str:
    """A number from 0 to 1 by which a vertex id of 0 or more is chosen, in plain arithmetic, as other engines have it too."""
    mixed = f"(({v} + {seed}) % 2147483647 * 1103515245 + 12345) % 2147483648"
    folded = f"({mixed} + ({mixed}) % 46337 * 31607) % 2147483647"
    return f"CAST(({folded} * 1103515245 + 12345) % 2147483648 AS DOUBLE) / 2147483648"


def sampled_vertices(adj: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """The graph induced by a share of the vertices, chosen by hash: the same vertices every time."""
    keep = lambda c: F.expr(share_sql(c, seed)) < ratio
    return adj.where(keep("src") & keep("dst"))


def induced(adj: DataFrame, chosen: DataFrame, v: str = "v") -> DataFrame:
    """Edges with both ends among the chosen vertices."""
    own = chosen.select(F.col(v).alias("_v")).distinct()
    return adj.join(own, F.col("src") == F.col("_v"), "left_semi").join(own, F.col("dst") == F.col("_v"), "left_semi")


def rows_of(adj: DataFrame, chosen: DataFrame, v: str = "v") -> DataFrame:
    """Edges whose source is among the chosen vertices; ids stay."""
    own = chosen.select(F.col(v).alias("_v")).distinct()
    return adj.join(own, F.col("src") == F.col("_v"), "left_semi")


def first_edges(edges: DataFrame, n: int) -> DataFrame:
    """The first n edges as they are ordered by ordinal, if there is one, or any n."""
    return edges.orderBy("ordinal").limit(n) if "ordinal" in edges.columns else edges.limit(n)
