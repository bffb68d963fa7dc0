"""The graph queries over the driver's tables, and the SQL they are checked against.

The graph is of the parts on neighbouring lines of an order, over all lines of the table. (Nearly all suppliers share an order, so
theirs would be a complete graph.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave import oracle
from subweave.operators import blocks, clean, match, motif, partition
from subweave.plans import reuse
from subweave.plans.pattern import CATALOGUE, LINE, Pattern, by_name
from subweave.plans.planner import Level, cheapest
from subweave.sources import graphs
from subweave.store import new_path
from subweave.streaming import fennel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """adj of all lines, kept with its neighbour lists: all patterns over one graph read them many times.

    Spark finds the kept lists in every plan that has them, and drops and recomputes what does not fit.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("v"))
    x, y = lines.alias("x"), lines.alias("y")
    step = F.col("x.l_linenumber") + 1 == F.col("y.l_linenumber")
    both = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & step & (F.col("x.v") != F.col("y.v")))
    edges = both.select(F.least("x.v", "y.v").alias("src"), F.greatest("x.v", "y.v").alias("dst")).distinct()
    adj = clean.symmetric(edges).persist()
    clean.neighbours(adj).persist()
    return adj


def parts_of(adj: DataFrame, k: int = 4) -> DataFrame:
    return partition.by_hash(clean.vertices(adj), k)


#: Queries whose partial matches are far more than the graph's edges where they are shuffled: their plans run in blocks.
IN_BLOCKS = {
    "edge_seeded_q2",
    "edge_seeded_q3",
    "edge_weight_square",
    "inter_by_sequences_q2",
    "inter_by_sequences_q3",
    "inter_lazily_q1",
    "inter_lazily_q4",
    "q10_solar_square",
    "q10_solar_square_direct",
    "q10_solar_square_lazy",
    "q10_solar_square_reuse",
    "q10_solar_square_unordered",
    "q1_square",
    "q1_square_lazy",
    "q1_square_reuse",
    "q1_square_unordered",
    "q4_house",
    "q5_quad_triangle",
}


def _kept_parts(adj: DataFrame, k: int = 4) -> DataFrame:
    """parts_of, from the lists that graph() keeps, so that vertices need not be found again."""
    return partition.by_hash(clean.neighbours(adj), k)


def _add(name: str, query: Query, sql: str | None, in_blocks: Query | None = None) -> None:
    """in_blocks: the query as it runs if it is one of IN_BLOCKS."""
    QUERIES[name] = in_blocks if in_blocks and name in IN_BLOCKS else query
    if sql:
        ORACLE_SQL[name] = sql


_ADJ = f"WITH {oracle.GRAPH}"
_PART = "part AS (SELECT DISTINCT src AS v, CAST(src % 4 AS INTEGER) AS pid FROM adj)"
_PLACED = "placed AS (SELECT a.src, a.dst, p.pid AS ps, q.pid AS pd FROM adj a JOIN part p ON p.v = a.src JOIN part q ON q.v = a.dst)"
_COMMON = f"{_ADJ}, c AS (SELECT e.src AS a, e.dst AS b, count(*) AS n FROM adj e JOIN adj x ON x.src = e.src JOIN adj y ON y.src = e.dst AND y.dst = x.dst GROUP BY ALL) SELECT src AS a, dst AS b, CAST(coalesce(n, 0) AS INTEGER) AS n FROM adj LEFT JOIN c ON a = src AND b = dst"
_NBR = "nbr AS (SELECT src AS v, list(dst ORDER BY dst) AS n FROM adj GROUP BY src)"


def _counts() -> None:
    for name, p in CATALOGUE.items():
        sql = oracle.count_sql(p)
        closed = lambda s, d, p=p: blocks.count(graph(s, d), p, closed=True)
        _add(name, lambda s, d, p=p: match.count_by_joins(graph(s, d), p), sql, lambda s, d, p=p: blocks.count(graph(s, d), p, closed=p.n == 4))
        _add(f"{name}_lazy", lambda s, d, p=p: match.count_lazily(graph(s, d), p), sql, closed)
        _add(f"{name}_reuse", lambda s, d, p=p: match.count_with_reuse(graph(s, d), p), sql, closed)
        _add(f"{name}_unordered", lambda s, d, p=p: match.count_lazily(graph(s, d), p.unordered()), oracle.count_sql(p.unordered()), lambda s, d, p=p: blocks.count(graph(s, d), p.unordered(), closed=True))
    for short in ("q2", "q5", "q6", "q10"):
        p = by_name(short)
        _add(f"{p.name}_direct", lambda s, d, p=p: match.count_direct(graph(s, d), p), oracle.count_sql(p), lambda s, d, p=p: blocks.count(graph(s, d), p, closed=True))
    for short in ("q0", "q2", "q3", "q8"):
        p = by_name(short)
        _add(f"{short}_instances", lambda s, d, p=p: match.instances(graph(s, d), p), oracle.instances_sql(p))
    for short, level in (("q3", Level.ROWS), ("q4", Level.LAST), ("q5", Level.CLOSED)):
        p = by_name(short)
        _add(f"{p.name}_level_{level.name.lower()}", lambda s, d, p=p, level=level: match.count_lazily(graph(s, d), p, level=level), oracle.count_sql(p))
    for short in ("q4", "q9"):
        p = by_name(short)
        _add(f"{p.name}_cost_order", lambda s, d, p=p: match.count_lazily(graph(s, d), p, cheapest(p)), oracle.count_sql(p))
    p = by_name("q9")
    _add(f"{p.name}_cheapest_reuse", lambda s, d, p=p: match.count_with_reuse(graph(s, d), p, reuse.cheapest(p)), oracle.count_sql(p))
    for short in ("q3", "q7"):
        p = by_name(short)
        _add(f"{p.name}_by_degree", lambda s, d, p=p: match.count_lazily(clean.by_degree(graph(s, d)), p), oracle.count_sql(p))
        _add(f"{p.name}_pruned", lambda s, d, p=p: match.instances_pruned(graph(s, d), p).agg(F.count("*").alias("n")), oracle.count_sql(p))
    for short in ("q0", "q4", "q12"):
        p = by_name(short)
        _add(f"{p.name}_embeddings", lambda s, d, p=p: match.count_embeddings(graph(s, d), p), oracle.count_sql(p.unordered()))
    bull = Pattern("bull", 5, ((0, 1), (1, 2), (0, 2), (1, 3), (2, 4)), ((1, 2),))
    _add("user_pattern_bull", lambda s, d: match.count_lazily(graph(s, d), bull), oracle.count_sql(bull))


def _weights_sql(p: Pattern) -> str:
    ctes, last = oracle.match_ctes(p)
    used = " UNION ALL ".join(f"SELECT v{a} AS src, v{b} AS dst FROM {last}" for x, y in p.edges for a, b in ((x, y), (y, x)))
    return f"{_ADJ},\n{ctes},\nused AS ({used}),\nw AS (SELECT adj.src, adj.dst, coalesce(n, 0) AS w FROM adj LEFT JOIN (SELECT src, dst, count(*) AS n FROM used GROUP BY ALL) USING (src, dst))"


def _parts_sql(p: Pattern) -> str:
    ctes, last = oracle.match_ctes(p)
    same = " AND ".join(f"v{u} % 4 = v0 % 4" for u in range(1, p.n))
    return f"{_ADJ},\n{ctes}\nSELECT count(*) FILTER (WHERE {same}) AS intra, count(*) FILTER (WHERE NOT ({same})) AS inter, count(*) AS total FROM {last}"


def _seeded_sql(p: Pattern) -> str:
    ctes, last = oracle.match_ctes(p)
    cross = [f"CASE WHEN v{a} % 4 <> v{b} % 4 THEN least(v{a}, v{b}) * 4294967296 + greatest(v{a}, v{b}) END" for a, b in p.edges]
    return f"{_ADJ},\n{ctes},\nk AS (SELECT list_min([{', '.join(cross)}]) AS e FROM {last})\nSELECT CAST(e // 4294967296 AS BIGINT) AS a, CAST(e % 4294967296 AS BIGINT) AS b, count(*) AS n FROM k WHERE e IS NOT NULL GROUP BY ALL"


def _graph_queries() -> None:
    q0, q1, q2, q3 = (by_name(x) for x in ("q0", "q1", "q2", "q3"))
    for p in (q0, q2, q3):
        short = p.name.split("_")[0]
        _add(f"intra_inter_{short}", lambda s, d, p=p: match.by_partition(graph(s, d), parts_of(graph(s, d)), p), _parts_sql(p))
        _add(f"edge_seeded_{short}", lambda s, d, p=p: match.seeded(graph(s, d), parts_of(graph(s, d)), p), _seeded_sql(p), lambda s, d, p=p: blocks.seeded(graph(s, d), _kept_parts(graph(s, d)), p))
        _add(f"inter_by_sequences_{short}", lambda s, d, p=p: match.inter_by_sequences(graph(s, d), parts_of(graph(s, d)), p), f"SELECT inter AS n FROM ({_parts_sql(p)})", lambda s, d, p=p: blocks.inter_by_sequences(graph(s, d), _kept_parts(graph(s, d)), p))
    for p in (q0, q1, q2, q3, by_name("q4")):
        _add(f"inter_lazily_{p.name.split('_')[0]}", lambda s, d, p=p: match.inter_lazily(graph(s, d), parts_of(graph(s, d)), p, 4), f"SELECT inter AS n FROM ({_parts_sql(p)})", lambda s, d, p=p: blocks.inter_lazily(graph(s, d), _kept_parts(graph(s, d)), p))
    for p in (q0, q1, q2, q3):
        _add(f"edge_weight_{p.name.split('_', 1)[1]}", lambda s, d, p=p: motif.edge_weights(graph(s, d), p), f"{_weights_sql(p)}\nSELECT * FROM w", lambda s, d, p=p: blocks.edge_weights(graph(s, d), p))
    _add("edge_weight_uniform", lambda s, d: motif.edge_weights(graph(s, d), LINE), f"{_ADJ}\nSELECT src, dst, CAST(1 AS BIGINT) AS w FROM adj")
    _add("edge_weight_partitioner", lambda s, d: motif.partitioner_weights(graph(s, d), q0), f"{_weights_sql(q0)}\nSELECT src, dst, w + 1 AS w FROM w")
    _add("edge_weight_total", lambda s, d: motif.total_matches(motif.edge_weights(graph(s, d), q0), q0), oracle.count_sql(q0))
    metis = "string_agg((dst + 1) || ' ' || (w + 1), ' ' ORDER BY dst)"
    weigh = lambda s, d: motif.partitioner_weights(graph(s, d), q0)
    _add("metis_edge_weights", lambda s, d: motif.metis_rows(weigh(s, d)), f"{_weights_sql(q0)}\nSELECT src AS v, {metis} AS line FROM w GROUP BY src")
    _add("metis_vertex_edge_weights", lambda s, d: motif.metis_rows(weigh(s, d), True), f"{_weights_sql(q0)}\nSELECT src AS v, count(*) || ' ' || {metis} AS line FROM w GROUP BY src")
    _add("metis_header", lambda s, d: motif.metis_header(weigh(s, d), True), f"{_ADJ}\nSELECT (max(src) + 1) || ' ' || (count(*) // 2) || ' 011 1' AS line FROM adj")
    _add("motif_cut_rows", lambda s, d: motif.cut_rows(motif.edge_weights(graph(s, d), q0)), f"{_weights_sql(q0)}\nSELECT src, dst, src || ' ' || dst || ' ' || w AS line FROM w")
    _add("relabel_dense", lambda s, d: clean.numbered(clean.vertices(graph(s, d)), "v"), f"{_ADJ}\nSELECT v, row_number() OVER (ORDER BY v) - 1 AS number FROM (SELECT DISTINCT src AS v FROM adj)")
    _add("degree", lambda s, d: clean.degrees(graph(s, d)), f"{_ADJ}\nSELECT src AS v, count(*) AS degree FROM adj GROUP BY src")
    _add("graph_summary", lambda s, d: clean.summary(graph(s, d)), f"{_ADJ}\nSELECT count(*) AS n_vertices, CAST(sum(degree) AS BIGINT) AS n_edges, min(degree) AS min_degree, max(degree) AS max_degree FROM (SELECT count(*) AS degree FROM adj GROUP BY src)")
    _add("neighbour_lists", lambda s, d: clean.neighbours(graph(s, d)).select("v", F.array_join(F.col("n").cast("array<string>"), " ").alias("n")), f"{_ADJ},\n{_NBR}\nSELECT v, array_to_string(n, ' ') AS n FROM nbr")
    _add("csr_offsets", lambda s, d: clean.csr(graph(s, d)).select("v", "offset", F.size("n").alias("degree")), f"{_ADJ}\nSELECT v, CAST(coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(degree AS INTEGER) AS degree FROM (SELECT src AS v, count(*) AS degree FROM adj GROUP BY src)")
    _add("adjacency_text", lambda s, d: graphs.adjacency_lines(graph(s, d)), f"{_ADJ},\n{_NBR}\nSELECT v, v || chr(9) || array_to_string(n, ' ') AS value FROM nbr")
    _add("edge_text", lambda s, d: graphs.edge_lines(graph(s, d)), f"{_ADJ}\nSELECT src || chr(9) || dst AS value FROM adj WHERE src < dst")
    _add("info_text", lambda s, d: graphs.info_line(graph(s, d)), f"{_ADJ}\nSELECT (max(src) + 1) || ' ' || count(*) AS value FROM adj")
    _add("edge_intersections", lambda s, d: match.edge_intersections(graph(s, d)).select("a", "b", F.size("n").alias("n")), _COMMON)
    ctes, _ = oracle.match_ctes(q2)
    _add("candidate_sizes_q2", lambda s, d: match.candidate_sizes(graph(s, d), q2), f"{_ADJ},\n{ctes}\nSELECT v0, v1, v2, count(*) AS candidates FROM m3 GROUP BY ALL")

    part = lambda s, d: parts_of(graph(s, d))
    _add("cross_edges", lambda s, d: partition.crossing(graph(s, d), part(s, d)), f"{_ADJ}\nSELECT * FROM adj WHERE src % 4 <> dst % 4")
    _add("cross_edge_rate", lambda s, d: partition.crossing_rate(graph(s, d), part(s, d)), f"{_ADJ}\nSELECT count(*) FILTER (WHERE src % 4 <> dst % 4) AS crossing, count(*) AS edges, count(*) FILTER (WHERE src % 4 <> dst % 4) / count(*) AS rate FROM adj")
    _add("partition_stats", lambda s, d: partition.statistics(graph(s, d), part(s, d)), f"{_ADJ},\n{_PART},\n{_PLACED}\nSELECT pid, n_vertices, intra_edges, edges, intra_edges / edges AS intra_rate FROM (SELECT pid, count(*) AS n_vertices FROM part GROUP BY pid) JOIN (SELECT ps AS pid, count(*) FILTER (WHERE ps = pd) AS intra_edges, count(*) AS edges FROM placed GROUP BY ps) USING (pid)")
    _add("intra_partition_graphs", lambda s, d: partition.relabelled_inside(graph(s, d), part(s, d)), f"{_ADJ},\n{_PART},\n{_PLACED},\nids AS (SELECT v, row_number() OVER (PARTITION BY pid ORDER BY v) - 1 AS l FROM part)\nSELECT ps AS pid, a.l AS src, b.l AS dst FROM placed JOIN ids a ON a.v = src JOIN ids b ON b.v = dst WHERE ps = pd")
    _add("partition_check", lambda s, d: partition.checked(part(s, d), 4), "SELECT CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS outside, true AS all_used")


def _raw_queries() -> None:
    raw = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 3).alias("dst"))
    raw_sql = "WITH r AS (SELECT l_partkey AS src, l_suppkey * 3 AS dst FROM lineitem), s AS (SELECT src, dst FROM r UNION ALL SELECT dst, src FROM r)"
    _add("symmetrise", lambda s, d: clean.symmetric(raw(s, d)), f"{raw_sql} SELECT * FROM s")
    _add("drop_self_loops", lambda s, d: clean.without_loops(clean.symmetric(raw(s, d))), f"{raw_sql} SELECT * FROM s WHERE src <> dst")
    _add("drop_parallel_edges", lambda s, d: clean.without_parallels(clean.symmetric(raw(s, d))), f"{raw_sql} SELECT DISTINCT * FROM s")
    dense = "u AS (SELECT DISTINCT src, dst FROM s WHERE src <> dst), ids AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT DISTINCT src AS v FROM u))"
    cleaned = f"{raw_sql}, {dense}, g AS (SELECT a.id AS src, b.id AS dst FROM u JOIN ids a ON a.v = u.src JOIN ids b ON b.v = u.dst)"
    _add("clean_graph", lambda s, d: clean.cleaned(raw(s, d)), f"{cleaned} SELECT * FROM g")
    _add("validate_graph", lambda s, d: clean.validated(clean.symmetric(raw(s, d))), f"{raw_sql} SELECT (SELECT max(src) + 1 - count(DISTINCT src) FROM s) AS dangling, (SELECT count(*) FROM s WHERE src = dst) AS self_loops, (SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) AS parallel_edges")


def _sampling_queries() -> None:
    q0 = by_name("q0")
    _add("edge_weight_sampled", lambda s, d: motif.sampled_weights(graph(s, d), q0), None)
    kept = lambda v: clean.share_sql(v) + " < 0.4"
    _add("vertex_sample", lambda s, d: clean.sampled_vertices(graph(s, d), 0.4), f"{_ADJ}\nSELECT * FROM adj WHERE {kept('src')} AND {kept('dst')}")
    _add("fennel_partition", lambda s, d: fennel.partitioned(clean.neighbours(graph(s, d)), 4), None)
    _add("label_partition", lambda s, d: partition.by_labels(graph(s, d), 4), None)


def _chosen_queries() -> None:
    """With the vertices of more than the mean degree, and with the ends of all edges as pairs."""

    def hubs(s: SparkSession, d: str) -> DataFrame:
        found = clean.degrees(graph(s, d))
        return found.crossJoin(F.broadcast(found.agg(F.avg("degree").alias("mean")))).where("degree > mean").select("v")

    h = f"{_ADJ}, h AS (SELECT src AS v FROM adj GROUP BY src HAVING count(*) > (SELECT count(*) / count(DISTINCT src) FROM adj))"
    ends = lambda s, d: graph(s, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    _add("induced_subgraph", lambda s, d: clean.induced(graph(s, d), hubs(s, d)), f"{h}\nSELECT * FROM adj WHERE src IN (SELECT v FROM h) AND dst IN (SELECT v FROM h)")
    _add("vertex_rows", lambda s, d: clean.rows_of(graph(s, d), hubs(s, d)), f"{h}\nSELECT * FROM adj WHERE src IN (SELECT v FROM h)")
    _add("batch_intersections", lambda s, d: match.batch_intersections(ends(s, d), clean.neighbours(graph(s, d))).select("a", "b", F.size("n").alias("n")), _COMMON)


def _stored_lines(rows: DataFrame, name: str, by: list[str]) -> str:
    """Path of a folder of text files with the column value in the order of by."""
    path = new_path(rows.sparkSession, name)
    rows.orderBy(*by).select("value").write.text(path)
    return path


def _file_queries() -> None:
    """Files written from the tables and read back."""
    raw = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    text = lambda s, d: raw(s, d).withColumn("value", F.concat_ws("\t", "a", "b"))
    r = "r AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem), low AS (SELECT least(min(a), min(b)) AS x FROM r), t AS (SELECT a - x AS src, b - x AS dst FROM r, low)"
    _add("edge_list_directed", lambda s, d: graphs.read_graph(s, _stored_lines(text(s, d), "list", ["a", "b"]), True, "txt"), f"WITH {r} SELECT src, dst FROM t")
    _add("edge_list_undirected", lambda s, d: graphs.read_graph(s, _stored_lines(text(s, d), "list", ["a", "b"]), False, "txt"), f"WITH {r} SELECT src, dst FROM t UNION ALL SELECT dst, src FROM t")

    big = "100000000000000000000"
    large = lambda s, d: _stored_lines(raw(s, d).withColumn("value", F.format_string(f"{big[:-9]}%09d,{big[:-9]}%09d", F.col("a"), F.col("b") + 500_000_000)), "large", ["a", "b"])
    seen = "o AS (SELECT l_partkey AS a, l_suppkey + 500000000 AS b, row_number() OVER (ORDER BY l_partkey, l_suppkey) AS n FROM lineitem), k AS (SELECT a AS t, 2 * n AS p FROM o UNION ALL SELECT b, 2 * n + 1 FROM o), i AS (SELECT t, row_number() OVER (ORDER BY min(p)) - 1 AS id FROM k GROUP BY t)"
    _add("large_ids", lambda s, d: graphs.read_graph(s, large(s, d), True, "lvid"), f"WITH {seen} SELECT x.id AS src, y.id AS dst FROM o JOIN i x ON x.t = o.a JOIN i y ON y.t = o.b")

    cut = lambda s, d: _stored_lines(text(s, d).withColumn("value", F.concat_ws(" ", F.lit("x"), "a", F.lit("y,"), "b")), "dirty", ["a", "b"])
    pairs = "SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1 AS pair, "
    _add("clean_lines", lambda s, d: graphs.clean_lines(s, cut(s, d))[0], f"{pairs} CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem")
    _add("clean_lines_rest", lambda s, d: graphs.clean_lines(s, cut(s, d))[1], f"{pairs} 'x' AS a, 'y' AS b FROM lineitem")

    rows = lambda s, d: clean.neighbours(graph(s, d)).select("v", F.concat_ws(" ", F.col("v").cast("string"), F.size("n").cast("string"), F.concat_ws(" ", F.col("n").cast("array<string>"))).alias("value"))
    half = lambda s, d, odd: _stored_lines(rows(s, d).where(F.col("v") % 2 == odd), "adjacency", ["v"])
    _add("adjacency_lists", lambda s, d: graphs.read_graph(s, _stored_lines(rows(s, d), "adjacency", ["v"]), True, "adj"), f"{_ADJ} SELECT src, dst FROM adj")
    _add("adjacency_lists_of_two_files", lambda s, d: graphs.read_adjacency(s, f"{half(s, d, 0)},{half(s, d, 1)}"), f"{_ADJ} SELECT src, dst FROM adj")

    def binary(s: SparkSession, d: str) -> DataFrame:
        path = new_path(s, "graph")
        graphs.write_graph(clean.relabelled(graph(s, d)), path, "bin")
        return graphs.read_graph(s, f"{path}.bin")

    ids = "ids AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT DISTINCT src AS v FROM adj))"
    _add("binary_graph", binary, f"{_ADJ}, {ids} SELECT x.id AS src, y.id AS dst FROM adj JOIN ids x ON x.v = src JOIN ids y ON y.v = dst")

    def part_file(s: SparkSession, d: str) -> DataFrame:
        own = clean.relabelled(graph(s, d))
        lines = parts_of(own).select("v", F.col("pid").cast("string").alias("value"))
        return graphs.read_parts(s, _stored_lines(lines, "parts", ["v"]), 4)

    _add("part_file", part_file, f"{_ADJ}, {ids} SELECT id AS v, CAST(id % 4 AS INTEGER) AS pid FROM ids")

    def text_sink(s: SparkSession, d: str) -> DataFrame:
        path = new_path(s, "graph")
        graphs.write_graph(graph(s, d), path, "txt")
        return graphs.raw_edges(s, f"{path}.snap.txt")

    _add("text_sink", text_sink, f"{_ADJ} SELECT src, dst FROM adj WHERE src < dst")
    _add("in_memory_graph", lambda s, d: graphs.in_memory(s, {0: [1, 2], 1: [0], 2: [0]}), "SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM (VALUES (0, 1), (0, 2), (1, 0), (2, 0)) t(a, b)")
    named = [(p.name, graphs.weight_path("g", k, p.name)) for p in [*CATALOGUE.values()][:12] for k in ("motifcut", "weight", "veweight")] + [("line", "g.weight.uniform")]
    _add("weight_files", lambda s, d: s.createDataFrame([(p.name, graphs.weight_path("g", k, p.name)) for p in [*CATALOGUE.values()][:12] for k in ("motifcut", "weight", "veweight")] + [("line", graphs.weight_path("g", "weight", "line"))], "pattern string, path string"), f"SELECT * FROM (VALUES {', '.join(map(str, named))}) t(pattern, path)")
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    first = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.struct(*order.split(", ")).alias("ordinal"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    _add("first_edges", lambda s, d: graphs_first(first(s, d)), f"SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem ORDER BY {order} LIMIT 1000")


def graphs_first(edges: DataFrame) -> DataFrame:
    """The first thousand edges, as a truncated file has them."""
    return clean.first_edges(edges, 1000).select("src", "dst")


_counts()
_graph_queries()
_raw_queries()
_sampling_queries()
_chosen_queries()
_file_queries()
