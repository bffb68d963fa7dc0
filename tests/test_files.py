"""The registered queries over files against their SQL."""

import os

import duckdb
import pytest

from subweave import queries

SF = "/root/testdata/sf0.001"
NAMES = [
    "edge_list_directed", "edge_list_undirected", "large_ids", "clean_lines", "clean_lines_rest", "adjacency_lists", "adjacency_lists_of_two_files", "binary_graph",
    "part_file", "text_sink", "in_memory_graph", "weight_files", "first_edges", "vertex_sample", "induced_subgraph", "vertex_rows", "batch_intersections", "edge_intersections",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    found = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    assert want
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()) == want
