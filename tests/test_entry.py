"""The driver's contract for the graph queries."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from subweave import queries

SF = "/root/testdata/sf0.001"
SOME = ["q0_triangle", "q5_quad_triangle_lazy", "q9_three_triangle_reuse", "q3_instances", "intra_inter_q0", "edge_weight_triangle", "partition_stats", "clean_graph", "csr_offsets"]


def test_names():
    found = entry_module.queries()
    assert set(queries.QUERIES) <= set(found)
    assert set(entry_module.oracle_sql()) <= set(found)


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["n"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    found = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()) == want
