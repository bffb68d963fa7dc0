import pytest

from subweave.llm import hot


@pytest.mark.parametrize("share", [2, 1000])
def test_every_row_meets_its_key_once(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "SHARE", share)
    rows = [(i, "a" if i % 3 else f"k{i % 10}" if i % 2 else None) for i in range(200)]
    own = {"a": 1, "k3": 2, "k9": 3, "unused": 4}
    left = spark.createDataFrame(rows, "i long, k string")
    got = hot.unique_join(left, spark.createDataFrame(list(own.items()), "k string, x long"), "k").collect()
    assert sorted((r["i"], str(r["k"]), r["x"]) for r in got) == sorted((i, str(k), own.get(k)) for i, k in rows)


def test_empty_tables(spark):
    left, right = spark.createDataFrame([], "i long, k string"), spark.createDataFrame([], "k string, x long")
    assert hot.unique_join(left, right, "k").collect() == []
    assert [tuple(r) for r in hot.unique_join(spark.createDataFrame([(1, "a"), (2, None)], "i long, k string"), right, "k").orderBy("i").collect()] == [(1, "a", None), (2, None, None)]
