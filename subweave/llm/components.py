"""Connected components of a graph given as a table of edges.

Each task contracts its edges, a million at a time, to stars around the smallest node of each component it sees. What several
tasks know of a node is then brought together: a node's roots hook onto the smallest of them, and every node moves on to its
root's root. No edge is added, so rounds go on until one task sees all edges that are left or nothing moves. Roots that many nodes
have are sent to all tasks instead of being joined in one. Only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from subweave.llm.hot import unique_join
from subweave.store import stored

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def stars(hi: pa.Array, lo: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Every node but the smallest of each component, and that smallest one."""
    both = pa.concat_arrays([hi, lo]).dictionary_encode()
    names = both.dictionary.take(pc.sort_indices(both.dictionary))
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(both.dictionary).to_numpy()] = np.arange(len(names))
    codes = rank[both.indices.to_numpy()]
    a, b, label = codes[: len(hi)], codes[len(hi) :], np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(label)))
    return names.take(pa.array(own)), names.take(pa.array(label[own]))


def _contracted(chunk: int) -> Callable:
    """The stars of each chunk of edges, with the chunk's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

        def sent() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            hi, lo = stars(*(table.column(c).combine_chunks() for c in ("hi", "lo")))
            return pa.RecordBatch.from_arrays([hi, lo, pa.array([(part << 24) + nth] * len(hi), pa.int64())], names=["hi", "lo", "chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                held.append(batch.slice(at, chunk))
                n += held[-1].num_rows
                if n >= chunk:
                    yield sent()
                    nth, held, n = nth + 1, [], 0
        if n:
            yield sent()

    return run


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node and root (the smallest node it is connected with, itself included) for every node on an edge (a, b).

    Edges with a null end or from a node to itself say nothing; repeated edges count once. No edges: no rows.
    """
    cut = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    schema = StructType([*cut.schema, StructField("chunk", LongType())])
    while True:
        # as many tasks as there are chunks; few edges meet in one
        cut = stored(cut, "edges")
        cut = stored(cut.coalesce(math.ceil(max(1, cut.count()) / chunk)).mapInArrow(_contracted(chunk), schema), "stars")
        ends = cut.agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).first()
        if ends["a"] == ends["b"]:
            break
        # a node has at most one root for each chunk
        first = stored(cut.groupBy("hi").agg(F.min("lo").alias("root"), F.collect_set("lo").alias("all")), "roots")
        own = first.select("hi", F.col("root").alias("lo"), F.lit(False).alias("moved"))
        hooked = first.select(F.explode(F.array_remove("all", F.col("root"))).alias("hi"), F.col("root").alias("lo"), F.lit(True).alias("moved"))
        above = first.select(F.col("hi").alias("lo"), F.col("root").alias("above"))
        jumped = unique_join(stored(own.unionAll(hooked), "hooked"), above, "lo")
        cut = stored(jumped.select("hi", F.coalesce("above", "lo").alias("lo"), (F.col("moved") | F.col("above").isNotNull()).cast(BooleanType()).alias("moved")), "jumped")
        if not cut.where("moved").limit(1).count():
            break
        cut = cut.where("hi <> lo").select("hi", "lo").distinct()
    return cut.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(cut.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
