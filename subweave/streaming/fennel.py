"""One-pass graph partitioning: each vertex goes, as it comes, where its earlier neighbours are and room is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The exponent of a part's cost, and how much fuller than even a part may be.
GAMMA, SLACK = 1.5, 1.1


class Fennel:
    """The state of one pass: where every vertex went and how full the parts are."""

    def __init__(self, n_vertices: int, n_edges: int, k: int):
        self.k, self.load = k, np.zeros(k)
        self.alpha = k**0.5 * n_edges / max(1, n_vertices) ** GAMMA
        self.most = SLACK * n_vertices / k
        self.place: dict[int, int] = {}

    def put(self, v: int, near: Iterable[int]) -> int:
        """The part of most earlier neighbours against the cost of making it fuller; of equals the lowest. Full parts are left out."""
        score = -self.alpha * ((self.load + 1) ** GAMMA - self.load**GAMMA)
        for u in near:
            if (p := self.place.get(u)) is not None:
                score[p] += 1
        score[self.load > self.most] = -np.inf
        pid = int(np.argmax(score)) if np.isfinite(score).any() else int(np.argmin(self.load))
        self.load[pid] += 1
        self.place[v] = pid
        return pid


def partitioned(lists: DataFrame, k: int) -> DataFrame:
    """part (v, pid) from lists (v, n) in ascending order of v.

    The pass is sequential by its definition and holds every vertex's part, so it runs in one task; for graphs that are
    too large for that, operators.partition.by_labels does without.
    """
    from pyspark.sql import functions as F

    size = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("n")), F.lit(0)).alias("m")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Fennel(size["n"], size["m"] // 2, k)
        for batch in batches:
            v = batch.column("v").to_pylist()
            pid = [state.put(x, near) for x, near in zip(v, batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(pid, pa.int32())], names=["v", "pid"])

    return lists.select("v", "n").coalesce(1).sortWithinPartitions("v").mapInArrow(run, "v long, pid int")
