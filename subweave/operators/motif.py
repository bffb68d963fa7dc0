"""Weights of edges by the matches that use them, exact and sampled, and the rows of partitioners' input files."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave.operators.clean import neighbours
from subweave.operators.match import instances
from subweave.plans.pattern import Pattern
from subweave.store import stored

#: Walks from each vertex, and the chance that a walk ends after a step.
WALKS, STOP = 10_240, 0.1
#: Edges of a graph that is sent to all tasks at most (4 bytes each; where matches are no triangles, a task needs 40), and walks that a task holds at once.
MOST_SENT, MOST_WALKED, HELD = 3 << 24, 1 << 23, 1 << 19
#: Edges of the small components that are sent together.
PART = 1 << 20
#: Steps that are reckoned ahead of the walks, and standard deviations by which fewer are drawn than expected.
AHEAD, MARGIN = 8, 5.0


def edge_weights(adj: DataFrame, pattern: Pattern) -> DataFrame:
    """src, dst, w: how many matches use the edge, in both directions, 0 where none does. A pattern without vertices weighs every edge 1."""
    if not pattern.n:
        return adj.select("src", "dst", F.lit(1).cast("long").alias("w"))
    ends = [F.struct(F.col(f"v{a}").alias("src"), F.col(f"v{b}").alias("dst")) for x, y in pattern.edges for a, b in ((x, y), (y, x))]
    used = instances(adj, pattern).select(F.explode(F.array(*ends)).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("w"))
    return adj.join(used, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0)).alias("w"))


def partitioner_weights(adj: DataFrame, pattern: Pattern) -> DataFrame:
    """src, dst, w: one more than the matches, so that no edge weighs nothing."""
    own = edge_weights(adj, pattern)
    return own if not pattern.n else own.withColumn("w", F.col("w") + 1)


def total_matches(weights: DataFrame, pattern: Pattern) -> DataFrame:
    """One row, n: matches, from exact weights: every match adds one to both directions of each of its edges."""
    return weights.agg(F.coalesce(F.sum("w") / (2 * max(1, len(pattern.edges))), F.lit(0)).cast("long").alias("n"))


def metis_rows(weights: DataFrame, vertex_weights: bool = False) -> DataFrame:
    """v and line: 1-based neighbours with weights, before them the vertex's degree where vertices are weighed too. Vertices are 0.. without gaps."""
    one = F.transform(F.sort_array(F.collect_list(F.struct("dst", "w"))), lambda x: F.concat_ws(" ", (x["dst"] + 1).cast("string"), x["w"].cast("string")))
    line = F.concat_ws(" ", one)
    if vertex_weights:
        line = F.concat_ws(" ", F.count("*").cast("string"), line)
    return weights.groupBy(F.col("src").alias("v")).agg(line.alias("line"))


def metis_header(weights: DataFrame, vertex_weights: bool = False) -> DataFrame:
    """One row, line: vertices, undirected edges, and the format's code."""
    code = "011 1" if vertex_weights else "001"
    n = weights.agg(F.coalesce(F.greatest(F.max("src"), F.max("dst")) + 1, F.lit(0)).alias("v"), (F.count("*") / 2).cast("long").alias("e"))
    return n.select(F.concat_ws(" ", F.col("v").cast("string"), F.col("e").cast("string"), F.lit(code)).alias("line"))


def cut_rows(weights: DataFrame) -> DataFrame:
    """src, dst and line: each direction with its weight."""
    return weights.select("src", "dst", F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("w").cast("string")).alias("line"))


class Walks:
    """Random walks over a graph in memory: vertices 0.., the offsets of their targets, and the targets in ascending order."""

    def __init__(self, offsets: np.ndarray, targets: np.ndarray, pattern: Pattern, stop: float):
        self.offsets, self.targets, self.pattern, self.stop = offsets, targets, pattern, stop
        self.n = len(offsets) - 1
        self.shapes = list(itertools.permutations(range(pattern.n)))

    @cached_property
    def codes(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.offsets)) * self.n + self.targets

    @cached_property
    def back(self) -> np.ndarray:
        """The place of each edge's way back."""
        return np.searchsorted(self.codes, self.codes % self.n * self.n + self.codes // self.n)

    def edge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each edge, and whether it is there."""
        code = a * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return at, self.codes[at] == code

    def tested(self, window: np.ndarray, total: np.ndarray) -> None:
        """Add the edges of all matches among the vertices of each window to total, by place."""
        p = self.pattern
        apart = [(a, b) for a, b in itertools.combinations(range(p.n), 2) if not p.adjacent(a, b)]
        for shape in self.shapes:
            m = window[:, shape]
            good = np.ones(len(m), bool)
            for a, b in p.order:
                good &= m[:, a] < m[:, b]
            for a, b in apart:
                good &= m[:, a] != m[:, b]
            m, places = m[good], []
            for a, b in p.edges:
                at, there = self.edge(m[:, a], m[:, b])
                m, places = m[there], [*(x[there] for x in places), at[there]]
            for at in places:
                np.add.at(total, at, 1)
                np.add.at(total, self.back[at], 1)

    def run(self, starts: np.ndarray, walks: int, rng: np.random.Generator) -> np.ndarray:
        """How often matches in the windows of the walks used each edge. A window has the vertices of the last steps."""
        at = np.repeat(starts, walks)
        total = np.zeros(len(self.targets), np.int64)
        self._walk(at, np.full((len(at), self.pattern.n), -1, np.int64), 0, total, rng)
        return total

    def _walk(self, at: np.ndarray, window: np.ndarray, step: int, total: np.ndarray, rng: np.random.Generator) -> None:
        """Walks that come to at as their next vertex, after as many steps, until all have stopped."""
        size = self.pattern.n
        while len(at):
            window[:, step % size] = at
            step += 1
            if step >= size:
                self.tested(window, total)
            alive = rng.random(len(at)) >= self.stop
            at, window = at[alive], window[alive]
            first = self.offsets[at]
            at = self.targets[first + (rng.random(len(at)) * (self.offsets[at + 1] - first)).astype(np.int64)]


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with most members at most, but one row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def triangles(offsets: np.ndarray, targets: np.ndarray, first: int, end: int) -> Iterator[np.ndarray]:
    """Rows u < v < w of the triangles whose least vertex is one of first..end-1, a bounded number of edges at a time."""
    n = len(offsets) - 1
    for a, b in pieces(np.diff(offsets[first : end + 1]), 1 << 16):
        lo, hi = offsets[first + a], offsets[first + b]
        u, v = np.repeat(np.arange(first + a, first + b), np.diff(offsets[first + a : first + b + 1])), targets[lo:hi].astype(np.int64)
        codes = u * n + v
        u, v = u[u < v], v[u < v]
        for x, y in pieces(offsets[v + 1] - offsets[v], 1 << 21):
            size = offsets[v[x:y] + 1] - offsets[v[x:y]]
            w = targets[np.arange(size.sum()) + np.repeat(offsets[v[x:y]] - (np.cumsum(size) - size), size)]
            at = np.repeat(np.arange(x, y), size)
            at, w = at[w > v[at]], w[w > v[at]].astype(np.int64)
            code = u[at] * n + w
            there = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
            yield np.column_stack([u[at[there]], v[at[there]], w[there]])


class Flows(Walks):
    """The same walks for triangles, all at once: how many walks take each edge, not which.

    Where a walk goes depends on its last vertex alone, and what it meets on the last three. So a walk waits in one of two kinds of
    places: at a vertex, or at the end of an edge that is in a triangle and by which it came. Walks in one place are alike. If each
    place has its own row of lots (to stop, or whither), then how often each is drawn does not depend on the order in which walks
    are moved; lots may even be drawn for walks that are yet to come, as long as no more are drawn than come in the end. So many
    lots are drawn at once, in binomial numbers: as many as are expected, less MARGIN standard deviations. What is missing then is
    owed by the place and paid by walks that come later. This is repeated with what is left, and few walks are walked one by one.
    Each walk stops, goes and is counted with the chances it has one by one. If a place still owes when all have stopped, too many
    lots were drawn there; then all is done again with twice the margin.
    """

    def __init__(self, offsets: np.ndarray, targets: np.ndarray, pattern: Pattern, stop: float, three: np.ndarray | None = None):
        self.offsets, self.targets, self.pattern, self.stop = offsets, targets, pattern, stop
        self.n, self.degree = len(offsets) - 1, np.diff(offsets)
        self.rows = list(pieces(self.degree, 1 << 20))
        if three is None:
            three = np.concatenate([np.empty((0, 3), np.int64), *triangles(offsets, targets, 0, self.n)])
        #: Edges in triangles, by code and by place, each with the place of the way back among them. Walks that came over the way back wait at its source.
        sides = np.concatenate([three[:, q] for q in itertools.permutations(range(3), 2)]).astype(np.int64)
        codes = np.unique(sides[:, 0] * self.n + sides[:, 1])
        self.at, self.came = codes // max(1, self.n), codes % max(1, self.n)
        self.closing = self._places()
        self.reverse = np.searchsorted(codes, self.came * self.n + self.at)
        #: Ways through triangles u, v, w, in order of: the place of v to u, of v to w; and the place of u to w.
        found = []
        for a, b, c in itertools.permutations(range(3)):
            u, v, w = (three[:, k].astype(np.int64) for k in (a, b, c))
            found.append([np.searchsorted(codes, x * self.n + y) for x, y in ((v, u), (v, w), (u, w))])
        vu, vw, uw = (np.concatenate(x) for x in zip(*found, strict=True))
        key = vu * len(codes) + vw
        order = np.argsort(key)
        self.key, self.uw = key[order], uw[order]
        shapes = itertools.permutations(range(3))
        self.ways = sum(all(x[a] < x[b] for a, b in pattern.order) for x in shapes)

    def _places(self) -> np.ndarray:
        """The places of the edges from at to came among all."""
        out = np.empty(len(self.at), np.int64)
        for a, b in self.rows:
            x, y = np.searchsorted(self.at, [a, b])
            lo, hi = self.offsets[a], self.offsets[b]
            codes = np.repeat(np.arange(a, b), self.degree[a:b]) * self.n + self.targets[lo:hi]
            out[x:y] = lo + np.searchsorted(codes, self.at[x:y] * self.n + self.came[x:y])
        return out

    def spread(self, count: np.ndarray, v: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Walks at vertices go to their neighbours: how many over each edge, row by row, and where rows begin."""
        size = self.degree[v]
        begin = np.cumsum(size) - size
        out, left, live = np.zeros(size.sum(), np.int64), count.copy(), np.arange(len(v))
        for j in range(int(size.max(initial=0))):
            live = live[(size[live] > j) & (left[live] > 0)]
            if not len(live):
                break
            gone = rng.binomial(left[live], 1 / (size[live] - j))
            out[begin[live] + j] = gone
            left[live] -= gone
        return out, begin

    def pulled(self, x: np.ndarray) -> np.ndarray:
        """For each vertex the sum over its neighbours."""
        return np.concatenate([np.add.reduceat(x[self.targets[self.offsets[a] : self.offsets[b]]], self.offsets[a:b] - self.offsets[a]) for a, b in self.rows])

    def expected(self, count: np.ndarray) -> np.ndarray:
        """How often walks that are at vertices, less those owed, will be there before they stop: at most the expectation.

        Some steps are reckoned. The rest is at least what comes of the least share of a vertex by its degree, which steps keep.
        """
        go, x = 1 - self.stop, count.astype(float)
        step = x.copy()
        for _ in range(AHEAD):
            step = go * self.pulled(step / self.degree)
            x += step
        return x + max(0.0, (step / self.degree).min()) * self.degree * go / self.stop

    def drawn(self, pool: np.ndarray, own: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """How many lots to draw at each vertex and at each end of an edge in a triangle."""
        go = 1 - self.stop
        share = go * self.expected(pool + np.bincount(self.at, own, self.n)) / self.degree
        over = share[self.came]
        e_pool = pool + self.pulled(share) - np.bincount(self.at, over, self.n)
        # the variance is at most so many times the expectation, by the chance to be back after two steps, which later returns do not exceed
        back = self.pulled(1 / self.degree) / self.degree
        if pool.min() >= 0 and own.min(initial=0) >= 0:
            most = 2 * np.minimum(1 / (1 - go * go), 1 + back * go * go / self.stop) - 1
        else:
            most = np.minimum((1 + go * go) / (1 - go * go) ** 2, 1 + back * (1 / self.stop**2 - 1 - 2 * go))
        less = lambda e, f: np.maximum(0, np.floor(e - margin * np.sqrt(f * np.maximum(e, 0)))).astype(np.int64)
        return less(e_pool, most), less(own + over, 1 + 2 * most[self.came] / self.degree[self.came])

    def _fire(self, draw: np.ndarray, draw_own: np.ndarray, met: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Draw lots: how many walks come to each vertex and over each edge in a triangle. Ways through triangles are added to met."""
        pool, own = np.zeros(self.n, np.int64), np.zeros(len(self.at), np.int64)
        for a, b in self.rows:
            lo, hi = self.offsets[a], self.offsets[b]
            flow = self.spread(rng.binomial(draw[a:b], 1 - self.stop), np.arange(a, b), rng)[0]
            x, y = np.searchsorted(self.at, [a, b])
            used = x + np.flatnonzero(draw_own[x:y])
            for i, j in pieces(self.degree[self.at[used]], 1 << 20):
                e = used[i:j]
                cells, begin = self.spread(rng.binomial(draw_own[e], 1 - self.stop), self.at[e], rng)
                np.add.at(flow, np.arange(len(cells)) + np.repeat(self.offsets[self.at[e]] - lo - begin, self.degree[self.at[e]]), cells)
                p, q = np.searchsorted(self.key, [e[0] * len(self.at), (e[-1] + 1) * len(self.at)])
                vu, vw = np.divmod(self.key[p:q], max(1, len(self.at)))
                row = np.minimum(np.searchsorted(e, vu), len(e) - 1)
                hit = np.flatnonzero(e[row] == vu)
                met[p + hit] += cells[begin[row[hit]] + self.closing[vw[hit]] - self.offsets[self.at[vu[hit]]]]
            own[self.reverse[x:y]] = flow[self.closing[x:y] - lo]
            flow[self.closing[x:y] - lo] = 0
            pool += np.bincount(self.targets[lo:hi], flow, self.n).astype(np.int64)
        return pool, own

    def _rest(self, pool: np.ndarray, own: np.ndarray, met: np.ndarray, rng: np.random.Generator) -> bool:
        """Walk one by one until all have stopped or paid what a place owes; whether nothing is owed then."""
        count = np.concatenate([pool, own])
        owed, spot = np.maximum(-count, 0), np.concatenate([np.arange(self.n), self.at])
        some = np.flatnonzero(count > 0)
        ends = np.cumsum(count[some])
        flag = np.zeros(len(self.targets), bool)
        flag[self.closing] = True
        debts = owed.sum()
        for lo in range(0, int(ends[-1]) if len(ends) else 0, HELD):
            s = some[np.searchsorted(ends, np.arange(lo, min(lo + HELD, ends[-1])), "right")]
            while len(s):
                s = s[rng.random(len(s)) >= self.stop]
                v = spot[s]
                e = self.offsets[v] + (rng.random(len(s)) * self.degree[v]).astype(np.int64)
                to = self.targets[e].astype(np.int64)
                c = np.flatnonzero(flag[e])
                if len(c):
                    out, old = np.searchsorted(self.closing, e[c]), s[c] - self.n
                    key = (old * len(self.at) + out)[old >= 0]
                    way = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                    np.add.at(met, way[self.key[way] == key], 1)
                    to[c] = self.n + self.reverse[out]
                s = to
                if debts and len(at := np.flatnonzero(owed[s])):
                    at = at[np.argsort(s[at], kind="stable")]
                    place, begin, many = np.unique(s[at], return_index=True, return_counts=True)
                    paid = np.minimum(many, owed[place])
                    gone = np.arange(len(at)) - np.repeat(begin, many) < np.repeat(paid, many)
                    owed[place] -= paid
                    debts -= paid.sum()
                    s = np.delete(s, at[gone])
        return not debts

    def run_all(self, walks: int, rng: np.random.Generator, few: int = HELD) -> np.ndarray:
        """As run() from every vertex."""
        total = np.zeros(len(self.targets), np.int64)
        total[self.closing] = self.met(walks, rng, few)
        return total

    def met(self, walks: int, rng: np.random.Generator, few: int = HELD) -> np.ndarray:
        """As run() from every vertex, for the edges in triangles alone, as no match uses another."""
        margin, done = MARGIN, False
        while not done:
            met, pool, own = np.zeros(len(self.key), np.int64), np.full(self.n, walks), np.zeros(len(self.at), np.int64)
            while len(self.key) and (pool.sum() + own.sum()) / self.stop > few:
                draw, draw_own = self.drawn(pool, own, margin)
                if draw.sum() + draw_own.sum() <= 2 * len(self.targets):
                    break
                more, more_own = self._fire(draw, draw_own, met, rng)
                pool, own = pool + more - draw, own + more_own - draw_own
            done, margin = not len(self.key) or self._rest(pool, own, met, rng), 2 * margin
        vu, vw = np.divmod(self.key, max(1, len(self.at)))
        one = sum(np.bincount(e, met, len(self.at)) for e in (vu, vw, self.uw)) if len(met) else np.zeros(len(self.at))
        return self.ways * (one + one[self.reverse]).astype(np.int64)


def is_triangle(pattern: Pattern) -> bool:
    return pattern.n == 3 and len({frozenset(e) for e in pattern.edges}) == 3


def labels(offsets: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """For each vertex the least of those it is connected with."""
    out = np.arange(len(offsets) - 1)
    while True:
        low = np.concatenate([np.minimum.reduceat(out[targets[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a]) for a, b in pieces(np.diff(offsets), 1 << 20)])
        new = np.minimum(out, low)
        np.minimum.at(new, out, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == out).all():
            return out
        out = new


def parts(offsets: np.ndarray, targets: np.ndarray, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The vertices of whole components, together with most edges at most or one component, in ascending order; and the graph of each such part."""
    label, size = labels(offsets, targets), np.diff(offsets)
    order = np.argsort(label, kind="stable")
    begin = np.flatnonzero(np.diff(label[order], prepend=-1))
    ends, local = np.append(begin, len(order)), np.empty(len(label), np.int32)
    for a, b in pieces(np.add.reduceat(size[order], begin), most):
        v = np.sort(order[ends[a] : ends[b]])
        local[v] = np.arange(len(v))
        own = np.concatenate([[0], np.cumsum(size[v])])
        yield v, own, np.concatenate([local[targets[np.arange(own[y] - own[x]) + np.repeat(offsets[v[x:y]] - own[x:y] + own[x], size[v[x:y]])]] for x, y in pieces(size[v], 1 << 20)])


def _flown(sent: list, pattern: Pattern, walks: int, stop: float, seed: int, whole: bool) -> Callable:
    """Shares of the walks over parts. whole: all edges of a part are returned, also those that are not met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (ids, offsets, targets), three = sent[part][0].value, sent[part][1]
                own = Flows(offsets, targets, pattern, stop, three and three.value)
                w = own.met(walks // shares + (nth < walks % shares), np.random.default_rng((seed, part, nth)))
                used = np.flatnonzero(w)
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own.at[used]]), pa.array(ids[own.came[used]]), pa.array(w[used])], names=["src", "dst", "w"])
                    continue
                for a, b in pieces(own.degree, 1 << 18):
                    lo, hi = offsets[a], offsets[b]
                    x, y = np.searchsorted(own.at, [a, b])
                    total = np.zeros(hi - lo, np.int64)
                    total[own.closing[x:y] - lo] = w[x:y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], own.degree[a:b])), pa.array(ids[targets[lo:hi]]), pa.array(total)], names=["src", "dst", "w"])

    return run


def _found(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for own in triangles(*sent.value[1:], first, end):
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, k].astype(np.int32)) for k in range(3)], names=["u", "v", "w"])

    return run


def _packed(sent) -> Callable:
    """Neighbour lists of a batch as numbers of four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [np.searchsorted(sent.value, x.to_numpy()).astype(np.int32).tobytes() for x in (batch.column(0), batch.column(1).flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], names=["v", "n"])

    return run


def _in_arrays(adj: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices in ascending order, the offsets of their targets, and the targets as places among the vertices."""
    spark, lists = adj.sparkSession, neighbours(adj)
    sizes = lists.select("v", F.size("n").alias("size")).toArrow()
    order = np.argsort(sizes.column("v").to_numpy())
    ids, size = sizes.column("v").to_numpy()[order], sizes.column("size").to_numpy()[order].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    targets = np.empty(offsets[-1], np.int32)
    numbers = spark.sparkContext.broadcast(ids)
    for batch in lists.mapInArrow(_packed(numbers), "v binary, n binary").toArrow().to_batches():
        for v, n in zip(*batch.columns, strict=True):
            v, n = (np.frombuffer(x.as_buffer(), np.int32) for x in (v, n))
            targets[np.arange(len(n)) + np.repeat(offsets[v] - (np.cumsum(size[v]) - size[v]), size[v])] = n
    return ids, offsets, targets


def _dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One row a task."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)


def _flows(adj: DataFrame, pattern: Pattern, walks: int, stop: float, seed: int, most: int = PART) -> DataFrame:
    """src, dst, w for triangles: parts of whole components, as no walk leaves its component, are sent to the tasks.

    Where a part has a large share of all edges, each task has a share of the walks of each of its vertices.
    """
    spark = adj.sparkSession
    ids, offsets, targets = _in_arrays(adj)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, walks))
    sent, rows = [], []
    for v, own, to in parts(offsets, targets, most):
        graph, three, shares = spark.sparkContext.broadcast((ids[v], own, to)), None, tasks if 2 * tasks * len(to) > len(targets) else 1
        if shares > 1:
            cuts = np.unique(np.searchsorted(own, np.linspace(0, len(to), 8 * tasks + 1).astype(np.int64))).tolist()
            found = _dealt(spark, list(itertools.pairwise(cuts)), "first long, end long").mapInArrow(_found(graph), "u int, v int, w int").toArrow()
            three = spark.sparkContext.broadcast(np.column_stack([c.to_numpy() for c in found.columns]))
        rows += [(len(sent), nth, shares) for nth in range(shares)]
        sent.append((graph, three))
    whole = len(rows) == len(sent)
    got = _dealt(spark, rows, "part long, nth long, shares long").mapInArrow(_flown(sent, pattern, walks, stop, seed, whole), "src long, dst long, w long")
    return got if whole else _with_unused(adj, got)


def _walked(sent, pattern: Pattern, walks: int, stop: float, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, targets = sent.value
        own, step = Walks(offsets, targets, pattern, stop), max(1, HELD // walks)
        for batch in batches:
            v = batch.column(0).to_numpy()
            for lo in range(0, len(v), step):
                total = own.run(v[lo : lo + step], walks, np.random.default_rng((seed, int(v[lo]))))
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own.codes[used] // own.n]), pa.array(ids[targets[used]]), pa.array(total[used])], names=["src", "dst", "w"])

    return run


def _sent_walks(adj: DataFrame, pattern: Pattern, walks: int, stop: float, seed: int) -> DataFrame:
    """Walks of a graph that is sent to all tasks."""
    spark = adj.sparkSession
    edges = adj.select("src", "dst").toArrow()
    ids, flat = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    src, dst = flat[: len(edges)], flat[len(edges) :]
    order = np.lexsort((dst, src))
    sent = spark.sparkContext.broadcast((ids, np.searchsorted(src[order], np.arange(len(ids) + 1)), dst[order]))
    tasks = max(spark.sparkContext.defaultParallelism, len(ids) * walks // (1 << 23))
    return spark.range(0, len(ids), 1, tasks).mapInArrow(_walked(sent, pattern, walks, stop, seed), "src long, dst long, w long")


def _joined_walks(adj: DataFrame, pattern: Pattern, walks: int, stop: float, seed: int) -> DataFrame:
    """Walks that take each step by a join with the neighbour lists."""
    lists, n = stored(neighbours(adj), "lists"), pattern.n
    state = lists.select("v", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("nth"))
    state = state.select(F.xxhash64(F.lit(seed), "v", "nth").alias("walk"), F.array("v").alias("window"))
    luck = lambda k, kind, below: F.pmod(F.xxhash64("walk", F.lit(k), F.lit(kind)), below)
    found, k = [], 0
    while state.limit(1).count():
        if k >= n - 1:
            found.append(stored(_used(adj, pattern, state), "used"))
        k += 1
        alive = state.where(luck(k, 1, F.lit(1 << 20)) >= int(stop * (1 << 20)))
        moved = alive.join(lists, F.element_at("window", -1) == F.col("v"))
        target = F.get("n", luck(k, 2, F.size("n")).cast("int"))
        kept = F.slice("window", F.greatest(F.lit(1), F.size("window") - n + 2), n - 1)
        state = stored(moved.select("walk", F.concat(kept, F.array(target)).alias("window")), "walks")
    return reduce(DataFrame.unionAll, found, adj.where("false").select("src", "dst", F.lit(0).cast("long").alias("w")))


def _used(adj: DataFrame, pattern: Pattern, state: DataFrame) -> DataFrame:
    """The edges of all matches among the vertices of each window."""
    shapes = [F.array(*(F.get("window", F.lit(i)) for i in p)) for p in itertools.permutations(range(pattern.n))]
    rows = state.select(F.explode(F.array(*shapes)).alias("m")).select(*(F.get("m", F.lit(u)).alias(f"v{u}") for u in range(pattern.n)))
    for a, b in itertools.combinations(range(pattern.n), 2):
        if r := pattern.relation(a, b):
            rows = rows.where(f"v{a} {r} v{b}")
    for a, b in pattern.edges:
        rows = rows.join(adj.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}")), [f"v{a}", f"v{b}"], "left_semi")
    ends = [F.struct(F.col(f"v{a}").alias("src"), F.col(f"v{b}").alias("dst")) for x, y in pattern.edges for a, b in ((x, y), (y, x))]
    return rows.select(F.explode(F.array(*ends)).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("w"))


def sampled_weights(adj: DataFrame, pattern: Pattern, walks: int = WALKS, stop: float = STOP, seed: int = 0, most_sent: int = MOST_SENT) -> DataFrame:
    """src, dst, w: how often random walks from every vertex met a match that uses the edge, among the vertices of their last steps.

    A graph of up to most_sent edges is sent to the tasks, which walk in memory; over a larger one, steps are joins.
    """
    n = adj.count()
    if n and n <= most_sent and is_triangle(pattern):
        return _flows(adj, pattern, walks, stop, seed)
    walked = _sent_walks if n <= min(most_sent, MOST_WALKED) else _joined_walks
    return _with_unused(adj, walked(adj, pattern, walks, stop, seed))


def _with_unused(adj: DataFrame, walked: DataFrame) -> DataFrame:
    """The sums of w, and 0 for the other edges."""
    used = walked.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return adj.join(used, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0)).alias("w"))
