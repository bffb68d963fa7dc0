"""Matching in blocks: each task has the lists of a block of vertices and of all their neighbours, and matches there in memory.

Shuffled partial matches need room in proportion to their number, which for open shapes (squares) is far above the graph's size.
Here only neighbour lists are shuffled, each to the blocks in which it has a neighbour or its vertex. That suffices for patterns
with a centre: a vertex such that every edge of the pattern has an end that is the centre or next to it. A match belongs to the
block of its centre. Rows of partial matches are grown depth first, a bounded number at a time, and never leave the task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.operators.clean import neighbours
from subweave.plans import planner
from subweave.plans.pattern import Pattern
from subweave.store import stored

#: Neighbours listed in a block, those in its lists and its neighbours' lists at most, blocks at most (then lists are longer), and rows that a task grows at once.
BLOCK, HELD, MOST_BLOCKS, STEP = 1 << 19, 1 << 24, 1 << 14, 1 << 20

Rows = dict[int, np.ndarray]


def is_centre(pattern: Pattern, c: int) -> bool:
    near = {c, *pattern.neighbours(c)}
    return all(a in near or b in near for a, b in pattern.edges)


def order_of(pattern: Pattern) -> tuple[int, ...]:
    """A connected order from a centre on that closes cycles as soon as it can."""
    out = [max((u for u in range(pattern.n) if is_centre(pattern, u)), key=lambda u: (len(pattern.neighbours(u)), -u))]
    while len(out) < pattern.n:
        rest = [u for u in range(pattern.n) if u not in out]
        out.append(max(rest, key=lambda u: (len(pattern.neighbours(u) & set(out)), len(pattern.neighbours(u)), -u)))
    return tuple(out)


def has_centre(pattern: Pattern) -> bool:
    return any(is_centre(pattern, c) for c in range(pattern.n))


def twins(pattern: Pattern) -> tuple[int, int] | None:
    """Two vertices (a, b) with the same candidates, whatever the others are: not adjacent, with the same neighbours and conditions."""
    for a, b in itertools.combinations(range(pattern.n), 2):
        others = [u for u in range(pattern.n) if u not in (a, b)]
        same = all(pattern.relation(a, u) == pattern.relation(b, u) for u in others)
        if same and not pattern.adjacent(a, b) and pattern.neighbours(a) == pattern.neighbours(b):
            return a, b
    return None


class Block:
    """The graph that one task sees, under local ids in the order of ids: targets of each vertex in ascending order, as codes src * n + dst.

    own: the block's vertices. part: of every vertex, where ids have it.
    """

    def __init__(self, pattern: Pattern, number: int, cuts: np.ndarray, v: np.ndarray, degree: np.ndarray, flat: np.ndarray, k: int):
        self.pattern = pattern
        self.ids = np.unique(np.concatenate((v, flat)))
        self.n = len(self.ids)
        source = np.searchsorted(self.ids, v)
        self.codes = np.repeat(source, degree) * self.n + np.searchsorted(self.ids, flat)
        self.codes.sort()
        self.targets = self.codes % self.n
        self.offsets = np.searchsorted(self.codes, np.arange(self.n + 1) * self.n)
        self.own = np.searchsorted(cuts, self.ids, "right") == number
        self.part = self.ids % k

    def place(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each edge from a vertex whose list is here, and whether it is there."""
        code = a * self.n + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return at, self.codes[at] == code

    def _next(self, rows: Rows, todo: tuple[int, ...], centre: int) -> tuple[int, list[int], list[int]]:
        """The first vertex to come in beside one whose list is here; those, and its other neighbours in the rows."""
        for u in todo:
            near = [w for w in rows if self.pattern.adjacent(u, w)]
            listed = [w for w in near if w == centre or self.pattern.adjacent(w, centre)]
            if listed:
                return u, listed, [w for w in near if w not in listed]
        raise AssertionError(f"{todo} have no neighbour with a list around {centre}")

    def grown(self, rows: Rows, todo: tuple[int, ...], centre: int, same: frozenset = frozenset()) -> Iterator[Rows]:
        """The rows with all vertices of todo, in pieces. same: pairs of vertices that must lie in one part."""
        if not todo:
            yield rows
            return
        u, listed, others = self._next(rows, todo, centre)
        rest = tuple(w for w in todo if w != u)
        lists = np.stack([rows[w] for w in listed])
        if len(listed) > 1:  # grow from the shortest list, look up in the others
            size = self.offsets[lists + 1] - self.offsets[lists]
            lists = np.take_along_axis(lists, np.argsort(size, axis=0, kind="stable"), axis=0)
        above = [rows[w] for w in rows if self.pattern.relation(u, w) == ">"]
        below = [rows[w] for w in rows if self.pattern.relation(u, w) == "<"]
        first, last = self.offsets[lists[0]], self.offsets[lists[0] + 1]
        if above:
            first = np.searchsorted(self.codes, lists[0] * self.n + np.max(above, axis=0) + 1)
        if below:
            last = np.searchsorted(self.codes, lists[0] * self.n + np.min(below, axis=0))
        count = np.maximum(last - first, 0)
        ends = np.cumsum(count)
        lo = 0
        while lo < len(count):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + STEP, "right")))
            nth = np.repeat(np.arange(lo, hi), count[lo:hi])
            new = self.targets[np.arange(len(nth)) + np.repeat(first[lo:hi] - (ends[lo:hi] - count[lo:hi] - done), count[lo:hi])]
            lo = hi
            if u == centre:
                good = self.own[new]
                nth, new = nth[good], new[good]
            for w in rows:
                if self.pattern.relation(u, w) == "<>":
                    good = new != rows[w][nth]
                    nth, new = nth[good], new[good]
                if frozenset((u, w)) in same:
                    good = self.part[new] == self.part[rows[w][nth]]
                    nth, new = nth[good], new[good]
            for other in lists[1:]:
                good = self.place(other[nth], new)[1]
                nth, new = nth[good], new[good]
            for w in others:  # u's own list is here, as one end of each edge has one
                good = self.place(new, rows[w][nth])[1]
                nth, new = nth[good], new[good]
            if len(new):
                yield from self.grown({**{w: x[nth] for w, x in rows.items()}, u: new}, rest, centre, same)

    def matches(self) -> Iterator[Rows]:
        """All matches of the block, in pieces."""
        first, *rest = order_of(self.pattern)
        yield from self.grown({first: np.flatnonzero(self.own)}, tuple(rest), first)

    def _starts(self) -> Iterator[np.ndarray]:
        """The block's vertices, those together whose neighbours' lists have some STEP members."""
        v = np.flatnonzero(self.own)
        below = np.concatenate(([0], np.cumsum((self.offsets[1:] - self.offsets[:-1])[self.targets])))
        ends = np.cumsum(below[self.offsets[v + 1]] - below[self.offsets[v]])
        lo = 0
        while lo < len(v):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
            yield v[lo:hi]
            lo = hi

    def paired(self, a: int, b: int) -> Iterator[tuple[Rows, np.ndarray, np.ndarray]]:
        """Matches of the pattern without b as rows; for each row a number for its vertices but a, and how many rows have that number.

        a and b are twins: the vertices that rows with one number have at a are the intersection from which both are picked.
        """
        p = self.pattern
        renamed = {u: i for i, u in enumerate(u for u in range(p.n) if u != b)}
        own = lambda pairs: tuple((renamed[x], renamed[y]) for x, y in pairs if b not in (x, y))
        rest = replace(p, n=p.n - 1, edges=own(p.edges), order=own(p.order))
        back = {i: u for u, i in renamed.items()}
        centre, *todo = (u for u in _order_but(rest, renamed[a]))
        inner = Block.__new__(Block)
        inner.__dict__ = {**self.__dict__, "pattern": rest}
        for start in self._starts():
            pieces = list(inner.grown({centre: start}, tuple(todo), centre))
            if not pieces:
                continue
            rows = {back[u]: np.concatenate([x[u] for x in pieces]) for u in range(rest.n)}
            key = None
            for u in (u for u in rows if u != a):
                key = rows[u] if key is None else _numbers(key)[0] * self.n + rows[u]
            number, size = _numbers(key)
            yield rows, number, size

    def n_matches(self, closed: bool) -> int:
        """closed: count pairs of twins by the size of their intersection."""
        own = twins(self.pattern) if closed else None
        if not own:
            return sum(len(rows[0]) for rows in self.matches())
        return sum(self._picked(own, size) for _, _, size in self.paired(*own))

    def _picked(self, own: tuple[int, int], size: np.ndarray) -> int:
        """Ways to pick twins from intersections of these sizes."""
        ways = size * (size - 1)
        return int(ways.sum()) // (2 if self.pattern.relation(*own) in ("<", ">") else 1)

    def n_crossing(self) -> int:
        """Matches of a pattern with twins that do not lie in one part: all of them less those whose vertices have one part."""
        own, n = twins(self.pattern), 0
        for rows, number, size in self.paired(*own):
            parts = np.stack([self.part[x] for x in rows.values()])
            inside = np.bincount(number[(parts == parts[0]).all(axis=0)], minlength=len(size))
            n += self._picked(own, size) - self._picked(own, inside)
        return n

    def weights(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lesser end, greater end and number of matches that use the edge, within the block."""
        total, own, p = np.zeros(len(self.codes), np.int64), twins(self.pattern), self.pattern
        centre = order_of(p)[0]

        def add(rows: Rows, x: int, y: int, n: np.ndarray | int) -> None:
            a, b = (x, y) if x == centre or p.adjacent(x, centre) else (y, x)
            np.add.at(total, self.place(rows[a], rows[b])[0], n)

        if own and is_centre(p, centre := _order_but(p, own[0])[0]):
            a, b = own
            once = 1 if p.relation(a, b) in ("<", ">") else 2
            for rows, number, size in self.paired(a, b):
                kept = size[number] > 1
                rows, number = {u: x[kept] for u, x in rows.items()}, number[kept]
                first = np.unique(number, return_index=True)[1]
                for x, y in p.edges:
                    if b in (x, y):
                        continue
                    if a in (x, y):
                        add(rows, x, y, once * (size[number] - 1))
                    else:
                        add({u: z[first] for u, z in rows.items()}, x, y, once * size[number[first]] * (size[number[first]] - 1) // 2)
        else:
            for rows in self.matches():
                for x, y in p.edges:
                    add(rows, x, y, 1)
        used = np.flatnonzero(total)
        a, b = self.codes[used] // self.n, self.targets[used]
        code, at = np.unique(np.minimum(a, b) * self.n + np.maximum(a, b), return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, at, total[used])
        yield self.ids[code // self.n], self.ids[code % self.n], n

    def _crossing(self, order: tuple[int, ...], centre: int) -> Rows:
        """The edges across parts for the order's first two vertices."""
        a, b = order[:2]
        if a != centre and not self.pattern.adjacent(a, centre):
            a, b = b, a
        source = np.repeat(np.arange(self.n), np.diff(self.offsets))
        good = self.part[source] != self.part[self.targets]
        for u, x in ((a, source), (b, self.targets)):
            if u == centre:
                good &= self.own[x]
        r = self.pattern.relation(a, b)
        if r in ("<", ">"):
            good &= source < self.targets if r == "<" else source > self.targets
        return {a: source[good], b: self.targets[good]}

    def from_crossing(self, share: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ends of the edges across parts, for each match the smallest of its own, from which it is grown.

        There is an order for each edge of the pattern; those that begin alike share the rows of what is alike.
        """
        p = self.pattern
        orders = list(planner.seeded_orders(p).values())
        share = share and all(is_centre(p, o[0]) for o in orders)
        groups = planner.shared_prefixes(p, orders) if share else {o: [o] for o in orders}
        for prefix, own in groups.items():
            first, k = own[0], len(prefix) if len(own) > 1 else 2
            centre = next(u for u in first if is_centre(p, u))
            for shared in self.grown(self._crossing(first, centre), first[2:k], centre):
                for order in own:
                    rows = {u: shared[w] for u, w in zip(order[:k], first[:k], strict=True)}
                    for whole in self.grown(rows, order[k:], next(u for u in order if is_centre(p, u))):
                        yield self._at_smallest(whole, order)

    def _at_smallest(self, rows: Rows, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        code = lambda a, b: np.minimum(rows[a], rows[b]) * self.n + np.maximum(rows[a], rows[b])
        none = np.iinfo(np.int64).max
        least = np.min([np.where(self.part[rows[a]] != self.part[rows[b]], code(a, b), none) for a, b in self.pattern.edges], axis=0)
        seed = least[least == code(*order[:2])]
        return seed // self.n, seed % self.n

    def n_first_crossing(self) -> int:
        """Matches across parts, each at the first edge of the pattern that crosses in it: those before lie within parts."""
        n = 0
        for i, (_, order) in enumerate(planner.seeded_orders(self.pattern).items()):
            same = frozenset(map(frozenset, self.pattern.edges[:i]))
            centre = next(u for u in order if is_centre(self.pattern, u))
            rows = self._crossing(order, centre)
            if frozenset(order[:2]) not in same:
                n += sum(len(x[0]) for x in self.grown(rows, order[2:], centre, same))
        return n


def _order_but(pattern: Pattern, last: int) -> tuple[int, ...]:
    """An order whose first vertex is a centre other than the given vertex."""
    first = next(u for u in range(pattern.n) if u != last and is_centre(pattern, u))
    out = [first]
    while len(out) < pattern.n:
        rest = [u for u in range(pattern.n) if u not in out and pattern.neighbours(u) & set(out)]
        out.append(max(rest, key=lambda u: (len(pattern.neighbours(u) & set(out)), -u)))
    return tuple(out)


def _numbers(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key a number from 0, and how many keys have each number."""
    _, number, size = np.unique(key, return_inverse=True, return_counts=True)
    return number, size


def _rows_of(batch: pa.RecordBatch, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, offsets and members of the lists in a batch, and the blocks they are needed in: block and row."""
    v, lists = batch.column(0).to_numpy(), batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
    nth = np.repeat(np.arange(len(v)), np.diff(offsets))
    key = np.concatenate((np.searchsorted(cuts, v, "right") * len(v) + np.arange(len(v)), np.searchsorted(cuts, flat, "right") * len(v) + nth))
    key = np.unique(key)
    return v, offsets, flat, key // max(1, len(v)), key % max(1, len(v))


def _sized(cuts: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            _, offsets, _, block, row = _rows_of(batch, cuts)
            np.add.at(total, block, np.diff(offsets)[row])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["block", "members"])

    return run


def _dealt(cuts: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, offsets, flat, block, row = _rows_of(batch, cuts)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            for lo, hi in itertools.pairwise([*first, len(block)]):
                own = row[lo:hi]
                size = offsets[own + 1] - offsets[own]
                at = np.arange(size.sum()) + np.repeat(offsets[own] - (np.cumsum(size) - size), size)
                columns = [pa.array([block[lo]]), *(pa.array([x]) for x in (v[own], size, flat[at]))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "v", "size", "flat"])

    return run


def _cuts(lists: DataFrame) -> np.ndarray:
    """Ids that part the vertices into blocks, so many that no block's lists and its neighbours' lists have over HELD members."""
    members = lists.agg(F.sum(F.size("n"))).first()[0] or 0
    n = math.ceil(members / BLOCK)
    while n > 1:
        found = lists.select(F.explode("n").alias("v")).select(F.percentile_approx("v", [k / n for k in range(1, n)], 10 * n)).first()[0]
        cuts = np.unique(np.array(found, np.int64))
        if members <= HELD or n >= MOST_BLOCKS:
            return cuts
        sizes = lists.select("v", "n").mapInArrow(_sized(cuts), "block long, members long").groupBy("block").agg(F.sum("members").alias("members"))
        if sizes.agg(F.max("members")).first()[0] <= HELD:
            return cuts
        n = min(2 * n, MOST_BLOCKS)
    return np.empty(0, np.int64)


def over_blocks(lists: DataFrame, pattern: Pattern, run: Callable[[Block], Iterator[tuple[np.ndarray, ...]]], names: list[str], k: int = 1) -> DataFrame:
    """What run yields for each block, as bigint columns. lists has v and its sorted neighbours n; ids have the part as remainder by k."""
    cuts = _cuts(lists)

    def matched(key: tuple, table: pa.Table) -> pa.Table:
        v, size, flat = (np.concatenate([x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in table.column(c).chunks]) for c in ("v", "size", "flat"))
        found = list(run(Block(pattern, key[0].as_py(), cuts, v, size, flat, k)))
        columns = [np.concatenate([np.asarray(x[i], np.int64) for x in found] or [np.empty(0, np.int64)]) for i in range(len(names))]
        return pa.table(columns, names=names)

    dealt = lists.select("v", "n").mapInArrow(_dealt(cuts), "block long, v array<long>, size array<long>, flat array<long>")
    return dealt.groupBy("block").applyInArrow(matched, ", ".join(f"{x} long" for x in names))


def _total(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def count(adj: DataFrame, pattern: Pattern, closed: bool = False) -> DataFrame:
    """One row with n, the number of matches, each as a row; closed: rows without one of two twins, which are counted by sizes."""
    return _total(over_blocks(neighbours(adj), pattern, lambda b: iter([([b.n_matches(closed)],)]), ["n"]))


def edge_weights(adj: DataFrame, pattern: Pattern) -> DataFrame:
    """src, dst, w: how many matches use the edge, in both directions, 0 where none does."""
    used = over_blocks(neighbours(adj), pattern, Block.weights, ["src", "dst", "w"]).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    half = adj.where("src < dst").join(used, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0)).alias("w"))
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return half.select(F.explode(both).alias("e"), "w").select("e.src", "e.dst", "w")


def _with_parts(adj: DataFrame, part: DataFrame) -> tuple[DataFrame, int]:
    """Lists whose ids are id * k + pid, which keeps their order, and k. Each list is sent back to its members with its vertex's part."""
    k = (part.agg(F.max("pid")).first()[0] or 0) + 1
    coded = neighbours(adj).join(part.select("v", (F.col("v") * k + F.col("pid")).cast("long").alias("code")), "v")
    back = coded.select(F.explode("n").alias("v"), F.col("code").alias("dst")).groupBy("v").agg(F.sort_array(F.collect_list("dst")).alias("n"))
    return stored(back.join(part, "v").select((F.col("v") * k + F.col("pid")).cast("long").alias("v"), "n"), "lists"), k


def seeded(adj: DataFrame, part: DataFrame, pattern: Pattern) -> DataFrame:
    """For each edge that crosses partitions and is the smallest such edge of a match, the number of its matches: a, b, n."""
    lists, k = _with_parts(adj, part)

    def run(block: Block) -> Iterator[tuple[np.ndarray, ...]]:
        for a, b in block.from_crossing():
            code, n = np.unique(a * block.n + b, return_counts=True)
            yield block.ids[code // block.n] // k, block.ids[code % block.n] // k, n

    return over_blocks(lists, pattern, run, ["a", "b", "n"], k).groupBy("a", "b").agg(F.sum("n").alias("n"))


def inter_by_sequences(adj: DataFrame, part: DataFrame, pattern: Pattern, share: bool = True) -> DataFrame:
    """One row with n, matches across partitions, grown from crossing edges; share says whether orders share prefixes."""
    lists, k = _with_parts(adj, part)
    return _total(over_blocks(lists, pattern, lambda b: iter([([sum(len(x) for x, _ in b.from_crossing(share))],)]), ["n"], k))


def inter_lazily(adj: DataFrame, part: DataFrame, pattern: Pattern) -> DataFrame:
    """One row with n, matches across partitions: by the sizes of twins' intersections, or else from each match's first crossing edge."""
    lists, k = _with_parts(adj, part)
    run = Block.n_crossing if twins(pattern) else Block.n_first_crossing
    return _total(over_blocks(lists, pattern, lambda b: iter([([run(b)],)]), ["n"], k))
