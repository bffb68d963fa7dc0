"""Matching of patterns: as joins, as lazily expanded arrays, and with intersections that are used again.

Matching is of subgraphs, not induced ones: edges that the pattern lacks may be there. All matched vertices differ. All plans
give the same rows and counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from subweave.functions.arrays import holds, intersection, kept, length, pairs, triples
from subweave.operators.clean import degrees, neighbours
from subweave.plans import planner, reuse
from subweave.plans.pattern import Pattern
from subweave.plans.planner import Level, Op, Step
from subweave.store import stored


def _v(u: int) -> str:
    return f"v{u}"


def _conditions(pattern: Pattern, u: int, others: list[int]) -> list[tuple[str, Column]]:
    """What u's id must be against the ids of others."""
    return [(r, F.col(_v(w))) for w in others if (r := pattern.relation(u, w))]


def instances(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None) -> DataFrame:
    """Every match as a row v0..v(n-1), by joins.

    Each vertex comes in by an equi-join on one earlier neighbour and is then checked against the others by semi-joins, so
    no partial match is ever wider than its ids.
    """
    return _instances(lambda a, u: adj, pattern, order)


def _instances(edges: Callable[[int, int], DataFrame], pattern: Pattern, order: tuple[int, ...] | None, seen: Callable[[DataFrame, int], DataFrame] = lambda rows, k: rows) -> DataFrame:
    """edges gives the src and dst that may stand for an edge of the pattern; seen is shown the partial matches of k vertices."""
    order = order or planner.hand_picked(pattern)
    rows = edges(order[0], order[1]).select(F.col("src").alias(_v(order[0])), F.col("dst").alias(_v(order[1])))
    rows = _checked(rows, pattern, order[1], [order[0]])
    return _grown(seen(rows, 2), edges, pattern, order, 2, pattern.n, seen).select(*(_v(u) for u in range(pattern.n)))


def profiled(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None) -> tuple[DataFrame, dict[int, Observation]]:
    """instances(), and for each number of vertices an observation of how many partial matches (rows) there were, once it has run."""
    found: dict[int, Observation] = {}

    def seen(rows: DataFrame, k: int) -> DataFrame:
        found[k] = Observation(f"vertices {k}")
        return rows.observe(found[k], F.count("*").alias("rows"))

    return _instances(lambda a, u: adj, pattern, order, seen), found


def _checked(rows: DataFrame, pattern: Pattern, u: int, others: list[int]) -> DataFrame:
    for op, w in _conditions(pattern, u, others):
        rows = rows.where(holds(F.col(_v(u)), op, w))
    return rows


def count_by_joins(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None) -> DataFrame:
    """One row with n, the number of matches."""
    return instances(adj, pattern, order).agg(F.count("*").alias("n"))


class _Rows:
    """Partial matches: ids as v*, lists of ids that are needed as n*, candidates as c*."""

    def __init__(self, adj: DataFrame, pattern: Pattern, order: tuple[int, ...], plan: reuse.ReusePlan | None = None, lists: DataFrame | None = None):
        self.pattern, self.order, self.plan = pattern, order, plan
        self.lists = neighbours(adj) if lists is None else lists
        self.common = edge_intersections(adj, self.lists) if plan and plan.uses_edges() else None
        self.rows: list[int] = []
        self.arrays: list[int] = []
        self.todo = list(order[1:])
        self.frame: DataFrame = None  # set by the first step
        self.carried: dict[frozenset[int], str] = {}
        self.same: dict[frozenset[int], int] = {}  # pairs of vertices whose ids have equal remainders, and by what

    def _conditions(self, u: int) -> list[tuple[str, Column]]:
        return _conditions(self.pattern, u, self.rows) + [(f"%{self.same[e]}", F.col(_v(w))) for w in self.rows if (e := frozenset((u, w))) in self.same]

    def seed(self, edges: DataFrame) -> None:
        """Begin with edges (src, dst) for the first two vertices."""
        a, b = self.order[:2]
        self.rows, self.todo = [a, b], [*self.order[2:]]
        self.frame = _checked(edges.select(F.col("src").alias(_v(a)), F.col("dst").alias(_v(b))), self.pattern, b, [a])
        for u in (a, b):
            if f"n{u}" in self._needed():
                self.frame = self.frame.join(self.lists.select(F.col("v").alias(_v(u)), F.col("n").alias(f"n{u}")), _v(u))

    def _sources(self, u: int) -> tuple[reuse.Source, ...]:
        if self.plan:
            return self.plan.of(u)
        return tuple(reuse.Source(frozenset((v,)), "list") for v in planner.backward(self.pattern, self.order, u))

    def _needed(self) -> list[str]:
        """Columns that later steps read."""
        lists = {v for u in self.todo for s in self._sources(u) if s.kind == "list" for v in s.inputs}
        carried = [c for inputs, c in self.carried.items() if any(s.inputs == inputs for u in self.todo for s in self._sources(u))]
        return [*(_v(u) for u in self.rows), *(f"n{u}" for u in self.rows if u in lists), *(f"c{u}" for u in self.arrays), *carried]

    def _trim(self) -> None:
        own = set(self._needed())
        self.frame = self.frame.select(*(c for c in self.frame.columns if c in own))

    def run(self, step: Step) -> None:
        u = step.vertex
        if step.op is Op.MATERIALIZE:
            self._materialize(u)
        elif step.op is Op.FILTER:
            self.frame = self.frame.withColumn(f"c{u}", kept(F.col(f"c{u}"), self._conditions(u)))
            self.frame = self.frame.where(F.size(f"c{u}") > 0)
        elif step.op in (Op.COMPUTE, Op.COMPUTE_COUNT):
            self._compute(u)

    def _materialize(self, u: int) -> None:
        if not self.rows:
            self.frame = self.lists.select(F.col("v").alias(_v(u)), F.col("n").alias(f"n{u}"))
            self.rows.append(u)
            return
        self.frame = self.frame.withColumn(_v(u), F.explode(f"c{u}")).drop(f"c{u}")
        for op, w in self._conditions(u):
            self.frame = self.frame.where(holds(F.col(_v(u)), op, w))
        self.arrays.remove(u)
        self.rows.append(u)
        if f"n{u}" in self._needed():
            self.frame = self.frame.join(self.lists.select(F.col("v").alias(_v(u)), F.col("n").alias(f"n{u}")), _v(u))
        self._trim()

    def _compute(self, u: int) -> None:
        parts, extra = [], []
        for s in self._sources(u):
            if s.kind == "list":
                (v,) = s.inputs
                parts.append(F.col(f"n{v}"))
            elif s.kind == "carried":
                parts.append(F.col(self.carried[s.inputs]))
            else:
                a, b = sorted(s.inputs)
                name = f"e{a}{b}_{u}"
                self.frame = self.frame.join(self.common.select(F.col("a").alias(_v(a)), F.col("b").alias(_v(b)), F.col("n").alias(name)), [_v(a), _v(b)])
                parts.append(F.col(name))
                extra.append(name)
        raw = intersection(parts) if len(parts) > 1 else parts[0]
        inputs = frozenset(planner.backward(self.pattern, self.order, u))
        if self.plan and inputs in self.plan.carried() and inputs not in self.carried:
            self.carried[inputs] = "r" + "".join(map(str, sorted(inputs)))
            self.frame = self.frame.withColumn(self.carried[inputs], raw)
            raw = F.col(self.carried[inputs])
        self.frame = self.frame.withColumn(f"c{u}", kept(raw, self._conditions(u))).drop(*extra).where(F.size(f"c{u}") > 0)
        self.arrays.append(u)
        self.todo.remove(u)
        self._trim()

    def counted(self) -> DataFrame:
        return self.frame.agg(F.coalesce(F.sum(self._per_row()), F.lit(0)).cast("long").alias("n"))

    def _per_row(self) -> Column:
        """Ways to pick the vertices that are still arrays."""
        own = self.arrays
        if not own:
            return F.lit(1).cast("long")
        if len(own) == 1:
            return length(F.col(f"c{own[0]}"))
        if len(own) == 2:
            a, b = own
            relation = self.pattern.relation(a, b)
            if relation is None:
                raise AssertionError(f"{a} and {b} are adjacent, so one of them must be a row")
            return pairs(F.col(f"c{a}"), F.col(f"c{b}"), relation)
        return triples(*(F.col(f"c{u}") for u in own))


def lazy_rows(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None, level: Level = Level.LAZY, plan: reuse.ReusePlan | None = None, steps: list[Step] | None = None, lists: DataFrame | None = None) -> _Rows:
    order = plan.order if plan else order or planner.hand_picked(pattern)
    out = _Rows(adj, pattern, order, plan, lists)
    for step in steps or planner.sequence(pattern, order, level):
        out.run(step)
    return out


def count_lazily(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None, level: Level = Level.LAZY) -> DataFrame:
    """One row with n: arrays are expanded only where a later vertex needs their elements, and the last ones are counted."""
    return lazy_rows(adj, pattern, order, level).counted()


def count_with_reuse(adj: DataFrame, pattern: Pattern, plan: reuse.ReusePlan | None = None) -> DataFrame:
    """One row with n: as count_lazily, with intersections carried along and read from the table of edges."""
    return lazy_rows(adj, pattern, plan=plan or reuse.plan(pattern, planner.hand_picked(pattern))).counted()


def symmetry_factor(pattern: Pattern) -> int:
    """Embeddings for each match that the pattern's order lets through."""
    all_ = list(itertools.permutations(range(pattern.n)))
    return len(all_) // sum(all(p[a] < p[b] for a, b in pattern.order) for p in all_)


def count_embeddings(adj: DataFrame, pattern: Pattern) -> DataFrame:
    """One row with n, all embeddings: matches under the order, times those that it leaves out for each."""
    return count_lazily(adj, pattern).select((F.col("n") * symmetry_factor(pattern)).alias("n"))


def edge_intersections(adj: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """a, b and their common neighbours n for every edge in both directions."""
    own = neighbours(adj) if lists is None else lists
    left, right = own.select(F.col("v").alias("a"), F.col("n").alias("na")), own.select(F.col("v").alias("b"), F.col("n").alias("nb"))
    half = adj.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(left, "a").join(right, "b")
    half = half.select("a", "b", intersection([F.col("na"), F.col("nb")]).alias("n"))
    return half.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "n").select("e.a", "e.b", "n")


def batch_intersections(pairs_: DataFrame, lists: DataFrame) -> DataFrame:
    """For many (a, b) the common neighbours n."""
    a, b = lists.select(F.col("v").alias("a"), F.col("n").alias("na")), lists.select(F.col("v").alias("b"), F.col("n").alias("nb"))
    return pairs_.join(a, "a").join(b, "b").select("a", "b", intersection([F.col("na"), F.col("nb")]).alias("n"))


def candidate_sizes(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None) -> DataFrame:
    """Partial matches with, for the last vertex, how many candidates each has: columns v* and candidates."""
    order = order or planner.hand_picked(pattern)
    steps = [s for s in planner.sequence(pattern, order, Level.LAST) if s.op is not Op.COMPUTE_COUNT] + [Step(Op.COMPUTE, order[-1])]
    made = lazy_rows(adj, pattern, order, steps=steps)
    return made.frame.select(*(_v(u) for u in sorted(made.rows)), length(F.col(f"c{order[-1]}")).alias("candidates"))


def instances_pruned(adj: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None) -> DataFrame:
    """instances() where only vertices with enough neighbours stand for each vertex of the pattern. The degrees travel with the edges."""
    own = degrees(adj)
    known = adj.join(own.select(F.col("v").alias("src"), F.col("degree").alias("ds")), "src").join(own.select(F.col("v").alias("dst"), F.col("degree").alias("dd")), "dst")

    def edges(a: int, u: int) -> DataFrame:
        return known.where((F.col("ds") >= len(pattern.neighbours(a))) & (F.col("dd") >= len(pattern.neighbours(u)))).select("src", "dst")

    return _instances(edges, pattern, order)


def count_direct(adj: DataFrame, pattern: Pattern) -> DataFrame:
    """One row with n by the pattern's closed form over sizes of candidate arrays, where it has one."""
    name = pattern.name.split("_")[0]
    made = lazy_rows(adj, pattern, steps=_DIRECT[name])
    c = {u: length(F.col(f"c{u}")) for u in made.arrays}
    return made.frame.agg(F.coalesce(F.sum(_CLOSED[name](c)), F.lit(0)).cast("long").alias("n"))


def _steps(text: str) -> list[Step]:
    return [Step(Op.MATERIALIZE if x[0] == "M" else Op.FILTER if x[0] == "F" else Op.COMPUTE, int(x[1])) for x in text.split()]


#: The arrays that the closed forms count, and the forms, which counts must equal: pairs without order; three rim vertices around one that touches both others; two arrays, one within the other.
_DIRECT = {
    "q2": _steps("M0 C2 M2 C3"),
    "q5": _steps("M0 C2 C4 M2 C1 M4 C3 C5 F1"),
    "q6": _steps("M0 C1 M1 C3 M3 C2 C4"),
    "q10": _steps("M0 C1 C3 M1 M3 C2"),
}
_CLOSED = {
    "q2": lambda c: c[3] * (c[3] - 1) / 2,
    "q5": lambda c: c[1] * c[3] * c[5] - c[3] * (c[1] + c[5] - 2) - c[3] * c[3],
    "q6": lambda c: c[4] * c[2] - c[2],
    "q10": lambda c: c[2] * (c[2] - 1) / 2,
}


def _with_parts(rows: DataFrame, part: DataFrame, pattern: Pattern) -> DataFrame:
    """Matches with the part of each vertex as p*."""
    for u in range(pattern.n):
        rows = rows.join(part.select(F.col("v").alias(_v(u)), F.col("pid").alias(f"p{u}")), _v(u))
    return rows


def _edge(a: int, b: int) -> Column:
    return F.struct(F.least(_v(a), _v(b)).alias("a"), F.greatest(_v(a), _v(b)).alias("b"))


def _smallest_crossing(pattern: Pattern) -> Column:
    """The smallest edge of a match that crosses partitions; null where none does."""
    return F.array_min(F.array_compact(F.array(*(F.when(F.col(f"p{a}") != F.col(f"p{b}"), _edge(a, b)) for a, b in pattern.edges))))


def by_partition(adj: DataFrame, part: DataFrame, pattern: Pattern, order: tuple[int, ...] | None = None) -> DataFrame:
    """One row: matches inside one partition, across partitions, in all. part has v and pid."""
    rows = _with_parts(instances(adj, pattern, order), part, pattern)
    same = reduce(lambda a, b: a & b, (F.col("p0") == F.col(f"p{u}") for u in range(1, pattern.n)))
    inside = F.count_if(same)
    return rows.agg(inside.alias("intra"), (F.count("*") - inside).alias("inter"), F.count("*").alias("total"))


def _grown(rows: DataFrame, edges: Callable[[int, int], DataFrame], pattern: Pattern, order: tuple[int, ...], lo: int, hi: int, seen: Callable[[DataFrame, int], DataFrame] = lambda rows, k: rows) -> DataFrame:
    """Partial matches of the order's first lo vertices with those up to hi."""
    for k, u in list(enumerate(order))[lo:hi]:
        anchor, *others = sorted(planner.backward(pattern, order, u), key=lambda w: -order.index(w))
        step = lambda w, u=u: edges(w, u).select(F.col("src").alias(_v(w)), F.col("dst").alias(_v(u)))
        rows = _checked(rows.join(step(anchor), _v(anchor)), pattern, u, list(order[:k]))
        for w in others:
            rows = rows.join(step(w), [_v(w), _v(u)], "left_semi")
        rows = seen(rows, k + 1)
    return rows


def _from_crossing(adj: DataFrame, part: DataFrame, pattern: Pattern, share: bool = True) -> DataFrame:
    """Matches across partitions as rows with their seed, grown from crossing edges.

    There is one connected order for each edge of the pattern; a match is kept where its edge is the smallest that crosses. Orders
    whose first vertices match the same partial pattern share those rows, under other names, unless share is false.
    """
    placed = adj.join(part.select(F.col("v").alias("src"), F.col("pid").alias("ps")), "src").join(part.select(F.col("v").alias("dst"), F.col("pid").alias("pd")), "dst")
    crossing = placed.where("ps <> pd").select("src", "dst")
    orders = list(planner.seeded_orders(pattern).values())
    groups = planner.shared_prefixes(pattern, orders) if share else {o: [o] for o in orders}
    out = None
    for prefix, own in groups.items():
        first, k = own[0], len(prefix) if len(own) > 1 else 2
        seeds = crossing.select(F.col("src").alias(_v(first[0])), F.col("dst").alias(_v(first[1])))
        shared = _grown(_checked(seeds, pattern, first[1], [first[0]]), lambda a, u: adj, pattern, first, 2, k)
        shared = shared.select(*(F.col(_v(u)).alias(f"at{i}") for i, u in enumerate(first[:k])))
        if len(own) > 1:
            shared = stored(shared, "prefix")
        for order in own:
            rows = shared.select(*(F.col(f"at{i}").alias(_v(u)) for i, u in enumerate(order[:k])))
            whole = _grown(rows, lambda a, u: adj, pattern, order, k, pattern.n)
            found = whole.select(*(_v(u) for u in range(pattern.n)), _edge(order[0], order[1]).alias("seed"))
            out = found if out is None else out.unionAll(found)
    return _at_smallest(out, part, pattern)


def inter_by_sequences(adj: DataFrame, part: DataFrame, pattern: Pattern, share: bool = True) -> DataFrame:
    """One row with n, matches across partitions, grown from crossing edges; share says whether orders share prefixes."""
    return _from_crossing(adj, part, pattern, share).agg(F.count("*").alias("n"))


def seeded(adj: DataFrame, part: DataFrame, pattern: Pattern) -> DataFrame:
    """For each edge that crosses partitions and is the smallest such edge of a match, the number of its matches: a, b, n.

    Every match across partitions is counted at one edge, from which it is grown.
    """
    return _from_crossing(adj, part, pattern).groupBy("seed.a", "seed.b").agg(F.count("*").alias("n"))


def _at_smallest(rows: DataFrame, part: DataFrame, pattern: Pattern) -> DataFrame:
    """The matches whose seed is the smallest of their edges that cross partitions."""
    return _with_parts(rows, part, pattern).where(F.col("seed") == _smallest_crossing(pattern))


def inter_lazily(adj: DataFrame, part: DataFrame, pattern: Pattern, k: int) -> DataFrame:
    """One row with n, matches across partitions, with lazily expanded arrays from every crossing edge. part has pids below k.

    A match is counted at the first edge of the pattern that crosses in it: all earlier ones lie within a partition. Ids are
    written as id * k + pid for that, which keeps their order.
    """
    both = adj.join(part.select(F.col("v").alias("src"), F.col("pid").alias("ps")), "src").join(part.select(F.col("v").alias("dst"), F.col("pid").alias("pd")), "dst")
    coded = stored(both.select((F.col("src") * k + F.col("ps")).alias("src"), (F.col("dst") * k + F.col("pd")).alias("dst")), "coded")
    lists = stored(neighbours(coded), "lists")
    crossing = coded.where(F.col("src") % k != F.col("dst") % k)
    out = None
    for i, (edge, order) in enumerate(planner.seeded_orders(pattern).items()):
        rows = _Rows(coded, pattern, order, lists=lists)
        rows.same = {frozenset(e): k for e in pattern.edges[:i]}
        assert edge == order[:2]
        rows.seed(crossing)
        for step in planner.sequence(pattern, order, seeded=True):
            rows.run(step)
        found = rows.counted()
        out = found if out is None else out.unionAll(found)
    return out.agg(F.sum("n").alias("n"))
