"""One call for a count or for the matches, with the choices a user has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from subweave.operators import clean, match
from subweave.plans import planner, reuse
from subweave.plans.pattern import Pattern, by_name
from subweave.plans.planner import Level

#: All give the same count.
ALGORITHMS: dict[str, Callable[[DataFrame, Pattern, tuple[int, ...], Level], DataFrame]] = {
    "join": lambda adj, p, order, level: match.count_by_joins(adj, p, order),
    "pruned": lambda adj, p, order, level: match.instances_pruned(adj, p, order).selectExpr("count(*) as n"),
    "lazy": lambda adj, p, order, level: match.count_lazily(adj, p, order, level),
    "reuse": lambda adj, p, order, level: match.count_with_reuse(adj, p, reuse.plan(p, order)),
}
ORDERS: dict[str, Callable[[Pattern], tuple[int, ...]]] = {"hand": planner.hand_picked, "greedy": planner.greedy, "cost": planner.cheapest}


def _pattern(pattern: Pattern | str, ordered: bool) -> Pattern:
    own = by_name(pattern) if isinstance(pattern, str) else pattern
    return own if ordered else own.unordered()


def _order(pattern: Pattern, order: str | tuple[int, ...]) -> tuple[int, ...]:
    out = ORDERS[order](pattern) if isinstance(order, str) else tuple(order)
    if not planner.is_connected(pattern, out):
        raise ValueError(f"not a connected order of {pattern.name}: {out}")
    return out


def count(adj: DataFrame, pattern: Pattern | str, algorithm: str = "lazy", order: str | tuple[int, ...] = "hand", level: Level = Level.LAZY, ordered: bool = True, by_degree: bool | None = None) -> DataFrame:
    """One row with n. ordered: break symmetries; else all embeddings count.

    by_degree: number vertices by degree first, so that no hub's neighbours are paired with each other. Unless it is said, patterns
    whose order is total are counted so.
    """
    own = _pattern(pattern, ordered)
    if own.totally_ordered() if by_degree is None else by_degree:
        adj = clean.by_degree(adj)
    return ALGORITHMS[algorithm](adj, own, _order(own, order), level)


def matches(adj: DataFrame, pattern: Pattern | str, order: str | tuple[int, ...] = "hand", ordered: bool = True) -> DataFrame:
    """The matches as rows v0..v(n-1)."""
    own = _pattern(pattern, ordered)
    return match.instances(adj, own, _order(own, order))


def profile(adj: DataFrame, pattern: Pattern | str, order: str | tuple[int, ...] = "hand") -> dict[int, int]:
    """Runs the pattern and says how many partial matches of each number of vertices there were."""
    own = _pattern(pattern, True)
    rows, found = match.profiled(adj, own, _order(own, order))
    rows.write.format("noop").mode("overwrite").save()
    return {k: x.get["rows"] for k, x in found.items()}


def explain(pattern: Pattern | str, order: str | tuple[int, ...] = "hand", level: Level = Level.LAZY) -> str:
    own = _pattern(pattern, True)
    return planner.explain(own, _order(own, order), level)
