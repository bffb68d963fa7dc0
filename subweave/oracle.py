"""DuckDB SQL for patterns: one materialised table for each vertex that comes in, so that its planner has nothing to search."""

from __future__ import annotations

from subweave.plans.pattern import Pattern

#: The driver's table as a graph: the parts on neighbouring lines of an order.
GRAPH = """e AS MATERIALIZED (
  SELECT DISTINCT least(x.l_partkey, y.l_partkey) AS s, greatest(x.l_partkey, y.l_partkey) AS d
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber + 1 = y.l_linenumber
  WHERE x.l_partkey <> y.l_partkey),
adj AS MATERIALIZED (SELECT s AS src, d AS dst FROM e UNION ALL SELECT d, s FROM e)"""


def match_ctes(pattern: Pattern) -> tuple[str, str]:
    """CTEs that end in the table of all matches, and its name; vertices come in in their own order where that is connected."""
    from subweave.plans.planner import backward, hand_picked

    order = hand_picked(pattern)
    out = [f"m1 AS MATERIALIZED (SELECT src AS v{order[0]}, dst AS v{order[1]} FROM adj WHERE {_conditions(pattern, order, 1, 'dst', 'src')})"]
    for k, u in enumerate(order[2:], 2):
        first, *rest = backward(pattern, order, u)
        checks = "".join(f" AND EXISTS (SELECT 1 FROM adj t WHERE t.src = p.v{w} AND t.dst = a.dst)" for w in rest)
        out.append(f"m{k} AS MATERIALIZED (SELECT p.*, a.dst AS v{u} FROM m{k - 1} p JOIN adj a ON a.src = p.v{first} WHERE {_conditions(pattern, order, k, 'a.dst', None)}{checks})")
    return ",\n".join(out), f"m{pattern.n - 1}"


def _conditions(pattern: Pattern, order: tuple[int, ...], k: int, own: str, other: str | None) -> str:
    found = [f"{own} {r} {other or f'p.v{w}'}" for w in order[:k] if (r := pattern.relation(order[k], w))]
    return " AND ".join(found) or "true"


def count_sql(pattern: Pattern) -> str:
    ctes, last = match_ctes(pattern)
    return f"WITH {GRAPH},\n{ctes}\nSELECT count(*) AS n FROM {last}"


def instances_sql(pattern: Pattern) -> str:
    ctes, last = match_ctes(pattern)
    return f"WITH {GRAPH},\n{ctes}\nSELECT {', '.join(f'v{u}' for u in range(pattern.n))} FROM {last}"
