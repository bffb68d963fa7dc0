"""Patterns: small graphs with symmetry-breaking order, kept as data."""

from __future__ import annotations

import itertools
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """n vertices, undirected edges, and pairs (a, b) that say the id matched to a is below that of b."""

    name: str
    n: int
    edges: tuple[tuple[int, int], ...]
    order: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        for a, b in (*self.edges, *self.order):
            if not (0 <= a < self.n and 0 <= b < self.n) or a == b:
                raise ValueError(f"{self.name}: no such pair of vertices: {a}, {b}")

    def neighbours(self, u: int) -> frozenset[int]:
        return frozenset(b if a == u else a for a, b in self.edges if u in (a, b))

    def adjacent(self, a: int, b: int) -> bool:
        return (a, b) in self.edges or (b, a) in self.edges

    def relation(self, a: int, b: int) -> str | None:
        """What must hold between the ids matched to a and b: '<', '>', '<>', or None where the edge between them says enough."""
        if (a, b) in self.order:
            return "<"
        if (b, a) in self.order:
            return ">"
        return None if self.adjacent(a, b) else "<>"

    def unordered(self) -> Pattern:
        """Without symmetry breaking: every embedding counts."""
        return Pattern(self.name, self.n, self.edges)

    def totally_ordered(self) -> bool:
        """Whether the order leaves one way to sort the vertices."""
        return any(all((a, b) in self.order for a, b in itertools.pairwise(p)) for p in itertools.permutations(range(self.n)))

    def automorphisms(self) -> list[tuple[int, ...]]:
        own = {frozenset(e) for e in self.edges}
        return [p for p in itertools.permutations(range(self.n)) if {frozenset((p[a], p[b])) for a, b in own} == own]


def _pairs(text: str) -> tuple[tuple[int, int], ...]:
    return tuple((int(x[0]), int(x[1])) for x in text.split())


def _chain(n: int) -> str:
    return " ".join(f"{i}{i + 1}" for i in range(n - 1))


def _clique(n: int) -> str:
    return " ".join(f"{a}{b}" for a, b in itertools.combinations(range(n), 2))


#: Each pattern's edges and order, on which the counts depend. The order of q12 leaves every match three times.
CATALOGUE: dict[str, Pattern] = {
    p.name: p
    for p in (
        Pattern("q0_triangle", 3, _pairs("01 02 12"), _pairs("01 12")),
        Pattern("q1_square", 4, _pairs("01 03 12 23"), _pairs("01 02 03 13")),
        Pattern("q2_chordal_square", 4, _pairs("01 02 03 12 23"), _pairs("02 13")),
        Pattern("q3_4_clique", 4, _pairs(_clique(4)), _pairs(_chain(4))),
        Pattern("q4_house", 5, _pairs("01 02 12 13 24 34"), _pairs("12")),
        Pattern("q5_quad_triangle", 6, _pairs("01 02 03 04 05 12 23 34 45"), _pairs("24")),
        Pattern("q6_near_5_clique", 5, _pairs("01 02 03 04 12 13 23 34"), _pairs("03 12")),
        Pattern("q7_5_clique", 5, _pairs(_clique(5)), _pairs(_chain(5))),
        Pattern("q8_chordal_roof", 5, _pairs("01 02 03 12 13 24 34"), _pairs("01 23")),
        Pattern("q9_three_triangle", 5, _pairs("01 02 03 04 13 12 24"), _pairs("12")),
        Pattern("q10_solar_square", 5, _pairs("01 02 03 04 12 14 23 34"), _pairs("12 13 14 24")),
        Pattern("q11_6_clique", 6, _pairs(_clique(6)), _pairs(_chain(6))),
        Pattern("q12_near_near_5_clique", 5, _pairs("01 02 03 04 12 13 14 23 34"), _pairs("01 24")),
        Pattern("q13_triangle_in_diamond", 6, _pairs("01 02 03 05 12 13 14 24 25"), _pairs("01 12")),
    )
}
#: Match orders that are picked by hand; other patterns are matched in the order of their vertices.
HAND_PICKED = {
    "q2_chordal_square": (0, 2, 1, 3),
    "q4_house": (1, 2, 3, 0, 4),
    "q5_quad_triangle": (0, 2, 4, 1, 3, 5),
    "q6_near_5_clique": (0, 1, 3, 2, 4),
    "q10_solar_square": (0, 1, 3, 2, 4),
    "q12_near_near_5_clique": (0, 1, 3, 2, 4),
}
#: Stands for the uniform edge weight of partitioners: no pattern at all.
LINE = Pattern("line", 0, ())


def register(pattern: Pattern) -> Pattern:
    """Make a pattern known by its name."""
    if pattern.name in CATALOGUE and CATALOGUE[pattern.name] != pattern:
        raise ValueError(f"another pattern is named {pattern.name}")
    return CATALOGUE.setdefault(pattern.name, pattern)


def by_name(name: str) -> Pattern:
    """A pattern by its name or its short name (q3)."""
    found = [p for k, p in CATALOGUE.items() if k == name or k.split("_")[0] == name]
    if not found:
        raise KeyError(name)
    return found[0]
