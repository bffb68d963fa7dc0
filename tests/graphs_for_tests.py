"""Small graphs and a brute-force count."""

import itertools


def complete(n):
    return [(a, b) for a, b in itertools.combinations(range(n), 2)]


def adj(spark, edges):
    both = sorted({e for a, b in edges for e in ((a, b), (b, a)) if a != b})
    return spark.createDataFrame(both, "src long, dst long").coalesce(1).persist()


def brute(edges, pattern):
    own = {e for a, b in edges for e in ((a, b), (b, a))}
    vertices = sorted({v for e in own for v in e})
    out = []
    for m in itertools.permutations(vertices, pattern.n):
        if all((m[a], m[b]) in own for a, b in pattern.edges) and all(m[a] < m[b] for a, b in pattern.order):
            out.append(m)
    return out
