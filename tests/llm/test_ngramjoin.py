import random

import numpy as np
import pytest
from helpers import AWKWARD, corpus, frame, words_of

from subweave.llm import ngramjoin
from subweave.llm.components import components


def shingles(text):
    w = words_of((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        own = least.get(find(i))
        least[find(i)] = k if own is None else own if k is None else min(own, k)
    return [(k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_components_against_brute_force(spark, block):
    rows = corpus(3, n=150)
    got = ngramjoin.clustered(frame(spark, rows), block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_awkward_rows(spark):
    got = ngramjoin.clustered(frame(spark, AWKWARD, extra=True)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(AWKWARD), key=key)


def test_many_copies_of_one_text(spark):
    """One set has more than its share of the rows, and one group of links too."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in range(300)] + [(1000 + i, " ".join([*words, f"x{i}"])) for i in range(60)] + [(2000 + i, None) for i in range(50)] + corpus(9, n=60)
    got = ngramjoin.clustered(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_blocks_of_sizes_lose_no_link(spark):
    """Groups far larger than a block, of sets of one size and of many sizes."""
    rng = random.Random(4)
    chain = [(i, " ".join(f"c{k}" for k in range(i, i + 60))) for i in range(0, 120, 2)]
    nested = [(1000 + n, " ".join(f"n{k}" for k in range(n))) for n in range(20, 90)]
    rows = chain + nested
    rng.shuffle(rows)
    sets = [frozenset(shingles(t)) for _, t in rows]
    want = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert ngramjoin.pairs(frame(spark, rows), block=150).count() == want
    got = ngramjoin.clustered(frame(spark, rows), block=150, links=False).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_empty_table(spark):
    assert ngramjoin.clustered(frame(spark, [])).collect() == []
    assert ngramjoin.without_near_duplicates(frame(spark, [])).collect() == []


def test_one_of_each_component_stays(spark):
    rows = corpus(4, n=80) + [(k and k + 1000, t) for k, t in AWKWARD]
    got = ngramjoin.without_near_duplicates(frame(spark, rows)).collect()
    kept = sorted((r["doc_id"] for r in got if words_of(r["text"])), key=lambda x: (x is None, x or 0))
    want = {}
    for (k, t), (_, n, c) in zip(rows, brute(rows), strict=True):
        if n:
            want.setdefault(c if c is not None else ("none", t), k)
    assert len(kept) == len(want)
    assert sum(not words_of(r["text"]) for r in got) == sum(not words_of(t) for _, t in rows)


def test_search_against_all_pairs():
    rng, threshold = random.Random(5), ngramjoin.Threshold()
    base = [rng.sample(range(4000), rng.choice([5, 20, 100])) for _ in range(12)]
    sets = []
    for b in base * 8:
        own = set(b)
        for _ in range(rng.randint(0, len(b) // 6)):
            own.discard(rng.choice(b))
            own.add(rng.randrange(4000))
        sets.append(np.array(sorted(own), np.uint64))
    index = ngramjoin.Index(sorted(sets, key=len), threshold)
    ordered = sorted(sets, key=len)
    for q, own in enumerate(ordered):
        a = set(own.tolist())
        want = [i for i, x in enumerate(ordered) if i != q and 100 * len(a & set(x.tolist())) >= 80 * len(a | set(x.tolist()))]
        assert sorted(index.search(q).tolist()) == want


@pytest.mark.parametrize(("many", "long"), [(1, 1 << 30), (1, 16), (1, 3), (1 << 30, 16)])
def test_every_link_against_all_pairs(monkeypatch, many, long):
    """With all lists long, with some, and with none."""
    monkeypatch.setattr(ngramjoin, "MANY", many)
    monkeypatch.setattr(ngramjoin, "LONG", long)
    monkeypatch.setattr(ngramjoin, "COUNTS", 1000)
    rng, threshold = random.Random(7), ngramjoin.Threshold()
    base = list(range(60))
    sets = [np.array(sorted({*rng.sample(base, rng.randint(45, 60)), *rng.sample(range(100, 400), rng.randint(0, 8))}), np.uint64) for _ in range(150)]
    sets += [np.array(sorted(rng.sample(range(1000, 5000), rng.choice([1, 3, 30]))), np.uint64) for _ in range(40)]
    sets.sort(key=len)
    close = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if close(set(a.tolist()), set(sets[j].tolist()))}
    got = [(q, int(x)) for q, found in ngramjoin.Index(sets, threshold).every() for x in found]
    assert len(want) > 500 and len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want


@pytest.mark.parametrize("chunk", [1 << 20, 4])
def test_components(spark, chunk):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 20)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), chunk).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_all_links_against_brute_force(spark, block):
    base = [f"w{i}" for i in range(60)]
    near = [(1000 + k, " ".join(["x" * k, *base[k:], "y" * k])) for k in range(9)]
    rows = corpus(6, n=80) + near + [(2000 + k, near[4][1]) for k in range(3)]
    sets = [frozenset(shingles(t)) for _, t in rows]
    close = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    want = [(k, sum(i != j and bool(close(sets[i], x)) for j, x in enumerate(sets))) for i, (k, _) in enumerate(rows)]
    got = ngramjoin.clustered(frame(spark, rows), block=block).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    different = {frozenset((a, b)) for a in sets for b in sets if a != b and close(a, b)}
    found = ngramjoin.pairs(frame(spark, rows), block=block).collect()
    assert len({tuple(r) for r in found}) == len(found) == len(different)
