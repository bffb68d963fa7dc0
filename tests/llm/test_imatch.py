import hashlib
from collections import Counter

import pytest
import xxhash
from helpers import AWKWARD, corpus, frame
from pyspark.sql import functions as F

from subweave.llm import imatch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms(text):
    flat = text.lower()
    for c in "\t\n\x0b\x0c\r":
        flat = flat.replace(c, " ")
    return [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in flat.split(" ") if w]


def hashed(value, seed=42, size=8):
    return xxhash.xxh64_intdigest((value & ((1 << 8 * size) - 1)).to_bytes(size, "little"), seed)


def slot(words, family):
    """The hash of the terms of the highest level that is there."""
    marks = sorted(w & signed(hashed(w)) for w in words)
    level = lambda x: (x >> 4 * family) & 15
    top, h = max(map(level, marks), default=0), 42
    for x in marks:
        if level(x) == top:
            h = hashed(x, h)
    return hashed(family, h, 4)


def brute(rows, rarest, commonest):
    rows = sorted([(k, t or "") for k, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    n, df = len(rows), Counter(x for _, t in rows for x in set(terms(t)))
    lexicon = {x for x, c in df.items() if c * rarest >= n and c * commonest <= n}

    def print_of(text):
        w = set(terms(text))
        return [slot(w & lexicon or w, m) for m in range(imatch.SUBSETS)]

    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = print_of(t), print_of(edited), print_of(after)
        like = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / imatch.SUBSETS
        out.append((str(k), len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:016x}" for h in a), like(a, b), like(a, c)))
    return sorted(out)


@pytest.mark.parametrize("stretch", [2048, 11])
def test_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(imatch, "STRETCH_ROWS", stretch)
    rows = corpus(11, n=70) + [r for r in AWKWARD if r[0] != 9]
    got = imatch.with_edits(frame(spark, rows, extra=True), rarest=40, commonest=3)
    got = got.select("doc_id", "n_chars", F.sha2("edited", 256), imatch.written(F.col("hashes")), imatch.likeness(F.col("hashes"), F.col("edited_hashes")), imatch.likeness(F.col("hashes"), F.col("next_hashes"))).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, 40, 3)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = corpus(12, n=40)
    prints = {}
    for r in imatch.fingerprints(frame(spark, rows)).collect():
        assert prints.setdefault(r["text"], r["hashes"]) == r["hashes"]


def test_likeness_tells_edited_from_unrelated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(trim(text), '\\\\s+')) >= 20")
    near = imatch.with_edits(docs).select(imatch.likeness(F.col("hashes"), F.col("edited_hashes")).alias("e"), imatch.likeness(F.col("hashes"), F.col("next_hashes")).alias("n"))
    r = near.agg(F.avg((F.col("e") > F.col("n")).cast("double")), F.avg((F.col("e") == 0).cast("double"))).first()
    assert r[0] >= 0.9 and r[1] <= 0.05, r


def test_few_rows(spark):
    assert imatch.with_edits(frame(spark, [])).collect() == []
    (r,) = imatch.with_edits(frame(spark, [(1, "abcdef")])).collect()
    assert r["edited"] == "abcabc"


def test_no_python_in_the_plan(spark):
    plan = imatch.with_edits(frame(spark, corpus(13, n=10)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
