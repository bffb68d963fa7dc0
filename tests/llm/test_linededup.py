import re
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, corpus, frame

from subweave.llm import linededup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(FOLD)


def brute(rows, min_docs, min_chars=1):
    n = Counter(k for _, t in rows for k in {key_of(x) for x in (t or "").split("\n")})
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if n[key_of(x)] < min_docs or len(key_of(x)) < min_chars]
        out.append((str(k), "\n".join(rest), len(lines), len(lines) - len(rest)))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect())


@pytest.mark.parametrize(("most_sent", "most_hashes", "range_keys"), [(linededup.MOST_SENT, linededup.MOST_HASHES, linededup.RANGE_KEYS), (2, 0, 50), (0, 3, 7)])
def test_against_brute_force(spark, most_sent, most_hashes, range_keys):
    rows = corpus(6, n=80) + AWKWARD
    for min_docs, min_chars in ((10, 1), (2, 1), (2, 12)):
        got = linededup.dedup_lines(frame(spark, rows, extra=True), min_docs=min_docs, min_chars=min_chars, most_sent=most_sent, most_hashes=most_hashes, range_keys=range_keys)
        assert result(got) == brute(rows, min_docs, min_chars)


def test_columns_to_carry(spark):
    rows = [(i, f"line {i % 3}\nonly {i}") for i in range(30)]
    docs = frame(spark, rows).selectExpr("*", "doc_id * 2 as key", "'h' as hash", "struct(doc_id as text) as n_docs")
    for most_sent in (100, 0):
        got = linededup.dedup_lines(docs, min_docs=5, most_sent=most_sent, carry=("key", "hash", "n_docs")).collect()
        assert sorted((r["doc_id"], r["text"], r["key"], r["hash"], r["n_docs"]["text"]) for r in got) == [(i, f"only {i}", 2 * i, "h", i) for i in range(30)]


@pytest.mark.parametrize("bits", [1 << 4, 1 << 14])
def test_filters_lose_no_repeat(bits):
    """Every hash in enough documents is a suspect, however small the filters are; large ones let few others pass."""
    rng = np.random.default_rng(1)
    parts = []
    for _ in range(5):
        h, n = np.unique(rng.integers(0, 1000, 80).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)
        parts.append((h, n))
    total = Counter()
    for h, n in parts:
        total.update(dict(zip(h.tolist(), n.tolist(), strict=True)))
    for min_docs in (2, 3):
        got, passed = linededup.suspects(parts, bits, min_docs)
        assert set(got.tolist()) == {h for h, n in total.items() if n >= min_docs}
        assert passed >= sum(n > 1 for n in total.values())
    if bits > 1 << 10:
        assert passed < sum(n > 1 for n in total.values()) + 0.1 * len(total)


def test_first_occurrence(spark):
    rows = [(9, "a\nb"), (3, "x\nB "), (4, "b"), (None, "b")]
    (got,) = linededup.repeated_lines(frame(spark, rows), min_docs=2).collect()
    assert (got["key"], got["n_docs"], got["first_doc"], got["first_line"]) == ("b", 4, 3, 1)


def test_empty_table(spark):
    assert result(linededup.dedup_lines(frame(spark, []))) == []
