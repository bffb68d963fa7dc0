import random

import pyarrow as pa
import pytest
from helpers import AWKWARD, frame

from subweave.llm import licenses
from subweave.llm.text import texts

NOISE = "the of and in to that was with for by as on are this from it an be at or".split()


def noise(rng, n):
    return " ".join(rng.choice(NOISE) + rng.choice(["", "", "x", "ing,"]) for _ in range(n))


def found(text):
    return {x[0]: x for x in licenses.Scanner().scan(texts(pa.array([text]))).get(0, [])}


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.name)
def test_templates_are_found_in_noise(template):
    rng = random.Random(template.name)
    for before, after in ((0, 0), (400, 30), (3, 2000)):
        own = found(f"{noise(rng, before)} {template.text} {noise(rng, after)}")
        assert template.name in own and own[template.name][1] == 1.0
    assert template.name in found(template.text.upper().replace(" ", "\n * "))


@pytest.mark.parametrize("template", licenses.TEMPLATES[:3], ids=lambda t: t.name)
def test_edited_and_repeated_templates(template):
    rng = random.Random(1)
    w = template.text.split()
    edited = [x for x in w if rng.random() > 0.08]
    assert found(" ".join(edited))[template.name][1] >= 0.85
    assert found("\n".join([template.text] * 3))[template.name][1] == 1.0
    assert template.name not in found(" ".join(w[: len(w) // 2]))


def test_a_notice_with_a_remark_inside_is_found():
    rng = random.Random(5)
    for template in licenses.TEMPLATES:
        w = template.text.split()
        if len(w) >= 40:
            at = len(w) // 2
            own = found(" ".join([noise(rng, 50), *w[:at], *(f"foot{i}" for i in range(15)), *w[at:], noise(rng, 50)]))
            assert own[template.name][1] == 1.0


@pytest.mark.parametrize(("kind", "share", "least"), [("drop", 0.05, 1.0), ("drop", 0.15, 0.95), ("insert", 0.05, 1.0), ("insert", 0.15, 1.0), ("insert", 0.3, 0.98), ("replace", 0.05, 1.0), ("replace", 0.12, 0.95)])
def test_recall_of_edited_notices(kind, share, least):
    """Of notices with some of their words changed, those that keep the coverage are found nearly always."""
    rng, hits, all_ = random.Random(9), 0, 0
    for template in licenses.TEMPLATES:
        w = template.text.split()
        for _ in range(10 if len(w) >= 40 else 0):
            own, kept = [], 0
            for x in w:
                changed = rng.random() < share
                if kind == "insert" and changed:
                    own.append("foreign" + str(rng.randrange(1000)))
                if not changed or kind == "insert":
                    own.append(x)
                    kept += 1
                elif kind == "replace":
                    own.append("foreign" + str(rng.randrange(1000)))
            if kept < 0.82 * len(w):
                continue
            all_ += 1
            hits += template.name in found(f"{noise(rng, 100)} {' '.join(own)} {noise(rng, 100)}")
    assert hits >= least * all_ and all_


def test_scan_against_alignment_of_whole_texts():
    """On texts that are no longer than a cluster, the clusters find what aligning the whole text finds."""
    rng = random.Random(8)
    scanner = licenses.Scanner(tuple(licenses.Template(f"t{k}", " ".join(f"w{rng.randrange(40)}" for _ in range(20))) for k in range(12)))
    for _ in range(200):
        template = rng.randrange(12)
        own = [x for x in scanner.templates[template].text.split() if rng.random() > 0.15]
        for _ in range(rng.randrange(6)):
            own.insert(rng.randrange(len(own)), f"w{rng.randrange(60)}")
        row = texts(pa.array([" ".join(own)]))
        hashes = licenses.words(row)[0].tolist()
        want = {t.name for t, w in zip(scanner.templates, scanner.words, strict=True) if len(licenses.align(hashes, w)) >= 0.8 * len(w)}
        assert {x[0] for x in scanner.scan(row).get(0, [])} >= want


def test_noise_has_no_license():
    rng = random.Random(2)
    assert not found(noise(rng, 5000))
    assert not found("the " * 3000 + "license")


def test_one_line_twice_in_a_row():
    assert found("Released under the MIT License. Released under the MIT License.")["MIT-line"][1] == 1.0


def test_longest_increasing_subsequence():
    rng = random.Random(3)
    for _ in range(50):
        v = rng.sample(range(30), rng.randint(0, 9))
        got = [v[i] for i in licenses.increasing(v)]
        assert got == sorted(got)
        best = max(bin(m).count("1") for m in range(1 << len(v)) if (s := [x for i, x in enumerate(v) if m >> i & 1]) == sorted(s))
        assert len(got) == best


def test_alignment_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a, b = [rng.randrange(12) for _ in range(20)], [rng.randrange(12) for _ in range(15)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(licenses.align(a, a)) == len(a)


def test_frame(spark):
    rows = AWKWARD + [(50, "x\nLicensed under CC BY-NC 4.0.\ny"), (51, "Released under the MIT License.")]
    got = {r["doc_id"]: r for r in licenses.scanned(frame(spark, rows, extra=True)).collect()}
    assert got[50]["license"] == "CC-BY-NC-4.0-line" and got[50]["first_word"] == 1 and got[50]["n_words"] == 7
    assert got[51]["license"] == "MIT-line" and got[1]["license"] is None and got[1]["licenses"] == []
    assert licenses.scanned(frame(spark, rows)).count() == len(rows)
    assert licenses.scanned(frame(spark, [])).collect() == []
