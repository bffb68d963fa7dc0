from helpers import AWKWARD, corpus, frame, words_of

from subweave.llm import quality


def brute(text):
    t = text or ""
    w = words_of(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(w) < 3000 else set(range(len(w)))
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_measurements(spark):
    rows = corpus(1, n=60) + AWKWARD + [(20, "a b c a b c x a b\n#\n#\n##"), (21, "the the the the")]
    got = quality.ledger(frame(spark, rows, extra=True)).collect()
    assert sorted((str(r["doc_id"]), *(r[m] for m in quality.MEASURES[:5])) for r in got) == sorted((str(k), *brute(t)) for k, t in rows)


def test_policies_are_bits(spark):
    rows = corpus(2, n=60) + [(500, "X! " * 60), (501, " ".join(f"w{i}#" for i in range(80)))]
    scored = quality.ledger(frame(spark, rows)).persist()
    for policy in (quality.BASE, quality.FULL):
        kept = {r["doc_id"] for r in quality.applied(scored, policy).where("kept").collect()}
        own = {r["doc_id"]: r["failed"] for r in scored.collect()}
        assert kept == {k for k, bits in own.items() if not bits & policy.mask(quality.RULES)}
        for r in quality.ablations(scored, policy).collect():
            (rule,) = [x for x in quality.RULES if x.name == r["rule"]]
            less = quality.Policy("x", tuple(n for n in policy.rules if n != rule.name))
            assert r["kept_without"] == quality.applied(scored, less).where("kept").count()
            assert r["failing"] == sum(bool(b & (1 << rule.bit)) for b in own.values())


def test_empty_table(spark):
    assert quality.applied(quality.ledger(frame(spark, [])), quality.FULL).collect() == []
    assert quality.ablations(quality.ledger(frame(spark, [])), quality.BASE).where("kept > 0").collect() == []
