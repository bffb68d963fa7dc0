import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from helpers import AWKWARD, corpus, words_of
from test_linededup import key_of
from test_ngramjoin import brute as brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from subweave.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_rules(text):
    """The full policy, measured anew."""
    t = text or ""
    w = words_of(t)
    n, chars = len(w), sum(map(len, w))
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {p for i in range(n - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words_of(x)]
    fails = [n < 50, 100 * len(again) > 50 * n, 10 * len(re.findall(r"[#*$%&|<>]", t)) > n, 100 * len(re.findall("[A-Z]", t)) > 30 * chars, 100 * t.count("!") > 30 * n, 100 * (len(lines) - len(set(lines))) > 50 * len(lines), chars < 2 * n or chars > 14 * n]
    assert len(fails) == len(quality.RULES)
    return not any(fails)


def brute(rows):
    rows = [(k, t) for k, t in rows if kept_by_rules(t)]
    seen = Counter(k for _, t in rows for k in {key_of(x) for x in t.split("\n")})
    rows = [(k, "\n".join(x for x in t.split("\n") if not key_of(x) or seen[key_of(x)] < 10)) for k, t in rows]
    firsts = brute_components(rows)
    return {k: t for (k, t), (_, n, c) in zip(rows, firsts, strict=True) if not n or k == c}


def test_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(21, n=110, hot=60) + [r for r in AWKWARD if r[0] != 9])]
    rows += [(500 + i, "Fine words here\n" + " ".join(f"w{i}x{j % 70}" for j in range(90))) for i in range(12)]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in want.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(want) < len(rows) - 20
    for r in got:
        own = ids[r["doc_id"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in corpus(22, n=30)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "packing"]


def test_names_of_other_columns_may_clash(spark):
    """Whatever the other columns are called, their values come out as they went in."""
    names = ["n_words", "failed", "kept", "policy", "n_lines", "n_dropped", "bad", "_bad", "set_key", "chosen", "again", "key", "hash", "doc", "with.dot"]
    rows = corpus(23, n=60) + [(None, None), (900, "")]
    extra = ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(k, t, *(None if k is None else f"{n} of {k}" for n in names)) for k, t in rows], f"doc_id long, text string, {extra}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.dtypes == docs.dtypes
        for r in got.collect():
            assert list(r)[2:] == [None if r["doc_id"] is None else f"{n} of {r['doc_id']}" for n in names]
    only = docs.select("text", "doc_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, only, "").columns == ["text", "doc_id"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, "")
        assert docs_out.collect() == []
