"""Units, packing, files of ids and the transducer against the tokenizers library."""

import random
import zlib
from functools import update_wrapper
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import AWKWARD, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from subweave.llm import bpe, packing, tokenfiles, tokens
from subweave.llm.text import Texts, sliced

ALPHABET = " \n\ta bZé漢　'sS1.!,-́<|😀"
SPECIAL = ["a <|endoftext|> b<|endoftext|>", "<|startoftext|>it's  I'll", "don't x's 's\n't", "a\n \nb", " \nfoo a\n \nbar", "don.'t (x)y's"]
LIBRARY = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def ids_of(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", LIBRARY)
@pytest.mark.parametrize("limit", [1 << 20, 64])
def test_units_give_the_ids_of_whole_texts(name, limit):
    rng = random.Random(1)
    sample = SPECIAL + [t or "" for _, t in AWKWARD[:8] + corpus(1, n=20)] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    got = []
    for _, texts in sliced(pa.RecordBatch.from_arrays([pa.array(sample)], names=["text"]), "text", limit):
        ids, offsets = tokens.library_ids(texts, name, drops_space=name.startswith("word"))
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [ids_of(name, t) for t in sample]


def test_a_full_memory_is_emptied():
    memory = tokens.Memory(lambda units: [[len(u)] for u in units], room=3)
    for text in ("aa bbb c dddd", "aa e", "ff aa ggg hh iii j"):
        for _, texts in sliced(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]), "text"):
            ids, _ = tokens.whole_ids(memory, texts, tokens.bare_units)
        assert ids.tolist() == [len(w) for w in text.split(" ")]


def by_units(sample, name, limit=1 << 20):
    got = []
    for _, texts in sliced(pa.RecordBatch.from_arrays([pa.array(sample)], names=["text"]), "text", limit):
        ids, offsets = tokens.library_ids(texts, name, drops_space=name.startswith("word"))
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return got


def test_a_word_is_learned_in_one_case(monkeypatch):
    seen = []

    class Recorded(tokens.Memory):
        def __init__(self, encode, *rest):
            super().__init__(update_wrapper(lambda units: seen.extend(units) or encode(units), encode), *rest)

    monkeypatch.setattr(tokens, "_held", {})
    monkeypatch.setattr(tokens, "Memory", Recorded)
    sample = ["Many words many WORDS\nétude Many", "words zzxqy WoRdS", "zzxqy étude"]
    assert by_units(sample, "word_bpe_49k.json") == [ids_of("word_bpe_49k.json", t) for t in sample]
    assert sorted(seen) == sorted(w.encode() for w in ("many", "words", "étude", "zzxqy"))


def test_words_of_letters_need_no_marks_between_them(monkeypatch):
    encode = tokens.Library(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(encode, "_marked", None)
    words = [*"Many words ÉTUDE zzxqyzzxqy çéü a".split(), *map("".join, product("abcé", repeat=5))]
    assert encode([w.encode() for w in words]) == [ids_of("word_bpe_49k.json", w) for w in words]


CASES = ["J\u030c j\u030c J\u0323\u030c", "H\u0331 T\u0308 W\u030a Y\u030a A\u02be", "I\u0307 İ ı I i", "\u212a K k \u212b Å A\u030a", "ẞ ß SS", "ΑΣ ΑΣ. Ǆ ǅ ǆ", "DON'T Don't X'S 'Re", "É é E\u0301 Éa×÷ÿŸ"]
SPECIAL_CASES = ["<|STARTOFTEXT|> Abc <|endoftext|>ABC", "ABC<|EndOfText|>"]


@pytest.mark.parametrize("name", LIBRARY)
def test_case_and_composition(name):
    """A letter that only its small form is composed in keeps its case until the library has composed it."""
    rng = random.Random(2)
    alphabet = "JjHhTtIiAaKSs'\u030c\u0331\u0308\u0307\u030a\u0301\u02be\u212aÉéßẞ×÷0. \n"
    sample = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for some in (sample, sample[:200] + SPECIAL_CASES):
        assert by_units(some, name) == [ids_of(name, t) for t in some]


@pytest.mark.parametrize("name", LIBRARY)
@pytest.mark.parametrize("room", [5, 400_000])
def test_units_of_equal_hash(name, room, monkeypatch):
    monkeypatch.setattr(tokens, "_held", {("library", name): tokens.Memory(tokens.Library(public_tokenizers.path(name)), room)})
    monkeypatch.setattr(Texts, "hashes", lambda self, starts, ends: (self.data[starts] % 16).astype(np.uint64))
    sample = SPECIAL + CASES + [t or "" for _, t in corpus(3, n=30)]
    for limit in (64, 1 << 20):
        assert by_units(sample, name, limit) == [ids_of(name, t) for t in sample]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60), st.integers(1, 9))
def test_transducer(text, step):
    own = bpe.merges("byte_bpe_50k.json")
    stream, out = bpe.StreamingEncoder(own), []
    for i in range(0, len(text), step):
        out += stream.feed(text[i : i + step])
    out += stream.finish()
    assert out == ids_of("byte_bpe_50k.json", text)
    decoder = bpe.StreamingDecoder(own)
    assert "".join([decoder.feed([i]) for i in out]) + decoder.finish() == text


@pytest.mark.parametrize("text", ["a" * 3000, "=" * 2500 + "x", " " * 3000 + "x", "thethe" * 400, "é" * 900])
def test_long_pre_tokens_leave_early(text):
    own = bpe.merges("byte_bpe_50k.json")
    stream = bpe.StreamingEncoder(own)
    early = stream.feed(text)
    assert early + stream.finish() == ids_of("byte_bpe_50k.json", text)
    assert early
    assert own.lookahead == len(own.rank) * own.longest


def test_together_is_the_encoding_of_both():
    own, rng = bpe.merges("byte_bpe_50k.json"), random.Random(3)
    single = [own.id[bytes([b])] for b in range(256)]
    ids = [i for i in own.bytes if i in own.made]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(1500)] + [(a, c) for a, b in list(own.rank)[:800] for c in (a, b)]
    for a, b in pairs:
        assert own.together(a, b) == (own.apply([single[x] for x in own.bytes[a] + own.bytes[b]]) == [a, b])


def test_bytes_that_are_no_character():
    own = bpe.merges("byte_bpe_50k.json")
    ids = [own.id[bytes([b])] for b in (0xE6, 0xBC, 0x41, 0xFF, 0xC3)]
    decoder = bpe.StreamingDecoder(own)
    assert decoder.feed(ids) + decoder.finish() == LIBRARY["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False)


def test_round_trip(spark):
    rows = corpus(5, n=30) + AWKWARD + [(70 + i, t) for i, t in enumerate(SPECIAL)]
    got = bpe.round_trip(frame(spark, rows, extra=True)).collect()
    want = [(str(k), ids_of("byte_bpe_50k.json", t), t or "") for k, t in rows]
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got) == sorted(want)
    assert bpe.round_trip(frame(spark, [])).collect() == []


def test_packing(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(8, n=90) + AWKWARD)]
    docs = {k: np.array([*ids_of("byte_bpe_50k.json", t), 1], "<u4") for k, t in rows}
    got = packing.packed(frame(spark, rows, extra=True), window=256).collect()
    pieces, places = {}, {}
    for r in got:
        own = docs[r["doc_id"]]
        assert (zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()), len(own)) == (r["ids_crc32"], r["doc_tokens"])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(docs) and sorted(places) == list(range(len(places)))
    for own, total in [*((x, len(docs[k])) for k, x in pieces.items()), *((x, None) for x in places.values())]:
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 256
    assert len(places) <= 1.05 * sum(map(len, docs.values())) / 256 + 1


def test_packing_of_nothing_and_of_one(spark):
    assert packing.packed(frame(spark, [])).collect() == []
    (r,) = packing.packed(frame(spark, [(5, None)])).collect()
    assert tuple(r) == (5, 0, 1, zlib.crc32(b"\x01\0\0\0"), 1, 0, 0)
    assert len(packing.packed(frame(spark, [(None, "a b"), (None, "a b")])).collect()) == 2


def test_plans_use_every_rest_once():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 300, 20_000):
        counts = np.bincount(rng.lognormal(4, 1, n).astype(int) % 255 + 1, minlength=257)
        used, sequences = np.zeros(257, int), 0
        for lengths, times in packing.plan(counts, 256):
            assert sum(lengths) <= 256
            np.add.at(used, list(lengths), times)
            sequences += times
        assert (used == counts).all()
        if n == 20_000:
            assert (counts * np.arange(257)).sum() / sequences / 256 > 0.99


def test_least_squares_match_counts():
    combos = np.array([[0, 4, 6], [0, 5, 5], [2, 4, 4]])
    counts = np.zeros(11, int)
    for c, n in zip(combos, (10, 20, 5), strict=True):
        np.add.at(counts, c[c > 0], n)
    assert np.allclose(packing.LeastSquares(combos, counts).solved(), [10, 20, 5], atol=1e-6)


def test_least_squares_against_every_support():
    """Of all supports, the best solution without negative repeats has the same residual."""
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(20):
        combos = np.sort(rng.integers(0, 7, (6, 3)), axis=1)
        combos = combos[combos[:, 2] > 0]
        target = rng.integers(0, 30, 7)
        problem = packing.LeastSquares(combos, target)
        a = np.zeros((7, len(combos)))
        for i, c in enumerate(combos):
            np.add.at(a[:, i], c[c > 0], 1)
        want = min(
            float(((a[:, list(own)] @ x - problem.target) ** 2).sum())
            for k in range(len(combos) + 1)
            for own in itertools.combinations(range(len(combos)), k)
            if ((x := np.linalg.lstsq(a[:, list(own)], problem.target, rcond=None)[0]) >= -1e-9).all()
        )
        assert abs(float((problem.residual(problem.solved()) ** 2).sum()) - want) < 1e-5


def _table_counts(sf: str) -> np.ndarray:
    docs = pq.read_table(f"/root/testdata/sf{sf}/documents.parquet").column("text").combine_chunks()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    rests = [len(x.ids) + 1 for x in own.encode_batch_fast([t or "" for t in docs.to_pylist()], add_special_tokens=False)]
    return np.bincount(np.array(rests) % 2048, minlength=2049)


@pytest.mark.parametrize("times", [1, 1000])
def test_solutions_fill_most_windows(times):
    """At least 90 % of the windows of rests come from the least squares, and the plan has a bound that the counts do not move."""
    for counts in (_table_counts("0.01"), np.bincount(np.random.default_rng(1).lognormal(6.2, 0.8, 10_000).astype(int) % 2047 + 1, minlength=2049)):
        counts = counts * times
        counts[0] = 0
        left = counts.copy()
        solved = sum(n for _, n in packing.solved_fillings(left, 2048))
        fillings = packing.plan(counts, 2048)
        assert solved >= 0.9 * sum(n for _, n in fillings)
        assert len(fillings) <= packing.ROUNDS * 2048 + 2048 * (np.log(2048) + 1)
        assert (left * np.arange(2049)).sum() <= 0.1 * (counts * np.arange(2049)).sum()


def test_token_files(spark, tmp_path):
    rows = [(k, t) for k, t in corpus(9, n=50) + AWKWARD]
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(frame(spark, rows, extra=True), path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for k, t in ordered:
        own = np.array([*ids_of("word_bpe_49k.json", t), 2], "<u4")
        want.append((str(k), at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    got = tokenfiles.summed(tokenfiles.read_tokens(spark, path)).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert tokenfiles.read_tokens(spark, path).where("doc_id = 5 and start >= 0").count() == sum(k == 5 for k, _ in rows)
    tokenfiles.write_tokens(frame(spark, []), str(tmp_path / "none"))
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).collect() == []


def scanned_rows(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_token_files_are_pruned_by_their_metadata(spark, tmp_path):
    """Row indexes leave one stretch of ten thousand rows for an id that is there, Bloom filters none for one that is not."""
    path = str(tmp_path / "tokens")
    docs = spark.range(40_000).selectExpr("2 * id as doc_id", "concat('t ', id % 7) as text").coalesce(1)
    tokenfiles.write_tokens(docs, path)
    files = spark.read.orc(path)
    assert files.count() == 40_000
    assert 0 < scanned_rows(files.where("doc_id = 30000").select("tokens")) <= 10_000
    missing = [scanned_rows(files.where(f"doc_id = {i}").select("tokens")) for i in (30_001, 40_001, 51_111, 60_003)]
    assert missing.count(0) >= 3


def test_token_files_of_many_ranges(spark, tmp_path, monkeypatch):
    rows = corpus(10, n=40)
    tokenfiles.write_tokens(frame(spark, rows), str(tmp_path / "tokens"))
    want = sorted(map(tuple, tokenfiles.summed(tokenfiles.read_tokens(spark, str(tmp_path / "tokens"))).collect()))
    monkeypatch.setattr(tokenfiles, "MOST_SENT", 0)
    assert sorted(map(tuple, tokenfiles.summed(tokenfiles.read_tokens(spark, str(tmp_path / "tokens"))).collect())) == want
