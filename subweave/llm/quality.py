"""Quality rules as a ledger of failure bits.

Each rule is evaluated once. A document's failures are bits of one long, stored with the measurements behind them, so a
policy (a versioned set of rules) and what it would keep without one of its rules are bitwise arithmetic on the ledger;
texts are not read again.

Nulls, empties, ties: a null text has no words, as an empty one; every measurement of it is 0 and it fails too_short. Ids may be
null or repeat: rows are judged one by one and each input row gives one output row. Columns other than the id and the text
are dropped unless they are to be carried, so their names cannot clash. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from subweave.llm.text import SPACES, Texts, chained, mix, sliced

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")


@dataclass(frozen=True)
class Rule:
    """A condition over the measurements, in SQL, that a bad document meets. The bit is fixed for good once it is used."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    """The rules that count, by name, under a version that is written beside its verdicts."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


RULES = (
    Rule("too_short", 0, "n_words < 50"),
    Rule("repeats_itself", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("shouting", 3, "100 * n_upper > 30 * word_chars"),
    Rule("exclaiming", 4, "100 * n_exclaim > 30 * n_words"),
    Rule("repeated_lines", 5, "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", 6, "word_chars < 2 * n_words or word_chars > 14 * n_words"),
)
BASE = Policy("base-1", ("too_short", "repeats_itself"))
FULL = Policy("full-1", tuple(r.name for r in RULES))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row, the words in a window of three words that its text has twice or more."""
    n = len(starts)
    if n < 3:
        return np.zeros(len(texts), np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    window = chained(texts.hashes(starts, ends), 3)
    inside = np.flatnonzero(row[:-2] == row[2:])
    key = mix(window[inside] + row[inside].astype(np.uint64))
    order = np.argsort(key)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice = inside[order[same[1:] | same[:-1]]]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 3, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return total[first[1:]] - total[first[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    with_word = repeats = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if line in seen:
            with_word, repeats = with_word + 1, repeats + 1
        elif line.strip(SPACES):
            with_word += 1
            seen.add(line)
    return with_word, repeats


def measured(texts: Texts) -> dict[str, np.ndarray]:
    """The measurements of each row."""
    data = texts.data
    starts, ends, first = texts.words()
    lines = np.array([_lines(texts.row(i)) for i in range(len(texts))], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(first),
        "word_chars": texts.count(((data & 0xC0) != 0x80) & (data != 32) & ~((data >= 9) & (data <= 13))),
        "n_symbols": texts.count(_SYMBOL[data]),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": _repeated(texts, starts, ends, first),
        "n_lines": lines[:, 0],
        "n_upper": texts.count((data >= 65) & (data <= 90)),
        "n_exclaim": texts.count(data == 33),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in sliced(batch, "text"):
            m = measured(texts)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], names=[*rows.schema.names, *MEASURES])


def _bits(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(0).cast("long")
    for r in rules:
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: its id and text, the columns to carry, the measurements, and failed, the bits of the rules it fails.

    Columns to carry must not be named like a measurement or failed.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    schema = StructType([*rows.schema, *(StructField(k, LongType()) for k in MEASURES)])
    return rows.mapInArrow(_measure, schema).withColumn("failed", _bits(rules))


def applied(scored: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with kept and the policy's version."""
    return scored.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask(rules))) == 0).withColumn("policy", F.lit(policy.version))


def ablations(scored: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail nothing else, and that the policy keeps without it."""
    mask = policy.mask(rules)
    used = [r for r in rules if r.name in policy.rules]
    under = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.count_if(under == 0).alias("kept")]
    for r in used:
        bit = 1 << r.bit
        sums += [F.count_if(under.bitwiseAND(F.lit(bit)) != 0).alias(f"failing_{r.bit}"), F.count_if(under == bit).alias(f"only_{r.bit}")]
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"failing_{r.bit}").alias("failing"), F.col(f"only_{r.bit}").alias("only"), (F.col("kept") + F.col(f"only_{r.bit}")).alias("kept_without")) for r in used]
    return scored.agg(*sums).select(F.lit(policy.version).alias("policy"), F.explode(F.array(*rows)).alias("r")).select("policy", "r.*")
