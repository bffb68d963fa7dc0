"""The corpus pipeline: quality rules, line dedup, near-duplicate removal and packing, over the table documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. A null text is empty: quality rules
reject it. Rows are judged one by one, repeated ones too, until near_duplicates keeps one of them. Columns other than doc_id and
text go through the first three stages in one struct, so none of their names can clash with what an operator adds; n_chars, where it
is there, is the length of the text that is left. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave.llm import linededup, ngramjoin, packing, quality
from subweave.store import stored

#: The struct of all other columns while an operator runs.
_REST = "_rest"


def _carried(docs: DataFrame, operator: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """What the operator (of doc_id, text and columns to carry) leaves, with the columns of docs."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in rest}
    rows = docs.select("doc_id", "text", *([F.struct(*quoted.values()).alias(_REST)] if rest else []))
    done = operator(rows, (_REST,) if rest else ())
    return done.select(*(c if c in ("doc_id", "text") else F.col(_REST).getField(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the full policy. Null, empty and very long texts are judged like others."""
    return _carried(docs, lambda rows, carry: quality.applied(quality.ledger(rows, carry=carry), quality.FULL).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have. A document that loses all its lines stays, with an empty text."""
    done = _carried(docs, lambda rows, carry: linededup.dedup_lines(rows, carry=carry))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, then the smallest text; documents without words all stay."""
    return _carried(docs, lambda rows, carry: ngramjoin.without_near_duplicates(rows, carry=carry))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences. An empty text has its end id only."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]

#: SQL has neither the tokenizer nor the packing, so run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
