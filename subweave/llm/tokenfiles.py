"""Token ids in ORC files.

Documents are dealt into ranges of doc_id, sorted, encoded and written: a row per document with the ids as an array of int, which
ORC stores as run-length encoded integers in stripes with row indexes, and with Bloom filters on doc_id. Rows also have their
range and the ids before them in it, so a reader needs only the ranges' totals to know where a document starts.

Nulls, empties, ties: a null text is empty and has only the end id. Rows without an id come first; rows of one id in the order of
their texts. Columns other than the id and the text are not looked at. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subweave.store import stored
from subweave.llm.text import sliced
from subweave.llm.tokens import library_ids

END_ID, TOKENIZER = 2, "word_bpe_49k.json"
#: Ranges whose totals are sent to every task at most (16 bytes each); more are joined by a shuffle.
MOST_SENT = 1 << 20
#: Writer's settings: stripes of 64 MB, an index entry each 10,000 rows, Bloom filters of document ids at 1 % false positives.
ORC = {"orc.stripe.size": str(64 << 20), "orc.row.index.stride": "10000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}


def _encoded(end_id: int, tokenizer: str, drops_space: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                ids, offsets = library_ids(texts, tokenizer, drops_space)
                n = np.diff(offsets) + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                out = np.full(ends[-1], end_id, np.int32)
                inner = np.ones(ends[-1], bool)
                inner[ends[1:] - 1] = False
                out[inner] = ids
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(before + ends[:-1]), pa.array(n), tokens],
                    names=["doc_id", "part", "before", "n_tokens", "tokens"],
                )
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokenizer: str = TOKENIZER, drops_space: bool = True) -> None:
    """Write the documents' ids to ORC files at path, in ascending order of doc_id within and across files.

    drops_space says whether the tokenizer drops white space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(_encoded(end_id, tokenizer, drops_space), "doc_id long, part int, before long, n_tokens long, tokens array<int>")
    done.write.options(**ORC).orc(path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        offsets, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), tokens; filters on doc_id reach the files."""
    files = spark.read.schema("doc_id long, part int, before long, n_tokens long, tokens array<int>").orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    if bases.count() <= MOST_SENT:
        bases = F.broadcast(bases)
    return files.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "tokens")


def summed(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return read.mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
