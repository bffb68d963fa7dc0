"""Lines that many documents share, found with two Bloom filters for each range of hashes.

Every document contributes each of its line keys once, as a 64-bit hash that is dealt to the task of its range. That task has a
filter of hashes seen once and one of hashes that may have been seen twice, sized for the range. Hashes that pass the second one are
suspects; those in too few documents, counted there, are let go. Only lines of a suspect's hash are shuffled by their
text, where documents are counted exactly and the first occurrence is chosen. Ranges grow in number with the corpus, so no
filter saturates and none passes through the driver.

Nulls, empties, ties: a null or empty text is one empty line. A key shorter than min_chars is never repeated. Every row counts as
a document, repeated rows and rows without an id included. The first occurrence is the one with the smallest id, then the
smallest line number; null ids come last. Columns other than the id and the text are dropped unless they are to be carried. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from subweave.llm import bloom
from subweave.llm.hot import unique_join
from subweave.llm.text import SPACES, texts
from subweave.store import stored

#: Keys of one range of hashes, bits of each of its filters for a key, and bytes of text for a key, about half a line.
RANGE_KEYS, BITS, BYTES = 1 << 20, 16, 32
#: Hashes of suspects, and the most common of the repeated keys, that are sent to every executor at most; others are joined.
MOST_HASHES, MOST_SENT = 1 << 21, 1 << 18
#: Bytes of repeated keys that are sent at most.
MOST_BYTES = 1 << 25

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def line_key(line: bytes) -> bytes:
    """The line stripped of spaces at both ends, A-Z in lower case."""
    return line.strip(SPACES).translate(_FOLD)


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if _chars(k) >= min_chars}


def _dealt(min_chars: int, ranges: int) -> Callable:
    """For each batch and range the hashes of its lines, and in how many of the batch's documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column("text"))
            once: list[int] = []
            for i in range(len(found)):
                once += map(_hash, _keys(found.row(i), min_chars))
            hashes, n = np.unique(np.array(once, np.uint64), return_counts=True)
            own = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(own, prepend=np.uint64(ranges)))
            ends = np.append(cuts[1:], len(own)) if len(cuts) else cuts
            pieces = list(zip(cuts.tolist(), ends.tolist(), strict=True))
            columns = [pa.array([int(own[a]) for a, _ in pieces], pa.int32()), pa.array([hashes[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in pieces], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "hashes", "docs"])

    return run


def suspects(parts: list[tuple[np.ndarray, np.ndarray]], bits: int, min_docs: int) -> tuple[np.ndarray, int]:
    """Hashes of one range that two filters of so many bits take for repeated and that are in min_docs documents, and how many the filters let pass.

    A part has distinct hashes and how many documents have each.
    """
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for hashes, n in parts:
        at = bloom.positions(hashes, bits).reshape(2, -1)
        again = at[:, once[at].all(axis=0) | (n > 1)]
        once[at] = True
        twice[again] = True
    passed = [(h[own], n[own]) for h, n in parts if (own := twice[bloom.positions(h, bits).reshape(2, -1)].all(axis=0)).any()]
    if not passed:
        return np.zeros(0, np.uint64), 0
    flat, where = np.unique(np.concatenate([h for h, _ in passed]), return_inverse=True)
    total = np.bincount(where, np.concatenate([n for _, n in passed]))
    return flat[total >= min_docs], len(flat)


def _repeated(bits: int, min_docs: int) -> Callable:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(h.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<u4")) for batch in batches for h, n in zip(batch.column("hashes"), batch.column("docs"), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(suspects(parts, bits, min_docs)[0].view(np.int64))], names=["hash"])

    return run


def suspect_hashes(docs: DataFrame, min_docs: int, min_chars: int, range_keys: int = RANGE_KEYS) -> DataFrame:
    """hash: 64 bits of the keys that seem to be in min_docs documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = int(size) // BYTES + 1
    ranges = math.ceil(keys / range_keys)
    dealt = docs.select("text").mapInArrow(_dealt(min_chars, ranges), "range int, hashes binary, docs binary")
    return stored(dealt.groupBy("range").applyInArrow(_repeated(bloom.size_for(math.ceil(keys / ranges), BITS), min_docs), "hash long"), "suspects")


def _lines(min_chars: int, sent) -> Callable:
    """The lines of each batch, once each with its documents and first occurrence; where hashes were sent, only lines of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent else None
        for batch in batches:
            found, ids = texts(batch.column("text")), batch.column("doc_id").to_pylist()
            keys, docs, numbers = [], [], []
            for i in range(len(found)):
                first: dict[bytes, int] = {}
                for number, line in enumerate(found.row(i).split(b"\n")):
                    key = line_key(line)
                    if key not in first and _chars(key) >= min_chars:
                        first[key] = number
                keys += first
                numbers += first.values()
                docs += [ids[i]] * len(first)
            hashes = np.fromiter(map(_hash, keys), np.uint64, len(keys))
            if known is None:
                keep = range(len(keys))
            else:
                keep = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes).tolist() if len(known) else []
            # one row for each key and batch: a line of many documents is counted here first
            per: dict[bytes, list] = {}
            for j in keep:
                at = (docs[j] is None, docs[j] if docs[j] is not None else 0, numbers[j])
                x = per.setdefault(keys[j], [0, at, j])
                x[0], x[1] = x[0] + 1, min(x[1], at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k.decode() for k in per], pa.string()),
                    pa.array(hashes[[x[2] for x in per.values()]].view(np.int64) if per else [], pa.int64()),
                    pa.array([x[0] for x in per.values()], pa.int64()),
                    pa.array([None if x[1][0] else x[1][1] for x in per.values()], pa.int64()),
                    pa.array([x[1][2] for x in per.values()], pa.int64()),
                ],
                names=["key", "hash", "n_docs", "first_doc", "first_line"],
            )

    return run


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, most_hashes: int = MOST_HASHES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Exactly the keys of at least min_docs documents: key, n_docs, and the document and line where it comes first.

    docs has doc_id (long) and text.
    """
    found = suspect_hashes(docs, min_docs, min_chars, range_keys)
    schema = "key string, hash long, n_docs long, first_doc long, first_line long"
    rows = docs.select("doc_id", "text")
    if found.count() <= most_hashes:
        known = np.sort(np.array([r["hash"] for r in found.toLocalIterator()], np.int64).view(np.uint64))
        lines = rows.mapInArrow(_lines(min_chars, docs.sparkSession.sparkContext.broadcast(known)), schema)
    else:
        lines = rows.mapInArrow(_lines(min_chars, None), schema).join(found, "hash", "left_semi")
    first = F.min(F.struct(F.col("first_doc").isNull().alias("none"), "first_doc", "first_line"))
    exact = lines.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), first.alias("first")).where(F.col("n_docs") >= min_docs)
    return exact.select("key", "n_docs", F.col("first.first_doc").alias("first_doc"), F.col("first.first_line").alias("first_line"))


def _dropped(sent, listed: bool) -> Callable:
    """Texts without the keys that were sent and, where listed, those in the column _bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = texts(batch.column("text"))
            own = batch.column("_bad").to_pylist() if listed else [None] * len(found)
            kept, n_lines, n_dropped = [], [], []
            for i in range(len(found)):
                lines, bad = found.row(i).split(b"\n"), {x.encode() for x in own[i] or ()}
                rest = [x for x in lines if (k := line_key(x)) not in known and k not in bad]
                kept.append(b"\n".join(rest).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(rest))
            names = [n for n in batch.schema.names if n not in ("_text_key", "_bad")]
            columns = [pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def _row_keys(min_chars: int, sent) -> Callable:
    """For each text its 128-bit hash and its keys but for those that were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = texts(batch.column("text"))
            own, keys = [], []
            for i in range(len(found)):
                text = found.row(i)
                k = _keys(text, min_chars) - known
                own += [xxhash.xxh3_128_digest(text)] * len(k)
                keys += (x.decode() for x in k)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(keys, pa.string())], names=["_text_key", "key"])

    return run


def _with_text_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = texts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest(found.row(i)) for i in range(len(found))], pa.binary())], names=[*batch.schema.names, "_text_key"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, most_sent: int = MOST_SENT, most_hashes: int = MOST_HASHES, range_keys: int = RANGE_KEYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the lines that at least min_docs documents have: doc_id, text, the columns to carry, n_lines, n_dropped.

    The repeated keys in most documents are sent to every executor. Where there are more than that, each text learns its others by a
    join, in which no key is as common as those. Columns to carry must not be named n_lines, n_dropped, _text_key or _bad.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    out = StructType([*rows.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    bad = stored(repeated_lines(rows, min_docs, min_chars, most_hashes, range_keys), "lines")
    n, size = bad.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    room = min(most_sent, n * MOST_BYTES // max(1, size))
    common = bad.orderBy(F.desc("n_docs"), "key").limit(room).select("key") if n > room else bad.select("key")
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(r["key"].encode() for r in common.toLocalIterator()))
    if n <= room:
        return rows.mapInArrow(_dropped(sent, listed=False), out)
    own = rows.select("text").mapInArrow(_row_keys(min_chars, sent), "_text_key binary, key string").distinct()
    lists = stored(own.join(bad.select("key"), "key").groupBy("_text_key").agg(F.collect_set("key").alias("_bad")), "line-lists")
    keyed = stored(rows.mapInArrow(_with_text_key, StructType([*rows.schema, StructField("_text_key", BinaryType())])), "keyed")
    return unique_join(keyed, lists, "_text_key").select(*rows.columns, "_bad").mapInArrow(_dropped(sent, listed=True), out)
