"""Jaccard join of word n-gram sets by T-occurrence search with DivideSkip.

A document linked with another shares at least the threshold's part of its own shingles with it. So:

1. Each text is reduced to the size and the 128-bit key of its shingle set; equal sets are one from here on.
2. Shingles are dealt out as 32-bit rests of 64-bit hashes, and each document learns how many of its own occur anywhere else.
   A task sends a shingle that several of its documents have only once. Rests that fall together only keep a document in.
3. Documents with enough shared shingles stay; a Bloom filter of their keys, of a fixed largest size, tells the tasks that read
   the texts again which sets to send on. A sketch of counts, with a byte for each shingle of what stays up to MOST_SLOTS, orders
   shingles from rare to frequent. Any order gives the same links; a coarse one only makes groups larger.
   Two linked documents have one of their n - ceil(t n) + 1 rarest shingles in common, so documents that share none of
   them, even over others, never meet again: they fall into groups.
4. Each group is searched in memory, several small groups at a time. A larger one is dealt into blocks by the size of the sets, and
   two blocks meet in a task of their own where sets of their sizes can be linked at all. The search is DivideSkip: a document's
   shortest inverted lists are merged, documents found often enough there are counted in its longest lists, by binary search
   where they are few, and those that reach the overlap are linked. Lists that most sets of a task are in are probed for many
   queries at once. The merge sorts the short lists together as arrays
   instead of taking their heads from a heap one by one; it gives the same counts. A document leaves the index after its own
   search, so every pair of different sets that are linked is found once. A task sums its links by set, weighted by copies;
   pairs() gives them as rows. Where only components are asked for, a document leaves the index once it is linked, which gives
   a tree of links.
5. Links are contracted to components. Of the links of a task those go there that connect what was not connected before.

Rows that meet by a key that may be common (a shingle, a group, a set with many copies) meet by hot.unique_join.

Shingles are compared by 64-bit hashes, sets by 128-bit ones.

Nulls, empties, ties: a null text, or one without words, has no shingles and is linked with nothing; a text of fewer words than
a shingle has one, its whole sequence. Every row is a document: repeated rows are copies of each other. A component's
id is its smallest doc_id; rows without an id have a null component only where no member has an id. Columns other than the id
and the text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from subweave.llm import bloom
from subweave.llm.components import components
from subweave.llm.hot import unique_join
from subweave.llm.text import Texts, chained, mix, sliced
from subweave.store import stored

#: Shingles of one bucket of the counting step and of one block of the search, and of one send of a task.
BUCKET = BLOCK = 1 << 20
SEND = 1 << 19
#: Documents of one send at most; the last number stands for several.
SEND_DOCS, SEVERAL = 60_000, 0xFFFF
#: Slots of the sketch at least and at most, of one piece of it, and slots that a task holds before it sends them.
LEAST_SLOTS, MOST_SLOTS, SKETCH_PART, HELD = 1 << 16, 1 << 27, 1 << 16, 1 << 21
#: Weight of the binary search against the merge when a query's lists are divided.
MU = 0.01
#: A list is long for all queries if it has one of so many sets, and there are so many sets; counts of sets by queries at once.
LONG, MANY, COUNTS = 16, 256, 1 << 22


@dataclass(frozen=True)
class Threshold:
    """Linked: den * intersection >= num * union."""

    num: int = 80
    den: int = 100

    def least(self, n):
        """Shingles that a set of n must have in common with any set it is linked with."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """Shingles that sets of n and of m must have in common."""
        return -(-self.num * (n + m) // (self.num + self.den))


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; texts are in lower case."""
    starts, ends, first = texts.words()
    words = texts.hashes(starts, ends)
    window = chained(words, size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            found = np.sort(window[lo : hi - size + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif hi > lo:
            found = mix(chained(words[lo:hi], hi - lo) + np.uint64(hi - lo))
        else:
            found = window[:0]
        out.append(found)
    return out


def set_key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _summaries(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                sets = shingle_sets(texts.lower(), size)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(set_key, sets), pa.binary())], names=["doc_id", "n_shingles", "set_key"])

    return run


def _with_sets(size: int, sent) -> Callable:
    """The sets whose key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in sliced(batch, "text"):
                sets = [x for x in shingle_sets(texts.lower(), size) if len(x)]
                keys = list(map(set_key, sets))
                good = np.flatnonzero(bloom.passes(sent.value, bloom.hashes_of(keys)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in good], pa.binary()), pa.array([sets[i].tobytes() for i in good], pa.binary())], names=["set_key", "shingles"])

    return run


_SENT = "bucket int, part int, send int, rests binary, rows binary, keys binary, sizes binary"


def _sends(size: int, buckets: int) -> Callable:
    """Shingles by bucket, and a line for each send with its documents' keys, sizes and how many shingles they share within it."""

    def packed(part: int, send: int, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array(list(map(len, sets)), "<u4")
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
        count = np.diff(np.append(np.flatnonzero(fresh), len(flat)))
        shared = np.bincount(row[np.repeat(count > 1, count)], minlength=len(sets)).astype("<u4")
        flat, row = flat[fresh], np.where(count > 1, SEVERAL, row[fresh]).astype("<u2")
        bucket = ((flat >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        rests = (flat & np.uint64(0xFFFFFFFF)).astype("<u4")
        cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        ends = np.append(cuts[1:], len(flat))
        out = [(int(bucket[a]), rests[a:b].tobytes(), row[a:b].tobytes(), None, None) for a, b in zip(cuts, ends, strict=True)]
        out.append(((part * 31 + send) % buckets, None, shared.tobytes(), b"".join(map(set_key, sets)), sizes.tobytes()))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array([send] * len(out), pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            names=["bucket", "part", "send", "rests", "rows", "keys", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, send, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for _, texts in sliced(batch, "text"):
                for found in shingle_sets(texts.lower(), size):
                    if len(found):
                        held.append(found)
                        n += len(found)
                    if n >= SEND or len(held) >= SEND_DOCS:
                        yield packed(part, send, held)
                        send, held, n = send + 1, [], 0
        if held:
            yield packed(part, send, held)

    return run


def _binary(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket: which rests occur twice, as counts for each document of each send."""
    filled = table.column("keys").is_valid()
    about, table = table.filter(filled), table.filter(pa.compute.invert(filled))
    parts, sends = table.column("part").to_pylist(), table.column("send").to_pylist()
    rests, rows = _binary(table.column("rests"), "<u4"), _binary(table.column("rows"), "<u2")
    out = [(p, s, r, None, k, z) for p, s, r, k, z in zip(*(about.column(c).to_pylist() for c in ("part", "send", "rows", "keys", "sizes")), strict=True)]
    if rests:
        flat, row = np.concatenate(rests), np.concatenate(rows)
        of = np.repeat(np.arange(len(rests)), list(map(len, rests)))
        order = np.argsort(flat, kind="stable")
        fresh = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
        count = np.diff(np.append(np.flatnonzero(fresh), len(flat)))
        hit = order[np.repeat(count > 1, count)]
        hit = hit[row[hit] != SEVERAL]
        pairs, n = np.unique(of[hit] * 65536 + row[hit], return_counts=True)
        at = pairs // 65536
        for i in np.unique(at):
            own = at == i
            out.append((parts[i], sends[i], (pairs[own] % 65536).astype("<u2").tobytes(), n[own].astype("<u4").tobytes(), None, None))
    columns = list(zip(*out, strict=True)) or [[]] * 6
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["part", "send", "rows", "counts", "keys", "sizes"])


def _enough(threshold: Threshold) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """One send: the keys of its documents with enough shared shingles."""
        filled = table.column("keys").is_valid()
        about, counts = table.filter(filled), table.filter(pa.compute.invert(filled))
        keys, sizes = about.column("keys")[0].as_py(), np.frombuffer(about.column("sizes")[0].as_py(), "<u4").astype(np.int64)
        total = np.frombuffer(about.column("rows")[0].as_py(), "<u4").astype(np.int64)
        for row, n in zip(_binary(counts.column("rows"), "<u2"), _binary(counts.column("counts"), "<u4"), strict=True):
            total[row] += n
        good = np.flatnonzero(total >= threshold.least(sizes))
        return pa.table([pa.array([keys[16 * i : 16 * i + 16] for i in good.tolist()], pa.binary())], names=["set_key"])

    return run


def _slots(found: np.ndarray, slots: int) -> np.ndarray:
    return (found >> np.uint64(20)) & np.uint64(slots - 1)


def _sketched(slots: int) -> Callable:
    def pieces(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.diff(at // np.uint64(SKETCH_PART), prepend=np.uint64(slots)))
        ends = np.append(cuts[1:], len(at))
        out = [(int(at[a]) // SKETCH_PART, (at[a:b] % np.uint64(SKETCH_PART)).astype("<u2").tobytes(), n[a:b].astype("<u4").tobytes()) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["piece", "slots", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                held.append(_slots(np.frombuffer(x, "<u8"), slots))
                n += len(held[-1])
                if n >= HELD:
                    yield pieces(held)
                    held, n = [], 0
        if n:
            yield pieces(held)

    return run


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece: 0 and 1 as they are, then logarithms."""
    total = np.zeros(SKETCH_PART, np.int64)
    for batch in batches:
        for at, n in zip(_binary(batch.column("slots"), "<u2"), _binary(batch.column("counts"), "<u4"), strict=True):
            total[at] += n
    levels = np.where(total < 2, total, 1 + np.ceil(4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["piece", "levels"])


def sketch(sets: DataFrame) -> np.ndarray:
    """By slot how many sets have a shingle there, as levels that ascend. A slot for each shingle of a set, as far as MOST_SLOTS allows."""
    n = sets.agg(F.sum(F.octet_length("shingles") / 8).cast("long")).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (n - 1).bit_length())) if n else LEAST_SLOTS
    rows = sets.select("shingles").mapInArrow(_sketched(slots), "piece int, slots binary, counts binary").groupBy("piece").applyInArrow(_summed, "piece int, levels binary")
    out = np.zeros(slots, np.uint8)
    for r in rows.toLocalIterator():
        out[r["piece"] * SKETCH_PART :][:SKETCH_PART] = np.frombuffer(r["levels"], np.uint8)
    return out


def _prefixes(sent, threshold: Threshold) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            hashes, owners = [], []
            for k, x in zip(batch.column("set_key").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                found = np.frombuffer(x, "<u8")
                n = known[_slots(found, len(known))]
                order = np.lexsort((found, n))[: len(found) - threshold.least(len(found)) + 1]
                found = found[order][n[order] > 1]
                hashes.append(found.view(np.int64))
                owners += [k] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64), pa.int64()), pa.array(owners, pa.binary())], names=["shingle", "set_key"])

    return run


class Index:
    """Inverted lists over some sets, for T-occurrence search. Sets are numbered by size, so partners of a size are a range."""

    def __init__(self, sets: list[np.ndarray], threshold: Threshold):
        self.threshold, self.sizes = threshold, np.array(list(map(len, sets)), np.int64)
        flat = np.concatenate(sets)
        _, self._term = np.unique(flat, return_inverse=True)
        self._from = np.concatenate([[0], np.cumsum(self.sizes)])
        self._owner = np.repeat(np.arange(len(sets)), self.sizes)
        self._terms = int(self._term.max()) + 1
        self.alive = np.ones(len(sets), bool)
        self._build()

    def _build(self) -> None:
        """Lists of the sets that are alive, end to end, each in ascending order."""
        keep = self.alive[self._owner]
        term, owner = self._term[keep], self._owner[keep]
        self._flat = np.sort(term * len(self.sizes) + owner)
        self._lists = np.searchsorted(self._flat, np.arange(self._terms + 1) * len(self.sizes))
        self._built = int(self.alive.sum())

    def drop(self, which) -> None:
        self.alive[which] = False
        if 2 * self.alive.sum() < self._built:
            self._build()

    def search(self, q: int) -> np.ndarray:
        """The sets that are alive and linked with set q."""
        n, t = int(self.sizes[q]), self.threshold
        need = t.least(n)
        lo, hi = np.searchsorted(self.sizes, [need, n * t.den // t.num + 1])
        terms = self._term[self._from[q] : self._from[q + 1]]
        length = self._lists[terms + 1] - self._lists[terms]
        order = np.argsort(length, kind="stable")
        longest = int(length[order[-1]])
        if not longest:
            return order[:0]
        n_long = min(need - 1, math.ceil(need / (MU * math.log2(longest + 1) + 1)))
        short, long = terms[order[: n - n_long]], terms[order[n - n_long :]]
        found, count = self._merged(short, length[order[: n - n_long]])
        good = (count >= need - n_long) & (found >= lo) & (found < hi) & self.alive[found] & (found != q)
        found, count = found[good], count[good]
        # count in the long ones: merged too where that reads less than a binary search for each
        size = length[order[n - n_long :]]
        if len(found) * len(long) > size.sum() + len(self.sizes):
            total = np.zeros(len(self.sizes), np.int64)
            some, more = self._merged(long, size)
            total[some] = more
            return found[count + total[found] >= t.overlap(n, self.sizes[found])]
        out, step = [], max(1, (1 << 18) // max(1, len(long)))
        for i in range(0, len(found), step):
            some = found[i : i + step]
            probe = (long[:, None] * len(self.sizes) + some[None, :]).ravel()
            place = np.minimum(np.searchsorted(self._flat, probe), len(self._flat) - 1)
            total = count[i : i + step] + (self._flat[place] == probe).reshape(len(long), len(some)).sum(axis=0)
            out.append(some[total >= t.overlap(n, self.sizes[some])])
        return np.concatenate(out) if out else found

    def _merged(self, terms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets in the lists of some terms, and in how many of them each is."""
        at = np.repeat(self._lists[terms] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owners = self._flat[at] % len(self.sizes)
        if len(owners) < len(self.sizes):
            return np.unique(owners, return_counts=True)
        count = np.bincount(owners, minlength=len(self.sizes))
        found = np.flatnonzero(count)
        return found, count[found]

    def every(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each set with the later ones it is linked with.

        Where sets have lists in common that most of them are in, as near copies have, each query's long lists are probed for many
        sets at once: such lists are columns of ones and zeros, and counts in them a product of matrices. These have no more than LONG
        entries for each entry of a list.
        """
        n, length = len(self.sizes), np.diff(self._lists)
        long = np.flatnonzero(length * LONG > n) if n >= MANY else np.zeros(0, np.int64)
        if not len(long):
            for q in range(n):
                self.drop(q)
                yield q, self.search(q)
            return
        column = np.full(self._terms, -1, np.int64)
        column[long] = np.arange(len(long))
        there = np.zeros((n, len(long)), np.float32)
        own = np.flatnonzero(column[self._term] >= 0)
        there[self._owner[own], column[self._term[own]]] = 1
        t = self.threshold
        ends = np.searchsorted(self.sizes, self.sizes * t.den // t.num + 1)
        step = max(1, COUNTS // n)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            end = int(ends[hi - 1])
            counts = there[lo:hi] @ there[lo:end].T
            for q in range(lo, hi):
                terms = self._term[self._from[q] : self._from[q + 1]]
                terms = terms[column[terms] < 0]
                total = counts[q - lo, q + 1 - lo : ends[q] - lo]
                some, more = self._merged(terms, length[terms])
                inside = (some > q) & (some < ends[q])
                total[some[inside] - q - 1] += more[inside]
                yield q, q + 1 + np.flatnonzero(total >= t.overlap(int(self.sizes[q]), self.sizes[q + 1 : ends[q]]))


def linked(sets: list[np.ndarray], threshold: Threshold) -> list[tuple[int, int]]:
    """Links between sets that connect what is connected, one fewer than each component has members."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    index, out = Index([sets[i] for i in order], threshold), []
    for seed in range(len(order)):
        if not index.alive[seed]:
            continue
        index.drop(seed)
        open_ = [seed]
        while open_:
            q = open_.pop()
            hits = index.search(q)
            index.drop(hits)
            open_ += hits.tolist()
            out += [(order[q], order[int(x)]) for x in hits]
    return out


def all_links(sets: list[np.ndarray], threshold: Threshold, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each set with the sets it is linked with, every link once; where there are two blocks, only links between them."""
    order = np.array(sorted(range(len(sets)), key=lambda i: len(sets[i])))
    index = Index([sets[i] for i in order], threshold)
    cross = len(np.unique(own)) > 1
    for q, found in index.every():
        i, found = int(order[q]), order[found]
        if cross:
            found = found[own[found] != own[i]]
        if len(found):
            yield i, found


def _tile(table: pa.Table, threshold: Threshold) -> tuple[list[bytes], Iterator[tuple[int, np.ndarray]]]:
    """The keys and links of one task."""
    keys, sets = table.column("set_key").to_pylist(), _binary(table.column("shingles"), "<u8")
    return keys, all_links(sets, threshold, table.column("own").to_numpy()) if len(sets) > 1 else iter(())


def _tree(threshold: Threshold) -> Callable:
    """Links that connect what is connected."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, sets = table.column("set_key").to_pylist(), _binary(table.column("shingles"), "<u8")
        found = linked(sets, threshold) if len(sets) > 1 else []
        return pa.table([pa.array([keys[a] for a, _ in found], pa.binary()), pa.array([keys[b] for _, b in found], pa.binary())], names=["a", "b"])

    return run


def _pairs(threshold: Threshold) -> Callable:
    """All links."""

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, links = _tile(table, threshold)
        names = pa.array(keys, pa.binary())
        for q, found in links:
            yield pa.RecordBatch.from_arrays([pa.array([keys[q]] * len(found), pa.binary()), names.take(pa.array(found))], names=["a", "b"])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(key, table), pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return whole


def _counts(threshold: Threshold) -> Callable:
    """Links that connect what is connected (a, b), and for each set that has links the documents they lead to (a, n)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, links = _tile(table, threshold)
        copies, total = table.column("copies").to_numpy(), np.zeros(len(keys), np.int64)
        label, members, tree = np.arange(len(keys)), {i: [i] for i in range(len(keys))}, []
        for q, found in links:
            total[q] += copies[found].sum()
            total[found] += copies[q]
            fresh = found[label[found] != label[q]]
            for x in fresh[np.unique(label[fresh], return_index=True)[1]].tolist():
                tree.append((keys[q], keys[x]))
                a, b = int(label[q]), int(label[x])
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                moved = members.pop(b)
                label[moved] = a
                members[a] += moved
        some = np.flatnonzero(total)
        a = [x for x, _ in tree] + [keys[i] for i in some.tolist()]
        b = [y for _, y in tree] + [None] * len(some)
        n = [None] * len(tree) + total[some].tolist()
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def _links(sets: DataFrame, threshold: Threshold, block: int, search: Callable, schema: str) -> DataFrame:
    """What the search of each task gives for the sets (set_key, shingles, copies)."""
    sent = sets.sparkSession.sparkContext.broadcast(sketch(sets))
    postings = stored(sets.mapInArrow(_prefixes(sent, threshold), "shingle long, set_key binary"), "postings")
    stars = postings.groupBy("shingle").agg(F.min("set_key").alias("a"), F.max("set_key").alias("z")).where("a <> z").drop("z")
    groups = components(unique_join(postings, stars, "shingle").where("a is not null").select("a", F.col("set_key").alias("b")))
    held = sets.select("set_key", (F.octet_length("shingles") / 8).cast("long").alias("n")).join(groups.select(F.col("node").alias("set_key"), "root"), "set_key")
    held = stored(held, "groups")
    sizes = stored(held.groupBy("root").agg(F.sum("n").alias("total")), "sizes")
    large = sizes.where(F.col("total") > 2 * block).select("root")
    packs = max(1, math.ceil((sizes.agg(F.sum("total")).first()[0] or 0) / block))
    of_large = unique_join(held, large.withColumn("large", F.lit(True)), "root")
    small = of_large.where("large is null").select("set_key", F.lit(None).cast("binary").alias("root"), F.lit(-1).cast("long").alias("i"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("long").alias("j"), F.lit(0).cast("long").alias("own"))
    tiles = small.unionByName(_dealt_by_size(of_large.where("large").drop("large"), threshold, block)).join(sets, "set_key")
    return tiles.groupBy("root", "i", "j").applyInArrow(search, schema)


def _dealt_by_size(held: DataFrame, threshold: Threshold, block: int) -> DataFrame:
    """Sets of large groups (set_key, n, root) by the tiles (root, i, j) they go to, i to j where blocks of their sizes can have links."""
    key = F.struct("root", "n")
    of_size = held.groupBy("root", "n").agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = of_size.select(key.alias("key"), before.alias("before"), "all")
    share = F.pmod(F.xxhash64("set_key"), F.lit(1 << 20)) / (1 << 20)
    placed = unique_join(held.withColumn("key", key), starts, "key").withColumn("own", F.floor((F.col("before") + share * F.col("all")) / block))
    placed = stored(placed.select("set_key", "root", "n", "own"), "blocks")
    blocks = stored(placed.groupBy("root", "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "block-sizes")
    a, b = blocks.select("root", F.col("own").alias("i"), F.col("hi").alias("most")), blocks.select("root", F.col("own").alias("j"), F.col("lo").alias("least"))
    meeting = a.join(b, "root").where((F.col("i") <= F.col("j")) & (F.col("most") * threshold.den >= F.col("least") * threshold.num))
    sides = meeting.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    return placed.join(sides, ["root", "own"]).select("set_key", "root", "i", "j", "own")


def _summarised(rows: DataFrame, size: int) -> DataFrame:
    return stored(rows.mapInArrow(_summaries(size), "doc_id long, n_shingles long, set_key binary"), "sets")


def _candidates(rows: DataFrame, all_sets: DataFrame, size: int, threshold: Threshold) -> DataFrame:
    """set_key, shingles and copies of the sets that share enough shingles with others."""
    buckets = max(1, math.ceil((all_sets.agg(F.sum("n_shingles")).first()[0] or 0) / BUCKET))
    counted = rows.select("text").mapInArrow(_sends(size, buckets), _SENT).groupBy("bucket").applyInArrow(_shared, "part int, send int, rows binary, counts binary, keys binary, sizes binary")
    good = stored(counted.groupBy("part", "send").applyInArrow(_enough(threshold), "set_key binary").distinct(), "candidates")
    sent = rows.sparkSession.sparkContext.broadcast(bloom.key_filter(good, bloom.size_for(good.count(), 16)))
    near = rows.select("text").mapInArrow(_with_sets(size, sent), "set_key binary, shingles binary")
    return stored(near.join(good, "set_key", "left_semi").groupBy("set_key").agg(F.first("shingles").alias("shingles"), F.count("*").alias("copies")), "shingles")


def pairs(docs: DataFrame, text_col: str = "text", size: int = 5, threshold: Threshold = Threshold(), block: int = BLOCK) -> DataFrame:
    """A row (a, b) per two different shingle sets, by their keys, that are linked. Rows grow with the square of a group's sets."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = _candidates(rows, _summarised(rows, size), size, threshold)
    return _links(sets, threshold, block, _pairs(threshold), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Threshold = Threshold(), block: int = BLOCK, links: bool = True) -> DataFrame:
    """A row per document: doc_id, n_shingles, set_key, component (the smallest set key it is connected with), component_id and, unless links is off, n_links, the other documents it is linked with."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_sets = _summarised(rows, size)
    by_key = all_sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    sets = _candidates(rows, all_sets, size, threshold)
    if links:
        found = stored(_links(sets, threshold, block, _counts(threshold), "a binary, b binary, n long"), "links")
        edges, totals = found.where("b is not null").select("a", "b"), found.where("n is not null").groupBy(F.col("a").alias("set_key")).agg(F.sum("n").alias("others"))
    else:
        edges = _links(sets, threshold, block, _tree(threshold), "a binary, b binary")
    roots = stored(components(edges), "components")
    named = by_key.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").where("n > 1 or root is not null")
    if links:
        named = named.join(totals, "set_key", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("others", F.lit(0)))
    counts = ["n_links"] if links else []
    named = stored(named.select("set_key", "doc_id", F.coalesce("root", "set_key").alias("component"), *counts), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = stored(unique_join(named.select("set_key", "component", *counts), least, "component"), "names")
    joined = unique_join(all_sets, names, "set_key")
    own = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return joined.select("doc_id", "n_shingles", "set_key", F.coalesce("component", "set_key").alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *own)


def _keyed(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                keys = pa.array(map(set_key, shingle_sets(texts.lower(), size)), pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, keys], names=[*rows.schema.names, "set_key"])

    return run


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: Threshold = Threshold(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One document of each component: the one with the smallest id, then the smallest set key and text. Columns: doc_id, text, those to carry.

    Documents without shingles all stay. Columns to carry must not be named set_key, chosen, chosen_set, again or again_set.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    all_sets = _summarised(rows.select("doc_id", "text"), size)
    found = all_sets.where("set_key is not null")
    edges = _links(_candidates(rows, all_sets, size, threshold), threshold, BLOCK, _tree(threshold), "a binary, b binary")
    roots = stored(components(edges), "components")
    first = found.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("x"))
    of_set = first.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select(F.coalesce("root", "set_key").alias("component"), F.struct("x.none", "x.doc_id", "set_key").alias("x"))
    chosen = stored(of_set.groupBy("component").agg(F.min("x").alias("x")).select(F.col("x.doc_id").alias("chosen"), F.col("x.set_key").alias("chosen_set")), "chosen")
    keyed = rows.mapInArrow(_keyed(size), StructType([*rows.schema, StructField("set_key", BinaryType())]))
    kept = keyed.join(chosen, F.expr("doc_id <=> chosen and set_key = chosen_set"), "left_semi")
    without = keyed.where("set_key is null").select(*rows.columns)
    # rows that have both id and set in common are seldom; only those are grouped
    again = stored(found.groupBy("doc_id", "set_key").count().where("count > 1").select(F.col("doc_id").alias("again"), F.col("set_key").alias("again_set")), "again")
    if not again.limit(1).count():
        return kept.select(*rows.columns).unionByName(without)
    both = F.expr("doc_id <=> again and set_key = again_set")
    one = kept.join(again, both, "left_semi").groupBy("doc_id", "set_key").agg(*(F.min_by(c, "text").alias(c) for c in rows.columns[1:]))
    return kept.join(again, both, "left_anti").select(*rows.columns).unionByName(one.select(*rows.columns)).unionByName(without)
