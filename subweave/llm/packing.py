"""Packing of token sequences into windows by non-negative least squares.

Each document's ids are cut into whole windows and a rest shorter than one. Whole windows are sequences of their own. The counts of
rests by length, a table no longer than a window at any corpus size, are what the driver plans with: it enumerates the ways to
fill a window with two, three or four rests and finds by non-negative least squares, with an active set, how often each is to be
repeated so that together they match the counts. The repeats are rounded, what that leaves is solved again, and the few rests that
no solution takes are packed greedily, longest first. The plan says, for the k-th rest of a length, which sequence and place
it has; k comes from counts by task and length, so no task sees all rests of a length.

Nulls, empties, ties: a null text is empty and has only the end id. Rows are packed one by one, also repeated ones and those
without an id. Rests of one length are interchangeable: their order is that of the tasks. Other columns are not looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subweave.store import stored
from subweave.llm.text import sliced
from subweave.llm.tokens import library_ids

WINDOW, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k.json"
#: Solutions that are rounded one after the other, rounds of the active set, and steps of conjugate gradients in each.
ROUNDS, ACTIVATED, STEPS = 6, 24, 100
#: Lengths that the two shortest rests of a quadruple are chosen from.
FREQUENT = 32

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def _pieces(window: int, end_id: int, tokenizer: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                ids, offsets = library_ids(texts, tokenizer, drops_space=False)
                docs, out = rows.column("doc_id").to_pylist(), []
                for doc, a, b in zip(docs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), window):
                        piece = own[start : start + window]
                        out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(own), part, seen[len(piece)]))
                        seen[len(piece)] += 1
                columns = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return run


def combinations(counts: np.ndarray, window: int, frequent: int = FREQUENT) -> np.ndarray:
    """Pairs, triples and some quadruples of lengths that fill the window, ascending, with zeros before them in rows of four.

    The two shortest of a quadruple are among the most frequent lengths. So there are at most about window^2 / 12 rows of
    three and frequent^2 * window / 4 of four, however large the counts are.
    """
    lengths = np.flatnonzero(counts[:window])
    lengths = lengths[lengths > 0]
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    out = []

    def last_two(*head: int) -> None:
        """Rows that begin with head, and two lengths no shorter."""
        room, least = window - sum(head), head[-1] if head else 1
        y = lengths[(lengths >= least) & (lengths <= room // 2)]
        y = y[there[room - y]]
        out.append(np.column_stack([*(np.full(len(y), h) for h in (0,) * (2 - len(head)) + head), y, room - y]))

    last_two()
    for x in lengths[lengths <= window // 3].tolist():
        last_two(x)
    often = np.sort(lengths[np.argsort(-counts[lengths], kind="stable")][:frequent]).tolist()
    for i, x in enumerate(often):
        for y in often[i:]:
            if x + 3 * y <= window:
                last_two(x, y)
    return np.concatenate(out)


class LeastSquares:
    """min |Ax - target|, x >= 0, where column i of A has a one for each length in row i of combos. Length 0 stands for none."""

    def __init__(self, combos: np.ndarray, target: np.ndarray):
        self.combos, self.target = combos, target.astype(float)
        self.target[0] = 0

    def product(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.bincount(self.combos[own].ravel(), np.repeat(x, self.combos.shape[1]), len(self.target))
        out[0] = 0
        return out

    def residual(self, x: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(x)
        return self.target - self.product(own, x[own])

    def _free(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least squares over some columns without the sign, by conjugate gradients from x on."""
        back = lambda v: v[self.combos[own]].sum(axis=1)
        rest = self.target - self.product(own, x)
        slope = back(rest)
        step, size = slope, slope @ slope
        least = 1e-12 * size
        for _ in range(STEPS):
            if size <= least or size < 1e-12:
                break
            made = self.product(own, step)
            by = size / (made @ made)
            x, rest = x + by * step, rest - by * made
            slope = back(rest)
            size, before = slope @ slope, size
            step = slope + size / before * step
        return x

    def solved(self, rounds: int = ACTIVATED) -> np.ndarray:
        """Active set: columns that would lower the residual most, no two with a length in common, come in together; those that would become negative leave."""
        x, active = np.zeros(len(self.combos)), np.zeros(len(self.combos), bool)
        for _ in range(rounds):
            gain = self.residual(x)[self.combos].sum(axis=1)
            gain[active] = 0
            best = np.flatnonzero(gain > 1e-6 * max(1.0, self.target.max()))
            best = best[np.argsort(-gain[best], kind="stable")][: 8 * len(self.target)]
            taken, entering = np.zeros(len(self.target), bool), []
            for i in best.tolist():
                lengths = self.combos[i][self.combos[i] > 0]
                if not taken[lengths].any():
                    taken[lengths] = True
                    entering.append(i)
            if not entering:
                break
            active[entering] = True
            while active.any():
                own = np.flatnonzero(active)
                aim = self._free(own, x[own])
                bad = aim <= 0
                if not bad.any():
                    x[own] = aim
                    break
                at = x[own]
                far = at[bad] / (at[bad] - aim[bad] + 1e-30)
                x[own] = np.maximum(at + far.min() * (aim - at), 0)
                gone = own[bad][far <= far.min() * (1 + 1e-9)]
                x[gone], active[gone] = 0, False
        return x


def solved_fillings(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of full windows by rounded solutions; left is lowered by what they use.

    Repeats are rounded to whole numbers as far as the rests allow, most repeated first. What rounding leaves is a smaller
    problem of the same kind, which is solved again; from then on every combination of the solution is tried once at least.
    """
    out = []
    for k in range(ROUNDS):
        combos = combinations(left, window)
        if not len(combos):
            break
        x = LeastSquares(combos, left[: window + 1]).solved()
        used = 0
        for i in np.argsort(-x, kind="stable")[:window]:
            if x[i] < 1e-6:
                break
            own, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
            n = min(max(int(x[i] + 0.5), min(k, 1)), int((left[own] // times).min()))
            if n:
                left[own] -= n * times
                out.append((tuple(sorted(combos[i][combos[i] > 0].tolist(), reverse=True)), n))
                used += n
        if not used:
            break
    return out


def greedy_fillings(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings for all that is left: the longest rest, then again and again the longest that fits."""
    out, fits = [], np.zeros(window + 1, np.int64)

    def longest(room: int) -> int:
        while room and not left[room] - fits[room]:
            room -= 1
        return room

    top = window
    while top := longest(top):
        own, room, times = [], window, {}
        while x := longest(min(room, top)):
            own.append(x)
            fits[x] += 1
            times[x] = times.get(x, 0) + 1
            room -= x
        n = min(int(left[k]) // v for k, v in times.items())
        for k, v in times.items():
            fits[k] = 0
            left[k] -= n * v
        out.append((tuple(own), n))
    return out


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of the window (lengths, longest first) and how often each is used; counts has the rests of each length.

    There are at most `window` fillings for each of ROUNDS solutions. A greedy one uses up a length but for fewer rests than a
    window holds of it, so there are at most window * (ln window + 1) of those: the plan does not grow with the corpus.
    """
    left = counts.astype(np.int64).copy()
    return solved_fillings(left, window) + greedy_fillings(left, window)


def places(fillings: list[tuple[tuple[int, ...], int]], window: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of its rests: the number of the first, its sequence, its place there, and rests of that length a sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, n in fillings:
        at = 0
        for x in lengths:
            out.setdefault(x, []).append((taken.get(x, 0), sequence, at))
            taken[x] = taken.get(x, 0) + n
            at += x
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def _placed(sent, first: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            length, k = batch.column("length").to_numpy(), batch.column("k").to_numpy()
            sequence, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                start, base, at = known[x]
                run_ = np.searchsorted(start, k[own], "right") - 1
                sequence[own], offset[own] = first + base[run_] + k[own] - start[run_], at[run_]
            columns = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(window, end_id, tokenizer), _PIECE), "pieces")
    counted = stored(pieces.groupBy("length", "part").count(), "piece-counts")
    counts = np.zeros(window + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[r["length"]] = r["n"]
    whole = int(counts[window])
    counts[window] = 0
    table = places(plan(counts, window), window)
    # Whole windows come first, numbered as they are.
    table[window] = tuple(np.array([v], np.int64) for v in (0, -whole, 0))
    sent = rows.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("k"))
    return ranked.mapInArrow(_placed(sent, whole), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
