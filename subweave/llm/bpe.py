"""Byte-pair encoding as a streaming transducer, and decoding as an incremental state machine.

The encoder reads characters as they come. A state machine splits them into pre-tokens, and each pre-token's bytes go into a
transducer that knows, for every position, the one token that the encoding of the text up to there ends with: the token that ends
there and goes with the one before it, where two tokens go together if encoding the two of them gives the two of them.
Whatever follows, the encoding passes through one of the positions that are less than the longest token away. So a token is stable,
and leaves, once the ways back from all those positions lead through it. The merge list bounds how far that can lie ahead: at
most the number of merges times the longest token, its sufficient lookahead. What is held never grows beyond that.

The decoder turns ids into bytes and bytes into text, holding at most one unfinished character.

Nulls, empties, ties: a null or empty text has no ids and decodes to an empty text. Rows are encoded one by one, whatever their
ids. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subweave.llm.text import Texts, sliced
from subweave.llm.tokens import LONGEST, Encoder, held, spaced_units, whole_ids

TOKENIZER = "byte_bpe_50k.json"
#: Pairs of tokens, and short pre-tokens, that an encoder remembers; both memories are emptied when full.
PAIRS, SHORT = 1 << 20, 1 << 17


def byte_letters() -> dict[str, int]:
    """The bytes behind the letters in which byte-level vocabularies are written: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary of byte strings and an ordered list of merges."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in self.special:
            self.id.pop(s.encode(), None)
        self.bytes = {i: b for b, i in self.id.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.id[raw(a)], self.id[raw(b)]] = (n, self.id[raw(a + b)])
        self.longest = max(map(len, self.id))
        #: For each token that is merged: when, and from what.
        self.made = {c: (n, *pair) for pair, (n, c) in sorted(self.rank.items(), key=lambda x: -x[1][0])}

    @cached_property
    def lookahead(self) -> int:
        """Bytes after which what stands before them is settled, whatever follows."""
        return len(self.rank) * self.longest

    def together(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are.

        Looks back in time from the two, undoing the later of the merges next to their border. They stay if at no
        time the pieces at the border would have been merged before the merge undone last.
        """
        bound, made, rank = (len(self.rank), False), self.made, self.rank
        while True:
            across = rank.get((a, b))
            if across is not None and (across[0] < bound[0] or (bound[1] and across[0] == bound[0])):
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                bound, a = (x[0], False), x[2]
            else:  # of equal merges the left one comes first, so one across the border would too
                bound, b = (y[0], True), y[1]

    def apply(self, ids: list[int]) -> list[int]:
        """The merges in their order, the leftmost first."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            pair = ids[i], ids[i + 1]
            new, out, k = self.rank[pair][1], ids[:i], i
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(new)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids


class Transducer:
    """One pre-token's bytes in, stable tokens out."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._pairs: dict[tuple[int, int], bool] = {}
        self._sizes = sorted({len(b) for b in merges.id})
        self.start()

    def start(self) -> None:
        self._held = b""  # bytes that have not left
        self._token, self._back = [-1], [-1]  # at each position in held: the last token, and where it starts
        self._first = -1  # the token that left last

    def feed(self, data: bytes) -> list[int]:
        """The tokens that became stable."""
        ids, sizes, pairs, longest, out = self.merges.id, self._sizes, self._pairs, self.merges.longest, []
        end = len(self._held)
        self._held += data
        for _ in data:
            end += 1
            held_, token = self._held, self._token
            for size in sizes:
                t = ids.get(held_[end - size : end])
                if t is None:
                    continue
                before = token[end - size]
                if before < 0:
                    before = self._first
                if before >= 0:
                    good = pairs.get((before, t))
                    if good is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        good = pairs[before, t] = self.merges.together(before, t)
                    if not good:
                        continue
                token.append(t)
                self._back.append(end - size)
                break
            if end >= 4 * longest and not end % longest:
                out += self._settle(end)
                end -= len(held_) - len(self._held)
        return out

    def _way(self, at: int) -> list[int]:
        """Positions on the way back from at, the nearest to the start first."""
        out = []
        while at > 0:
            out.append(at)
            at = self._back[at]
        return out[::-1]

    def _settle(self, end: int) -> list[int]:
        live = set(range(max(0, end - self.merges.longest + 1), end + 1))
        while len(live) > 1:  # the farthest steps back until all have met
            at = max(live)
            live.remove(at)
            live.add(self._back[at])
        meet = max(0, live.pop())
        assert end - meet <= self.merges.lookahead
        return self._leave(meet)

    def _leave(self, upto: int) -> list[int]:
        way = self._way(upto)
        out = [self._token[p] for p in way]
        if out:
            self._held, self._first = self._held[upto:], out[-1]
            self._token = [-1, *self._token[upto + 1 :]]
            self._back = [-1, *(p - upto for p in self._back[upto + 1 :])]
        return out

    def finish(self) -> list[int]:
        out = self._leave(len(self._held))
        self.start()
        return out


#: The contractions of the pre-tokenizer, and the white space characters of Unicode.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE_SPACE = frozenset(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LETTER, NUMBER, SPACE, OTHER = range(4)


class Splitter:
    """Characters in, pre-tokens out in pieces: (text, whether the pre-token ends with it)."""

    def __init__(self) -> None:
        self._kinds: dict[str, int] = {}
        self.start()

    def start(self) -> None:
        self._state = None  # the kind of characters the open pre-token takes, if one is open
        self._space = ""  # the last character of a run of white space, which may belong to what follows
        self._run = False  # whether more of the run has left before it
        self._quote = ""  # a contraction in the making

    def kind(self, c: str) -> int:
        k = self._kinds.get(c)
        if k is None:
            general = unicodedata.category(c)[0]
            k = self._kinds[c] = SPACE if c in WHITE_SPACE else LETTER if general == "L" else NUMBER if general == "N" else OTHER
        return k

    def feed(self, text: str) -> Iterator[tuple[str, bool]]:
        for c in text:
            yield from self._next(c)

    def _next(self, c: str) -> Iterator[tuple[str, bool]]:
        kind = self.kind(c)
        if self._quote:
            whole = self._quote + c
            if whole in CONTRACTIONS:
                self._quote = ""
                yield whole, True
                return
            if any(x.startswith(whole) for x in CONTRACTIONS):
                self._quote = whole
                return
            held, self._quote = self._quote, ""
            yield "'", False
            self._state = OTHER
            for x in held[1:] + c:
                yield from self._plain(x, self.kind(x))
            return
        yield from self._plain(c, kind)

    def _plain(self, c: str, kind: int) -> Iterator[tuple[str, bool]]:
        if self._state == kind and kind != SPACE:
            yield c, False
            return
        if self._state is not None and self._state != SPACE:
            yield "", True
            self._state = None
        if kind == SPACE:
            if self._state == SPACE:
                yield self._space, False
                self._run = True
            self._state, self._space = SPACE, c
            return
        lead = ""
        if self._state == SPACE:
            if self._run:
                yield "", True
            if self._space == " ":
                lead = " "
            else:
                yield self._space, True
            self._run, self._state = False, None
        if c == "'" and not lead:
            self._quote = c
            return
        yield lead + c, False
        self._state = kind

    def finish(self) -> Iterator[tuple[str, bool]]:
        if self._quote:
            held, self._quote = self._quote, ""
            yield "'", False
            self._state = OTHER
            for x in held[1:]:
                yield from self._plain(x, self.kind(x))
        if self._state == SPACE:
            yield self._space, True
        elif self._state is not None:
            yield "", True
        self.start()


class StreamingEncoder:
    """Text in pieces of any size in, ids out as soon as they are stable."""

    def __init__(self, merges: Merges):
        self._split, self._bytes, self._special = Splitter(), Transducer(merges), merges.special
        self._most = max(map(len, self._special), default=1) - 1
        self._tail = ""

    def feed(self, text: str) -> list[int]:
        return self._run(self._tail + text, last=False)

    def finish(self) -> list[int]:
        out = self._run(self._tail, last=True)
        self._tail = ""
        return out

    def _run(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        while True:
            at, name = min(((text.find(s), s) for s in self._special if s in text), default=(-1, ""))
            if at < 0:
                break
            out += self._plain(text[:at], last=True)
            out.append(self._special[name])
            text = text[at + len(name) :]
        keep = 0 if last else next((n for n in range(min(self._most, len(text)), 0, -1) if any(s.startswith(text[-n:]) for s in self._special)), 0)
        self._tail = text[len(text) - keep :]
        return out + self._plain(text[: len(text) - keep], last)

    def _plain(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        for run in (self._split.feed(text), self._split.finish() if last else ()):
            for piece, ended in run:
                if piece:
                    out += self._bytes.feed(piece.encode())
                if ended:
                    out += self._bytes.finish()
        return out


class StreamingDecoder:
    """Ids in, text out; bytes that are no character become U+FFFD."""

    def __init__(self, merges: Merges):
        self._bytes, self._text = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self._text.decode(b"".join([self._bytes[i] for i in ids]))

    def finish(self) -> str:
        out = self._text.decode(b"", True)
        self._text.reset()
        return out


_merges: dict[str, Merges] = {}


def merges(name: str) -> Merges:
    """The merge list of the file of that name, read once a worker."""
    if name not in _merges:
        _merges[name] = Merges(public_tokenizers.path(name))
    return _merges[name]


def _encoder(name: str) -> Encoder:
    own = merges(name)
    stream, transducer, split = StreamingEncoder(own), Transducer(own), regex.compile(public_tokenizers.PATTERN).findall
    short: dict[str, list[int]] = {}

    def encode(units: list[bytes]) -> list[list[int]]:
        out = []
        for u in units:
            text = u.decode()
            if len(u) > LONGEST or any(s in text for s in own.special):
                ids = stream.feed(text)
                out.append(ids + stream.finish())
                continue
            ids = []
            for part in split(text):
                if (found := short.get(part)) is None:
                    if len(short) >= SHORT:
                        short.clear()
                    found = short[part] = transducer.feed(part.encode()) + transducer.finish()
                ids += found
            out.append(ids)
        return out

    return encode


def encoded(texts: Texts, name: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows end to end, and the rows' offsets in them; units that come again are taken from the worker's memory."""
    return whole_ids(held(("own", name), lambda: _encoder(name)), texts, spaced_units)


def _round_trip(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamingDecoder(merges(name))
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                ids, offsets = encoded(texts, name)
                decoded, blobs = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = [decoder.feed(ids[i : min(b, i + 4096)].tolist()) for i in range(a, b, 4096)]
                    decoded.append("".join(own) + decoder.finish())
                    blobs.append(ids[a:b].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and what they decode to."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_round_trip(tokenizer), "doc_id long, ids binary, decoded string")

