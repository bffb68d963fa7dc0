"""Token ids of whole texts by way of their units.

A unit is a stretch of a text that the tokenizer's own pre-tokenizer never joins with its neighbours: texts are cut where a
single space or newline stands between two characters that are surely not white space, and between a Latin letter and a
punctuation mark other than the apostrophe. So the ids of a text are the ids of its units one after the other, and a unit that
comes again need not be encoded again. Each worker keeps the ids of a bounded number of short units; a full memory is emptied.

Units are grouped and remembered by hash, and each is then compared with the one that stands for its hash; units that differ
from it are encoded by themselves.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers

from subweave.llm.text import LOW_BYTES, Texts

#: Units that a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 64
#: An encoder takes some units as bytes and gives the ids of each.
Encoder = Callable[[list[bytes]], list[list[int]]]

_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LEAD = {2: np.zeros(256, bool), 3: np.zeros(256, bool), 4: np.zeros(256, bool)}
_LEAD[2][0xC3:0xE0] = True  # C2 leads two white space characters
_LEAD[3][0xE4:0xEE] = True  # E1 to E3 lead the others
_LEAD[4][0xF0:0xF5] = True
_NEXT = _ASCII | _LEAD[2] | _LEAD[3] | _LEAD[4]


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _ASCII & ~_LETTER
_MARK[48:58] = _MARK[0x27] = False
#: What begins a special token, inside which nothing is cut at letters and marks.
_SPECIAL = b"<|"


def _between(texts: Texts) -> np.ndarray:
    """Where a space or a newline stands alone between two characters that are not white space."""
    d, n = texts.data, len(texts.data)
    at = np.flatnonzero((d == 0x20) | (d == 0x0A))
    at = at[(at > 0) & (at < n - 1)]
    before = d[at - 1]
    solid = _ASCII[before]
    other = np.flatnonzero((before & 0xC0) == 0x80)
    for k in (2, 3, 4):
        solid[other] |= (at[other] >= k) & _LEAD[k][d[np.maximum(at[other] - k, 0)]]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    return at[solid & _NEXT[d[at + 1]] & ~edge[at] & ~edge[at + 1]]


def _flags(texts: Texts, blob: bytes) -> np.ndarray:
    """Flags of the bytes that begin a row, or a letter next to a mark, or a mark next to a letter."""
    d = texts.data
    out = np.zeros(len(d) + 1, bool)
    if len(d) and _SPECIAL not in blob:
        letter, mark = _LETTER[d], _MARK[d]
        # the last byte of a letter of Latin-1: C3 and any but the signs of multiplication and division
        latin = (d[:-1] == 0xC3) & (d[1:] != 0x97) & (d[1:] != 0xB7)
        ends = letter.copy()
        ends[1:] |= latin
        letter[:-1] |= latin
        out[1:-1] = (ends[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    out[texts.offsets[:-1]] = True
    return out


def spaced_units(texts: Texts, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units where a space belongs to the word behind it and a newline is a unit."""
    flags, cut = _flags(texts, blob), _between(texts)
    flags[cut] = flags[cut[texts.data[cut] == 0x0A] + 1] = True
    starts = np.flatnonzero(flags[:-1])
    return starts, np.append(starts[1:], len(texts.data))


def bare_units(texts: Texts, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units without the white space between them, for tokenizers that drop it."""
    flags, cut = _flags(texts, blob), _between(texts)
    flags[cut + 1] = True
    starts = np.flatnonzero(flags[:-1])
    ends = np.append(starts[1:], len(texts.data))
    dropped = np.zeros(len(texts.data) + 1, bool)
    dropped[cut + 1] = True
    return starts, ends - dropped[ends]


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _differ(data: np.ndarray, starts: np.ndarray, length: np.ndarray, other: np.ndarray, others: np.ndarray, other_length: np.ndarray) -> np.ndarray:
    """Whether each byte range of data differs from that of other; both have eight bytes more than their ranges."""
    eight = [np.ndarray((len(d) - 7,), "<u8", d, 0, (1,)) for d in (data, other)]
    out = length != other_length
    at, more = 0, np.flatnonzero(~out)
    while len(more):
        a, b = starts[more] + at, others[more] + at
        wrong = ((eight[0][a] ^ eight[1][b]) & LOW_BYTES[np.minimum(length[more] - at, 8)]) != 0
        out[more[wrong]] = True
        at += 8
        more = more[(length[more] > at) & ~wrong]
    return out


def _added(store: np.ndarray, offsets: np.ndarray, k: int, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """store with the values of len(sizes) entries after the first k, and room for eight more; offsets are set."""
    lo = int(offsets[k])
    hi = lo + len(values)
    offsets[k + 1 : k + 1 + len(sizes)] = lo + np.cumsum(sizes)
    if hi + 8 > len(store):
        store = np.concatenate([store, np.zeros(max(len(store), len(values) + 8), store.dtype)])
    store[lo:hi] = values
    return store


class Memory:
    """The ids of units, numbered in the order they were first met, with the units' hashes in ascending order."""

    def __init__(self, encode: Encoder, room: int = REMEMBERED):
        self.encode, self._room = encode, room
        self._clear()

    def _clear(self) -> None:
        self._keys, self._number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._ids, self._offsets = np.zeros(1 << 16, np.uint32), np.zeros(self._room + 2, np.int64)
        self._bytes, self._places = np.zeros(1 << 16, np.uint8), np.zeros(self._room + 2, np.int64)

    def _learn(self, keys: np.ndarray, at: np.ndarray, units: list[bytes]) -> None:
        k, found = len(self._keys), self.encode(units)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._ids = _added(self._ids, self._offsets, k, sizes, np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()))
        self._bytes = _added(self._bytes, self._places, k, np.fromiter(map(len, units), np.int64, len(units)), np.frombuffer(b"".join(units), np.uint8))
        self._keys, self._number = np.insert(self._keys, at, keys), np.insert(self._number, at, np.arange(k, k + len(units)))

    def _numbers(self, keys: np.ndarray, blob: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the units that have these hashes, in ascending order; those at starts and ends are learned where none has."""
        at = np.searchsorted(self._keys, keys)
        fresh = at == len(self._keys)
        fresh[~fresh] = self._keys[at[~fresh]] != keys[~fresh]
        if len(self._keys) + np.count_nonzero(fresh) > self._room:
            self._room = max(self._room, len(keys))
            self._clear()
            at, fresh = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        if fresh.any():
            self._learn(keys[fresh], at[fresh], [blob[i:j] for i, j in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
        return self._number[np.searchsorted(self._keys, keys)]

    def ids(self, texts: Texts, blob: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, and the offsets of the rows in them. blob is the texts' bytes."""
        length, data = ends - starts, _padded(texts.data)
        alone = length > LONGEST
        small = np.flatnonzero(~alone)
        a, size = starts[small], length[small]
        keys, first, group = np.unique(texts.hashes(a, a + size), return_index=True, return_inverse=True)
        number = self._numbers(keys, blob, a[first], a[first] + size[first])
        held_at = self._places[number]
        wrong = _differ(data, a[first], size[first], self._bytes, held_at, self._places[number + 1] - held_at)
        alone[small] = wrong[group] | _differ(data, a, size, data, a[first][group], size[first][group])
        own = {i: np.array(self.encode([blob[starts[i] : ends[i]]])[0], np.uint32) for i in np.flatnonzero(alone).tolist()}
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[small], n[small] = self._offsets[number][group], (self._offsets[number + 1] - self._offsets[number])[group]
        for i, x in own.items():
            n[i] = len(x)
        place = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(at - place[:-1], n) + np.arange(place[-1])
        for i in own:
            where[place[i] : place[i + 1]] = 0
        out = self._ids[where]
        for i, x in own.items():
            out[place[i] : place[i + 1]] = x
        return out, place[np.searchsorted(starts, texts.offsets)]


_held: dict[tuple, Memory] = {}


def held(key: tuple, make: Callable[[], Encoder]) -> Memory:
    """This worker's memory under the key."""
    if key not in _held:
        _held[key] = Memory(make())
    return _held[key]


#: Rules under which the case of Latin letters is lost, and letters are one token after the other up to one that ends the word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Letters of ASCII and Latin-1 alone: nothing in them is composed or split.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class Library:
    """An encoder by the tokenizers library.

    Many units go in as one text with a special token between them: the library takes special tokens out before it does anything
    else, and what stands between them one by one. Units that have special tokens themselves go in alone. Where the file's rules
    make a word of any run of letters, units of letters alone have spaces between them instead, and their ids are told apart by
    the tokens that end words.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(file)
        self._own.no_truncation()
        self._own.no_padding()
        self._between, self._text = max((i, t.content) for i, t in self._own.get_added_tokens_decoder().items() if t.special)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        #: Whether the ids are those of the text in lower case, and each word's last token is one of those that end words.
        self.words = bool(suffix) and (spec["normalizer"], spec["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        if self.words:
            self._ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self._ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._own.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, texts: list[str]) -> list[list[int]] | None:
        """The ids of each text of letters, or None if they are not as many as the ends of words."""
        (whole,) = self._ids([" ".join(texts)])
        ends = (np.flatnonzero(self._ends[whole]) + 1).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(texts) else None

    def _marked(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, by special tokens between them."""
        (whole,) = self._ids([self._text.join(texts)])
        out, at = [], 0
        for _ in texts[1:]:
            end = whole.index(self._between, at)
            out.append(whole[at:end])
            at = end + 1
        return [*out, whole[at:]]

    def __call__(self, units: list[bytes]) -> list[list[int]]:
        texts = [u.decode() for u in units]
        out: list[list[int]] = [[] for _ in units]
        letters = [i for i, u in enumerate(units) if _LETTERS(u)] if self.words else []
        of_letters = set(letters)
        plain = [i for i, t in enumerate(texts) if i not in of_letters and "<|" not in t]
        for kind in (letters, plain):
            for lo in range(0, len(kind), 512):
                some = kind[lo : lo + 512]
                own = [texts[i] for i in some]
                for i, x in zip(some, (kind is letters and self._spaced(own)) or self._marked(own), strict=True):
                    out[i] = x
        alone = [i for i, t in enumerate(texts) if "<|" in t]
        for i, x in zip(alone, self._ids([texts[i] for i in alone]), strict=True):
            out[i] = x
        return out


def folded(texts: Texts) -> Texts:
    """With A-Z in lower case, except before what a letter could be composed with in one case only."""
    d = texts.data
    upper = (d >= 65) & (d <= 90)
    upper[:-1] &= d[1:] < 0xCC  # combining characters begin at U+0300, which is CC 80
    return Texts(d + (upper.view(np.uint8) << 5), texts.offsets)


def whole_ids(memory: Memory, texts: Texts, cut: Callable) -> tuple[np.ndarray, np.ndarray]:
    blob = texts.data.tobytes()
    return memory.ids(texts, blob, *cut(texts, blob))


def library_ids(texts: Texts, name: str, drops_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and their offsets, by the tokenizers library and the file of that name."""
    memory = held(("library", name), lambda: Library(public_tokenizers.path(name)))
    if memory.encode.words and _SPECIAL not in texts.data.tobytes():
        texts = folded(texts)
    return whole_ids(memory, texts, bare_units if drops_space else spaced_units)
