"""Batches of texts cut into pieces, ids of whole texts from the ids of their pieces, and what workers keep of pieces that they have met.

A batch's bytes are cut at white space, and where runs of letters and others meet, in one pass. A piece of at most SHORT bytes is its own
key, two 64-bit numbers, and is looked up in a hash table by array operations; so Python code sees a piece only when it is new to the
worker, and the texts are put together again by array operations too.

Where a tokenizer drops white space and never joins across it, a text's ids are the ids of its pieces, one after another. A piece of
characters whose normalization is not known to be context-free goes to the tokenizers library whole.

Memory: a worker holds the tables of one operator at a time (`held`), each of a fixed size. A batch takes about twenty times the bytes
of a slice of it, and a slice is SLICE bytes, or one text if that is longer.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: How byte-level vocabularies write the 256 bytes (the printable ones as themselves, the rest from 256 on).
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}

_LOCAL_LIMIT = 0x250
#: Bytes of text that are cut at once.
SLICE = 4 << 20
#: Bytes of a piece that is its own key, at most; slots of a worker's table of pieces, as a power of 2, of which half are taken at most.
SHORT, SLOTS = 15, 20
#: Bytes that a worker's table of longer pieces, and of words inside pieces, holds, about.
WORDS = 16 << 20

#: Every byte as itself, but 0x09-0x0D as a space; the same with A-Z in lower case.
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[9:14] = 32
LOWER_BLANKS = BLANKS.copy()
LOWER_BLANKS[65:91] += 32

#: Classes of ASCII characters: letters, digits, others. Class 0 is white space, control characters, the apostrophe (which may begin a
#: contraction) and whatever is not ASCII: what stands beside it is left to patterns.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[39] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1


class Pieces(NamedTuple):
    """Where the pieces of some texts begin in their bytes, and how long they are; for each text, how many pieces there are up to its end."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A piece's first 8 bytes, and its next 7 with its size; of use for pieces of SHORT bytes at most."""
        padded = np.concatenate((self.data, np.zeros(16, np.uint8)))
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        low = words[self.starts] & _KEEP[np.minimum(self.sizes, 8)]
        high = words[self.starts + 8] & _KEEP[np.clip(self.sizes - 8, 0, 7)]
        return low, high | self.sizes.astype(np.uint64) << np.uint64(56)

    def at(self, places: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a : a + n] for a, n in zip(self.starts[places].tolist(), self.sizes[places].tolist(), strict=True)]


#: Masks that keep the first n bytes of a word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each one ends; the first begins at 0."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def class_borders(texts: pa.Array, data: np.ndarray, ends: np.ndarray, specials: Iterable[str], digits_apart: bool) -> np.ndarray:
    """Places where a byte-level pattern of runs of letters, digits and others ends one run and begins the next, as far as both neighbours
    are of a class. Texts with special strings, which patterns do not see, have none."""
    kind = _CLASS[data]
    border = kind[1:] != kind[:-1]
    if digits_apart:
        border |= kind[1:] == 2
    border &= (kind[1:] != 0) & (kind[:-1] != 0)
    for s in specials:
        for i in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist():
            border[max(0, (ends[i - 1] if i else 0) - 1) : ends[i]] = False
    return np.flatnonzero(border) + 1


def pieces(texts: pa.Array, table: np.ndarray | None = BLANKS, leading: bool = False, specials: Iterable[str] | None = None, digits_apart: bool = True) -> Pieces:
    """Texts without nulls, their bytes mapped by `table`, cut at spaces; where `specials` are given, at class borders too. The space that
    ends a piece is not part of it; with `leading`, the space that begins one is. Pieces may be empty."""
    touch()
    data, ends = bytes_of(texts)
    if table is not None:
        data = table[data]
    at = [np.flatnonzero(data == 32) + (not leading), ends]
    if specials is not None and len(data):
        at.append(class_borders(texts, data, ends, specials, digits_apart))
    cuts = np.concatenate(at)
    cuts.sort(kind="stable")
    cuts = cuts[np.concatenate((cuts[:1] > 0, cuts[1:] != cuts[:-1]))]
    starts = np.concatenate((np.zeros(min(1, len(cuts)), np.int64), cuts[:-1]))
    sizes = cuts - starts
    if not leading and len(cuts):
        sizes -= data[cuts - 1] == 32
    return Pieces(data, starts, sizes, np.searchsorted(cuts, ends, "right"))


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of text each; the texts hold no nulls."""
    _, ends = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        start = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_holding: dict[tuple, object] = {}
_used = {"at": 0.0, "watch": 0}
#: Seconds after which a worker that is not used gives its tables back.
IDLE = 5.0


def _give_back() -> None:
    """Drop all tables, and return what the process has freed to the system."""
    _holding.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _watch() -> None:
    while True:
        time.sleep(IDLE / 2)
        if _holding and time.monotonic() - _used["at"] > IDLE:
            _give_back()


def touch() -> None:
    """The tables are in use."""
    _used["at"] = time.monotonic()


def held(key: tuple, make: Callable[[], object]) -> object:
    """The tables of an operator in this worker. Those of any other operator, from an earlier task, are given back first, and all are once
    the worker has been idle for a while: Spark keeps idle workers beside the stages that need no Python."""
    touch()
    if _used["watch"] != os.getpid():  # a thread does not outlive a fork
        _used["watch"] = os.getpid()
        threading.Thread(target=_watch, daemon=True).start()
    if (found := _holding.get(key)) is None:
        _give_back()
        found = _holding[key] = make()
    return found


class WordSplitter:
    """Normalizes a piece and splits it into words, written in the byte alphabet; None where only the library can.

    The pattern is the tokenizer's own, read from its file. Characters below U+0250 are checked one by one when loading: those
    that the library's normalizer maps to what str.lower() gives, and that combine with nothing before them, are handled here."""

    def __init__(self, tokenizer: Tokenizer, pattern: str, specials: list[str]):
        norm = tokenizer.normalizer
        bad = [c for c in map(chr, range(_LOCAL_LIMIT)) if not c.isspace() and norm.normalize_str("a" + c) != "a" + c.lower()]
        bad += [c for c in map(chr, range(_LOCAL_LIMIT)) if c.isspace()]
        self.foreign = re.compile("[%s]|[^\\x00-\\u024f]%s" % ("".join(map(re.escape, bad)), "".join("|" + re.escape(s) for s in specials)))
        self.words = regex.compile(pattern)
        self.table = str.maketrans({chr(b): c for b, c in BYTE_CHARS.items()})

    def __call__(self, piece: str) -> list[str] | None:
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            if piece[:-1].isalpha() and piece[-1] in ",.":
                return [piece[:-1].lower(), piece[-1]]
        if self.foreign.search(piece):
            return None
        low = piece.lower()
        if low.isalpha() and not piece.isascii():
            found = [low]
        elif low[:-1].isalpha() and low[-1] in ",." and not piece.isascii():
            found = [low[:-1], low[-1]]
        else:
            found = self.words.findall(low)
        return found if piece.isascii() and piece.isprintable() else [w.encode().decode("latin-1").translate(self.table) for w in found]


class BoundedCache(dict):
    """key -> what `make` gives for it, in about `limit` bytes. Once half of them are taken, what is held is set aside; entries that are met
    again come back, the rest go at the next time: what is frequent stays. Keys of more than LONG bytes or characters are not kept."""

    LONG = 256

    def __init__(self, make: Callable[[object], object], limit: int):
        super().__init__()
        self.make, self.limit, self.taken, self.aside = make, limit // 2, 0, {}

    def __missing__(self, key):
        value = self.aside[key] if key in self.aside else self.make(key)
        size = len(key) if isinstance(key, str | bytes) else 0
        if size <= self.LONG:
            # a dictionary's slot, two headers, and what is in them
            self.taken += 200 + size + (len(value) * 8 if isinstance(value, list) else 0)
            if self.taken > self.limit:
                self.aside, self.taken = dict(self), 0
                self.clear()
            self[key] = value
        return value


class PieceTable:
    """Short pieces -> lists of whole numbers, by open addressing in arrays. `make` gives the list of a new piece. When half of the slots
    are taken, entries that were met again since the last time stay, the others go."""

    EMPTY = np.uint64(0xFF << 56)  # no size

    def __init__(self, make: Callable[[bytes], list[int]], kind: np.dtype, slots: int = SLOTS):
        self.make, self.kind, self.bits = make, kind, slots
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high = np.zeros(n, np.uint64), np.full(n, self.EMPTY)
        self.start, self.count, self.again = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
        self.taken, self.used = 0, 0
        self.values = np.zeros(1 << 16, self.kind)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self._slot(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, slot, -1)
        todo = np.flatnonzero(~hit & (there != self.EMPTY))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            there = self.high[slot[todo]]
            hit = (there == high[todo]) & (self.low[slot[todo]] == low[todo])
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (there != self.EMPTY)]
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, lists: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys that are not there, and their lists one after another."""
        need = self.used + len(lists)
        if need > len(self.values):
            self.values = np.concatenate((self.values[: self.used], np.zeros(max(need, 2 * len(self.values)) - self.used, self.kind)))
        self.values[self.used : need] = lists
        starts = self.used + np.cumsum(counts) - counts
        self.used, self.taken = need, self.taken + len(low)
        slot, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            free = todo[self.high[slot[todo]] == self.EMPTY]
            at, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.low[at], self.high[at], self.start[at], self.count[at], self.again[at] = low[mine], high[mine], starts[mine], counts[mine], False
            todo = np.setdiff1d(todo, mine, assume_unique=True)
            slot[todo] = (slot[todo] + (self.high[slot[todo]] != self.EMPTY)) & ((1 << self.bits) - 1)

    def _shrink(self) -> None:
        stay = np.flatnonzero(self.again)[: 1 << (self.bits - 2)]
        low, high, start, count, values = self.low[stay], self.high[stay], self.start[stay], self.count[stay].astype(np.int64), self.values
        self._clear()
        total = np.cumsum(count)
        self._add(low, high, values[np.repeat(start - (total - count), count) + np.arange(count.sum())], count)

    def find(self, p: Pieces, short: np.ndarray) -> np.ndarray:
        """Slots of the pieces at these places, which are of SHORT bytes at most. They hold until the next call."""
        low, high = (k[short] for k in p.keys()) if len(short) < len(p.starts) else p.keys()
        slot = self._find(low, high)
        self.again[slot[slot >= 0]] = True
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            order = np.lexsort((low[missing], high[missing]))
            l, h = low[missing][order], high[missing][order]
            new = np.concatenate(([True], (l[1:] != l[:-1]) | (h[1:] != h[:-1])))
            lists, counts = [], []
            for raw in p.at(short[missing[order[new]]]):
                found = self.make(raw)
                lists += found
                counts.append(len(found))
            if self.taken + len(counts) > 1 << (self.bits - 1):
                self._shrink()
                while self.taken + len(counts) > 1 << (self.bits - 1):  # more new pieces than the table takes: a text beyond measure
                    self.bits += 1
                    self._shrink()
            self._add(l[new], h[new], np.array(lists, self.kind), np.array(counts, np.int64))
            slot = self._find(low, high)
            again = np.flatnonzero(slot < 0)
            if len(again):  # dropped when the table shrank
                return self.find(p, short)
        return slot


class TextEncoder:
    """ids of whole texts, as the tokenizers library gives them without special tokens, for a vocabulary that drops white space between
    words. What ids a word has is left to a subclass, and so is a piece that the splitter cannot take."""

    def __init__(self, path: str):
        self.library = load(path)
        spec = json.loads(self.library.to_str())
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.splitter = WordSplitter(self.library, split["pattern"]["Regex"], list(self.specials))
        self.wide = self.library.get_vocab_size(True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.words = BoundedCache(self.ids_of_word, WORDS)
        self.short = PieceTable(self._piece, self.kind)
        self.long = BoundedCache(self._piece, WORDS)
        self.prepare(spec)

    def prepare(self, spec: dict) -> None:
        """What a subclass takes from the vocabulary's file."""

    def ids_of_word(self, word: str) -> list[int]:
        raise NotImplementedError

    def foreign_piece(self, piece: str) -> list[int]:
        raise NotImplementedError

    def _piece(self, raw: bytes) -> list[int]:
        piece = raw.decode()
        if piece.isascii() and piece.isalpha():
            return self.ids_of_word(piece.lower())
        words = self.splitter(piece)
        if words is None:
            return self.foreign_piece(piece)
        return self.ids_of_word(words[0]) if len(words) == 1 else [i for w in words for i in self.words[w]]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids end."""
        p = pieces(texts, specials=self.specials)
        short = np.flatnonzero(p.sizes <= SHORT)
        slot = self.short.find(p, short)
        start, n = np.empty(len(p.starts), np.int64), np.empty(len(p.starts), np.int64)
        start[short], n[short] = self.short.start[slot], self.short.count[slot]
        long = np.flatnonzero(p.sizes > SHORT)
        found = [self.long[raw] for raw in p.at(long)] if len(long) else []
        n[long] = [len(x) for x in found]
        values = np.concatenate((self.short.values[: self.short.used], np.array([i for x in found for i in x], self.kind)))
        start[long] = self.short.used + np.cumsum(n[long]) - n[long]
        total = np.concatenate(([0], np.cumsum(n)))
        return values[np.repeat(start - total[:-1], n) + np.arange(total[-1])], total[p.ends]
