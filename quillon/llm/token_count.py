"""Token counts by byte-pair merging with a heap over a linked list.

The adjacent pair of the lowest rank is merged again and again, the leftmost first among equals. Every merge takes one symbol away, so
the count is the number of initial symbols less the number of merges; no identifier is ever emitted. The work is n log n for a word of
n bytes, so a word without end is no trouble.

A batch of texts is cut at its spaces, and a piece is split and counted when it is new to the worker; pieces that it has met are kept in a
table of a fixed size.

Defined results: null text counts as empty and has no tokens and no bytes; an empty table gives none. Rows are independent: repeated
rows, null or repeated doc_ids and extra columns change nothing. A special string inside a text counts as one token, as in the library.
A text is counted whole, however long; a worker then holds some twenty times its bytes for a moment.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .wordcache import BYTE_CHARS, SHORT, WORDS, BoundedCache, PieceTable, bytes_of, held, load, pieces, slices

#: Fixed value: the pattern by which this kind of tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: White space other than 0x20.
OTHER_SPACE = [*"\t\n\v\f\r", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]


_FAR = regex.compile("[^\x00-\u024f]")
#: Two spaces, or a space beside other white space: there a space may belong to what stands before it.
_ODD = re.compile(" [ {0}]|[{0}] ".format("".join(OTHER_SPACE)))
_LEAD = np.zeros(256, bool)
_LEAD[[9, 10, 11, 12, 13, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # bytes with which white space begins


class Counter:
    """Counts for one vocabulary file of the tokenizers library with byte-level splitting."""

    def __init__(self, path: str):
        library = load(path)
        spec = json.loads(library.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("this counter takes byte-level vocabularies without normalization")
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.char_ids = {c: model["vocab"][c] for c in BYTE_CHARS.values()}
        self.pattern = regex.compile(PATTERN)
        vocab = model["vocab"]
        self.byte_ids = [vocab[BYTE_CHARS[b]] for b in range(256)]
        self.merges = {}  # (left << 32 | right): rank << 32 | whole
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        self.words = BoundedCache(self.count_word, WORDS)
        self.short = PieceTable(lambda raw: [self._chunk(raw.decode())], np.dtype(np.int32))
        self.long = BoundedCache(lambda raw: self._chunk(raw.decode()), WORDS)

    def count_word(self, word: str) -> int:
        """Tokens of one word: initial symbols less merges."""
        ids = self.byte_ids
        return self._merged([ids[b] for b in word.encode()])

    def _merged(self, symbols: list[int]) -> int:
        n = len(symbols)
        merges = self.merges
        get = merges.get
        heap = []
        for i in range(n - 1):
            m = get(symbols[i] << 32 | symbols[i + 1])
            if m is not None:
                heap.append((m >> 32 << 32) | i)
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        ahead = list(range(-1, n - 1))
        done = 0
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFF
            a = symbols[i]
            j = after[i]
            if a < 0 or j >= n:
                continue
            m = get(a << 32 | symbols[j])
            if m is None or m >> 32 != x >> 32:
                continue  # one of the two has been merged since
            done += 1
            a = symbols[i] = m & 0xFFFFFFFF
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                m = get(a << 32 | symbols[k])
                if m is not None:
                    heappush(heap, (m >> 32 << 32) | i)
            h = ahead[i]
            if h >= 0:
                m = get(symbols[h] << 32 | a)
                if m is not None:
                    heappush(heap, (m >> 32 << 32) | h)
        return n - done

    def _chunk(self, chunk: str) -> int:
        if _FAR.search(chunk):  # the library's Unicode tables may be of another version
            return sum([self._merged([self.char_ids[c] for c in w]) for w, _ in self.split(chunk)])
        words = self.pattern.findall(chunk)
        return self.count_word(words[0]) if len(words) == 1 else sum([self.words[w] for w in words])

    def __call__(self, text: str) -> int:
        """A single text, cut at special strings only."""
        total, parts = 0, [text]
        for s in self.specials:
            if s in text:
                split = [p.split(s) for p in parts]
                total += sum(len(p) - 1 for p in split)
                parts = [x for p in split for x in p]
        return total + sum([self._chunk(p) for p in parts if p])

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Counts of texts without nulls. A space between two other characters always begins a word, so texts are cut there; texts with
        special strings, or with a space beside other white space, are not."""
        whole = np.zeros(len(texts), bool)
        for s in self.specials:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        data, ends = bytes_of(texts)
        beside = np.flatnonzero((data == 32)[:-1] & _LEAD[data[1:]] | _LEAD[data[:-1]] & (data == 32)[1:])
        last = np.flatnonzero((data[:-1] >= 0x80) & (data[:-1] < 0xC0) & (data[1:] == 32))
        last = last[(data[last - 1] == 0xC2) | (data[last - 2] >= 0xE1) & (data[last - 2] <= 0xE3)]
        beside = np.concatenate((beside, last))
        for i in np.unique(np.searchsorted(ends, beside, "right")).tolist():
            whole[i] = whole[i] or _ODD.search(texts[i].as_py()) is not None
        p = pieces(texts, None, True, self.specials, digits_apart=False)
        n = np.empty(len(p.starts), np.int64)
        short, long = np.flatnonzero(p.sizes <= SHORT), np.flatnonzero(p.sizes > SHORT)
        slot = self.short.find(p, short)
        n[short] = self.short.values[self.short.start[slot]]
        n[long] = [self.long[raw] for raw in p.at(long)] if len(long) else []
        counts = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], p.ends))])
        for i in np.flatnonzero(whole).tolist():
            counts[i] = self(texts[i].as_py())
        return counts


def counter(path: str) -> Counter:
    return held(("token_count", path), lambda: Counter(path))


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they exceed `limit`, for every whole text; no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            for part in slices(b, 2):
                n = count.count_all(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(n > limit)], schema=COUNTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
