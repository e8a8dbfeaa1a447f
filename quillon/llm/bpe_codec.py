"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

A merge list fixes one encoding for every string, and every prefix of an encoding is the encoding of that prefix. So each prefix of a
word has one last token: the one that some suffix match of the vocabulary offers and that is compatible with the last token of what
stands before it. An Aho-Corasick automaton lists the suffix matches; two tokens are compatible if no merge would ever have crossed
the border between them. The last tokens form back-pointers, and following them from the whole word emits the ids. Nothing is merged.

Pieces that a worker has met are kept in a table of a fixed size; a text's ids are those of its pieces. Decoding takes ids alone.

Defined results: null text counts as empty and gives no ids; decoding no ids gives an empty string; an empty table gives none. Rows are
independent: repeated rows, null or repeated doc_ids and extra columns change nothing. Special strings inside a text become their ids, as
in the library. A text is encoded whole, however long: a worker then holds some twenty times its bytes for a moment, and a word without
end takes time and memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .wordcache import BoundedCache, TextEncoder, held, slices

#: Bytes that a worker's table of compatibility tests takes, about.
PAIRS = 16 << 20
_END = "\x00"


class Vocabulary:
    """Tokens, merges and compatibility of one byte-pair vocabulary. Words are given in the byte alphabet of its file."""

    def __init__(self, model: dict):
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for r, (a, b) in enumerate(merges):
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            if whole in self.made or any(self.made.get(x, (-1,))[0] >= r for x in (left, right)):
                raise ValueError("each merge must make a new token from tokens that earlier merges made")
            self.rank[left, right] = r
            self.made[whole] = (r, left, right)
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.compatible = BoundedCache(self._compatible, PAIRS)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self._stands(i):
                text = token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) else token
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.spines.clear()  # of most tokens they are not needed again

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token while it is built, and the rank of the merge that ends each one's time there."""
        if (token, side) not in self.spines:
            out, until, x = [], float("inf"), token
            while True:
                out.append((x, until))
                if x not in self.made:
                    break
                until, x = self.made[x][0], self.made[x][side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def _crossed(self, a: int, b: int, before: float) -> bool:
        """Whether a merge of a rank below `before` joins the right edge of a with the left edge of b. At equal ranks the merge that
        stands further left comes first."""
        rank = self.rank
        right_edge = self._spine(b, 1)
        for x, x_until in self._spine(a, 2):
            for y, y_until in right_edge:
                r = rank.get((x, y))
                if r is not None and r < before and r < x_until and r <= y_until:
                    return True
        return False

    def _compatible(self, pair: tuple[int, int]) -> bool:
        return not self._crossed(*pair, float("inf"))

    def _stands(self, token: int) -> bool:
        """Whether a token is the encoding of its own string."""
        todo = [token]
        while todo:
            x = todo.pop()
            if x in self.made:
                r, a, b = self.made[x]
                if self._crossed(a, b, r):
                    return False
                todo += (a, b)
        return True

    def encode(self, word: str) -> list[int]:
        n = len(word)
        if not n:
            return []
        if self.suffix:
            word += _END
        last: list[tuple[int, int] | None] = [None] * (len(word) + 1)  # for each prefix: last token, and where it begins
        compatible = self.compatible
        barred = n if self.suffix else -1  # the last character and the word's end are one symbol
        for at, (length, token) in self.automaton.iter(word):
            end = at + 1
            if last[end] is not None or end == barred:
                continue
            start = end - length
            if start == 0:
                last[end] = (token, 0)
            elif (before := last[start]) is not None and compatible[before[0], token]:
                last[end] = (token, start)
        out, at = [], len(word)
        while at:
            if last[at] is None:
                raise ValueError("the vocabulary lacks a symbol of this word")
            token, at = last[at]
            out.append(token)
        return out[::-1]


class Codec(TextEncoder):
    """encode and decode of whole texts for a vocabulary file of the tokenizers library that drops white space between words.

    The library is used for normalizing and splitting pieces with characters beyond the checked range, never for encoding."""

    def prepare(self, spec: dict) -> None:
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("this codec decodes by joining tokens with a space, and adds none")
        self.vocabulary = Vocabulary(spec["model"])
        tokens = {i: t for t, i in {**self.vocabulary.ids, **self.specials}.items()}
        every = range(max(tokens) + 1)
        self.known = np.array([i in tokens for i in every])
        self.tokens = pa.array([tokens.get(i, "") for i in every], pa.string())
        self.decimals = pa.array(map(str, every), pa.string())

    def ids_of_word(self, word: str) -> list[int]:
        return self.vocabulary.encode(word)

    def _parts(self, piece: str) -> list[str]:
        """A piece split at special strings, the leftmost first, the longest of those at one place."""
        for s in sorted(self.specials, key=len, reverse=True):
            if s in piece:
                a, _, b = piece.partition(s)
                return [*self._parts(a), s, *self._parts(b)]
        return [piece] if piece else []

    def foreign_piece(self, piece: str) -> list[int]:
        out: list[int] = []
        for part in self._parts(piece):
            if part in self.specials:
                out.append(self.specials[part])
            else:
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out += self.words[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The tokens of each row's ids, joined by a space; ids outside the vocabulary are passed over, as the library does."""
        known = (ids >= 0) & (ids < len(self.known))
        known[known] = self.known[ids[known]]
        if not known.all():
            ends, ids = np.concatenate(([0], np.cumsum(known)))[ends], ids[known]
        return _joined(self.tokens, ids, ends)

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of each row's decimal ids, and of the text decoded from them."""

        def sha(texts: pa.Array) -> list[str]:
            return [hashlib.sha256(x.as_buffer()).hexdigest() for x in texts]

        return sha(_joined(self.decimals, ids, ends)), sha(self.decode_all(ids, ends))


def _joined(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each row's names, joined by a space."""
    found = names.take(pa.array(ids))
    if found.nbytes + len(found) < 1 << 31:
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), found)
        return pc.binary_join(lists, " ")
    # a single text of hundreds of megabytes: Arrow's plain strings end at two gigabytes
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return pa.array([" ".join(found.slice(a, b - a).to_pylist()) for a, b in zip(starts, ends.tolist(), strict=True)], pa.large_string())


def codec(path: str) -> Codec:
    return held(("bpe_codec", path), lambda: Codec(path))


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, tokenizer_path: str, text_column: str = "text", into: str = "ids") -> DataFrame:
    """All columns, and the ids of each text as array<int> in `into` (which replaces a column of that name); no shuffle."""
    ship(docs.sparkSession)
    keep = docs.drop(into)
    ddl = keep.withColumn(into, F.lit(None).cast("array<int>")).schema
    at = keep.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            texts = pc.fill_null(b.column(at), "")
            for part in slices(pa.RecordBatch.from_arrays([texts, pa.array(range(b.num_rows))], ["text", "row"]), 0):
                ids = id_lists(*c.encode_all(part.column(0)))
                rows = b.slice(part.column(1)[0].as_py(), part.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, ids], [*b.schema.names, into])

    return keep.mapInArrow(run, ddl)


def decode(rows: DataFrame, tokenizer_path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns, and the decoded text of each row's ids in `into`; null ids count as none."""
    ship(rows.sparkSession)
    keep = rows.drop(into)
    ddl = keep.withColumn(into, F.lit(None).cast("string")).schema
    at = keep.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(b.column(at).flatten(), -1).to_numpy(zero_copy_only=False)
            texts = c.decode_all(ids, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([*b.columns, texts.cast(pa.string())], [*b.schema.names, into])

    return keep.mapInArrow(run, ddl)


CODED = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def _coded(docs: DataFrame, tokenizer_path: str, with_ids: bool) -> DataFrame:
    ship(docs.sparkSession)
    names = CODED if with_ids else CODED[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in batches:
            for part in slices(b, 1):
                ids, ends = c.encode_all(part.column(1))
                coded, decoded = c.digests(ids, ends)
                columns = [part.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([id_lists(ids, ends)] if with_ids else [])], names)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, ddl)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encode, and decode from the ids, in one pass without a shuffle."""
    return _coded(docs, tokenizer_path, False)


def encoded_corpus(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """What `encode_digests` gives, and the ids themselves."""
    return _coded(docs, tokenizer_path, True)
