"""Removal of repeated byte strings by a sampled, distributed suffix sort.

Every byte that lies in a string of WINDOW bytes which also starts earlier is removed. Sorting the suffixes of all bytes would move a
hundred times the text, so only suffixes at *leading tokens* are sorted: in each window the token of TOKEN bytes with the smallest hash
leads, the leftmost among equals. Equal windows have equal leading tokens at equal places, so nothing is lost. Windows that follow one
another and have the same leader form a run; the bytes of a run's windows are its context.

1. Runs are dealt to buckets by the hash of their leading token, with splitters from a sample. A token so frequent that several splitters
   fall on it is split by the hash of the context, so that no bucket holds it alone. Before a task sends its runs, it drops those whose
   contexts have stood in it before, byte for byte; so a passage that many documents share is sent once for each task.
2. A bucket sorts its suffixes by multikey quicksort (token, place). Runs whose token is met again are *contested*, and so are
   those of tokens that reach across a border between buckets: they are compared with what lies beyond it.
3. The contexts of contested runs are fetched from the texts. Multikey quicksort over their bytes, 8 at a time, finds equal contexts, of
   which all but the earliest are removed, and then equal windows among those that are left. Hashes only choose what is compared: what is
   removed has been found equal byte for byte. Tokens with more than HOT contested runs, or split ones, are compared window by window in
   a sort of their own, dealt by content; a task streams through its share, and holds none of it.
4. What is to be removed goes to the texts, where it is merged and cut out.

Texts are moved twice, compressed: once to fetch contexts, once to cut. Buckets and parts grow in number with the bytes of the texts.

Defined results: null text counts as empty; an empty table gives none. Order is by doc_id, null last, then by a 128-bit hash of the text.
Rows with equal doc_id and equal hash of the text are one document and get equal results. Texts shorter than WINDOW keep all bytes; texts
of more than _SEGMENT bytes are taken in segments that overlap, so that no window is lost, and one text is held whole by a worker. Extra
columns are ignored by `removals` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, ship, stored, text_of
from .wordcache import held

WINDOW, TOKEN = 100, 32
PLACES = WINDOW - TOKEN + 1
#: Documents of the sample from which splitters come; buckets for each shuffle partition, and bytes of text for each bucket at most;
#: contested runs of one token that a task sorts in memory; contested runs that it sorts at once; tasks that share equal windows.
SAMPLE, BUCKETS, BUCKET_BYTES, HOT, BLOCK, SALTS = 2000, 4, 16 << 20, 100_000, 20_000, 16
#: Runs that a task looks for repeats in before it sends them.
FLUSH = 1_500_000
_NULL = np.iinfo(np.int64).max
_SEGMENT = 1 << 20
_SIGN = np.uint64(1 << 63)

RUN = np.dtype([("token", "<u8"), ("doc", "<i8"), ("tie", "<u8"), ("tie2", "<u8"), ("lo", "<u4"), ("off", "u1"), ("n", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<u8"), ("tie2", "<u8"), ("lo", "<u4"), ("n", "<u4")])
_PLACE = ("doc", "tie", "tie2", "lo")

_rng = np.random.default_rng(7)
_BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES2 = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xB5297A4D3F84D5B5


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash, and of its inverse; a segment's at most."""
    tables = held(("suffix_dedup",), dict)
    if len(tables.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(max(n, 1 << 14), base, np.uint64)
                steps[0] = 1
                tables[name] = np.cumprod(steps, dtype=np.uint64)
    return tables["up"][:n], tables["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs_of(data: bytes) -> tuple[np.ndarray, ...]:
    """token, context, lo, off, n of the runs of a text: hashes, first window's start, leader's place in it, number of windows."""
    if len(data) > _SEGMENT:
        parts = [(at, runs_of(data[at : at + _SEGMENT])) for at in range(0, len(data) - WINDOW + 1, _SEGMENT - WINDOW + 1)]
        return tuple(np.concatenate([p[i] + (at if i == 2 else 0) for at, p in parts]) for i in range(5))
    if len(data) < WINDOW:
        return tuple(np.empty(0, np.uint64) for _ in range(5))
    raw = np.frombuffer(data, np.uint8)
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[:-1], dtype=np.uint64)))
        token = _mixed((total[TOKEN:] - total[:-TOKEN]) * down[: len(raw) - TOKEN + 1])
        packed = (token & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(token), dtype=np.uint64)
        least, width = packed, 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < PLACES:
            least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
        leader = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(leader[1:] != leader[:-1]) + 1))
        n = np.diff(np.concatenate((lo, [len(leader)])))
        place = leader[lo]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES2[raw] * up[:-1], dtype=np.uint64)))
        context = (total[lo + n - 1 + WINDOW] - total[lo]) * down[lo]
        context = _mixed(context + (n * 256 + place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return token[place], context, lo, place - lo, n


def tie_of(data: bytes) -> tuple[int, int]:
    """Tells apart the texts of one doc_id, or of none."""
    h = xxhash.xxh3_128_intdigest(data)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def document_runs(doc: int | None, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a text, and the hashes of their contexts."""
    token, context, lo, off, n = runs_of(data)
    out = np.empty(len(lo), RUN)
    out["token"], out["lo"], out["off"], out["n"] = token, lo, off, n
    out["doc"], (out["tie"], out["tie2"]) = _NULL if doc is None else doc, tie_of(data)
    return out, context


def multikey_quicksort(words: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group and then by their words, and whether each ordered row differs from the one before it.

    Every segment of rows that are not yet told apart is split in three by one word of a row in its middle: less, equal, greater. The
    equal part goes on with the next word, the others with the same. All segments are split in one pass of array operations. Without groups,
    rows are first dealt to segments by the leading 16 bits of their first word."""
    n, width = words.shape
    group = (words[:, 0] >> np.uint64(48)).astype(np.uint16) if group is None else group
    order = np.argsort(group, kind="stable")
    new = np.ones(n, bool)
    new[1:] = group[order][1:] != group[order][:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate((start, [n])))
    depth = np.zeros(len(start), np.int64)
    while True:
        go = (size > 1) & (depth < width)
        start, size, depth = start[go], size[go], depth[go]
        if not len(start):
            return order, new
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(segment)) + (start - first)[segment]
        rows = order[at]
        key = words[rows, depth[segment]]
        pivot = key[first + size // 2][segment]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        # stable: each row's place among those of its segment and side
        parts = np.empty((3, len(size)), np.int64)
        rank = np.empty(len(at), np.int64)
        for k in range(3):
            mine = side == k
            before = np.cumsum(mine) - mine
            rank[mine] = before[mine] - before[first][segment[mine]]
            parts[k] = np.add.reduceat(mine, first)
        starts = np.stack((start, start + parts[0], start + parts[0] + parts[1]))
        order[starts[side, segment] + rank] = rows
        new[starts[parts > 0]] = True
        start, size, depth = starts.ravel(), parts.ravel(), np.concatenate((depth, depth + 1, depth))


def _key_words(a: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([a[n].astype(np.uint64) ^ _SIGN if a[n].dtype.kind == "i" else a[n].astype(np.uint64) for n in names]).reshape(len(a), len(names))


def _pack(a: np.ndarray) -> bytes:
    """Column by column, documents as differences: what repeats then compresses."""
    a = a[np.argsort(a["doc"], kind="stable")]
    parts = [len(a).to_bytes(8, "little")]
    for name in a.dtype.names:
        column = np.ascontiguousarray(a[name])
        if name == "doc":
            with np.errstate(over="ignore"):
                column = np.diff(column, prepend=np.int64(0))
        raw = column.view(np.uint8).reshape(len(a), -1)
        parts.append(np.ascontiguousarray(raw.T).tobytes())
    return b"".join(parts)


def _unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    out, at = np.empty(n, kind), 8
    for name in kind.names:
        size = kind[name].itemsize
        column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind[name]).reshape(n)
        with np.errstate(over="ignore"):
            out[name] = np.cumsum(column) if name == "doc" else column
        at += n * size
    return out


def _whole(runs: np.ndarray) -> np.ndarray:
    out = np.empty(len(runs), SPAN)
    for name in _PLACE:
        out[name] = runs[name]
    out["n"] = runs["n"].astype(np.uint32) + np.uint32(WINDOW - 1)
    return out


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """Spans by document (tie, doc) and place, merged where they overlap or touch."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["doc"], spans["tie2"], spans["tie"]))]
    new = np.ones(len(spans), bool)
    new[1:] = False
    for name in ("doc", "tie", "tie2"):
        new[1:] |= spans[name][1:] != spans[name][:-1]
    ends = spans["lo"].astype(np.int64) + spans["n"]
    # running maximum of the ends within each document: documents lie apart by more than any end
    shift = np.cumsum(new).astype(np.int64) << 33
    reach = np.maximum.accumulate(ends + shift) - shift
    new[1:] |= spans["lo"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(spans)])) - 1
    out = spans[first].copy()
    out["n"] = reach[last] - spans["lo"][first]
    return out


PARCELS = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
PARCELS_DDL = "to int, kind int, payload binary"
_RUNS, _SPANS, _HOT = 0, 1, 2


class Splitters:
    """Borders between buckets. A token on which several of them fall is split by context; any other is in one bucket."""

    def __init__(self, sample: np.ndarray, buckets: int):
        sample = sample[np.lexsort((sample["context"], sample["token"]))]
        found = sample[(np.arange(1, buckets) * len(sample)) // buckets] if len(sample) else sample
        token, times = np.unique(found["token"], return_counts=True)
        self.split = token[times > 1]
        found = found[np.isin(found["token"], self.split)]
        once = np.zeros(int((times == 1).sum()), found.dtype)
        once["token"] = token[times == 1]
        borders = np.unique(np.concatenate((found, once)))
        self.token, self.context = np.ascontiguousarray(borders["token"]), np.ascontiguousarray(borders["context"])

    def __len__(self) -> int:
        return len(self.token)

    def bucket(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        to = np.searchsorted(self.token, token, "right")
        for t in self.split[np.isin(self.split, token)].tolist():
            mine = token == np.uint64(t)
            a, b = np.searchsorted(self.token, np.uint64(t), "left"), np.searchsorted(self.token, np.uint64(t), "right")
            to[mine] = a + np.searchsorted(self.context[a:b], context[mine], "right")
        return to


def _target(items: np.ndarray, parts: int) -> np.ndarray:
    """Which part of the documents a document belongs to."""
    with np.errstate(over="ignore"):
        return ((items["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + items["tie"]) >> np.uint64(33)) % np.uint64(parts)


def _parcels(kind: int, items: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(to, kind="stable")
    items, to = items[order], to[order]
    edges = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])) if len(to) else []
    rows = [(int(to[a]), kind, _pack(items[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64], strict=True), PARCELS, strict=True)], schema=PARCELS)


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from places a on equal those from places b on."""
    out = np.ones(len(a), bool)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(np.cumsum(n[at : at + 100_000]), 1 << 22)) + at)
        k = n[at:to]
        first = np.cumsum(k) - k
        step = np.arange(k.sum()) - np.repeat(first, k)
        out[at:to] = np.logical_and.reduceat(raw[step + np.repeat(a[at:to], k)] == raw[step + np.repeat(b[at:to], k)], first)
        at = to
    return out


def _cut_runs(splitters: Splitters) -> Callable:
    """Texts -> parcels of runs by token and of spans that the task itself can tell."""

    def flush(texts: dict[tuple, bytes], runs: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
        keys = sorted(texts)  # documents in order, and their runs by place: ties between hashes are then in order already
        every, context = (np.concatenate([runs[k][i] for k in keys]) for i in (0, 1))
        at = np.cumsum([0, *(len(texts[k]) for k in keys)])
        place = np.repeat(at[:-1], [len(runs[k][0]) for k in keys]) + every["lo"]
        raw = np.frombuffer(b"".join(texts[k] for k in keys), np.uint8)
        order = np.lexsort((context, every["token"]))
        every, context, place = every[order], context[order], place[order]
        first = np.ones(len(every), bool)
        first[1:] = (every["token"][1:] != every["token"][:-1]) | (context[1:] != context[:-1])
        again = np.flatnonzero(~first)
        if len(again):
            source = np.flatnonzero(first)[np.cumsum(first)[again] - 1]
            first[again] = ~same_bytes(raw, place[again], place[source], every["n"][again].astype(np.int64) + WINDOW - 1)
        yield from _parcels(_RUNS, every[first], splitters.bucket(every["token"][first], context[first]))
        spans = joined_spans(_whole(every[~first]))
        if len(spans):
            yield from _parcels(_SPANS, spans, np.full(len(spans), int(spans["lo"][0]) % (len(splitters) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, runs, size = {}, {}, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                r, context = document_runs(doc, data)
                if not len(r) or (key := (_NULL if doc is None else doc, int(r["tie"][0]), int(r["tie2"][0]))) in texts:
                    continue
                texts[key], runs[key] = data, (r, context)
                size += len(r)
                if size > FLUSH:
                    yield from flush(texts, runs)
                    texts, runs, size = {}, {}, 0
        if texts:
            yield from flush(texts, runs)

    return run


REQUESTS = pa.schema([("what", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
ANSWER_DDL = "what int, part int, payload binary"


def _answer(what: int, items: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed by the part of their documents."""
    for b in _parcels(what, items, _target(items, parts)):
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2)], schema=REQUESTS)


def _sort_buckets(splitters: Splitters, parts: int) -> Callable:
    """Parcels of one bucket after another -> contested runs, and the spans that tasks could tell."""

    def close(runs: list[np.ndarray], spans: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if runs:
            every = np.concatenate(runs)
            order, new = multikey_quicksort(_key_words(every, ("token", *_PLACE)))
            every = every[order[new]]  # repeated rows have sent their runs again
            token, at, times = np.unique(every["token"], return_inverse=True, return_counts=True)
            hot = (times > HOT) | np.isin(token, splitters.split)
            yield from _answer(_HOT, every[hot[at]], parts)
            yield from _answer(_RUNS, every[((times > 1) & ~hot)[at]], parts)
        if spans:
            yield from _answer(_SPANS, joined_spans(np.concatenate(spans)), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("suffix_dedup",), dict)
        at, runs, spans = None, [], []
        for b in batches:
            for to, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if to != at:
                    yield from close(runs, spans)
                    at, runs, spans = to, [], []
                if kind == _RUNS:
                    runs.append(_unpack(payload, RUN))
                else:
                    spans.append(_unpack(payload, SPAN))
        yield from close(runs, spans)

    return run


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    """part, order 1, doc and the compressed text, and the column `rest`, if there is one."""
    names = ["part", "order", "doc", "payload", *docs.columns[2:]]
    kinds = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("order", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("payload", T.BinaryType()), *docs.schema.fields[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                keys, texts = s.column(0).to_pylist(), [t.encode() for t in s.column(1).to_pylist()]
                probe = np.zeros(len(keys), SPAN)
                probe["doc"] = [_NULL if k is None else k for k in keys]
                probe["tie"] = [tie_of(t)[0] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(_target(probe, parts).astype(np.int32)), pa.array(np.ones(len(keys), np.int32)), s.column(0), pa.array(map(z.compress, texts), pa.binary()), *s.columns[2:]], names)

    return docs.mapInArrow(run, kinds)


def _beside(docs: DataFrame, answers: DataFrame, parts: int, shuffle: int, work: Callable, kinds: T.StructType) -> DataFrame:
    """work(items of a part, doc, text) for every text, with what was packed for its part. A part's parcels come before its texts.
    Where docs have a column `rest`, work gives one row for each text, and `rest` follows in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("suffix_dedup",), dict)
        z = zstandard.ZstdDecompressor()
        at, parcels, items = None, [], None
        for b in batches:
            rows, at_text = [], []
            for i, (part, order, doc, payload) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)):
                if part != at:
                    at, parcels, items = part, [], None
                if order == 0:
                    parcels.append(payload)
                    continue
                if items is None:
                    items, parcels = work.prepare(parcels), []
                rows += work(items, doc, z.decompress(payload))
                at_text.append(i)
            rows += work.end(rows)
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), work.schema, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(c.take(pa.array(at_text)) for c in b.columns[4:])], [*work.schema.names, *b.schema.names[4:]])

    parcels = answers.select("part", F.lit(0).alias("order"), F.lit(None).cast("long").alias("doc"), "payload")
    both = parcels.unionByName(_texts(docs, parts), allowMissingColumns=True)
    return both.repartition(shuffle, "part").sortWithinPartitions("part", "order").mapInArrow(run, T.StructType(kinds.fields + docs.schema.fields[2:]))


class Items:
    """What was packed for a part, by document. Copies of one text have equal ties, so both keys are searched."""

    def __init__(self, items: np.ndarray):
        self.items = items[np.lexsort((items["lo"], items["tie2"], items["doc"], items["tie"]))]
        self.tie, self.doc = np.ascontiguousarray(self.items["tie"]), np.ascontiguousarray(self.items["doc"])

    def of(self, doc: int | None, data: bytes) -> np.ndarray:
        if not len(self.items):
            return self.items
        tie, tie2 = tie_of(data)
        a, b = np.searchsorted(self.tie, np.uint64(tie), "left"), np.searchsorted(self.tie, np.uint64(tie), "right")
        key = _NULL if doc is None else doc
        a, b = a + np.searchsorted(self.doc[a:b], key, "left"), a + np.searchsorted(self.doc[a:b], key, "right")
        found = self.items[a:b]
        return found[found["tie2"] == np.uint64(tie2)]


class Fetch:
    """Contexts of contested runs, packed by bucket: the runs, then their contexts one after another, compressed."""

    schema = pa.schema([("to", pa.int32()), ("runs", pa.binary()), ("contexts", pa.binary())])
    kinds = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("runs", T.BinaryType()), T.StructField("contexts", T.BinaryType())])

    def __init__(self, splitters: Splitters):
        self.splitters = splitters
        self.found: list[tuple[np.ndarray, bytes]] = []
        self.size = 0

    def prepare(self, parcels: list[bytes]) -> Items:
        return Items(np.concatenate([np.empty(0, RUN), *(_unpack(p, RUN) for p in parcels)]))

    def __call__(self, items: Items, doc: int | None, data: bytes) -> list[tuple]:
        if len(mine := items.of(doc, data)):
            self.found.append((mine, data))
            self.size += len(mine)
        return self.end([]) if self.size > BLOCK else []

    def end(self, rows: list[tuple]) -> list[tuple]:
        found, self.found, self.size = self.found, [], 0
        if not found:
            return []
        z = zstandard.ZstdCompressor(level=1)
        runs = np.concatenate([r for r, _ in found])
        raw = np.frombuffer(b"".join(d for _, d in found), np.uint8)
        start = np.repeat(np.cumsum([0, *(len(d) for _, d in found)])[:-1], [len(r) for r, _ in found]) + runs["lo"]
        # runs of split tokens go on by their windows, so no context is needed here
        to = self.splitters.bucket(runs["token"], np.zeros(len(runs), np.uint64))
        order = np.argsort(to, kind="stable")
        runs, start, to = runs[order], start[order], to[order]
        edges = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])).tolist()
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = runs["n"][a:b].astype(np.int64) + WINDOW - 1
            at = np.repeat(start[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((int(to[a]), runs[a:b].tobytes(), z.compress(raw[at].tobytes())))
        return out


def _table(runs: np.ndarray, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Contexts, which begin at `start` in raw, as rows of bytes, the leader at column PLACES - 1 of each."""
    table = np.zeros((len(runs), PLACES - 1 + WINDOW + 1), np.uint8)
    for at in range(0, len(runs), 8192):
        part = runs[at : at + 8192]
        n = part["n"].astype(np.int64) + WINDOW - 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(at, at + len(part)), n)
        table[row, step + np.repeat(PLACES - 1 - part["off"].astype(np.int64), n)] = raw[step + np.repeat(start[at : at + 8192], n)]
    return table


def _words(table: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words of 8."""
    width = -(-table.shape[1] // 8) * 8
    padded = np.zeros((len(table), width), np.uint8)
    padded[:, : table.shape[1]] = table
    return padded.view(">u8").astype(np.uint64)


def _earliest(runs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each run is the earliest of its token with this context. runs come ordered by place."""
    shape = runs["off"].astype(np.uint64) << np.uint64(8) | runs["n"].astype(np.uint64)
    order, new = multikey_quicksort(np.column_stack((runs["token"], shape, _words(table))))
    out = np.zeros(len(runs), bool)
    out[order[new]] = True  # rows that are equal keep their order
    return out


def contested_spans(runs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Spans of all windows but the earliest of equal ones, among runs with equal tokens. runs come ordered by place."""
    _, group, times = np.unique(runs["token"], return_inverse=True, return_counts=True)
    several = times[group] > 1
    runs, table, group = runs[several], table[several], group[several].astype(np.uint64)
    off, last = runs["off"].astype(np.int64), runs["off"].astype(np.int64) - runs["n"].astype(np.int64) + 1
    gone = np.zeros((len(runs), PLACES + 1), bool)
    with np.errstate(over="ignore"):
        up, down = _powers(WINDOW + 1)
        rolling = np.zeros(len(runs), np.uint64)
        for k in range(WINDOW):
            rolling += _BYTES[table[:, k]] * up[k]
        for at in range(PLACES):
            d = PLACES - 1 - at
            have = np.flatnonzero((d <= off) & (d >= last))
            # windows that are equal have equal hashes: those of hashes that occur once need no look
            _, which, times = np.unique(_mixed(rolling[have] + group[have] * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            have = have[times[which] > 1]
            if len(have):
                order, new = multikey_quicksort(_words(table[have, at : at + WINDOW]), group[have])
                again = have[order[~new]]
                gone[again, off[again] - d] = True
            rolling = (rolling - _BYTES[table[:, at]]) * down[1] + _BYTES[table[:, at + WINDOW]] * up[WINDOW - 1]
    # runs of removed windows become spans
    edge = np.diff(np.concatenate((np.zeros((len(runs), 1), np.int8), gone.astype(np.int8)), axis=1), axis=1)
    r, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    out = np.empty(len(r), SPAN)
    for name in ("doc", "tie", "tie2"):
        out[name] = runs[name][r]
    out["lo"] = runs["lo"][r] + start.astype(np.uint32)
    out["n"] = (end - start + WINDOW - 1).astype(np.uint32)
    return out


def _sort_contested(parts: int) -> Callable:
    def close(found: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        runs = np.frombuffer(b"".join(r for r, _ in found), RUN)
        z = zstandard.ZstdDecompressor()
        raw = np.frombuffer(b"".join(z.decompress(c) for _, c in found), np.uint8)
        n = runs["n"].astype(np.int64) + WINDOW - 1
        start = np.cumsum(n) - n
        order = np.lexsort((*(runs[name] for name in reversed(_PLACE)), runs["token"]))
        runs, start = runs[order], start[order]
        once = np.ones(len(runs), bool)  # a repeated row has sent its runs again
        once[1:] = np.logical_or.reduce([runs[name][1:] != runs[name][:-1] for name in ("token", *_PLACE)])
        runs, start = runs[once], start[once]
        border = np.flatnonzero(np.concatenate((runs["token"][1:] != runs["token"][:-1], [True]))) + 1
        spans, at = [np.empty(0, SPAN)], 0
        while at < len(runs):  # whole tokens, about BLOCK runs at once
            to = int(border[min(np.searchsorted(border, at + BLOCK), len(border) - 1)])
            table = _table(runs[at:to], raw, start[at:to])
            first = _earliest(runs[at:to], table)
            spans += [_whole(runs[at:to][~first]), contested_spans(runs[at:to][first], table[first])]
            at = to
        yield from _answer(_SPANS, joined_spans(np.concatenate(spans)), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("suffix_dedup",), dict)
        at, found = None, []
        for b in batches:
            for to, runs, contexts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if to != at:
                    yield from close(found)
                    at, found = to, []
                found.append((runs, contexts))
        yield from close(found)

    return run


HOT_DDL = "key long, salt int, doc long, tie long, tie2 long, lo long, window binary, what int, part int, payload binary"
_HOT_NAMES = ["key", "salt", "doc", "tie", "tie2", "lo", "window", "what", "part", "payload"]


def _hot_rows(spans: np.ndarray, windows: list[bytes], keys: list[int] | None = None) -> pa.RecordBatch:
    """Windows as rows; ties as signed numbers of the same order."""
    signed = [pa.array((spans[n] ^ _SIGN).view(np.int64)) for n in ("tie", "tie2")]
    keys = [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in windows] if keys is None else keys
    salt = (spans["tie"] + spans["lo"]) % np.uint64(SALTS)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(salt.astype(np.int32)), pa.array(spans["doc"]), *signed, pa.array(spans["lo"].astype(np.int64)), pa.array(windows, pa.binary()), *(pa.nulls(len(spans), t) for t in (pa.int32(), pa.int32(), pa.binary()))], _HOT_NAMES)


def _explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for raw, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            runs, contexts = np.frombuffer(raw, RUN), z.decompress(packed)
            at = 0
            for r in range(0, len(runs), 512):
                part = runs[r : r + 512]
                spans = np.repeat(_whole(part), part["n"])
                spans["lo"] += np.concatenate([np.arange(n, dtype=np.uint32) for n in part["n"].tolist()])
                windows = []
                for n in part["n"].tolist():
                    windows += [contexts[at + i : at + i + WINDOW] for i in range(n)]
                    at += n + WINDOW - 1
                yield _hot_rows(spans, windows)


def _thin(parts: int, firsts: bool) -> Callable:
    """Rows come ordered by key, window and place. Of equal windows the first goes on (if `firsts`), the others become spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            # before equal windows of all tasks meet, those of one salt do
            windows = list(zip(b.column("window").to_pylist(), b.column("salt").to_pylist() if firsts else [0] * b.num_rows, strict=True))
            spans = np.zeros(len(windows), SPAN)
            spans["doc"] = b.column("doc").to_numpy()
            for name in ("tie", "tie2"):
                spans[name] = b.column(name).to_numpy().view(np.uint64) ^ _SIGN
            spans["lo"], spans["n"] = b.column("lo").to_numpy(), WINDOW
            new = np.array([w != v for v, w in zip([last, *windows], windows, strict=False)], bool)
            last = windows[-1] if windows else last
            if firsts and new.any():
                yield _hot_rows(spans[new], [windows[i][0] for i in np.flatnonzero(new).tolist()], b.column("key").to_numpy()[new].tolist())
            for a in _answer(_SPANS, joined_spans(spans[~new]), parts):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(a.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), *a.columns], _HOT_NAMES)

    return run


def _hot_spans(contexts: DataFrame, parts: int, shuffle: int) -> DataFrame:
    """Spans of repeated windows, among runs of tokens that no task could hold. Equal windows meet in SALTS tasks, then what is left of
    them, SALTS rows at most, in one."""
    place = ["window", "doc", "tie", "tie2", "lo"]
    windows = contexts.mapInArrow(_explode_windows, HOT_DDL)
    thin = stored(windows.repartition(shuffle, "key", "salt").sortWithinPartitions("key", "salt", *place).mapInArrow(_thin(parts, True), HOT_DDL), "suffix-windows")
    left = thin.where("what IS NULL").repartition(shuffle, "key").sortWithinPartitions("key", *place).mapInArrow(_thin(parts, False), HOT_DDL)
    spans = stored(left.unionByName(thin).where("what IS NOT NULL").select("what", "part", "payload"), "suffix-hot")
    discard(thin)
    return spans


class Cut:
    """The result of each document, and its text without what is removed, if wanted."""

    def __init__(self, with_text: bool):
        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
        self.with_text = with_text
        self.schema = pa.schema([*fields, ("kept" if with_text else "kept_sha256", pa.string())])
        self.kinds = T.StructType([*(T.StructField(name, T.LongType()) for name, _ in fields), T.StructField(self.schema.names[-1], T.StringType())])

    def prepare(self, parcels: list[bytes]) -> Items:
        return Items(joined_spans(np.concatenate([np.empty(0, SPAN), *(_unpack(p, SPAN) for p in parcels)])))

    def end(self, rows: list[tuple]) -> list[tuple]:
        return []

    def __call__(self, items: Items, doc: int | None, data: bytes) -> list[tuple]:
        mine = items.of(doc, data)
        kept, at = [], 0
        for lo, n in zip(mine["lo"].tolist(), mine["n"].tolist(), strict=True):
            kept.append(data[at:lo])
            at = lo + n
        kept.append(data[at:])
        rest = b"".join(kept)
        head = (doc, len(data), len(data) - len(rest), len(mine))
        if self.with_text:
            # a span may end inside a character: what is left of one is not text
            return [(*head, rest.decode(errors="ignore"))]
        return [(*head, hashlib.sha256(rest).hexdigest())]


def _splitters(docs: DataFrame, n: int, buckets: int) -> Splitters:
    """Quantiles of the leading tokens of a sample of documents. They shape the buckets' sizes, never the result."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(1).to_pylist():
                token, context, *_ = runs_of(text.encode())
                step = max(1, len(token) // 16)
                yield pa.RecordBatch.from_arrays([pa.array(x[::step][:16].astype(np.uint64).view(np.int64)) for x in (token, context)], ["t", "c"])

    rows = docs.sample(min(1.0, SAMPLE / n), 11).limit(2 * SAMPLE).mapInArrow(tokens, "t long, c long").collect() if n else []
    sample = np.zeros(len(rows), [("token", "<u8"), ("context", "<u8")])
    for i, name in enumerate(("token", "context")):
        sample[name] = np.array([r[i] for r in rows], np.int64).view(np.uint64)
    return Splitters(sample, buckets)


def _sizes(docs: DataFrame) -> tuple[int, int, int, int]:
    """Rows; shuffle partitions; buckets, which are the parts of the documents too; by the bytes of the texts."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    least = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(BUCKETS * least, -(-(size or 0) // BUCKET_BYTES))
    return n, max(least, buckets // (2 * BUCKETS)), buckets, buckets


def _spans(docs: DataFrame, n: int, shuffle: int, buckets: int, parts: int) -> DataFrame:
    """All spans to remove, packed by parts of the documents."""
    splitters = _splitters(docs, n, buckets)
    sent = docs.mapInArrow(_cut_runs(splitters), PARCELS_DDL)
    answers = stored(sent.repartition(shuffle, "to").sortWithinPartitions("to").mapInArrow(_sort_buckets(splitters, parts), ANSWER_DDL), "suffix-answers")

    def contexts(what: int) -> DataFrame:
        fetch = Fetch(splitters)
        return _beside(docs, answers.where(F.col("what") == what), parts, shuffle, fetch, fetch.kinds)

    contested = contexts(_RUNS).repartition(shuffle, "to").sortWithinPartitions("to").mapInArrow(_sort_contested(parts), ANSWER_DDL)
    found = contested.unionByName(answers.where(F.col("what") == _SPANS))
    hot = None
    if not answers.where(F.col("what") == _HOT).isEmpty():
        hot = _hot_spans(contexts(_HOT), parts, shuffle)
        found = found.unionByName(hot)
    spans = stored(found, "suffix-spans")
    discard(answers, *([hot] if hot is not None else []))
    return spans


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    ship(docs.sparkSession)
    slim, cut = _slim(docs), Cut(False)
    n, shuffle, buckets, parts = _sizes(slim)
    return _beside(slim, _spans(slim, n, shuffle, buckets, parts), parts, shuffle, cut, cut.kinds)


def clean(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the repeated strings cut out of the texts; where a cut splits a character, the rest of it goes too.
    Rows that lose nothing keep their text, null included."""
    ship(docs.sparkSession)
    columns = docs.columns
    names = [f"_in_{i}" for i in range(len(columns))]
    at = columns.index("text")
    rest = F.struct(F.col(names[at]).isNull().alias("none"), *[n for i, n in enumerate(names) if i != at])
    whole = docs.toDF(*names).select(F.col(names[columns.index("doc_id")]).cast("long").alias("doc_id"), text_of(names[at]).alias("text"), rest.alias("rest"))
    slim = whole.select("doc_id", "text")
    cut = Cut(True)
    n, shuffle, buckets, parts = _sizes(slim)
    done = _beside(whole, _spans(slim, n, shuffle, buckets, parts), parts, shuffle, cut, cut.kinds)
    out = {n: F.col(f"rest.{n}") for i, n in enumerate(names) if i != at} | {names[at]: F.when(~F.col("rest.none"), F.col("kept"))}
    if "n_chars" in columns:
        n = names[columns.index("n_chars")]
        out[n] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(out[n])
    return done.select(*[out[n].alias(c) for n, c in zip(names, columns, strict=True)])
