"""Near-duplicate groups by circulant MinHash, banding, and exact Jaccard verification.

A document is the set of its word shingles, by 64-bit hash. The hash places a shingle on a circle of 2**32 positions; one fixed
permutation of the circle, shifted by k places, gives coordinate k of the signature. So two permutations make all coordinates. Bands of
coordinates are hashed; documents that share a band are candidates, and every verdict is by their full sets.

1. Documents with equal sets form a class, of which the smallest doc_id stands for all.
2. In each band bucket, every class is held against the smallest and the largest one. What is linked is joined to components.
3. Buckets may then still hold several components. Of such a bucket, what neither is one of the two nor is of the component with most
   members there goes on: each visits that component, whose sets it is held against until one is near enough, and in blocks all of them
   are held against each other. A block gives a link only where it joins what it did not know to be joined, so no more of them than it
   has members. Afterwards every pair that shares a band has been compared, or is known to be of one component.

No bucket is capped, and no signature rules a pair out. What can be missed is a pair that shares no band: a chance of 5e-8 at similarity
0.8 (0.8 ** 4 is the chance of one band of 32). A group of n copies is one class; one of n near copies gives 2 n pairs for each band at most.

Defined results: null text counts as empty; a document without words has an empty set and is alone; one with fewer words than a shingle
has its whole sequence as its one shingle; a text is taken whole, however long (a worker then holds some twenty times its bytes for a
moment). Rows with equal doc_id are one document that has the links of all of its rows. A row without doc_id is linked with nothing, has
no component_id and is kept. Repeated rows stay; an empty table gives none; extra columns are ignored by `components` and kept by `keep`,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ship, stored, text_of
from .wordcache import LOWER_BLANKS, SHORT, held, pieces, slices

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: What one task holds at most, about: hosts, members of a block, and shingles in either; and the visitors of one part of a group.
HOSTS, BLOCK, SHINGLES, VISITORS = 1024, 2048, 2_000_000, 2048
#: Edges of a node from which its neighbours are told of it by a broadcast, where they are that many or a thousandth of all edges.
HUB = 100_000

#: Odd multipliers of the permutation of the circle, and the shifts of its coordinates.
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32) * _M1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles, A-Z lowered."""
    p = pieces(texts, LOWER_BLANKS)
    long = np.flatnonzero(p.sizes > SHORT)
    with np.errstate(over="ignore"):
        low, high = p.keys()
        words = _mixed(low + _mixed(high))  # of short words all bytes go in
    words[long] = np.fromiter(map(xxhash.xxh3_64_intdigest, p.at(long)), np.uint64, len(long))
    here = p.sizes > 0
    h = words[here]
    ends = np.concatenate(([0], np.cumsum(here)))[p.ends].tolist()

    def folded(h: np.ndarray, n: int) -> np.ndarray:
        s = h
        for i in range(1, n):
            s = _mixed(s[: len(h) - i] * np.uint64(0x9E3779B97F4A7C15)) + h[i:]
        return _mixed(s + np.uint64(n))

    out = []
    with np.errstate(over="ignore"):
        every = folded(h, width)  # those that would reach from one text into the next are passed over
        for a, b in zip([0, *ends], ends, strict=False):
            out.append(np.unique(every[a : b - width + 1]) if b - a >= width else folded(h[a:b], b - a) if b > a else h[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates: the minimum, over the shingles, of the permuted places from theirs on."""
    places = (shingles >> np.uint64(32)).astype(np.uint32) * _M1
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 256):
        x = np.add.outer(places[at : at + 256], _SHIFTS)
        x ^= x >> np.uint32(16)
        x *= _M2
        x ^= x >> np.uint32(15)
        x *= _M3
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in sig.reshape(BANDS, ROWS).T:
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return x.view(np.int64)


SKETCH_DDL = "doc_id long, n_shingles long, class binary, bands array<long>"


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("minhash_dedup",), dict)
        for b in batches:
            for part in slices(b, 1):
                sets = shingle_sets(part.column(1), width)
                classes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = np.concatenate([np.empty(0, np.int64), *(band_hashes(signature(s)) for s in sets if len(s))])
                offsets = np.concatenate(([0], np.cumsum([BANDS * bool(len(s)) for s in sets]))).astype(np.int32)
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands))], ["doc_id", "n_shingles", "class", "bands"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("minhash_dedup",), dict)
        for b in batches:
            for part in slices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), width)], pa.binary())], ["doc", "shingles"])

    return run


def near(both: np.ndarray | int, n: np.ndarray | int, m: int, percent: int):
    """Whether sets of n and m shingles, `both` of them common, reach the similarity."""
    return 100 * both >= percent * (n + m - both)


class Index:
    """Sets by their shingles: what another set has in common with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def common(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


class Hosts:
    """The sets that visitors of one group are held against."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.index: Index | None = None
        self.likely = 0

    def near(self, s: np.ndarray, percent: int) -> bool:
        """Whether a set reaches the similarity with one of these: the one that did last time first, then all."""
        if not self.sets or not len(s):
            return False
        first = self.sets[self.likely]
        both = int((first[np.minimum(np.searchsorted(first, s), len(first) - 1)] == s).sum()) if len(first) else 0
        if near(both, len(first), len(s), percent):
            return True
        if len(self.sets) == 1:
            return False
        if self.index is None:
            self.index = Index(self.sets)
        found = np.flatnonzero(near(self.index.common(s), self.index.sizes, len(s), percent))
        if len(found):
            self.likely = int(found[0])
        return len(found) > 0


def _confirm(percent: int):
    """Rows come ordered by group and part, hosts first: only the hosts of a part are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("minhash_dedup",), dict)
        at, hosts = None, Hosts()
        for b in batches:
            a, c = [], []
            for g, part, kind, doc, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (g, part) != at:
                    at, hosts = (g, part), Hosts()
                if kind == 0:
                    hosts.sets.append(np.frombuffer(raw, np.uint64))
                elif hosts.near(np.frombuffer(raw, np.uint64), percent):
                    a.append(g)
                    c.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def confirmed(sets: DataFrame, hosts: DataFrame, visits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): visitor b of group a is near one of the group's hosts. sets: doc, shingles; hosts: g, doc, n; visits: g, doc.

    Groups of many hosts, or of hosts with many shingles, are several parts, and so are those of many visitors."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shares(most: int, weight: str | None = None):
        share = F.count(F.lit(1)) / F.lit(most)
        return F.ceil(F.greatest(share, F.sum(weight) / F.lit(SHINGLES)) if weight else share)

    groups = hosts.groupBy("g").agg(shares(HOSTS, "n").alias("h")).join(visits.groupBy("g").agg(shares(VISITORS).alias("v")), "g")

    def placed(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        df = df.join(groups, "g").withColumn("m", F.pmod(F.xxhash64("doc"), F.col(own))).withColumn("e", every)
        part = F.col("m") * F.col("v") + F.col("e") if kind == 0 else F.col("e") * F.col("v") + F.col("m")
        return df.select("doc", "g", part.alias("part"), F.lit(kind).alias("kind"))

    roles = placed(hosts.select("g", "doc"), "h", "v", 0).unionByName(placed(visits, "v", "h", 1))
    sent = roles.join(sets, "doc").select("g", "part", "kind", "doc", "shingles")
    return sent.repartition(parts, "g", "part").sortWithinPartitions("g", "part", "kind").mapInArrow(_confirm(percent), "a long, b long").distinct()


def _beside(frame: DataFrame, lows: DataFrame, edges: int) -> DataFrame:
    """frame joined with lows (u, m, n) on u, where n is u's number of rows. Nodes with very many are told by a broadcast; they are no
    more than two thousand, so that no key of the join has more than a thousandth of the rows, or HUB."""
    if edges <= HUB:
        return frame.join(lows.drop("n"), "u")
    most = max(HUB, edges // 1000)
    marked = frame.join(F.broadcast(lows.where(F.col("n") > most).select("u", F.col("m").alias("hub"))), "u", "left")
    rest = marked.where("hub IS NULL").drop("hub").join(lows.where(F.col("n") <= most).drop("n"), "u")
    return marked.where("hub IS NOT NULL").withColumnRenamed("hub", "m").unionByName(rest)


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node and the smallest node of its component, by alternating large and small stars. Each round is written to the shared folder."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, size = state, 2 * state[0]
        both = edges.union(edges.select("v", "u"))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _beside(both, lows, size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _beside(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), size)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, edges = edges, stored(small, "near-edges")
        discard(old)
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "near-labels")
    discard(edges)
    return labels


LINKS_DDL = "a long, b long"


def _join_blocks(percent: int):
    """Links that join components, among the rows of one pair of blocks: none that follows from those before it."""

    def join(table: pa.Table) -> pa.Table:
        held(("minhash_dedup",), dict)
        side, node, root = (table.column(c).to_numpy().copy() for c in ("side", "node", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        index = Index(sets)
        a, b = [], []
        for i in np.flatnonzero(side != 1).tolist():
            other = (root != root[i]) & (side != 0 if side[i] == 0 else side == side[i])
            if not other.any():
                continue
            for j in np.flatnonzero(near(index.common(sets[i]), index.sizes, len(sets[i]), percent) & other).tolist():
                if root[j] != root[i]:
                    a.append(int(node[i]))
                    b.append(int(node[j]))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return join


def _join_rest(sets: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Links among the members of a bucket that are left. rest: band, node, component, n."""
    weight = F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("n") / F.lit(SHINGLES))
    mixed = rest.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(weight).alias("blocks")).where("lo < hi").select("band", "blocks")
    rows = rest.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a block meets itself (side 2), and as the left side (0) every later block
    side = lambda j: F.when(j == F.col("block"), 2).when(F.col("block") < j, 0).otherwise(1)
    partner = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y"), side(j).alias("side")))
    met = rows.withColumn("met", F.explode(partner)).select("band", "met.x", "met.y", "met.side", "node", "component")
    full = met.join(sets.withColumnRenamed("doc", "node"), "node").drop("doc")
    return full.groupBy("band", "x", "y").applyInArrow(_join_blocks(percent), LINKS_DDL)


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sketch = stored(docs.mapInArrow(_sketch(width), SKETCH_DDL), "near-sketch")
    known = sketch.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-classes")
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("other"), F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = stored(banded.join(shared, "band"), "near-buckets")
    sets = stored(docs.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id").mapInArrow(_full_sets(width), "doc long, shingles binary"), "near-sets")

    pairs = stored(buckets.select(F.col("leader").alias("g"), F.col("node").alias("doc")).union(buckets.select("other", "node")).where("g <> doc").distinct(), "near-pairs")
    leaders = pairs.select("g").distinct().select("g", F.col("g").alias("doc"), F.lit(0).cast("long").alias("n"))
    # a doc_id with several texts links their classes
    told = known.select("doc_id", "class", F.xxhash64("class").alias("h"))
    several = told.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("doc_id")
    own = told.join(several, "doc_id").join(classes.select("class", "node"), "class").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = stored(confirmed(sets, leaders, pairs, percent).union(own), "near-links")
    labels = connected(spark, links)

    # what buckets of more than three still hold beside their two ends and the component that most of their members are of
    large = buckets.where("c > 3").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(large.select("band", "node", "n", "component", ((F.col("node") == F.col("leader")) | (F.col("node") == F.col("other"))).alias("end")), "near-named")
    most = named.groupBy("band", "component").count().groupBy("band").agg(F.max(F.struct("count", -F.col("component"))).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    tops = stored(most.select("band", F.when(F.col("top.count") > 1, -F.col("top.col2")).alias("top")), "near-tops")
    rest = stored(named.where("NOT end").join(tops, "band").where("top IS NULL OR component <> top"), "near-rest")
    if not rest.isEmpty():
        visits = stored(rest.where("top IS NOT NULL").select(F.col("top").alias("g"), F.col("node").alias("doc")).distinct(), "near-visits")
        everyone = classes.select("node", "n").join(labels, "node", "left").select(F.coalesce("component", "node").alias("g"), F.col("node").alias("doc"), "n")
        hosts = everyone.join(visits.select("g").distinct(), "g", "left_semi")
        more = stored(confirmed(sets, hosts, visits, percent).union(_join_rest(sets, rest, percent)), "near-links")
        old, labels = labels, connected(spark, links.union(more))
        discard(old, visits, more)
    discard(buckets, sets, pairs, links, named, tops, rest)

    placed = classes.select("class", "node").join(labels, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    whole = sketch.select("doc_id", "n_shingles", "class").join(placed, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id."""
    columns = docs.columns
    names = [f"_in_{i}" for i in range(len(columns))]  # positions, so that no column name can clash
    gone = components(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.toDF(*names)
    return rows.join(gone, F.col(names[columns.index("doc_id")]) == F.col("_gone"), "left_anti").toDF(*columns)


def single(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near texts, with all its columns: the one with the smallest doc_id, null last, then the smallest hash of
    its text. Rows are numbered, and every row is a document of its own: repeated rows and rows without doc_id take part by their texts."""
    columns = docs.columns
    names = [f"_in_{i}" for i in range(len(columns))]
    rows = stored(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    doc_id, text = F.col(names[columns.index("doc_id")]), F.col(names[columns.index("text")])
    groups = components(rows.select(F.col("_row").alias("doc_id"), text.alias("text")), width, percent).select(F.col("doc_id").alias("_row"), "component_id")
    ranks = rows.select("_row", F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(text).alias("h"), F.col("_row").alias("row")).alias("rank"))
    stays = groups.join(ranks, "_row").groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").drop("_row").toDF(*columns)
