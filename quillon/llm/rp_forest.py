"""Approximate nearest neighbours by a forest of random-projection trees.

Level by level, a tree projects rows on the difference of two rows drawn at random, and splits each node at the median of its rows'
projections. The upper levels are fitted on a bounded sample; where the table asks for more leaves than the sample can tell medians of,
the medians below are fitted leaf by leaf, in parallel, on a share of the rows. Every row is routed to one leaf of each tree. A query walks
all trees by one priority queue that holds nodes of any tree by the smallest margin on the way to them, and takes leaves as they come. The
rows of those leaves are candidates; their inner products with the query are computed in double precision on the original vectors, and the
largest are returned.

How many trees there are, how deep they go and how many leaves a query takes is settled on the sample: the fewest rows at which RECALL of
the sample's true neighbours are in a leaf taken. So data with structure are searched in few leaves of deep trees, and data without any,
where trees tell little, in many leaves of shallow ones; that is most rows of the table, whatever the trees do.

Leaves are searched in groups of neighbours. A group of many rows is split into blocks, and so are its queries, so one vector that a third
of the rows share does no harm. A query is sent once to each block, with the list of the leaves that it takes there.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id, nor rows
whose dimension is not the most common one (the smaller, of two as common). Rows with equal vec_id are one candidate, at its best score,
and one query. Equal scores are ordered by vec_id, and of those at the k-th place the smaller ids stay. Fewer candidates than k give as many
rows; an empty table gives none. Extra columns are ignored. Vectors may have any length; a block holds up to twice BLOCK of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Rows of the sample at most, and queries on it; numbers of trees that are tried; rows of a leaf, about; deepest tree; share of true
#: neighbours to find on the sample.
SAMPLE, PROBES, TREES, LEAF, DEEPEST, RECALL = 20_000, 300, (2, 4, 8), 1024, 20, 0.95
#: Rows of the sample, or of the share, from which a median is told; share of a tree's leaves up to which it is worth going deeper.
TELL, FEW = 32, 0.05
#: Leaves of a group; rows and queries of a block.
GROUP, BLOCK = 8, 4096


class Tree:
    """A complete binary tree in an array: node j has children 2j + 1 and 2j + 2. All nodes of a level share a direction."""

    def __init__(self, directions: np.ndarray):
        self.directions, self.depth = directions, 0
        self.cuts = np.zeros(0)

    def fit(self, sample: np.ndarray, depth: int) -> Tree:
        projected, node = sample @ self.directions[:depth].T, np.zeros(len(sample), np.int64)
        self.depth, self.cuts = depth, np.zeros(2**depth - 1)
        for level in range(depth):
            node = _split(self.cuts, node, projected[:, level], level)
        return self

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        projected, node = rows @ self.directions[: self.depth].T, np.zeros(len(rows), np.int64)
        for level in range(self.depth):
            node = 2 * node + 1 + (projected[:, level] > self.cuts[node])
        return node - (2**self.depth - 1)


def _split(cuts: np.ndarray, node: np.ndarray, projected: np.ndarray, level: int) -> np.ndarray:
    """Writes the medians of a level's nodes, and gives the rows' nodes one level down."""
    order = np.lexsort((projected, node))
    at, first, n = np.unique(node[order], return_index=True, return_counts=True)
    cuts[at] = projected[order[first + (n - 1) // 2]]
    return 2 * node + 1 + (projected > cuts[node])


class Forest:
    def __init__(self, trees: list[Tree], take: int):
        self.trees, self.take = trees, take

    @property
    def depth(self) -> int:
        return self.trees[0].depth

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest first: one queue for all trees, ordered by the smallest margin on the way to a node."""
        inner = 2**self.depth - 1
        projected = [(t.directions[: t.depth] @ query).tolist() for t in self.trees]
        queue = [(-math.inf, t, 0, 0) for t in range(len(self.trees))]
        while queue:
            worst, t, j, level = heapq.heappop(queue)
            if j >= inner:
                yield t, j - inner
                continue
            m = projected[t][level] - float(self.trees[t].cuts[j])
            heapq.heappush(queue, (max(worst, m), t, 2 * j + 1, level + 1))
            heapq.heappush(queue, (max(worst, -m), t, 2 * j + 2, level + 1))

    def settle(self, sample: np.ndarray, k: int, rng: np.random.Generator) -> float:
        """Sets how many leaves a query takes; the rows that it then meets, as a multiple of the table."""
        leaves = np.stack([t.leaves(sample) for t in self.trees])
        needed = []
        for i in rng.permutation(len(sample))[:PROBES]:
            score = sample @ sample[i]
            score[i] = -math.inf
            near = np.argpartition(-score, k)[:k]
            waiting = {(t, leaf): near[leaves[t][near] == leaf].tolist() for t in range(len(self.trees)) for leaf in set(leaves[t][near].tolist())}
            met: dict[int, int] = {}
            for at, way in enumerate(self.walk(sample[i]), 1):
                for row in waiting.get(way, ()):
                    met.setdefault(row, at)
                if len(met) == k:
                    break
            needed += met.values()
        self.take = int(np.ceil(np.quantile(needed, RECALL)))
        return self.take / 2**self.depth


def fit(sample: np.ndarray, n_rows: int, k: int, seed: int = 5) -> tuple[Forest, int]:
    """A forest, as far as the sample can tell it, and the depth that it should have. sample: rows in double precision; n_rows: rows of the table."""
    rng = np.random.default_rng(seed)
    wanted = max(0, min(DEEPEST, round(math.log2(max(1, n_rows / LEAF)))))
    depth = min(wanted, int(math.log2(max(1, len(sample) / TELL))))
    best, least = None, math.inf
    for trees in TREES:
        forest = Forest([Tree(_directions(sample, max(1, wanted), rng)).fit(sample, depth) for _ in range(trees)], trees * 2**depth)
        if not depth or len(sample) <= k:
            return forest, depth
        met = forest.settle(sample, k, rng)
        if met < least:
            best, least = forest, met
    # where few leaves are needed, the trees tell something, and it is worth telling more
    return best, wanted if best.take <= FEW * len(best.trees) * 2**depth else depth


def _directions(sample: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    out = np.empty((depth, sample.shape[1]))
    for level in range(depth):
        a, b = rng.integers(len(sample), size=2)
        v = sample[a] - sample[b]
        while not np.linalg.norm(v) > 1e-12:
            v = rng.normal(size=sample.shape[1])
        out[level] = v / np.linalg.norm(v)
    return out


def deepen(forest: Forest, rows: DataFrame, n_rows: int, depth: int) -> None:
    """Medians of the levels below those that the sample could tell, leaf by leaf, from a share of the rows chosen by hash. What comes
    back is a number for each node: 8 bytes for some LEAF rows, 2 ** DEEPEST numbers for each tree at most."""
    top, below = forest.depth, depth - forest.depth
    share = min(1.0, 2 * TELL * 2**depth / n_rows)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                for t, tree in enumerate(forest.trees):
                    p = x @ tree.directions[top:depth].T
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * below), pa.array(p.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaves(x).astype(np.int32)), lists], ["tree", "leaf", "p"])

    def medians(key, table):
        p = _matrix(table.column("p").combine_chunks())
        cuts, node = np.zeros(2**below - 1), np.zeros(len(p), np.int64)
        for level in range(below):
            node = _split(cuts, node, p[:, level], level)
        return pa.table({"tree": [key[0].as_py()], "leaf": [key[1].as_py()], "cuts": [cuts.tolist()]}, schema=pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("cuts", pa.list_(pa.float64()))]))

    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v")
    found = chosen.mapInArrow(project, "tree int, leaf int, p array<double>").groupBy("tree", "leaf").applyInArrow(medians, "tree int, leaf int, cuts array<double>").toArrow()
    whole = [np.concatenate((t.cuts, np.zeros(2**depth - 2**top))) for t in forest.trees]
    for t, leaf, cuts in zip(*(found.column(c).to_pylist() for c in ("tree", "leaf", "cuts")), strict=True):
        for level in range(below):
            # nodes of one level of a subtree stand side by side in the tree
            at = 2 ** (top + level) - 1 + leaf * 2**level
            whole[t][at : at + 2**level] = cuts[2**level - 1 : 2 ** (level + 1) - 1]
    for t, cuts in zip(forest.trees, whole, strict=True):
        t.cuts, t.depth = cuts, depth


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v (an array of floats or doubles, as they are) of the rows that take part."""
    v = F.col("v")
    kind = table.schema[vector_column].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType | T.DoubleType) else T.DoubleType()
    df = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(T.ArrayType(kind)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    bad: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0.0))
    common = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return df.where(F.size("v") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


MET = pa.schema([("tree", pa.int32()), ("group", pa.int32()), ("leaves", pa.list_(pa.int32())), ("vec_id", pa.int64())])


def _leaves(forest) -> object:
    """Each row's leaf in each tree, without its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                for t, tree in enumerate(forest.value.trees):
                    leaf, n = np.unique(tree.leaves(x), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(n)], ["tree", "leaf", "n"])

    return run


def _route(forest):
    """Each row in each tree: its group of leaves, and its leaf as a list of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                ones = pa.array(np.arange(len(x) + 1, dtype=np.int32))
                for t, tree in enumerate(forest.value.trees):
                    leaf = tree.leaves(x).astype(np.int32)
                    columns = [pa.array(np.full(len(x), t, np.int32)), pa.array(leaf // GROUP), pa.ListArray.from_arrays(ones, pa.array(leaf))]
                    yield pa.RecordBatch.from_arrays([*columns, *b.columns], [*MET.names, "v"])

    return run


def _probe(forest, sizes, k: int):
    """Each query once for each group in which it takes leaves: as many as the forest says, and until one tree has given more than k rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, counts = forest.value, sizes.value
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else []
            for i in range(b.num_rows):
                taken: dict[tuple[int, int], list[int]] = {}
                n, rows = 0, [0] * len(f.trees)
                for t, leaf in f.walk(x[i]):
                    if n >= f.take and max(rows) > k:
                        break
                    n += 1
                    rows[t] += int(counts[t][leaf])
                    if counts[t][leaf]:
                        taken.setdefault((t, leaf // GROUP), []).append(leaf)
                keys = list(taken)
                same = pa.array(np.full(len(keys), i))
                columns = [pa.array([t for t, _ in keys], pa.int32()), pa.array([g for _, g in keys], pa.int32()), pa.array(list(taken.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, b.column(0).take(same), b.column(1).take(same)], [*MET.names, "v"])

    return run


FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
FOUND_DDL = "query_id long, ids array<long>, scores array<double>"


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids, largest score first, ties to smaller ids."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _rank(k: int):
    def rank(table):
        kind = table.column("kind").to_numpy()
        ids, vectors = table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks())
        leaves = table.column("leaves").combine_chunks()
        base = table.column("group")[0].as_py() * GROUP
        rows, queries = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        R, row_ids = vectors[rows], ids[rows]
        row_leaf = leaves.take(pa.array(rows)).flatten().to_numpy() - base if len(rows) else np.empty(0, np.int64)
        out = []
        for at in range(0, len(queries) if len(rows) else 0, 256):
            part = queries[at : at + 256]
            asked = np.zeros((len(part), GROUP), bool)
            lists = leaves.take(pa.array(part))
            asked[np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy() - base] = True
            here = np.flatnonzero(asked.any(axis=0)[row_leaf])  # rows in leaves that one of these queries takes
            rough = vectors[part] @ R[here].T
            rough[~asked[:, row_leaf[here]]] = -math.inf
            for i, q in enumerate(part.tolist()):
                s = rough[i]
                s[row_ids[here] == ids[q]] = -math.inf
                # a little below the k-th, so that what differs by rounding alone is kept; repeated ids may need a second, full look
                edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -math.inf
                near = np.flatnonzero((s >= edge - 1e-9 * (1 + abs(edge))) & (s > -math.inf)) if edge > -math.inf else np.flatnonzero(s > -math.inf)
                if len(near) >= k and len(np.unique(row_ids[here[near]])) < k:
                    near = np.flatnonzero(s > -math.inf)
                near = here[near]
                exact = (R[near] * vectors[q]).sum(axis=1)
                top = best(exact, row_ids[near], k)
                if len(top):
                    out.append((int(ids[q]), row_ids[near][top].tolist(), exact[top].tolist()))
        return pa.Table.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(FOUND)], schema=FOUND)

    return rank


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by query; what one query has so far is never more than k and one block's."""
        at, ids, scores = None, np.empty(0, np.int64), np.empty(0)

        def done() -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, at, np.int64)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for q, i, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if q != at:
                    if at is not None:
                        yield done()
                    at, ids, scores = q, np.empty(0, np.int64), np.empty(0)
                ids, scores = np.concatenate((ids, i.values.to_numpy())), np.concatenate((scores, s.values.to_numpy()))
                top = best(scores, ids, k)
                ids, scores = ids[top], scores[top]
        if at is not None:
            yield done()

    return run


def search(table: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row for which `queries` (over vec_id) holds."""
    spark = table.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(table, id_column, vector_column)
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the rows of the smallest hashes: a bounded sample, the same at every run
    chance = F.xxhash64("vec_id", "v")
    hashed = rows.where(F.pmod(chance, F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / n_rows) * (1 << 30)) + 1)
    sample = hashed.orderBy(chance, "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    sample = sample if sample.num_rows else rows.select("v").limit(1).toArrow()  # copies of few vectors, of unlucky hashes
    drawn = _matrix(sample.column(0).combine_chunks())
    grown, depth = fit(drawn, n_rows, k)
    if depth > grown.depth:
        deepen(grown, rows, n_rows, depth)
        grown.settle(drawn, k, np.random.default_rng(6))
    forest = spark.sparkContext.broadcast(grown)
    kind = rows.schema["v"].dataType.simpleString()
    found = rows.select("v").mapInArrow(_leaves(forest), "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    tallied = found.toArrow()  # a number for each leaf, of some LEAF rows; no more than 2 ** DEEPEST for each tree
    counts = [np.zeros(2**grown.depth, np.int32) for _ in grown.trees]
    for t in range(len(counts)):
        mine = tallied.filter(pc.equal(tallied.column("tree"), t))
        counts[t][mine.column("leaf").to_numpy()] = mine.column("n").to_numpy()
    sizes = spark.sparkContext.broadcast(counts)
    met = f"tree int, group int, leaves array<int>, vec_id long, v {kind}"
    placed = rows.mapInArrow(_route(forest), met)
    asked = rows.where(queries).mapInArrow(_probe(forest, sizes, k), met)
    groups = found.groupBy("tree", (F.col("leaf") / GROUP).cast("int").alias("group")).agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("r"))
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))
    plan = groups.join(asked.groupBy("tree", "group").agg(blocks.alias("q")), ["tree", "group"])

    def spread(df: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        # rows with equal ids part by their vectors, queries meet all
        mine = df.join(plan, ["tree", "group"]).withColumn(f"{own}b", F.pmod(F.xxhash64("vec_id", "v"), F.col(own)))
        return mine.withColumn(f"{other}b", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("tree", "group", "rb", "qb", F.lit(kind).alias("kind"), "leaves", "vec_id", "v")

    both = spread(placed, "r", "q", 0).unionByName(spread(asked, "q", "r", 1))
    ranked = both.groupBy("tree", "group", "rb", "qb").applyInArrow(_rank(k), FOUND_DDL)
    return ranked.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), schema)
