"""Token ids in a content-addressed binary store.

Every text is encoded whole; a rolling hash over its ids cuts the stream into chunks, so equal passages give equal chunks wherever
they stand. The store has three parts under one folder:

* ``content/kind=chunk/``: one row for each distinct chunk: digest (BLAKE2b-128 of the ids as little-endian 32-bit integers), n_ids,
  codec, payload. The payload holds 16-bit ids where the vocabulary allows it, 32-bit ids otherwise, compressed by Zstandard where that
  is shorter.
* ``recipes/``: one row for each document in ascending doc_id order, shard by shard: doc_id, n_tokens, the chunk digests in order, and
  the Merkle root over them. A shard is a range of about SHARD documents at most, however many there are.
* ``manifest/``: one row for each shard: n_docs, n_tokens, start (ids of all shards before it), and the Merkle root over the
  documents' roots, in order.

``read_back`` takes everything from these files: it recomputes chunk digests, document roots and shard roots, and fails on a mismatch.

Defined results: null text counts as empty; every document ends with the end id, so none is empty; rows with null doc_id come after
all others; rows with equal doc_id stay separate and are ordered by their content; an empty table gives an empty store. Extra columns are
ignored. A text is encoded and cut whole, however long: a worker then holds its ids and some twenty times its bytes for a moment, and its
recipe has a digest for each chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Files
from .common import shared_folder, ship, text_of
from .wordcache import TextEncoder, held, slices

#: Chunk sizes in ids: no boundary before MIN_IDS, one every 2**MASK_BITS on average after that, and one at MAX_IDS at the latest.
MIN_IDS, MASK_BITS, MAX_IDS, WINDOW = 256, 10, 8192, 16
#: Digests that a task remembers, so as not to send a chunk again; documents of a shard.
SEEN, SHARD = 200_000, 100_000

#: A random 64-bit number for each id, taken modulo the table's size.
_NUMBERS = np.random.default_rng(3).integers(0, 1 << 63, 1 << 16, np.uint64)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: positions where a rolling hash of the last WINDOW ids has MASK_BITS zero bits. The hash is the
    sum of the ids' numbers, so it comes from one running sum."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n] if n else []
    total = np.cumsum(_NUMBERS[ids if ids.dtype.itemsize == 2 else ids & 0xFFFF], dtype=np.uint64)
    total[WINDOW:] -= total[:-WINDOW].copy()
    marks = np.flatnonzero(total & np.uint64(((1 << MASK_BITS) - 1) << 40) == 0) + 1
    out, start = [], 0
    for m in marks.tolist():
        while m - start > MAX_IDS:
            start += MAX_IDS
            out.append(start)
        if m - start >= MIN_IDS:
            out.append(m)
            start = m
    while n - start > MAX_IDS:
        start += MAX_IDS
        out.append(start)
    if start < n:
        out.append(n)
    return out


def digest_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged; no leaves: the hash of nothing. Leaves and nodes are hashed apart."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        paired = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0]


_squeeze, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray, wide: bool) -> tuple[int, bytes]:
    raw = ids.astype("<u4" if wide else "<u2").tobytes()
    small = _squeeze.compress(raw)
    return (2 * wide + 1, small) if len(small) < len(raw) else (2 * wide, raw)


def unpack(codec: int, payload: bytes) -> np.ndarray:
    return np.frombuffer(_open.decompress(payload) if codec & 1 else payload, "<u4" if codec & 2 else "<u2").astype(np.uint32)


class Encoder(TextEncoder):
    """The library encodes each word, and each piece that is foreign to the splitter."""

    def ids_of_word(self, word: str) -> list[int]:
        return [x.id for x in self.library.model.tokenize(word)]

    def foreign_piece(self, piece: str) -> list[int]:
        return self.library.encode(piece, add_special_tokens=False).ids


def encoder(path: str) -> Encoder:
    return held(("token_store", path), lambda: Encoder(path))


STAGED = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("salt", pa.int64()), ("n_ids", pa.int64()), ("digest", pa.binary()), ("digests", pa.list_(pa.binary())), ("codec", pa.int32()), ("payload", pa.binary())])
STAGED_DDL = "kind string, doc_id long, salt long, n_ids long, digest binary, digests array<binary>, codec int, payload binary"


def _stage(path: str, end_id: int):
    """documents -> their recipes, and the chunks that the task has not sent yet, as far back as it remembers. A recipe's salt is its number
    in the task: it parts equal recipes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end_of_text = np.array(end_id, encode.kind)
        seen: set[bytes] = set()
        salt = 0
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                all_ids, ends = encode.encode_all(part.column(1))
                at = 0
                for key, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    ids = np.append(all_ids[at:end], end_of_text)
                    at = end
                    digests, start = [], 0
                    for cut in cut_points(ids):
                        digests.append(d := digest_of(piece := ids[start:cut]))
                        if d not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(d)
                            rows.append(("chunk", None, None, cut - start, d, None, *pack(piece, encode.wide)))
                        start = cut
                    rows.append(("recipe", key, salt, len(ids), merkle(digests), digests, None, None))
                    salt += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STAGED, strict=True)], schema=STAGED)

    return run


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the first of neighbouring chunks with equal digests. Rows come ordered by kind and digest, so nothing is remembered."""
    last = None
    for batch in batches:
        keep = []
        for kind, d in zip(batch.column("kind").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            keep.append(kind != "chunk" or d != last)
            if kind == "chunk":
                last = d
        if any(keep):
            yield batch.filter(pa.array(keep))


def _parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Encode every text and write the store to `folder`. One shuffle moves each task's distinct chunks to the partition of their digest;
    the recipes are then ranged by document id."""
    spark = docs.sparkSession
    ship(spark)
    parts = _parts(spark)
    staged = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(_stage(tokenizer_path, end_id), STAGED_DDL)
    # equal chunks meet; recipes, which may repeat a root many times, spread by document and salt
    met = staged.repartition(parts, "digest", "doc_id", "salt").sortWithinPartitions("kind", "digest")
    met.mapInArrow(_unique, STAGED_DDL).write.partitionBy("kind").parquet(f"{folder}/content")
    recipes = _read(spark, f"{folder}/content", "recipe", "doc_id long, salt long, n_ids long, digest binary, digests array<binary>")
    placed = recipes.select("doc_id", F.col("n_ids").alias("n_tokens"), "digests", F.col("digest").alias("root"), "salt")
    order = [F.col("doc_id").asc_nulls_last(), F.col("root"), F.col("salt")]
    ranges = max(parts, -(-placed.count() // SHARD))
    ranged = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("salt")
    ranged.withColumn("shard", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{folder}/recipes")
    Files(spark).delete(f"{folder}/content/kind=recipe")  # they are in recipes/ now
    shards = recipe_rows(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    roots = _shard_roots(recipe_rows(spark, folder))
    # one row for each shard, that is for SHARD documents: a single ordered window takes them for 10**12 documents still
    starts = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards.join(roots, "shard").withColumn("start", starts).write.parquet(f"{folder}/manifest")
    return folder


def _read(spark: SparkSession, path: str, kind: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl + ", kind string").parquet(path).where(F.col("kind") == kind).drop("kind")


def recipe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, digests array<binary>, root binary, shard int, place long").parquet(f"{folder}/recipes")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/content", "chunk", "n_ids long, digest binary, codec int, payload binary")


def _shard_roots(recipes: DataFrame) -> DataFrame:
    """Merkle roots of the shards. A shard's rows are its own range of documents, so a group holds the 16-byte roots of about SHARD of them."""

    def root(key, table):
        ordered = table.sort_by("place")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "shard_root": pa.array([merkle(ordered.column("root").to_pylist())], pa.binary())})

    return recipes.select("shard", "place", "root").groupBy("shard").applyInArrow(root, "shard int, shard_root binary")


_POLY = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _zero_operators() -> list[list[int]]:
    """Matrices over GF(2) that append 2**k zero bytes to a CRC-32."""
    bit = [_POLY] + [1 << i for i in range(31)]
    ops = [bit]
    for _ in range(3 + 44):
        ops.append([_times(ops[-1], x) for x in ops[-1]])
    return ops[3:]


_zeros = _zero_operators()


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from (crc, bytes) of its parts."""
    total = 0
    for crc, n in parts:
        k = 0
        while n:
            if n & 1:
                total = _times(_zeros[k], total)
            n >>= 1
            k += 1
        total ^= crc
    return total


CHECKED = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, n, crc = batch.column("digest").to_pylist(), [], []
        for d, count, codec, payload in zip(digests, *(batch.column(c).to_pylist() for c in ("n_ids", "codec", "payload")), strict=True):
            raw = unpack(codec, payload).astype("<u4")
            if len(raw) != count or digest_of(raw) != d:
                raise ValueError(f"chunk {d.hex()} does not hold what its name says")
            n.append(count)
            crc.append(zlib.crc32(raw.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=CHECKED)


DIGEST_DDL = "place long, ids_crc32 long"


def _join_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place, crcs = batch.column("place").to_pylist(), []
        for n_tokens, root, parts in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "root", "parts")), strict=True):
            if merkle([p["digest"] for p in parts]) != root or sum(p["n"] for p in parts) != n_tokens:
                raise ValueError("a document's chunks do not match its recipe")
            crcs.append(crc_joined([(p["crc"], 4 * p["n"]) for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(crcs, pa.int64())], ["place", "ids_crc32"])


def verify_manifest(spark: SparkSession, folder: str) -> None:
    """Recompute every shard's Merkle root from its recipes; raises if one differs from the manifest."""
    kept = spark.read.parquet(f"{folder}/manifest").select("shard", F.col("shard_root").alias("kept"))
    if not _shard_roots(recipe_rows(spark, folder)).join(kept, "shard", "full").where(~F.col("kept").eqNullSafe(F.col("shard_root"))).isEmpty():
        raise ValueError("a shard does not match its manifest")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the store's files alone. Payloads are read once, where they lie; only
    their digest, length and CRC-32 are joined to the recipes, and a document's CRC is combined from those of its chunks."""
    ship(spark)
    verify_manifest(spark, folder)
    recipes = recipe_rows(spark, folder)
    checked = chunk_rows(spark, folder).mapInArrow(_check_chunks, "digest binary, n long, crc long")
    used = recipes.select("place", F.posexplode("digests").alias("pos", "digest"))
    parts = used.join(checked, "digest", "left").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", F.coalesce("n", F.lit(-1)).alias("n"), "crc"))).alias("parts"))
    whole = recipes.select("place", "n_tokens", "root").join(parts, "place").mapInArrow(_join_crcs, DIGEST_DDL)
    shards = spark.read.parquet(f"{folder}/manifest").select("shard", F.col("start").alias("shard_start"))
    before = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = recipes.select("doc_id", "n_tokens", "shard", "place").join(shards, "shard").withColumn("start", F.col("shard_start") + before)
    return placed.join(whole, "place").select("doc_id", "start", "n_tokens", "ids_crc32")


def ids_of(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array of int) of every document, put together from the chunks."""
    ship(spark)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [unpack(c, p).tolist() for c, p in zip(b.column("codec").to_pylist(), b.column("payload").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(ids, pa.list_(pa.int32()))], ["digest", "ids"])

    used = recipe_rows(spark, folder).select("doc_id", "place", F.posexplode("digests").alias("pos", "digest"))
    chunks = chunk_rows(spark, folder).mapInArrow(opened, "digest binary, ids array<int>")
    return used.join(chunks, "digest").groupBy("place", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids")).select("doc_id", "ids")


def store_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the store under the shared folder and return what is read back from it."""
    folder = write_store(docs, shared_folder(docs.sparkSession, "token-store"), tokenizer_path, end_id)
    return read_back(docs.sparkSession, folder)
