"""Token ids of a corpus in Huffman-coded binary files, and back.

``write_tokens`` puts the documents in ascending order of their ids (range partitions by id and row, one
shard each), encodes the texts, counts all ids over the corpus, builds one canonical code
with lengths of at most ``max_bits`` from the counts, and writes

* ``codebook``: one row (id, bits) per id that occurs; the codes follow from the lengths;
* ``blocks``: rows of about ``block_ids`` ids, whole documents each, with the number of ids
  before the block, the documents' ids and lengths, the bit offset of every
  ``CHECKPOINT``-th id and the payload. Shard and block numbers give the order.

A block can be decoded without any other. Decoding looks the next ``max_bits`` bits up in a
table, at all checkpoints of a block at once. Both folders are Parquet, so that tasks that
are run again leave no halves behind and any storage that Spark can write will do.

A null text is an empty document, which is its end id alone. Rows with a null id come first.
Repeated rows are kept, next to each other. Other columns are not read. An empty table gives
an empty codebook and no blocks. The codebook has at most as many rows as the vocabulary.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import documents, query, slices
from linkcast.llm.tokens import encoder, vocabulary
from linkcast.session import stage_root

CHECKPOINT = 64
COUNTS = -1  # in the place of a block's number: the counts of a shard
SHARD_BYTES = 16 << 20
MOST_SHARDS = 50_000
RECENT_WORDS = 400_000

HEAD = "shard int, block long, before long, n_ids long, doc_ids array<long>, doc_sizes array<long>"
PLAIN_BLOCK = f"{HEAD}, ids binary"
BLOCK = f"{HEAD}, checkpoints binary, payload binary"
HEAD_FIELDS = [
    ("shard", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())),
]


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes longer than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    levels, merged = [], weights
    is_leaf = np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(max_bits - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        merged, is_leaf = both[place], place < n
        levels.append(is_leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter codes first, equal lengths in ascending order of ids."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.width = int(self.lengths.max()) if len(ids) else 1
        span = np.left_shift(1, self.width - self.lengths)
        codes = (np.cumsum(span) - span) >> (self.width - self.lengths)
        size = int(self.ids.max()) + 1 if len(ids) else 1
        # A code and its length in one number; so are an id and the length of its code.
        self.code_of = np.zeros(size, np.int64)
        self.code_of[self.ids] = codes << 8 | self.lengths
        self.table = np.ones(1 << self.width, np.int64)
        self.table[: int(span.sum())] = np.repeat(self.ids << 8 | self.lengths, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(checkpoints, payload): little-endian 32-bit bit offsets, and bits from the highest down."""
        found = self.code_of.take(ids)
        bits = found & 255
        end = np.cumsum(bits)
        start = end - bits
        word, free = start >> 6, 64 - (start & 63) - bits
        code = (found >> 8).astype(np.uint64)
        n_words = int(end[-1] + 63 >> 6) if len(ids) else 0
        out = np.zeros(n_words + 1, np.uint64)
        high = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64),
                        code >> np.maximum(-free, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(free < 0)  # at most one id in a word runs over into the next
            out[word[over] + 1] |= code[over] << (64 + free[over]).astype(np.uint64)
        size = int(end[-1] + 7 >> 3) if len(ids) else 0
        return start[::CHECKPOINT].astype("<u4").tobytes(), out.astype(">u8").tobytes()[:size]

    def decode(self, checkpoints: bytes, payload: bytes, n_ids: int) -> np.ndarray:
        """The ids of one block."""
        if not n_ids:
            return np.zeros(0, "<u4")
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        last = 8 * len(payload)
        out = np.empty((CHECKPOINT, len(at)), "<u4")
        shift, table = np.uint32(32 - self.width), self.table
        for step in range(CHECKPOINT):
            look = window.take(at >> 3)
            look <<= (at & 7).astype(np.uint32)
            look >>= shift
            entry = table.take(look)
            out[step] = entry >> 8
            entry &= 255
            at += entry
            np.minimum(at, last, out=at)
        return out.T.reshape(-1)[:n_ids]


def _planes(ids: bytes, width: int) -> bytes:
    """The low bytes of all ids, then the next ones; packs better than ids one by one."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    for k in range(width):
        out[:, k] = planes[k]
    return out.view("<u4").reshape(-1)


def write_tokens(
    docs: DataFrame, folder: str, path: str, keeps_space: bool, end_id: int, vocabulary_size: int,
    id_col: str = "doc_id", text_col: str = "text", max_bits: int = 18, block_ids: int = 1 << 16,
) -> None:
    """Writes ``folder``/codebook and ``folder``/blocks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, size // SHARD_BYTES + 1)
    width = max(1, (int(vocabulary_size - 1).bit_length() + 7) // 8)
    end = np.array([end_id], "<u4").tobytes()

    staged = pa.schema([*HEAD_FIELDS, ("ids", pa.binary())])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keeps_space, RECENT_WORDS)
        shard, seq, before = TaskContext.get().partitionId(), 0, 0
        total = np.zeros(vocabulary_size, np.int64)
        docs, sizes, raw, size = [], [], [], 0  # of the open block

        def block() -> pa.RecordBatch:
            ids = b"".join(raw)
            total[:] += np.bincount(np.frombuffer(ids, "<u4"), minlength=vocabulary_size)
            row = (shard, seq - len(docs), before - size, size, docs, sizes, _planes(ids, width))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, staged)], schema=staged)

        for batch in batches:
            for some in slices(batch, 1):
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist())):
                    if size >= block_ids:
                        yield block()
                        docs, sizes, raw, size = [], [], [], 0
                    n = len(ids) // 4 + 1
                    docs.append(doc)
                    sizes.append(n)
                    raw += (ids, end)
                    seq, before, size = seq + 1, before + n, size + n
        if docs:  # then the counts of the shard, as one more row
            yield block()
            row = (shard, COUNTS, before, 0, None, None, total.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, staged)], schema=staged)

    # A hot id, or all rows without one, are spread by row. The sample for the ranges reads no text.
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    plain = f"{stage_root(spark)}/linkcast-ids-{uuid.uuid4().hex}"
    ordered.select("doc_id", "text").mapInArrow(tokenize, PLAIN_BLOCK).write.option("compression", "zstd").parquet(plain)
    written = spark.read.schema(PLAIN_BLOCK).parquet(plain)
    ids = written.where(F.col("block") != COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary_size, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                total += np.frombuffer(batch.column(0)[k].as_py(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = written.where(F.col("block") == COUNTS).select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    counts.sort()
    known = np.array([c[0] for c in counts], np.int64)
    lengths = code_lengths(np.array([c[1] for c in counts], np.int64), max_bits)
    pairs = [(int(i), int(b)) for i, b in zip(known, lengths)]
    spark.createDataFrame(pairs, "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    totals = dict(ids.groupBy("shard").agg(F.sum("n_ids")).collect())  # at most MOST_SHARDS or the partitions
    heads, before = {}, 0
    for shard in sorted(totals):
        heads[shard] = before
        before += totals[shard]
    shared = spark.sparkContext.broadcast((Code(known, lengths), heads))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, heads = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                shard, block, before, n, docs, sizes, planes = batch.slice(at, 1).columns
                head = heads[shard[0].as_py()]
                checkpoints, payload = code.encode(_from_planes(planes[0].as_py(), width))
                columns = [
                    shard, block, pa.array([head + before[0].as_py()]), n, docs, sizes,
                    pa.array([checkpoints], pa.binary()), pa.array([payload], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = pa.schema([*HEAD_FIELDS, ("checkpoints", pa.binary()), ("payload", pa.binary())])
    ids.mapInArrow(blocks, BLOCK).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_code(spark: SparkSession, folder: str) -> Code:
    rows = spark.read.schema("id long, bits int").parquet(f"{folder}/codebook").collect()
    return Code(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def read_tokens(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): ids are little-endian unsigned 32-bit integers.

    With ``digest_only`` the ids themselves are left out.
    """
    shared = spark.sparkContext.broadcast(read_code(spark, folder))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids binary")
    columns = ["before", "n_ids", "doc_ids", "doc_sizes", "checkpoints", "payload"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                raw = code.decode(r["checkpoints"], r["payload"], r["n_ids"]).tobytes()
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                docs = [raw[4 * a: 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                arrays = [
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + ends - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if not digest_only:
                    arrays.append(pa.array(docs, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks").select(*columns)
    return blocks.mapInArrow(decode, schema)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids, written as Huffman-coded files and read back."""
    folder = f"{stage_root(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf), folder, vocabulary("byte_bpe_50k.json"), True, 2, 50_257)
    return read_tokens(spark, folder, digest_only=True)
