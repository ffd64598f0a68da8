"""Token-id files: canonical length-limited Huffman codes in independent blocks with checkpoints.

Format, as rows that Spark writes and reads on any store:

* header: one row, ``lengths`` - the code length of each id (0: does not occur). Codes are canonical:
  ordered by length, then id. No code is longer than 16 bits.
* blocks: ``file``, ``block``, ``first`` (ids before the block in its file), ``doc_ids`` and ``sizes``
  (whole documents, in ascending order), ``marks`` (little-endian unsigned 32-bit bit offsets of every
  128th id) and ``payload`` (the bit stream, most significant bit first).

Files follow each other in ascending doc_id order. Every block is decoded by itself, all its marks at
once, with one table look-up for each id.

Null and empty texts are documents of one id (the end id); null doc_ids come first; rows with equal
doc_ids are all written, in the order of a checksum of their ids, and may lie in several files, so that no
doc_id is one task's. Only doc_id and text are read, whatever the other columns are called. An empty table
gives a header without codes and no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import tidy_shuffles
from .common import Stages, loosen, partitions, session, small, squeeze
from .tokens import encoder

END_ID = 1
#: Longest code; ids between two checkpoints; ids after which a block ends with the next document.
LIMIT, STEP, BLOCK = 16, 128, 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code without codes beyond the limit (package-merge)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    n, levels = len(order), []
    weights = leaves
    for _ in range(limit - 1):
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)  # which places of this level's list are leaves
        weights = both[rank]
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        own = int(np.count_nonzero(leaf[:take]))
        bits[:own] += 1
        take = 2 * (take - own)
    bits[:take] += 1
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    if len(order):
        # a code is the sum of the room that the codes before it take
        room = np.uint64(1) << (32 - size).astype(np.uint64)
        codes[order] = (np.cumsum(room) - room) >> (32 - size).astype(np.uint64)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Checkpoints and bit stream."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = ends - size
        word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
        two = self.codes[ids] << shift  # two 32-bit words, the upper one where the code begins
        out = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] += np.add.reduceat(two >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(two & np.uint64(0xFFFFFFFF), first)
        payload = out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) >> 3]
        return at[::STEP].astype("<u4").tobytes(), payload

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the length for each beginning of a bit stream."""
        ids, size = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
        for i in np.flatnonzero(self.lengths):
            n = int(self.lengths[i])
            lo = int(self.codes[i]) << (LIMIT - n)
            ids[lo : lo + (1 << (LIMIT - n))], size[lo : lo + (1 << (LIMIT - n))] = i, n
        return ids, size


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.ids, self.size = Coder(lengths).table()

    def decode(self, marks: bytes, payload: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(marks, "<u4").astype(np.int64)
        raw = np.frombuffer(payload + b"\0\0\0", np.uint8).astype(np.uint32)
        three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        out = np.empty((STEP, len(at)), np.uint32)
        tail = n - STEP * (len(at) - 1)  # the last mark is followed by so many
        for k in range(STEP):
            if k == tail:
                at = at[:-1]
            if not len(at):
                break
            beginning = three[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)
            out[k, : len(at)] = self.ids[beginning]
            at += self.size[beginning]
        return out.T.reshape(-1)[:n]


def _packed(ids: np.ndarray, wide: bool) -> bytes:
    """Ids for a stage: their lower and upper bytes apart, compressed."""
    kind, n = ("<u4", 4) if wide else ("<u2", 2)
    return squeeze(ids.astype(kind).view(np.uint8).reshape(-1, n).T)


def _unpacked(raw: bytes, wide: bool) -> np.ndarray:
    kind, n = ("<u4", 4) if wide else ("<u2", 2)
    return np.ascontiguousarray(loosen(raw, np.uint8).reshape(n, -1).T).view(kind).reshape(-1)


HEADER, BLOCKS = "header", "blocks"


class TokenFiles:
    """A written set of files: the header's code lengths and the table of blocks."""

    def __init__(self, lengths: np.ndarray, blocks: DataFrame):
        self.lengths, self.blocks = lengths, blocks
        self.id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenFiles:
        """The files that write_token_files() wrote to a path."""
        session(spark)
        header, blocks = (spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in (HEADER, BLOCKS))
        return cls(np.frombuffer(bytes(header.first()[0]), np.uint8), blocks)

    def read(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) for every document."""
        totals = self.blocks.groupBy("file").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
        before = Window.partitionBy().orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each file
        lengths = self.lengths

        def run(batches: Iterator[pa.RecordBatch]):
            decoder = Decoder(lengths)
            for batch in small(batches, payload):
                for row in batch.to_pylist():
                    ends = np.cumsum(np.array(row["sizes"], np.int64))
                    ids = decoder.decode(row["marks"], row["payload"], int(ends[-1])).astype("<u4")
                    starts = ends - np.array(row["sizes"], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                            pa.array(starts + row["first"] + row["base"], pa.int64()),
                            pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "ids"],
                    )

        rows = self.blocks.join(F.broadcast(totals), "file")
        payload = rows.columns.index("payload")
        return rows.mapInArrow(run, f"doc_id {self.id_type}, start bigint, ids binary")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> TokenFiles:
    """Writes the ids of all documents, in ascending doc_id order, to a new folder; without one, to a folder that goes when the application ends."""
    spark = session(docs.sparkSession)
    stages = Stages(spark, "token-files")
    path = (path or f"{stages.root}/files").rstrip("/")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    wide = vocabulary > 1 << 16

    def tokenise(batches):
        n = 0
        for batch in small(batches, 1):
            packed, marks = [], []
            for ids in encoder(tokenizer).texts(batch.column(1), end_id):
                packed.append(_packed(ids, wide))
                # equal rows by the thousand differ in their place
                marks.append(zlib.crc32(packed[-1]) << 12 | n & 0xFFF)
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "mark", "packed"])

    tokens = stages.write(docs.select("doc_id", "text").mapInArrow(tokenise, f"doc_id {id_type}, mark bigint, packed binary"), codec="none")

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in small(batches, 0):
            ids = [_unpacked(x, wide) for x in batch.column(0).to_pylist()]
            if ids:
                total += np.bincount(np.concatenate(ids), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for i, n in tokens.select("packed").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():  # one row for an id
        counts[i] = n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/{HEADER}")

    def encode(batches):
        from pyspark import TaskContext

        file, coder = TaskContext.get().partitionId(), Coder(lengths)
        block = first = held = 0
        doc_ids, parts = [], []

        def out():
            marks, payload = coder.encode(np.concatenate(parts))
            sizes = [len(p) for p in parts]
            values = [[file], [block], [first], [doc_ids], [sizes], [marks], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["file", "block", "first", "doc_ids", "sizes", "marks", "payload"])

        for batch in small(batches, 1):
            kind = batch.schema.field(0).type
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc)
                parts.append(_unpacked(packed, wide))
                held += len(parts[-1])
                if held >= BLOCK:
                    yield out()
                    block, first, held = block + 1, first + held, 0
                    doc_ids, parts = [], []
        if parts:
            yield out()

    ordered = tokens.repartitionByRange(partitions(spark), "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "packed")
    schema = f"file int, block int, first bigint, doc_ids array<{id_type}>, sizes array<bigint>, marks binary, payload binary"
    with tidy_shuffles(spark):
        ordered.mapInArrow(encode, schema).write.option("compression", "none").parquet(f"{path}/{BLOCKS}")
    stages.drop(tokens)
    return TokenFiles.open(spark, path)


def digest(read: DataFrame) -> DataFrame:
    """The documents read, with a checksum in place of their ids."""
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
