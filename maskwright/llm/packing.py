"""Packing: documents' token ids into windows of a fixed size, balanced by Karmarkar-Karp differencing.

A document's ids (with its end id) fill whole windows first; what remains is cut into items of at most a
quarter window. The items of a block of documents are dealt to the fewest windows that can hold them by
multiway differencing: partial partitions, each a list of window sums, are merged two by two, the two
with the largest imbalance first, the fullest windows of one onto the emptiest of the other. Where a
window then exceeds the capacity, one more is opened and the block is dealt anew.

Everything happens where the rows are read: no shuffle, and a block of bounded size at a time. Null and
empty texts are documents of one id (the end id). Equal rows and null doc_ids are packed like any other.
Only doc_id and text are read; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import session, small
from .tokens import encoder

WINDOW, END_ID = 2048, 1
#: Ids of remainders that are dealt at once.
BLOCK = 1 << 19


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each item, by multiway largest differencing."""
    n = len(sizes)
    if n <= 1 or windows == 1:
        return np.zeros(n, np.int64)
    parts: dict[int, np.ndarray] = {}  # sums of a partial partition's windows, fullest first, less the emptiest
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def take() -> tuple[int, np.ndarray]:
        _, i = heapq.heappop(heap)
        if i >= n:
            return i, parts.pop(i)
        alone = np.zeros(windows, np.int64)
        alone[0] = sizes[i]
        return i, alone

    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (a, x), (b, y) = take(), take()
        both = x + y[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        node = n + len(merges)
        merges.append((a, b, order))
        parts[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    # Back from the last merge to the items: the window in which each partial window came to lie.
    lies = {n + len(merges) - 1: np.arange(windows)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        at = np.empty(windows, np.int64)
        at[order] = lies.pop(n + k)
        lies[a], lies[b] = at, at[::-1]
    return np.array([lies[i][0] for i in range(n)], np.int64)


def deal(sizes: list[int], window: int) -> np.ndarray:
    """The window of each item: as few windows as differencing can fill without exceeding one."""
    windows = max(1, -(-sum(sizes) // window))
    while True:
        where = difference(sizes, windows)
        if not len(where) or np.bincount(where, weights=sizes).max() <= window:
            return where
        windows += 1


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    item = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def rows(ids, starts, parts, tokens, sequences, offsets):
            longs = [pa.array(x, pa.int64()) for x in (starts, [len(p) // 4 for p in parts])]
            rest = [pa.array(x, pa.int64()) for x in (tokens, sequences, offsets)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *longs, pa.array(parts, pa.binary()), *rest], names)

        def dealt(items):
            nonlocal sequence
            where = deal([len(p) // 4 for _, _, p, _ in items], window)
            used = {w: sequence + k for k, w in enumerate(dict.fromkeys(where.tolist()))}
            filled: dict[int, int] = {}
            columns = [[], [], [], [], [], []]
            for (doc, start, part, tokens), w in zip(items, where.tolist(), strict=True):
                at = filled.get(w, 0)
                filled[w] = at + len(part) // 4
                for column, value in zip(columns, (doc, start, part, tokens, used[w], at), strict=True):
                    column.append(value)
            sequence += len(used)
            return rows(*columns)

        open_items, held = [], 0
        for batch in small(batches, 1):
            whole = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).texts(batch.column(1), end_id), strict=True):
                n, raw = len(ids), ids.astype("<u4").tobytes()
                full = n - n % window
                for start in range(0, full, window):
                    for column, value in zip(whole, (doc, start, raw[4 * start : 4 * (start + window)], n, sequence, 0), strict=True):
                        column.append(value)
                    sequence += 1
                for start in range(full, n, item):
                    open_items.append((doc, start, raw[4 * start : 4 * min(n, start + item)], n))
                held += n - full
                if held >= block:
                    yield dealt(open_items)
                    open_items, held = [], 0
            if whole[0]:
                yield rows(*whole)
        if open_items:
            yield dealt(open_items)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
