"""Sharding: minimax contiguous partition of groups of equal texts, in DataFrame functions only.

Groups are ordered by 60 bits of their text's MD5 and never divided. The least capacity for which a greedy
pass needs no more than the given number of shards is found by binary search on the driver, over sums of
ranges of hashes: 2**12 ranges first, and wherever a cut may fall, 2**6 parts of a range. A range counts as
one group (enough) or as divisible anywhere (needed); each round one query reads the parts of all ranges in
which the two differ, until they agree. A round reads at most about 22,000 rows (a range for each of some
300 places, 64 parts each), whatever the size of the table, and a few rounds do. Where shards may end
within the capacity, each ends as near to an equal share as the groups allow. Twenty-three cut keys then
decide each row's shard, so the rows themselves are never sorted globally.

Null text counts as empty (size 8); null or repeated doc_ids are rows like any other; an empty table
gives an empty result; a group larger than the mean shard gets a shard as large as itself. Columns other
than doc_id and text are not read, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, session

#: Bits of a hash; those that the first ranges are told apart by; those of their parts.
BITS, TOP, FAN = 60, 12, 6
#: Bits of the cells of hashes in which rows are ranked, and rows from which a cell is divided.
CELLS, FULL = 12, 256


def order_key(text: Column) -> Column:
    """The place of a text's group: its MD5's first 60 bits."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


class _Line:
    """The groups in order as ranges of hashes with their bytes: read more finely where it matters."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        row = groups.agg(F.max("bytes")).first()
        self.largest = row[0] or 0
        self._set(self._read(F.shiftright("h", BITS - TOP), BITS - TOP, F.lit(True)))

    def _read(self, child: Column, below: int, where: Column) -> list[tuple]:
        rows = self.groups.where(where).groupBy(child.alias("k")).agg(F.sum("bytes"), F.count(F.lit(1)), F.min("h")).collect()
        return [(first, size, n, below) for _, size, n, first in rows]

    def _set(self, parts: list[tuple]) -> None:
        self.parts = sorted(parts)
        self.sums = [0, *accumulate(p[1] for p in self.parts)]
        self.total = self.sums[-1]

    def refine(self, places: set[int]) -> None:
        """Reads the parts of some ranges, all with one query."""
        by: dict[int, list[int]] = {}
        for i in places:
            by.setdefault(self.parts[i][3], []).append(self.parts[i][0])
        where, child = F.lit(False), F.lit(None).cast("bigint")
        for bits, firsts in by.items():
            inside = F.shiftright("h", bits).isin([f >> bits for f in firsts])
            where = where | inside
            # ranges of other bits lie elsewhere; a shift of their own keeps the children of one apart from another's
            child = F.when(inside, F.shiftright("h", max(0, bits - FAN)) * 64 + bits).otherwise(child)
        rows = self.groups.where(where).groupBy(child.alias("k")).agg(F.sum("bytes"), F.count(F.lit(1)), F.min("h")).collect()
        fresh = [(first, size, n, max(0, k % 64 - FAN)) for k, size, n, first in rows]
        self._set([p for i, p in enumerate(self.parts) if i not in places] + fresh)

    def at(self, position: int) -> int:
        """The range that holds a byte position, or begins there."""
        return bisect_right(self.sums, position) - 1

    def coarse(self, i: int) -> bool:
        return i < len(self.parts) and self.parts[i][2] > 1


def _ends(line: _Line, capacity: int, shards: int, divisible: bool) -> list[int]:
    """Where a greedy pass ends each shard, up to the end of all groups."""
    out, at = [], 0
    for _ in range(shards):
        at = min(at + capacity, line.total)
        i = line.at(at)
        if line.sums[i] != at and not (divisible and line.coarse(i)):
            at = line.sums[i]
        out.append(at)
        if at == line.total:
            break
    return out


def _least(lo: int, hi: int, fits) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def _capacity(line: _Line, shards: int) -> int:
    """The least capacity, with the ranges refined as far as it takes to know."""
    low = max(-(-line.total // shards), line.largest)
    while True:
        fits = {d: lambda c, d=d: _ends(line, c, shards, d)[-1] == line.total for d in (True, False)}
        lo = _least(low, line.total, fits[True])
        hi = _least(lo, line.total, fits[False])
        if lo == hi:
            return lo
        need: set[int] = set()
        early, late = _ends(line, lo, shards, False), _ends(line, hi, shards, True)
        for k, a in enumerate(early):
            b = late[k] if k < len(late) else line.total
            need |= {i for i in range(line.at(a), line.at(b) + 1) if line.coarse(i)}
        line.refine(need)


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int | None], int]:
    """First hash of shards 1, 2, ... (None: no row from there on), and the least capacity. groups: h and bytes."""
    line = _Line(groups)
    if not line.total:
        return [None] * (shards - 1), 0
    capacity = _capacity(line, shards)
    while True:
        sums, need = line.sums, set()
        # right[j]: the first boundary from which j shards suffice
        right, at = [line.total], line.total
        for _ in range(shards - 1):
            at = max(0, at - capacity)
            i = bisect_left(sums, at)
            if sums[i] != at and line.coarse(i - 1):
                need.add(i - 1)
            at = sums[i]
            right.append(at)
        keys, at = [], 0
        for left in range(shards - 1, 0, -1):
            even = at + (line.total - at) // (left + 1)
            i, j = line.at(even), line.at(min(at + capacity, line.total))
            need |= {k for k, p in ((i, even), (j, min(at + capacity, line.total))) if sums[k] != p and line.coarse(k)}
            low, high = sums[i], sums[i] if sums[i] == even else sums[i + 1]
            at = max(right[left], min(low if even - low <= high - even else high, sums[j]))
            k = bisect_left(sums, at)
            keys.append(line.parts[k][0] if k < len(line.parts) else None)
        if not need:
            return keys, capacity
        line.refine(need)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) for every row of docs(doc_id, text)."""
    spark = session(docs.sparkSession)
    stages = Stages(spark, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stages.write(
        docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), order_key(text).alias("h"))
    )
    groups = stages.write(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).repartitionByRange("h").sortWithinPartitions("h"))
    keys, _capacity = cut_keys(groups, shards)

    place = F.lit(0)
    for key in keys:
        if key is not None:
            place = place + F.when(F.col("h") >= F.lit(key), 1).otherwise(0)
    # Ranks without one task for a shard or for a large group: ranges of hashes, the full ones divided by the row's place in the stage.
    cell = F.shiftright("h", BITS - CELLS).cast("int")
    cells = groups.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    mean = F.greatest(F.lit(FULL), F.ceil(F.sum("n").over(Window.partitionBy()) / F.lit(float(1 << CELLS))))
    cells = cells.select("cell", F.ceil(F.col("n") / mean).alias("parts"))  # 4096 rows at most, 8192 parts in all
    rows = rows.select("*", place.cast("int").alias("shard"), cell.alias("cell"), F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("mark"))
    rows = rows.join(F.broadcast(cells), "cell").withColumn("part", F.pmod("mark", F.col("parts")))
    where = ["shard", "cell", "part"]
    counts = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n"))  # as many rows as parts, and one more for each cut
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*where, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy(*where).orderBy("h", "doc_id", "mark"))
    return rows.join(F.broadcast(counts), where).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + rank - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
