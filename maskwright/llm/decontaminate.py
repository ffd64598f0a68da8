"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur with k = floor(RATE * n) edits. Cut into k + 1 pieces, one of them must
occur unchanged, at most k places from where the others put it. One Aho-Corasick automaton finds all pieces
of all items; a hit is verified with Myers' bit-parallel edit distance over the window that the item can
take up - after a shorter look at what lies beside the piece, which most chance hits don't survive.

Items and texts are compared lower-cased, with each run of white space as one space. Null and empty texts
hold nothing and are kept. An item too short for an edit must occur as it is, between word borders, and one
of fewer than LEAST characters, null or empty is never found: it would be found everywhere. Equal items are
found alike; rows with equal or null doc_ids are searched like any other. Other columns of documents are
passed on by clean() as they are and not read by find_leaks(), whatever they are called; an empty table of
either kind gives no leaks. Items come to the driver and go to the executors in blocks of a fixed size,
whatever their number, and each block reads all documents again; documents are searched where they are
read, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import releasing, session, small

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of the shortest item that is looked for.
LEAST = 8
#: Items, and characters of items, that one automaton holds.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000
#: Patterns that a worker keeps ready.
PATTERNS = 4096
#: Characters beside a piece that are looked at first.
GLANCE = 64


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _border(text: str, at: int) -> bool:
    """No word goes on from one side of a place to the other."""
    return at in (0, len(text)) or not (text[at - 1].isalnum() and text[at].isalnum())


class Pattern:
    """Bit-parallel edit distance of a pattern to the substrings of a text (Myers 1999)."""

    def __init__(self, pattern: str):
        self.n = len(pattern)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)
        self.full, self.top = (1 << self.n) - 1, 1 << max(0, self.n - 1)

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """The least distance to a substring (anchored: to a prefix) of the text, and its first end."""
        pv, mv, score = self.full, 0, self.n
        low, end = self.n, 0
        full, top, get = self.full, self.top, self.masks.get
        start = 1 if anchored else 0  # whether a step along the text alone costs
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | start) & full
            mh = mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < low:
                low, end = score, j + 1
        return low, end


class Finder:
    """All occurrences of some items within their error budgets."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.items = [(key, normal(text)) for key, text in items]
        self.budget = [int(rate * len(t)) for _, t in self.items]
        self.patterns: dict[tuple, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(self.items):
            k = self.budget[i]
            if len(text) < LEAST:
                continue
            cuts = np.linspace(0, len(text), k + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    places[text[a:b]].append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def _pattern(self, i: int, a: int, b: int, back: bool) -> Pattern:
        key = (i, a, b, back)
        if key not in self.patterns:
            if len(self.patterns) >= PATTERNS:
                self.patterns.clear()
            part = self.items[i][1][a:b]
            self.patterns[key] = Pattern(part[::-1] if back else part)
        return self.patterns[key]

    def _check(self, text: str, i: int, a: int, size: int, at: int) -> tuple[int, int, int] | None:
        """Distance, start and end of item i about a piece of it that lies at a place of the text."""
        item, k = self.items[i][1], self.budget[i]
        n, origin = len(item), at - a
        if origin >= 0 and text.startswith(item, origin) and (k or (_border(text, origin) and _border(text, origin + n))):
            return 0, origin, origin + n
        if not k:
            return None
        # beside the piece, on the longer side
        if n - a - size >= a:
            part = min(GLANCE, n - a - size)
            near = self._pattern(i, a + size, a + size + part, False).best(text[at + size : at + size + part + k], True)[0]
        else:
            part = min(GLANCE, a)
            near = self._pattern(i, a - part, a, True).best(text[max(0, at - part - k) : at][::-1], True)[0]
        if near > k:
            return None
        begin = max(0, origin - k)
        window = text[begin : origin + n + k]
        distance, end = self._pattern(i, 0, n, False).best(window)
        if distance > k:
            return None
        size = self._pattern(i, 0, n, True).best(window[:end][::-1], True)[1]
        return distance, begin + end - size, begin + end

    def find(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """For each item found: least distance, start and end of its best (then first) occurrence, in the normalised text."""
        found: dict[int, tuple[int, int, int]] = {}
        text = normal(text)
        if not text or not self.any:
            return found
        seen = set()
        for last, (size, where) in self.automaton.iter(text):
            at = last + 1 - size
            for i, a in where:
                if (i, at - a) in seen or (i in found and found[i][0] == 0):
                    continue
                seen.add((i, at - a))
                if (hit := self._check(text, i, a, size, at)) and (i not in found or hit < found[i]):
                    found[i] = hit
        return found


def blocks(items: DataFrame, most: int = BLOCK_ITEMS, characters: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """items(item_id, text) in blocks that fit the driver and an executor."""
    block, held = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        if block and (len(block) >= most or held + len(row[1] or "") > characters):
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1] or "")
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start and end for each document and item that it holds; offsets in the normalised text."""
    spark = session(docs.sparkSession)
    doc_type, item_type = (f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {doc_type}, item_id {item_type}, distance bigint, start bigint, end bigint"
    item_arrow = to_arrow_type(items.schema["item_id"].dataType)

    def search(block):
        shared = spark.sparkContext.broadcast(block)  # of a fixed size

        def run(batches):
            finder = Finder(shared.value, rate)
            for batch in small(batches, 1):
                rows, hits = [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    for i, hit in sorted(finder.find(text).items()):
                        rows.append(r)
                        hits.append((finder.items[i][0], *hit))
                columns = list(zip(*hits, strict=True)) if hits else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], item_arrow), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    ["doc_id", "item_id", "distance", "start", "end"],
                )

        return docs.select("doc_id", "text").mapInArrow(releasing(run), schema)

    found = [search(b) for b in blocks(items)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark = session(docs.sparkSession)
    at = docs.schema.fieldNames().index("text")

    def without(docs, block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            finder = Finder(shared.value, rate)
            for batch in small(batches, at):
                yield batch.filter(pa.array([not finder.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return docs.mapInArrow(releasing(run), docs.schema)

    return reduce(without, blocks(items), docs)

