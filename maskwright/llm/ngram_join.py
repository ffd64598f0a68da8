"""N-gram Jaccard join: documents whose sets of five-word shingles are alike, and their components.

Two documents link when 100 * |A & B| >= 75 * |A | B|. Method: prefixes of token combinations.

1. Shingles become 64-bit tokens. Their document frequencies are counted exactly: tokens travel in packed
   blocks to the task of their range, and only those of two or more documents travel back. A token that a
   block holds often travels once, with its count, so that one shingle of every document is no hot key. A
   document with more than a quarter of its tokens to itself can have no partner and ends here.
2. Tokens have one order: by frequency (exact up to FREQUENT, then by powers of two). A document's prefix is
   extended until its signatures cover floor(n / 4) + 1 tokens. A rare token (FREQUENT documents at most) is
   a signature of its own and covers one; tokens of the frequent classes are dealt to sub-classes, and each
   combination of k prefix tokens of a sub-class is a signature, so that p tokens of a sub-class cover
   p - k + 1: pairs up to VERY documents, triples beyond. If two prefixes had no signature in common, the
   shorter would hold more tokens that the other lacks than a link allows. Sub-classes depend on the size
   band, and a document near the end of its band is indexed in the next one too.
3. Documents with a signature in common, of sizes that allow a link, are verified on their whole sets.
   Short signature lists give all their pairs. A long list gives the pairs with one pivot, its set with the
   fewest tokens of its own (what copies were made from links with all of them). Of a list that is long
   within one block only a pivot of the block's own travels on, so that no signature is a hot key; the members
   are paired with it, once for all their signatures, and go with it to the list's pivot.
4. Where the members of a pivot's lists are then not one component, those of them that can have a partner in
   the list by their sizes are signed again by combinations of more tokens, level by level. What lists are
   torn after the last level is compared in pairs of blocks, by exact overlap matrices.

Equal sets are one node throughout: within a block copies send their tokens once, and those of other blocks
are dropped by name after the count. Components come from large-star / small-star rounds on the links;
nothing but counts reaches the driver. Steps are written to the shared folder and deleted once they are read.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. With fewer
than five words, the whole sequence is the one shingle. Rows with equal or null doc_ids are rows of their
own; a component's id is its least doc_id (null if all are). doc_id is of an integer type. Only doc_id and
text are read, whatever the other columns are called; an empty table gives no rows.

Sets are known by 64-bit sums of their tokens: among 10**10 different sets some three pairs share one by
chance, and would count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import LOWER, Stages, input_bytes, loosen, mix, partitions, releasing, session, small, span_hashes, squeeze, text_pieces, word_spans

U = np.uint64
SHINGLE, PERCENT = 5, 75
#: Tokens of more documents than this are frequent, and of more than that very frequent.
FREQUENT, VERY = 64, 4096
#: Signature lists up to this size give all their pairs at once.
SHORT = 12
#: Occurrences of a token, and members of a signature, in one block beyond which they travel apart.
OFTEN, MANY = 16, 32
#: Rounds of longer combinations for members of torn lists.
LEVELS = 1
#: Sets in a block of members that are compared with another block.
BLOCK = 512
#: Tokens that a task gathers before it sends them on; input bytes whose tokens a task holds at once.
FLUSH, RANGE_BYTES = 1 << 20, 16 << 20
#: Ranges that one partition is divided into, at most.
MOST_RANGES = 1024
#: Parts of a key in salted joins.
SALTS = 16


# ---------------------------------------------------------------- sets


def shingle_hashes(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of some texts, and the place where each text's begin (n + 1)."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs)
    words = span_hashes(low, starts, ends)
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, n_words > 0)
    at = np.concatenate([[0], np.cumsum(n)])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    length = np.repeat(np.minimum(n_words, size), n)
    out = np.zeros(at[-1], np.uint64)
    for k in range(size):
        word = words[np.minimum(begin + k, len(words) - 1)]
        out = np.where(length > k, mix(out * U(0x9E3779B97F4A7C15) + word + U(k + 1)), out)
    return out, at


def _sets(data: np.ndarray, offs: np.ndarray):
    """For each text its sorted distinct tokens, and the sum that names the set."""
    hashes, at = shingle_hashes(data, offs)
    for i in range(len(offs) - 1):
        own = np.unique(hashes[at[i] : at[i + 1]])
        yield own, int(mix(own * U(0xD1342543DE82EF95) + U(len(own))).sum(dtype=np.uint64).astype(np.int64)) if len(own) else 0


def _pack(ranked: np.ndarray) -> bytes:
    """Sorted tokens of one range: their upper bytes hardly change, so byte by byte they take some five bytes each."""
    return squeeze(np.ascontiguousarray(ranked.astype("<u8").view(np.uint8).reshape(-1, 8).T))


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(loosen(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


_PARCEL = "slot bigint, flush bigint, kind int, a binary, b binary, c binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _parcels(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], ["slot", "flush", "kind", "a", "b", "c"])


def _groups(batches: Iterator[pa.RecordBatch], key: int):
    """Key and rows of sorted parcels, one key's at a time."""
    rows = (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True))
    yield from groupby(rows, lambda row: row[key])


def _runs(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array begins, and how often it occurs."""
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(ranked)))


def _cuts(ranked: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots (ranges of the upper 32 bits, n in all) that occur in a sorted array, and the bounds of each."""
    slot = (ranked >> U(32)) * U(n) >> U(32)
    begin, size = _runs(slot)
    return slot[begin].astype(np.int64), np.append(begin, len(ranked)) if len(begin) else np.zeros(1, np.int64)


def _send(n: int):
    """docs(doc_id, text, h) -> parcels of tokens by range, and of owners; h is a hash of the row's text.

    Kind 0: the block's documents. 1: tokens and their owners, by range. 2: tokens that the block holds often,
    and how often, by range. 3: the owners of these, for the block itself.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        flush = TaskContext.get().partitionId() << 24
        ids, marks, names, sizes, tokens, seen = [], [], [], [], [], set()
        held = 0

        def out():
            every = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(tokens), dtype=np.uint16), [len(t) for t in tokens])
            order = np.argsort(every)
            every, owner = every[order], owner[order]
            del order
            begin, size = _runs(every)
            known = np.array([i is not None for i in ids])
            rows = [(flush % n, flush, 0, np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes(), np.array([sizes, marks], np.int64).tobytes(), np.array(names, np.int64).tobytes())]
            often = size > OFTEN
            if often.any():
                inside = np.repeat(often, size)
                hot, count = every[begin[often]], size[often]
                rows.append((flush % n, flush, 3, hot.tobytes(), squeeze(owner[inside]), count.astype(np.int64).tobytes()))
                slots, cut = _cuts(hot, n)
                rows += [(s, flush, 2, hot[a:b].tobytes(), None, count[a:b].astype(np.int64).tobytes()) for s, a, b in zip(slots.tolist(), cut, cut[1:], strict=False)]
                every, owner = every[~inside], owner[~inside]
            slots, cut = _cuts(every, n)
            rows += [(s, flush, 1, _pack(every[a:b]), squeeze(owner[a:b]), None) for s, a, b in zip(slots.tolist(), cut, cut[1:], strict=False)]
            return _parcels(rows)

        for batch in small(batches, 1):
            doc_ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, _j, data, offs in text_pieces(batch.column(1), 2 << 20):
                for k, (own, name) in enumerate(_sets(data, offs)):
                    ids.append(doc_ids[i + k])
                    marks.append(hashes[i + k])
                    names.append(name)
                    sizes.append(len(own))
                    tokens.append(own if name not in seen else own[:0])
                    seen.add(name)
                    held += len(tokens[-1])
                    if held >= FLUSH or len(ids) >= 60_000:
                        yield out()
                        flush, held = flush + 1, 0
                        ids, marks, names, sizes, tokens, seen = [], [], [], [], [], set()
        if ids:
            yield out()

    return run


def frequency_class(n: np.ndarray) -> np.ndarray:
    """n itself up to FREQUENT, then one more for each power of two."""
    beyond = FREQUENT + np.ceil(np.log2(np.maximum(n, FREQUENT + 1) / FREQUENT))
    return np.where(n <= FREQUENT, n, beyond).astype(np.uint8)


#: The last class whose tokens are not very frequent.
_PAIRS = int(frequency_class(np.array([VERY]))[0])


def _count(batches: Iterator[pa.RecordBatch]):
    """Parcels, sorted by range -> the tokens of two documents or more, by sender, with the class of their frequency."""
    for _, rows in _groups(batches, 0):
        parts = []
        for _, flush, kind, a, b, c in rows:
            if kind in (0, 3):
                yield _parcels([(0, flush, kind, a, b, c)])
            else:
                parts.append((flush, kind, b, _unpack(a) if kind == 1 else np.frombuffer(a, np.uint64), c))
        if not parts:
            continue
        tokens = np.concatenate([p[3] for p in parts])
        weight = np.concatenate([np.ones(len(p[3]), np.int32) if p[1] == 1 else np.frombuffer(p[4], np.int64).astype(np.int32) for p in parts])
        order = np.argsort(tokens)
        begin, size = _runs(tokens[order])
        total = np.add.reduceat(weight[order], begin, dtype=np.int64)
        often = np.empty(len(tokens), np.uint8)
        often[order] = np.repeat(frequency_class(total), size)
        del order, weight
        at, back = 0, []
        for flush, kind, owners, own, _ in parts:
            mine = often[at : at + len(own)]
            at += len(own)
            keep = mine >= 2
            if keep.any():
                back.append((0, flush, kind, _pack(own[keep]), squeeze(loosen(owners, np.uint16)[keep]) if kind == 1 else None, squeeze(mine[keep])))
        if back:
            yield _parcels(back)


_SETS = "kind int, doc_id bigint, h bigint, n bigint, name bigint, rare bigint, tokens binary, classes binary"


def _gather(batches: Iterator[pa.RecordBatch]):
    """Parcels, sorted by sender -> a row for each document (kind 0), and one for each set that can have a partner (kind 1)."""
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
    fields = ["kind", "doc_id", "h", "n", "name", "rare", "tokens", "classes"]
    for _, rows in _groups(batches, 1):
        parts: dict[int, list] = {0: [], 1: [], 2: [], 3: []}
        for _, _, kind, a, b, c in rows:
            parts[kind].append((a, b, c))
        a, b, c = parts[0][0]
        (sizes, marks), names = np.frombuffer(b, np.int64).reshape(2, -1), np.frombuffer(c, np.int64)
        m = len(sizes)
        ids, known = np.frombuffer(a[: 8 * m], np.int64), np.frombuffer(a[8 * m :], bool)
        none = pa.nulls(m, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(ids, mask=~known), pa.array(marks), pa.array(sizes), pa.array(names), pa.nulls(m, pa.int64()), none, none], fields)
        tokens, owner, often = [_unpack(p[0]) for p in parts[1]], [loosen(p[1], np.uint16) for p in parts[1]], [loosen(p[2], np.uint8) for p in parts[1]]
        if parts[3]:
            hot, owners, count = np.frombuffer(parts[3][0][0], np.uint64), loosen(parts[3][0][1], np.uint16), np.frombuffer(parts[3][0][2], np.int64)
            answered, said = np.concatenate([_unpack(p[0]) for p in parts[2]]), np.concatenate([loosen(p[2], np.uint8) for p in parts[2]])
            tokens.append(np.repeat(hot, count))
            owner.append(owners)
            often.append(np.repeat(said[np.argsort(answered)], count))  # both are the same tokens
        if not tokens:
            continue
        tokens, owner, often = np.concatenate(tokens), np.concatenate(owner), np.concatenate(often)
        shared = np.bincount(owner, minlength=m)
        # a copy within the block sent no tokens and ends here as well
        alive = (sizes > 0) & (shared >= sizes - sizes // 4)
        keep = alive[owner]
        tokens, owner, often = tokens[keep], owner[keep], often[keep]
        order = np.lexsort((tokens, often, owner))
        tokens, owner, often = tokens[order], owner[order], often[order]
        cut = np.searchsorted(owner, np.arange(m + 1))
        rare = np.bincount(owner[often <= FREQUENT], minlength=m)
        live = np.flatnonzero(alive)
        for i in range(0, len(live), 2000):
            some = live[i : i + 2000]
            blobs = [tokens[cut[k] : cut[k + 1]].tobytes() for k in some]
            classes = [often[cut[k] + rare[k] : cut[k + 1]].tobytes() for k in some]
            values = [np.ones(len(some), np.int32), [None] * len(some), [None] * len(some), sizes[some], names[some], rare[some].astype(np.int64), blobs, classes]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], fields)


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


# ---------------------------------------------------------------- signatures


def band(n: int) -> int:
    return int(n).bit_length() - 1


def bands(n: int) -> list[int]:
    """A set's size band, and the next where a partner can be in it."""
    own = band(n)
    return [own, own + 1] if band(100 * n // PERCENT) > own else [own]


def scheme(b: int, level: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """How many tokens a combination has and how many sub-classes there are, for frequent and for very frequent tokens of a band.

    With k tokens a sub-class, p of them cover p - k + 1. The numbers are such that the tokens of any set that
    can have a partner, three quarters of it at least, cover what its prefix has to: (k - 1) * sub-classes of
    both together is half the band's least size or less, and less than that in small bands.
    """
    if level == 0:
        return ((2, 1 << b - 3), (3, 1 << b - 4)) if b >= 5 else ((2, 1), (2, 1))
    k = level + 2 if b >= 3 else 2
    one = (k, 1 << max(0, b - 4) if b >= 5 else 1)
    return one, one


@lru_cache(None)
def _choices(p: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(p), k)), np.int64).reshape(-1, k)


def signatures(n: int, tokens: np.ndarray, rare: int, classes: np.ndarray, level: int = 0) -> np.ndarray:
    """The signatures of a set of n tokens: those shared with others are given by frequency, and from ``rare`` on also the class of each."""
    need = n // 4 + 1 - (n - len(tokens))
    alone = tokens[: min(rare, need)]
    need -= len(alone)
    out = [mix(alone)]
    frequent = tokens[rare:]
    if need > 0 and len(frequent):
        for b in bands(n):
            pair, triple = scheme(b, level)
            very = classes > _PAIRS
            scattered = mix(frequent * U(0xA0761D6478BD642F) + U(b))
            if pair == triple:
                k, sub = np.full(len(frequent), pair[0]), (scattered % U(pair[1])).astype(np.int64)
            else:
                k = np.where(very, triple[0], pair[0])
                sub = np.where(very, pair[1] + (scattered % U(triple[1])).astype(np.int64), (scattered % U(pair[1])).astype(np.int64))
            order = np.lexsort((scattered, classes))  # one order for all sets of a band: by frequency, then by hash
            k, sub, ranked = k[order], sub[order], frequent[order]
            # the first k - 1 tokens of a sub-class cover nothing, each further one covers one
            by = np.argsort(sub, kind="stable")
            begin, size = _runs(sub[by])
            place = np.empty(len(sub), np.int64)
            place[by] = np.arange(len(sub)) - np.repeat(begin, size)
            end = int(np.searchsorted(np.cumsum(place >= k - 1), need)) + 1
            k, sub, ranked = k[:end], sub[:end], ranked[:end]
            by = np.lexsort((ranked, sub))
            k, sub, ranked = k[by], sub[by], ranked[by]
            begin, size = _runs(sub)
            for p in np.unique(size).tolist():
                for width in (pair[0], triple[0]) if pair != triple else (pair[0],):
                    at = begin[(size == p) & (k[begin] == width)]
                    if p < width or not len(at):
                        continue
                    rows = ranked[at[:, None] + np.arange(p)][:, _choices(p, width)]
                    made = mix(rows[..., 0] + U(b + 1 + 64 * level))
                    for j in range(1, width):
                        made = mix(made * U(3) + rows[..., j])
                    out.append(made.reshape(-1))
    return np.concatenate(out)


def _sign(n: int, level: int = 0):
    """Sets -> parcels of signatures by slot.

    Kind 1: signatures, which of the sets each is of, and the sets' names, sizes, shared tokens and tokens that
    are not frequent. 2: signatures of many sets of the block, with the facts of the block's pivot. 3: pairs of
    such pivots and members, with the facts of both.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        flush = TaskContext.get().partitionId() << 24
        facts, each = [], []
        held = 0

        def out():
            every = np.concatenate(each)
            owner = np.repeat(np.arange(len(each), dtype=np.uint32), [len(x) for x in each])
            known = np.array(facts, np.int64)
            # of each signature the set with the fewest odd tokens first
            best = np.empty(len(known), np.int64)
            best[np.lexsort((known[:, 0], known[:, 3]))] = np.arange(len(known))
            order = np.lexsort((best[owner], every))
            every, owner = every[order], owner[order]
            begin, size = _runs(every)
            rows = []
            many = size > MANY
            if many.any():
                inside = np.repeat(many, size)
                top = owner[begin[many]]
                hot, first = every[begin[many]], known[top]
                pairs = np.unique(np.repeat(top, size[many]).astype(np.int64) << 32 | owner[inside])
                a, b = pairs >> 32, pairs & 0xFFFFFFFF
                rows.append((flush % n, flush, 3, None, None, np.concatenate([known[a[a != b]], known[b[a != b]]], 1).tobytes()))
                slots, cut = _cuts(hot, n)
                rows += [(s, flush, 2, hot[a:b].tobytes(), None, first[a:b].tobytes()) for s, a, b in zip(slots.tolist(), cut, cut[1:], strict=False)]
                every, owner = every[~inside], owner[~inside]
            slots, cut = _cuts(every, n)
            for s, a, b in zip(slots.tolist(), cut, cut[1:], strict=False):
                used, back = np.unique(owner[a:b], return_inverse=True)
                rows.append((s, flush, 1, every[a:b].tobytes(), squeeze(back.astype(np.uint32)), known[used].tobytes()))
            return _parcels(rows)

        for batch in small(batches, 3):
            for size, name, rare, raw, classes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                tokens = _tokens(raw)
                each.append(signatures(size, tokens, rare, np.frombuffer(classes, np.uint8), level))
                facts.append((name, size, len(tokens), size - len(tokens) + rare))
                held += len(each[-1])
                if held >= FLUSH // 2:
                    yield out()
                    flush, held = flush + 1, 0
                    facts, each = [], []
        if held:
            yield out()

    return run


_FOUND = "kind int, a bigint, b bigint"


def _fits(size_a: np.ndarray, size_b: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray) -> np.ndarray:
    """Two sets can link by their sizes, and by what either shares with any set."""
    return (100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)) & ((100 + PERCENT) * np.minimum(shared_a, shared_b) >= PERCENT * (size_a + size_b))


def _meet(batches: Iterator[pa.RecordBatch]):
    """Parcels of signatures, sorted by slot -> found rows.

    Kind 0: candidate pairs a < b. 1: long lists' pivots a with their members b. 2: pivots a of blocks with their
    members b. 3: the lists' pivots b of such pivots a.
    """

    def found(kind, a, b):
        x, y = (np.minimum(a, b), np.maximum(a, b)) if kind == 0 else (a, b)
        ab = np.unique(np.stack([x, y], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ab), kind, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in ab.T)], ["kind", "a", "b"])

    for _, rows in _groups(batches, 0):
        signature, facts, many = [], [], []
        for _, _, kind, a, b, c in rows:
            if kind == 3:
                both = np.frombuffer(c, np.int64).reshape(-1, 8)
                x, y = both[:, :4], both[:, 4:]
                yield found(2, x[:, 0], y[:, 0])
                fits = _fits(x[:, 1], y[:, 1], x[:, 2], y[:, 2])
                yield found(0, x[fits, 0], y[fits, 0])
                continue
            own, known = np.frombuffer(a, np.uint64), np.frombuffer(c, np.int64).reshape(-1, 4)
            signature.append(own)
            facts.append(known[loosen(b, np.uint32)] if kind == 1 else known)
            many.append(np.full(len(own), kind == 2))
        if not signature:
            continue
        signature, facts, many = np.concatenate(signature), np.concatenate(facts), np.concatenate(many)
        # the set with the fewest odd tokens first: what many copies were made from is the pivot of their list
        order = np.lexsort((~many, facts[:, 0], facts[:, 3], signature))
        signature, facts, many = signature[order], facts[order], many[order]
        new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (facts[1:, 0] != facts[:-1, 0])])
        hot = np.isin(signature, signature[many]) if many.any() else many
        signature, (name, size, shared, _), hot, many = signature[new], facts[new].T, hot[new], many[new]
        begin, length = _runs(signature)
        member = np.repeat(length, length)
        place = np.arange(len(signature)) - np.repeat(begin, length)
        if many.any():
            i = np.flatnonzero(many)
            yield found(3, name[i], name[i - place[i]])
        pairs = []
        for step in range(1, SHORT):  # a short list's members that many places apart
            if step >= len(signature):
                break
            i = np.flatnonzero((member <= SHORT) & ~hot & (place + step < member))
            pairs.append((i, i + step))
        i = np.flatnonzero(((member > SHORT) | hot) & (place > 0))
        pairs.append((i - place[i], i))
        left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
        fits = _fits(size[left], size[right], shared[left], shared[right])
        yield found(0, name[left[fits]], name[right[fits]])
        yield found(1, name[i - place[i]], name[i])


def _verify(batches: Iterator[pa.RecordBatch]):
    """Pairs with both sets -> those that link."""
    for batch in small(batches, 4):
        keep = []
        for na, nb, ta, tb in zip(*(x.to_pylist() for x in batch.columns[2:]), strict=True):
            both = np.concatenate([_tokens(ta), _tokens(tb)])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * common >= PERCENT * (na + nb - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return joined.mapInArrow(_verify, "a bigint, b bigint")


def _found(sets: DataFrame, n: int, level: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), and the long lists' members (pivot, name), of sets."""
    signed = sets.select("n", "name", "rare", "tokens", "classes").mapInArrow(releasing(_sign(n, level)), _PARCEL)
    found = stages.write(_few(_dealt(signed, "slot", n).mapInArrow(releasing(_meet), _FOUND)))
    pairs = found.where("kind = 0").select("a", "b").distinct()
    # members of a block's pivot are members of the lists that the pivot is in
    own = found.where("kind = 2").select(F.col("a").alias("top"), F.col("b").alias("name")).distinct()
    upper = found.where("kind = 3").select(F.col("a").alias("top"), F.col("b").alias("pivot")).distinct()
    members = found.where("kind = 1").select(F.col("a").alias("pivot"), F.col("b").alias("name")).unionByName(own.join(upper, "top").where("name <> pivot").select("pivot", "name")).distinct()
    return pairs, members


def _dealt(parcels: DataFrame, key: str, n: int) -> DataFrame:
    """Parcels by key, sorted, so that a task holds one key's at a time."""
    parts = partitions(parcels.sparkSession)
    place = F.expr(f"cast({key} * {parts} div {n} as int)") if key == "slot" else F.expr(f"cast(pmod(xxhash64({key}), {parts}) as int)")
    dealt = parcels.repartitionById(parts, place)
    return dealt if key == "slot" and n == parts else dealt.sortWithinPartitions(key)  # a partition of one range needs no order


def _few(rows: DataFrame) -> DataFrame:
    """Rows in a quarter of the partitions: steps that are small beside the tokens make many small files otherwise."""
    return rows.coalesce(max(1, partitions(rows.sparkSession) // 4))


def _torn(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, name and root of the members (and the pivot) of lists that are more than one component; a set without links is its own root.

    Left out are sets that can link with none in their list: a partner has as many tokens as the list's smallest
    set, and as many as the two have in common, which is what the set shares with any other at most.
    """
    every = members.unionByName(members.select("pivot", F.col("pivot").alias("name")).distinct())
    every = every.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").select("pivot", "name", F.coalesce("root", "name").alias("root"))

    # a list may be as long as the table: what is known of it goes to each of many parts of it
    every = every.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def torn(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("pivot", parts)
        return rows.join(lists, ["pivot", "salt"], "left_semi")

    rows = torn(every).join(sets.select("name", "n", (F.octet_length("tokens") / 8).cast("bigint").alias("shared")), "name")
    rows = rows.join(rows.groupBy("pivot").agg(F.min("n").alias("least")).select("pivot", "least", parts), ["pivot", "salt"])
    able = (100 + PERCENT) * F.col("shared") >= PERCENT * (F.col("n") + F.greatest("least", "shared"))
    return torn(rows.where(able).select("pivot", "name", "root", "salt")).drop("salt")


def _across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the rows of _torn() that are in different components.

    Members outside a list's largest component are compared with all others, block by block: a group is two
    blocks of about BLOCK sets, whatever the list's size.
    """
    sizes = placed.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("pivot").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"))
    lists = lists.select("pivot", F.col("top.root").alias("main"), F.ceil(F.col("m") / BLOCK).alias("whole"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).alias("strays"))
    rows = placed.join(lists, "pivot")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("strays") - 1)
    left = rows.where("root <> main").select("name", "root", "pivot", F.pmod(F.xxhash64("name"), F.col("strays")).alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("j"), F.lit(True).alias("stray"))
    right = rows.select("name", "root", "pivot", F.explode(every).alias("i"), F.pmod(F.xxhash64("name", F.lit(1)), F.col("whole")).alias("j"), F.lit(False).alias("stray"))
    groups = left.unionByName(right).join(sets.select("name", "n", "tokens"), "name").select("pivot", "i", "j", "name", "root", "stray", "n", "tokens")
    return groups.groupBy("pivot", "i", "j").applyInArrow(_compare, "a bigint, b bigint").distinct()


def _compare(key, table):
    """Links between the strays of one block and the members of another that are in other components."""
    stray = table.column("stray").to_numpy(zero_copy_only=False)
    name, root, n = (table.column(c).to_numpy() for c in ("name", "root", "n"))
    tokens = [_tokens(x) for x in table.column("tokens").to_pylist()]
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, token, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    place = np.cumsum(stray) - 1  # a stray's line in the matrix
    other = np.cumsum(~stray) - 1
    common = np.zeros((int(stray.sum()), int((~stray).sum())), np.int32)
    # frequent tokens by products of slices, the others pair by pair
    frequent = np.flatnonzero(often >= 16)
    column = np.full(len(often), -1)
    column[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 4096):
        use = (column[token] >= at) & (column[token] < at + 4096)
        dense = np.zeros((len(tokens), min(4096, len(frequent) - at)), np.float32)
        dense[row[use], column[token[use]] - at] = 1
        common += np.rint(dense[stray] @ dense[~stray].T).astype(np.int32)
    use = (often[token] >= 2) & (often[token] < 16)
    order = np.argsort(token[use], kind="stable")
    token, row = token[use][order], row[use][order]
    for step in range(1, 16):
        if step >= len(token):
            break
        same = np.flatnonzero(token[step:] == token[:-step])
        if not len(same):
            break
        x, y = row[same], row[same + step]
        for p, q in ((x, y), (y, x)):
            k = stray[p] & ~stray[q]
            np.add.at(common, (place[p[k]], other[q[k]]), 1)
    both = n[stray][:, None] + n[~stray][None, :] - common
    alike = (100 * common >= PERCENT * both) & (root[stray][:, None] != root[~stray][None, :])
    i, j = np.nonzero(alike)
    a, b = name[stray][i], name[~stray][j]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


# ---------------------------------------------------------------- components


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """node and root, the least node of its component, for every node of links(a, b) but the roots, by large-star / small-star rounds."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stages.write(_few(small))
        if last is not None:
            stages.drop(last)
        last = edges
        # done when these are stars: each node has one edge to a lesser one, which has none
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _placed(docs: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, h (a hash of the text), n and root (null: an empty set) for every row, written."""
    spark = session(docs.sparkSession)
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id is of an integer type")
    parts = partitions(spark)
    # ranges: so many that one fits a worker, by the optimizer's estimate, which may be far too high
    n = parts * min(MOST_RANGES, max(1, -(-input_bytes(docs.select("text")) // (parts * RANGE_BYTES))))
    parcels = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _text_hash(F.col("text")).alias("h")).mapInArrow(releasing(_send(n)), _PARCEL)
    counted = _dealt(parcels, "slot", n).mapInArrow(releasing(_count), _PARCEL)
    known = stages.write(_few(_dealt(counted, "flush", n).mapInArrow(releasing(_gather), _SETS)), codec="none")
    rows = known.where("kind = 0").select("doc_id", "h", "n", "name")
    sets = stages.write(known.where("kind = 1").select("n", "name", "rare", "tokens", "classes").dropDuplicates(["name"]), codec="none")
    pairs, members = _found(sets, n, 0, stages)
    roots = components(stages.write(_links(pairs, sets)), stages)
    apart = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
    more: list[DataFrame] = []  # links between components, found by what lists are torn
    for level in range(1, LEVELS + 2):
        placed = stages.write(_few(_torn(members, roots, sets)))
        if placed.isEmpty():
            break
        if level <= LEVELS:
            some = stages.write(sets.join(placed.select("name").distinct(), "name", "left_semi"), codec="none")
            pairs, members = _found(some, n, level, stages)
            pairs = pairs.join(apart[0], "a", "left").join(apart[1], "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
            more.append(stages.write(_few(_links(pairs, some))))
            stages.drop(some)
        else:
            more.append(stages.write(_few(_across(placed, sets))))
        stages.drop(placed)
    out = rows.join(roots.select(F.col("node").alias("name"), "root"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    if any(not links.isEmpty() for links in more):
        # the components are the nodes now
        between = reduce(DataFrame.unionByName, more).join(apart[0], "a", "left").join(apart[1], "b", "left")
        joined = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), stages)
        out = out.join(joined.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").withColumn("root", F.coalesce("whole", "root"))
    out = stages.write(_few(out.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))))
    stages.drop(known, sets)
    return out


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs(doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType
    rows = _placed(docs, Stages(docs.sparkSession, "ngram-join"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # a component may hold any share of the rows: its id goes to each of many parts of them
    least = least.where("copies > 1").select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int"))
    own = F.coalesce("least", "doc_id")
    return rows.join(least, ["root", "salt"], "left").select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("n").alias("n_shingles"), own.cast(id_type).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of docs: that of least doc_id (then text hash; null ids last). Rows with an empty set all stay."""
    stages = Stages(docs.sparkSession, "representatives")
    placed = _placed(docs, stages)
    best = placed.where("root is not null").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("best"))
    empty = placed.where("root is null").select("doc_id", "h").distinct()
    kept = best.select("best.doc_id", "best.h").unionByName(empty).select(F.col("doc_id").alias("k0"), F.col("h").alias("k1"))
    again = placed.where("root is not null").groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("k0"), F.col("h").alias("k1"))
    again = stages.write(again)
    # The rows' own columns get other names meanwhile, whatever they are called.
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    doc_id, mark = F.col(f"c{names.index('doc_id')}").cast("bigint"), _text_hash(F.col(f"c{names.index('text')}"))

    def among(rows, keys, how):
        return rows.join(keys, doc_id.eqNullSafe(F.col("k0")) & (mark == F.col("k1")), how)

    rows = among(rows, kept, "left_semi")
    if not again.isEmpty():  # repeated rows: one of each
        once = among(rows, again, "left_semi").withColumn("k0", doc_id).withColumn("k1", mark).dropDuplicates(["k0", "k1"]).drop("k0", "k1")
        rows = among(rows, again, "left_anti").unionByName(once)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
