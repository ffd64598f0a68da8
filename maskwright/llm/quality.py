"""Quality rules: counted base rules, and a logistic regression over hashed word and character n-grams.

Features of a text are the shares of its words, word pairs and byte 4-grams (ASCII letters folded, white
space runs as they are) that fall in each of 2**16 hash buckets a kind, so that long and short texts weigh
alike. Weights are learned on labelled rows - at most ``FIT_ROWS`` of them, those of least hashed doc_id, and
of these as many as hold ``FIT_BYTES`` of text together (bounds of what reaches the driver) - and the scores turned into probabilities by Platt's method on the fifth of these rows that was held out. A
text is kept if its probability of good quality is THRESHOLD or more and no base rule failed.

Counting is vectorised over Arrow batches. Null and empty texts have no words, fail the base rule and are
not kept; labels that are null or of no document are ignored; with only one class among the labels every
text gets that class's probability; rows with equal or null doc_ids are scored like any other. Only doc_id
and text are read by score(); keep() passes all columns on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, mix, release, releasing, session, small, span_hashes, text_pieces, word_spans

#: Labelled rows used for fitting and bytes of their texts, at most; least probability of a kept text; hash bits of each kind of feature.
FIT_ROWS, FIT_BYTES, THRESHOLD, BITS = 3000, 64 << 20, 0.3, 16
KINDS, U = 3, np.uint64
#: Text bytes that are counted at once.
CHUNK = 1 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _chunks(column: pa.Array):
    yield from text_pieces(column, CHUNK)


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of each row's values."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offs[1:]] - sums[offs[:-1]]


def _repeated(row: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items occur twice or more in their row, and which equal an earlier one."""
    order = np.lexsort((keys, row))
    r, k = row[order], keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    twice[order] = either
    return twice, later


@dataclass
class Text:
    """A chunk of texts, cut into words once."""

    data: np.ndarray
    offs: np.ndarray

    def __post_init__(self):
        self.starts, self.ends, self.first = word_spans(self.data, self.offs)
        self.row = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def counts(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
        data, offs, first = self.data, self.offs, self.first
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        n_words = np.diff(first)
        word_chars = _per_row(characters[self.ends] - characters[self.starts], first)
        # lines
        cut = np.zeros(len(data) + 1, bool)
        cut[np.flatnonzero(data == 10) + 1] = True
        cut[offs] = True
        cut[len(data)] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        tail = (end > begin) & (data[end - 1] == 10) if len(begin) else np.zeros(0, bool)
        end = end - tail
        worded = np.searchsorted(self.starts, end) > np.searchsorted(self.starts, begin)
        begin, end = begin[worded], end[worded]
        line_row = np.searchsorted(offs, begin, "right") - 1
        _, later = _repeated(line_row, span_hashes(data, begin, end))
        n_dup = np.bincount(line_row[later], minlength=len(n_words)).astype(np.int64)
        # windows of five words
        words = span_hashes(data, self.starts, self.ends)
        n_repeat = np.zeros(len(n_words), np.int64)
        if len(words) >= 5:
            n = len(words) - 4
            keys = np.zeros(n, np.uint64)
            for k in range(5):
                keys += words[k : k + n] * U(2 * k + 0x9E3779B97F4A7C15)
                keys = mix(keys)
            inside = self.row[:n] == self.row[4:]
            at = np.flatnonzero(inside)
            twice, _ = _repeated(self.row[at], keys[at])
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, at[twice], 1)
            np.add.at(covered, at[twice] + 5, -1)
            n_repeat = _per_row(np.cumsum(covered[:-1]) > 0, first)
        return {"n_words": n_words.astype(np.int64), "word_chars": word_chars, "n_symbols": _per_row(SYMBOL[data], offs), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}

    def grams(self):
        """For each kind of feature: buckets, and the text of each."""
        low = LOWER[self.data]
        shift = U(64 - BITS)
        words = span_hashes(low, self.starts, self.ends)
        yield (words >> shift).astype(np.int64), self.row
        if len(words) > 1:
            same = self.row[1:] == self.row[:-1]
            pairs = mix(words[:-1] * U(3) + words[1:] * U(0x9E3779B97F4A7C15))
            yield (pairs[same] >> shift).astype(np.int64) + (1 << BITS), self.row[1:][same]
        if len(low) > 3:
            wide = low.astype(np.uint32)
            four = (wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24) * np.uint32(0x9E3779B1)
            row = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))
            same = row[:-3] == row[3:]
            yield (four[same] >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS), row[:-3][same]


@dataclass
class Model:
    """Weights of all buckets, and Platt's line."""

    weights: np.ndarray
    slope: float
    base: float

    def probability(self, text: Text) -> np.ndarray:
        n = len(text.offs) - 1
        score = np.zeros(n)
        for bucket, row in text.grams():
            total = np.bincount(row, minlength=n)
            score += np.bincount(row, weights=self.weights[bucket], minlength=n) / np.maximum(1, total)
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.base, -40, 40)))


class Shares:
    """Sparse shares of buckets, row by row; taken apart in blocks of rows, so that the driver holds little beside them."""

    def __init__(self, texts: list[str]):
        buckets, values, sizes = [], [], []
        for _, _, data, offs in text_pieces(pa.array(texts, pa.large_string()), CHUNK // 4):
            keys, shares = [], []
            for bucket, row in Text(data, offs).grams():
                total = np.bincount(row, minlength=len(offs))
                key, n = np.unique(row.astype(np.int64) << 32 | bucket, return_counts=True)
                keys.append(key)
                shares.append((n / total[key >> 32]).astype(np.float32))
            key, share = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, shares))
            order = np.argsort(key >> 32, kind="stable")
            buckets.append((key[order] & 0xFFFFFFFF).astype(np.int32))
            values.append(share[order].astype(np.float32))
            sizes.append(np.bincount(key >> 32, minlength=len(offs) - 1))
        self.bucket, self.value = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((buckets, np.int32), (values, np.float32)))
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int64)

    def blocks(self, rows: int = 256):
        """First and last row of a block, and row, bucket and value of its entries."""
        n = len(self.at) - 1
        for lo in range(0, n, rows):
            hi = min(n, lo + rows)
            part = slice(self.at[lo], self.at[hi])
            yield lo, hi, np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1])), self.bucket[part], self.value[part]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(row, weights=value * weights[bucket], minlength=hi - lo) for lo, hi, row, bucket, value in self.blocks()] or [np.zeros(0)])


def _descend(x: Shares, y: np.ndarray, weight: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Logistic regression by accelerated gradient steps scaled for each feature; the last weight is the intercept."""
    width = KINDS << BITS
    spread = np.zeros(width)
    for lo, hi, row, bucket, value in x.blocks():
        spread += np.bincount(bucket, weights=value.astype(float) ** 2 * weight[lo:hi][row], minlength=width)
    scale = 1 / np.sqrt(spread / weight.sum() + 1e-7)
    norm = 1 + max(((np.bincount(row, weights=(value * scale[bucket]) ** 2, minlength=hi - lo) * (weight[lo:hi] > 0)).max() for lo, hi, row, bucket, value in x.blocks()), default=0)
    w, v, b, vb, step = np.zeros(width), np.zeros(width), 0.0, 0.0, 4.0 / norm
    for k in range(rounds):
        look, lookb = w + k / (k + 3) * v, b + k / (k + 3) * vb
        p = 1 / (1 + np.exp(-np.clip(x.scores(scale * look) + lookb, -40, 40)))
        error = weight * (y - p) / weight.sum()
        slope = np.zeros(width)
        for lo, hi, row, bucket, value in x.blocks():
            slope += np.bincount(bucket, weights=value * error[lo:hi][row], minlength=width)
        new = look + step * (slope * scale * norm - penalty * look)
        newb = lookb + step * error.sum() * norm
        v, vb, w, b = new - w, newb - b, new, newb
    return np.append(w * scale, b)


def fit(texts: list[str], good: list[int], rounds: int = 60, penalty: float = 1e-3) -> Model:
    """Fits weights on four fifths of the rows and the probability on the last fifth."""
    y = np.array(good, float)
    none = np.zeros(KINDS << BITS)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0
        return Model(none, 0.0, 40.0 if share >= 0.5 else -40.0)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    x = Shares(texts)
    balance = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))
    balance[held] = 0
    weights = _descend(x, y, balance * len(y), rounds, penalty)
    score = x.scores(weights[:-1])
    use = held if held.any() else ~held
    # Platt: two parameters by Newton's method, with his smoothed targets
    s, t = score[use], y[use]
    target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, b = 1.0, weights[-1]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        g, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([(g * s).sum(), g.sum()]) + 1e-6 * np.array([a, 0])
        hess = np.array([[(h * s * s).sum(), (h * s).sum()], [(h * s).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return Model(weights[:-1], float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> Model:
    """A model from labels(doc_id, quality); at most so many rows, and so many bytes of their texts, reach the driver."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id"), F.col("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # documents with equal ids are rows of their own: once more no more than so many
    known = known.select("text", "quality", F.xxhash64("doc_id").alias("h"), F.octet_length("text").cast("bigint").alias("size")).orderBy("h", "size", "text").limit(rows)
    held = F.sum("size").over(Window.orderBy("h", "size", "text").rowsBetween(Window.unboundedPreceding, 0))  # over the bounded rows
    got = known.withColumn("held", held).where(F.col("held") <= most).select("text", "quality").collect()
    model = fit([r["text"] for r in got], [int(r["quality"] > 0) for r in got])
    del got
    release()
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability for every row."""
    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 3 * 2**BITS weights

    def run(batches):
        for batch in small(batches, 1):
            for i, j, counts, failed, kept, p in _judged(batch.column(1), shared.value, threshold):
                columns = [batch.column(0).slice(i, j - i), *(pa.array(c) for c in counts.values()), pa.array(failed), pa.array(kept), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *counts, "base_failed", "kept", "probability"])

    longs = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, probability double")


def _judged(column: pa.Array, model: Model, threshold: float):
    for i, j, data, offs in _chunks(column):
        text = Text(data, offs)
        counts = text.counts()
        failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        p = model.probability(text)
        yield i, j, counts, failed, ~failed & (p >= threshold), p


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score() keeps, with all their columns."""
    session(docs.sparkSession)
    at = docs.schema.fieldNames().index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small(batches, at):
            kept = [k for _, _, _, _, k, _ in _judged(batch.column(at), shared.value, threshold)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(releasing(run), docs.schema)
