"""Each method against a plainer one."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, ngram_join, packing, quality, secret_scan, sharding, token_files
from maskwright.llm.common import flat


def test_trigram_queries_hold():
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex"), rule.kind
    texts = ["x PASSWORD: hunter2hunter2", "Api-Key", "apikey=" + "a" * 9, "ghp_" + "a1" * 18, "xoxb-123456789012", "-----BEGIN RSA PRIVATE KEY-----", "nothing", "tok", "en=abcdefghij"]
    got = secret_scan.Scanner().spans(pa.array(texts))
    for text, spans in zip(texts, got, strict=True):
        want = sorted((m.start(), k, m.end()) for k, (r, x) in enumerate(zip(secret_scan.RULES, secret_scan.Scanner().regexes, strict=True)) for m in x.finditer(text) if r.keep(m))
        assert spans == want


def test_minimax_capacity(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(1, 300) + str(i % 37)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = sharding.shard(frame, 5)
    keyed = frame.select(sharding.order_key(F.col("text")).alias("h"), F.expr("octet_length(text) + 8").alias("b")).groupBy("h").agg(F.sum("b").alias("bytes"))
    sizes = [int(x[1]) for x in sorted(keyed.collect())]

    def fits(capacity):
        shards, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            shards, held = (shards + 1, s) if held + s > capacity else (shards, held + s)
        return shards <= 5

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    _, capacity = sharding.cut_keys(keyed, 5)
    assert capacity == best
    sums = {}
    for x in groups.collect():
        sums[x.shard] = sums.get(x.shard, 0) + x.size
    assert max(sums.values()) <= best


def _jaccard_components(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_join_with_long_torn_lists(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(170)]
    texts = []
    for _ in range(3):  # families that share the passage, but not enough to link
        base = passage + [word() for _ in range(34)]
        for _ in range(40):
            copy = list(base)
            if r.random() < 0.6:
                copy[r.randrange(175, 200)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage[:k]) for k in range(100, 170, 7)] + [" ".join(word() for _ in range(50)) for _ in range(20)]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    got = {x.doc_id: x.component_id for x in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == _jaccard_components(texts)


def test_signatures_cover():
    """Sets that are alike enough have a signature in common on every level, whatever classes their tokens are of."""
    r = np.random.default_rng(3)
    for turn in range(600):
        n = int(r.integers(2, 40 if turn % 2 else 300))
        universe = np.unique(r.integers(1, 1 << 62, 2 * n + 50).astype(np.uint64))
        r.shuffle(universe)
        a = universe[:n]
        drop = int(r.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[drop:], universe[n : n + int(r.integers(0, n // 4 + 1))]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        top, frequent = r.choice([66, 71, 90]), r.random()
        often = {t: int(r.integers(65, top)) if r.random() < frequent else int(r.integers(2, 65)) for t in universe.tolist()}
        alone = r.random() < 0.5  # tokens of one set only have no class
        for level in range(ngram_join.LEVELS + 1):
            out = []
            for s, other in ((a, b), (b, a)):
                shared = np.intersect1d(s, other) if alone else s
                tokens = np.array(sorted(shared.tolist(), key=lambda t: (often[t], t)), np.uint64)
                classes = np.array([often[t] for t in tokens.tolist()], np.uint8)
                rare = int((classes <= ngram_join.FREQUENT).sum())
                out.append(set(ngram_join.signatures(len(s), tokens, rare, classes[rare:], level).tolist()))
            assert out[0] & out[1], (n, level)


def test_frequency_classes():
    n = np.array([2, 64, 65, 128, 129, 4096, 4097, 10**12])
    assert ngram_join.frequency_class(n).tolist() == [2, 64, 65, 65, 66, 70, 71, 98] and ngram_join._PAIRS == 70


def _check(spark, texts):
    got = {x.doc_id: x.component_id for x in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == _jaccard_components(texts)


@pytest.mark.parametrize("most", [2, 0])
def test_join_with_one_shingle_everywhere_and_hot_lists(spark, monkeypatch, most):
    """Tokens and signatures that travel apart; torn lists signed again, or compared block by block."""
    monkeypatch.setattr(ngram_join, "LEVELS", most)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    monkeypatch.setattr(ngram_join, "MANY", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    levels, across = [], []
    found, last = ngram_join._found, ngram_join._across
    monkeypatch.setattr(ngram_join, "_found", lambda sets, n, level, stages: (levels.append(level), found(sets, n, level, stages))[1])
    monkeypatch.setattr(ngram_join, "_across", lambda *a: (across.append(1), last(*a))[1])
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = "every document of this corpus holds one licence line that nobody reads"
    passage = [word() for _ in range(60)]
    texts = [f"{line} " + " ".join(word() for _ in range(r.randint(0, 40))) for _ in range(90)]
    for k in range(6):  # families of more copies than a rare token has documents, that share a passage
        base = passage + [word() for _ in range(12 + 2 * k)]
        for _ in range(70):
            copy = list(base)
            if r.random() < 0.8:
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage[:k]) for k in range(34, 60, 2)]
    texts += [line, line, " ".join(passage), " ".join(passage[:50]), "", "one two", "one two", "one  TWO"]
    r.shuffle(texts)
    _check(spark, texts)
    assert levels[:2] == [0, 1] if most else across


def test_differencing():
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.randint(1, 512) for _ in range(r.randint(1, 200))]
        where = packing.deal(sizes, 2048)
        sums = np.bincount(where, weights=sizes)
        assert sums.max() <= 2048 and len(sums) <= -(-sum(sizes) // 2048) + 1


def test_huffman_round_trip_and_optimum():
    r = np.random.default_rng(1)
    for n in (1, 2, 300, 5000):
        counts = r.zipf(1.4, n).clip(1, 10**6).astype(np.int64)
        lengths = token_files.code_lengths(counts)
        if n > 1:
            assert abs((0.5 ** lengths.astype(float)).sum() - 1) < 1e-9
            heap, total = [int(c) for c in counts], 0
            heapq.heapify(heap)
            while len(heap) > 1:
                both = heapq.heappop(heap) + heapq.heappop(heap)
                total += both
                heapq.heappush(heap, both)
            cost = int((counts * lengths).sum())
            assert cost >= total and (cost == total or lengths.max() == token_files.LIMIT)
        ids = r.integers(0, n, 1000)
        marks, payload = token_files.Coder(lengths).encode(ids)
        assert (token_files.Decoder(lengths).decode(marks, payload, 1000) == ids).all()


def test_edit_distance():
    r = random.Random(3)
    for _ in range(400):
        p, t = "".join(r.choice("abc") for _ in range(r.randint(1, 15))), "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        for anchored in (False, True):
            row, best = list(range(len(p) + 1)), (len(p), 0)
            for j, c in enumerate(t):
                new = [j + 1 if anchored else 0]
                for i, a in enumerate(p):
                    new.append(min(row[i] + (a != c), row[i + 1] + 1, new[i] + 1))
                row = new
                if row[-1] < best[0]:
                    best = (row[-1], j + 1)
            assert decontaminate.Pattern(p).best(t, anchored) == best


def test_quality_on_held_out_rows():
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "light", "morning", "the", "a", "of"]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["foo%%%", "bar***", "zzz###", "the", "qqq$$$", "a"]) for _ in range(60))
    model = quality.fit([good() for _ in range(60)] + [bad() for _ in range(60)], [1] * 60 + [0] * 60, rounds=30)
    texts = [good() for _ in range(20)] + [bad() for _ in range(20)]
    p = model.probability(quality.Text(*flat(pa.array(texts))))
    assert (p[:20] >= quality.THRESHOLD).all() and (p[20:] < quality.THRESHOLD).all()


def test_quality_counts():
    texts = ["", "a\na\na\n", "x y\r\nx y", "a b c d e a b c d e", "# & é é", " \n \n"]
    got = quality.Text(*flat(pa.array(texts))).counts()
    assert got["n_words"].tolist() == [0, 3, 4, 10, 4, 0] and got["n_dup_lines"].tolist() == [0, 2, 0, 0, 0, 0]
    assert got["n_repeat_words"].tolist() == [0, 0, 0, 10, 0, 0] and got["n_symbols"].tolist() == [0, 0, 0, 0, 2, 0] and got["word_chars"].tolist() == [0, 3, 4, 10, 4, 0]
