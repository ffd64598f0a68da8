"""Quality of detection and of fakes: matching, confusion, leaks, consistency and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import Stages
from ..functions import spans as S
from .detect import Policy, detect, with_static
from .lexicon import learn, learned_spans
from .pseudonyms import key_of

#: Labels that count as another in evaluations.
FOLD = {"LOCALITY": "ADDRESS", "AADHAAR": "ID_NUMBER"}
MARK = "array<struct<start:int,end:int,label:string>>"


def folded(label: Column) -> Column:
    out = label
    for a, b in FOLD.items():
        out = F.when(label == a, F.lit(b)).otherwise(out)
    return out


def marks(spans: str) -> Column:
    """A column of spans as marks: start, end and label, labels folded."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), folded(s["label"]).alias("label"))).cast(MARK)


def gold_spans(text: Column, items: Column) -> Column:
    """Every occurrence of each item (substring, label) in a text, nested ones dropped; by start, longer first."""

    def places(item: Column) -> Column:
        word = item["substring"]
        pieces = F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)
        ends = F.aggregate(S.let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1)), F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(p) + F.length(word))))
        return F.transform(ends, lambda e: F.struct((e - F.length(word)).alias("start"), e.alias("end"), item["label"].alias("label")))

    found = F.array_distinct(F.flatten(F.transform(F.filter(items, lambda i: i["substring"] != ""), places)))
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["end"] <= b["end"]) & (a != b)
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
    return S.let(found, lambda every: F.array_sort(F.filter(every, lambda a: ~F.exists(every, lambda b: inside(a, b) & (~same(a, b) | (b["label"] < a["label"]))))))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two ranges; 0 for empty ones."""
    inter = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    union = (a["end"] - a["start"]) + (b["end"] - b["start"]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def match(pred: Column, gold: Column, threshold: float) -> Column:
    """Labels of true positives, false positives and false negatives of one text: each prediction in order takes the best free gold span of its label."""
    state = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("tp"), F.array().cast("array<string>").alias("fp"))

    def step(a: Column, p: Column) -> Column:
        scored = F.transform(gold, lambda g, i: F.struct(F.when((g["label"] == p["label"]) & ~F.array_contains(a["used"], i), iou(p, g)).otherwise(0.0).alias("v"), (-i).alias("i")))

        def add(best: Column) -> Column:
            hit = F.coalesce((best["v"] > 0) & (best["v"] >= threshold), F.lit(False))
            right = F.struct(F.concat(a["used"], F.array(-best["i"])).alias("used"), F.concat(a["tp"], F.array(p["label"])).alias("tp"), a["fp"].alias("fp"))
            wrong = F.struct(a["used"].alias("used"), a["tp"].alias("tp"), F.concat(a["fp"], F.array(p["label"])).alias("fp"))
            return F.when(hit, right).otherwise(wrong)

        return S.let(F.array_max(scored), add)

    def with_missed(done: Column) -> Column:
        missed = F.filter(F.transform(gold, lambda g, i: F.when(~F.array_contains(done["used"], i), g["label"])), lambda x: x.isNotNull())
        return F.struct(done["tp"].alias("tp"), done["fp"].alias("fp"), missed.alias("fn"))

    return S.let(F.aggregate(F.array_sort(pred), state, step), with_missed)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, rounded to four places; 0 where undefined."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(x, 4).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))]


def scores(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """label (null: all), tp, fp, fn, precision, recall and f1 of rows(pred, gold): arrays of (start, end, label)."""
    m = Stages(rows.sparkSession, "scores").write(rows.select(match(F.col("pred"), F.col("gold"), threshold).alias("m")))
    kinds = [m.select(F.explode(f"m.{k}").alias("label"), F.lit(k).alias("kind")) for k in ("tp", "fp", "fn")]
    each = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    sums = each.rollup("label").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")))
    return sums.select("label", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def evaluate_set(texts: DataFrame, provider: DataFrame | None = None, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores and words of texts(doc_id, para_idx, text, gold) in every mode; gold: an array of start, end and label.

    Scores: mode, matching ('relaxed', overlap of one half, or 'strict'), label (null: all), tp, fp, fn, precision,
    recall, f1. Words: mode and token_confusion(). The lexicon is learned from the same texts. provider: doc_id,
    para_idx and spans of an entity model; without it there is no mode 'ner'.
    """
    stages = stages or Stages(texts.sparkSession, "evaluation")
    paras = stages.write(with_static(texts.select("doc_id", "para_idx", "text", "gold")))
    learned = {"regex": None, "hybrid": learned_spans(paras, learn(paras, stages=stages))} | ({} if provider is None else {"ner": provider})
    score, word = [], []
    for mode, more in learned.items():
        found = stages.write(detect(paras, Policy(mode=mode), more).select("text", marks("spans").alias("pred"), marks("gold").alias("gold")))
        score += [scores(found, least).select(F.lit(mode).alias("mode"), F.lit(name).alias("matching"), "*") for name, least in (("relaxed", 0.5), ("strict", 1.0))]
        word.append(token_confusion(found).select(F.lit(mode).alias("mode"), "*"))
    return reduce(DataFrame.unionByName, score), reduce(DataFrame.unionByName, word)


def pooled(scored: DataFrame, by: tuple[str, ...] = ("mode", "matching")) -> DataFrame:
    """Scores of several sets (tables of scores in a row) added up for each label."""
    sums = scored.groupBy(*by, "label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select(*by, "label", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def token_confusion(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy and the rest over the words of rows(text, pred, gold)."""
    each = rows.select("pred", "gold", F.explode(S.matches(F.col("text"), r"\S+")).alias("t"))
    touch = lambda name: F.exists(name, lambda s: (F.col("t.start") < s["end"]) & (s["start"] < F.col("t.end")))
    c = each.select(touch("pred").alias("p"), touch("gold").alias("g")).agg(
        F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"), F.count_if(~F.col("p") & F.col("g")).alias("fn"), F.count_if(~F.col("p") & ~F.col("g")).alias("tn")
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("tp", "fp", "fn", "tn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), F.round(F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(0.0), 4).alias("accuracy"))


def errors(rows: DataFrame, key: str) -> DataFrame:
    """key, kind ('FP' | 'FN'), label, text and note of what has no counterpart of its label with an overlap of one half."""
    out = []
    for kind, mine, theirs, none in (("FP", "pred", "gold", "not PII"), ("FN", "gold", "pred", "missed entirely")):
        each = rows.select(key, "text", theirs, F.explode(mine).alias("s"))
        same = F.exists(theirs, lambda o: (o["label"] == F.col("s.label")) & (iou(F.col("s"), o) >= 0.5))
        near = F.try_element_at(F.filter(theirs, lambda o: iou(F.col("s"), o) > 0), F.lit(1))["label"]
        note = F.when(near.isNull(), F.lit(none)).otherwise(F.concat(F.lit("overlaps "), near))
        out.append(each.where(~same).select(key, F.lit(kind).alias("kind"), F.col("s.label").alias("label"), S.part(F.col("text"), F.col("s")).alias("found"), note.alias("note")))
    return out[0].unionByName(out[1])


def recall_by_pool(rows: DataFrame, label: str = "PERSON") -> DataFrame:
    """pool, n and recall of gold spans (start, end, label, pool) that a prediction of the label overlaps by half."""
    each = rows.select("pred", F.explode("gold").alias("g")).where(F.col("g.label") == label)
    hit = F.exists("pred", lambda p: (p["label"] == label) & (iou(p, F.col("g")) >= 0.5))
    return each.groupBy(F.col("g.pool").alias("pool")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 4).alias("recall"))


def leaks(gold: DataFrame, redacted: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of by): gold strings (keys, substring), those still in the redacted text, and their share."""
    joined = gold.join(redacted.select(*keys, "redacted"), keys)
    n, leaked = F.count(F.lit(1)), F.count_if(F.col("redacted").contains(F.col("substring")))
    return joined.groupBy(*by).agg(n.alias("gold_spans"), leaked.alias("leaked"), F.round(F.when(n > 0, leaked / n).otherwise(0.0), 4).alias("leak_rate"))


def inconsistent(audited: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, key and n_fakes of originals that have more than one fake, case and white space apart."""
    rows = audited.select(*keys, "label", key_of(F.col("original")).alias("key"), key_of(F.col("replacement")).alias("fake"))
    return rows.groupBy(*keys, "label", "key").agg(F.countDistinct("fake").alias("n_fakes")).where("n_fakes > 1")


def format_report(audited: DataFrame) -> DataFrame:
    """label, n, kept (fakes of the right shape that differ from the original) and unchanged."""
    o, r, label = F.col("original"), F.col("replacement"), F.col("label")
    size = lambda c: F.length(F.regexp_replace(c, r"\D", ""))
    shape = (
        F.when(label == "PHONE", size(o) == size(r)).when(label == "EMAIL", r.rlike(r"(?U)^[\w.+-]+@[\w.-]+\.\w+$")).when(label == "ID_NUMBER", F.length(o) == F.length(r)).otherwise(True)
    )
    return audited.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(shape & (o != r)).alias("kept"), F.count_if(o == r).alias("unchanged"))


def stratified_sample(paras: DataFrame, cue: str, n_cued: int, n_rest: int, seed: str = "2026", least: int = 25, most: int = 700, exclude: DataFrame | None = None) -> DataFrame:
    """doc_id, para_idx, stratum and text: so many paragraphs with the cue (A) and of the rest (B), by hash order."""
    rows = paras.where(F.length("text").between(least, most))
    if exclude is not None:
        rows = rows.join(exclude.select("doc_id", "para_idx"), ["doc_id", "para_idx"], "left_anti")
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("para_idx").cast("string")), 256)
    cued = rows.where(F.col("text").rlike(cue)).orderBy(order).limit(n_cued).withColumn("stratum", F.lit("A"))
    rest = rows.where(~F.col("text").rlike(cue)).orderBy(order).limit(n_rest).withColumn("stratum", F.lit("B"))
    return cued.unionByName(rest).select("doc_id", "para_idx", "stratum", "text")
