"""Paragraphs and the detection column: all spans of a paragraph, overlaps resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hygiene
from ..functions import spans as S
from .addresses import address_spans
from .organisations import organisation_spans
from .patterns import Rule, pattern_spans

MODES = ("regex", "ner", "hybrid")


@dataclass(frozen=True)
class Policy:
    """mode: 'regex' (patterns), 'ner' (patterns and a provider's entities) or 'hybrid' (patterns and the learned lexicon).
    Skipped labels are dropped before overlaps are resolved. rules: instead of the package's table of pattern rules."""

    mode: str = "hybrid"
    skip_labels: frozenset[str] = frozenset()
    seed: str = "maskwright"
    images: bool = True
    rules: tuple[Rule, ...] | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, para_idx and text: one row for each line, cleaned; null texts give no rows."""
    lines = docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("para_idx", "text"))
    return lines.withColumn("text", cleaned(F.col("text")))


def cleaned(line: Column) -> Column:
    """A line as all operators expect it: without invisible characters and repeated blanks, and ready for span search."""
    return hygiene.clean(S.fenceable(line))


def numbered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (unique for each row of docs, whatever its key), key, para_idx and text of every line; a null text gives one null line.

    Rows keep their number only where the result is written before it is used twice.
    """
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.split(F.col(text), "\n", -1).alias("lines"))
    lines = lines.select("row", "key", F.posexplode_outer("lines").alias("para_idx", "text"))
    return lines.select("row", "key", F.coalesce("para_idx", F.lit(0)).alias("para_idx"), cleaned(F.col("text")).alias("text"))


def static_spans(text: Column, policy: Policy = Policy()) -> Column:
    """Spans that need no learning: patterns, addresses and organisations by suffix, not yet resolved."""
    skip = policy.skip_labels
    found = [pattern_spans(text, skip, policy.rules)]
    if "ADDRESS" not in skip:
        found.append(address_spans(text))
    if "ORG" not in skip and policy.mode != "ner":
        found.append(organisation_spans(text))
    return F.concat(*found)


def detect(paras: DataFrame, policy: Policy = Policy(), learned: DataFrame | None = None) -> DataFrame:
    """paras with spans; a null or blank text has none. learned: doc_id, para_idx and more spans (of a lexicon or an entity provider).

    A column ``static`` of paras (static_spans() of all labels, found before) is used instead of searching again.
    """
    if policy.mode == "ner" and learned is None:
        raise ValueError("mode 'ner' needs the spans of an entity provider")
    none = F.array().cast(S.SPAN)

    def allowed(spans: Column) -> Column:
        return F.filter(spans, lambda s: ~s["label"].isin(*policy.skip_labels)) if policy.skip_labels else spans

    if "static" in paras.columns:
        out = paras.withColumn("spans", allowed(F.col("static") if policy.mode != "ner" else F.filter("static", lambda s: s["label"] != "ORG"))).drop("static")
    else:
        blank = F.col("text").isNull() | (F.trim("text") == "")
        out = paras.withColumn("spans", F.when(blank, none).otherwise(static_spans(F.col("text"), policy)))
    if learned is not None:
        more = learned.select(F.col("doc_id").alias("__doc"), F.col("para_idx").alias("__para"), F.col("spans").alias("__more"))
        here = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("para_idx") == F.col("__para"))
        out = out.join(more, here, "left").withColumn("spans", F.concat("spans", allowed(F.coalesce("__more", none)))).drop("__doc", "__para", "__more")
    return out.withColumn("spans", S.resolve(F.col("spans")))


def with_static(paras: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """paras with ``static``: the unresolved spans of all labels that need no learning, for learning and detection alike."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return paras.withColumn("static", F.when(blank, F.array().cast(S.SPAN)).otherwise(static_spans(F.col("text"), Policy(rules=rules))))


def entities(detected: DataFrame) -> DataFrame:
    """One row for each span: doc_id, para_idx, start, end, label, priority and original."""
    # an inner explode() has a filter on its array inferred below it, which would compute all spans twice
    rows = detected.select("doc_id", "para_idx", "text", F.explode_outer("spans").alias("s")).where("s is not null")
    return rows.select("doc_id", "para_idx", "s.start", "s.end", "s.label", "s.priority", S.part(F.col("text"), F.col("s")).alias("original"))
