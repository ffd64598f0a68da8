"""Streams: redaction without state, counts by event time, and learning by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import Stages
from ..functions import spans as S
from ..operators.detect import Policy, cleaned, static_spans
from ..operators.pseudonyms import SEED, by_hash, direct
from ..operators.redact import redact, rewrite


def spans_of(text: Column, policy: Policy = Policy(mode="regex")) -> Column:
    """Resolved spans of one text, without a lexicon."""
    return S.resolve(static_spans(text, policy))


def with_replacements(text: Column, spans: Column, seed: str = SEED) -> Column:
    """Spans as edits, each fake a function of its original alone."""

    def one(s: Column) -> Column:
        value = S.part(text, s)
        fake = F.coalesce(direct(s["label"], value, seed), by_hash(s["label"], value))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), fake.alias("replacement"), s["label"].alias("label"))

    return F.transform(spans, one)


def redact_lines(rows: DataFrame, text: str = "text", policy: Policy = Policy(mode="regex"), clean: bool = True) -> DataFrame:
    """rows with redacted and labels, by projection alone: for streams, and for tables that need no learning.

    A null text stays null and has no labels. clean=False: the lines come from paragraphs() and are clean.
    """
    line = cleaned(F.col(text)) if clean else F.col(text)
    out = rows.withColumn("__t", line).withColumn("__s", spans_of(F.col("__t"), policy))
    out = out.withColumn("__e", F.when(F.size("__s") > 0, with_replacements(F.col("__t"), F.col("__s"), policy.seed)))
    out = out.withColumn("redacted", F.when(F.col("__e").isNull(), F.col("__t")).otherwise(rewrite(F.col("__t"), F.col("__e"))))
    return out.withColumn("labels", F.transform("__s", lambda s: s["label"])).drop("__t", "__s", "__e")


def label_counts(redacted: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window, label and n over event time, with late rows dropped after a watermark."""
    rows = redacted.withWatermark(ts, late).select(ts, F.explode("labels").alias("label"))
    return rows.groupBy(F.window(ts, window), "label").agg(F.count(F.lit(1)).alias("n"))


def learn_and_redact(sink, policy: Policy = Policy()):
    """A foreachBatch function: each micro-batch of documents is learned from, redacted and given to sink(rows, batch id).

    The sink writes the rows before it returns; then every step of the batch is deleted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with Stages(batch.sparkSession, "batch") as stages:
            sink(redact(batch, policy, stages=stages), batch_id)

    return run
