"""URL filter: prefix rules first, then a weighted vocabulary counted with one Aho-Corasick automaton.

A strict term rejects alone, soft terms only when several distinct ones occur. A term counts where no
ASCII letter or digit touches it. Null urls, and urls without ``://``, have an empty host and path, fit
no rule, and are judged by the vocabulary over the whole url (null: allowed). Urls are judged whole, however
long; repeated rows and null ids are judged like any other; an empty table gives no rows; other columns of
the input are neither read nor returned, whatever they are called.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, small

#: (verdict, host, path); the longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STRICT = ("porn", "xxx", "hentai", "camgirls", "casino", "malware", "phishing", "warez", "escorts")
SOFT = ("adult", "sex", "nude", "bet", "betting", "poker", "slots", "torrent", "crack", "keygen", "pills", "viagra", "loan", "dating")
SOFT_LIMIT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ? or #, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to the next ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def _counter(strict, soft):
    automaton = ahocorasick.Automaton()
    for kind, terms in ((0, strict), (1, soft)):
        for term in terms:
            automaton.add_word(term, (kind, term))
    automaton.make_automaton()
    edge = frozenset(_LOWER + "0123456789")

    def count(url: str | None) -> tuple[int, int]:
        """Strict hits and distinct soft terms."""
        low = (url or "").translate(str.maketrans(_UPPER, _LOWER))
        hard, mild = 0, set()
        for end, (kind, term) in automaton.iter(low):
            start = end - len(term)
            if (start >= 0 and low[start] in edge) or (end + 1 < len(low) and low[end + 1] in edge):
                continue
            if kind:
                mild.add(term)
            else:
                hard += 1
        return hard, len(mild)

    return count


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for every row of pages(page_id, url)."""

    def terms(batches):
        count = _counter(strict, soft)
        for batch in small(batches, 1):
            found = [count(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                ["page_id", "url", "n_strict", "n_soft"],
            )

    session(pages.sparkSession)
    known = pages.select("page_id", "url")
    kind = known.schema["page_id"].dataType.simpleString()
    seen = known.mapInArrow(terms, f"page_id {kind}, url string, n_strict bigint, n_soft bigint")
    seen = seen.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "n_strict", "n_soft")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return seen.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "n_strict", "n_soft")
