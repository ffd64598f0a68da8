"""Secret scan: a trigram inverted index per batch of texts chooses which texts a rule's regex reads.

Each regex gives a Boolean query over the trigrams that every match must hold (letters folded). Postings
of just those trigrams are made for a batch, intersected and united as the query says, and only the
candidates are verified with the regex. A rule without mandatory trigrams reads every text.

Matches are leftmost and non-overlapping within a rule, over whole texts; a match that fails its rule's
check is dropped. Null and empty texts have no spans; rows with equal or null doc_ids stay as they are.
Offsets count code points, ends are exclusive. Only the key and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _parser as _re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, flat, releasing, session, small


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


def _long(group: int, least: int) -> Callable[[re.Match], bool]:
    return lambda m: m.end(group) - m.start(group) >= least


#: In listed order; spans that start alike are ordered so. Fixed values.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long(2, 8), True),
    Rule("access", r"AKIA[A-Z0-9]+", _long(0, 16), True),
    Rule("hex", r"[0-9a-f]{32,}", _long(0, 32), True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?i:authorization):\x20*(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{16,}"),
)

# ---------------------------------------------------------------- Boolean trigram queries
# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).


def _and(*qs):
    parts = frozenset(q for q in qs if q is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _or(*qs):
    parts = frozenset(qs)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _grams(s: str):
    return _and(*(s[i : i + 3] for i in range(len(s) - 2))) if len(s) >= 3 else True


class _Run:
    """What the text just before a place in the pattern can be, and what is demanded so far."""

    def __init__(self):
        self.tails, self.query = {""}, True

    def flush(self):
        self.query, self.tails = _and(self.query, _or(*map(_grams, self.tails))), {""}

    def extend(self, choices: set[str]):
        if len(self.tails) * len(choices) > 128:
            self.flush()
        if len(choices) > 128:
            return
        self.tails = {a + b for a in self.tails for b in choices}


def _exact(items) -> set[str] | None:
    """All strings that a part of a pattern matches, if they are few."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg).lower()}
        elif name == "IN":
            more = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    more.add(chr(a).lower())
                elif str(o) == "RANGE" and a[1] - a[0] < 8:
                    more |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
        elif name == "SUBPATTERN":
            more = _exact(arg[3])
        elif name == "BRANCH":
            each = [_exact(x) for x in arg[1]]
            more = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and arg[1] == 1:
            more = _exact(arg[2])
            more = more and (more | {""} if arg[0] == 0 else more)
        elif name == "AT":
            more = {""}
        else:
            return None
        if more is None or len(out) * len(more) > 128:
            return None
        out = {a + b for a in out for b in more}
    return out


def _walk(items, run: _Run) -> None:
    for op, arg in items:
        name = str(op)
        if (few := _exact([(op, arg)])) is not None:
            run.extend(few)
        elif name == "SUBPATTERN":
            _walk(arg[3], run)
        elif name == "BRANCH":
            run.flush()
            run.query = _and(run.query, _or(*(_demand(x) for x in arg[1])))
        elif name == "MAX_REPEAT" and arg[0] > 0:
            if (few := _exact(arg[2])) is not None:
                run.extend(few)
                run.flush()
            else:
                _walk(arg[2], run)
                run.flush()
        else:
            run.flush()


def _demand(items):
    run = _Run()
    _walk(items, run)
    run.flush()
    return run.query


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of a regex fulfils; True if none can be derived."""
    return _demand(_re.parse(pattern))


def _names(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_names, query[1]))


class TrigramIndex:
    """Postings (sorted row numbers) of the wanted trigrams in one batch of texts."""

    def __init__(self, wanted: list[str]):
        self.names = wanted
        self.slot = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for i, t in enumerate(wanted):
            a, b, c = t.encode()
            self.slot[a << 16 | b << 8 | c] = i + 1
        self.postings: dict[str, np.ndarray] = {}

    def load(self, data: np.ndarray, offs: np.ndarray) -> None:
        empty = np.zeros(0, np.int64)
        self.postings = dict.fromkeys(self.names, empty)
        self.rows = np.arange(len(offs) - 1)
        if len(data) < 3:
            return
        low = LOWER[data].astype(np.uint32)
        ids = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(ids)
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + 2 < offs[row + 1]
        pairs = np.unique(ids[at][inside].astype(np.int64) << 32 | row[inside])
        cut = np.searchsorted(pairs >> 32, np.arange(1, len(self.names) + 2))
        for i, t in enumerate(self.names):
            self.postings[t] = pairs[cut[i] : cut[i + 1]] & 0xFFFFFFFF

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return self.rows
        if isinstance(query, str):
            return self.postings[query]
        each = sorted((self.candidates(q) for q in query[1]), key=len)
        out = each[0]
        for x in each[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = rules
        self.regexes = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(sorted(set().union(*map(_names, self.queries))))

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Each text's spans as (start, rule number, end), sorted."""
        self.index.load(*flat(column))
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regexes, self.queries, strict=True)):
            for i in self.index.candidates(query).tolist():
                if i not in texts:
                    texts[i] = column[i].as_py() or ""
                found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if rule.keep(m)]
        for x in found:
            x.sort()
        return found


def scan_secrets(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (array of kind, start, end; by start, then rule order) for every row."""
    session(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        scanner = Scanner(rules)
        for batch in small(batches, 1):
            found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner.spans(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], [key, "spans"])

    return docs.select(key, text).mapInArrow(scan, f"{key} {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask(text: str | None, spans: list[tuple[int, int, int]], rules=RULES) -> str | None:
    """The text with each run of overlapping spans replaced by <secret:kind> of its first."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for start, k, end in spans:
        if start < at:
            if end > at:
                at = end
            continue
        out += [text[at:start], f"<secret:{rules[k].kind}>"]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, rules=RULES, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of docs, with secrets masked in the text and the length column (if there) following it."""
    session(docs.sparkSession)
    schema = docs.schema
    at, n = schema.fieldNames().index(text), schema.fieldNames().index(length) if length in schema.fieldNames() else None

    def clean(batches):
        scanner = Scanner(rules)
        for batch in small(batches, at):
            columns, spans = list(batch.columns), scanner.spans(batch.column(at))
            hit = [i for i, x in enumerate(spans) if x]
            if hit:
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i] = mask(texts[i], spans[i], rules)
                columns[at] = pa.array(texts, columns[at].type)
                if n is not None:
                    sizes = columns[n].to_pylist()
                    for i in hit:
                        sizes[i] = len(texts[i])
                    columns[n] = pa.array(sizes, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(releasing(clean), schema)


def digest(spans: DataFrame, rules=RULES, key: str = "doc_id") -> DataFrame:
    """The counts, the hash of the base spans and the joined spans of scan_secrets' rows."""
    base = [r.kind for r in rules if r.base]
    told = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base]
    return spans.select(key, *counts, F.sha2(told(of(base)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
