"""The table of pattern rules, and its extension by register_detector()."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import spans as S
from ..functions import validators as V


@dataclass(frozen=True)
class Rule:
    """Ranges of ``body`` right after ``lead`` and before ``after``; ``needs`` is a cheap pattern that occurs in every text with a match.

    ``flags`` and ``doubled`` as in spans.matches().
    """

    name: str
    label: str
    priority: int
    body: str
    lead: str = ""
    needs: str = ""
    valid: Callable[[Column], Column] | None = None
    not_after: str | None = None
    after: str = ""
    flags: str = S.FLAGS
    doubled: bool = False

    def spans(self, text: Column) -> Column:
        found = S.matches(text, self.body, self.lead, text.rlike(self.needs) if self.needs else None, after=self.after, doubled=self.doubled, flags=self.flags)
        if self.valid or self.not_after:

            def holds(s: Column) -> Column:
                ok = F.lit(True)
                if self.valid:
                    ok = ok & self.valid(S.part(text, s))
                if self.not_after:
                    ok = ok & ~S.before(text, s, X.CONTEXT_CHARS).rlike(f"{self.flags}(?i){self.not_after}")
                return ok

            found = F.filter(found, holds)
        return S.label(found, self.label, self.priority)


#: Patterns and priorities. Fixed values.
RULES: list[Rule] = [
    Rule("email", "EMAIL", 100, r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", needs="@"),
    Rule("url", "URL", 90, r"\b(?:https?://|www\.)[^\s<>\"')\];,]*[^\s<>\"')\].;,:]", needs=r"http|www\."),
    Rule("bare_url", "URL", 88, r"(?i:(?<![@\w.-])[a-z0-9-]{3,}\.(?:com|co\.in|in|org|net|io|edu|gov\.in)\b(?![\w@]))", needs=r"[A-Za-z0-9-]\.[A-Za-z]{2}"),
    Rule("cin", "ID_NUMBER", 85, r"\b[LU]\d{5}[A-Z]{2}\d{4}(?:PLC|PTC|FTC|GAP|GAT|NPL|SGC|ULT|OPC)\d{6}\b", needs=r"(?U)[LU]\d{5}[A-Z]"),
    Rule("pan", "ID_NUMBER", 85, r"\b[A-Z]{5}\d{4}[A-Z]\b", needs=r"(?U)[A-Z]{5}\d{4}[A-Z]"),
    Rule("gstin", "ID_NUMBER", 85, r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", needs=r"(?U)\d[A-Z]{5}\d{4}[A-Z]"),
    Rule("sebi", "ID_NUMBER", 85, r"\bIN[A-Z]\d{9}\b", needs=r"(?U)IN[A-Z]\d{9}"),
    Rule("registration", "ID_NUMBER", 83, r"[A-Z]{0,4}-?\d{4,9}\b", r"\b(?i:registration|membership|licen[cs]e)\s+(?i:no\.?|number)\s*[:.]?\s*", needs=r"(?U)(?i:regis|membe|licen).*\d{4}"),
    Rule("aadhaar", "AADHAAR", 84, r"(?<![\d-])[2-9]\d{3}[ -]\d{4}[ -]\d{4}(?![\d-])", needs=r"(?U)\d{4}[ -]\d{4}[ -]\d{4}", valid=V.aadhaar_ok),
    Rule("aadhaar_cue", "AADHAAR", 84, r"[2-9]\d{11}(?!\d)", r"(?i:aadhaar|aadhar|uidai?)\b[^\d\n]{0,25}?", needs=r"(?U)\d{12}", valid=V.aadhaar_ok),
    Rule("ssn", "SSN", 82, r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])", needs=r"(?U)\d{3}-\d{2}-\d{4}"),
    Rule("ssn_cue", "SSN", 82, r"\d{9}(?!\d)", r"(?i:\bssn|social\s+security)\b[^\d\n]{0,25}?", needs=r"(?U)\d{9}"),
    Rule("card", "CREDIT_CARD", 80, r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])", needs=r"(?U)(?:\d[ -]?){12}\d", valid=V.luhn_ok),
    Rule("ipv4", "IP_ADDRESS", 78, r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", needs=r"(?U)\d\.\d+\.\d+\.\d", not_after=X.VERSION_CUE),
    Rule("ipv6", "IP_ADDRESS", 78, r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])", needs=r":[0-9A-Fa-f]{1,4}:"),
    Rule("ipv6_short", "IP_ADDRESS", 77, r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])", needs="::"),
    Rule("dob", "DOB", 72, rf"(?i:{X.DATE})", r"(?i:\bd\.?o\.?b\.?|date\s*of\s*birth|\bborn(?:\s+on)?)\b[\s:.,-]*", needs=r"(?U)(?i:d\.?o\.?b|birth|born)[\s\S]*\d"),
    Rule("phone_intl", "PHONE", 60, r"(?<![\w.])\+\s?\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,4}(?!\d)", needs=r"(?U)\+\s?\d", valid=V.phone_ok),
    Rule("phone_cue", "PHONE", 59, r"\+?\(?\d[\d\s().-]{6,17}\d", rf"(?i:{X.PHONE_CUE})", needs=r"(?U)(?i:tel|phone|mob|fax|whatsapp|call|reach|contact)[\s\S]*\d", valid=V.phone_ok),
    Rule("phone_in", "PHONE", 58, r"(?<![\d.,-])(?:0|\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?![\d,]|\.\d)", needs=r"(?U)\d{5}[\s-]?\d{5}", not_after=X.ID_CUE),
    Rule(
        "phone_us", "PHONE", 57,
        r"(?<![\w.,-])(?:(?:\+?1|001)[\s.-]?)?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}[\s.-])[2-9]\d{2}[\s.-]\d{4}(?:\s?(?:x|ext\.?)\s?\d{1,6})?(?![\d-])",
        needs=r"(?U)\d{3}[\s.-]\d{4}", not_after=X.ID_CUE,
    ),
    Rule("phone_us_prefixed", "PHONE", 57, r"(?<![\w.,-])(?:\+?1|001)[\s.-][2-9]\d{2}[\s.-][2-9]\d{2}[\s.-]\d{4}(?:\s?(?:x|ext\.?)\s?\d{1,6})?(?![\d-])", needs=r"(?U)\d{3}[\s.-]\d{4}"),
]


def register_detector(name: str, label: str, body: str, priority: int, lead: str = "", needs: str = "", valid=None, not_after: str | None = None) -> Rule:
    """Adds a rule to the table; patterns are Java regexes with Unicode classes."""
    rule = Rule(name, label, priority, body, lead, needs, valid, not_after)
    RULES.append(rule)
    return rule


def rule(name: str) -> Rule:
    return next(r for r in RULES if r.name == name)


def pattern_spans(text: Column, skip: frozenset[str] = frozenset(), rules: Iterable[Rule] | None = None) -> Column:
    """Spans of all rules whose label is not skipped."""
    return F.concat(F.array().cast(S.SPAN), *(r.spans(text) for r in (RULES if rules is None else rules) if r.label not in skip))
