"""The rules, overlaps and replacements of the package once more, in DuckDB's SQL.

RE2 has no look-around, so a rule is a border that is consumed, a body, and a border after it. Each function
gives SQL text; sources are queries of (doc, para, text).
"""

from __future__ import annotations

from ..functions import fixed as X
from ..functions import hygiene as H
from ..functions import names as N
from ..functions import validators as V
from ..operators import pseudonyms as P

#: Word characters, as RE2 knows them only for ASCII.
_W = r"\pL\pN_"
_DIGITS8 = r"length(regexp_replace(value, '\D', '', 'g')) BETWEEN 8 AND 15"


def luhn(d: str) -> str:
    """A string of digits fulfils Luhn's check."""
    digit = f"CAST(substr({d}, CAST(i AS BIGINT), 1) AS INT)"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"


def verhoeff(d: str) -> str:
    """A string of 12 digits fulfils Verhoeff's check."""
    product, moved = [x for row in V._dihedral() for x in row], [x for row in V._permutations() for x in row]
    step = f"list_transform(range(0, 12), lambda i: CAST({moved}[CAST((i % 8) * 10 + CAST(substr({d}, CAST(12 - i AS BIGINT), 1) AS INT) + 1 AS BIGINT)] AS BIGINT))"
    return f"list_reduce({step}, lambda c, p: CAST({product}[c * 10 + p + 1] AS BIGINT), CAST(0 AS BIGINT)) = 0"


_PLAIN = r"regexp_replace(value, '\D', '', 'g')"
_CARD = f"length({_PLAIN}) BETWEEN 13 AND 19 AND regexp_matches({_PLAIN}, '^(?:[2-6]|1800)') AND {_PLAIN} <> repeat({_PLAIN}[1], CAST(length({_PLAIN}) AS INT)) AND {luhn(_PLAIN)}"
_SIXTEEN = r"(?:[0-9A-Fa-f]{1,4}"
_WORD_BEFORE, _WORD_AFTER = f"(^|[^{_W}])", f"($|[^{_W}])"
_US = r"[\s.-][2-9]\d{2}[\s.-]\d{4}(?:\s?(?:x|ext\.?)\s?\d{1,6})?"

#: name: border before, body, border after, condition on value (and context, the 30 characters before it).
RULES = {
    "email": (f"(^|[^{_W}.+-])", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "()", "true"),
    "url": ("()", r"""\b(?:https?://|www\.)[^\s<>"'')\];,]*[^\s<>"'')\].;,:]""", "()", "true"),
    "bare_url": (f"(^|[^@{_W}.-])", r"(?i:[a-z0-9-]{3,}\.(?:com|co\.in|in|org|net|io|edu|gov\.in))", f"($|[^{_W}@])", "true"),
    "cin": (_WORD_BEFORE, r"[LU]\d{5}[A-Z]{2}\d{4}(?:PLC|PTC|FTC|GAP|GAT|NPL|SGC|ULT|OPC)\d{6}", _WORD_AFTER, "true"),
    "pan": (_WORD_BEFORE, r"[A-Z]{5}\d{4}[A-Z]", _WORD_AFTER, "true"),
    "gstin": (_WORD_BEFORE, r"\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]", _WORD_AFTER, "true"),
    "sebi": (_WORD_BEFORE, r"IN[A-Z]\d{9}", _WORD_AFTER, "true"),
    "registration": (r"(\b(?i:registration|membership|licen[cs]e)\s+(?i:no\.?|number)\s*[:.]?\s*)", r"[A-Z]{0,4}-?\d{4,9}", _WORD_AFTER, "true"),
    "aadhaar": ("(^|[^0-9-])", r"[2-9]\d{3}[ -]\d{4}[ -]\d{4}", "($|[^0-9-])", verhoeff(_PLAIN)),
    "aadhaar_cue": (r"((?i:aadhaar|aadhar|uidai?)\b[^0-9\n]{0,25}?)", r"[2-9]\d{11}", "($|[^0-9])", verhoeff(_PLAIN)),
    "ssn": ("(^|[^0-9-])", r"\d{3}-\d{2}-\d{4}", "($|[^0-9-])", "NOT regexp_matches(value, '^(?:000|666|9)') AND value[5:6] <> '00' AND value[8:11] <> '0000'"),
    "ssn_cue": (r"((?i:\bssn|social\s+security)\b[^0-9\n]{0,25}?)", r"\d{9}", "($|[^0-9])", "true"),
    "card": ("(^|[^0-9-])", r"(?:\d[ -]?){12,18}\d", "($|[^0-9-])", _CARD),
    "ipv4": (r"(^|[^0-9.])", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)", r"($|[^0-9.]|\.$|\.[^0-9])", f"NOT regexp_matches(context, '(?i){X.VERSION_CUE}')"),
    "ipv6": (f"(^|[^{_W}:])", _SIXTEEN + r":){7}[0-9A-Fa-f]{1,4}", f"($|[^{_W}:])", "true"),
    "ipv6_short": (f"(^|[^{_W}:])", _SIXTEEN + r":){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?", f"($|[^{_W}:])", "true"),
    "dob": (r"((?i:\bd\.?o\.?b\.?|date\s*of\s*birth|\bborn(?:\s+on)?)\b[\s:.,-]*)", f"(?i:{X.DATE})", "()", "true"),
    "phone_intl": (f"(^|[^{_W}.])", r"\+\s?\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,4}", "($|[^0-9])", _DIGITS8),
    "phone_cue": (f"((?i:{X.PHONE_CUE}))", r"\+?\(?\d[\d\s().-]{6,17}\d", "()", _DIGITS8),
    "phone_in": ("(^|[^0-9.,-])", r"(?:0|\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}", r"($|[^0-9,.]|\.$|\.[^0-9])", f"NOT regexp_matches(context, '(?i){X.ID_CUE}')"),
    "phone_us": (f"(^|[^{_W}.,-])", r"(?:(?:\+?1|001)[\s.-]?)?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}[\s.-])[2-9]\d{2}[\s.-]\d{4}(?:\s?(?:x|ext\.?)\s?\d{1,6})?", "($|[^0-9-])", f"NOT regexp_matches(context, '(?i){X.ID_CUE}')"),
    "phone_us_prefixed": (f"(^|[^{_W}.,-])", r"(?:\+?1|001)[\s.-][2-9]\d{2}" + _US, "($|[^0-9-])", "true"),
}


def matches(source: str, before: str, body: str, after: str, doubled: bool = False) -> str:
    """doc, para, text, lead (all before a match), value and rest (all after it).

    A border may be shared by two matches, so white space can be doubled for the search, for bodies without any.
    """
    text = r"regexp_replace(text, '(\s)', '\1\1', 'g')" if doubled else "text"
    plain = r"regexp_replace({}, '(\s)\s', '\1', 'g')" if doubled else "{}"
    lead = plain.format("replace(array_to_string(ps[1:i - 1], ''), chr(2), '')")
    return f"""SELECT doc, para, text, lead, value, substr(text, length(lead) + length(value) + 1) AS rest FROM (
  SELECT doc, para, text, {lead} AS lead, string_split(ps[i], chr(2))[1] AS value FROM (
    SELECT doc, para, text, ps, unnest(range(2, len(ps) + 1)) AS i FROM (
      SELECT doc, para, text, string_split(regexp_replace({text}, '{before}({body}){after}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS ps FROM ({source}))))"""


def rule_spans(source: str, name: str, doubled: bool = False) -> str:
    """doc, para, start and value of a rule's matches."""
    before, body, after, holds = RULES[name]
    found = matches(source, before, body, after, doubled)
    return f"SELECT doc, para, CAST(length(lead) AS BIGINT) AS start, value FROM (SELECT *, right(lead, {X.CONTEXT_CHARS}) AS context FROM ({found})) WHERE {holds}"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


_ANCHORS = {
    "pin": ("([-–—,] |[-–—])", r"[1-9]\d{2} ?\d{3}", "($|[^0-9,]|[0-9,]$|[0-9,][^0-9])"),
    "us": ("(, [A-Z]{2} )", r"\d{5}(?:-\d{4})?", "($|[^0-9])"),
    "bare": ("([A-Za-z]{3} )", r"[1-9]\d{5}", "($|[^0-9])"),
}
_BOUNDARY = r"(?s)^.*(?:[;:\n]|\b(?:at|to|from|is)\s(\d)|\bat\s([A-Z]))"


def address_spans(source: str) -> str:
    """doc, para, start and value of addresses."""
    kinds = []
    for kind, border in _ANCHORS.items():
        city = r"regexp_extract(lead, '([A-Za-z]{3,})\s*[-–—,]?\s*$', 1)"
        named = "true" if kind == "us" else f"{city} <> '' AND NOT (upper({city}) = {city} AND length({city}) < 4)"
        kinds.append(
            f"""SELECT doc, para, CAST(length(lead) - length(chunk) AS BIGINT) AS start, chunk || value || tail AS value FROM (
  SELECT *, ltrim(regexp_replace(right(lead, {X.ADDRESS_LOOKBACK}), '{_BOUNDARY}', '\\1\\2'), '{X.ADDRESS_LEAD.replace("'", "''")}') AS chunk, regexp_extract(rest, '(?i)^{X.ADDRESS_TAIL}') AS tail FROM ({matches(source, *border)}))
WHERE len(regexp_extract_all(chunk, '[A-Za-z]{{3,}}')) >= 2 AND {named} AND regexp_matches(chunk, '[,\\d]') AND {"contains(chunk, ',')" if kind == "bare" else "true"} AND NOT regexp_matches(text, '(?i){X.STATE_LINE}')"""
        )
    line = rf"SELECT doc, para, CAST(length(regexp_extract(text, '^\s*')) AS BIGINT) AS start, rtrim(ltrim(text), ' .;') AS value FROM ({source}) WHERE regexp_matches(text, '(?i){X.STATE_LINE}')"
    return " UNION ALL ".join([*kinds, line])


_ORG = rf"\b(?:(?:{X.ORG_WORD}{X.ORG_LINK}){{1,6}}(?i:{X.LEGAL})|(?:{X.ORG_WORD}{X.ORG_LINK}){{1,5}}(?:{X.HEAD})|Bank\s+of\s+[A-Z]\w+(?:\s+[A-Z]\w+)?)".replace("'", "''")


def org_spans(source: str) -> str:
    """doc, para, start and value of organisations by suffix."""
    whole = f"SELECT * FROM ({matches(source, '()', _ORG, f'($|[^{_W}])')}) WHERE NOT (starts_with(value, 'Bank') AND ends_with(lead, 'Reserve '))"
    both = rf"(?s)^(.*?(?:{X.LEGAL}|{X.HEAD})(\s+and\s+))[A-Z]"
    cut = f"SELECT *, regexp_extract(value, '{both}', 1) AS one, regexp_extract(value, '{both}', 2) AS link FROM ({whole})"
    names = f"""SELECT doc, para, length(lead) AS start, CASE WHEN one = '' THEN value ELSE left(one, length(one) - length(link)) END AS value FROM ({cut})
UNION ALL SELECT doc, para, length(lead) + length(one) AS start, substr(value, length(one) + 1) AS value FROM ({cut}) WHERE one <> ''"""
    plain = "lower(trim(trim(w, '()&,'), '.'))"
    first = f"coalesce(list_position(list_transform(regexp_extract_all(value, '\\S+'), lambda w: {plain} IN {_in(X.TRIM)}), false), len(regexp_extract_all(value, '\\S+')))"
    clipped = f"SELECT doc, para, start + length(value) AS stop, regexp_replace(value, '^(?:\\S+\\s+){{' || ({first} - 1) || '}}', '') AS value FROM ({names})"
    return f"SELECT doc, para, CAST(stop - length(value) AS BIGINT) AS start, value FROM ({clipped}) WHERE len(regexp_extract_all(value, '\\S+')) >= 2 AND NOT regexp_matches(value, '(?i){X.PUBLIC_BODIES}')"


def resolved(source: str, rules, skip=frozenset(), doubled=frozenset(), learned: str = "") -> str:
    """doc, para, start, end, label, priority and original of all spans, overlaps resolved. rules: the package's, with labels and priorities; learned: more spans."""
    parts = [(rule_spans("SELECT * FROM lines", r.name, r.name in doubled), r.label, r.priority) for r in rules if r.label not in skip]
    parts += [(q, label, n) for q, label, n in ((address_spans("SELECT * FROM lines"), "ADDRESS", 50), (org_spans("SELECT * FROM lines"), "ORG", 40)) if label not in skip]
    every = " UNION ALL ".join(f"SELECT doc, para, start, value, '{label}' AS label, {n} AS priority FROM ({q})" for q, label, n in parts)
    every += f" UNION ALL SELECT doc, para, start, value, label, priority FROM ({learned})" if learned else ""
    return f"""WITH lines AS MATERIALIZED ({source}), every AS ({every}),
ranked AS (SELECT doc, para, list_sort(list_distinct(list({{'p': -priority, 'l': -length(value), 's': start, 'label': label, 'value': value}}))) AS r FROM every GROUP BY doc, para),
kept AS (SELECT doc, para, unnest(list_reduce(list_prepend([], list_transform(r, lambda x: [x])), lambda a, b: CASE WHEN len(list_filter(a, lambda k: k.s < b[1].s - b[1].l AND b[1].s < k.s - k.l)) > 0 THEN a ELSE list_concat(a, b) END)) AS k FROM ranked)
SELECT doc, para, CAST(k.s AS INT) AS start, CAST(k.s - k.l AS INT) AS "end", k.label AS label, CAST(-k.p AS INT) AS priority, k.value AS original FROM kept"""


# ---------------------------------------------------------------- replacements


def draw(kind: str, key: str, turn: int | str = 0) -> str:
    return f"CAST('0x' || substr(sha256('{P.SEED}|{kind}|' || {key} || '|{turn}'), 1, 15) AS BIGINT)"


def between(kind: str, key: str, lo: int, hi: int, turn: int = 0) -> str:
    return f"CAST({lo} + {draw(kind, key, turn)} % {hi - lo + 1} AS VARCHAR)"


def pick(kind: str, key: str, pool, turn: int = 0) -> str:
    return f"{list(pool)}[{draw(kind, key, turn)} % {len(pool)} + 1]"


def stream(kind: str, key: str, parts: int = 2) -> str:
    return "(" + " || ".join(f"lpad(CAST({draw(kind, key, 100 + i)} % 1000000000000000 AS VARCHAR), 15, '0')" for i in range(parts)) + ")"


def fill(template: str, number: str) -> str:
    """The template with its digits replaced in order."""
    return f"array_to_string(list_transform(range(1, length({template}) + 1), lambda i: CASE WHEN regexp_matches({template}[i], '[0-9]') THEN {number}[length(regexp_replace({template}[1:i], '[^0-9]', '', 'g'))] ELSE {template}[i] END), '')"


def _dob(v: str) -> str:
    days = f"CAST((200 + {draw('dob', v)} % 2301) * (1 - 2 * ({draw('dob', v, 1)} % 2)) AS INT)"
    names = "|".join(X.MONTH_NAMES)
    month = lambda m: f"list_position({[n[:3].lower() for n in X.MONTH_NAMES]}, lower({m}[1:3]))"
    moved = lambda y, m, d: f"(TRY_CAST({y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE) + {days})"
    at = lambda rx, i: f"regexp_extract({v}, '{rx}', {i})"
    iso = f"strftime({moved(f'{v}[1:4]', f'{v}[6:7]', f'{v}[9:10]')}, '%Y-%m-%d')"
    number = r"^(\d{2})/(\d{2})/(\d{4})$"
    swap = f"(CAST({at(number, 1)} AS INT) <= 12 AND CAST({at(number, 2)} AS INT) > 12)"
    day, mon = f"CASE WHEN {swap} THEN {at(number, 2)} ELSE {at(number, 1)} END", f"CASE WHEN {swap} THEN {at(number, 1)} ELSE {at(number, 2)} END"
    date = moved(at(number, 3), f"({mon})", f"({day})")
    numeric = f"CASE WHEN {swap} THEN strftime({date}, '%m/%d/%Y') ELSE strftime({date}, '%d/%m/%Y') END"
    named = lambda d, old: f"CASE WHEN length({old}) > 3 THEN split_part('{names}', '|', CAST(month({d}) AS INT)) ELSE substr(split_part('{names}', '|', CAST(month({d}) AS INT)), 1, 3) END"
    worded = r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$"
    date1 = moved(at(worded, 3), month(at(worded, 2)), at(worded, 1))
    lead = r"^([A-Za-z]+) (\d{1,2}), (\d{4})$"
    date2 = moved(at(lead, 3), month(at(lead, 1)), at(lead, 2))
    return f"""CASE WHEN regexp_matches({v}, '^\\d{{4}}-') THEN {iso} WHEN regexp_matches({v}, '{number}') THEN {numeric}
WHEN regexp_matches({v}, '{worded}') THEN CAST(day({date1}) AS VARCHAR) || ' ' || {named(date1, at(worded, 2))} || ' ' || CAST(year({date1}) AS VARCHAR)
WHEN regexp_matches({v}, '{lead}') THEN {named(date2, at(lead, 1))} || ' ' || CAST(day({date2}) AS VARCHAR) || ', ' || CAST(year({date2}) AS VARCHAR) END"""


def _id_number(v: str) -> str:
    letter = lambda k, t: pick("id", k, X.LETTERS, t)
    pan = lambda k: f"{letter(k, 1)} || {letter(k, 2)} || {letter(k, 3)} || {k}[4:5] || {between('id', k, 1000, 9999, 4)} || {letter(k, 5)}"
    cin = f"{v}[1:1] || {between('id', v, 10000, 99999, 1)} || {pick('id', v, X.STATE_CODES, 2)} || {between('id', v, 1975, 2018, 3)} || {v}[13:15] || {between('id', v, 100000, 999999, 4)}"
    gst = f"lpad({between('id', v, 1, 37, 6)}, 2, '0') || {pan(f'{v}[3:12]')} || '1Z' || {letter(v, 7)}"
    nibble = f"CAST('0x' || substr(sha256('{P.SEED}|id|' || {v}), CAST(((i - 1) % 32) * 2 + 1 AS BIGINT), 2) AS INT)"
    each = f"CASE WHEN regexp_matches({v}[i], '[0-9]') THEN CAST({nibble} % 10 AS VARCHAR) WHEN regexp_matches({v}[i], '\\pL') THEN {list(X.LETTERS)}[{nibble} % {len(X.LETTERS)} + 1] ELSE {v}[i] END"
    return f"""CASE WHEN regexp_matches({v}, '^[LU]\\d{{5}}[A-Z]{{2}}\\d{{4}}[A-Z]{{3}}\\d{{6}}$') THEN {cin} WHEN regexp_matches({v}, '^[A-Z]{{5}}\\d{{4}}[A-Z]$') THEN {pan(v)}
WHEN regexp_matches({v}, '^\\d{{2}}[A-Z]{{5}}\\d{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]$') THEN {gst} ELSE array_to_string(list_transform(range(1, length({v}) + 1), lambda i: {each}), '') END"""


def _address(v: str, k: str) -> str:
    states = X.STATES.split("|")
    others = f"list_filter({states}, lambda x: x <> trim(regexp_replace({v}, ',?\\s*India\\s*$', '')))"
    state = f"{others}[{draw('state', k)} % len({others}) + 1]"
    dash, blank = rf"regexp_extract({v}, '([-–—,])\s*\d{{3}} ?\d{{3}}', 1)", rf"regexp_extract({v}, '\d{{3}}( ?)\d{{3}}(?:\D|$)', 1)"
    body = f"{between('house', k, 1, 240)} || ', ' || {pick('street', k, N.STREETS)} || ', ' || {pick('town', k, N.TOWNS)}"
    number = f"{between('pin', k, 100, 999)} || {blank} || {between('pin', k, 100, 999, 1)}"
    tail = f"CASE WHEN contains({v}, 'India') THEN ', ' || {state} || ', India' WHEN regexp_matches({v}, '{X.STATES}') THEN ', ' || {state} ELSE '' END"
    return f"""CASE WHEN regexp_matches({v}, '^\\s*[A-Za-z ]+(?:,\\s*India)?\\s*$') THEN {state} || CASE WHEN contains({v}, 'India') THEN ', India' ELSE '' END
ELSE {body} || ' ' || CASE WHEN {dash} <> '' THEN {dash} ELSE '-' END || ' ' || {number} || {tail} END"""


def direct(v: str) -> str:
    """The fake of a value (column v) by its label, for labels that need no token map."""
    k = f"regexp_replace(lower(trim({v})), '\\s+', ' ', 'g')"
    d = f"regexp_replace({v}, '\\D', '', 'g')"
    ip = f"CASE WHEN contains({v}, ':') THEN '2001:db8::' || printf('%x', 1 + {draw('ip', k, 2)} % 65535) ELSE {pick('ip', k, X.DOCUMENTATION_BLOCKS)} || '.' || {between('ip', k, 1, 254, 1)} END"
    ssn = fill(v, f"({between('ssn', k, 900, 999)} || {between('ssn', k, 10, 99, 1)} || {between('ssn', k, 1000, 9999, 2)})")
    aadhaar = fill(v, f"('1' || substr({stream('aadhaar', d, 1)}, 1, 11))")
    body = f"({d}[1:1] || substr({stream('card', d)}, 1, length({d}) - 2))"
    card = fill(v, f"list_filter(list_transform(range(0, 10), lambda c: {body} || CAST(c AS VARCHAR)), lambda f: {luhn('f')})[1]")
    code = f"CASE WHEN NOT (starts_with(ltrim({v}), '+') OR (starts_with({d}, '91') AND length({d}) = 12)) THEN 0 WHEN {d}[1:3] IN {_in(X.COUNTRY_CODES_3)} THEN 3 WHEN regexp_matches({d}, '^[17]') THEN 1 ELSE 2 END"
    kept = f"left({d}, {code})"
    phone = fill(v, f"({kept} || CASE WHEN {kept} IN ('', '91') AND length({d}) - ({code}) = 10 THEN {between('phone', d, 6, 9)} ELSE {between('phone', d, 1, 9, 1)} END || {stream('phone', d)})")
    of = {"IP_ADDRESS": ip, "SSN": ssn, "AADHAAR": aadhaar, "CREDIT_CARD": card, "PHONE": phone, "ID_NUMBER": _id_number(v), "DOB": _dob(v), "ADDRESS": _address(v, k)}
    made = "CASE label " + " ".join(f"WHEN '{label}' THEN {q}" for label, q in of.items()) + " END"
    return made


_BRAND = "CASE WHEN len(h) >= 3 AND h[-2] IN ('co', 'gov', 'ac') THEN h[-3] WHEN len(h) >= 2 THEN h[-2] ELSE coalesce(h[1], '') END"
_HOST = "string_split(lower(CASE WHEN label = 'EMAIL' THEN split_part(original, '@', -1) ELSE regexp_extract(original, '(?is)^(?:https?://)?(?:www\\.)?([^/\\s?#]+)', 1) END), '.')"


def coined(k: str, turn: int) -> str:
    h = draw("coin", k, turn)
    return f"{list(N.ONSETS)}[{h} % {len(N.ONSETS)} + 1] || {list(N.ENDINGS)}[({h} // {len(N.ONSETS)}) % {len(N.ENDINGS)} + 1]"


def forbidden(lines: str) -> str:
    """doc and token: real words of a document's lexicon, which no fake may be."""
    return f"SELECT DISTINCT doc, unnest(phrase) AS token FROM ({person_phrases(lines)}) UNION {org_core(lines)}"


def audited(found: str, mapped: bool = True, real: str = "") -> str:
    """The rows of found (doc, para, start, end, label, original) with their replacement.

    mapped: names by the document's token map, else by their own hash; real: doc and token of words that are no fakes.
    """
    draws = [f"CASE WHEN kind = 'first' THEN {pick('first', 'token', N.FIRST, t)} ELSE {pick('last', 'token', N.LAST, t)} END" if t < 3 else coined("token", t) for t in range(P.DRAWS)]
    wants = " UNION ALL ".join(f"SELECT doc, token, {t} AS turn, {q} AS fake FROM todo" for t, q in enumerate(draws))
    word = "\\pL(?:\\pL|[''’-])*\\.?"
    mark = lambda text, rx: f"string_split(regexp_replace({text}, '({rx})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
    common = f"norm IN {_in(X.DESCRIPTORS | X.TRIM)} OR length(norm) < 2 OR regexp_matches(norm, '^[ivxlc]{{1,4}}$')"
    case = "CASE WHEN upper(t) = t AND lower(t) <> t AND length(t) > 1 THEN upper({f}) WHEN lower(t) = t AND upper(t) <> t THEN lower({f}) ELSE {f} END"
    unique = f"upper('x') || translate(substr(sha256('{P.SEED}|' || token), 1, 9), '0123456789', 'ghijklmnop')"
    fake = lambda of: f"coalesce((SELECT m.fake FROM mapped m WHERE m.doc IS NOT DISTINCT FROM p.doc AND m.token = {of}), {coined(of, 0)})" if mapped else coined(of, 0)
    return f"""WITH found AS MATERIALIZED ({found}), vals AS MATERIALIZED (SELECT DISTINCT doc, label, original FROM found),
pieces AS (SELECT doc, label, original, CASE WHEN label = 'EMAIL' THEN {mark("split_part(original, '@', 1)", "[A-Za-z]+")} ELSE {mark("original", word)} END AS ps FROM vals WHERE label IN ('PERSON', 'ORG', 'LOCALITY', 'EMAIL')),
parts AS (SELECT *, lower(trim(t, '.')) AS norm FROM (SELECT doc, label, original, i, len(ps) AS n, ps[1] AS lead, string_split(ps[i], chr(2))[1] AS t, string_split(ps[i], chr(2))[2] AS gap FROM (SELECT *, unnest(range(2, len(ps) + 1)) AS i FROM pieces))),
marked AS MATERIALIZED (SELECT *, CASE WHEN label = 'EMAIL' THEN norm NOT IN {_in(X.ROLE_MAILBOXES)} WHEN label = 'PERSON' THEN NOT regexp_matches(t, '^[A-Z]\\.$')
  ELSE NOT ({common}) OR (i = 2 AND bool_and({common}) OVER (PARTITION BY doc, label, original)) END AS own FROM parts),
hosts AS MATERIALIZED (SELECT doc, label, original, {_BRAND} AS brand FROM (SELECT *, {_HOST} AS h FROM vals WHERE label IN ('EMAIL', 'URL'))),
tokens AS (SELECT doc, norm AS token, CASE WHEN label = 'EMAIL' OR (label = 'PERSON' AND (i < n OR n = 2)) THEN 'first' ELSE 'surname' END AS kind, label <> 'EMAIL' AS core FROM marked WHERE own OR (label IN ('ORG', 'LOCALITY') AND i = 2)
  UNION ALL SELECT doc, brand, 'surname', false FROM hosts),
todo AS MATERIALIZED (SELECT doc, token, max(kind) AS kind FROM tokens WHERE token <> '' GROUP BY doc, token), wants AS ({wants}),
real AS MATERIALIZED (SELECT doc, token FROM todo{f" UNION SELECT doc, token FROM ({real})" if real else ""}),
free AS (SELECT * FROM wants w WHERE NOT EXISTS (SELECT 1 FROM real r WHERE r.doc IS NOT DISTINCT FROM w.doc AND r.token = lower(w.fake))),
owner AS (SELECT doc, min({{'turn': turn, 'h': {draw("owner", "token")}, 'token': token, 'fake': fake}}) AS o FROM free GROUP BY doc, lower(fake)),
won AS (SELECT doc, o.token AS token, arg_min(o.fake, o.turn) AS fake FROM owner GROUP BY doc, o.token),
mapped AS MATERIALIZED (SELECT t.doc, t.token, coalesce(w.fake, {unique.replace("token", "t.token")}) AS fake FROM todo t LEFT JOIN won w ON w.doc IS NOT DISTINCT FROM t.doc AND w.token = t.token),
begins AS (SELECT p.doc, p.word, coalesce(max_by(c.token, length(c.token)), p.word) AS b FROM (SELECT doc, norm AS word FROM marked WHERE label = 'EMAIL' UNION SELECT doc, brand FROM hosts) p
  LEFT JOIN (SELECT DISTINCT doc, token FROM tokens WHERE core) c ON {"c.doc IS NOT DISTINCT FROM p.doc" if mapped else "false"} AND length(c.token) >= 3 AND starts_with(p.word, c.token) GROUP BY p.doc, p.word),
branded AS MATERIALIZED (SELECT p.doc, p.word, lower({fake("p.b")} || substr(p.word, length(p.b) + 1)) AS fake FROM begins p),
named AS (SELECT p.doc, p.label, p.original, any_value(p.lead) || string_agg(CASE WHEN p.label = 'EMAIL' AND own THEN b.fake WHEN own THEN {case.format(f=fake("p.norm")).replace("(t)", "(trim(t, '.'))").replace(" t ", " trim(t, '.') ")}
    WHEN p.label = 'PERSON' THEN {pick("initial", "t", X.INITIALS)} || '.' ELSE t END || gap, '' ORDER BY i) AS fake
  FROM marked p LEFT JOIN branded b ON p.label = 'EMAIL' AND b.doc IS NOT DISTINCT FROM p.doc AND b.word = p.norm GROUP BY p.doc, p.label, p.original),
whole AS (SELECT v.doc, v.label, v.original, CASE WHEN v.label = 'EMAIL' THEN coalesce(n.fake, split_part(v.original, '@', 1)) || '@' || b.fake || '.example.com'
    WHEN v.label = 'URL' THEN regexp_extract(v.original, '(?is)^(https?://)?(www\\.)?', 0) || b.fake || '.example.com' || regexp_replace(regexp_extract(v.original, '(?is)^(?:https?://)?(?:www\\.)?[^/\\s?#]+(.*)$', 1), '(?s)\\?.*', '') ELSE n.fake END AS fake
  FROM vals v LEFT JOIN hosts h USING (doc, label, original) LEFT JOIN branded b ON b.doc IS NOT DISTINCT FROM v.doc AND b.word = h.brand LEFT JOIN named n ON n.doc IS NOT DISTINCT FROM v.doc AND n.label = v.label AND n.original = v.original)
SELECT f.doc, f.para, f.start, f."end", f.label, f.original, CASE WHEN f.label IN ('PERSON', 'ORG', 'LOCALITY', 'EMAIL', 'URL') THEN w.fake ELSE f.made END AS replacement
FROM (SELECT *, CASE WHEN fake = original THEN translate(fake, '0123456789', '1234567890') ELSE fake END AS made FROM (SELECT *, {direct("original")} AS fake FROM found)) f
LEFT JOIN whole w ON w.doc IS NOT DISTINCT FROM f.doc AND w.label = f.label AND w.original = f.original"""


def redacted(lines: str, audit: str) -> str:
    """doc, para, text and redacted of lines (doc, para, text), by an audit's replacements."""
    return f"""SELECT l.doc, l.para, l.text, coalesce(r.head || substr(l.text, r.last + 1), l.text) AS redacted FROM ({lines}) l LEFT JOIN (
  SELECT doc, para, string_agg(substr(text, past + 1, start - past) || replacement, '' ORDER BY start) AS head, max("end") AS last FROM (
    SELECT a.*, t.text, coalesce(lag(a."end") OVER (PARTITION BY a.doc, a.para ORDER BY a.start), 0) AS past FROM ({audit}) a JOIN ({lines}) t ON t.doc = a.doc AND t.para = a.para) GROUP BY doc, para) r
ON r.doc = l.doc AND r.para = l.para"""


CLEAN = f"regexp_replace(translate({{}}, '{H.NBSP}{H.INVISIBLE}', '  '), ' {{{{2,}}}}', ' ', 'g')"


def lines_of(source: str) -> str:
    """doc, para and text of the cleaned lines of a source of (doc, text)."""
    return f"SELECT doc, CAST(i - 1 AS INT) AS para, {CLEAN.format('ls[i]')} AS text FROM (SELECT doc, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc, string_split(text, chr(10)) AS ls FROM ({source}) WHERE text IS NOT NULL))"


# ---------------------------------------------------------------- learning

_NAME_WORD = "\\pL(?:\\pL|[''’-])*\\.?"
_NO_NAME = X.PERSON_STOP | X.TRIM | X.DESCRIPTORS


def vocabulary(lines: str) -> str:
    """doc and token: words in lower case outside mail and web addresses."""
    border = f"[^{_W}\\pM]"
    return f"SELECT DISTINCT doc, unnest(regexp_extract_all(regexp_replace(text, '{X.NON_PROSE}', ' ', 'g'), '(?:^|{border})([a-z]{{3,}})(?:$|{border})', 1)) AS token FROM (SELECT doc, regexp_replace(text, '\\s', '  ', 'g') AS text FROM ({lines}))"


def words(lines: str, pattern: str = _NAME_WORD) -> str:
    """doc, para, text, pos, start, end, token, norm, gap and lead of the words of lines."""
    return f"""SELECT doc, para, text, lead, pos, start, "end", token, lower(trim(token, '.')) AS norm, text[coalesce(lag("end") OVER w, 0) + 1:start] AS gap FROM (
SELECT *, row_number() OVER (PARTITION BY doc, para ORDER BY length(lead)) - 1 AS pos, length(lead) AS start, length(lead) + length(value) AS "end", value AS token FROM ({matches(lines, "()", pattern, "()")})) WINDOW w AS (PARTITION BY doc, para ORDER BY pos)"""


_CAPS = "length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.7 * length(regexp_replace(text, '[^\\pL]', '', 'g'))"
_GOOD = f"length(norm) >= 2 AND regexp_matches(token, '^\\p{{Lu}}') AND (NOT (upper(token) = token AND lower(token) <> token) OR {_CAPS}) AND norm NOT IN {_in(_NO_NAME)} AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.doc = w.doc AND v.token = w.norm)"


def candidate_runs(lines: str) -> str:
    """doc, para, start, end and phrase of runs of name-like words."""
    known = _in(N.GAZETTEER)
    return f"""WITH vocab AS MATERIALIZED ({vocabulary(lines)}),
rows_ AS (SELECT *, regexp_matches(token, '^[A-Z]\\.$') AS initial, {_GOOD} AND NOT (regexp_matches(rtrim(lead), '(?:^|[.!?])$') AND norm NOT IN {known}) AS good FROM ({words(lines)}) w WHERE regexp_matches(token, '^\\p{{Lu}}')),
kept AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND regexp_matches(gap, '^\\s*$') THEN 0 ELSE 1 END AS new FROM rows_ WHERE good OR initial WINDOW w AS (PARTITION BY doc, para ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc, para ORDER BY pos) AS run FROM kept),
bounds AS (SELECT *, min(CASE WHEN NOT initial THEN pos END) OVER r AS fp, max(CASE WHEN NOT initial THEN pos END) OVER r AS lp FROM runs WINDOW r AS (PARTITION BY doc, para, run))
SELECT doc, para, CAST(min(start) AS INT) AS start, CAST(max("end") AS INT) AS "end", list(norm ORDER BY pos) FILTER (WHERE pos <= lp) AS phrase FROM bounds WHERE pos >= fp GROUP BY doc, para, run
HAVING count(*) FILTER (WHERE pos <= lp) BETWEEN 2 AND 4 AND bool_or(norm IN {known} OR initial) FILTER (WHERE pos <= lp) AND count(*) FILTER (WHERE pos <= lp AND length(norm) >= 3) >= 2"""


def _usable(ranges: str, lines: str) -> str:
    """Ranges (doc, para, start, end, phrase) that overlap no organisation and stand before no street or place word."""
    return f"""SELECT r.doc, r.para, r.phrase FROM ({ranges}) r JOIN ({lines}) l ON l.doc = r.doc AND l.para = r.para WHERE NOT regexp_matches(substr(l.text, r."end" + 1), '{X.PLACE_SUFFIX}')
AND NOT EXISTS (SELECT 1 FROM ({org_spans(lines)}) o WHERE o.doc = r.doc AND o.para = r.para AND o.start < r."end" AND r.start < o.start + length(o.value))"""


def person_phrases(lines: str) -> str:
    """doc, phrase and n, the number of lines in which a name stands."""
    lead, name = f"({X.CONTEXT_LEAD})".replace("'", "''"), "[A-Z][A-Za-z]+(?:[ -][A-Z][A-Za-z]+){1,2}"
    split = lambda text: f"list_transform(regexp_split_to_array({text}, '\\s+'), lambda x: lower(trim(x, '.')))"
    title = matches(lines, f"({X.TITLE})", X.TITLED_NAME.replace("'", "''"), "()")
    cued = f"""SELECT doc, para, s AS start, e AS "end", list(norm ORDER BY pos) AS phrase FROM (
  SELECT w.*, w.doc AS d, c.s, c.e, {_GOOD.replace("text", "w.text").replace("w.w.text", "w.text")} AS good FROM (SELECT doc, para, length(lead) AS s, length(lead) + length(value) AS e FROM ({matches(lines, lead, name, "()")})) c JOIN ({words(lines)}) w ON w.doc = c.doc AND w.para = c.para AND w.start >= c.s AND w."end" <= c.e)
GROUP BY doc, para, s, e HAVING bool_and(good) AND count(*) BETWEEN 2 AND 3"""
    return f"""WITH vocab AS MATERIALIZED ({vocabulary(lines)}), every AS ({_usable(candidate_runs(lines), lines)} UNION SELECT doc, para, {split("value")} FROM ({title}) UNION {_usable(cued, lines)})
SELECT doc, phrase, count(*) AS n FROM every GROUP BY doc, phrase"""


def org_core(lines: str) -> str:
    """doc and token: the distinctive words of organisations' names."""
    named = f"SELECT doc, unnest(list_transform(regexp_extract_all(value, '{_NAME_WORD}'), lambda x: lower(trim(x, '.')))) AS token FROM ({org_spans(lines)})"
    return f"""SELECT DISTINCT doc, token FROM ({named}) t WHERE length(token) >= 3 AND token NOT IN {_in(X.DESCRIPTORS | X.TRIM)} AND NOT regexp_matches(token, '^[ivxlc]{{1,4}}$')
AND NOT EXISTS (SELECT 1 FROM ({vocabulary(lines)}) v WHERE v.doc = t.doc AND v.token = t.token)"""


def localities(lines: str) -> str:
    """doc and token: capitalised words of addresses that are nothing else known."""
    skip = _NO_NAME | X.CITIES | {s.lower() for s in X.STATES.split("|")} | N.GAZETTEER
    found = f"SELECT doc, lower(unnest(regexp_extract_all(value, '[A-Z][A-Za-z]{{4,}}'))) AS token FROM ({address_spans(lines)})"
    return f"""SELECT DISTINCT doc, token FROM ({found}) t WHERE token NOT IN {_in(skip)} AND NOT EXISTS (SELECT 1 FROM ({vocabulary(lines)}) v WHERE v.doc = t.doc AND v.token = t.token)
AND NOT EXISTS (SELECT 1 FROM ({org_core(lines)}) c WHERE c.doc = t.doc AND c.token = t.token)"""


def _token_runs(words_: str, tokens: str) -> str:
    """For each listed word, the run of listed words that begins with it: doc, para, s, r (0) and e."""
    return f"""SELECT doc, para, start AS s, 0 AS r, max("end") OVER (PARTITION BY doc, para, run) AS e FROM (
  SELECT *, sum(new) OVER (PARTITION BY doc, para ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY doc, para ORDER BY pos) = pos - 1 AND regexp_matches(gap, '^[ \\t]+$') THEN 0 ELSE 1 END AS new
    FROM ({words_}) w WHERE EXISTS (SELECT 1 FROM ({tokens}) t WHERE t.doc = w.doc AND t.token = w.norm)))"""


def _leftmost(hits: str) -> str:
    """Of each line's hits (s, r, e) the leftmost, of least r, then those right of it: doc, para, s and e."""
    kept = "list_reduce(list_prepend([], list_transform(hs, lambda x: [x])), lambda a, b: CASE WHEN len(a) = 0 OR a[-1].e <= b[1].s THEN list_concat(a, b) ELSE a END)"
    return f"SELECT doc, para, k.s AS s, k.e AS e FROM (SELECT doc, para, unnest({kept}) AS k FROM (SELECT doc, para, list_sort(list({{'s': s, 'r': r, 'e': e}})) AS hs FROM ({hits}) GROUP BY doc, para))"


def learned_spans(lines: str) -> str:
    """doc, para, start, value, label and priority of people, brands and localities that a document's lexicon finds; lines is a table."""
    letters = words(lines, "\\pL+")
    ahead = lambda k: f"lead(norm, {k}) OVER g AS n{k}, lead(gap, {k}) OVER g AS g{k}, lead(\"end\", {k}) OVER g AS e{k}"
    blank = lambda last, gap: f"CASE WHEN length({last}) = 1 THEN regexp_matches({gap}, '^\\.?[ \\t]+$') ELSE regexp_matches({gap}, '^[ \\t]+$') END"
    linked, gram, grams, last = "true", "norm", [], "norm"
    for k, end in enumerate(('"end"', "e1", "e2", "e3")):
        if k:
            linked, gram, last = f"{linked} AND {blank(last, f'g{k}')}", f"{gram} || ' ' || n{k}", f"n{k}"
        grams.append(f"SELECT doc, para, start AS s, {end} AS e, {gram} AS gram FROM ahead WHERE {linked}")
    good = f"after <> '' AND length(norm) >= 2 AND regexp_matches(after, '^\\p{{Lu}}') AND (NOT (upper(after) = after AND lower(after) <> after) OR (upper(after) = after AND upper(span) = span)) AND norm NOT IN {_in(_NO_NAME)} AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.doc = x.doc AND v.token = x.norm)"
    follow = X.NEXT_WORD.replace("'", "''").replace("\\-", "-")
    business = f"norm IN {_in(X.DESCRIPTORS - {'&', 'and', 'of', 'the'})} OR regexp_matches(token, '^(?:(?i:[IVXLC]{{1,4}})|\\d+)$')"
    title = matches(lines, f"({X.TITLE})", X.TITLED_NAME.replace("'", "''"), "()")
    hinted = f"SELECT * FROM ({lines}) WHERE regexp_matches(text, '{X.ADDRESS_HINT}')"
    return f"""WITH vocab AS MATERIALIZED ({vocabulary(lines)}), phrases AS MATERIALIZED ({person_phrases(lines)}), core AS MATERIALIZED ({org_core(lines)}),
people AS MATERIALIZED (SELECT doc, token FROM (SELECT doc, unnest(list_distinct(phrase)) AS token FROM phrases) WHERE length(token) >= 3 GROUP BY doc, token HAVING count(*) >= 2 OR (token IN {_in(N.GAZETTEER)} AND length(token) >= 4)),
letters AS MATERIALIZED ({letters}), ahead AS (SELECT *, {", ".join(ahead(k) for k in (1, 2, 3))} FROM letters WINDOW g AS (PARTITION BY doc, para ORDER BY pos)),
hits AS (SELECT g.doc, g.para, g.s, -length(array_to_string(p.phrase, '')) AS r, g.e FROM ({" UNION ALL ".join(grams)}) g JOIN phrases p ON p.doc = g.doc AND array_to_string(p.phrase, ' ') = g.gram
  UNION ALL {_token_runs("SELECT * FROM letters", "SELECT * FROM people")}),
found AS (SELECT f.doc, f.para, f.s, f.e, l.text, substr(l.text, f.s + 1, f.e - f.s) AS span, regexp_extract(substr(l.text, f.e + 1), '{follow}', 1) AS after, length(regexp_extract(substr(l.text, f.e + 1), '{follow}', 0)) AS more
  FROM ({_leftmost("SELECT * FROM hits")}) f JOIN ({lines}) l ON l.doc = f.doc AND l.para = f.para),
persons AS (SELECT doc, para, s, CASE WHEN {good} THEN e + more ELSE e END AS e, text FROM (SELECT *, lower(trim(after, '.')) AS norm FROM found) x
  UNION ALL SELECT doc, para, length(lead), length(lead) + length(value), text FROM ({title})),
brands AS (SELECT * FROM (SELECT *, EXISTS (SELECT 1 FROM core c WHERE c.doc = w.doc AND c.token = w.norm AND NOT EXISTS (SELECT 1 FROM people p WHERE p.doc = c.doc AND p.token = c.token)) AS is_core FROM (SELECT * REPLACE (lower(token) AS norm) FROM ({words(lines, "[\\pL\\pN]+")})) w) WHERE is_core OR {business}),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc, para ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY doc, para ORDER BY pos) = pos - 1 AND (regexp_matches(gap, '^\\s+$') OR (regexp_matches(gap, '^\\s*&\\s*$') AND is_core)) THEN 0 ELSE 1 END AS new FROM brands)),
firms AS (SELECT doc, para, any_value(text) AS text, min(start) AS s, max("end") AS e FROM (SELECT *, min(CASE WHEN is_core THEN start END) OVER (PARTITION BY doc, para, run) AS begin_ FROM runs) WHERE start >= begin_ GROUP BY doc, para, run),
legal AS (SELECT doc, para, text, s, e + length(regexp_extract(substr(text, e + 1), '^\\s+(?i:{X.LEGAL})')) AS e FROM firms),
places AS ({_leftmost(_token_runs(f"SELECT w.* FROM letters w WHERE EXISTS (SELECT 1 FROM ({hinted}) h WHERE h.doc = w.doc AND h.para = w.para)", localities(lines)))}),
every AS (SELECT doc, para, s, e, 'PERSON' AS label, 30 AS priority FROM persons UNION ALL SELECT doc, para, s, e, 'ORG', 39 FROM legal WHERE NOT regexp_matches(substr(text, s + 1, e - s), '(?i){X.PUBLIC_BODIES}')
  UNION ALL SELECT doc, para, s, e, 'LOCALITY', 35 FROM places)
SELECT v.doc, v.para, CAST(v.s AS BIGINT) AS start, substr(l.text, v.s + 1, v.e - v.s) AS value, v.label, v.priority FROM every v JOIN ({lines}) l ON l.doc = v.doc AND l.para = v.para"""
