"""Replacement values: deterministic, shaped like the original, from ranges that belong to nobody.

Every value is a pure function of a seed, a kind and a normalised original, by SHA-256, so equal originals
get equal fakes on any partitioning and in any order. Words of names and brands go through a token map
that is built once: candidates by hash, collisions resolved by rank and a further hash, real words never
drawn. A fake that equals its original is drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import Stages
from ..functions import fixed as X
from ..functions import hygiene as H
from ..functions import names as N
from ..functions import spans as S
from ..functions.spans import let
from ..functions.validators import digits, luhn_sum

SEED = "maskwright"
#: Draws after which a token takes a name made of its own hash.
DRAWS = 8


def draw(seed: str, kind: str, key: Column, turn: int | Column = 0) -> Column:
    """60 bits of the hash of a key."""
    turn = F.lit(turn) if isinstance(turn, int) else turn
    hashed = F.sha2(F.concat_ws("|", F.lit(seed), F.lit(kind), key, turn.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")


def between(seed: str, kind: str, key: Column, lo: int, hi: int, turn: int | Column = 0) -> Column:
    return F.lit(lo) + draw(seed, kind, key, turn) % (hi - lo + 1)


def pick(seed: str, kind: str, key: Column, pool, turn: int = 0) -> Column:
    return F.element_at(F.lit(list(pool)), (draw(seed, kind, key, turn) % len(pool) + 1).cast("int"))


def stream(seed: str, kind: str, key: Column, parts: int = 2) -> Column:
    """Decimal digits, 15 for each part."""
    return F.concat(*(F.lpad((draw(seed, kind, key, 100 + i) % 10**15).cast("string"), 15, "0") for i in range(parts)))


def fill(template: Column, number: Column) -> Column:
    """The template with its digits replaced in order."""
    step = lambda a, c: F.when(
        c.rlike("^[0-9]$"), F.struct((a["i"] + 1).alias("i"), F.concat(a["s"], F.substring(number, a["i"], F.lit(1))).alias("s"))
    ).otherwise(F.struct(a["i"].alias("i"), F.concat(a["s"], c).alias("s")))
    return F.aggregate(F.split(template, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), step, lambda a: a["s"])


def key_of(value: Column) -> Column:
    """One key for all spellings of a value that differ in case and white space."""
    return F.regexp_replace(F.lower(F.trim(value)), r"(?U)\s+", " ")


# ---------------------------------------------------------------- numbers


def ip(value: Column, seed: str = SEED) -> Column:
    k = key_of(value)
    four = F.concat(pick(seed, "ip", k, X.DOCUMENTATION_BLOCKS), F.lit("."), between(seed, "ip", k, 1, 254, 1).cast("string"))
    six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(between(seed, "ip", k, 1, 0xFFFF, 2))))
    return F.when(value.contains(":"), six).otherwise(four)


def ssn(value: Column, seed: str = SEED) -> Column:
    k = key_of(value)
    area = between(seed, "ssn", k, 900, 999)
    rest = F.concat(between(seed, "ssn", k, 10, 99, 1).cast("string"), between(seed, "ssn", k, 1000, 9999, 2).cast("string"))
    return fill(value, F.concat(area.cast("string"), rest))


def aadhaar(value: Column, seed: str = SEED) -> Column:
    return fill(value, F.concat(F.lit("1"), F.substring(stream(seed, "aadhaar", digits(value), 1), 1, 11)))


def card(value: Column, seed: str = SEED) -> Column:
    """Same first digit, length and grouping, with a valid check digit."""
    body = let(digits(value), lambda n: F.concat(F.substring(n, 1, 1), F.substring(stream(seed, "card", n), F.lit(1), F.length(n) - 2)))
    return fill(value, let(body, lambda b: F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0")))) % 10).cast("string"))))


def phone(value: Column, seed: str = SEED) -> Column:
    """Same layout and country code; a first digit that a subscriber's number can have."""
    return let(digits(value), lambda n: _phone(value, n, seed))


def _phone(value: Column, n: Column, seed: str) -> Column:
    abroad = F.ltrim(value).startswith("+") | (n.startswith("91") & (F.length(n) == 12))
    code = F.when(~abroad, 0).when(F.substring(n, 1, 3).isin(*X.COUNTRY_CODES_3), 3).when(n.rlike("^[17]"), 1).otherwise(2)
    kept = F.substring(n, F.lit(1), code)
    mobile = kept.isin("", "91") & (F.length(n) - code == 10)
    first = F.when(mobile, between(seed, "phone", n, 6, 9)).otherwise(between(seed, "phone", n, 1, 9, 1))
    return fill(value, F.concat(kept, first.cast("string"), stream(seed, "phone", n)))


def _letter(seed: str, kind: str, k: Column, turn: int) -> Column:
    return pick(seed, kind, k, X.LETTERS, turn)


def id_number(value: Column, seed: str = SEED) -> Column:
    """In the shape of a company number, tax number or tax registration; else class by class."""
    num = lambda lo, hi, t, k=value: between(seed, "id", k, lo, hi, t).cast("string")

    def pan(of: Column) -> Column:
        return F.concat(*(_letter(seed, "id", of, t) for t in (1, 2, 3)), F.substring(of, 4, 2), between(seed, "id", of, 1000, 9999, 4).cast("string"), _letter(seed, "id", of, 5))

    cin = F.concat(F.substring(value, 1, 1), num(10000, 99999, 1), pick(seed, "id", value, X.STATE_CODES, 2), num(1975, 2018, 3), F.substring(value, 13, 3), num(100000, 999999, 4))
    gst = F.concat(F.lpad(num(1, 37, 6), 2, "0"), pan(F.substring(value, 3, 10)), F.lit("1Z"), _letter(seed, "id", value, 7))
    code = F.sha2(F.concat_ws("|", F.lit(seed), F.lit("id"), value), 256)
    nibble = lambda i: F.conv(F.substring(code, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    letters = F.lit(list(X.LETTERS))
    each = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(c.rlike("^[0-9]$"), (nibble(i) % 10).cast("string")).when(c.rlike(r"^\p{L}$"), F.element_at(letters, nibble(i) % len(X.LETTERS) + 1)).otherwise(c),
    )
    return (
        F.when(value.rlike(r"^[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}$"), cin)
        .when(value.rlike(r"^[A-Z]{5}\d{4}[A-Z]$"), pan(value))
        .when(value.rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"), gst)
        .otherwise(F.array_join(each, ""))
    )


# ---------------------------------------------------------------- dates


def dob(value: Column, seed: str = SEED) -> Column:
    """Moved by 200 to 2500 days, in the same format; what is no date keeps its shape with other digits."""
    days = (between(seed, "dob", value, 200, 2500) * (F.lit(1) - 2 * (draw(seed, "dob", value, 1) % 2))).cast("int")
    return let(days, lambda d: _moved_dob(value, d, seed))


def _moved_dob(value: Column, days: Column, seed: str) -> Column:
    moved = lambda text, form: F.date_add(F.try_to_date(text, form), days)
    get = lambda rx, i: F.regexp_extract(value, rx, i)
    like = lambda n, model: F.when(F.length(model) > 1, F.lpad(n.cast("string"), F.length(model), F.lit("0"))).otherwise(n.cast("string"))
    ordinal = lambda d: F.when(F.dayofmonth(d).between(10, 20), "th").when(F.dayofmonth(d) % 10 == 1, "st").when(F.dayofmonth(d) % 10 == 2, "nd").when(F.dayofmonth(d) % 10 == 3, "rd").otherwise("th")

    iso = F.date_format(moved(F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value), "yyyy-MM-dd"), "yyyy-MM-dd")

    numeric = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{2}|\d{4})$"
    a, sep, b, y = (get(numeric, i) for i in (1, 2, 3, 4))
    ai, bi, yi = (x.try_cast("int") for x in (a, b, y))
    year = F.when(F.length(y) == 4, yi).when(yi < 30, yi + 2000).otherwise(yi + 1900)
    month_first = (ai <= 12) & (bi > 12)
    dd, mm = F.when(month_first, bi).otherwise(ai), F.when(month_first, ai).otherwise(bi)
    d = moved(F.concat_ws("-", year.cast("string"), F.lpad(mm.cast("string"), 2, "0"), F.lpad(dd.cast("string"), 2, "0")), "yyyy-MM-dd")

    def as_numbers(d: Column) -> Column:
        one, two = F.when(month_first, F.month(d)).otherwise(F.dayofmonth(d)), F.when(month_first, F.dayofmonth(d)).otherwise(F.month(d))
        short = F.when(F.length(y) == 4, F.year(d).cast("string")).otherwise(F.lpad((F.year(d) % 100).cast("string"), 2, "0"))
        return F.concat(like(one, a), sep, like(two, b), sep, short)

    slashed = let(d, as_numbers)

    months = "|".join(m[:3] for m in X.MONTH_NAMES)
    number = lambda name: F.array_position(F.lit([m[:3].lower() for m in X.MONTH_NAMES]), F.lower(F.substring(name, 1, 3)))
    full = F.lit(list(X.MONTH_NAMES))

    def named(d: Column, old: Column) -> Column:
        name = F.try_element_at(full, F.month(d))
        return F.when(F.length(old) > 3, name).otherwise(F.substring(name, 1, 3))

    def built(year: Column, month: Column, day: Column) -> Column:
        return moved(F.concat_ws("-", year, F.lpad(number(month).cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    day_first = rf"(?i)^(\d{{1,2}})(st|nd|rd|th)?([ -])((?:{months})[a-z]*)(\.?,?)([ -])(\d{{4}})$"
    p = [None, *(get(day_first, i) for i in range(1, 8))]
    worded = let(built(p[7], p[4], p[1]), lambda d: F.concat(F.dayofmonth(d).cast("string"), F.when(p[2] != "", ordinal(d)).otherwise(""), p[3], named(d, p[4]), p[5], p[6], F.year(d).cast("string")))
    month_lead = rf"(?i)^((?:{months})[a-z]*)(\.?) (\d{{1,2}})(st|nd|rd|th)?(,?) (\d{{4}})$"
    q = [None, *(get(month_lead, i) for i in range(1, 7))]
    lead = let(
        built(q[6], q[1], q[3]),
        lambda d: F.concat(named(d, q[1]), q[2], F.lit(" "), F.dayofmonth(d).cast("string"), F.when(q[4] != "", ordinal(d)).otherwise(""), q[5], F.lit(" "), F.year(d).cast("string")),
    )
    other = fill(value, stream(seed, "dob", value))
    return F.coalesce(iso, F.when(value.rlike(numeric), slashed), F.when(value.rlike(day_first), worded), F.when(value.rlike(month_lead), lead), other)


def address(value: Column, seed: str = SEED) -> Column:
    """Number, street and town, a code of the source's layout, and state and country where the source has them."""
    k = key_of(value)
    states = X.STATES.split("|")
    # never the state itself, where the line is one
    others = F.array_remove(F.lit(states), F.trim(F.regexp_replace(value, r",?\s*India\s*$", "")))
    state = let(others, lambda o: F.element_at(o, (draw(seed, "state", k) % F.size(o) + 1).cast("int")))
    code = r"(\d{3})( ?)(\d{3})(?!\d)"
    pin = value.rlike(code)
    dash = F.regexp_extract(value, r"([\-–—,])\s*\d{3} ?\d{3}", 1)
    number = F.concat(between(seed, "pin", k, 100, 999).cast("string"), F.regexp_extract(value, code, 2), between(seed, "pin", k, 100, 999, 1).cast("string"))
    body = F.concat_ws(", ", between(seed, "house", k, 1, 240).cast("string"), pick(seed, "street", k, N.STREETS), pick(seed, "town", k, N.TOWNS))
    tail = F.when(value.contains("India"), F.concat(F.lit(", "), state, F.lit(", India"))).when(value.rlike(X.STATES), F.concat(F.lit(", "), state)).otherwise("")
    line = value.rlike(r"^\s*[A-Za-z ]+(?:,\s*India)?\s*$") & ~pin
    return F.when(line, F.concat(state, F.when(value.contains("India"), ", India").otherwise(""))).otherwise(F.concat(body, F.lit(" "), F.when(dash != "", dash).otherwise("-"), F.lit(" "), number, tail))


NUMBERS = {"IP_ADDRESS": ip, "SSN": ssn, "AADHAAR": aadhaar, "CREDIT_CARD": card, "PHONE": phone, "ID_NUMBER": id_number, "DOB": dob, "ADDRESS": address}
FAKERS = dict(NUMBERS)


def register_faker(label: str, make) -> None:
    """A replacement for a label: make(value column, seed) -> column."""
    FAKERS[label] = make


def direct(label: Column, value: Column, seed: str = SEED) -> Column:
    """The fake of a value whose label needs no token map; null for others. One that equals the original has its digits moved on by one."""
    (first, make), *rest = FAKERS.items()
    drawn = reduce(lambda out, item: out.when(label == item[0], item[1](value, seed)), rest, F.when(label == first, make(value, seed)))
    return let(drawn, lambda fake: F.when(fake == value, F.translate(fake, "0123456789", "1234567890")).otherwise(fake))


# ---------------------------------------------------------------- words


def _coined(key: Column, seed: str, turn: Column) -> Column:
    """A name of two parts, by hash."""
    h = draw(seed, "coin", key, turn)
    return F.concat(F.element_at(F.lit(list(N.ONSETS)), (h % len(N.ONSETS) + 1).cast("int")), F.element_at(F.lit(list(N.ENDINGS)), (F.call_function("div", h, F.lit(len(N.ONSETS))) % len(N.ENDINGS) + 1).cast("int")))


def token_map(tokens: DataFrame, forbidden: DataFrame | None = None, seed: str = SEED, scope: str = "doc_id") -> DataFrame:
    """scope, token and fake for tokens(scope, token, kind 'first' | 'surname').

    In a scope no two tokens share a fake and none is a real token. Each turn draws for the tokens that have
    none; of those that draw the same name the least by hash keeps it. After the last turn the token's hash
    makes it unique.
    """
    todo = tokens.groupBy(scope, "token").agg(F.max("kind").alias("kind"))  # surname if ever one
    real = todo.select(scope, F.col("token").alias("word"))
    if forbidden is not None:
        real = real.unionByName(forbidden.select(scope, F.col("token").alias("word"))).distinct()
    k = F.col("token")
    draws = [
        F.when(F.col("kind") == "first", pick(seed, "first", k, N.FIRST, t)).otherwise(pick(seed, "last", k, N.LAST, t)) if t < 3 else _coined(k, seed, F.lit(t)) for t in range(DRAWS)
    ]
    # all draws of all tokens at once: (scope, word) goes to the token that wants it first, by a minimum, as a pool's name has any number of takers
    wants = todo.select(scope, "token", F.posexplode(F.array(*draws)).alias("turn", "fake")).withColumn("word", F.lower("fake"))
    free = wants.join(real, [scope, "word"], "left_anti")
    owner = free.groupBy(scope, "word").agg(F.min(F.struct("turn", draw(seed, "owner", k).alias("h"), "token", "fake")).alias("o"))
    won = owner.select(scope, "o.token", "o.turn", "o.fake").groupBy(scope, "token").agg(F.min_by("fake", "turn").alias("fake"))
    unique = F.initcap(F.concat(F.lit("X"), F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), k), 256), 1, 9), "0123456789", "ghijklmnop")))
    return todo.join(won, [scope, "token"], "left").select(scope, "token", F.coalesce("fake", unique).alias("fake"))


def _swap(text: Column, parts: Column) -> Column:
    """Parts of an array (start, end, fake) put into their places, the rest as it is."""
    step = lambda a, w: F.struct(w["end"].alias("at"), F.concat(a["s"], F.substring(text, a["at"] + 1, w["start"] - a["at"]), w["fake"]).alias("s"))
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("s")), step, lambda a: F.concat(a["s"], F.substring(text, a["at"] + 1, F.length(text))))


def name_tokens(entities: DataFrame, scope: str = "doc_id") -> DataFrame:
    """scope, token, kind and core: the words of people's, brands' and places' names (core), of mailboxes and of domains, that need a fake."""
    from .lexicon import words

    each = entities.where(F.col("label").isin("PERSON", "ORG", "LOCALITY")).select(scope, "label", words(F.col("original")).alias("ws"))
    each = each.select(scope, "label", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "w")).where(~F.col("w.token").rlike(r"^[A-Z]\.$"))
    person = F.col("label") == "PERSON"
    own = (~F.col("w.norm").isin(*(X.DESCRIPTORS | X.TRIM)) & (F.length("w.norm") >= 2) & ~H.is_roman(F.col("w.norm"))) | (F.col("i") == 0)
    kind = F.when(person & ((F.col("i") < F.col("n") - 1) | (F.col("n") == 1)), "first").otherwise("surname")
    named = each.where(person | own).select(scope, F.col("w.norm").alias("token"), kind.alias("kind"), F.lit(True).alias("core"))
    mail = entities.where("label = 'EMAIL'").select(scope, F.explode(F.regexp_extract_all(F.substring_index("original", "@", 1), F.lit("([A-Za-z]+)"), F.lit(1))).alias("token"))
    mail = mail.where(~F.lower("token").isin(*X.ROLE_MAILBOXES)).select(scope, F.lower("token").alias("token"), F.lit("first").alias("kind"), F.lit(False).alias("core"))
    hosts = entities.where("label in ('EMAIL', 'URL')").select(scope, brand_of(host_of(F.col("label"), F.col("original"))).alias("token"), F.lit("surname").alias("kind"), F.lit(False).alias("core"))
    return named.unionByName(mail).unionByName(hosts).where("token <> ''")


def host_of(label: Column, value: Column) -> Column:
    web = F.regexp_extract(value, r"(?is)^(?:https?://)?(?:www\.)?([^/\s?#]+)", 1)
    return F.lower(F.when(label == "EMAIL", F.substring_index(value, "@", -1)).otherwise(web))


def brand_of(host: Column) -> Column:
    """The label that a domain is registered under."""

    def pick_label(parts: Column) -> Column:
        at = F.when((F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).isin("co", "gov", "ac"), -3).when(F.size(parts) >= 2, -2).otherwise(1)
        return F.coalesce(F.try_element_at(parts, at), F.lit(""))

    return let(F.split(host, r"\."), pick_label)


PART = "array<struct<start:int,end:int,token:string,norm:string,role:string>>"


def parts_of(label: Column, value: Column) -> Column:
    """What is renamed in a name, mail address or web address: start, end, token, norm and role.

    Roles: 'initial' and 'name' (words of people, brands and places), 'mailbox' (words left of the @; start and
    end count there) and 'host' (the label that a domain is registered under).
    """
    from .lexicon import words

    def part(w: Column, role: Column) -> Column:
        return F.struct(w["start"].alias("start"), w["end"].alias("end"), w["token"].alias("token"), w["norm"].alias("norm"), role.alias("role"))

    def person(ws: Column) -> Column:
        return F.transform(ws, lambda w: part(w, F.when(w["token"].rlike(r"^[A-Z]\.$"), "initial").otherwise("name")))

    def brand(ws: Column) -> Column:
        kept = lambda w: w["norm"].isin(*(X.DESCRIPTORS | X.TRIM)) | (F.length(w["norm"]) < 2) | H.is_roman(w["norm"])
        own = F.filter(ws, lambda w: ~kept(w))
        return F.transform(F.when(F.size(own) > 0, own).otherwise(F.slice(ws, 1, 1)), lambda w: part(w, F.lit("name")))

    host = brand_of(host_of(label, value))
    hosts = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), host.alias("token"), host.alias("norm"), F.lit("host").alias("role")))
    local = words(F.substring_index(value, "@", 1), "[A-Za-z]+")
    mailbox = F.transform(F.filter(local, lambda w: ~w["norm"].isin(*X.ROLE_MAILBOXES)), lambda w: part(w, F.lit("mailbox")))
    return (
        F.when(label == "PERSON", S.let(words(value), person).cast(PART))
        .when(label.isin("ORG", "LOCALITY"), S.let(words(value), brand).cast(PART))
        .when(label == "EMAIL", F.concat(mailbox.cast(PART), hosts.cast(PART)))
        .when(label == "URL", hosts.cast(PART))
    )


def renamed(part: Column, begin: Column, fake: Column, seed: str = SEED) -> Column:
    """The new text of a part. begin: the known word that a mailbox or host begins with, or itself; fake: that of begin, or of the name (null: by hash)."""
    name = F.coalesce(fake, _coined(part["norm"], SEED, F.lit(0)))
    branded = F.lower(F.concat(F.coalesce(fake, _coined(begin, SEED, F.lit(0))), F.substring(part["norm"], F.length(begin) + 1, F.length(part["norm"]))))
    initial = F.concat(H.keep_case(part["token"], pick(SEED, "initial", part["token"], X.INITIALS)), F.lit("."))
    return F.when(part["role"] == "initial", initial).when(part["role"] == "name", H.keep_case(F.trim(part["token"], F.lit(".")), name)).otherwise(branded)


def rebuilt(label: Column, value: Column, parts: Column) -> Column:
    """The value with its parts (start, end, role, fake) replaced."""
    inner = F.filter(parts, lambda p: p["role"] != "host")
    host = F.concat(F.try_element_at(F.filter(parts, lambda p: p["role"] == "host"), F.lit(1))["fake"], F.lit(".example.com"))
    mail = F.concat(_swap(F.substring_index(value, "@", 1), inner), F.lit("@"), host)
    pieces = [F.regexp_extract(value, r"(?is)^(https?://)?(www\.)?([^/\s?#]+)(.*)$", i) for i in (1, 2, 4)]
    web = F.concat(pieces[0], pieces[1], host, F.regexp_replace(pieces[2], r"(?s)\?.*", ""))
    return F.when(label == "EMAIL", mail).when(label == "URL", web).otherwise(_swap(value, inner))


def by_hash(label: Column, value: Column) -> Column:
    """The fake of a name, mailbox or web address of which no words are known, by the words' own hashes."""
    named = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["role"].alias("role"), renamed(p, p["norm"], F.lit(None).cast("string")).alias("fake"))
    return rebuilt(label, value, F.transform(parts_of(label, value), named))


NAMED = ("PERSON", "ORG", "LOCALITY", "EMAIL", "URL")


def pseudonymise(entities: DataFrame, forbidden: DataFrame | None = None, seed: str = SEED, scope: str = "doc_id", stages: Stages | None = None) -> DataFrame:
    """entities with a replacement; every row once. scope: within which equal words have equal fakes and fakes are no real words (null is one like any other).

    Labels with a faker of their own are replaced by projection. Names are cut into words, each joined with
    the token map by itself, so that no row holds a document's words.
    """
    stages = stages or Stages(entities.sparkSession, "pseudonyms")
    label, value, by = F.col("label"), F.col("original"), "__scope"
    # a struct is equal to another where both hold null
    known = entities.withColumn(by, F.struct(F.col(scope).alias("s")))
    real = None if forbidden is None else forbidden.select(F.struct(F.col(scope).alias("s")).alias(by), "token")
    tokens = stages.write(name_tokens(known, by))
    mapped = stages.write(token_map(tokens, real, seed, by))
    values = known.where(label.isin(*[x for x in NAMED if x not in FAKERS])).select(by, "label", "original").distinct()
    parts = values.select(by, "label", "original", F.posexplode(parts_of(label, value)).alias("i", "p"))
    parts = stages.write(parts)
    whole = [by, "label", "original", "i"]
    # a mailbox or host is named after the longest name word that it begins with
    words = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("p.norm"))), lambda n: F.substring(F.col("p.norm"), F.lit(1), n))
    begins = parts.where("p.role in ('mailbox', 'host') and length(p.norm) >= 3").select(*whole, F.explode(words).alias("token"))
    core = tokens.where("core").select(by, "token").distinct()
    begins = begins.join(core, [by, "token"], "left_semi").groupBy(*whole).agg(F.max_by("token", F.length("token")).alias("begin"))
    parts = parts.join(begins, whole, "left").withColumn("begin", F.coalesce("begin", "p.norm"))
    parts = parts.join(mapped.select(by, F.col("token").alias("begin"), "fake"), [by, "begin"], "left")
    one = F.struct("i", "p.start", "p.end", "p.role", renamed(F.col("p"), F.col("begin"), F.col("fake"), seed).alias("fake"))
    fakes = parts.groupBy(by, "label", "original").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    fakes = fakes.select(by, "label", "original", rebuilt(label, value, F.col("parts")).alias("__fake"))
    out = known.join(fakes, [by, "label", "original"], "left")
    # what has no faker and no words is replaced character by character, never kept
    made = F.when(label.isin(*FAKERS), direct(label, value, seed)).otherwise(F.coalesce("__fake", id_number(value, seed)))
    return out.select(*(F.col(f"`{c}`") for c in entities.columns), made.alias("replacement"))
