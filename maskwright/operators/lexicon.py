"""The learned lexicon: people, brands and localities of each document, found by aggregation and joined back.

Everything is keyed by doc_id, so that a document's own words decide what is a name in it. Learning gives
five small tables; applying them gives spans for each paragraph.

Without an entity provider, every line is searched for names; proposals of a provider (doc_id, para_idx,
start, end, label) can be given, and then decide where to look and which words are places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import Stages
from ..functions import fixed as X
from ..functions import hygiene as H
from ..functions import names as N
from ..functions import spans as S
from .addresses import address_spans
from .organisations import organisation_spans

PERSON, BRAND, LOCALITY = 30, 39, 35
_J = S.FLAGS
_PARA = ["doc_id", "para_idx"]
_INITIAL = r"^[A-Z]\.$"
_BETWEEN = r"(?U)(?:[^\w'’\-]|[\d_])+"  # what no word of a name holds


@dataclass(frozen=True)
class Lexicon:
    """(doc_id, token) tables, phrases with their counts, and organisations with theirs."""

    lower_vocab: DataFrame
    phrases: DataFrame  # doc_id, phrase (array), n
    person_tokens: DataFrame
    org_core: DataFrame
    localities: DataFrame
    org_names: DataFrame  # doc_id, name, n
    place_tokens: DataFrame | None = None

    def forbidden(self) -> DataFrame:
        """Real tokens, none of which may be drawn as a fake."""
        people = self.phrases.select("doc_id", F.explode("phrase").alias("token"))
        return people.unionByName(self.org_core).distinct()


def lower_vocab(paras: DataFrame) -> DataFrame:
    """doc_id and token: the words that occur in lower case outside mail and web addresses."""
    prose = F.regexp_replace("text", _J + X.NON_PROSE, " ")
    return paras.select("doc_id", F.explode(F.regexp_extract_all(prose, F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))).alias("token")).distinct()


def words(text: Column, pattern: str = X.WORD) -> Column:
    """The words of a text: start, end, token, norm and the gap before each."""

    def within(t: Column) -> Column:
        def linked(found: Column) -> Column:
            ends = F.concat(F.array(F.lit(0)), F.transform(found, lambda w: w["end"]))

            def one(w: Column, last: Column) -> Column:
                token, gap = S.part(t, w), F.substring(t, last + 1, w["start"] - last)
                return F.struct(w["start"].alias("start"), w["end"].alias("end"), token.alias("token"), H.norm(token).alias("norm"), gap.alias("gap"))

            return F.zip_with(found, F.slice(ends, F.lit(1), F.size(found)), one)

        return S.let(S.matches(t, pattern, many=True), linked)

    return S.let(text, within)


def _known(name: Column, gazetteer: frozenset[str]) -> Column:
    return name.isin(*gazetteer) if gazetteer else F.lit(False)


def _may_be_name(token: Column, norm: Column, caps: Column) -> Column:
    """What a name's token must fulfil, but for the document's own vocabulary."""
    upper = (F.upper(token) == token) & (F.lower(token) != token)
    return (F.length(norm) >= 2) & token.rlike(r"^\p{Lu}") & (~upper | caps) & ~norm.isin(*(X.PERSON_STOP | X.TRIM | X.DESCRIPTORS))


def _without(rows: DataFrame, tokens: DataFrame | None, column: str) -> DataFrame:
    if tokens is None:
        return rows
    return rows.join(tokens.select("doc_id", F.col("token").alias(column)).withColumn("__in", F.lit(True)), ["doc_id", column], "left").withColumn("good", F.col("good") & F.col("__in").isNull()).drop("__in")


def candidate_runs(paras: DataFrame, vocabulary: DataFrame | None, places: DataFrame | None = None, allow_caps: bool = False, gazetteer: frozenset[str] = N.GAZETTEER) -> DataFrame:
    """doc_id, para_idx, start, end and phrase of runs of two to four name-like words, one of them known or an initial.

    Words of a run are separated by white space alone; an initial may stand within it. An initial at the end
    is not part of the phrase, but of the span.
    """
    caps = F.lit(True) if allow_caps else H.mostly_caps(F.col("text"))
    placed = lambda w, i: F.struct(i.alias("pos"), *(w[c].alias(c) for c in ("start", "end", "token", "norm", "gap")))
    upper = F.filter(F.transform(words(F.col("text")), placed), lambda w: w["token"].rlike(r"^\p{Lu}"))
    # a run holds a known name or an initial; most lines can be seen to have neither before their words are taken apart
    likely = F.exists(F.split(F.lower("text"), _BETWEEN), lambda w: _known(F.ltrim(w, F.lit("'’-")), gazetteer)) | F.col("text").rlike(r"[A-Z]\.")
    rows = paras.where(likely).select(*_PARA, "text", upper.alias("ws"))
    rows = rows.where(F.exists("ws", lambda w: _known(w["norm"], gazetteer) | w["token"].rlike(_INITIAL)))
    rows = rows.select(*_PARA, "text", caps.alias("caps"), F.explode("ws").alias("w"))
    rows = rows.select(*_PARA, "caps", "w.*", F.substring("text", F.lit(1), F.col("w.start")).alias("left"))
    opening = F.rtrim(F.regexp_replace("left", r"(?U)\s+$", ""))
    rows = rows.withColumn("opens", ((opening == "") | opening.rlike(r"[.!?]$")) & ~_known(F.col("norm"), gazetteer)).drop("left")
    rows = rows.withColumn("initial", F.col("token").rlike(_INITIAL))
    rows = rows.withColumn("good", _may_be_name(F.col("token"), F.col("norm"), F.col("caps")) & ~F.col("opens"))
    rows = _without(_without(rows, vocabulary, "norm"), places, "norm")
    rows = rows.where("good or initial")
    line = Window.partitionBy(*_PARA).orderBy("pos")
    joined = (F.lag("pos").over(line) == F.col("pos") - 1) & (F.trim(F.regexp_replace("gap", r"(?U)\s", "")) == "")
    rows = rows.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    runs = rows.groupBy(*_PARA, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "norm", "initial"))).alias("ws"))
    first = F.array_position(F.transform("ws", lambda w: w["initial"]), F.lit(False)).cast("int")
    # filters may be evaluated in another order, so a run of initials alone must not fail in slice()
    runs = runs.where(first > 0).withColumn("ws", F.slice("ws", F.greatest(first, F.lit(1)), F.size("ws") - F.greatest(first, F.lit(1)) + 1))
    back = F.array_position(F.transform(F.reverse("ws"), lambda w: w["initial"]), F.lit(False)).cast("int")
    runs = runs.withColumn("core", F.slice("ws", F.lit(1), F.size("ws") - back + 1))
    known = F.exists("core", lambda w: _known(w["norm"], gazetteer) | w["initial"])
    long = F.size(F.filter("core", lambda w: F.length(w["norm"]) >= 3)) >= 2
    runs = runs.where(F.size("core").between(2, 4) & known & long)
    return runs.select(*_PARA, F.element_at("ws", 1)["start"].alias("start"), F.element_at("ws", -1)["end"].alias("end"), F.transform("core", lambda w: w["norm"]).alias("phrase"))


def _usable(rows: DataFrame, paras: DataFrame) -> DataFrame:
    """Ranges that overlap no organisation and are not followed by a street or place word."""
    seen = rows.join(paras.select(*_PARA, "text", _static(paras, "ORG").alias("orgs")), _PARA)
    clear = ~F.exists("orgs", lambda o: (o["start"] < F.col("end")) & (F.col("start") < o["end"]))
    follows = F.expr("substring(text, end + 1)").rlike(_J + X.PLACE_SUFFIX)
    return seen.where(clear & ~follows).drop("text", "orgs")


def _titled(text: Column) -> Column:
    """Names after a title."""
    return S.matches(text, X.TITLED_NAME, X.TITLE, text.rlike("Mr|Ms|Miss|Dr|Shri|Smt|Sri"))


def person_phrases(paras: DataFrame, vocabulary: DataFrame, places: DataFrame | None = None, proposals: DataFrame | None = None, gazetteer: frozenset[str] = N.GAZETTEER) -> DataFrame:
    """doc_id, phrase and n, the number of paragraphs in which the name stands."""
    runs = candidate_runs(paras, vocabulary, places, gazetteer=gazetteer)
    if proposals is not None:
        where = proposals.where("label in ('PERSON', 'ORG')").select(*_PARA, F.col("start").alias("s"), F.col("end").alias("e"), "label")
        people = where.where("label = 'PERSON'").select(*_PARA).distinct()
        inside = runs.join(where, _PARA).where("start >= s and end <= e").select(*_PARA, "start", "end", "phrase")
        runs = inside.unionByName(runs.join(people, _PARA, "left_semi")).distinct()
    found = _usable(runs, paras).select(*_PARA, "phrase")
    titled = paras.select(*_PARA, F.explode(F.transform(_titled(F.col("text")), lambda s: S.part(F.col("text"), s))).alias("name"))
    titled = titled.select(*_PARA, F.transform(F.split("name", r"(?U)\s+"), H.norm).alias("phrase"))
    cued = paras.select(*_PARA, "text", H.mostly_caps(F.col("text")).alias("caps"), F.explode(S.matches(F.col("text"), X.CONTEXT_NAME, X.CONTEXT_LEAD, F.lower("text").rlike(rf"(?<![a-z0-9_])(?:{X.CONTEXT_CUES})[ ,:\-]"))).alias("s"))
    cued = cued.select(*_PARA, "caps", "s.start", "s.end", words(S.part(F.col("text"), F.col("s"))).alias("ws")).where(F.size("ws").between(2, 3))
    each = cued.select(*_PARA, "start", "end", "caps", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w")).select(*_PARA, "start", "end", "caps", "n", "pos", "w.token", "w.norm")
    each = each.withColumn("good", _may_be_name(F.col("token"), F.col("norm"), F.col("caps")))
    each = _without(_without(each, vocabulary, "norm"), places, "norm").where("good")
    whole = each.groupBy(*_PARA, "start", "end", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("ws")).where(F.size("ws") == F.col("n"))
    whole = _usable(whole.select(*_PARA, "start", "end", F.transform("ws", lambda w: w["norm"]).alias("phrase")), paras).select(*_PARA, "phrase")
    every = found.unionByName(titled).unionByName(whole).distinct()
    return every.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


def token_support(phrases: DataFrame) -> DataFrame:
    """doc_id, token and support: in how many different phrases a token of three letters or more occurs."""
    return phrases.select("doc_id", F.explode(F.array_distinct("phrase")).alias("token")).where(F.length("token") >= 3).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("support"))


def _static(paras: DataFrame, label: str) -> Column:
    """Spans of organisations with a suffix, or of addresses: those found before, if paras has them."""
    if "static" in paras.columns:
        return F.filter("static", lambda s: s["label"] == label)
    return {"ORG": organisation_spans, "ADDRESS": address_spans}[label](F.col("text"))


def org_names(paras: DataFrame) -> DataFrame:
    """doc_id, name and n of the organisations with a suffix."""
    text = F.col("text")
    named = paras.select("doc_id", F.explode(F.transform(_static(paras, "ORG"), lambda s: S.part(text, s))).alias("name"))
    return named.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def org_core(named: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id and token: the distinctive words of the organisations' names."""
    each = named.select("doc_id", F.explode(F.transform(words(F.col("name")), lambda w: w["norm"])).alias("token")).distinct()
    each = each.where((F.length("token") >= 3) & ~F.col("token").isin(*(X.DESCRIPTORS | X.TRIM)) & ~H.is_roman(F.col("token")))
    return each.join(vocabulary, ["doc_id", "token"], "left_anti")


def localities(paras: DataFrame, vocabulary: DataFrame, core: DataFrame, gazetteer: frozenset[str] = N.GAZETTEER) -> DataFrame:
    """doc_id and token: capitalised words of addresses that are nothing else known."""
    text = F.col("text")
    found = paras.select("doc_id", F.explode(F.transform(_static(paras, "ADDRESS"), lambda s: S.part(text, s))).alias("address"))
    each = found.select("doc_id", F.explode(F.regexp_extract_all("address", F.lit("([A-Z][A-Za-z]{4,})"), F.lit(1))).alias("token"))
    each = each.select("doc_id", F.lower("token").alias("token")).distinct()
    skip = X.PERSON_STOP | X.TRIM | X.DESCRIPTORS | X.CITIES | {s.lower() for s in X.STATES.split("|")} | gazetteer
    each = each.where(~F.col("token").isin(*skip))
    return each.join(vocabulary, ["doc_id", "token"], "left_anti").join(core, ["doc_id", "token"], "left_anti")


def place_tokens(paras: DataFrame, proposals: DataFrame) -> DataFrame:
    """doc_id and token: words that a provider calls a place more often than anything else."""
    named = proposals.join(paras, _PARA).select("doc_id", "label", F.explode(words(F.expr("substring(text, start + 1, end - start)"))).alias("w"))
    place = F.col("label").isin("GPE", "LOC", "FAC")
    votes = named.groupBy("doc_id", F.col("w.norm").alias("token")).agg(F.count_if(place).alias("p"), F.count_if(~place).alias("o"))
    return votes.where("p > o").select("doc_id", "token")


def read_names(spark: SparkSession, path: str, most: int = 200_000) -> frozenset[str]:
    """A name list for learn(): words apart by white space, what follows a # on a line is a remark. Longer lists are an error, as it goes into every task."""
    lines = spark.read.text(path).select(F.explode(F.split(F.lower(F.regexp_replace("value", "#.*", "")), r"(?U)\s+")).alias("name"))
    found = [r[0] for r in lines.where("name <> ''").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a name list holds at most {most} names")
    return frozenset(found)


def learn(paras: DataFrame, proposals: DataFrame | None = None, stages: Stages | None = None, gazetteer: frozenset[str] = N.GAZETTEER) -> Lexicon:
    """The lexicon of every document. paras may hold ``static`` spans; stages: where its tables, which hold names, are written."""
    stages = stages or Stages(paras.sparkSession, "lexicon")
    # written once each: everything later joins with them
    vocabulary = stages.write(lower_vocab(paras))
    named = stages.write(org_names(paras))
    core = stages.write(org_core(named, vocabulary))
    places = place_tokens(paras, proposals) if proposals is not None else None
    phrases = stages.write(person_phrases(paras, vocabulary, places, proposals, gazetteer))
    support = token_support(phrases)
    tokens = support.where((F.col("support") >= 2) | (_known(F.col("token"), gazetteer) & (F.length("token") >= 4))).select("doc_id", "token")
    return Lexicon(vocabulary, phrases, tokens, core, localities(paras, vocabulary, core, gazetteer), named, places)


# ---------------------------------------------------------------- application


def _grams(paras: DataFrame) -> DataFrame:
    """Runs of one to four words, separated by blanks (after an initial, also by its point): start, end and gram."""
    ws = F.col("ws")
    rows = paras.select(*_PARA, words(F.col("text"), r"[^\W\d_]+").alias("ws"))

    def grams(w: Column, i: Column) -> Column:
        out = [F.struct(w["start"].alias("start"), w["end"].alias("end"), w["norm"].alias("gram"))]
        gram, linked, last = w["norm"], F.lit(True), w
        for k in range(1, 4):
            nxt = F.try_element_at(ws, i + k + 1)
            apart = F.when(F.length(last["norm"]) == 1, nxt["gap"].rlike(r"^\.?[ \t]+$")).otherwise(nxt["gap"].rlike(r"^[ \t]+$"))
            linked = linked & F.coalesce(apart, F.lit(False))
            gram = F.concat(gram, F.lit(" "), nxt["norm"])
            out.append(F.when(linked, F.struct(w["start"].alias("start"), nxt["end"].alias("end"), gram.alias("gram"))))
            last = nxt
        return F.array(*out)

    rows = rows.select(*_PARA, F.explode(F.flatten(F.transform(ws, grams))).alias("g"))
    return rows.where("g is not null").select(*_PARA, "g.*")


def _token_runs(paras: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each listed word, the run of listed words that begins with it: start and end."""
    rows = paras.select(*_PARA, F.posexplode(words(F.col("text"), r"[^\W\d_]+")).alias("pos", "w")).select(*_PARA, "pos", "w.start", "w.end", "w.gap", F.col("w.norm").alias("token"))
    rows = rows.join(tokens, ["doc_id", "token"])
    line = Window.partitionBy(*_PARA).orderBy("pos")
    joined = (F.lag("pos").over(line) == F.col("pos") - 1) & F.col("gap").rlike(r"^[ \t]+$")
    rows = rows.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(line))
    return rows.select(*_PARA, "start", F.max("end").over(Window.partitionBy(*_PARA, "run")).alias("end"))


def _leftmost(hits: DataFrame) -> DataFrame:
    """Of each paragraph's hits (start, end, rank) the leftmost, of least rank, then those right of it, and so on."""
    sorted_hits = F.array_sort(F.collect_list(F.struct("start", "rank", F.col("end"))))
    lines = hits.groupBy(*_PARA).agg(sorted_hits.alias("hits"))
    step = lambda kept, h: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) <= h["start"], F.concat(kept, F.array(F.struct(h["start"].alias("start"), h["end"].alias("end"))))).otherwise(kept)
    return lines.select(*_PARA, F.explode(F.aggregate("hits", F.array().cast(S.RANGE), step)).alias("s")).select(*_PARA, "s.*")


def _as_spans(ranges: DataFrame, label: str, priority: int) -> DataFrame:
    return ranges.select(*_PARA, F.col("start").cast("int"), F.col("end").cast("int"), F.lit(label).alias("label"), F.lit(priority).alias("priority"))


def _with_any(paras: DataFrame, *tables: DataFrame) -> DataFrame:
    """The lines of documents that a table has any row of: few documents have names, and only their words are taken apart."""
    docs = reduce(DataFrame.unionByName, (t.select("doc_id") for t in tables)).distinct()
    return paras.join(docs, "doc_id", "left_semi")


def person_spans(paras: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Learned names, with one more name-like word after them, and names after a title."""
    titled = paras.select(*_PARA, F.explode(_titled(F.col("text"))).alias("s")).select(*_PARA, "s.*")
    paras = _with_any(paras, lexicon.phrases)  # the tokens are of phrases
    phrases = lexicon.phrases.select("doc_id", F.array_join("phrase", " ").alias("gram"), F.aggregate("phrase", F.lit(0), lambda a, t: a + F.length(t)).alias("size"))
    hits = _grams(paras).join(phrases, ["doc_id", "gram"]).select(*_PARA, "start", "end", (-F.col("size")).alias("rank"))
    runs = _token_runs(paras, lexicon.person_tokens).select(*_PARA, "start", "end", F.lit(0).alias("rank"))
    found = _leftmost(hits.unionByName(runs)).join(paras.select(*_PARA, "text"), _PARA)
    after = F.regexp_extract(F.expr("substring(text, end + 1)"), _J + X.NEXT_WORD, 1)
    span = F.expr("substring(text, start + 1, end - start)")
    caps = (F.upper(after) == after) & (F.upper(span) == span)
    found = found.withColumn("norm", H.norm(after)).withColumn("good", (after != "") & _may_be_name(after, H.norm(after), caps))
    blanks = F.length(F.regexp_extract(F.expr("substring(text, end + 1)"), _J + X.NEXT_WORD, 0))
    found = found.withColumn("more", blanks)
    found = _without(_without(found, lexicon.lower_vocab, "norm"), lexicon.place_tokens, "norm")
    found = found.select(*_PARA, "start", (F.col("end") + F.when(F.col("good"), F.col("more")).otherwise(0)).alias("end"))
    return _as_spans(found.unionByName(titled), "PERSON", PERSON)


def brand_spans(paras: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Runs that begin with a learned brand word and go on with such, business words, numerals and a legal suffix."""
    core = lexicon.org_core.join(lexicon.person_tokens, ["doc_id", "token"], "left_anti").withColumn("core", F.lit(True))
    paras = _with_any(paras, lexicon.org_core)
    rows = paras.select(*_PARA, F.posexplode(words(F.col("text"), r"[^\W_]+")).alias("pos", "w")).select(*_PARA, "pos", "w.start", "w.end", "w.gap", "w.token", F.lower("w.token").alias("norm"))
    rows = rows.join(core.select("doc_id", F.col("token").alias("norm"), "core"), ["doc_id", "norm"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    follows = F.col("norm").isin(*(X.DESCRIPTORS - {"&", "and", "of", "the"})) | F.col("token").rlike(r"^(?:(?i)[IVXLC]{1,4}|\d+)$")
    rows = rows.where(F.col("core") | follows)
    line = Window.partitionBy(*_PARA).orderBy("pos")
    blank, both = F.col("gap").rlike(r"(?U)^\s+$"), F.col("gap").rlike(r"(?U)^\s*&\s*$") & F.col("core")
    joined = (F.lag("pos").over(line) == F.col("pos") - 1) & (blank | both)
    rows = rows.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(line))
    group = Window.partitionBy(*_PARA, "run")
    rows = rows.withColumn("begin", F.min(F.when(F.col("core"), F.col("start"))).over(group)).where("start >= begin")
    runs = rows.groupBy(*_PARA, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).join(paras.select(*_PARA, "text"), _PARA)
    legal = F.length(F.regexp_extract(F.expr("substring(text, end + 1)"), rf"{_J}^\s+(?i:{X.LEGAL})", 0))
    runs = runs.withColumn("end", F.col("end") + legal)
    return _as_spans(runs.where(~F.expr("substring(text, start + 1, end - start)").rlike(f"{_J}(?i){X.PUBLIC_BODIES}")), "ORG", BRAND)


def locality_spans(paras: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Learned localities: those that a provider calls places anywhere, the others where a line looks like an address."""
    paras = _with_any(paras, lexicon.localities)
    hinted = paras.where(F.col("text").rlike(_J + X.ADDRESS_HINT))
    if lexicon.place_tokens is None:
        return _as_spans(_leftmost(_token_runs(hinted, lexicon.localities).withColumn("rank", F.lit(0))), "LOCALITY", LOCALITY)
    sure = lexicon.localities.join(lexicon.place_tokens, ["doc_id", "token"], "left_semi")
    other = lexicon.localities.join(lexicon.place_tokens, ["doc_id", "token"], "left_anti")
    found = [_leftmost(_token_runs(p, t).withColumn("rank", F.lit(0))) for p, t in ((paras, sure), (hinted, other))]
    return _as_spans(found[0].unionByName(found[1]), "LOCALITY", LOCALITY)


def learned_spans(paras: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, para_idx and spans of all learned kinds."""
    every = person_spans(paras, lexicon).unionByName(brand_spans(paras, lexicon)).unionByName(locality_spans(paras, lexicon))
    return every.groupBy(*_PARA).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "priority"))).cast(S.SPAN).alias("spans"))
