"""Identity cards: layout rules over lines read from pictures (image, text, score, x0, y0, x1, y1).

Reading pictures and painting them needs libraries that are not part of this package; its work begins with
a table of lines and ends with a table of boxes to cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import spans as S
from .detect import Policy, static_spans
from .lexicon import PERSON, Lexicon, candidate_runs, learned_spans

_J = S.FLAGS
COVER = "array<struct<line:int,x0:int,y0:int,x1:int,y1:int,start:int,end:int,size:int,label:string>>"


def ordered_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """image and lines: per image its readable lines in reading order, each with its offset in the joined text."""
    kept = lines.where((F.col("score") >= least) & (F.trim("text") != "")).withColumn("text", F.trim("text"))
    row = F.floor(F.floor((F.col("y0") + F.col("y1")) / 2) / 12)
    per = kept.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(row.alias("row"), "x0", "y0", "x1", "y1", "text"))).alias("ls"))

    def step(a: Column, l: Column) -> Column:
        at = a["at"]
        one = F.struct(F.size(a["out"]).alias("line"), l["text"].alias("text"), at.alias("start"), *(l[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))
        return F.struct((at + F.length(l["text"]) + 1).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    none = F.array().cast("array<struct<line:int,text:string,start:int,x0:int,y0:int,x1:int,y1:int>>")
    return per.select("image", F.aggregate("ls", F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"]).alias("lines"))


def _cover(l: Column, start: Column, end: Column, label: str | Column) -> Column:
    say = F.lit(label) if isinstance(label, str) else label
    return F.struct(l["line"].alias("line"), *(l[c].alias(c) for c in ("x0", "y0", "x1", "y1")), start.cast("int").alias("start"), end.cast("int").alias("end"), F.length(l["text"]).alias("size"), say.alias("label"))


def _whole(l: Column, label: str) -> Column:
    return _cover(l, F.lit(0), F.length(l["text"]), label)


def _strip(l: Column, left: Column, top: Column, label: str) -> Column:
    """A box above a line, for what can't be read."""
    return F.struct(
        F.lit(-1).alias("line"), F.greatest(left, F.lit(0)).cast("int").alias("x0"), F.greatest(top, F.lit(0)).cast("int").alias("y0"), l["x1"].alias("x1"), l["y0"].alias("y1"),
        F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1).alias("size"), F.lit(label).alias("label"),
    )


def _twin(l: Column) -> Column:
    """The line of another script above a name."""
    return _strip(l, l["x0"], l["y0"] - F.floor(F.lit(X.COVER_ABOVE) * (l["y1"] - l["y0"])), "PERSON")


def _flat(l: Column) -> Column:
    return F.regexp_replace(l["text"], r"(?U)\W", "")


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def _where(items: Column, condition: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.filter(items, condition), make)).cast(COVER)


def _name_runs(texts: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """image and names: any run of name-like words with a known one, capitals allowed, as a picture has no text around it."""
    paras = texts.select(F.col("image").alias("doc_id"), F.lit(0).alias("para_idx"), F.col("joined").alias("text"))
    runs = candidate_runs(paras, lexicon and lexicon.lower_vocab, lexicon and lexicon.place_tokens, allow_caps=True)
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("PERSON").alias("label"), F.lit(PERSON).alias("priority"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).cast(S.SPAN).alias("names")).withColumnRenamed("doc_id", "of")


def covers(lines: DataFrame, detect: Callable[[Column], Column] | None = None, policy: Policy = Policy(), lexicon: Lexicon | None = None) -> DataFrame:
    """One row for each box to cover: image, line, box, start, end and label. lines: as from ordered_lines().

    In mode 'hybrid' candidate names are covered too; a lexicon (its doc_id is the image) adds the names learned
    from the document around the picture. detect takes the place of all this.
    """
    none = F.array().cast(S.SPAN)
    ls = F.col("lines")
    rows = lines.withColumn("joined", F.array_join(F.transform(ls, lambda l: l["text"]), "\n"))
    rows = rows.withColumn("spans", detect(F.col("joined")) if detect else static_spans(F.col("joined"), policy))
    if not detect and policy.mode == "hybrid":
        texts = rows.select("image", "joined")
        if lexicon:
            paras = texts.select(F.col("image").alias("doc_id"), F.lit(0).alias("para_idx"), F.col("joined").alias("text"))
            learned = learned_spans(paras, lexicon).select(F.col("doc_id").alias("of"), F.col("spans").alias("learned"))
            kept = F.filter(F.coalesce("learned", none), lambda s: ~s["label"].isin(*policy.skip_labels) if policy.skip_labels else F.lit(True))
            rows = rows.join(learned, F.col("image").eqNullSafe(F.col("of")), "left").withColumn("spans", F.concat("spans", kept)).drop("of", "learned")
        rows = rows.join(_name_runs(texts, lexicon), F.col("image").eqNullSafe(F.col("of")), "left")
        rows = rows.withColumn("spans", F.concat(S.resolve(F.col("spans")), F.coalesce("names", none))).drop("of", "names")
    if not detect:
        rows = rows.withColumn("spans", S.resolve(F.col("spans")))

    def in_lines(s: Column) -> Column:
        under = F.filter(ls, lambda l: (s["start"] < l["start"] + F.length(l["text"])) & (l["start"] < s["end"]))
        return F.transform(under, lambda l: _cover(l, F.greatest(s["start"] - l["start"], F.lit(0)), F.least(s["end"] - l["start"], F.length(l["text"])), s["label"]))

    labelled = lambda l: _flat(l).rlike(_J + X.NAME_LABEL)
    last = lambda l: F.try_element_at(ls, l["line"])  # noqa: E731  # the line before, as places count from 1
    valued = lambda l: (l["line"] > 0) & (F.length(last(l)["text"]) <= 24) & labelled(last(l)) & (_letters(l["text"]) >= 3) & ~labelled(l)
    rows = rows.withColumn("found", F.concat(F.flatten(F.transform("spans", in_lines)).cast(COVER), _where(ls, valued, lambda l: F.array(_whole(l, "PERSON")))))
    hinted = F.exists(ls, lambda l: _flat(l).rlike(_J + X.ID_HINT)) | F.exists("found", lambda f: f["label"].isin("ID_NUMBER", "AADHAAR", "DOB"))

    def ranges(pattern: str, label: str, first: bool = False) -> Column:
        def one(l: Column) -> Column:
            hits = S.matches(l["text"], pattern)
            return F.transform(F.slice(hits, 1, 1) if first else hits, lambda m: _cover(l, m["start"], m["end"], label))

        return F.flatten(F.transform(ls, one)).cast(COVER)

    kin = lambda l: F.regexp_extract(F.trim(l["text"]), _J + X.RELATION, 1)
    related = lambda l: _letters(kin(l)) >= 3
    related_spans = _where(ls, related, lambda l: F.array(_cover(l, F.length(l["text"]) - F.length(kin(l)), F.length(l["text"]), "PERSON"), _twin(l)))
    caps = lambda l: ~related(l) & _flat(l).rlike(r"^\p{Lu}{6,30}$") & ~_flat(l).rlike(_J + X.NOT_NAMES)
    caps_spans = _where(ls, caps, lambda l: F.array(_whole(l, "PERSON"), _twin(l)))
    named = lambda l: (l["line"] > 0) & F.exists("found", lambda f: (f["line"] == l["line"]) & (f["label"] == "PERSON"))
    twins = _where(ls, named, lambda l: F.array(_twin(l)))

    def block(l: Column) -> Column:
        """The lines after an address label, up to the row that holds its PIN."""
        after = F.slice(ls, l["line"] + 2, F.lit(X.ADDRESS_LINES))
        pinned = F.try_element_at(F.filter(after, lambda x: x["text"].rlike(X.CARD_PIN)), F.lit(1))
        inside = F.filter(after, lambda x: pinned.isNull() | (x["line"] <= pinned["line"]) | (x["y0"] <= pinned["y1"]))
        # lines behind the PIN's row end the block, whatever follows them
        over = F.try_element_at(F.filter(after, lambda x: (x["line"] > pinned["line"]) & (x["y0"] > pinned["y1"])), F.lit(1))
        inside = F.filter(inside, lambda x: over.isNull() | (x["line"] < over["line"]))
        return F.concat(F.array(_whole(l, "ADDRESS")), F.transform(inside, lambda x: _whole(x, "ADDRESS")))

    addresses = _where(ls, lambda l: F.lower(l["text"]).contains("address"), block)
    wide = lambda l: l["x0"] - F.floor(F.lit(X.SIGNATURE_LEFT) * (l["x1"] - l["x0"]))
    high = lambda l: l["y0"] - F.floor(F.lit(X.SIGNATURE_ABOVE) * (l["y1"] - l["y0"]))
    signed = _where(ls, lambda l: F.lower(_flat(l)).contains("signature"), lambda l: F.array(_strip(l, wide(l), high(l), "SIGNATURE")))
    extra = F.concat(ranges(X.AADHAAR_LIKE, "AADHAAR", True), ranges(X.FULL_DATE, "DOB"), related_spans, caps_spans, twins, addresses, signed)
    every = F.concat("found", F.when(hinted, extra).otherwise(F.array().cast(COVER)))
    return rows.select("image", F.explode(every).alias("c")).select("image", "c.*")


def boxes(covered: DataFrame, pad: int = X.PAD) -> DataFrame:
    """image, label and the padded pixel box of each cover, by its share of the line's characters."""
    w, n = F.col("x1") - F.col("x0"), F.greatest(F.col("size"), F.lit(1))
    left = F.when(F.col("start") == 0, F.col("x0")).otherwise(F.col("x0") + F.floor(w * F.col("start") / n))
    right = F.when(F.col("end") >= n, F.col("x1")).otherwise(F.col("x0") + F.floor(w * F.col("end") / n))
    return covered.select("image", "label", *(c.cast("int").alias(a) for c, a in ((left - pad, "x0"), (F.col("y0") - pad, "y0"), (right + pad, "x1"), (F.col("y1") + pad, "y1"))))


def image_report(covered: DataFrame) -> DataFrame:
    """image, regions and labels (label -> n)."""
    per = covered.groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("image").agg(F.sum("n").alias("regions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
