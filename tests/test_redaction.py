"""Fakes, the learned lexicon, whole redaction, Word documents and card rules."""

import io
import re
import zipfile

import pytest

from maskwright.operators import cards, evaluate, lexicon, pseudonyms, redact
from maskwright.operators.detect import Policy, detect, entities, paragraphs
from maskwright.sources import docx

DOC = """Our Promoters are Arjun Wagle Mehta and Priya R. Sharma, who signed the offer.
ARJUN WAGLE MEHTA spoke. The offer was good for Mehta and Wakhele.
Waterloo Industrial Park VI Private Limited owns Waterloo Logistics.
Unit 4, Birdewadi Estate, Chakan, Pune - 411 045, Maharashtra
Plot No. 2 (Birdewadi) near Mr. Tushar Wakhele"""

VALUES = [
    ("PHONE", "+91 22 3075 2929", r"\+91 \d\d \d{4} \d{4}"), ("SSN", "123-45-6789", r"9\d\d-\d\d-\d{4}"), ("CREDIT_CARD", "4111 1111 1111 1111", r"4\d{3}( \d{4}){3}"),
    ("IP_ADDRESS", "10.0.0.1", r"(192\.0\.2|198\.51\.100|203\.0\.113)\.\d+"), ("IP_ADDRESS", "fe80::1", r"2001:db8::[0-9a-f]+"), ("AADHAAR", "2341 2341 2346", r"1\d{3} \d{4} \d{4}"),
    ("ID_NUMBER", "ABCDE1234F", r"[A-Z]{3}DE\d{4}[A-Z]"), ("DOB", "1990-04-12", r"\d{4}-\d\d-\d\d"), ("DOB", "12th April 1990", r"\d+(st|nd|rd|th) [A-Z][a-z]+ \d{4}"),
    ("DOB", "31 February 1990", r"\d\d February \d{4}"), ("ADDRESS", "Maharashtra, India", r"(?!Maha)[A-Za-z ]+, India"), ("PERSON", "Priya R. Sharma", r"[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+"),
    ("PERSON", "SHARMA", r"[A-Z]+"), ("ORG", "Waterloo Industrial Park VI Private Limited", r"[A-Z][a-z]+ Industrial Park VI Private Limited"),
    ("EMAIL", "cs.priya@waterloobank.co.in", r"cs\.[a-z]+@[a-z]+\.example\.com"), ("URL", "https://www.waterloo.com/x?id=1", r"https://www\.[a-z]+\.example\.com/x"),
]


@pytest.fixture(scope="module")
def fakes(spark):
    rows = spark.createDataFrame([(1, a, b) for a, b, _ in VALUES], "doc_id long, label string, original string")
    return {(r.label, r.original): r.replacement for r in pseudonyms.pseudonymise(rows).collect()}


@pytest.mark.parametrize("label,value,shape", VALUES)
def test_fake(fakes, label, value, shape):
    fake = fakes[label, value]
    assert re.fullmatch(shape, fake) and fake != value, fake


def test_names_share_words(fakes):
    assert fakes["PERSON", "Priya R. Sharma"].split()[-1].upper() == fakes["PERSON", "SHARMA"]
    assert fakes["EMAIL", "cs.priya@waterloobank.co.in"].split("@")[0] == "cs." + fakes["PERSON", "Priya R. Sharma"].split()[0].lower()


def test_lexicon(spark):
    paras = paragraphs(spark.createDataFrame([(1, DOC), (2, "Mehta is not known here")], "doc_id long, text string"))
    found = {(r.para_idx, r.label, r.original) for r in entities(detect(paras, Policy(), lexicon.learned_spans(paras, lexicon.learn(paras)))).collect() if r.doc_id == 1}
    for want in [(0, "PERSON", "Arjun Wagle Mehta"), (0, "PERSON", "Priya R. Sharma"), (1, "PERSON", "ARJUN WAGLE MEHTA"), (1, "PERSON", "Mehta"), (2, "ORG", "Waterloo Logistics"), (4, "LOCALITY", "Birdewadi"), (4, "PERSON", "Tushar Wakhele")]:
        assert want in found


def test_runs_of_initials_alone(spark):
    docs = spark.createDataFrame([(1, "Signed by A. B. C. for Priya R. Sharma"), (2, "X. Y.\nJ. K. Sharma Mehta"), (3, "Q. R. S.")], "doc_id long, text string")
    paras = paragraphs(docs)
    runs = lexicon.candidate_runs(paras, lexicon.lower_vocab(paras)).collect()
    assert {(r.doc_id, tuple(r.phrase)) for r in runs} == {(1, ("priya", "r", "sharma")), (2, ("sharma", "mehta"))}
    assert {r.doc_id for r in redact.redact(docs).collect()} == {1, 2, 3}


def _package(body: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/metadata/thumbnail" Target="docProps/t.jpeg"/></Relationships>')
        z.writestr("docProps/t.jpeg", b"x")
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="http://cp" xmlns:dc="http://dc"><dc:creator>Jane Real</dc:creator></cp:coreProperties>')
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx_round_trip(spark):
    body = (
        "<w:p><w:r><w:t>SSN 123-</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>45-6789 stays  bold</w:t></w:r></w:p>"
        '<w:p><w:r><w:instrText>HYPERLINK "mailto:jane@real.org"</w:instrText></w:r><w:r><w:t>kept</w:t></w:r></w:p>'
    )
    files = spark.createDataFrame([("a.docx", bytearray(_package(body))), ("b.docx", bytearray(b"broken"))], "path string, content binary")
    paras = docx.docx_paragraphs(files).collect()
    assert [p.text for p in paras if p.doc_id == "a.docx"] == ["SSN 123-45-6789 stays bold", "kept", 'HYPERLINK "mailto:jane@real.org"']
    assert [p.error is not None for p in paras if p.doc_id == "b.docx"] == [True]
    done, audited, pictures = docx.redact_docx(files, Policy(mode="regex"))
    assert pictures.count() == 0
    rows = {r.path: r.content for r in done.collect()}
    assert rows["b.docx"] is None and {r.label for r in audited.collect()} == {"SSN", "EMAIL"}
    z = zipfile.ZipFile(io.BytesIO(bytes(rows["a.docx"])))
    text = z.read("word/document.xml").decode()
    assert "6789" not in text and "real.org" not in text and "stays bold" in text and "kept" in text
    assert b"Jane" not in z.read("docProps/core.xml") and "docProps/t.jpeg" not in z.namelist()


def test_card_rules(spark):
    lines = ["INCOME TAX DEPARTMENT", "Name", "Arjun Wagle", "01/02/1990", "ABCDE1234F", "Address", "12 Lake Road", "Pune 411045", "Other"]
    rows = spark.createDataFrame([("i", t, 0.9, 30, 30 + 40 * k, 330, 56 + 40 * k) for k, t in enumerate(lines)] + [("j", "nothing", 0.9, 0, 0, 9, 9), ("j", "blurred", 0.1, 0, 20, 9, 29)], "image string, text string, score double, x0 int, y0 int, x1 int, y1 int")
    got = {(r.line, r.label) for r in cards.covers(cards.ordered_lines(rows)).collect() if r.image == "i"}
    assert {(2, "PERSON"), (3, "DOB"), (4, "ID_NUMBER"), (5, "ADDRESS"), (6, "ADDRESS"), (7, "ADDRESS")} <= got and (8, "ADDRESS") not in got and (0, "PERSON") not in {x for x in got if x[0] == 1}


def test_unlabelled_names_on_pictures(spark):
    cards_ = {"a": ["Letter no. 7", "Rahul Sharma", "sent on time"], "b": ["to be paid 12", "RAHUL SHARMA", "100.00"], None: ["no. 3", "Rahul Sharma"], "c": ["no. 4", "Blue Table"]}
    rows = [(i, t, 0.9, 30, 30 + 40 * k, 330, 56 + 40 * k) for i, lines in cards_.items() for k, t in enumerate(lines)]
    frame = spark.createDataFrame(rows, "image string, text string, score double, x0 int, y0 int, x1 int, y1 int")
    seen = lambda got: {(r.image, r.line, r.start, r.end, r.label) for r in got.collect()}
    assert seen(cards.covers(cards.ordered_lines(frame))) == {(i, 1, 0, 12, "PERSON") for i in ("a", "b", None)}
    assert seen(cards.covers(cards.ordered_lines(frame), policy=Policy(mode="regex"))) == set()
    doc = lexicon.learn(spark.createDataFrame([("c", 0, "Ms. Blue Table came. I met Ms. Blue Table there.")], "doc_id string, para_idx int, text string"))
    assert ("c", 1, 0, 10, "PERSON") in seen(cards.covers(cards.ordered_lines(frame), lexicon=doc))


def test_matching(spark):
    mark = evaluate.MARK
    rows = spark.createDataFrame([([(0, 4, "A"), (5, 9, "A"), (20, 22, "B")], [(0, 4, "A"), (6, 9, "A"), (30, 33, "B")])], f"pred {mark}, gold {mark}")
    got = {r.label: (r.tp, r.fp, r.fn, r.f1) for r in evaluate.scores(rows).collect()}
    assert got == {"A": (2, 0, 0, 1.0), "B": (0, 1, 1, 0.0), None: (2, 1, 1, 0.6667)}
    assert {r.label: r.tp for r in evaluate.scores(rows, 1.0).collect()}["A"] == 1


def test_whole_redaction(spark):
    docs = spark.createDataFrame([(1, DOC + "\nmail priya.sharma@wagle.in"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact.redact(docs).collect()}
    assert set(got) == {1, 2, 3} and got[2] == "" and got[3] is None
    for word in ("Arjun", "ARJUN", "Mehta", "Sharma", "sharma", "Waterloo", "Birdewadi", "411 045", "wagle.in"):
        assert word not in got[1], word
    assert "signed the offer" in got[1] and "Industrial Park VI Private Limited" in got[1]


def _files(spark):
    """Files in the shared folder, which hold steps."""
    from pathlib import Path

    from maskwright.deploy import shared_dir

    return {p for p in Path(shared_dir(spark)).rglob("*") if p.is_file()}


def test_no_row_leaks_or_goes(spark):
    """Null and repeated keys, null and empty texts, and columns named like those of the steps."""
    rows = [
        (None, "write to jane@real.org now", "a"), (1, "DOB: 1990-04-12 of Tara Mohan\nand Tara Mohan Saxena", "b"), (1, "x\ntara.mohan@saxena.in and anil@smith.in", "c"), (2, None, "d"),
        (3, "", "e"), (3, "\n\n", "f"), (None, None, "g"), (1, "DOB: 1990-04-12 of Tara Mohan\nand Tara Mohan Saxena", "b"),
    ]
    docs = spark.createDataFrame([(*r, 1, "z", [1]) for r in rows], "doc_id long, text string, row string, para_idx int, key string, spans array<int>")
    for mode in ("regex", "hybrid"):
        before = _files(spark)
        got = redact.redact(docs, Policy(mode=mode))
        seen = sorted((str(r.doc_id), r.text) for r in got.collect() if r.text is not None)
        assert got.count() == len(rows) and sorted(str(r.doc_id) for r in got.where("text is null").collect()) == ["2", "None"]
        assert [t for i, t in seen if i == "3"] == ["", "\n\n"]
        whole = "\n".join(t for _, t in seen)
        for word in ("jane", "real.org", "1990-04-12", "anil", "saxena.in") + (("Tara", "Mohan") if mode == "hybrid" else ()):
            assert word not in whole, word
        ones = [t for i, t in seen if i == "1"]
        assert len(ones) == 3 and len(set(ones)) == 2 and sum(t.startswith("x\n") for t in ones) == 1
        # of the steps nothing is left but the redacted rows
        import pyarrow.parquet as pq

        left = [pq.read_table(p).to_pylist() for p in _files(spark) - before if p.suffix == ".parquet"]
        assert left and all(set(r) == {"doc_id", "text"} and "real.org" not in str(r) for t in left for r in t)


def test_stages_end_with_their_owner(spark):
    from maskwright.deploy import Stages

    before = _files(spark)
    with Stages(spark, "job") as stages:
        out = redact.redact(spark.createDataFrame([(1, DOC)], "doc_id long, text string"), stages=stages)
        assert "Mehta" not in out.first().text
    assert _files(spark) == before


def test_null_scopes_and_unknown_labels(spark):
    rows = [(None, "PERSON", "Tara Mohan"), (None, "EMAIL", "tara@mohan.in"), (7, "PERSON", "Tara Mohan"), (None, "BADGE", "AB-12"), (None, "PERSON", "Tara Mohan"), (7, "PERSON", "12")]
    got = [(r.doc_id, r.label, r.replacement) for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, label string, original string")).collect()]
    assert len(got) == len(rows) and all(new and new not in {o for _, _, o in rows} for _, _, new in got)
    assert len({new for i, l, new in got if i is None and l == "PERSON"}) == 1


def test_name_list(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# list\nZorblat  Quux # two\n\nxyzzy")
    names = lexicon.read_names(spark, str(tmp_path))
    assert names == {"zorblat", "quux", "xyzzy"}
    docs = spark.createDataFrame([(1, "Signed by Zorblat Wakhele today")], "doc_id long, text string")
    paras = paragraphs(docs)
    assert [list(r.phrase) for r in lexicon.learn(paras, gazetteer=names).phrases.collect()] == [["zorblat", "wakhele"]] and lexicon.learn(paras).phrases.count() == 0
    with pytest.raises(ValueError):
        lexicon.read_names(spark, str(tmp_path), most=2)
