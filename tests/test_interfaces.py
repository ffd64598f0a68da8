"""Streams, providers, extensions, files, pictures and the command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright import __main__ as cli
from maskwright.operators import evaluate, patterns, pseudonyms, redact
from maskwright.operators.detect import Policy, detect, entities, paragraphs
from maskwright.sources import docx, images, json_files
from maskwright.streaming import redact as stream
from tests.test_redaction import _package

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_stream_of_lines_and_counts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "mail jane@real.org"), (2, "2024-01-01 00:02:00", "Server 10.0.0.1 and 10.0.0.2"), (3, "2024-01-01 00:30:00", None), (4, "2024-01-01 00:31:00", "")]
    spark.createDataFrame(rows, "id long, at string, text string").selectExpr("id", "CAST(at AS timestamp) AS ts", "text").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long, ts timestamp, text string").parquet(f"{tmp_path}/in")
    out = stream.redact_lines(source)
    done = out.writeStream.format("memory").queryName("redacted_rows").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    counted = stream.label_counts(out).writeStream.format("memory").queryName("label_rows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    done.awaitTermination(120)
    counted.awaitTermination(120)
    got = {r.id: (r.redacted, r.labels) for r in spark.table("redacted_rows").collect()}
    assert "real.org" not in got[1][0] and got[1][1] == ["EMAIL"] and got[2][1] == ["IP_ADDRESS"] * 2 and got[3][0] is None and got[4] == ("", [])
    assert {(r.label, r.n) for r in spark.table("label_rows").collect()} == {("EMAIL", 1), ("IP_ADDRESS", 2)}
    # a stream's fakes are those of the batch
    batch = {r.id: r.redacted for r in stream.redact_lines(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert batch == {i: t for i, (t, _) in got.items()}


def test_micro_batches_learn_and_leave_nothing(spark, tmp_path):
    from tests.test_redaction import _files

    spark.createDataFrame([(None, "Signed by Tara Mohan.\nmail tara@mohan.in"), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    kept, before = [], _files(spark)
    run = stream.learn_and_redact(lambda rows, k: kept.extend(rows.collect()))
    source = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    source.writeStream.foreachBatch(run).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(180)
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"] and not any("Mohan" in (r.text or "") or "tara" in (r.text or "") for r in kept)
    assert _files(spark) == before


def test_provider_mode(spark):
    docs = spark.createDataFrame([(1, "Quillon met Orrick Widgets Limited at 10.0.0.1")], "doc_id long, text string")
    paras = paragraphs(docs)
    with pytest.raises(ValueError):
        detect(paras, Policy(mode="ner"))
    provided = spark.createDataFrame([(1, 0, [(0, 7, "PERSON", 30)])], "doc_id long, para_idx int, spans array<struct<start:int,end:int,label:string,priority:int>>")
    assert {(r.label, r.original) for r in entities(detect(paras, Policy(mode="ner"), provided)).collect()} == {("PERSON", "Quillon"), ("IP_ADDRESS", "10.0.0.1")}
    lines = redact.apply(paras, redact.audit(paras, Policy(mode="ner"), provider=provided)).first().redacted
    assert "Quillon" not in lines and "Orrick Widgets Limited" in lines
    assert not entities(detect(paras, Policy(mode="ner", skip_labels=frozenset({"PERSON", "IP_ADDRESS"})), provided)).collect()


def test_own_detector_and_faker(spark):
    docs = spark.createDataFrame([(1, "badge BX-1234 of mine, badge QX-9999 too")], "doc_id long, text string")
    rule = patterns.register_detector("badge", "BADGE", r"\b[A-Z]X-\d{4}\b", 95, valid=lambda v: ~v.startswith("Q"))
    try:
        assert [r.original for r in entities(detect(paragraphs(docs), Policy(mode="regex"))).collect()] == ["BX-1234"]
        unfaked = redact.redact(docs, Policy(mode="regex")).first().text  # no faker of its own: character by character
        assert "BX-1234" not in unfaked and "QX-9999" in unfaked
        pseudonyms.register_faker("BADGE", lambda value, seed: F.lit("BADGE-0"))
        assert "badge BADGE-0 of mine" in redact.redact(docs, Policy(mode="regex")).first().text
    finally:
        patterns.RULES.remove(rule)
        pseudonyms.FAKERS.pop("BADGE", None)


def _with_header() -> bytes:
    out = io.BytesIO(_package("<w:p><w:r><w:t>mail jane@real.org</w:t></w:r></w:p>"))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r7" Type="x/header" Target="topline.xml"/></Relationships>')
        z.writestr("word/topline.xml", f"<w:hdr {W}><w:p><w:r><w:t>SSN 123-45-6789</w:t></w:r></w:p></w:hdr>")
        z.writestr("word/media/image1.png", b"picture of Tara Mohan")
        z.writestr("word/media/image2.png", b"broken")
    body = out.getvalue()
    again = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(body)) as old, zipfile.ZipFile(again, "w") as z:
        for name in old.namelist():
            data = old.read(name)
            if name == "word/document.xml":
                data = data.replace(b"</w:body>", b'<w:sectPr><w:headerReference r:id="r7"/></w:sectPr></w:body>').replace(b"<w:document ", b'<w:document xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" ')
            z.writestr(name, data)
    return again.getvalue()


class _Engine:
    """Reads the bytes as a line of text; paints by writing the boxes."""

    def lines(self, content):
        if content == b"broken":
            raise ValueError("no picture")
        return [("Letter", 0.9, 0, 0, 90, 20), (content.decode()[11:], 0.9, 0, 40, 90, 60)]

    def faces(self, content):
        return [(1, 2, 3, 4)]

    def codes(self, content):
        return []

    def paint(self, content, boxes, blurred):
        return f"painted {len(boxes)} {len(blurred)}".encode()


def test_documents_with_pictures_to_a_folder(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name in ("in/a.docx", "in/sub/a.docx"):
        (tmp_path / name).write_bytes(_with_header())
    (tmp_path / "in/b.docx").write_bytes(b"broken")
    (tmp_path / "in/big.docx").write_bytes(b"x" * 100_000)
    files = docx.read_docx(spark, str(tmp_path / "in"), most=50_000)
    assert files.count() == 3
    told = {(r.image, r.error is None) for r in docx.docx_images(files).collect()}
    assert told == {("word/media/image1.png", True), ("word/media/image2.png", True), (None, False)}
    done, _, report = docx.redact_docx(files, Policy(mode="regex"))
    assert {r.error for r in report.collect()} == {"no engine"} and not images.available()
    images.register_engine(_Engine)
    try:
        done, audited, report = docx.redact_docx(files)
        rows = {r.image.split("!")[1]: r for r in report.collect()}
        assert rows["word/media/image1.png"].error is None and rows["word/media/image1.png"].faces == 1 and rows["word/media/image1.png"].labels == {"PERSON": 1}
        assert "no picture" in rows["word/media/image2.png"].error
        out = {r.path.split("/")[-2]: r for r in docx.write_docx(done, str(tmp_path / "out")).collect() if r.error is None}
        assert {r.error for r in docx.write_docx(done, str(tmp_path / "out2")).collect()} == {None, "no content"}
        assert len({r.target for r in out.values()}) == 2
        z = zipfile.ZipFile(out["in"].target)
        assert b"real.org" not in z.read("word/document.xml") and b"6789" not in z.read("word/topline.xml")
        assert z.read("word/media/image1.png") == b"painted 1 1" and z.read("word/media/image2.png") == b""
        changed = docx.changed_images(docx.docx_images(files), docx.docx_images(done))
        assert {r.image for r in changed.collect()} == {"word/media/image1.png", "word/media/image2.png"}
        off = images.redact_images(spark.createDataFrame([("x", bytearray(b"p"))], "image string, content binary"), Policy(images=False)).first()
        assert bytes(off.content) == b"p" and off.error == "pictures are off"
    finally:
        images.register_engine(None)


def test_json_in_and_out(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"text": "mail a@b.co", "pii": [{"start": 5, "end": 11, "label": "EMAIL", "pool": "x"}]}, {"text": "none", "pii": []}]))
    items = json_files.read_items(spark, str(tmp_path / "items.json"))
    lines = items.select(F.monotonically_increasing_id().alias("doc_id"), F.lit(0).alias("para_idx"), "text", F.col("pii").alias("gold"))
    scored, words = evaluate.evaluate_set(lines)
    both = evaluate.pooled(scored.unionByName(scored))
    assert {(r.mode, r.matching, r.tp, r.f1) for r in both.where("label = 'EMAIL'").collect()} == {(m, k, 2, 1.0) for m in ("regex", "hybrid") for k in ("relaxed", "strict")}
    assert {(r.mode, r.tp, r.tn) for r in words.collect()} == {("regex", 1, 2), ("hybrid", 1, 2)}
    json_files.write_metrics(both, f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").count() == both.count()
    (tmp_path / "gold.json").write_text('[{"para": 3, "substring": "x", "label": "ORG"}]')
    assert [tuple(r) for r in json_files.read_gold(spark, str(tmp_path / "gold.json")).collect()] == [(3, "x", "ORG")]
    paras = paragraphs(lines.withColumnRenamed("text", "t"), text="t")
    audited = redact.audit(paras, Policy(mode="regex"))
    json_files.write_audit(audited, f"{tmp_path}/audit")
    json_files.write_audit(audited, f"{tmp_path}/audit2", originals=True)
    assert "original" not in spark.read.json(f"{tmp_path}/audit").columns and spark.read.json(f"{tmp_path}/audit2").first().original == "a@b.co"


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "mail a@b.co"), (None, "Server 10.0.0.1"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    assert cli.main([f"{tmp_path}/in", "-o", f"{tmp_path}/out", "--mode", "regex", "--skip", "IP_ADDRESS"]) == 0
    got = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert "a@b.co" not in got[1] and got[None] == "Server 10.0.0.1" and got[2] is None
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.docx").write_bytes(_package("<w:p><w:r><w:t>mail jane@real.org</w:t></w:r></w:p>"))
    assert cli.main([f"{tmp_path}/docs", "-o", f"{tmp_path}/done", "--docx", "--audit", f"{tmp_path}/audit"]) == 0
    assert "EMAIL\t1" in capsys.readouterr().out and (tmp_path / "done/a.docx").exists() and spark.read.json(f"{tmp_path}/audit").count() == 1
    with pytest.raises(SystemExit):
        cli.main(["in"])


def test_recall_by_pool_and_counts(spark):
    span = "array<struct<start:int,end:int,label:string>>"
    rows = spark.createDataFrame([([(0, 4, "PERSON")], [(0, 4, "PERSON", "a"), (9, 12, "PERSON", "b")]), ([(0, 2, "ORG")], [(0, 2, "PERSON", "a")])], f"pred {span}, gold array<struct<start:int,end:int,label:string,pool:string>>")
    assert {(r.pool, r.n, r.recall) for r in evaluate.recall_by_pool(rows).collect()} == {("a", 2, 0.5), ("b", 1, 0.0)}
    found = spark.createDataFrame([("A",), ("B",), ("B",)], "label string")
    assert [(r.label, r.n) for r in redact.counts(found).collect()] == [("B", 2), ("A", 1)]
