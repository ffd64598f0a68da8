"""Word documents as DataFrames: paragraphs and hidden field codes out, edits in.

Files come from Spark's binaryFile source (path, content) and go back as rows of the same shape. Only the
standard library reads and writes them. A paragraph is numbered through body, tables, text boxes, headers
and footers; field codes follow as paragraphs of their own, uncleaned.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import Stages, ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_PART = re.compile(r"word/(?:document|header\d*|footer\d*)\.xml$")
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_IMAGE = re.compile(r"word/media/.+\.(?:png|jpe?g|bmp|tiff?)$", re.I)
_INVISIBLE = {ord(c): None for c in "​‌‍⁠﻿­"} | {0xA0: " ", 0x202F: " "}
SEGMENT = "array<struct<start:int,text:string,editable:boolean>>"
PARAGRAPH = f"doc_id string, para_idx int, field_code boolean, text string, segments {SEGMENT}, error string"
#: Core properties and what they become.
PROPERTIES = {"creator": "Redacted", "lastModifiedBy": "Redacted", "description": "", "keywords": ""}


def read_docx(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path and content of .docx files, of at most so many bytes each."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return (files if most is None else files.where(F.col("length") <= most)).select("path", "content")


def _names(data: bytes) -> None:
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)


def _own(element) -> Iterator:
    """What lies in a paragraph, but not in paragraphs within it."""
    for child in element:
        if child.tag != W + "p":
            yield child
            yield from _own(child)


def _clean(text: str) -> str:
    return re.sub(" {2,}", " ", text.translate(_INVISIBLE))


class Package:
    """An opened document."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.trees: dict[str, ET.Element] = {}
        for name in self._parts():
            data = self.zip.read(name)
            _names(data)
            self.trees[name] = ET.fromstring(data)
        self.paragraphs: list[tuple[bool, list[list]]] = []  # whether a field code; its pieces: start, text, node
        for tree in self.trees.values():
            for p in tree.iter(W + "p"):
                pieces, at = [], 0
                for node in _own(p):
                    kind = node.tag.removeprefix(W)
                    if kind == "t":
                        piece = [at, _clean(node.text or ""), node]
                    elif kind in ("tab", "br", "cr"):
                        piece = [at, "\t" if kind == "tab" else "\n", None]
                    else:
                        continue
                    pieces.append(piece)
                    at += len(piece[1])
                self.paragraphs.append((False, pieces))
        for tree in self.trees.values():
            self.paragraphs += [(True, [[0, node.text, node]]) for node in tree.iter(W + "instrText") if node.text]

    def _parts(self) -> list[str]:
        """The document, the headers and footers that its sections name, and others by their usual names: a part that no section shows may hold personal data."""
        names = self.zip.namelist()
        found = {n for n in names if _PART.match(n)}
        links, main = "word/_rels/document.xml.rels", "word/document.xml"
        if links in names and main in names:
            targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(self.zip.read(links))}
            sections = ET.fromstring(self.zip.read(main)).iter(W + "sectPr")
            named = [targets.get(e.get(_RELATION), "") for s in sections for e in s if e.tag in (W + "headerReference", W + "footerReference")]
            found |= {n for n in (t.removeprefix("/") if t.startswith("/") else f"word/{t}" for t in named) if n in names}
        return sorted(found, key=lambda n: (n != main, n))

    def images(self) -> list[tuple[str, bytes]]:
        return [(n, self.zip.read(n)) for n in self.zip.namelist() if _IMAGE.match(n)]

    def edited(self, edits: dict[int, list[tuple[int, int, str]]], images: dict[str, bytes] | None = None) -> bytes:
        """The document with edits (start, end, new) of its paragraphs made, pictures replaced, properties scrubbed and the preview dropped."""
        images = images or {}
        for i, (code, pieces) in enumerate(self.paragraphs):
            for start, end, new in sorted(edits.get(i, ()), reverse=True):
                for piece in pieces:
                    at, text, node = piece
                    lo, hi = max(start - at, 0), min(end - at, len(text))
                    if node is not None and lo < hi:
                        piece[1], new = text[:lo] + new + text[hi:], ""
            for _, text, node in pieces:
                if node is not None and (not code or i in edits):
                    node.text = text
                    node.set(SPACE, "preserve")
        out = io.BytesIO()
        dropped = set()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            rels = self._without_preview(dropped)
            for name in self.zip.namelist():
                if name in dropped:
                    continue
                if name in self.trees:
                    data = ET.tostring(self.trees[name], encoding="UTF-8", xml_declaration=True)
                elif name == "_rels/.rels" and rels is not None:
                    data = rels
                elif name in images:
                    data = images[name]
                elif name == "docProps/core.xml":
                    data = self._scrubbed(self.zip.read(name))
                else:
                    data = self.zip.read(name)
                z.writestr(name, data)
        return out.getvalue()

    def _without_preview(self, dropped: set[str]) -> bytes | None:
        if "_rels/.rels" not in self.zip.namelist():
            return None
        data = self.zip.read("_rels/.rels")
        _names(data)
        root = ET.fromstring(data)
        for rel in list(root):
            if rel.get("Type", "").endswith("/thumbnail"):
                dropped.add(rel.get("Target", "").lstrip("/"))
                root.remove(rel)
        return ET.tostring(root, encoding="UTF-8", xml_declaration=True)

    @staticmethod
    def _scrubbed(data: bytes) -> bytes:
        _names(data)
        root = ET.fromstring(data)
        for node in root:
            name = node.tag.rpartition("}")[2]
            if name in PROPERTIES:
                node.text = PROPERTIES[name]
        return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """doc_id (the path), para_idx, field_code, text and segments; a broken file gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]):
        segment = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("editable", pa.bool_())]))
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.string(), segment, pa.string()]
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    for i, (code, pieces) in enumerate(Package(content).paragraphs):
                        parts = [{"start": a, "text": t, "editable": n is not None} for a, t, n in pieces]
                        rows.append((path, i, code, "".join(t for _, t, _ in pieces), parts, None))
                except Exception as e:  # noqa: BLE001  # one broken file must not end the job
                    rows.append((path, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "para_idx", "field_code", "text", "segments", "error"])

    return files.select("path", "content").mapInArrow(run, PARAGRAPH)


def docx_images(files: DataFrame) -> DataFrame:
    """doc_id, image, content and error of the pictures in documents; a broken file gives one row with its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(path, name, data, None) for name, data in Package(content).images()]
                except Exception as e:  # noqa: BLE001  # one broken file must not end the job
                    rows.append((path, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["doc_id", "image", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "doc_id string, image string, content binary, error string")


def redacted_files(files: DataFrame, audited: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """path and content of the documents with all replacements made, and with pictures (doc_id, image, content) put in place of theirs.

    A document that can't be edited has no content: it is never passed on as it was.
    """
    edits = audited.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("para_idx", "start", "end", "replacement")).alias("edits"))
    rows = files.select("path", "content").join(edits, "path", "left")
    if images is None:
        rows = rows.withColumn("images", F.array().cast("array<struct<image:string,content:binary>>"))
    else:
        rows = rows.join(images.where("image is not null").groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("image", "content")).alias("images")), "path", "left")

    def run(batches):
        for batch in batches:
            out = []
            for content, edits, pictures in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                by: dict[int, list] = {}
                for e in edits or ():
                    by.setdefault(e["para_idx"], []).append((e["start"], e["end"], e["replacement"]))
                try:
                    out.append(Package(content).edited(by, {p["image"]: p["content"] or b"" for p in pictures or ()}))
                except Exception:  # noqa: BLE001  # told by docx_paragraphs()
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def write_docx(files: DataFrame, folder: str) -> DataFrame:
    """Writes each document (path, content) to a folder of any store, under its own name; path, target and error of each.

    Two documents of one name get the later part of their path before it; a document without content is not written.
    """
    target = F.element_at(F.split("path", "/"), -1)
    same = files.groupBy(target.alias("name")).agg(F.count(F.lit(1)).alias("same"))
    named = files.join(same, target == F.col("name")).select("path", "content", F.when(F.col("same") > 1, F.concat_ws("-", F.substring(F.sha2("path", 256), 1, 8), "name")).otherwise(F.col("name")).alias("name"))

    def run(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            targets, errors = [], []
            for path, content, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, error = f"{root.rstrip('/')}/{name}", None if content is not None else "no content"
                if content is not None:
                    with where.open_output_stream(to) as f:
                        f.write(content)
                targets.append(to if error is None else None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(targets, pa.string()), pa.array(errors, pa.string())], ["path", "target", "error"])

    return named.mapInArrow(run, "path string, target string, error string")


def changed_images(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id and image of pictures whose bytes differ."""
    pair = before.alias("a").join(after.alias("b"), ["doc_id", "image"])
    return pair.where(F.col("a.content") != F.col("b.content")).select("doc_id", "image")


def redact_docx(files: DataFrame, policy=None, stages: Stages | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The redacted files, the audit table (with originals: for trusted eyes only) and a report of the pictures.

    Pictures are redacted where an engine is registered (sources.images), else they stay and the report says so.
    """
    from ..operators.detect import Policy, with_static
    from ..operators.lexicon import learn
    from ..operators.redact import audit
    from . import images as I

    policy = policy or Policy()
    stages = stages or Stages(files.sparkSession, "docx")
    paras = stages.write(with_static(docx_paragraphs(files).where("error is null")))
    lexicon = learn(paras.where("not field_code"), stages=stages) if policy.mode == "hybrid" else None
    audited = stages.write(audit(paras.select("doc_id", "para_idx", "text", "static"), policy, lexicon, stages=stages))
    found = docx_images(files).where("image is not null")
    key = F.concat_ws("!", "doc_id", "image")
    done = I.redact_images(found.select(key.alias("image"), "content"), policy, stages=stages)
    if policy.images and I.available():
        done = stages.write(done)
        placed = found.select("doc_id", F.col("image").alias("name"), key.alias("image")).join(done, "image")
        return redacted_files(files, audited, placed.select("doc_id", F.col("name").alias("image"), "content")), audited, done.drop("content")
    return redacted_files(files, audited), audited, done.drop("content")
