"""Pictures: an interface to readers and painters that are not part of this package, and redaction with them.

Reading text, faces and codes from pixels and painting over them needs libraries that are not here. An
engine brings them: it is made once in each worker, by a function without arguments. Without one, pictures
stay as they are, and their rows say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import Stages
from ..operators import cards
from ..operators.detect import Policy
from ..operators.lexicon import Lexicon


class Engine(Protocol):
    """What reads and paints a picture. Boxes are (x0, y0, x1, y1) in pixels."""

    def lines(self, content: bytes) -> list[tuple[str, float, int, int, int, int]]:
        """Lines of text: text, score and box."""

    def faces(self, content: bytes) -> list[tuple[int, int, int, int]]: ...

    def codes(self, content: bytes) -> list[tuple[int, int, int, int]]: ...

    def paint(self, content: bytes, boxes: list[tuple[int, int, int, int]], blurred: list[tuple[int, int, int, int]]) -> bytes:
        """The picture with boxes covered and faces made unrecognisable."""


_MAKE: list[Callable[[], Engine]] = []
_OPEN: dict[int, Engine] = {}
LINES = "image string, text string, score double, x0 int, y0 int, x1 int, y1 int"


def register_engine(make: Callable[[], Engine] | None) -> None:
    """The engine of this driver's jobs from now on; None: no engine."""
    _MAKE[:] = [] if make is None else [make]


def available() -> bool:
    """Pictures can be read and painted."""
    return bool(_MAKE)


def _engine(make: Callable[[], Engine]) -> Engine:
    key = id(make)
    if key not in _OPEN:
        _OPEN[key] = make()
    return _OPEN[key]


def _read(images: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """image, lines, faces, codes and error of images(image, content); a picture that can't be read gives its error."""
    box = pa.list_(pa.struct([(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")]))
    line = pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64()), *((c, pa.int32()) for c in ("x0", "y0", "x1", "y1"))]))
    boxes = "array<struct<x0:int,y0:int,x1:int,y1:int>>"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lines, faces, codes, errors = [], [], [], []
            for content in batch.column(1).to_pylist():
                try:
                    engine = _engine(make)
                    read = [dict(zip(("text", "score", "x0", "y0", "x1", "y1"), x, strict=True)) for x in engine.lines(content)]
                    found = [[dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in f(content)] for f in (engine.faces, engine.codes)]
                    lines, faces, codes, errors = [*lines, read], [*faces, found[0]], [*codes, found[1]], [*errors, None]
                except Exception as e:  # noqa: BLE001  # one broken picture must not end the job
                    lines, faces, codes, errors = [*lines, None], [*faces, None], [*codes, None], [*errors, f"{type(e).__name__}: {e}"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, line), pa.array(faces, box), pa.array(codes, box), pa.array(errors, pa.string())], ["image", "lines", "faces", "codes", "error"])

    return images.select("image", "content").mapInArrow(run, f"image string, lines array<struct<text:string,score:double,x0:int,y0:int,x1:int,y1:int>>, faces {boxes}, codes {boxes}, error string")


def _painted(rows: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """rows(image, content, boxes, faces, error) with the content painted; unchanged where there is nothing to cover."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out, errors = [], []
            for r in batch.to_pylist():
                content, error = r["content"], r["error"]
                pick = [[(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r[c] or ()] for c in ("boxes", "faces")]
                if error is None and any(pick):
                    try:
                        content = _engine(make).paint(content, *pick)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                out.append(None if error else content)  # what can't be covered is not passed on
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["image", "content", "error"])

    return rows.select("image", "content", "boxes", "faces", "error").mapInArrow(run, "image string, content binary, error string")


def redact_images(images: DataFrame, policy: Policy = Policy(), lexicon: Lexicon | None = None, stages: Stages | None = None) -> DataFrame:
    """image, content, regions, faces, qr, labels and error for every row of images(image, content); image names a row.

    content is null where a picture couldn't be read or painted. With policy.images off, or without an engine,
    contents are as they were and error says why.
    """
    none = F.create_map().cast("map<string,bigint>")
    if not policy.images or not available():
        why = "pictures are off" if not policy.images else "no engine"
        zero = F.lit(0).cast("bigint")
        return images.select("image", "content", zero.alias("regions"), zero.alias("faces"), zero.alias("qr"), none.alias("labels"), F.lit(why).alias("error"))
    make = _MAKE[0]
    stages = stages or Stages(images.sparkSession, "images")
    read = stages.write(_read(images, make))
    lines = read.select("image", F.explode("lines").alias("l")).select("image", "l.*")
    covered = stages.write(cards.covers(cards.ordered_lines(lines), policy=policy, lexicon=lexicon))
    boxes = cards.boxes(covered).groupBy("image").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    # codes are covered like text, faces are blurred
    rows = images.join(read.select("image", "faces", "codes", "error"), "image").join(boxes, "image", "left")
    rows = rows.withColumn("boxes", F.concat(F.coalesce("boxes", F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")), F.coalesce("codes", F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>"))))
    done = _painted(rows, make)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("bigint")
    found = read.select("image", size("faces").alias("faces"), size("codes").alias("qr")).join(cards.image_report(covered), "image", "left")
    return done.join(found, "image").select("image", "content", F.coalesce("regions", F.lit(0)).alias("regions"), "faces", "qr", F.coalesce("labels", none).alias("labels"), "error")
