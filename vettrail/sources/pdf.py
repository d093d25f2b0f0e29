"""Files as span and metadata tables, by a parser that is plugged in.

A parser takes a file's bytes and returns (spans, metadata): spans as dicts with the columns of
model.SPANS from span_idx on, in reading order, off-page text included; metadata as a dict of strings.
Any library will do; pymupdf is used where it is installed and none is given. A file that can't be
read, or a system without a parser, is reported as not read and never as a clean document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SPANS

Parser = Callable[[bytes], tuple[list[dict], dict[str, str]]]
_BOX = pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")])
_SPAN = pa.struct([
    ("span_idx", pa.int32()), ("page", pa.int32()), ("text", pa.string()), ("font", pa.string()), ("size", pa.float64()), ("color_rgb", pa.int32()), ("alpha", pa.int32()),
    ("render_mode", pa.int32()), ("bbox", _BOX), ("page_rect", _BOX),
])
_FIELDS = SPANS.split(", ", 1)[1]
_READ = f"document_id string, spans array<struct<{', '.join(x.replace(' ', ':', 1) for x in _FIELDS.split(', '))}>>, metadata map<string,string>, note string"


def installed_parser() -> Parser | None:
    """A parser for PDF files where a library is installed, else none."""
    try:
        import pymupdf
    except ImportError:
        return None

    def parse(content: bytes) -> tuple[list[dict], dict[str, str]]:
        spans, far = [], pymupdf.Rect(-10_000, -10_000, 10_000, 10_000)  # text off the page counts too
        box = lambda r: dict(zip(("x0", "y0", "x1", "y1"), map(float, r)))
        with pymupdf.open(stream=content, filetype="pdf") as document:
            for number, page in enumerate(document, 1):
                parts = [s for b in page.get_text("dict", clip=far)["blocks"] for line in b.get("lines", []) for s in line["spans"]]
                for s in parts:
                    spans.append({
                        "span_idx": len(spans), "page": number, "text": s["text"], "font": s["font"], "size": float(s["size"]), "color_rgb": int(s["color"]), "alpha": int(s.get("alpha", 255)),
                        "render_mode": int(s.get("render_mode", 0)), "bbox": box(s["bbox"]), "page_rect": box(page.rect),
                    })
            return spans, {k: v for k, v in (document.metadata or {}).items() if v}

    return parse


def read_documents(files: DataFrame, parser: Parser | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, metadata, read) of files (path, content): read is (document_id, available, note), one row per file.

    Every file is parsed where it is read; a null content (an upload beyond its bound) isn't read. What is
    returned is parsed anew by each use: write the tables first where several queries follow.
    """
    parser = parser or installed_parser()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, metadata, notes = [], [], []
            for content in batch["content"].to_pylist():
                found, own, note = None, None, None
                if parser is None:
                    note = "no parser is installed"
                elif content is None:
                    note = "the file wasn't read"
                else:
                    try:
                        found, own = parser(content)
                    except Exception as error:  # whatever a parser raises is about this one file
                        note = f"{type(error).__name__}: {error}"
                spans.append(found), metadata.append(None if own is None else [*own.items()]), notes.append(note)
            yield pa.RecordBatch.from_arrays(
                [batch["path"], pa.array(spans, pa.list_(_SPAN)), pa.array(metadata, pa.map_(pa.string(), pa.string())), pa.array(notes, pa.string())], ["document_id", "spans", "metadata", "note"]
            )

    out = files.select("path", "content").mapInArrow(run, _READ)
    spans = out.select("document_id", F.explode("spans").alias("s")).select("document_id", "s.*")
    return spans, out.filter("metadata is not null").select("document_id", "metadata"), out.select("document_id", F.col("note").isNull().alias("available"), F.coalesce("note", F.lit("")).alias("note"))
