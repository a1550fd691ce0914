"""Cutting long texts into overlapping pieces at sentences, paragraphs and headings.

Where a piece begins depends on where the one before it ended, so a text is walked from its start; many texts come at once as Arrow batches.
White space is ASCII's. A null or blank text gives no piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[.!?]\s", re.ASCII)
_HEADING = re.compile(r"\n#{1,6}\s", re.ASCII)
_SPACE = " \t\n\r\f\v"


def _last(pattern: re.Pattern, window: str) -> int:
    at = -1
    for m in pattern.finditer(window):
        at = m.start()
    return at


def embedding_pieces(text: str, size: int = 1440, overlap: int = 160, most: int = 6) -> Iterator[str]:
    """At most ``most`` pieces of ``size`` characters: cut behind a sentence that ends in the last 30 %, else at a blank in the second half."""
    text = text.strip(_SPACE)
    start = 0
    if len(text) <= size:
        most, overlap = (1 if text else 0), 0
    while start < len(text) and most:
        end = min(start + size, len(text))
        if end < len(text):
            window = text[start:end]
            at = _last(_SENTENCE, window)
            blank = window.rfind(" ")
            end = start + at + 1 if at >= size * 7 // 10 else start + blank if blank > size * 0.5 else end
        piece = text[start:end].strip(_SPACE)
        most -= 1
        if piece:
            yield piece
        start += max(end - start - overlap, size * 3 // 10)


def document_pieces(text: str, size: int = 3000, overlap: int = 200) -> Iterator[str]:
    """Pieces of ``size`` characters: cut before the last heading behind 40 %, else at the last paragraph or sentence behind half."""
    text = text.strip(_SPACE)
    if len(text) <= size:
        yield from [text] if text else []
        return
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            window = text[start:end]
            heading, paragraph, sentence = _last(_HEADING, window), window.rfind("\n\n"), _last(_SENTENCE, window) + 1
            end = start + (heading if heading > size * 0.4 else paragraph if paragraph > size * 0.5 else sentence if sentence > size * 0.5 else end - start)
        piece = text[start:end].strip(_SPACE)
        if piece:
            yield piece
        start += max(end - start - overlap, size * 3 // 10)


def chunked(rows: DataFrame, cut: Callable[..., Iterator[str]] = document_pieces, id_col: str = "id", text_col: str = "content", **bounds: int) -> DataFrame:
    """(id, place, total, piece): every text's pieces in order."""
    schema = rows.select(F.col(id_col).alias("id")).schema.add("place", "integer").add("total", "integer").add("piece", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pieces = [list(cut(t or "", **bounds)) for t in part.column(1).to_pylist()]
                row = [i for i, p in enumerate(pieces) for _ in p]
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array([k for p in pieces for k in range(len(p))], pa.int32()), pa.array([len(p) for p in pieces for _ in p], pa.int32()), pa.array([x for p in pieces for x in p], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).mapInArrow(run, schema)
