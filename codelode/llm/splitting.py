"""Problem 3: cutting chunks that are over the limit of their suffix into pieces.

Offsets of lines are prefix sums; boundaries are a sorted array of offsets. A piece ends at the last boundary under the
limit (binary search), else at the last blank line, else at the last line start, else hard at the limit; the next one
begins there and repeats up to overlap characters of the piece before, whole lines where that is possible.

Defined results: contents within the limit, null and empty ones and suffixes without a limit have no pieces and no
boundaries; of repeated rows of a chunk the latest is cut; pieces without their repetition, joined, are the content.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.sources.tables import keep_last

from .boundaries import boundaries
from .common import suffix


def cut(text: str, marks: list[int], lines: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first character with the repetition, first new character, end) of each piece; marks and lines are sorted offsets."""
    blank = [lines[k + 1] for k in range(len(lines) - 1) if not text[lines[k] : lines[k + 1]].strip()]
    out: list[tuple[int, int, int]] = []
    overlap = max(0, min(overlap, limit - 1))
    at, n = 0, len(text)
    while at < n:
        begin = at
        if out and overlap:
            begin = max(0, at - overlap)
            k = bisect_left(lines, begin)
            if k < len(lines) and lines[k] < at:
                begin = lines[k]  # repeat whole lines
        top = begin + limit
        end = n
        if top < n:
            end = top
            for places in (marks, blank, lines):
                k = bisect_right(places, top) - 1
                if k >= 0 and places[k] > at:
                    end = places[k]
                    break
        out.append((begin, at, end))
        at = end
    return out


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows over the limit of their suffix, with it. The limits are one row for each suffix; Spark broadcasts them by their size."""
    per = limits.select(F.lower("extension").alias("_ext"), "max_chars", "overlap_chars").where("max_chars > 0").dropDuplicates(["_ext"])
    rows = chunks.select("chunk_id", "rel_path", "content", "start_line", "symbol_name", *(c for c in ("ingested_at",) if c in chunks.columns)).withColumn("_ext", suffix(F.col("rel_path")))
    return rows.join(per, "_ext").where(F.length("content") > F.col("max_chars"))


def boundary_lines(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, line_no): line 1 and each further line with a boundary, for chunks over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            for key, ext, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for k, _ in boundaries(text, ext):
                    ids.append(key)
                    lines.append(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], names=["chunk_id", "line_no"])

    return oversized(chunks, limits).select("chunk_id", "_ext", "content").mapInArrow(run, "chunk_id bigint, line_no int").distinct()


PIECES = "chunk_id bigint, piece int, start_line int, end_line int, symbol_name string, repeated_chars int, content string"


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the chunks over the limit, with their lines in the file (in the content where start_line is null)."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, ext, text, first, symbol, limit, overlap in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                found = boundaries(text, ext)
                lines = [0]
                while (end := text.find("\n", lines[-1])) >= 0:
                    lines.append(end + 1)
                marks, base = [lines[k] for k, _ in found], (first or 1)
                for i, (begin, new, end) in enumerate(cut(text, marks, lines, limit, overlap or 0)):
                    k = bisect_right(marks, new) - 1
                    rows.append((
                        key, i, base + bisect_right(lines, begin) - 1, base + bisect_right(lines, max(begin, end - 1)) - 1,
                        found[k][1] or symbol, new - begin, text[begin:end],
                    ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    columns = ("chunk_id", "_ext", "content", "start_line", "symbol_name", "max_chars", "overlap_chars")
    order = [c for c in ("ingested_at", "content") if c in chunks.columns]
    once = keep_last(oversized(chunks, limits), ["chunk_id"], *map(F.desc_nulls_last, order))
    return once.select(*columns).mapInArrow(run, PIECES)
