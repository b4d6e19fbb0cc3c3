"""Readers of marked sample streams, over documents as rows of lines.

A document is one file of the original readers, so the running state of a scan never leaves its row; the
cutting itself jumps from boundary to boundary (a binary search in the running lengths), not from line to line."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 5000      # fixed value: buffered characters per unit of the block size


def cut_points(lengths: list[int], marks: list[bool], bound: int) -> list[tuple[int, int]]:
    """``(first, end)`` line ranges of the blocks of one stream.  A block ends before a marker line, or
    before the line at which more than ``bound`` characters are buffered; that line is dropped like a
    marker (the reader does not keep it).  Empty blocks are kept out; the stream's end closes the last."""
    total = [0, *accumulate(lengths)]
    stops = [i for i, m in enumerate(marks) if m] + [len(lengths)]
    out, first, k = [], 0, 0
    while first < len(lengths):
        while stops[k] < first:
            k += 1
        # the first line with more than ``bound`` characters before it, since ``first``
        full = bisect_right(total, total[first] + bound)
        end = min(full, stops[k])
        if end > first:
            out.append((first, end))
        first = end + 1
    return out


def marked_blocks(docs: DataFrame, marker: str, block_size: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, block, first_line, n_lines, text`` of every document (null as empty): its lines cut at lines that begin
    with ``marker`` and wherever more than ``BLOCK_CHARS * block_size`` characters are buffered."""
    bound = BLOCK_CHARS * block_size
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lines = (batch.column(1)[i].as_py() or "").split("\n")
                cuts = cut_points([len(x) for x in lines], [x.startswith(marker) for x in lines], bound)
                if cuts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(cuts), batch.column(0).type), pa.array(range(len(cuts)), pa.int32()),
                         pa.array([a for a, _ in cuts], pa.int32()), pa.array([b - a for a, b in cuts], pa.int32()),
                         pa.array(["\n".join(lines[a:b]) for a, b in cuts], pa.string())], [key, "block", "first_line", "n_lines", "text"])
    return docs.select(key, text_col).mapInArrow(run, f"`{key}` {key_type}, block int, first_line int, n_lines int, text string")


def framed_samples(text: Column, opening: str = "<s>", closing: str = "</s>", mark: str = "#") -> Column:
    """Samples of a text of frames: split at ``closing``, without ``opening``, each from behind its first ``mark``
    (the whole sample if it has none), trimmed; empty ones go."""
    parts = F.transform(F.split(text, closing), lambda p: F.replace(p, F.lit(opening), F.lit("")))
    body = F.transform(parts, lambda p: F.trim(F.when(F.instr(p, mark) > 0, F.substring(p, F.instr(p, mark) + len(mark), F.length(p))).otherwise(p)))
    return F.filter(body, lambda p: p != "")


def multiline_samples(text: Column, closing: str = "</s>") -> Column:
    """Samples of lines: a sample ends with the line that ends with ``closing``; a rest without it is no sample."""
    import re
    end = re.escape(closing)
    pieces = F.split(text, f"(?<={end})\n")
    return F.filter(pieces, lambda p: p.endswith(closing))
