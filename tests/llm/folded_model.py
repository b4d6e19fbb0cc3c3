"""The four-gram model over a small folded alphabet, as one table of all its grams: what
``cadenza.llm.quality.probabilities`` is checked against."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready
from cadenza.llm.quality import ORDER
from cadenza.llm.words import pieces

SYMBOLS = 48
#: fixed values: the folded alphabet; 0 is the text border
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "éèêàçäöüßñíó"
OTHER_LETTER, DIGIT, UPPER, MARK = 45, 46, 44, 47


def _classes() -> np.ndarray:
    out = np.full(65536, MARK, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if ch.isspace():
            out[c] = 1
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch.isupper():
            out[c] = UPPER
        elif ch.isalpha():
            out[c] = OTHER_LETTER
    for i, ch in enumerate(LETTERS):
        out[ord(ch)] = 2 + i
    for i, ch in enumerate(".,;'"):
        out[ord(ch)] = 2 + len(LETTERS) + i
    out[0] = 0
    return out


_TABLE = None


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-gram codes of all texts (three borders before each) and their text numbers.
    A NUL character in a text counts as a border and is not predicted."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(points < 65536, _TABLE[np.minimum(points, 65535)], MARK).astype(np.int64)
    g = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
    for j in range(ORDER):
        g = g * SYMBOLS + s[j:len(s) - ORDER + 1 + j]
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    text = np.repeat(np.arange(len(texts)), n)[ORDER - 1:]
    real = s[ORDER - 1:] != 0
    return g[real], text[real]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            g, n = np.unique(codes([t or "" for t in part.column("text").to_pylist()])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "n"])


def gram_counts(texts: DataFrame) -> DataFrame:
    arrow_ready(texts.sparkSession)
    return texts.select("text").mapInArrow(_count_rows, "g long, n long").groupBy("g").agg(F.sum("n").alias("c"))


def table_of(orders: list[tuple[DataFrame, DataFrame]]) -> np.ndarray:
    """Log probability of every possible four-gram (bounded by the alphabet), half precision."""
    p = np.full((1, SYMBOLS), 1.0 / SYMBOLS, np.float32)
    for k, (grams, ctx) in enumerate(orders, 1):
        gamma = np.ones(SYMBOLS ** (k - 1), np.float32)
        x = ctx.toPandas()
        gamma[x["ctx"].to_numpy(np.int64)] = x["gamma"].to_numpy(np.float32)
        # a context without its first symbol is the row of the lower order
        low = p if k == 1 else np.tile(p, (SYMBOLS, 1))
        p = gamma[:, None] * low
        s = grams.toPandas()
        p.reshape(-1)[s["g"].to_numpy(np.int64)] = s["p"].to_numpy(np.float32)
        if k < len(orders):
            p = p.reshape(-1, SYMBOLS)
    return np.log(np.maximum(p.reshape(-1), 1e-7)).astype(np.float16)
