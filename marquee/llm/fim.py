"""Fill-in-middle: texts cut at two code points and rearranged, the cuts placed by a learned rank index.

A cut is given as a number of code points, a text is UTF-8 bytes. The boundary offsets of a block of texts (the byte at
which each code point starts, and the end) are a sorted list; its rank index is a piecewise-linear function of the rank,
fitted left to right: a segment grows while one slope through its first point stays within ``ERROR`` bytes of all its
offsets (the cone of such slopes is narrowed point by point and isn't empty), then the next begins. What the rounded
prediction misses by is stored as one signed byte per boundary, so a looked-up cut is exact: segment, prediction,
residual. Plain ASCII is one segment; a byte and some segments per boundary replace eight bytes. Blocks of texts are
indexed one after another, so memory follows the block, or the longest text.

Defined cases: null texts are empty; empty texts and texts that hold a marker stay plain; rows without doc_id draw as if
their id had no digits; repeated rows are cut alike; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest error of a segment in bytes; a residual, with rounding, fits a signed byte.
ERROR = 126
#: Bytes of text whose boundaries are indexed together.
BLOCK = 1 << 22
MARKS = (b"<P>", b"<S>", b"<M>")
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_STEP = 1 << 14


def fit(y: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First rank and slope of each segment: every ``y[i]`` is within ``error`` of ``y[first] + slope * (i - first)``."""
    first, slope = [], []
    s, n = 0, len(y)
    while s < n:
        low, high, a, step = -np.inf, np.inf, s + 1, 256
        while a < n:
            b = min(n, a + step)
            run, rise = np.arange(a - s, b - s), y[a:b] - y[s]
            lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
            wrong = lows > highs
            if wrong[-1]:
                k = int(wrong.argmax())
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                a += k
                break
            low, high, a, step = lows[-1], highs[-1], b, min(2 * step, _STEP)
        first.append(s)
        slope.append((low + high) / 2 if a > s + 1 else 0.0)
        s = a
    return np.array(first, np.int64), np.array(slope)


def boundaries(data: np.ndarray) -> np.ndarray:
    """The byte at which each code point of UTF-8 bytes starts, and the end."""
    return np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))


class RankIndex:
    """The i-th of sorted offsets, without the list: segments and a residual each."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        self.first, self.slope = fit(offsets, error)
        self.base = offsets[self.first]
        each = np.diff(np.append(self.first, len(offsets)))
        missed = offsets - self._line(np.arange(len(offsets)), np.repeat(np.arange(len(each)), each))
        self.residual = missed.astype(np.int8 if error <= ERROR else np.int64)

    def _line(self, rank: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return self.base[segment] + np.floor(self.slope[segment] * (rank - self.first[segment])).astype(np.int64)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, rank, side="right") - 1
        return self._line(rank, segment) + self.residual[rank]


def _cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        size, a = 0, 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= block or i == len(texts) - 1:
                yield _block(batch.slice(a, i + 1 - a), texts[a:i + 1])
                size, a = 0, i + 1


def _block(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    data = b"".join(texts)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    offsets = boundaries(np.frombuffer(data, np.uint8))
    rank, index = np.searchsorted(offsets, bounds), RankIndex(offsets)
    del offsets
    n, start = np.diff(rank), rank[:-1]
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4))
    one, two = h1 % (n + 1), h2 % (n + 1)
    one, two = np.minimum(one, two), np.maximum(one, two)
    marked = np.array([any(m in x for m in MARKS) for x in texts], bool)
    plain = (n == 0) | marked | (h3 % 100 >= 100 - PLAIN_PERCENT)
    spm = ~plain & (h4 % 100 < SPM_PERCENT)
    cuts = index.offset(np.concatenate([start + one, start + two])).reshape(2, -1)
    p, s, m = MARKS
    out = []
    for x, a, b, z, is_plain, is_spm in zip(texts, (cuts[0] - bounds[:-1]).tolist(), (cuts[1] - bounds[:-1]).tolist(),
                                            n.tolist(), plain.tolist(), spm.tolist(), strict=True):
        if is_plain:
            out.append(x)
        elif is_spm:
            out.append(b"".join((s, x[b:], p, x[:a], m, x[a:b])))
        else:
            out.append(b"".join((p, x[:a], s, x[b:], m, x[a:b])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    text = pc.cast(pa.array(out, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
         pa.array(one, pa.int64(), mask=plain), pa.array(two - one, pa.int64(), mask=plain), text],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transformed(docs: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document; lengths in code points."""
    number = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return (docs.select(number.alias("doc_id"), F.col("text").cast("string").alias("text"), *draws)
            .mapInArrow(lambda it: _cut(it, block),
                        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"))


def restored(form: Column, output: Column) -> Column:
    """The text, from its output and form alone. No marker can arise across a cut, so the three parts are told apart."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def report(docs: DataFrame) -> DataFrame:
    """The rows of ``transformed`` with digests of the output and of the text rebuilt from it."""
    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                                    sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def oracle() -> str:
    """The same in DuckDB SQL, which cuts by code points itself."""
    h = ", ".join(f"('0x' || substr(sha256('1:' || doc_id), {1 + 8 * i}, 8))::UBIGINT::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, {h} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1, n - b) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""
