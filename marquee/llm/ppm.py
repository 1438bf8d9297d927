"""Language identification by prediction by partial matching (PPM) with frozen statistics.

For every language a variable-order byte context tree is counted: how often each byte follows the last 3, 2, 1
and 0 bytes. A byte's probability is that of the longest context which has seen it; each longer context that was
seen without it costs its escape probability (method C: d distinct successors among n give d / (n + d)), and the
bytes it has seen are excluded from the shorter one, so every context's probabilities add up to 1. The code
length of a text under a language is the sum over all its bytes; the language with the shortest code wins.

The trees are learned once from a bounded sample: per language the ``docs_per_language`` documents that come
first in the order of a hash of doc_id, whole. All 256 byte values are symbols; contexts of one byte are dense, longer
ones sparse, so the frozen arrays that go to the executors are as large as the sample has distinct 4-grams. Every text
is scored whole.

Defined cases: null, empty and letterless texts are ``und`` with score 0; rows with null lang or doc_id are never learned
from, and rows that repeat a doc_id once; without any learned language every text is ``und``; repeated rows are scored alike; ties go to the language
first in order. Input columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents learned from per language, and bytes of text that are scored together.
DOCS_PER_LANGUAGE = 3000
BLOCK = 1 << 19
LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; rows without doc_id are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def _grams(data: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For every byte the 4-gram that ends in it; bytes before a text's start count as 0."""
    x = data.astype(np.uint32)
    out = x.copy()
    at = np.arange(len(x)) - np.repeat(head, np.diff(np.append(head, len(x)))) if len(head) else np.empty(0, int)
    for k in (1, 2, 3):
        back = np.concatenate([np.zeros(k, np.uint32), x[:-k]]) if len(x) > k else np.zeros(len(x), np.uint32)
        out |= np.where(at >= k, back, 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how often each 4-gram occurs, by language."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        for lang in sorted(set(langs)):
            own = [t for t, s in zip(texts, langs, strict=True) if s == lang and t]
            lens = np.fromiter(map(len, own), np.int64, len(own))
            grams, n = np.unique(_grams(np.frombuffer(b"".join(own), np.uint8), np.cumsum(lens) - lens), return_counts=True)
            yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.astype(np.int64),
                                   "n": n.astype(np.int64)})


class Keys:
    """Sorted integers, found again by a table of slots and, where slots are shared, by search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.slots = np.zeros(1 << max(10, int(np.ceil(np.log2(max(len(keys), 1) * 4)))), np.int64)
        self.slots[self._slot(keys)] = np.arange(len(keys))

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * 0x9E3779B1 >> 7) & (len(self.slots) - 1)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each value (0 if there is none) and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = self.slots[self._slot(x)]
        known = self.keys[at] == x
        miss = np.flatnonzero(~known)
        where = np.minimum(np.searchsorted(self.keys, x[miss]), len(self.keys) - 1)
        found = self.keys[where] == x[miss]
        at[miss[found]], known[miss[found]] = where[found], True
        at[~known] = 0
        return at, known


@dataclass
class Model:
    """Frozen code lengths (bits) for every language, by context length; all 256 byte values are symbols.

    ``one[c1, s]`` is the cost of s after the byte c1 when longer contexts have nothing to say; ``leave2[c2, c1]`` what
    leaving a context of two bytes costs (0 where it was never seen). ``three`` are the 3-grams that some language has
    seen, with their whole cost ``cost3`` and what leaving them as contexts costs, ``leave3``; ``four`` the 4-grams with
    ``cost4``. Where a language hasn't seen such a gram, its cost there is that by shorter contexts.
    """

    langs: list[str]
    one: np.ndarray
    leave2: np.ndarray
    three: Keys
    cost3: np.ndarray
    leave3: np.ndarray
    four: Keys
    cost4: np.ndarray

    def _three(self, gram: np.ndarray) -> np.ndarray:
        """Cost of the last byte of 3-grams."""
        at, known = self.three.find(gram)
        bits = self.cost3[at]
        rest = gram[~known]
        bits[~known] = self.one[rest & 0xFFFF] + self.leave2[rest >> 8]
        return bits

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        head = np.cumsum(lens) - lens
        gram = _grams(data, head[lens > 0]).astype(np.int64)
        at, known = self.four.find(gram)
        bits = self.cost4[at]
        rest = np.flatnonzero(~known)
        context, seen = self.three.find(gram[rest] >> 8)
        bits[rest] = self._three(gram[rest] & 0xFFFFFF) + np.where(seen[:, None], self.leave3[context], 0)
        some = np.flatnonzero(lens)
        if len(some):
            out[some] = np.add.reduceat(bits, head[some], axis=0, dtype=np.float64)
        return out


def _level(seen: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One order of a dense tree: ``seen`` counts [context, symbol], ``shorter`` probabilities of the next order.

    Returns probabilities with escape and exclusion, and the factor by which a context's unseen symbols scale.
    """
    total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    rest = 1 - np.where(seen > 0, shorter, 0).sum(1, keepdims=True)
    escape = np.where(rest > 1e-12, kinds / np.maximum(total + kinds, 1), 0.0)
    grown = np.where(rest > 1e-12, escape / np.maximum(rest, 1e-12), 0.0)
    p = np.where(seen > 0, (1 - escape) * seen / np.maximum(total, 1), shorter * grown)
    p = np.where(total > 0, p, shorter)
    return p, np.where(total > 0, grown, 1.0)[:, 0]


def _sparse(gram: np.ndarray, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One order of a sparse tree: the distinct ``gram`` with their counts and the probabilities ``lower`` of their last
    byte by the next shorter context. Gives the cost of each, the contexts, and what leaving these costs."""
    context, inv = np.unique(gram >> 8, return_inverse=True)
    total, kinds = np.bincount(inv, n), np.bincount(inv)
    rest = 1 - np.bincount(inv, lower)
    out = np.where(rest > 1e-12, kinds / (total + kinds), 0.0)  # nothing unseen is left: never left
    with np.errstate(divide="ignore"):
        leave = np.where(out > 0, -np.log2(np.maximum(out, 1e-300) / np.maximum(rest, 1e-12)), 0.0)
    return (1 - out[inv]) * n / total[inv], context, leave


def freeze(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The model from 4-gram counts (``lang`` indexes ``langs``)."""
    k = len(langs)
    three, four = Keys(np.unique(np.concatenate([gram & 0xFFFFFF, gram >> 8]))), Keys(np.unique(gram))
    one, leave2 = np.zeros((1 << 16, k), np.float32), np.zeros((1 << 16, k), np.float32)
    cost3, leave3 = np.zeros((len(three.keys), k), np.float32), np.zeros((len(three.keys), k), np.float32)
    cost4 = np.zeros((len(four.keys), k), np.float32)
    for i in range(k):
        own = lang == i
        code, times = np.unique(gram[own], return_inverse=True)
        w = np.bincount(times, n[own].astype(float))
        pairs = np.bincount(code & 0xFFFF, w, 1 << 16).reshape(256, 256)
        p0, _ = _level(pairs.sum(0)[None], np.full((1, 256), 1 / 256))
        p1, _ = _level(pairs, np.repeat(p0, 256, 0))
        p1 = np.maximum(p1, 1e-12).reshape(-1)
        one[:, i] = -np.log2(p1)
        seen3, of3 = np.unique(code & 0xFFFFFF, return_inverse=True)
        p2, context, leave = _sparse(seen3, np.bincount(of3, w), p1[seen3 & 0xFFFF])
        leave2[context, i] = leave
        cost3[:, i] = one[three.keys & 0xFFFF, i] + leave2[three.keys >> 8, i]
        cost3[three.find(seen3)[0], i] = -np.log2(p2)
        p3, context, leave = _sparse(code, w, p2[of3])
        leave3[three.find(context)[0], i] = leave
        cost4[:, i] = cost3[three.find(four.keys & 0xFFFFFF)[0], i] + leave3[three.find(four.keys >> 8)[0], i]
        cost4[four.find(code)[0], i] = -np.log2(p3)
    return Model(langs, one, leave2, three, cost3, leave3, four, cost4)


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample of ``docs(doc_id, text, lang)``; None without usable rows."""
    known = docs.where("lang is not null and doc_id is not null and text is not null and text <> ''")
    place = F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    # a threshold per language from one count leaves about twice the documents wanted; of these the exact cut is taken
    share = known.groupBy("lang").agg((F.lit(2.0 * docs_per_language) / F.count(F.lit(1))).alias("_share"))
    few = (known.select("lang", "doc_id", place.alias("_h")).join(F.broadcast(share), "lang").where("_h < _share").select("lang", "doc_id", "_h")
           .distinct().withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id")))
           .where(F.col("_r") <= docs_per_language).select("lang", "doc_id"))
    # rows that repeat a doc_id are learned from once, from the text first in order
    sample = known.select("lang", "doc_id", "text").join(F.broadcast(few), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    counts = (sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    if not counts.num_rows:
        return None
    names, lang = np.unique(np.array(counts.column("lang").to_pylist(), object), return_inverse=True)
    return freeze(names.tolist(), lang, counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def predictor(model: Model | None):
    """The function for ``mapInArrow`` over (text, other columns...): adds lang_pred and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value if hasattr(model, "value") else model
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            ask, size = [], 0
            todo = [i for i, t in enumerate(texts) if m and t and LETTER.search(t)]
            for n, i in enumerate(todo):
                ask.append(i)
                size += len(texts[i])
                if size < BLOCK and n + 1 < len(todo):
                    continue
                raw = [texts[j].encode() for j in ask]
                bits = m.lengths(raw)
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
                for j, b, s in zip(ask, best.tolist(), (1 / odds.sum(1)).tolist(), strict=True):
                    pred[j], score[j] = m.langs[b], s
                ask, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names[1:], "lang_pred", "score"])
    return run


def detect(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"))
            .mapInArrow(predictor(shared), "doc_id long, lang_pred string, score double"))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def identify(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Learn from the documents that are not held out, then ``doc_id, held_out, lang_pred, score`` of every one."""
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), docs_per_language)
    return detect(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.5, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """The documents whose language is told with at least ``least`` probability; columns as given."""
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), docs_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    out = T.StructType([T.StructField("_doc", schema), T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return (docs.select(F.col("text").cast("string"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
            .mapInArrow(predictor(shared), out)
            .where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_doc.*"))
