"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes become symbols: the byte, and whether the four bytes there also began up to ``LAGS`` bytes
earlier (512 symbols). ``FILTERS`` learned filters of width ``WIDTH`` run over all positions. The document is
covered by overlapping chunks of four blocks of ``BLOCK`` positions, each sharing a block with the next; a filter's
value in a chunk is its maximum there. Mean and maximum over the document's chunks go through a small hidden layer
into one probability. No byte is left out, and long documents are convolved piece by piece.

The network is trained (Adam, logistic loss) on a bounded sample of labelled documents: the ``train_docs`` that
come first in the order of a hash of doc_id, each whole; a step takes ``BATCH`` of them or as many as hold ``BATCH_BYTES``.

Defined cases: null and empty texts are scored as a text without bytes; rows without label or without doc_id
aren't learned from; several labels for a doc_id count as the highest; without any labelled row the score is 0.5;
repeated rows are scored alike. Input columns other than doc_id, text and quality are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS, DIM, WIDTH, FILTERS, HIDDEN = 512, 8, 6, 24, 16
BLOCK, LAGS, PIECE = 32, 20, 1 << 16
#: Labelled documents learned from (whole), steps, and documents and bytes of a step.
TRAIN_DOCS, STEPS, BATCH, BATCH_BYTES, RATE = 2500, 220, 48, 1 << 20, 0.01


def symbols(data: bytes) -> np.ndarray:
    """Symbols of a text, closed by WIDTH zeros, so that every text has a position."""
    x = np.frombuffer(data, np.uint8)
    out = np.zeros(len(x) + WIDTH, np.int32)
    out[:len(x)] = x
    if len(x) >= 6:
        y = x.astype(np.uint32)
        four = y[:-3] | y[1:-2] << np.uint32(8) | y[2:-1] << np.uint32(16) | y[3:] << np.uint32(24)
        again = np.zeros(len(four), bool)
        for lag in range(2, min(LAGS, len(four) - 1) + 1):
            again[lag:] |= four[lag:] == four[:-lag]
        out[:len(four)] += again * np.int32(256)
    return out


class Network:
    def __init__(self, seed: int = 4):
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (SYMBOLS, DIM)), "filter": r.normal(0, 0.3, (WIDTH, DIM, FILTERS)),
                  "bias": np.zeros(FILTERS), "w1": r.normal(0, 0.2, (2 * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN),
                  "w2": r.normal(0, 0.2, HIDDEN), "b2": np.zeros(1)}

    def tables(self) -> list[np.ndarray]:
        """What each symbol adds to each filter, by place in the filter."""
        return [(self.p["embed"] @ w).astype(np.float32) for w in self.p["filter"]]

    def respond(self, tables: list[np.ndarray], sym: np.ndarray, n: int) -> np.ndarray:
        """Filter values at positions 0..n-1 of ``sym`` (which holds WIDTH more)."""
        out = np.take(tables[0], sym[:n], axis=0)
        for k in range(1, WIDTH):
            out += np.take(tables[k], sym[k:k + n], axis=0)
        out += self.p["bias"].astype(np.float32)
        return np.maximum(out, 0, out=out)

    def blocks(self, tables, sym: np.ndarray) -> np.ndarray:
        """Block maxima of one document, piece by piece."""
        n, found = len(sym) - WIDTH + 1, []
        for a in range(0, n, PIECE):
            m = min(PIECE, n - a)
            found.append(np.maximum.reduceat(self.respond(tables, sym[a:a + m + WIDTH - 1], m), np.arange(0, m, BLOCK), axis=0))
        return np.concatenate(found)

    @staticmethod
    def chunks(n: int) -> np.ndarray:
        """The four blocks of each chunk of a document with n blocks (the last chunks repeat its last block)."""
        first = np.arange(0, max(n - 1, 1), 3)
        return np.minimum(first[:, None] + np.arange(4), n - 1)

    def head(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(feats @ self.p["w1"] + self.p["b1"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"], -30, 30)))

    def features(self, tables, sym: np.ndarray) -> np.ndarray:
        block = self.blocks(tables, sym)
        chunk = block[self.chunks(len(block))].max(1)
        return np.concatenate([chunk.mean(0), chunk.max(0)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        tables = self.tables()
        feats = np.stack([self.features(tables, symbols(t)) for t in texts])
        return self.head(feats.astype(np.float64))[1]

    def maxima(self, tables: list[np.ndarray], sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest value of each filter in each block of positions, and its first place; a text of any length is
        gone through in pieces."""
        n, blocks, places = len(sym) - WIDTH + 1, [], []
        for a in range(0, n, PIECE):
            m = min(PIECE, n - a)
            conv = self.respond(tables, sym[a:a + m + WIDTH - 1], m)
            conv = np.pad(conv, ((0, -m % BLOCK), (0, 0)), constant_values=-1).reshape(-1, BLOCK, FILTERS)
            at = conv.argmax(1)
            blocks.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
            places.append(at + a + np.arange(len(at))[:, None] * BLOCK)
        return np.concatenate(blocks), np.concatenate(places)

    def step(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of a batch."""
        tables, g = self.tables(), {}
        kept, feats = [], []
        for sym in docs:
            block, place = self.maxima(tables, sym)
            which = self.chunks(len(block))
            best = block[which].argmax(1)
            chunk = np.take_along_axis(block[which], best[:, None], 1)[:, 0]
            top = chunk.argmax(0)
            kept.append((len(sym), block, place, which, best, top))
            feats.append(np.concatenate([chunk.mean(0), chunk.max(0)]))
        feats = np.stack(feats).astype(np.float64)
        hidden, p = self.head(feats)
        d = (p - y) / len(y)
        g["w2"], g["b2"] = hidden.T @ d, np.array([d.sum()])
        dh = np.outer(d, self.p["w2"]) * (1 - hidden**2)
        g["w1"], g["b1"] = feats.T @ dh, dh.sum(0)
        df = dh @ self.p["w1"].T
        at, who, how = [], [], []
        base = 0
        cols = np.arange(FILTERS)
        for (size, block, place, which, best, top), row in zip(kept, df, strict=True):
            dc = np.repeat(row[None, :FILTERS] / len(which), len(which), 0)
            dc[top, cols] += row[FILTERS:]
            owner = np.take_along_axis(which[:, :, None], best[:, None], 1)[:, 0]
            db = np.zeros(block.shape)
            np.add.at(db, (owner, cols), dc)
            b, f = np.nonzero((block > 0) & (db != 0))
            at.append(place[b, f] + base)
            who.append(f)
            how.append(db[b, f])
            base += size
        at, who, how = np.concatenate(at), np.concatenate(who), np.concatenate(how)
        g["bias"] = np.bincount(who, how, FILTERS)
        sym = np.concatenate(docs)
        g["embed"], g["filter"] = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["filter"])
        for k in range(WIDTH):
            dt = np.bincount(sym[at + k] * FILTERS + who, how, SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
            g["filter"][k] = self.p["embed"].T @ dt
            g["embed"] += dt @ self.p["filter"][k].T
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE,
            seed: int = 4) -> "Network":
        r, docs = np.random.default_rng(seed), [symbols(t) for t in texts]
        m, v, t = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        self.p["b2"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        while t < steps:  # as many passes over the sample as it takes
            for own in batches(r.permutation(len(docs)), [len(d) for d in docs], batch):
                g = self.step([docs[i] for i in own], y[own])
                t += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * min(t / steps, 1)))
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self


def batches(order: np.ndarray, size: list[int], most: int, bytes_: int = BATCH_BYTES) -> Iterator[np.ndarray]:
    """Consecutive documents of ``order``, ``most`` at a time or as many as hold ``bytes_``, but one at least."""
    a, held = 0, 0
    for b, i in enumerate(order.tolist()):
        if b > a and (b - a == most or held + size[i] > bytes_):
            yield order[a:b]
            a, held = b, 0
        held += size[i]
    yield order[a:]


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network from at most ``train_docs`` labelled documents; None without any."""
    marks = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.max("quality").cast("int").alias("quality")))
    few = marks.orderBy(F.xxhash64(F.lit("cnn"), "doc_id"), "doc_id").limit(train_docs)
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
            .select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), "quality")
            .dropDuplicates(["doc_id", "raw"]).orderBy("doc_id", "raw").limit(2 * train_docs).toArrow())
    if not rows.num_rows:
        return None
    return Network().fit(rows.column("raw").to_pylist(), (rows.column("quality").to_numpy() > 0).astype(float))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) == 0


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            got = net.score(texts) if net and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the labelled documents that aren't held out; score every document."""
    network = train(docs.where(~held_out(F.col("doc_id"))), labels, train_docs)
    return score(docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                       (F.col("score") >= threshold).cast("int").alias("predicted"))
