"""Embedding near-duplicates by iterative quantisation (ITQ) and multi-index Hamming tables.

Unit vectors, less their mean, are turned by a rotation learned on a bounded sample (``SAMPLE`` vectors, first in the
order of a hash of the id) so that signs quantise them best; the signs are the code. Every code is cut into
``TABLES`` substrings, a Hamming table each. Near vectors differ in a few bits, namely those whose coordinate is near
zero. So each vector visits in every table its own substring and all that arise by flipping bits whose squared
coordinates add up to at most ``slack``. Since for a pair the squared coordinates of the differing bits add up, for
both ends together, to less than the squared distance, pairs near the threshold are missed with a probability well
below 1e-3 (see the tests), and closer ones practically never.

Entries and visits meet by (label, table, substring), split into blocks; candidates are ranked anew by the cosine of
the original vectors in double precision. A pair may meet in several tables and from both ends; it is counted where
it meets first, which both ends' codes tell, so neither pairs nor their duplicates are rows: a block returns, for each
of its vectors, the number of links and the smallest id of its part of the block's links. Equal vectors of a label
are one class with a number of copies. Blocks are dealt to as many tasks as keep each at about ``TASK_ROWS`` rows, and
a task looks at ``PAIRS`` near pairs at a time, so its memory does not grow with the input or with dense groups.

Defined cases: vectors that are null, zero, hold null or non-finite components or aren't of the most frequent length,
and rows without label, link with nothing; so do rows without id, whose component is null; rows that repeat an id, its
label and its vector are copies that link with one another; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, written
from marquee.llm.vectors import common_size, exact_products, matrix, usable

TABLES, BITS, SAMPLE, ROUNDS = 4, 16, 4000, 50
ENTRIES, VISITS = 1024, 8192
TASK_ROWS, PAIRS, FLIP_ROWS = 100_000, 1 << 16, 512  # rows of a task, near pairs and flipped rows held at once
_SCALE = float(1 << 26)  # squared coordinates as integers, so that sums don't depend on their order


class Quantiser:
    def __init__(self, sample: np.ndarray, rounds: int = ROUNDS, seed: int = 9):
        d = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(d)
        v = sample - self.mean
        axes = np.linalg.eigh(v.T @ v)[1]
        v = v @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
        for _ in range(rounds if len(sample) else 0):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        self.turn = axes @ turn
        self.tables = min(TABLES, d)
        self.bits = min(BITS, d // self.tables)
        width = d // self.tables
        self.columns = [np.arange(t * width, t * width + self.bits) for t in range(self.tables)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs and integer squared coordinates of unit vectors, [row, table, bit]."""
        y = (x - self.mean) @ self.turn
        y = np.stack([y[:, c] for c in self.columns], 1)
        return y >= 0, np.minimum(y * y * _SCALE, 2**31 - 1).astype(np.int32)

    def key(self, signs: np.ndarray) -> np.ndarray:
        return (signs.astype(np.int64) << np.arange(self.bits)).sum(-1)

    def flips(self, squares: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and masks of all sets of bits of one table whose squares add up to at most ``limit``."""
        row, mask, sum_ = np.arange(len(squares)), np.zeros(len(squares), np.int64), np.zeros(len(squares), np.int64)
        for b in range(self.bits):
            more = sum_ + squares[row, b]
            ok = more <= limit
            row, mask, sum_ = (np.concatenate(x) for x in
                               ((row, row[ok]), (mask, mask[ok] | 1 << b), (sum_, more[ok])))
        return row, mask


def learn(classes: DataFrame, d: int, sample: int = SAMPLE) -> Quantiser:
    few = classes.orderBy(F.xxhash64(F.lit("itq"), "rep"), "rep").limit(sample).select("vector").toArrow()
    x = matrix(few.column("vector"), d) if few.num_rows else np.zeros((0, d))
    return Quantiser(x / np.sqrt((x * x).sum(1, keepdims=True)))


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable over the links i-j, for n nodes."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, i, low[j])
        np.minimum.at(now, j, low[i])
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _near(u: np.ndarray, v: np.ndarray, e: np.ndarray, least: float):
    """Rows ``i, j`` of ``v`` and ``e`` whose vectors are near ``least`` or nearer, ``PAIRS`` products at a time."""
    step = max(1, PAIRS // len(e))
    theirs = u[e].T
    for a in range(0, len(v), step):
        i, j = np.nonzero(u[v[a:a + step]] @ theirs >= least - 1e-9)
        if len(i):
            yield v[a:a + step][i], e[j]


def near_duplicates(rows: DataFrame, least: float = 0.93, slack: float | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, vector, label)``."""
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"),
                       F.col("label"))
    fit = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    d = common_size(fit)
    fit = fit.where(F.size("vector") == d)
    label_type = rows.schema["label"].dataType.simpleString()
    single = rows.schema["vector"].dataType.simpleString() == "array<float>"
    classes = written(fit.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    quantiser = learn(classes, d) if d else None
    limit = int((slack if slack is not None else (2 - 2 * least) / 48) * _SCALE)

    def entries(batches):
        for b in batches:
            x = matrix(b.column("vector"), d)
            signs, _ = quantiser.encode(x / np.sqrt((x * x).sum(1, keepdims=True)))
            key = quantiser.key(signs)
            for t in range(quantiser.tables):
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(np.full(len(x), t, np.int32)), pa.array(key[:, t]),
                                                  b.column("rep")], names=["label", "t", "key", "rep"])

    def visits(batches):
        for b in batches:
            x = matrix(b.column("vector"), d)
            signs, squares = quantiser.encode(x / np.sqrt((x * x).sum(1, keepdims=True)))
            key = quantiser.key(signs)
            for t, low in ((t, low) for t in range(quantiser.tables) for low in range(0, len(x), FLIP_ROWS)):
                row, mask = quantiser.flips(squares[low:low + FLIP_ROWS, t], limit)
                row = row + low
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("label").take(at), pa.array(np.full(len(row), t, np.int32)), pa.array(key[row, t] ^ mask),
                     b.column("rep").take(at), pa.array(mask == 0)], names=["label", "t", "key", "rep", "home"])

    if not d:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    spot = ["label", "t", "key"]
    index = written(classes.select("label", "vector", "rep").mapInArrow(entries, f"label {label_type}, t int, key long, rep long"),
                    "index")
    size = index.groupBy(*spot).agg(F.count(F.lit(1)).alias("size"))
    asked = written(classes.select("label", "vector", "rep")
                    .mapInArrow(visits, f"label {label_type}, t int, key long, rep long, home boolean")
                    .join(size, spot).where("not home or size > 1").select(*spot, "rep", "size"), "visits")
    blocks = (asked.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
              .select(*spot, "n", "size", F.ceil(F.col("size") / ENTRIES).cast("int").alias("eb"), F.ceil(F.col("n") / VISITS).cast("int").alias("vb")))
    blocks = written(blocks, "blocks")
    # vectors of floats move as floats, which is exact
    own = classes.select("label", "rep", F.col("vector").cast(rows.schema["vector"].dataType if single else "array<double>").alias("vector"), "copies")
    dealt = blocks.drop("n", "size")
    left = (index.join(dealt, spot).withColumn("e", F.pmod(F.xxhash64("rep"), F.col("eb")).cast("int"))
            .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).drop("eb", "vb").withColumn("visit", F.lit(False)))
    right = (asked.drop("size").join(dealt, spot).withColumn("v", F.pmod(F.xxhash64("rep"), F.col("vb")).cast("int"))
             .withColumn("e", F.explode(F.sequence(F.lit(0), F.col("eb") - 1))).drop("eb", "vb").withColumn("visit", F.lit(True)))
    meet = left.unionByName(right).join(own, ["label", "rep"])

    def link(batches):
        """One partition: groups of entries and visits, told by their spot and block."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        unit, coded = [], []
        for b in held:  # each batch's lists are turned into its unit vectors and code at once
            x = matrix(b.column("vector"), d)
            unit.append(x / np.sqrt((x * x).sum(1, keepdims=True)))
            coded.append(quantiser.encode(unit[-1]))
        t = pa.Table.from_batches(held).drop_columns(["vector"])
        held.clear()
        u, signs, squares = np.concatenate(unit), *(np.concatenate(c) for c in zip(*coded, strict=True))
        unit, coded = [], []
        rep, copies, visit = (t.column(c).to_numpy() for c in ("rep", "copies", "visit"))
        table = t.column("t").to_numpy()
        group = pd.DataFrame({c: t.column(c).to_pandas() for c in (*spot, "e", "v")}).groupby([*spot, "e", "v"], sort=False).ngroup().to_numpy()
        order = np.lexsort((visit, group))
        cut = np.flatnonzero(np.diff(group[order], prepend=-1))
        slot = np.empty(len(order), np.int64)
        ids, links, lows = [], [], []
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            own = order[a:b]
            e, v = own[~visit[own]], own[visit[own]]
            if not len(e) or not len(v):
                continue
            node = n = low = None
            for i, j in _near(u, v, e, least):
                if node is None:
                    node, slot[own] = np.unique(rep[own], return_inverse=True)
                    n, low = np.zeros(len(node), np.int64), np.arange(len(node))
                ok = (rep[i] != rep[j]) & (exact_products(u[i], u[j]) >= least)
                i, j = i[ok], j[ok]
                # where does this pair meet first, and which end visits there?
                differ = signs[i] != signs[j]
                goes = np.where(differ, squares[i].astype(np.int64), 0).sum(2) <= limit
                comes = np.where(differ, squares[j].astype(np.int64), 0).sum(2) <= limit
                first = (goes | comes).argmax(1)
                at = np.arange(len(i))
                here = (first == table[i]) & goes[at, first] & (~comes[at, first] | (rep[i] < rep[j]))
                i, j = i[here], j[here]
                for x_, y_ in ((i, j), (j, i)):
                    n += np.bincount(slot[x_], copies[y_], len(node)).astype(np.int64)
                low = _parts(len(node), np.concatenate([np.arange(len(node)), slot[i]]), np.concatenate([low, slot[j]]))
            if node is not None:
                ids.append(node[n > 0])
                links.append(n[n > 0])
                lows.append(node[low[n > 0]])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, links, lows)], names=["rep", "n", "low"])

    rows_met = blocks.agg(F.sum(F.col("size") * F.col("vb") + F.col("n") * F.col("eb"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows_met // TASK_ROWS))
    found = written(meet.repartition(parts, *spot, "e", "v").select(*spot, "e", "v", "visit", "rep", "vector", "copies")
                    .mapInArrow(link, "rep long, n long, low long"), "found")
    total = found.groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    named = (classes.select("label", "vector", "rep", "copies").join(total, "rep", "left")
             .join(label, F.col("rep") == F.col("id"), "left")
             .select("label", "vector", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = base.join(named, ["label", "vector"], "left")
    linked = F.col("vec_id").isNotNull() & F.col("n_links").isNotNull()
    return (out.select("vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
                       F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
