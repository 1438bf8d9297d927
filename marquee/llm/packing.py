"""Best-fit packing: a configuration linear program over the length histogram, then rounding.

Documents become pieces of at most ``capacity`` tokens (an end id closes each document; only longer documents are
cut, from their end, so the first piece may be shorter). The histogram of piece lengths has at most ``capacity``
rows whatever the corpus, so it alone goes to the driver. There multiplicative weights solve the covering program
(configurations = multisets of lengths that fit; a knapsack dynamic program prices them), the solution is rounded
down, the few pieces left over are packed best-fit, and the outcome is a table of runs: so many equal sequences,
which take these ranks of each length. Pieces are then placed by their rank within their length, on the executors.

Defined cases: null and empty texts have the end id alone; a repeated row is a document of its own; an empty table
gives an empty result; null doc_ids stay null. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import written
from marquee.llm.tokens import default_tokenizer, encoder

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, pid int, at long")
#: Rounds of the program: each raises every length's coverage by its share. Passes: prices taken within a round.
ROUNDS, PASSES = 8, 2
#: A length that is ahead of its round by a whole has lost the weight exp(-EAGER).
EAGER = 4.0


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The unbounded knapsack by dynamic programming: the last length of a best configuration for each capacity.

    0: none fits. One table prices a best configuration around every single length.
    """
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        u = upto[c]
        gain = value[:u] + best[c - lengths[:u]]
        k = gain.argmax()
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], lengths[k]
        else:
            best[c], pick[c] = best[c - 1], -1
    return pick


def traced(pick: list[int], room: int) -> list[int]:
    out = []
    while room > 0 and (k := pick[room]):
        if k < 0:
            room -= 1
        else:
            out.append(k)
            room -= k
    return out


def solve(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, eager: float = EAGER) -> list[tuple[int, tuple[int, ...], float]]:
    """A fractional solution in steps: (round, configuration (lengths, descending), how often).

    Multiplicative weights: a length's value is its size, less by ``exp(-eager * lead)`` for coverage ahead of the
    round. Each pass prices once and takes, for every length that is behind, the best configuration around it, as
    often as its scarcest length allows up to one round ahead.
    """
    need = {k: float(n) for k, n in counts.items() if n > 0}
    left, found, step = dict(need), [], 1 / rounds
    for r in range(1, rounds + 1):
        goal = r * step
        for _ in range(PASSES if left else 0):
            lengths = np.array(sorted(left), np.int64)
            lead = np.array([1 - left[k] / need[k] for k in lengths.tolist()]) - goal + step
            pick = price(lengths, lengths / capacity * np.exp(-eager * np.maximum(0, lead)), capacity).tolist()
            behind = 0
            for length in lengths[::-1].tolist():
                lag = goal - 1 + left.get(length, 0) / need[length]
                if length not in left or lag <= 1e-9:
                    continue
                config = [length, *traced(pick, capacity - length)]
                times = {k: config.count(k) for k in config}
                x = min((min(goal + step, 1.0) - 1 + left.get(k, 0) / need[k]) * need[k] / t for k, t in times.items())
                x = min(x, lag * need[length] / times[length])
                if x <= 1e-9 * need[length]:
                    behind += 1
                    continue
                found.append((r, tuple(sorted(config, reverse=True)), x))
                for k, t in times.items():
                    left[k] -= x * t
                    if left[k] <= 1e-9 * need[k]:
                        del left[k]
            if not behind or not left:
                break
    return found


def best_fit(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on counts: equal sequences are filled together, so the work doesn't grow with the counts."""
    room: list[int] = []  # the free spaces that open sequences have, ascending
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    out: dict[tuple[int, ...], int] = defaultdict(int)

    def keep(content, n):
        free = capacity - sum(content)
        if not free:
            out[content] += n
            return
        if free not in bins:
            insort(room, free)
        at = bins.setdefault(free, {})
        at[content] = at.get(content, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(room, length)
            if at == len(room):
                free, content, n = capacity, (), left  # as many new ones as needed
            else:
                free = room[at]
                content, n = bins[free].popitem()
                if not bins[free]:
                    del bins[free]
                    room.pop(at)
            each = free // length
            full = min(n, left // each)
            if full:
                keep(content + (length,) * each, full)
            left -= full * each
            n -= full
            if n and left:  # the last one takes the rest
                keep(content + (length,) * left, 1)
                left, n = 0, n - 1
            if n and content:
                keep(content, n)
    for at in bins.values():
        for content, n in at.items():
            out[content] += n
    return out


def plan(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Whole configurations that hold exactly ``counts``: the program's solution, rounded.

    Rounding takes the configurations of the first rounds down to whole numbers and packs what remains best-fit;
    of a few such cuts, the one with the fewest sequences is taken. (The last rounds combine what the others
    have left, so a cut before them can be better.)
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    solution, best, fewest = solve(counts, capacity), {}, None
    for last in sorted({ROUNDS, ROUNDS - 1, ROUNDS - 2, ROUNDS * 3 // 4, ROUNDS // 2}):
        left, out, wanted = dict(counts), defaultdict(int), defaultdict(float)
        for r, config, x in solution:
            if r <= last:
                wanted[config] += x
        for config, x in wanted.items():
            times = {k: config.count(k) for k in config}
            n = min([int(x + 1e-6), *(left[k] // t for k, t in times.items())])
            if n > 0:
                out[config] += n
                for k, t in times.items():
                    left[k] -= n * t
        for config, n in best_fit({k: n for k, n in left.items() if n}, capacity).items():
            out[config] += n
        if fewest is None or sum(out.values()) < fewest:
            best, fewest = out, sum(out.values())
    return dict(best)


class Slots:
    """For each length, runs of ranks: where the run's pieces go."""

    def __init__(self, configs: dict[tuple[int, ...], int]):
        rows, seen, first = [], defaultdict(int), 0
        for config, n in sorted(configs.items(), reverse=True):
            offset = 0
            for length in sorted(set(config), reverse=True):
                times = config.count(length)
                rows.append((length, seen[length], first, times, offset))
                seen[length] += times * n
                offset += times * length
            first += n
        rows.sort()
        self.length, self.rank, self.first, self.times, self.offset = (np.array(x, np.int64) for x in zip(*rows)) \
            if rows else (np.empty(0, np.int64),) * 5
        self.sequences = first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these ranks within their lengths."""
        lo = np.searchsorted(self.length, length, side="left")
        hi = np.searchsorted(self.length, length, side="right")
        while (wide := hi - lo > 1).any():  # the last run of the length that begins at or before the rank
            mid = (lo + hi) // 2
            ahead = wide & (self.rank[np.minimum(mid, len(self.rank) - 1)] <= rank)
            lo, hi = np.where(ahead, mid, lo), np.where(wide & ~ahead, mid, hi)
        t = rank - self.rank[lo]
        return self.first[lo] + t // self.times[lo], self.offset[lo] + t % self.times[lo] * length


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, pid, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end = np.array([end_id], "<u4")
    for batch in batches:
        ids, piece, start, length, crc, who = [], [], [], [], [], []
        for d, got in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
            ids = np.concatenate([got, end]).astype("<u4")
            n = len(ids)
            a = 0
            for k in range(-(-n // capacity)):
                b = n - (-(-n // capacity) - k - 1) * capacity
                who.append(d), piece.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                a = b
        length_ = np.array(length, np.int64)
        order = np.argsort(length_, kind="stable")  # rank within the task and length
        at, same = np.empty(len(order), np.int64), np.bincount(length_, minlength=capacity + 1)
        at[order] = np.arange(len(order)) - np.repeat(np.cumsum(same) - same, same)
        at += seen[length_]
        seen += same
        yield pa.record_batch({"doc_id": pa.array(who, pa.int64()), "piece": pa.array(piece, pa.int32()),
                               "start": pa.array(start, pa.int64()), "length": length_, "ids_crc32": pa.array(crc, pa.int64()),
                               "pid": pa.array(np.full(len(who), pid, np.int32)), "at": at})


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    path = tokenizer_path or default_tokenizer()
    pieces = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                     .mapInArrow(lambda it: _cut(it, path, end_id, capacity), PIECES), "pieces")
    per = written(pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(plan(counts, capacity))
    before = per.select("pid", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n"))
                        .alias("before"))
    ranked = pieces.join(before, ["pid", "length"]).withColumn("rank", F.col("before") + F.col("at"))

    def put(batches):
        for b in batches:
            seq, off = slots.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                   pa.array(seq), pa.array(off)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
            .mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
                             "offset long"))
