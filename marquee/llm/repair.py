"""Token-ID output: Re-Pair grammars per shard, in a binary form that decodes any document without the others.

A shard holds whole documents in ascending doc_id order. Re-Pair replaces frequent adjacent pairs of ids by new
ids (nonterminals); here each round counts all pairs and replaces up to ``PAIRS`` of the most frequent at once, left to
right without overlap. Rounds follow until no pair occurs ``LEAST`` times or a round saves nothing, since a rule takes
three numbers and each use saves one. A shard's binary image is self-describing (little-endian):

    magic "RPG1"; counts of documents, rules, symbols (3 x uint64); first nonterminal (uint32)
    start of each document and the end of the last (uint64), pairs of the rules (2 x uint32 each),
    expansion length of each rule (uint32), symbols (uint32)

The images lie in a Parquet table (one row a shard), because Spark's own writer commits whole tasks and reaches
any store. ``tokens_before`` counts the ids of the shards that precede in the same task; tasks hold ascending
ranges of doc_id, so one sum per task gives global positions.

Defined cases: null and empty texts have the end id alone; rows without doc_id come first; rows that repeat a
doc_id are documents of their own, in the order of their texts; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import written
from marquee.llm.tokens import default_tokenizer, encoder

MAGIC = b"RPG1"
HEAD = struct.Struct("<4s3QI")
SHARDS = ("pid int, shard int, tokens_before long, n_docs int, n_tokens long, doc_ids binary, no_id binary, image binary")
#: Ids after which a shard is closed (a longer document makes a longer shard).
SHARD_IDS = 1 << 20
PAIRS, LEAST = 4096, 6
_SLOTS = 1 << 20


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 20)).astype(np.int64)


def _counted(pair: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, which of them each pair is, and how often each occurs, exactly: the last pair of a slot stands
    for it, and only pairs that differ from their slot's are sorted."""
    stands = np.zeros(_SLOTS, np.uint64)
    stands[slot] = pair
    same = stands[slot] == pair
    rest, inverse, more = np.unique(pair[~same], return_inverse=True, return_counts=True)
    count = np.bincount(slot[same], minlength=_SLOTS)
    used = np.flatnonzero(count)
    number = np.zeros(_SLOTS, np.int64)
    number[used] = np.arange(len(used))
    which = number[slot]
    which[~same] = len(used) + inverse
    return np.concatenate([stands[used], rest]), which, np.concatenate([count[used], more])


def _grouped(seq: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs that begin at places ``at`` (ascending) of ``seq``, whose symbols are ``top`` at most, how often
    each occurs, and the places pair by pair."""
    a, b = seq[at].astype(np.uint64), seq[at + 1].astype(np.uint64)
    wide, far = top.bit_length(), len(seq).bit_length()
    if 2 * wide + far > 64:  # pair and place don't fit one number
        pair = a << np.uint64(32) | b
        each, which, times = _counted(pair, _slot(pair))
        return each, times, at[np.argsort(which, kind="stable")]
    key = (a << np.uint64(wide) | b) << np.uint64(far) | at.astype(np.uint64)
    key.sort()
    at = (key & np.uint64((1 << far) - 1)).astype(np.int64)
    key >>= np.uint64(far)
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    each = key[begin]
    return (each >> np.uint64(wide) << np.uint64(32) | each & np.uint64((1 << wide) - 1), np.diff(np.append(begin, len(key))), at)


def compress(ids: np.ndarray, first: int, pairs: int = PAIRS, least: int = LEAST):
    """Symbols, rules (n x 2) and expansion lengths of the grammar of ``ids``, all below ``first``.

    No pair becomes more frequent later, and new ones lie beside new symbols. So a round counts the places that a round
    before found in a frequent pair and did not replace, and those beside its new symbols (``live``); the counts are
    exact."""
    seq, rules = ids.astype(np.uint32), []
    size = np.ones(1, np.int64)  # expansion length by nonterminal, after one entry for plain ids
    live = np.ones(len(seq), bool)
    n_rules, most = 0, pairs
    while len(seq) > 1:
        places = np.flatnonzero(live[:-1])
        each, times, at = _grouped(seq, places, first + n_rules)
        often = np.flatnonzero(times >= least)
        if not len(often):
            break
        live[places] = False
        live[at[np.repeat(times >= least, times)]] = True
        often = often[np.lexsort((each[often], -times[often]))[:most]]  # ties by the pair itself
        chosen = each[often]
        rule = np.full(len(each), -1, np.int32)
        rule[often] = np.arange(len(often))
        rule = np.repeat(rule, times)
        at, rule = at[rule >= 0], rule[rule >= 0]
        if len(at) * 16 < len(seq):
            order = np.argsort(at)
            hit, rule = at[order], rule[order]
        else:
            by_place = np.full(len(seq), -1, np.int32)
            by_place[at] = rule
            hit = np.flatnonzero(by_place >= 0)
            rule = by_place[hit]
        # runs of adjacent hits overlap: take every second one of a run, from its start
        begin = np.concatenate([[True], np.diff(hit) != 1])
        place = np.arange(len(hit))
        take = (place - np.maximum.accumulate(np.where(begin, place, 0))) & 1 == 0
        hit, rule = hit[take], rule[take]
        keep = np.bincount(rule, minlength=len(chosen)) >= min(least, 4)
        if not keep.all():
            take = keep[rule]
            hit, rule = hit[take], rule[take]
        if not len(hit):
            if len(chosen) == 1:
                break
            most = len(chosen) // 2  # they took each other's places: fewer at once
            continue
        most = pairs
        number = np.cumsum(keep) - 1
        new = chosen[keep]
        seq[hit] = (first + n_rules + number[rule]).astype(np.uint32)
        left = np.ones(len(seq), bool)
        left[hit + 1] = False
        seq, live = seq[left], live[left]
        now = hit - np.arange(len(hit))  # each hit before has taken one symbol away
        live[now] = True
        live[now[now > 0] - 1] = True
        ab = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)
        rules.append(ab)
        size = np.concatenate([size, size[np.maximum(ab - first + 1, 0)].sum(1)])
        n_rules += len(new)
    return (seq, np.concatenate(rules).astype(np.uint32) if rules else np.empty((0, 2), np.uint32),
            size[1:].astype(np.uint32))


def image(ids: np.ndarray, starts: np.ndarray, **how) -> bytes:
    """The binary image of a shard: all ids, and where each document starts (with the end of the last)."""
    first = int(ids.max()) + 1 if len(ids) else 1
    seq, rules, lens = compress(ids, first, **how)
    return b"".join([HEAD.pack(MAGIC, len(starts) - 1, len(rules), len(seq), first), starts.astype("<u8").tobytes(),
                     rules.astype("<u4").tobytes(), lens.astype("<u4").tobytes(), seq.astype("<u4").tobytes()])


class Shard:
    """Decodes a shard's image: ``document(i)`` or ``ids(a, b)`` expands only the symbols that cover them."""

    def __init__(self, blob: bytes):
        magic, docs, n_rules, n_seq, self.first = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard image")
        at = HEAD.size
        self.starts = np.frombuffer(blob, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        rules = np.frombuffer(blob, "<u4", 2 * n_rules, at).astype(np.int64).reshape(-1, 2)
        at += 8 * n_rules
        lens = np.frombuffer(blob, "<u4", n_rules, at).astype(np.int64)
        self.seq = np.frombuffer(blob, "<u4", n_seq, at + 4 * n_rules).astype(np.int64)
        self.lens = np.where(self.seq >= self.first, lens[np.maximum(self.seq - self.first, 0)], 1) if n_rules \
            else np.ones(n_seq, np.int64)
        self.ends = np.cumsum(self.lens)
        # expansions of all rules, one after another; a rule refers to plain ids and earlier rules only
        self.rule_end = np.cumsum(lens)
        self.flat = np.empty(int(lens.sum()), np.uint32)
        done = 0
        while done < n_rules:  # as many rules at a time as refer to finished ones only
            latest = rules[done:].max(1) - self.first
            ready = np.maximum.accumulate(latest) < done
            upto = done + (len(ready) if ready.all() else int(ready.argmin()))
            begin = self.rule_end[done - 1] if done else 0
            self.flat[begin:self.rule_end[upto - 1]] = self._expand(rules[done:upto].ravel())
            done = upto

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = np.maximum(symbols - self.first, 0)
        plain = symbols < self.first
        if plain.all():
            return symbols.astype(np.uint32)
        begin = np.where(rule > 0, self.rule_end[rule - 1], 0)
        lens = np.where(plain, 1, self.rule_end[rule] - begin)
        ends = np.cumsum(lens)
        at = np.repeat(begin - (ends - lens), lens) + np.arange(ends[-1])
        out = self.flat[np.where(np.repeat(plain, lens), 0, at)]
        out[(ends - lens)[plain]] = symbols[plain]
        return out

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self.ends, [a, b - 1], side="right")
        begin = self.ends[i] - self.lens[i]
        return self._expand(self.seq[i:j + 1])[a - begin:b - begin]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        every = self.ids(0, int(self.starts[-1]))
        return (every[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True))


def _shards(batches: Iterator[pa.RecordBatch], path: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    enc, pid, shard, before = encoder(path), TaskContext.get().partitionId(), 0, 0
    end = np.array([end_id], np.uint32)
    who, held, n = [], [], 0

    def close():
        lens = np.fromiter(map(len, held), np.int64, len(held))
        known = np.array([d is not None for d in who])
        return pa.record_batch({
            "pid": pa.array([pid], pa.int32()), "shard": pa.array([shard], pa.int32()),
            "tokens_before": pa.array([before], pa.int64()), "n_docs": pa.array([len(who)], pa.int32()),
            "n_tokens": pa.array([n], pa.int64()),
            "doc_ids": pa.array([np.array([d or 0 for d in who], "<i8").tobytes()], pa.binary()),
            "no_id": pa.array([(~known).astype(np.uint8).tobytes()], pa.binary()),
            "image": pa.array([image(np.concatenate(held), np.concatenate([[0], np.cumsum(lens)]))], pa.binary())})

    for batch in batches:
        for d, got in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
            who.append(d)
            held.append(np.concatenate([got, end]))
            n += len(got) + 1
            if n >= shard_ids:
                yield close()
                shard, before, who, held, n = shard + 1, before + n, [], [], 0
    if who:
        yield close()


def encode_documents(docs: DataFrame, end_id: int = 2, tokenizer_path: str | None = None,
                     shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order, as a table of shard images; return that table."""
    path = tokenizer_path or default_tokenizer()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    return written(placed.mapInArrow(lambda it: _shards(it, path, end_id, shard_ids), SHARDS), "ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["image"])
            starts, ids = shard.starts[:-1], np.frombuffer(row["doc_ids"], "<i8")
            none = np.frombuffer(row["no_id"], np.uint8).astype(bool)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in shard.documents()]
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64(), mask=none),
                                   "start": pa.array(row["before"] + row["tokens_before"] + starts, pa.int64()),
                                   "n_tokens": pa.array(np.diff(shard.starts), pa.int64()),
                                   "ids_crc32": pa.array(crc, pa.int64())})


def decode_documents(shards: DataFrame) -> DataFrame:
    """Read shard images back: ``doc_id, start, n_tokens, ids_crc32`` of every document.

    What is broadcast has one row per writing task, so its size is bounded by the number of partitions.
    """
    per = shards.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    before = per.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias("before"))
    return (shards.join(F.broadcast(before), "pid")
            .select("before", "tokens_before", "doc_ids", "no_id", "image")
            .mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
