"""Every pipeline stage against plain Python on its own input, and the run as a whole."""
import hashlib
import re
from collections import Counter, defaultdict

import brute
import corpus_pipeline
from marquee.llm.common import written
from test_documents import check_packing, lines_left, varied


def copies_taken(rows, weights=(5, 2, 1), cap=3, seed=6):
    """How often each document is taken: rows (doc_id, text, source)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    by = defaultdict(list)
    for d, _, s in rows:
        by[s].append(d)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[d] for d in by[s]) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        free = sum(total.values()) - cap * sum(total[s] for s in full)
        share = sum(weight[s] for s in order if s not in full) or 1
        more = {s for s in order if s not in full and cap * total[s] * share < weight[s] * free}
        if not more:
            break
        full |= more
    out = {}
    for s in order:
        target = float(cap * total[s]) if s in full else weight[s] * free / share
        whole = int(target // total[s]) if total[s] else 0
        missing, at = target - whole * total[s], 0
        for d in sorted(by[s], key=lambda d: hashlib.md5(f"{seed}:{d}".encode()).hexdigest()):
            out[d] = whole + (at + size[d] / 2 <= missing)
            at += size[d]
    return out


def test_stages_against_plain_python(spark, docs, sample):
    base = [r for r in sample if r[0] < 120]
    rows = base + [(d, t, "en", f"src{d % 5}") for d, t in varied(sample, 3) if d >= 1000]
    rows += [(9000, None, "en", "src1"), (9001, "", "en", "src1"), (9002, "12 + 34", "de", None), (9003, rows[0][1] + "\nmore", "en", None)]
    table, got = docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in table.collect()]
        out = written(stage(spark, table, ""), name)
        got[name] = out.collect()
        if name != "best_fit_packing":
            assert out.columns == table.columns
        after = [(r.doc_id, r.text) for r in got[name]] if name != "best_fit_packing" else None
        if name == "language_id":
            assert {d for d, _ in after} == {d for d, t, _ in before if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            want = lines_left([(d, t) for d, t, _ in before], 2)
            assert dict(after) == {d: want[d] for d, t, _ in before if want[d] or not t}
            assert all(r.n_chars == len(r.text) for r in got[name])
        elif name == "minhash_near_dedup":
            want, links = brute.near_duplicates([(d, t) for d, t, _ in before], 80, 5)
            assert links and sorted(d for d, _ in after) == sorted(d for d in want if want[d][2])
        elif name == "mixing":
            want = copies_taken(before)
            assert Counter(d for d, _ in after) == Counter({d: n for d, n in want.items() if n})
        else:
            used = check_packing([(d, t) for d, t, _ in before], got[name], 2048)
            assert used <= sum(r.length for r in got[name]) / 2048 * 1.02 + 2
        table = out


def test_run_gives_packed_pieces(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    room = Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert got and max(room.values()) <= 2048
