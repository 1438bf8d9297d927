"""Repeated phrases (op11) against a table of all windows."""
import random
from hashlib import sha256

import numpy as np
import pytest

from marquee.llm import phrases


def words_left(rows, length=20):
    """(doc_id, text) -> {doc_id: (words, removed, sha256 of the rest)} by a set of all windows."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - length + 1):
            run = tuple(w[i:i + length])
            if run in seen:
                gone.update(range(i, i + length))
            seen.add(run)
        out[d] = (len(w), len(gone), sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def shared_passages(seed, n_docs=60):
    """Documents around a few passages, of which each holds a part, a whole or several; some differ in one word."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "中文", "a.b", "<S>"]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([19, 20, 21, 45, 120]))] for _ in range(9)]
    rows = []
    for d in range(n_docs):
        out = []
        for _ in range(r.randrange(4)):
            out += [r.choice(vocabulary) for _ in range(r.randrange(40))]
            p = list(r.choice(passages))
            a = r.randrange(len(p)) if r.random() < 0.4 else 0
            p = p[a:a + r.choice([10, 25, 200])]
            if p and r.random() < 0.3:
                p[r.randrange(len(p))] = "other"
            out += p
        rows.append((d, "".join(w + r.choice([" ", "\n", "\t ", "\x0b"]) for w in out)))
    return rows


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_repeated_words_against_all_windows(docs, sample):
    rows = shared_passages(1) + [(1000 + d, t) for d, t, *_ in sample[:80]] + [(2000 + d, t) for d, t, *_ in sample[:20]]
    rows += [(3000, "ab " * 500), (3001, "ab cd " * 300), (3002, " ".join(map(str, range(19)))), (3003, " ".join(map(str, range(20)))),
             (3004, "x " + " ".join(map(str, range(20))) + " y")]
    want = words_left(rows)
    assert sum(v[1] for v in want.values()) > 3000
    assert got(phrases.report(docs(rows, extra=True))) == want


@pytest.mark.parametrize("length, pieces, most", [(20, 3, 2), (9, 2, 1)])
def test_hot_anchors_are_split_both_ways(docs, length, pieces, most):
    """One passage between changing words, so that its anchors have many segments and, at the rims, many phrases."""
    r = random.Random(4)
    middle = [f"m{i}" for i in range(30)]
    rows = shared_passages(2, 30)
    for d in range(80):
        rim = [str(r.randrange(3)) for _ in range(10)]
        rows.append((500 + d, " ".join(rim + middle + rim[::-1])))
    left = phrases.deduplicated(docs(rows), length, gram=4, pieces=pieces, phrases=most)
    out = {x.doc_id: (x.n_words, x.n_removed, sha256(x.kept).hexdigest()) for x in left.collect()}
    assert out == words_left(rows, length)


def test_edge_texts(docs, edge, spark):
    out = phrases.report(docs(edge, extra=True))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out.collect())
    assert rows == sorted((d or 0, len((t or "").encode().split()), 0) for d, t in edge)
    assert phrases.report(docs([])).collect() == []
    many = " ".join(f"{i}" for i in range(60))
    again = [(5, many), (5, many), (6, many + " more"), (None, many), (None, "z " + many), (7, None)]
    rows = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in phrases.report(docs(again)).collect())
    assert rows == [(5, 60, 0), (5, 60, 0), (6, 61, 60), (7, 0, 0), (99, 60, 60), (99, 61, 60)]


def test_a_text_longer_than_a_block(docs, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 1 << 12)
    r = random.Random(5)
    long = " ".join(str(r.randrange(10**6)) for _ in range(160_000))  # above 1 MiB
    rows = [(1, long), (2, long[5000:300_000]), (3, "w" * 700 + " " + long[100:900])]
    assert got(phrases.report(docs(rows))) == words_left(rows)


def test_segments_cover_every_window_once():
    r = np.random.default_rng(0)
    for _ in range(50):
        texts = [" ".join(str(x) for x in r.integers(0, 4, r.integers(0, 80))).encode() for _ in range(6)]
        for _, _, h, ends in phrases.word_hashes(texts):
            text, start, n, anchor, whole = phrases.segments(h, ends, 20, 8)
            windows = sorted((int(t), int(s) + i) for t, s, m in zip(text, start, n) for i in range(m))
            assert windows == [(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 19)]
            of = {}  # equal windows have equal anchors, equal segments equal hashes
            for t, s, m, a, c in zip(text.tolist(), start.tolist(), n.tolist(), anchor.tolist(), whole.tolist()):
                w = texts[t].split()
                assert of.setdefault(("c", a, c), tuple(w[s:s + m + 19])) == tuple(w[s:s + m + 19])
                for i in range(s, s + m):
                    assert of.setdefault(tuple(w[i:i + 20]), a) == a
