"""Fill-in-middle (op12) against plain string slices, and the learned rank index against the offsets."""
import random
from hashlib import sha256

import numpy as np
import pytest

from marquee.llm import fim


def plain(d, text):
    """The contract's row for one document, by Python strings."""
    x = text or ""
    n = len(x)
    digest = sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in x for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, a, b = "plain", x, None, None
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{x[b:]}<P>{x[:a]}<M>{x[a:b]}"
    else:
        form, out = "psm", f"<P>{x[:a]}<S>{x[b:]}<M>{x[a:b]}"
    sha = [sha256(t.encode()).hexdigest() for t in (out, x)]
    return (d, n, form, a, None if a is None else b - a, *sha)


def texts():
    r = random.Random(2)
    kinds = ["abc de", "äöüß ", "中文字 ", "🙂🙃", "a🙂中é"]
    out = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(300))) for _ in range(150)]
    # long stretches of one width each make several segments; text that looks like parts of a marker
    out.append("".join(k * 4000 for k in ("a", "中", "é", "🙂", "b", "字")))
    out += ["<", "<P", "<S<M", "<P>x", "a<M>", ">P<S" * 40, "x" * (3 << 20), "🙂" * 700_000 + "a" * 900_000]
    return out


@pytest.mark.parametrize("block", [1, 1000, fim.BLOCK])
def test_rows_against_string_slices(docs, edge, block):
    rows = list(enumerate(texts() if block > 1 else texts()[:-2])) + edge
    out = fim.transformed(docs(rows, extra=True), block=block)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha256(r.output.encode()).hexdigest()) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str(plain(d, t)[:6]) for d, t in rows)


def test_report_restores_every_text(docs, edge):
    rows = list(enumerate(texts()[:-2])) + edge
    got = [tuple(r) for r in fim.report(docs(rows)).collect()]
    assert sorted(map(str, got)) == sorted(str(plain(d, t)) for d, t in rows)
    forms = {r[2] for r in got}
    assert forms == {"plain", "psm", "spm"} and fim.report(docs([])).collect() == []


@pytest.mark.parametrize("error", [0, 3, fim.ERROR])
def test_index_is_exact_and_small(error):
    r = np.random.default_rng(1)
    for widths in (np.ones(50_000, int), r.integers(1, 5, 50_000), np.repeat(r.integers(1, 5, 50), 1000), np.ones(0, int), np.ones(1, int)):
        y = np.concatenate([[0], np.cumsum(widths)])
        index = fim.RankIndex(y, error)
        assert (index.offset(np.arange(len(y))) == y).all() and np.abs(index.residual).max() <= error + 1
        first, slope = fim.fit(y, error)
        at = np.searchsorted(first, np.arange(len(y)), side="right") - 1
        assert (np.abs(y - y[first][at] - slope[at] * (np.arange(len(y)) - first[at])) <= error + 1e-6).all()
        if error == fim.ERROR:
            assert index.residual.dtype == np.int8 and len(index.first) <= 60
