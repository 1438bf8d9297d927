"""Plain reference computations that the tests compare with."""
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width=3):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def roots(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows, percent=85, width=3):
    """rows: (doc_id, text) -> {doc_id: (n, component, kept)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, width) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    both = Counter()
    for ds in by.values():
        if len(ds) > 1:
            for i, a in enumerate(ds):
                for b in ds[:i]:
                    both[(min(a, b), max(a, b))] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = roots(sets, links)
    return {d: (len(sets[d]), comp[d], d == comp[d]) for d in sets}, links


def repeated_bytes(rows, length=100):
    """rows: (doc_id, text) -> {doc_id: (bytes, removed, runs, sha256 of the rest)} by a table of all windows."""
    from hashlib import sha256
    first, out = set(), {}
    for d, text in sorted(rows):
        x = (text or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            w = x[i:i + length]
            if hash(w) in first:
                gone[i:i + length] = b"\1" * length
            else:
                first.add(hash(w))
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(x), sum(gone), runs, sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest())
    return out
