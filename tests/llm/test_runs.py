"""op13: runs against a quadratic search, online in any slabs, and the contract's digests."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mercato.llm import op13_runs
from tests.llm.test_llm import CASES, prose


def plain_runs(w, least=12):
    """Every maximal stretch of each period, then the smallest period of equal stretches."""
    got = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                got.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in got.items())


def streams():
    r = random.Random(5)
    fib, tm = "a", "a"
    prev = "b"
    while len(fib) < 300:
        fib, prev = fib + prev, fib
    while len(tm) < 300:
        tm += tm.translate(str.maketrans("ab", "ba"))
    yield from ("", "a", "a" * 11, "a" * 12, "a" * 257, "ab" * 40, fib, tm, tm * 2 + "c" + tm)
    for n, alphabet in [(60, 2), (200, 2), (333, 3), (500, 2)] * 3:
        yield "".join(r.choice("abc"[:alphabet]) for _ in range(n))
    for _ in range(12):
        unit = "".join(r.choice("abcdef") for _ in range(r.randint(1, 70)))
        noise = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))
        text = noise() + unit * r.randint(2, 7) + unit[:r.randint(0, len(unit))] + noise() + unit * 2
        yield text * r.randint(1, 3)


@pytest.mark.parametrize("least", [12, 4])
def test_runs_against_a_quadratic_search(least):
    for w in streams():
        codes = np.array([ord(c) for c in w], np.int64)
        want = plain_runs(w, least)
        for slab in (1, 7, 1 << 16):
            got = op13_runs.find_runs(codes, len(w), least, slab)
            assert sorted((s, q, e) for s, e, q in got.tolist()) == want, (w, slab)


def test_every_period_has_a_catcher():
    for most in (0, 1, 5, 6, 7, 40, 1000):
        of = [p for _, a, b in op13_runs.bands(most) for p in range(a, b + 1)]
        assert sorted(of) == list(range(1, most + 1))
    assert all(2 * (1 << k) - 1 <= max(p, 12 - p) for k, a, b in op13_runs.bands(1000) for p in range(a, b + 1))


def expected(doc, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(b"" if doc is None else str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    keep = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, q, e in runs)]
    best = min(((-(e - s), s, q) for s, q, e in runs), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    top = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha("".join(f"{s},{e - s},{q}\n" for s, q, e in runs).encode()), sha(b" ".join(keep)))


def test_documents_against_brute_force(spark, docs):
    rows = [(i, prose(i, 5 + i * 3)) for i in range(90)] + [(100 + i, (prose(i, 1 + i) + "\n") * 6 + prose(i + 1, 9)) for i in range(30)]
    rows += [(200 + (i or 0), t) for i, t in CASES] + [(300, "na " * 500), (301, "x\x0by\x1cz \x85 " * 9), CASES[7], (300, "na " * 500)]
    out = [tuple(r) for r in op13_runs.periodic_runs(docs(rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(out, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert sum(r[1] > 0 for r in out) > 30
    assert op13_runs.periodic_runs(docs([])).count() == 0


def test_runs_table_names_the_repeated_words(spark, docs):
    got = op13_runs.runs_table(docs([(1, "so " + "buy now " * 8 + "ok"), (2, None), (3, "plain text")])).collect()
    assert [tuple(r) for r in got] == [(1, 1, 16, 2, "buy now")]
