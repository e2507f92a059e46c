"""op11: links, groups and corpus counts by the tokenizers' own output and plain Python."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mercato.llm import op11_align
from tests.llm.test_llm import CASES, prose

TOK = Tokenizer.from_file(public_tokenizers.path(op11_align.A_FILE))
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op11_align.B_FILE))
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in VISIBLE} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in VISIBLE)}


def piece(p):
    return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()


def plain(text):
    """(a ids, b ids, links as index pairs) by comparing all byte offsets."""
    if not text:
        return [], [], []
    enc = TOK.encode(" " + text, add_special_tokens=False)
    a, b = enc.ids, SP.encode(text)
    sa, sb = [bytes(BYTE[c] for c in t) for t in enc.tokens], [piece(SP.id_to_piece(i)) for i in b]
    whole = (" " + text).encode()
    if b"".join(sa) != whole or b"".join(sb) != whole:
        return [], [], []
    ends = lambda s: np.cumsum([len(x) for x in s]).tolist()
    at = {e: j for j, e in enumerate(ends(sb))}
    return a, b, [(i, at[e]) for i, e in enumerate(ends(sa)) if e in at]


def written(a, b, links):
    out, i, j = [], 0, 0
    for x, y in links:
        out.append(",".join(map(str, a[i:x + 1])) + "|" + ",".join(map(str, b[j:y + 1])))
        i, j = x + 1, y + 1
    return ";".join(out)


def corpus():
    rows = [(i, prose(i, 10 + 3 * i) + (" café naïve 日本語 x=1;\n\ty==2 " if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100 + (i or 0), t) for i, t in CASES]
    rows += [(200, " lead  two"), (201, "▁mark"), (202, "<unk> <s> <|endoftext|>"), (203, "tab\tnew\r\nline\x00nul"),
             (204, "é ﬁ \U0001F600\U0001F468‍\U0001F469"), (205, "a" * 5000), (206, "日本" * 900), (200, " lead  two"), CASES[7]]
    return rows


@pytest.mark.parametrize("hot", [op11_align.HOT, 40, 0])
def test_alignment_against_plain_python(spark, docs, hot):
    rows = corpus()
    got = op11_align.alignment(docs(rows), hot).collect()
    made = [(i, *plain(t)) for i, t in rows]
    count = Counter((a[x], b[y]) for _, a, b, links in made for x, y in links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    want = []
    for i, a, b, links in made:
        ids = [(a[x], b[y]) for x, y in links]
        sha = hashlib.sha256(written(a, b, links).encode()).hexdigest() if a else ""
        want.append((i, len(a), len(b), len(links), len(links), sum(count[p] == most[p[1]] for p in ids), sum(count[p] for p in ids), sha))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[5] < w[4] for w in want)


def test_lanes_don_t_change_the_merge():
    r = np.random.default_rng(0)
    for n in (1, 5, 300, 5000):
        last = n * 3
        a, b = (np.unique(np.append(r.integers(1, last, n), last)) for _ in "ab")
        want = [int(np.flatnonzero(b == x)[0]) if (b == x).any() else -1 for x in a]
        for lane in (1, 7, 64, last):
            assert op11_align.lockstep(a, b, np.unique(np.append(np.arange(0, last, lane), last))).tolist() == want


def test_links_table_and_empty_input(spark, docs):
    text = "tokens meet here"
    a, b, links = plain(text)
    got = [(r.doc_id, r.a_id, r.b_id) for r in op11_align.links_table(docs([(1, text), (2, None)])).orderBy("at").collect()]
    assert got == [(1, a[x], b[y]) for x, y in links]
    assert op11_align.alignment(docs([])).count() == 0
    zeros = op11_align.alignment(docs([(1, None), (2, "")])).collect()
    assert all(tuple(r)[1:] == (0,) * 6 + ("",) for r in zeros) and len(zeros) == 2
