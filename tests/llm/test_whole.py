"""Whole results: line links by edit similarity alone, against brute force."""

import random

import corpus_pipeline
from mercato.llm import op9_minhash, op10_lines

VOCAB = [a + b + c for a in "ba de fi go hu ka le mi no pu".split() for b in "ra se ti vo zu".split() for c in "lan mer nis dor".split()]


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def edited(r, words, n):
    """``words`` after n single-word edits at random places."""
    words = list(words)
    for k in range(n):
        i = r.randrange(len(words))
        words[i:i + 1] = r.choice([[f"new{k}x{i}"], [], [words[i], f"ins{k}x{i}"]])
    return words


def removed(docs):
    """(doc_id, how many of its lines went) of documents of one line each."""
    return {r.doc_id: r["__removed"] for r in op10_lines.dedup_lines(docs).collect()}


def test_line_links_need_no_near_simhash(spark, docs):
    """Every pair of 5 to 100 words with similarity >= 0.8 is linked, whatever words the edits hit."""
    r, rows, want = random.Random(7), [], {}
    for n in [*range(5, 30), 40, 55, 70, 85, 100]:
        for k in range(4):
            a = [r.choice(VOCAB) for _ in range(n)]
            b = edited(r, a, max(1, n // 5))
            i = len(rows)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            want |= {i: 0, i + 1: int(distance(a, b) <= max(len(a), len(b)) // 5)}
    assert sum(want.values()) > 90
    assert removed(docs(rows)) == want


def test_equal_lines_of_any_length_go(spark, docs):
    """Short lines, marks, tab-separated fields and scripts without spaces; one word more than four is near."""
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张"
    lines = ["Short line.", "x", "---", "a\tb\tc\td\te\tf", "https://host/" + "p/" * 50, han, "one two three four"]
    text = "\n".join(lines)
    near = "\n".join(["a\tb\tc\td\te\tother", han[:5] + "新" + han[6:], "one two new three four", "***", "short lines"])
    got = {r.doc_id: (r.text, r["__removed"]) for r in op10_lines.dedup_lines(docs([(1, text), (2, text + "\n\n \t"), (3, near)])).collect()}
    assert got == {1: (text, 0), 2: ("\n \t", 7), 3: ("***\nshort lines", 3)}


def test_stage_near_duplicates_at_080(spark, docs):
    """The pipeline's stage against brute force; pairs of 0.80 to 0.85 count."""
    r, rows = random.Random(11), []
    for g in range(40):
        w = [r.choice(VOCAB) for _ in range(100 + 3 * g)]
        # a changed end makes each similarity from about 0.9 down to about 0.7
        for k in (0, *r.sample(range(4, 40), 3)):
            rows.append((len(rows), " ".join([*w[:len(w) - k], *(f"n{g}x{k}x{i}" for i in range(k))])))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    link = [(a, b) for a in sets for b in sets if a < b and a // 4 == b // 4
            and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in link)
    root = {i: i for i in sets}
    for _ in range(4):
        for a, b in link:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()}
    assert got == {i for i in sets if root[i] == i}


def test_banding_follows_the_threshold():
    assert op9_minhash.banding(85) == (16, 4) and op9_minhash.least_agree(85) == 37
    for percent in (50, 70, 80, 85, 95):
        bands, rows = op9_minhash.banding(percent)
        assert bands * rows <= op9_minhash.BINS and (1 - (percent / 100) ** rows) ** bands < 1e-5
