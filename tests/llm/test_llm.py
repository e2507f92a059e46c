"""Small cases with defined results and brute-force versions of the operators."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from mercato.llm import (op1_hnsw, op2_winnow, op3_lm, op4_pieces, op5_pack, op6_toxicity, op7_chat, op8_langid,
                         op9_minhash, op10_lines)
from mercato.llm.common import components

WORDS = [a + b for a in "ba de fi go hu ka le mi no pu".split() for b in "ra se ti vo zu lan mer nis".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(900 + i, 40) for i in range(30))
CASES = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, LONG), (6, LONG), (6, LONG), (None, "some text without id"),
         (8, "<|endoftext|> </s>"), (9, "x" * 6000), (10, "▁ é 日本 \U0001F600  two  spaces ")]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + 0.2 * r.normal(size=(20, 16)), base[:5], base[3] + 0.05 * r.normal(size=(60, 16))]).astype(np.float32)
    label = [int(i % 2) for i in range(40)] + [int(i % 2) for i in range(20)] + [int(i % 2) for i in range(5)] + [1] * 60
    rows = [(i, v.tolist(), la, 1) for i, (v, la) in enumerate(zip(x, label))]
    odd = [(500, None, 0, 1), (501, [0.0] * 16, 0, 1), (502, [float("nan")] * 16, 1, 1), (503, x[0].tolist(), None, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, part int")
    got = by_id(op1_hnsw.near_vectors(df, shard_rows=32, block_rows=16, audit=8), "vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min(root[i], *root[link[i]], root[i]) if link[i].any() else root[i] for i in range(len(x))])
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(x))} == {i: (link[i].sum(), root[i]) for i in range(len(x))}
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (500, 501, 502, 503))
    assert op1_hnsw.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_links_outside_a_dense_region_are_found(seed):
    """97 % of a shard in one dense region, links elsewhere: each is found, and the recall is measured."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    center = r.normal(size=32)
    dense = unit(center + 0.6 * r.normal(size=(2400, 32)))
    far = unit(r.normal(size=(40, 32)))
    mates = unit(far + 0.03 * r.normal(size=far.shape))
    shard = r.permutation(np.concatenate([dense, mates]))
    q = r.permutation(np.concatenate([unit(center + 0.6 * r.normal(size=(1500, 32))), far]))
    layers = [x.astype(np.int64) for x in op1_hnsw.build(shard.astype(np.float32))]
    hit, beam, recall = op1_hnsw.probe(shard, layers, q, 0.93, 64)
    assert set(zip(*hit.tolist())) == set(zip(*np.nonzero(q @ shard.T >= 0.93)))
    assert hit.shape[1] >= 40 and recall == 1.0
    none = op1_hnsw.probe(dense, [x.astype(np.int64) for x in op1_hnsw.build(dense.astype(np.float32))], far, 0.93, 64)
    assert none[0].shape[1] == 0 and np.isnan(none[2])


def winnow(text):
    """Hash-free version: positions of the rightmost minima, given the operator's gram hashes."""
    import re
    return re.findall(r"[^\x20\x09-\x0D]{1,32}", text or "")


def test_fingerprints(spark, docs):
    rows = [(i, prose(i, 60)) for i in range(20)] + [(20, prose(3, 60)), *[(40 + (i or 0), t) for i, t in CASES]]
    out = op2_winnow.fingerprints(docs(rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert got[20].fingerprint == got[3].fingerprint and got[41].fingerprint == ""
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    for i, (doc, text) in enumerate(order):
        if sum(d == doc for d, _ in rows) > 1:
            continue
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0.05 < got[i].near_edited < 0.8 and got[i].near_next < 0.05 for i in range(4, 18))
    assert op2_winnow.fingerprints(docs([])).count() == 0


def test_winnowing_picks_rightmost_minima_and_keeps_the_guarantee(spark, docs):
    text = prose(1, 80) + " " + " ".join(["same"] * 30)
    df = op2_winnow.with_fingerprint(docs([(1, text)]), "text", "fp")
    pairs = [(x >> 32, x & 0xFFFFFFFF) for x in df.first().fp]
    n = len(winnow(text)) - op2_winnow.K + 1
    at = [p for _, p in pairs]
    assert at == sorted(at) and at[0] < op2_winnow.W and n - at[-1] <= op2_winnow.W
    assert all(b - a <= op2_winnow.W for a, b in zip(at, at[1:]))  # no window without a pick
    same = [p for h, p in pairs if p >= 80]
    assert same and same[0] == 80 + op2_winnow.W - 1  # the first window wholly in the run takes its last position
    other = prose(2, 25) + " " + text[:200] + " " + prose(3, 25)
    two = op2_winnow.with_fingerprint(docs([(1, text), (2, other)]), "text", "fp").collect()
    assert {x >> 32 for x in two[0].fp} & {x >> 32 for x in two[1].fp}


def test_lm_base_and_normalised_score(spark, docs):
    rows = [(i, prose(i % 50, 30) + " Only" + str(i)) for i in range(120)] + [(1000 + (i or 0), t) for i, t in CASES]
    got = op3_lm.score(docs(rows)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    count = {}
    for i, ws in toks:
        if not held(i):
            for w in ws:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    want = {}
    for i, ws in toks:
        want.setdefault(i, (len(ws), sum(w in count for w in ws), sum(np.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in ws)))
    assert len(got) == len(rows)
    for r in got:
        n, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(r.doc_id))
        assert r.base_score == pytest.approx(base) and r.score < 0
    table = op3_lm.table(op3_lm.start(np.full(op3_lm.N_CLASS, 1 / op3_lm.N_CLASS)))
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)
    assert op3_lm.score(docs([])).count() == 0


def test_lm_beats_the_base_where_context_tells(spark, docs):
    a, b = WORDS[:20], WORDS[40:60]
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(60))) for i in range(150)]
    held = [x for x in op3_lm.score(docs(rows)).collect() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) + 5 * len(held)


def test_pieces_round_trip_and_scan_equals_whole(spark, docs):
    rows = [(i, t) for i, t in CASES] + [(50, prose(1, 3000)), (51, "é" * 500 + " " + "ab" * 900)]
    d = docs(rows).select("doc_id", "text")
    lex = op4_pieces.Lexicon(public_tokenizers.path("piece_bpe_32k.model"))
    whole = op4_pieces.Encoder(lex)

    def score(x):
        return sum(int(lex.score[i]) if lex.score[i] > op4_pieces.NONE else op4_pieces.BYTE_SCORE for i in np.frombuffer(x, "<u4"))

    out = op4_pieces.decode(op4_pieces.encode(d, segment=200)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "")
        assert score(bytes(r.ids)) == score(whole([r.text or ""])[0])


def test_pieces_against_a_plain_viterbi():
    lex = op4_pieces.Lexicon(public_tokenizers.path("piece_bpe_32k.model"))
    known = {b: i for i, b in enumerate(lex.bytes) if b and lex.score[i] > op4_pieces.NONE}
    for text in ["the quick brown fox", "zzzz ünïcode 日本", prose(5, 30)]:
        t = " " + text
        best = [0] + [-10**18] * len(t)
        for p in range(len(t)):
            for k in range(1, op4_pieces.LONGEST + 1):
                i = known.get(t[p:p + k].encode())
                s = int(lex.score[i]) if i is not None else op4_pieces.BYTE_SCORE * len(t[p].encode()) if k == 1 else None
                if s is not None and p + k <= len(t):
                    best[p + k] = max(best[p + k], best[p] + s)
        got = np.frombuffer(op4_pieces.Encoder(lex)([text])[0], "<u4")
        assert sum(int(lex.score[i]) if lex.score[i] > op4_pieces.NONE else op4_pieces.BYTE_SCORE for i in got) == best[-1]


def test_packing_covers_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    rows = [(i, prose(i, 5 + 37 * i % 900)) for i in range(150)] + [(1000 + (i or 0), t) for i, t in CASES if i != 6]
    got = op5_pack.pack(docs(rows), block_docs=40).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    seq, doc = {}, {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append(r)
        doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 2048 * 8  # at most one unfinished sequence a task
    assert op5_pack.pack(docs([])).count() == 0


def test_toxicity_finds_the_planted_sentences(spark, docs):
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        s = [prose(10 * i + k, 6) for k in range(8)]
        if bad:
            s[i % 5] += " vileword"
        rows.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    d = docs(rows + [(1000 + (i or 0), t) for i, t in CASES])
    got = op6_toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) + len(CASES) and all(0 <= r.score <= 1 for r in got)
    right = [r.predicted == (r.doc_id % 8 == 0) for r in got if r.doc_id < 400 and r.held_out]
    assert np.mean(right) > 0.95
    found = op6_toxicity.offending(d, op6_toxicity.train(d, lab)).collect()
    assert found and all("vileword" in r.sentence for r in found)
    none = op6_toxicity.toxicity(d, lab.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)


def test_chat_masks_and_escapes(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <s", "é\U0001F600 text ", "", None, "a</s"]
    rows = [(1, k, ("user", "assistant")[k % 2], t, 1) for k, t in enumerate(nasty)] + [
        (2, 1, "assistant", "b", 1), (2, 0, None, "a", 1), (2, None, "assistant", "first", 1), (None, 0, "assistant", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = by_id(op7_chat.format_chats(op7_chat.with_control_case(df), with_text=True), "conv_id")
    turns = {1: [(r, t or "") for _, _, r, t, _ in rows[:6]], 2: [("assistant", "first"), ("", "a"), ("assistant", "b")],
             None: [("assistant", "x")], -7: [("user", nasty[0]), ("assistant", nasty[0])]}
    assert got.keys() == turns.keys()
    for c, ts in turns.items():
        r, said = got[c], "".join(t for role, t in ts if role == "assistant")
        assert op7_chat.read_back(r.formatted) == ts and r.n_turns == len(ts) and r.formatted_chars == len(r.formatted)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert len(r.loss) == len(r.ids)


def test_language_held_out_accuracy(spark, docs):
    stems = {"aa": "kal mon tir sul", "bb": "shr ough ing thw", "cc": "ção eau oux ñez"}
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices(s.split(), k=2)) for _ in range(12)), la) for i, (la, s) in enumerate(list(stems.items()) * 60)]
    d = docs(rows + [(1000 + (i or 0), t, None) for i, t in CASES])
    got = op8_langid.languages(d).collect()
    assert len(got) == len(rows) + len(CASES)
    lang = {i: la for i, _, la in rows}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) == 1 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1001, 1002, 1003)} == {"und"}
    assert {r.lang_pred for r in op8_langid.languages(d.limit(0)).collect()} == set()


def test_minhash_against_brute_force(spark, docs):
    rows = []
    for g in range(12):
        w = prose(g, 120).split()
        for k in range(6):
            v = list(w)
            for j in range(k):
                v[(17 * j + 3 * k) % 120] = f"new{g}{k}{j}"
            rows.append((g * 10 + k, " ".join(v)))
    rows += [(200, "one two"), (201, "ONE  two"), *[(300 + (i or 0), t) for i, t in CASES if i]]
    d = docs(rows)
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= 85 * (len(sets[a]) + len(sets[b]) - k):
                    root[a] = root[b] = min(root[a], root[b])
    out = op9_minhash.near_duplicates(d).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert op9_minhash.near_duplicates(docs([])).count() == 0


def test_minhash_links_each_text_of_a_repeated_id(spark, docs):
    """Document 1 has two texts; either links another document, and neither hides the other."""
    a, b = prose(900, 80).split(), prose(901, 140).split()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "other"])), (3, " ".join([*b[:-1], "other"])), (4, prose(902, 90))]
    out = {(r.doc_id, r.component_id) for r in op9_minhash.near_duplicates(docs(rows)).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_sketch_fills_every_bin_and_estimates():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 2000).astype(np.uint64)
    k = op9_minhash.sketch([np.unique(x[:1]), np.unique(x[:1000]), np.unique(x[100:1100])])
    assert (k != np.iinfo(np.uint64).max).all()
    assert abs((k[1] == k[2]).mean() - 900 / 1100) < 0.25


def word_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def plain_line_dedup(rows):
    """[(text, removed)] of (doc_id, text, lines as words): all pairs of distinct lines by edit similarity."""
    first = {}
    order = sorted({(i is not None, i or 0, t): ws for i, t, ws in rows}.items())
    for key, ws in order:
        for k, w in enumerate(ws):
            if w:
                at = (key[:2], k, key)
                first[w] = min(first.get(w, at), at)
    lines = list(first)
    root = {w: w for w in lines}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for x in range(len(lines)):
        for y in range(x):
            a, b = lines[x], lines[y]
            most = max(len(a), len(b)) // 5
            if most >= abs(len(a) - len(b)) and len({*a} - {*b}) <= most and word_distance(a, b) <= most:
                root[find(a)] = find(b)
    keep = {}
    for w in lines:
        g = find(w)
        keep[g] = min(keep.get(g, first[w]), first[w])
    out = []
    for i, t, ws in rows:
        key = (i is not None, i or 0, t)
        left = [k for k, w in enumerate(ws) if not w or keep[find(w)][1:] == (k, key)]
        out.append((i, None if t is None else "\n".join(t.split("\n")[k] for k in left), len(ws) - len(left)))
    return out


def test_line_dedup_against_brute_force(spark, docs):
    from pyspark.sql import functions as F
    base = [prose(500 + i, 70).split() for i in range(6)]
    rows = []
    for i in range(24):
        w = list(base[i % 6])
        if i >= 12:
            w[i % 70] = "changed"
        rows.append((i, "Short line.\n" + " ".join(w).capitalize() + ".\n\n" + prose(700 + i, 12)))
    r = random.Random(12)
    for i in range(60):  # lines of few words, repeated words, and lines that share their opening
        a = [r.choice(WORDS[:12]) for _ in range(r.randint(1, 14))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b)):][:1] = [r.choice(WORDS[:14])]
            b.insert(r.randrange(len(b) + 1), r.choice(WORDS[:14]))
        rows.append((1000 + i, " ".join(a) + "\n" + ", ".join(b) + "\n" + " ".join(WORDS[:6] + [r.choice(WORDS) for _ in range(6)])))
    rows += [(100 + (i or 0), t) for i, t in CASES if i] + [(None, "Short line.\nno id " + prose(1, 5))]
    d = docs(rows)
    split = d.select("doc_id", "text", F.transform(F.split("text", "\n"), op10_lines.words).alias("w")).collect()
    want = plain_line_dedup([(x.doc_id, x.text, [tuple(w) for w in x.w or []]) for x in split])
    out = op10_lines.dedup_lines(d).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2])
    assert sorted([(x.doc_id, x.text, x["__removed"]) for x in out], key=key) == sorted(want, key=key)
    assert all(x.node == 1 for x in out) and sum(x["__removed"] for x in out) > 40
    assert op10_lines.dedup_lines(docs([])).count() == 0


def test_lines_of_lower_similarity_stay(spark, docs):
    """Ten words of which three differ, with many choices of the three: no pair is linked."""
    rows = []
    for i in range(400):
        a = prose(9000 + i, 10).split()
        b = list(a)
        for k in (1, 4, 8):
            b[k] = f"other{i}x{k}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    assert not any(r["__removed"] for r in op10_lines.dedup_lines(docs(rows)).collect())


def test_lines_with_a_common_opening_list_few_pairs(spark, docs, monkeypatch):
    """Pairs compared grow with the lines, not with their square."""
    listed = []
    real = op10_lines.linked_groups

    def counted(buckets, verify, quick):
        def check(pairs):
            listed[-1] += pairs.count()
            return verify(pairs)
        return real(buckets, check, quick)

    monkeypatch.setattr(op10_lines, "linked_groups", counted)
    for n in (500, 2000):
        listed.append(0)
        rows = [(i, f"read all about it today w{i}a w{i}b w{i}c w{i}d") for i in range(n)]
        assert not any(r["__removed"] for r in op10_lines.dedup_lines(docs(rows)).collect())
    assert listed[1] <= 8 * max(listed[0], 50)


def test_within_edits_compares_words_exactly(spark):
    from pyspark.sql import functions as F
    r = random.Random(4)
    rows = []
    for n in (5, 10, 19, 60, 300):
        a = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for k in (n // 5 - 1, n // 5, n // 5 + 1):
            b = list(a)
            for i in r.sample(range(n), max(k, 0)):
                b[i] = f"x{i}"
            rows.append(("\n".join(a), "\n".join(b), k <= n // 5))
    got = spark.createDataFrame(rows, "x string, y string, want boolean").select("want", op10_lines.within_edits("x", "y").alias("got"))
    assert all(x.got == x.want for x in got.collect())


def test_linked_groups_keep_a_chain_through_pivots(spark):
    """Members of one bucket that are linked only along a chain come together."""
    from pyspark.sql import functions as F

    from mercato.llm.common import linked_groups, shared_buckets
    buckets = shared_buckets(spark.createDataFrame([(1, i) for i in range(40)], "key long, node long"))
    comps = linked_groups(buckets, lambda p: p.where("b - a = 1"), lambda: F.lit(True))
    assert {r.component for r in comps.collect()} == {0}


def test_step_groups_fit_any_number_of_tasks():
    import pyarrow as pa
    p = op5_pack.Packer(800_000)
    ids = np.arange(5000, dtype="<u4")
    p.block([(None, ids), (2**62, ids[:70])])
    p.close()
    got = p.frame()
    table = pa.Table.from_pandas(got)
    assert table.schema.field("doc_id").type == pa.int64() and set(table["doc_id"].to_pylist()) == {None, 2**62}
    assert (got["step_group"] >= 800_000 << 32).all() and (got["step_group"] < 800_001 << 32).all()
    assert (got["sequence_id"] >= 800_000 << 40).all()
