"""op12: counts by plain Python, the decision list by a plain learner, native plans."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mercato.llm import op12_rules
from mercato.llm.op12_rules import COUNTS, FEATURES, Condition
from tests.llm.test_llm import CASES, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i:i + 8]), []).append(i)
    twice = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), len(twice), len(lines),
            len({*w}), sum(x == x.upper() and x != x.lower() for x in w), sum(c in "0123456789" for c in text), sum(c in ".,;:!?" for c in text))


def corpus():
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        kind = i % 8
        text = "\n".join(prose(5000 + i * 7 + k, r.randint(4, 30)) + "." for k in range(r.randint(1, 6)))
        if kind == 0:
            text = " ".join(x + r.choice(["***", "$$$", "%%%"]) for x in text.split())
        elif kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2:
            text = (prose(i, 12) + "\n") * r.randint(2, 5) + text
        rows.append((i, text))
        labels.append((i, int(kind > 1), 0))
    return rows, labels


def test_counts_against_plain_python(spark, docs):
    rows, _ = corpus()
    r = random.Random(9)
    rows = rows[:60] + [(1000 + i, " ".join(r.choice("ab") for _ in range(r.randint(1, 60)))) for i in range(60)]
    rows += [(2000 + (i or 0), t) for i, t in CASES] + [(3000, "a b c d e f g h " * 300), (3001, "x\x0by\x0cz\r\n \t\nx\ny\nx"), (3002, "É É\x85É 日本\n日本 ÉA 1A")]
    got = op12_rules.with_counts(docs(rows).withColumn("n_words", F.lit("clash")))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "node", *COUNTS]
    have = sorted((x.doc_id, *[x[c] for c in COUNTS]) for x in got.collect())
    assert have == sorted((i, *counts(t)) for i, t in rows)
    assert any(h[5] for h in have)


def plain_learn(rows):
    """rows: (values by feature, bad, pruning).  The same covering over lists."""
    def covers(rule, v):
        return all((v[c.name] >= c.value) == c.above for c in rule)

    def bin_of(v):
        return max(op12_rules.LOW, min(op12_rules.HIGH, math.floor(math.log10(v) * op12_rules.STEPS))) if v > 0 else op12_rules.LOW - 1

    rules, left = [], rows
    while len(rules) < op12_rules.MAX_RULES:
        rule = []
        while len(rule) < op12_rules.MAX_CONDITIONS:
            hist = {}
            for v, bad, pruning in left:
                if not pruning and covers(rule, v):
                    for f in FEATURES:
                        hist.setdefault(f, {}).setdefault(bin_of(v[f]), [0, 0])[not bad] += 1
            c = op12_rules.best_condition(hist)
            if c is None:
                break
            rule.append(c)
        fit = []
        for k in range(1, len(rule) + 1):
            hit = [(bad, pruning) for v, bad, pruning in left if covers(rule[:k], v)]
            p, n = (sum(b == x and q for b, q in hit) for x in (True, False))
            if (p + 1) / (p + n + 2) >= op12_rules.LIKELY and sum(b for b, _ in hit) >= op12_rules.PRECISION * len(hit):
                fit.append(((p + 1) / (p + n + 2), -k))
        if not fit:
            break
        rules.append(rule[:-max(fit)[1]])
        left = [x for x in left if not covers(rules[-1], x[0])]
    return rules


def test_rules_against_a_plain_learner(spark, docs):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels + [(3, 0, 0), (None, 0, 0), (5, None, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    table = op12_rules.with_counts(docs(rows + rows[:3])).cache()
    rules = op12_rules.train(table, lab)
    assert rules and all(isinstance(c, Condition) for r in rules for c in r)
    y = {}
    for i, q, _ in labels + [(3, 0, 0)]:
        y[i] = max(q, y.get(i, 0))
    got = table.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).collect()
    value = lambda r, f: float(r[FEATURES[f][0]]) if FEATURES[f][1] is None else r[FEATURES[f][0]] / r[FEATURES[f][1]] if r[FEATURES[f][1]] else 0.0
    assert rules == plain_learn([({f: value(r, f) for f in FEATURES}, y[r.doc_id] == 0, r.p) for r in got])
    out = {r.doc_id: r for r in op12_rules.quality(docs(rows), lab).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        n, repeats = counts(text)[0], counts(text)[4]
        assert out[i].base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert out[i].kept == (not out[i].base_failed and out[i].rule == 0)
    judged = [i for i, _ in rows if not out[i].base_failed]
    assert sum(out[i].kept == (i % 8 > 1) for i in judged) / len(judged) > 0.97
    assert all(out[i].kept for i in judged if i % 8 > 2)
    table.unpersist()


def test_no_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op12_rules.quality(docs([(1, prose(1, 40)), (2, None), (3, "few words")]), none).collect()}
    assert (got[1].kept, got[2].kept, got[3].kept) == (True, False, False) and not any(r.rule for r in got.values())
    one = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert op12_rules.train(op12_rules.with_counts(docs([(1, "a b")])), one) == []
    assert op12_rules.quality(docs([]), one).count() == 0


def test_emitted_conditional_runs_without_python(spark, docs):
    rules = [[Condition("symbols", True, 0.08), Condition("words", False, 50)], [Condition("digits", True, 0.5)]]
    assert op12_rules.as_text(rules) == ["symbols >= 0.08 and words < 50", "digits >= 0.5"]
    df = op12_rules.with_verdict(op12_rules.with_counts(docs([(1, "#a #b"), (2, "123 45 6"), (3, prose(4, 30))])), rules)
    assert {r.doc_id: r.rule for r in df.collect()} == {1: 1, 2: 2, 3: 0}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


@pytest.mark.parametrize("k", [-129, -128, -3, 0, 40, 256])
def test_thresholds_lie_at_the_ends_of_bins(k):
    t = op12_rules.threshold(k)
    assert t == 0 if k < op12_rules.LOW else abs(math.log10(t) * op12_rules.STEPS - k) < 0.01
