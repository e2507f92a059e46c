"""Learned quality rules: a decision list over text statistics, in DataFrame functions only.

Every whole text gets counts (``with_counts``) and from them FEATURES.  Sequential
covering learns which documents to reject from labelled ones (quality 0 is the class
covered, 1 the other): a rule grows by the threshold condition of the greatest FOIL gain
until it covers one class alone, is cut back to the prefix that does best on the third
of the documents kept apart for pruning, and if it is precise there its documents
leave and the next rule is grown.  What comes out is ordered Spark conditionals:
``CASE WHEN symbols >= 0.0866 THEN 1 WHEN ... ELSE 0 END``.

Each step counts the labelled documents by (feature, bin, class), with partial
aggregation; the driver sees at most BINS counts a feature and class.  Bins are STEPS to
a factor of ten, so thresholds don't depend on how rows are partitioned.  All labelled
documents are used; texts are read once, their counts are stored and everything after
works on those.

Words that stand in an 8-word window found twice: hashes of the windows are made by
doubling; only where two are equal they are sorted and the windows' words compared.

Defined results: null text has no words; ratios over nothing are 0; a label without
doc_id or quality doesn't count, and a document labelled more than once is good if any
label says so; without labels of both classes there are no rules and the base alone
decides; repeated rows are decided each (each counts in learning); an empty table
gives an empty table; other columns pass through ``with_verdict`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import stored

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
#: Bins to a factor of ten; the least and the greatest bin hold all beyond.
STEPS, LOW, HIGH = 32, -128, 256
BINS = HIGH - LOW + 2
MAX_RULES, MAX_CONDITIONS, PRECISION, LIKELY = 12, 4, 0.95, 0.75

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_shouted", "n_digits", "n_marks"]
#: feature: numerator, denominator (None: the count itself)
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"), "shouted_words": ("n_shouted", "n_words"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "word_chars"), "line_words": ("n_words", "n_lines"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words of the array that stand in a window of WINDOW words found twice or more."""
    def join(h: Column, step: int) -> Column:
        return let(h, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step))))

    def covered(windows: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, WINDOW) == F.slice(w, y["i"] + 1, WINDOW))

        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.transform(s, lambda x, k: F.when(
            same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])))
        return let(F.array_sort(F.array_compact(twice)), lambda at: F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda s, x: s + x))

    h = F.transform(w, lambda x: F.xxhash64(x))
    for step in (1, 2, 4):
        h = join(h, step)
    # the last windows reach over the end
    whole = F.when(F.size(w) > WINDOW, F.slice(h, 1, F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))
    return let(whole, lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), covered(a)).otherwise(0))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with COUNTS of the whole text instead of its ``text``; names in the docs give way."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def without(chars: str) -> Column:
        return F.length("__t") - F.length(F.translate("__t", chars, ""))

    inner = F.btrim("__t", F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    per_words = let(words, lambda w: F.struct(
        F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).alias("n_distinct"),
        F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).alias("n_shouted")))
    per_lines = let(lines, lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))
    keep = [c for c in docs.columns if c not in ("text", *COUNTS)]
    d = docs.select(*keep, text.alias("__t"))
    # the structs are read field by field but must be made once, so they pass through a generator
    d = d.select(*keep, (F.length("__t") - F.length(F.translate("__t", SPACES, ""))).alias("__blank"), F.length("__t").alias("__n"),
                 without("#*$%&|<>").alias("n_symbols"), without("0123456789").alias("n_digits"), without(".,;:!?").alias("n_marks"),
                 F.explode(F.array(F.struct(per_words.alias("w"), per_lines.alias("l")))).alias("__s"))
    made = d.select(*keep, "__s.w.*", "__s.l.*", (F.col("__n") - F.col("__blank")).alias("word_chars"), "n_symbols", "n_digits", "n_marks")
    return made.select(*keep, *[F.col(c).cast("long").alias(c) for c in COUNTS])


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def bin_of(value: Column) -> Column:
    """Number of the bin; LOW - 1 holds zero."""
    k = F.floor(F.log10(value) * STEPS)
    return F.when(value > 0, F.least(F.greatest(k, F.lit(LOW)), F.lit(HIGH))).otherwise(F.lit(LOW - 1)).cast("int")


def threshold(k: int) -> float:
    """The lower end of bin k, to four digits."""
    return float(f"{10 ** (k / STEPS):.4g}") if k >= LOW else 0.0


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def column(self) -> Column:
        return feature(self.name) >= self.value if self.above else feature(self.name) < self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.value:g}"


def holds(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def first_rule(rules: list[list[Condition]]) -> Column:
    """The ordered conditional: number of the first rule that holds, 0 for none."""
    case = F.lit(0)
    if rules:
        case = F.when(holds(rules[0]), 1)
        for k, rule in enumerate(rules[1:], 2):
            case = case.when(holds(rule), k)
        case = case.otherwise(0)
    return case.cast("int")


def as_text(rules: list[list[Condition]]) -> list[str]:
    return [" and ".join(map(str, rule)) for rule in rules]


def best_condition(counts: dict[str, dict[int, list[int]]]) -> Condition | None:
    """The condition of the greatest FOIL gain; counts: feature -> bin -> [bad, good].

    Ties go to the feature named first, then to the widest cover, then to ``>=``.
    """
    best, top = None, 1e-9
    for name in FEATURES:
        bins = sorted(counts.get(name, {}).items())
        bad, good = (sum(v[c] for _, v in bins) for c in (0, 1))
        if not bad or not good:
            continue
        before = log2(bad / (bad + good))
        p = n = 0
        for (_, (b, g)), (k, _) in zip(bins, bins[1:]):
            p, n = p + b, n + g
            for above, x, y in ((True, bad - p, good - n), (False, p, n)):
                gain = x * (log2(x / (x + y)) - before) if x else 0.0
                if gain > top + 1e-9:
                    best, top = Condition(name, above, threshold(k)), gain
    return best


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """Decision list from (COUNTS, bad boolean, pruning boolean) rows, stored."""
    def histograms(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
        each = rows.select("bad", F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), bin_of(feature(n)).alias("bin")) for n in FEATURES])).alias("f"))
        out: dict[str, dict[int, list[int]]] = {}
        for r in each.groupBy("f.name", "f.bin").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect():
            out.setdefault(r["name"], {})[r["bin"]] = [r.b, r.g]
        return out

    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        left = labelled.where(first_rule(rules) == 0)
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            c = best_condition(histograms(left.where(~F.col("pruning") & holds(rule))))
            if c is None:
                break
            rule.append(c)
        if not rule:
            break
        # bad and good documents that each prefix covers, among those for pruning and among all
        cells = [F.count_if(holds(rule[:k]) & (F.col("bad") == bad) & (F.col("pruning") | F.lit(every)))
                 for k in range(1, len(rule) + 1) for every in (False, True) for bad in (True, False)]
        got = left.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
        worth = []
        for k in range(len(rule)):
            p, n, all_p, all_n = got[4 * k:4 * k + 4]
            likely = (p + 1) / (p + n + 2)
            if likely >= LIKELY and all_p >= PRECISION * (all_p + all_n):
                worth.append((likely, -k))
        if not worth:
            break
        rules.append(rule[:1 - max(worth)[1]])
    return rules


def train(counts: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Decision list from all labelled documents; ``counts`` holds doc_id and COUNTS."""
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        (F.max("quality") != 1).alias("bad"))
    known = counts.select("doc_id", *COUNTS).join(y, F.col("doc_id") == F.col("__id"))
    return learn(stored(known.select(*COUNTS, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning")), "labelled"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_verdict(counts: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Add ``base_failed``, ``rule`` (number of the first that rejects, 0 for none) and ``kept``."""
    out = counts.withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its counts, the base verdict, the deciding rule and the verdict."""
    counts = stored(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "counts")
    return with_verdict(counts, train(counts, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
