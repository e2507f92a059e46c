"""The pipeline on the smallest tables against a stage-by-stage check."""

import corpus_pipeline
import pytest

from mercato.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.toPandas(), docs.schema)
            assert out.count() <= docs.count()
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out if name != "packing" else docs
    assert start * 0.5 < docs.count() < start
    assert "__k" not in docs.columns


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_against_five_plain_stages(spark):
    """run() on the smallest tables beside the same decisions in plain Python: texts scored one by one with
    the trained weights, all pairs of lines, all pairs of shingle sets, and the pieces laid side by side."""
    import zlib

    import numpy as np
    import public_tokenizers
    from pyspark.sql import functions as F

    from mercato.llm import op5_pack, op6_toxicity, op8_langid, op10_lines
    from tests.llm.test_llm import plain_line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = op6_toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(i, t) for i, t in rows if model.score(t) < 0.5]
    left = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id", "left_semi")
    model, letters = op8_langid.train(left), op8_langid.letter_table()
    found = [(i, t, *model.predict(t, letters)) for i, t in rows]
    rows = [(i, t) for i, t, lang, p in found if lang != op8_langid.UNKNOWN and p >= corpus_pipeline.MIN_LANGUAGE]

    split = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "w", F.transform(F.split("text", "\n"), op10_lines.words)).collect()
    rows = [(i, t) for i, t, gone in plain_line_dedup([(x.doc_id, x.text, [tuple(w) for w in x.w]) for x in split])
            if not gone or t.strip(" ")]

    def words(t):
        return "".join(c.lower() if c.isascii() else c for c in t).encode().split()

    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [(i, t) for i, t in rows if find(i) == i]

    encode = op5_pack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: encode(t) for i, t in rows}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want) and 20 < len(want) < docs.count()
    windows = {}
    for i, pieces in got.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i])
            assert p.ids_crc32 == zlib.crc32(want[i][at:at + p.length].astype("<u4").tobytes())
            at += p.length
            windows.setdefault(p.sequence_id, []).append(p)
        assert at == len(want[i])
    for pieces in windows.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
        assert sum(p.length for p in pieces) <= 2048


def test_near_duplicates_are_decided_per_row(spark):
    """Rows that share a doc_id: the copy of another document goes, the text of its own stays."""
    from tests.llm.test_llm import prose

    a, b = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(2, a, "en", "s", 9), (5, a, "en", "s", 9), (5, b, "en", "s", 9), (None, a, "en", "s", 9), (7, None, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(2, a), (5, b), (0, a), (7, "")])


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_oracle(spark, key):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[key]).df()
    got = QUERIES[key](spark, SF).toPandas()[list(want.columns)]
    rows = lambda x: sorted(map(tuple, x.astype(object).to_numpy().tolist()))
    assert rows(got) == rows(want)
