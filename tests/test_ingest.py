"""SRC1 in parallel, against Python's csv module; rejects; stored results by source."""

import csv
import io
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from mercato.sources.ingest import MAX_LINES, ingest_csv, records, stage_csv
from mercato.sources.io import ingest_csv_tables, materialize, read_csv_table, write_csv
from mercato.sources.stored import drop_old, file_state, keyed
from mercato.plans.context import Context
from tests.conftest import SMALL

HEADER = ["order_id", "review_id", "review_score", "review_comment_title", "review_comment_message", "review_creation_date",
          "review_answer_timestamp"]


def reviews(n, spans, seed=1):
    r = random.Random(seed)
    words = ["ok", "bad", 'said "no"', "a,b", "é", "late", ""] + (["two\nlines", "\n", 'x"\n"y', "cr\r\nlf"] if spans else [])
    return [[f"o{i}", f"r{i}", str(1 + i % 5), r.choice(words), " ".join(r.choice(words) for _ in range(r.randint(0, 6))).strip(" "),
             "2018-01-18 00:00:00", "2018-01-18 21:46:59"] for i in range(n)]


def written(path, rows, header=HEADER, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows([header, *rows])


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("spans", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_is_split_and_equals_the_csv_module(spark, tmpdir_path, small_splits, spans, end):
    path = os.path.join(tmpdir_path, "reviews.csv")
    rows = reviews(4000, spans)
    written(path, rows, end=end)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 8
    names, recs = records(spark, path)
    assert names == HEADER
    with open(path, newline="") as f:
        lines = f.read().split("\n")
    reader = csv.reader(io.StringIO("\n".join(lines), newline=""))
    want, start = {}, 1
    for row in reader:
        want[start] = row
        start = reader.line_num + 1 if end == "\n" else None or reader.line_num + 1
    del want[1]
    got = {r.line: next(csv.reader(io.StringIO(r.text, newline=""))) for r in recs.collect()}
    assert len(got) == len(rows) and list(dict(sorted(got.items())).values()) == list(want.values())
    if not (spans and end == "\r\n"):
        assert got == want
    out = ingest_csv(spark, path, "reviews")
    have = {r.order_id: r for r in out.rows.collect()}
    assert out.rejects.count() == 0 and len(have) == len(rows)
    for o, _, score, title, message, *_ in rows:
        r = have[o]
        assert (r.review_score, r.review_comment_title or "", r.review_comment_message or "") == (int(score), title, message)


def test_rejects_are_counted_and_the_rest_is_read(spark, tmpdir_path, small_splits):
    path = os.path.join(tmpdir_path, "reviews.csv")
    rows = reviews(2000, True)
    lines, at = {}, 2
    for i, row in enumerate(rows):
        if i % 100 == 7:
            row[2] = "five"
        if i % 250 == 9:
            row[5] = "18/01/2018"
        lines[i] = at
        at += 1 + sum(c.count("\n") for c in row)
    rows[50] = [*rows[50], "one too many"]
    written(path, rows)
    out = ingest_csv(spark, path, "reviews")
    got = sorted(out.rejects.collect(), key=lambda r: (r.line, r.column or ""))
    want = [(lines[i], "review_score", "five", "not a bigint") for i in range(2000) if i % 100 == 7]
    want += [(lines[i], "review_creation_date", "18/01/2018", "not a timestamp_ntz") for i in range(2000) if i % 250 == 9]
    assert [(r.line, r.column, r.text, r.reason) for r in got if r.column] == sorted(want)
    shape, = [r for r in got if not r.column]
    assert shape.line == lines[50] and "one too many" in shape.text and shape.reason == "not the header's fields"
    bad = {i for i in range(2000) if i % 100 == 7 or i % 250 == 9} | {50}
    assert {r.order_id for r in out.rows.collect()} == {f"o{i}" for i in range(2000) if i not in bad}
    assert all(r.file.endswith("reviews.csv") for r in got)
    with pytest.raises(Exception, match=r"reviews\.(review_score: not a bigint: five|review_creation_date: not a timestamp_ntz: 18|\*: not the header)"):
        read_csv_table(spark, path, "reviews").collect()


def test_stray_quotes_cost_their_own_lines_only(spark, tmpdir_path):
    header = "seller_id,seller_zip_code_prefix,seller_state\n"
    body = [f"s{i},0{i},SP\n" for i in range(3 * MAX_LINES)]
    path = os.path.join(tmpdir_path, "odd.csv")
    with open(path, "w") as f:  # one quote in the file
        f.write(header + "".join(body[:10]) + '"broken,1,SP\n' + "".join(body[10:]))
    out = ingest_csv(spark, path, "sellers")
    assert out.rows.count() == len(body) and [r.line for r in out.rejects.collect()] == [12]
    path = os.path.join(tmpdir_path, "far.csv")
    with open(path, "w") as f:  # two quotes, too far apart for one record
        f.write(header + '"broken,1,SP\n' + "".join(body) + 'x"y,2\n')
    out = ingest_csv(spark, path, "sellers")
    assert out.rows.count() == len(body) and sorted(r.line for r in out.rejects.collect()) == [2, len(body) + 3]


def test_files_of_a_folder_headers_and_empty_ones(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "many")
    os.mkdir(folder)
    for k in range(3):
        written(os.path.join(folder, f"p{k}.csv"), [[f"s{k}{i}", "00123", "SP"] for i in range(5)], ["seller_id", "seller_zip_code_prefix", "seller_state"])
    out = ingest_csv(spark, folder, "sellers")
    assert out.rows.count() == 15 and {r.seller_zip_code_prefix for r in out.rows.collect()} == {"00123"}
    with open(os.path.join(folder, "p9.csv"), "w") as f:
        f.write("seller_state,seller_id,seller_zip_code_prefix\nSP,s,1\n")
    with pytest.raises(ValueError, match="different headers"):
        ingest_csv(spark, folder, "sellers")
    empty = os.path.join(tmpdir_path, "empty.csv")
    open(empty, "w").close()
    with pytest.raises(ValueError, match="no header"):
        ingest_csv(spark, empty, "sellers")
    only = os.path.join(tmpdir_path, "only.csv")
    written(only, [], ["seller_id", "seller_zip_code_prefix", "seller_state"])
    assert ingest_csv(spark, only, "sellers").rows.count() == 0


def test_all_eight_tables_read_from_csv(spark, tmpdir_path):
    src = Context(spark, SMALL).src
    paths = {}
    for name, df in src.items():
        paths[name] = os.path.join(tmpdir_path, name)
        write_csv(df, paths[name])
    assert len(paths) == 8
    back, rejects = ingest_csv_tables(spark, paths)
    assert rejects.count() == 0
    for name, df in back.items():
        assert df.count() == getattr(src, name).count()
    text = [F.col(c).cast("string") for c in src.geolocation.columns]
    assert back.geolocation.select(*text).exceptAll(src.geolocation.select(*text)).count() == 0
    clean_geo = src.geolocation.distinct().count()
    assert back.geolocation.distinct().count() == clean_geo < src.geolocation.count()


def test_staged_csv_is_read_again_only_when_it_changes(spark, tmpdir_path):
    path, root = os.path.join(tmpdir_path, "s.csv"), os.path.join(tmpdir_path, "stage")
    head = ["seller_id", "seller_zip_code_prefix", "seller_state"]
    written(path, [["a", "1", "SP"]], head)
    assert stage_csv(spark, path, "sellers", root).rows.count() == 1
    folders = {d for d in os.listdir(os.path.join(root, "sellers"))}
    assert stage_csv(spark, path, "sellers", root).rows.count() == 1
    assert {d for d in os.listdir(os.path.join(root, "sellers"))} == folders
    written(path, [["a", "1", "SP"], ["b", "2", "RJ"]], head)
    assert stage_csv(spark, path, "sellers", root).rows.count() == 2


def test_stored_results_follow_their_sources(spark, tmpdir_path):
    source, path = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    spark.range(5).write.parquet(source)
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    def get(key="k"):
        return keyed(spark, path, build, lambda: file_state(spark, [source]), key).count()

    assert (get(), get(), len(calls)) == (5, 5, 1)
    old = keyed(spark, path, build, lambda: file_state(spark, [source]), "k")
    spark.range(3).write.mode("append").parquet(source)
    assert (get(), len(calls)) == (8, 2)
    assert old.count() == 5  # its reader goes on
    assert (get("other definition"), len(calls)) == (8, 3)
    assert drop_old(spark, path) == 2 and (get("other definition"), len(calls)) == (8, 3)
    # a file of equal size and name that is written anew counts as changed
    f = next(os.path.join(source, n) for n in os.listdir(source) if n.endswith(".parquet"))
    os.utime(f, (time.time() + 60, time.time() + 60))
    assert (get("other definition"), len(calls)) == (8, 4)


def test_a_build_cut_short_is_not_reused(spark, tmpdir_path):
    source, path = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    spark.range(5).write.parquet(source)

    def broken():
        return spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))

    with pytest.raises(Exception, match="lost"):
        materialize(spark, path, broken, sources=[source])
    assert materialize(spark, path, lambda: spark.read.parquet(source), sources=[source]).count() == 5
    calls = []
    again = lambda: calls.append(1) or spark.read.parquet(source)
    materialize(spark, path, again, sources=[source])
    assert not calls
    materialize(spark, path, again, sources=[source], overwrite=True)
    assert calls


def test_catalogue_reads_the_stored_fact_in_one_pruned_scan(spark):
    from mercato.plans.catalog import QUERIES

    QUERIES["delivery_kpis"](spark, SMALL).collect()
    df = QUERIES["delivery_kpis"](spark, SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange") - plan.count("ExchangeQueryStage") <= 2
    assert "review_comment_message" not in plan and "Join" not in plan
    for key in ("customer_search", "customer_card"):
        df = QUERIES[key](spark, SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "/store/" in plan and "/fact/" not in plan and "Join" not in plan
