"""Parallel reading of delimited files, with rejects (SRC1).

Spark's CSV reader gives a whole file to one task as soon as fields may hold
newlines.  Here files are read as lines, which splits them at any block
size, and records are put together from the lines:

1. One pass over the lines counts, for each (file, split), its lines and the
   lines with an odd number of quotes, and takes the file's header.  That table
   has one row per split, so prefix sums over it give every split its first
   line number and the quotes opened before it.
2. Without an odd line no field holds a newline: every line is a record, and
   nothing is shuffled.
3. Else each line learns how many odd lines lie before it in its split (rows of
   a scan come in file order; one Arrow pass with a running sum).  With the
   prefix sums that is the number r of odd lines before it in the file: a line is
   inside a quoted field if r is odd, and the lines of one record share r div 2.
   Only the lines of records that span lines are grouped; all others pass by.

A stray quote can't swallow a file: in a file with an odd number of odd lines, and
where a record would span more than ``MAX_LINES`` lines, each line stands for
itself and fails alone.

A record that has another number of fields than the header, or a value that doesn't
fit its declared type, goes to the rejects (file, line, column, text, reason) and
not to the rows; the job goes on.  Line numbers are those of the file, from 1
for the header, a record's being that of its first line.
"""

from __future__ import annotations

import csv
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mercato.session import checkpoint_root
from mercato.sources.schema import OPTIONAL, SCHEMAS

MAX_LINES = 1000
# tie-breakers of the bound test tables that source files lack
DERIVED = ("source_row", "review_no")


@dataclass
class Ingest:
    rows: DataFrame      # the table's declared columns
    rejects: DataFrame   # file, line, column, text, reason


def _stored(df: DataFrame, tag: str) -> DataFrame:
    path = f"{checkpoint_root(df.sparkSession)}/ingest-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lines(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """(file, block, id, text, odd): ids rise within a split."""
    text = F.col("value")
    quotes = F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), text.alias("text"), (quotes % 2 == 1).alias("odd"))


def split_table(lines: DataFrame) -> DataFrame:
    """One row per (file, split): first id, lines and odd lines before it, the file's odd lines, the header in the first."""
    per = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_if("odd").alias("odds"),
        F.min_by(F.when(F.col("block") == 0, F.col("text")), "id").alias("header"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", "block", "first_id", "header",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
                      F.coalesce(F.sum("odds").over(before), F.lit(0)).alias("odds_before"),
                      F.sum("odds").over(Window.partitionBy("file")).alias("odds_in_file"))


def _with_odds(lines: DataFrame) -> DataFrame:
    """Add ``odds``: odd lines before the line in its split."""
    schema = StructType([*lines.schema.fields, StructField("odds", LongType())])

    def run(batches):
        at, count = None, 0
        for b in batches:
            files, blocks = b.column("file"), b.column("block").to_numpy()
            names = files.dictionary_encode().indices.to_numpy()
            odd = b.column("odd").to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (np.diff(blocks) != 0) | (np.diff(names) != 0)])
            seen = np.cumsum(odd) - odd
            base = -seen[new]  # counts start again in each split
            if at == (files[0].as_py(), int(blocks[0])):
                base[0] += count
            odds = seen + np.repeat(base, np.diff(np.r_[new, len(odd)]))
            at, count = (files[-1].as_py(), int(blocks[-1])), int(odds[-1] + odd[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odds)], [*b.schema.names, "odds"])

    return lines.mapInArrow(run, schema)


def records(spark: SparkSession, path: str, quote: str = '"', max_lines: int = MAX_LINES) -> tuple[list[str], DataFrame]:
    """(header names, DataFrame of file, line, text): one row per record."""
    lines = _lines(spark, path, quote)
    splits = _stored(split_table(lines), "splits")
    headers = [r.header for r in splits.where("block = 0").select(F.rtrim("header", F.lit("\r")).alias("header")).distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{path}: {'no header' if not headers else 'files with different headers'}")
    names = next(csv.reader([headers[0].lstrip("\ufeff")], quotechar=quote))
    spans = splits.where("odds_in_file > 0").limit(1).count() > 0

    placed = (_with_odds(lines) if spans else lines).join(splits.drop("header"), ["file", "block"]).withColumn(
        "line", F.col("lines_before") + F.col("id") - F.col("first_id") + 1).where("line > 1")
    if not spans:
        out = placed.select("file", "line", "text")
    else:
        rank = F.col("odds_before") + F.col("odds")
        placed = placed.select("file", "line", "text", (rank - rank % 2).alias("record"),
                               (((rank % 2 == 1) | F.col("odd")) & (F.col("odds_in_file") % 2 == 0)).alias("part"))
        parts = placed.where("part")
        long = parts.groupBy("file", "record").agg(F.count("*").alias("n")).where(F.col("n") > max_lines).select(
            "file", "record", F.lit(True).alias("long"))
        parts = parts.join(long, ["file", "record"], "left")
        joined = parts.where("long is null").groupBy("file", "record").agg(
            F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
        out = placed.where("not part").select("file", "line", "text").union(
            parts.where("long").select("file", "line", "text")).union(
            joined.select("file", "line", F.array_join("all.text", "\n")))
    return names, out.withColumn("text", F.rtrim("text", F.lit("\r"))).where("text <> ''")


def _typed(table: str, names: list[str], recs: DataFrame, quote: str, sep: str) -> DataFrame:
    """Records with the table's columns, ``__bad`` (column, text of the values that don't fit) and ``__whole``."""
    fields = ", ".join([*(f"c{i} string" for i in range(len(names))), "broken string"])
    parsed = F.from_csv("text", F.lit(fields), {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1",
                                                "columnNameOfCorruptRecord": "broken"})
    recs = recs.withColumn("__p", parsed)
    missing = [f.name for f in SCHEMAS[table] if f.name not in names and f.name not in {*DERIVED, *OPTIONAL}]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)}")

    def text_of(name: str) -> Column:
        return F.col(f"__p.c{names.index(name)}")

    def value(field) -> Column:
        if field.name in DERIVED and field.name not in names:
            # equal rows get equal numbers, so that they stay duplicates; the numbers don't follow the file's order
            return F.hash(*[text_of(n) for n in sorted(names)]).cast(field.dataType)
        if field.name not in names:
            return F.lit(None).cast(field.dataType)
        if is_id(field):
            return text_of(field.name)
        return text_of(field.name).try_cast(field.dataType)

    def is_id(field) -> bool:
        return field.name.endswith("_id") and field.name != "order_item_id"

    checked = [f for f in SCHEMAS[table] if f.name in names and not is_id(f)]
    bad = F.array_compact(F.array(*[F.when(
        text_of(f.name).isNotNull() & text_of(f.name).try_cast(f.dataType).isNull(),
        F.struct(F.lit(f.name).alias("column"), text_of(f.name).alias("text"),
                 F.lit(f"not a {f.dataType.simpleString()}").alias("reason"))) for f in checked]))
    return recs.select("file", "line", F.col("text").alias("__text"), F.col("__p.broken").isNull().alias("__whole"), bad.alias("__bad"),
                       *[value(f).alias(f.name) for f in SCHEMAS[table]])


def _parts(table: str, typed: DataFrame) -> Ingest:
    good = typed.where("__whole and size(__bad) = 0").select(*[f.name for f in SCHEMAS[table]])
    values = typed.where("__whole and size(__bad) > 0").select("file", "line", F.inline("__bad"))
    shapes = typed.where("not __whole").select("file", "line", F.lit(None).cast("string").alias("column"),
                                               F.col("__text").alias("text"), F.lit("not the header's fields").alias("reason"))
    return Ingest(rows=good, rejects=values.union(shapes))


def ingest_csv(spark: SparkSession, path: str, table: str, quote: str = '"', sep: str = ",") -> Ingest:
    """A file's, or a folder's, rows and rejects of a declared table.  Columns are found by their header names."""
    names, recs = records(spark, path, quote)
    return _parts(table, _typed(table, names, recs, quote, sep))


def strict_csv(spark: SparkSession, path: str, table: str, quote: str = '"', sep: str = ",") -> DataFrame:
    """The rows alone; the first record that doesn't fit stops the job with its text and line."""
    names, recs = records(spark, path, quote)
    typed = _typed(table, names, recs, quote, sep)
    first = F.coalesce(F.get("__bad", F.lit(0)), F.struct(F.lit("*").alias("column"), F.col("__text").alias("text"),
                                                          F.lit("not the header's fields").alias("reason")))
    wrong = F.concat(F.lit(f"{table}."), first["column"], F.lit(": "), first["reason"], F.lit(": "), first["text"],
                     F.lit(" (line "), F.col("line").cast("string"), F.lit(")"),
                     # not deterministic, so never moved below to lines that are no records yet
                     F.when(F.rand(0) > 1, "").otherwise(""))
    # the header and blank lines may be looked at before their own filters take them out
    ok = (F.col("line") <= 1) | (F.col("__text") == "") | (F.col("__whole") & (F.size("__bad") == 0))
    fits = F.when(ok, True).otherwise(F.raise_error(wrong).cast("boolean"))
    return typed.where(fits).select(*[f.name for f in SCHEMAS[table]])


def stage_csv(spark: SparkSession, path: str, table: str, root: str, quote: str = '"', sep: str = ",") -> Ingest:
    """As ``ingest_csv``, but read once: the typed records are written under ``root`` (a shared folder)
    and both results read from there.  Unchanged files aren't read again (``sources.stored``)."""
    from mercato.sources.stored import file_state, keyed

    def build() -> DataFrame:
        names, recs = records(spark, path, quote)
        return _typed(table, names, recs, quote, sep)

    return _parts(table, keyed(spark, f"{root.rstrip('/')}/{table}", build, lambda: file_state(spark, [path]),
                               key=f"{table};{sep};{quote};{SCHEMAS[table].simpleString()}"))
