"""Delimited and plain text files whose rows may be ragged, read whole and lazily.

Files arrive as binary rows; each is decoded and split where it lies.  Rows keep
their own number of cells, so nothing is lost to a fixed schema.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "path string, row long, cells array<string>, encoding string, delimiter string, replaced long, problem string"
_MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]
CHUNK = 10_000


def decode(content: bytes) -> tuple[str, str]:
    """Text and encoding: byte-order mark, else UTF-8, else Windows-1252, else Latin-1, which takes any byte."""
    for mark, name in _MARKS.items():
        if content.startswith(mark):
            return content.decode(name, "replace"), name
    for name in ("utf-8", "cp1252"):
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1"), "latin-1"


def delimiter(text: str) -> str:
    """The mark that a sniffer names, if seven lines in ten hold it; else the one whose count per line is most even and high; a comma if none shows up."""
    lines = [x for x in text.splitlines()[:200] if x.strip()]
    try:
        mark = csv.Sniffer().sniff("\n".join(lines[:50]), delimiters=",;\t|").delimiter
        if sum(mark in x for x in lines) >= 0.7 * len(lines):
            return mark
    except csv.Error:
        pass
    best, top = ",", 0.0
    for mark in ",;\t|":
        counts = [x.count(mark) for x in lines]
        some = [c for c in counts if c]
        if not some:
            continue
        mode = max(set(some), key=lambda c: (some.count(c), c))
        score = some.count(mode) / len(lines) * (1 + min(mode, 8) / 8)
        if score > top:
            best, top = mark, score
    return best


def tabular(text: str) -> bool:
    """Whether a plain text is a table: one mark, as often in at least seven of ten lines."""
    lines = [x for x in text.splitlines()[:200] if x.strip()]
    counts = [x.count(delimiter(text)) for x in lines]
    return len(lines) >= 2 and any(counts) and max(counts.count(c) for c in set(counts) if c) >= 0.7 * len(lines)


def _cells(text: str, mark: str):
    """(row, cells, problem); a row that cannot be read is named and the next is read."""
    reader, n = csv.reader(io.StringIO(text, newline=""), delimiter=mark), 0
    while True:
        n += 1
        try:
            row = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            yield n, [], str(e)[:500]
            continue
        if any(c.strip() for c in row):
            yield n, row, None


def _rows(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            text, encoding = decode(bytes(content))
            mark, out = delimiter(text), []
            for n, row, problem in _cells(text, mark):
                out.append((path, n, row, encoding, mark, sum(c.count("�") for c in row), problem))
                if len(out) == CHUNK:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)


def _lines(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            text, _ = decode(bytes(content))
            if tabular(text):
                continue
            lines = [(path, k // 2000, k + 1, x) for k, x in enumerate(text.splitlines())]
            for lo in range(0, len(lines), CHUNK):
                yield pd.DataFrame(lines[lo : lo + CHUNK], columns=["path", "chunk", "line", "text"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "[^/]*$", 0)
    inside = F.expr(f"substring(path, locate({_quoted(folder.rstrip('/'))}, path) + {len(folder.rstrip('/'))})")
    hidden = name.rlike("^~\\$|\\.(tmp|crdownload)$") | inside.rlike("/\\.")
    return files.where(~hidden).withColumn("kind", F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listing(spark: SparkSession, folder: str, supported: tuple[str, ...] = ("csv", "tsv", "txt")) -> DataFrame:
    """Every file below a folder in the order of paths, but hidden and temporary ones and those in hidden folders; no content is read.

    Others than supported are listed, not dropped.
    """
    return _files(spark, folder).select("path", "length", "modificationTime", "kind", F.col("kind").isin(*supported).alias("supported")).orderBy("path")


def contents(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    """(path, kind, content) of the files of these kinds."""
    return _files(spark, folder).where(F.col("kind").isin(*kinds)).select("path", "kind", "content")


def read_delimited(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line with cells: path, row, cells, encoding, delimiter, replaced, problem (why a row could not be read)."""
    return contents(spark, folder, ("csv", "tsv", "txt")).select("path", "content").mapInPandas(_rows, ROW)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, chunk, line, text) of plain text files that are no tables, 2,000 lines a chunk."""
    return contents(spark, folder, ("txt",)).select("path", "content").mapInPandas(_lines, "path string, chunk long, line long, text string")


def header_rows(rows: DataFrame, aliases: dict[str, list[str]], within: int = 40) -> DataFrame:
    """(path, header_row, fields): the row near a file's top with most distinct known fields, two at least; the first of equals."""
    field = F.create_map(*[F.lit(x) for f, names in aliases.items() for n in names for x in (n, f)])
    plain = F.transform("cells", lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))
    fields = F.transform(plain, lambda c: F.try_element_at(field, c))
    known = F.size(F.array_distinct(F.filter(fields, lambda f: f.isNotNull())))
    found = rows.where(F.col("row") <= within).select("path", "row", fields.alias("fields"), known.alias("known")).where("known >= 2")
    return found.groupBy("path").agg(F.max_by(F.struct("row", "fields"), F.struct("known", (-F.col("row")).alias("r"))).alias("b")).select("path", F.col("b.row").alias("header_row"), F.col("b.fields").alias("fields"))


def records(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows under their file's header as maps: known fields by field, all cells by position; rows that repeat the header go."""
    plain = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    head = rows.select("path", F.col("row").alias("header_row"), plain("cells").alias("_head"))
    found = header_rows(rows, aliases).join(head, ["path", "header_row"])
    joined = rows.join(found, "path").where((F.col("row") > F.col("header_row")) & (plain("cells") != F.col("_head")))
    pairs = F.filter(F.arrays_zip(F.col("fields").alias("f"), F.col("cells").alias("c")), lambda x: x["f"].isNotNull() & (F.trim(x["c"]) != ""))
    values = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: x["f"])), lambda f: F.struct(f.alias("k"), F.array_join(F.transform(F.filter(pairs, lambda x: x["f"] == f), lambda x: F.trim(x["c"])), "; ").alias("v"))))
    return joined.select("path", "row", values.alias("values"), "cells").where(F.size("values") > 0)


def carry_header(blocks: DataFrame, header: Column, order: Column) -> DataFrame:
    """``header`` of the last block of the same file that has one."""
    return blocks.withColumn("header", F.last(header, ignorenulls=True).over(Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
