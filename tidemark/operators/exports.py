"""Export frames, report figures and sinks of the catalogue."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Rows of one sheet of a workbook, its header aside.
SHEET_ROWS = 1_048_575
STATUS = {"auto": "Automatic", "verified": "Verified", "needs_review": "Needs review", "user_confirmed": "Confirmed by user"}


def _label(table: dict[str, str], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)


def master_data(entities: DataFrame) -> DataFrame:
    """Entities that were not merged away, lists as text, statuses as people read them; order by state, city and name."""
    lists = [c for c, kind in entities.dtypes if kind == "array<string>"]
    out = entities.where("merged_into is null").drop("merged_into")
    for c in lists:
        out = out.withColumn(c, F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; "))
    return out.withColumn("status", _label(STATUS, F.col("status"))).orderBy("state", "city", "standard_name")


def name_mapping(raw: DataFrame, cleaned: DataFrame, resolutions: DataFrame, entities: DataFrame) -> DataFrame:
    """Every current raw record with its normal name, decision and entity, in the order of arrival."""
    e = entities.select("entity_id", "standard_name", "state", "city")
    joined = raw.where("is_current").join(cleaned.select("record_id", "name_normalized", "quality_severity"), "record_id", "left").join(resolutions, "record_id", "left").join(e, "entity_id", "left")
    return joined.select("record_id", "source_file", F.coalesce("source_sheet", F.lit("")).alias("sheet"), "original_name", "name_normalized", "standard_name", "entity_id", "match_score", "match_status", "quality_severity", "state", "city", "seq").orderBy("seq").drop("seq")


def alias_list(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Aliases of entities that were not merged away, by entity and most frequent first."""
    e = entities.where("merged_into is null").select("entity_id", "standard_name")
    return aliases.join(e, "entity_id").select("standard_name", "alias", "entity_id", "occurrences", "verified").orderBy("standard_name", F.desc("occurrences"))


def duplicate_list(groups: DataFrame, raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Members of duplicate groups with their source and entity, the suggested primary first."""
    return groups.join(raw.select("record_id", "source_file", "original_name"), "record_id", "left").join(entities.select("entity_id", "standard_name"), "entity_id", "left").orderBy("group_id", F.desc("is_primary"))


def review_list(reviews: DataFrame, entities: DataFrame) -> DataFrame:
    """Pending reviews with the entity that they suggest, those of most records first."""
    e = entities.select(F.col("entity_id").alias("candidate_id"), F.col("standard_name").alias("candidate_name"))
    return reviews.where("status = 'pending'").join(e, "candidate_id", "left").orderBy(F.desc("record_count"), F.desc("match_score"))


def invalid_records(raw: DataFrame, cleaned: DataFrame, issues: DataFrame) -> DataFrame:
    """Current records with an error or without a usable name, with their distinct problems."""
    said = issues.where("message is not null").groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("message")), " | ").alias("problem"))
    bad = cleaned.where("quality_severity = 'error' or not is_resolvable").select("record_id", "quality_severity")
    return raw.where("is_current").join(bad, "record_id").join(said, "record_id", "left").select("record_id", "source_file", "original_name", "quality_severity", "problem", "seq").orderBy("seq").drop("seq")


def quality_list(issues: DataFrame, raw: DataFrame) -> DataFrame:
    """All issues with their source, by severity, kind and file."""
    return issues.join(raw.select("record_id", "source_file", "original_name"), "record_id", "left").orderBy("severity", "issue_type", "source_file")


def error_list(errors: DataFrame) -> DataFrame:
    return errors.select("occurred_at", "file_name", "stage", "severity", "message").orderBy("occurred_at")


def report_metrics(files: DataFrame, raw: DataFrame, cleaned: DataFrame, entities: DataFrame, resolutions: DataFrame, reviews: DataFrame, groups: DataFrame, issues: DataFrame, errors: DataFrame, now: str = "") -> DataFrame:
    """(metric, value): the report's figures, one pass over each table.

    Each table gives one row of counts; these are laid side by side and then
    under each other.
    """
    status = lambda s: F.count_if(F.col("status") == s)
    parts = [
        files.agg(F.count("*").alias("Files found"), status("processed").alias("Files processed"), status("failed").alias("Files failed"), status("unsupported").alias("Files unsupported"), status("duplicate_file").alias("Duplicate files skipped")),
        raw.where("is_current").join(cleaned.select("record_id", "is_resolvable"), "record_id", "left").agg(F.count("*").alias("Records extracted"), F.count_if("is_resolvable").alias("Records with a name")),
        entities.agg(F.count_if(F.col("merged_into").isNull()).alias("Master entities")),
        resolutions.agg(F.count_if(F.col("match_status").isin("auto_matched", "verified_mapping")).alias("Auto-matched records"), F.count_if("verified_by_user").alias("Records confirmed by user")),
        reviews.agg(status("pending").alias("Pending manual reviews")), groups.agg(F.count_distinct("group_id").alias("Duplicate groups")),
        issues.agg(F.count("*").alias("Data-quality issues")), errors.agg(F.count_if(F.col("severity") == "error").alias("Processing errors")),
    ]
    out = None
    for p in parts:
        rows = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in p.columns])))
        out = rows if out is None else out.unionByName(rows)
    spark = files.sparkSession
    return out.unionByName(spark.createDataFrame([("Generated at", now)], "metric string, value string")) if now else out


def top_counts(rows: DataFrame, columns: list[str], most: int | None = None, blank: str = "-") -> DataFrame:
    """(columns, n): groups with blanks named, most frequent first, of equals in order; ``most`` of them if given."""
    named = rows.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(blank)).alias(c) for c in columns])
    g = named.groupBy(*columns).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), *columns).limit(most) if most else g


def column_report(files: DataFrame) -> DataFrame:
    """(file, block, header_row, original, mapped_to, method, confidence): a files' inspection as JSON, one row per column."""
    column = "struct<original:string,field:string,method:string,confidence:double>"
    schema = f"struct<blocks:array<struct<sheet:string,page:int,header_row:int,columns:array<{column}>>>>"
    b = files.where("inspection is not null").select(F.col("source_path").alias("file"), F.explode(F.from_json("inspection", schema)["blocks"]).alias("b"))
    place = F.coalesce(F.nullif(F.col("b.sheet"), F.lit("")), F.concat(F.lit("page "), F.col("b.page").cast("string")), F.lit(""))
    return b.select("file", place.alias("block"), F.col("b.header_row").alias("header_row"), F.explode("b.columns").alias("c")).select(
        "file", "block", "header_row", F.col("c.original").alias("original"), F.coalesce("c.field", F.lit("(kept, not mapped)")).alias("mapped_to"), F.col("c.method").alias("method"), F.col("c.confidence").alias("confidence"))


def sheet_names(groups: DataFrame, name: str, taken: int = 31) -> DataFrame:
    """Adds ``sheet``: names of sheets, of ``taken`` characters at most, without marks that sheets refuse, unique without regard to case."""
    from pyspark.sql import Window

    base = F.left(F.coalesce(F.nullif(F.trim(F.regexp_replace(F.col(name), r"[\[\]:*?/\\']", " ")), F.lit("")), F.lit("Sheet")), F.lit(taken))
    n = F.row_number().over(Window.partitionBy(F.lower("_base")).orderBy(name))
    out = groups.withColumn("_base", base).withColumn("_n", n)
    tail = F.concat(F.lit(" "), F.col("_n").cast("string"))
    return out.withColumn("sheet", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat(F.left("_base", F.lit(taken) - F.length(tail)), tail))).drop("_base", "_n")


def guard(df: DataFrame, style: str = "export") -> DataFrame:
    """All text columns with what a spreadsheet would run made plain."""
    return df.select(*[T.guard_formula(F.col(c), style).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", str(v))[:32767]
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_workbook(frames: dict[str, DataFrame], path: str, sheet_rows: int = SHEET_ROWS) -> list[tuple[str, int]]:
    """A workbook on the driver's disk, one sheet per frame, or more where a frame has over ``sheet_rows`` rows; (sheet, rows) written.

    Rows stream through the driver partition by partition; for large frames use
    ``write_frame`` instead.
    """
    import os

    sheets, tmp = [], f"{path}.part"
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in frames.items():
            rows, part = guard(df).toLocalIterator(prefetchPartitions=True), 0
            row = next(rows, None)
            while part == 0 or row is not None:
                part += 1
                title = f"{name[:28]} {part}" if part > 1 else name[:31]
                n = 0
                with z.open(f"xl/worksheets/sheet{len(sheets) + 1}.xml", "w", force_zip64=True) as f:
                    put = lambda s: f.write(s.encode())  # noqa: B023, E731
                    put('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1">')
                    put("".join(_cell(f"{_letters(i + 1)}1", c) for i, c in enumerate(df.columns)) + "</row>")
                    while row is not None and n < sheet_rows:
                        n += 1
                        put(f'<row r="{n + 1}">' + "".join(_cell(f"{_letters(i + 1)}{n + 1}", v) for i, v in enumerate(row)) + "</row>")
                        row = next(rows, None)
                    put("</sheetData></worksheet>")
                sheets.append((title, n))
        names = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (t, _) in enumerate(sheets, 1))
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
    os.replace(tmp, path)
    return sheets


def write_frame(df: DataFrame, path: str, kind: str = "csv", rows_per_file: int = 1_000_000) -> None:
    """A frame as a folder of files of bounded rows; Spark's committer makes it whole or not at all."""
    w = (guard(df) if kind == "csv" else df).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (w.option("header", "true").csv if kind == "csv" else w.json if kind == "json" else w.parquet)(path)


def write_overflowing(df: DataFrame, path: str, name: str, most: int = 1_048_000) -> str:
    """A workbook, or, for a frame of more rows than one takes, a folder of delimited files beside a note; the path written."""
    if df.limit(most + 1).count() <= most:
        write_workbook({name: df}, f"{path}.xlsx")
        return f"{path}.xlsx"
    write_frame(df, f"{path}.csv")
    df.sparkSession.createDataFrame([(f"{name}: more than {most} rows, written as delimited files",)], "note string").coalesce(1).write.mode("overwrite").text(f"{path}.note")
    return f"{path}.csv"


def write_groups(df: DataFrame, by: list[str], path: str, most: int = 2000) -> bool:
    """A folder per group, unless there are more than ``most`` groups; whether it was written."""
    named = df
    for c in by:
        named = named.withColumn(f"{c}_folder", T.safe_name(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))))
    folders = [f"{c}_folder" for c in by]
    if named.select(*folders).distinct().limit(most + 1).count() > most:
        return False
    # a hot group is several files; rows need no shuffle to one writer per group
    guard(named).write.mode("overwrite").partitionBy(*folders).option("header", "true").csv(path)
    return True
