"""The catalogue from files to exports: what a user calls.

Every step is a frame of its own and is written down before the next reads it,
so a run that breaks off is taken up where it stopped: each step does the work
whose result is missing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.functions import places as P
from tidemark.operators import cleaning as K
from tidemark.operators import exports as X
from tidemark.operators import linkage as L
from tidemark.operators import offers as O
from tidemark.operators import schema as S
from tidemark.sources import delimited, packaged

#: Kinds of files that hold tables.
TABLES = ("csv", "tsv", "txt", "xlsx", "docx", "json", "jsonl")
STEPS = ("cells", "records", "cleaned", "resolutions")


@dataclass(frozen=True)
class Settings:
    """What a run goes by; dictionaries belong to the user."""

    spelling: S.Spelling = field(default_factory=S.Spelling)
    gazetteer: P.Gazetteer = field(default_factory=P.Gazetteer)
    rules: L.Rules = field(default_factory=L.Rules)
    header_within: int = 40
    sample: int = 50


class Catalogue:
    """One catalogue under the folder ``at``, which all executors reach."""

    def __init__(self, spark: SparkSession, at: str, settings: Settings = Settings()):
        self.spark, self.at, self.settings = spark, at.rstrip("/"), settings

    def _path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _step(self, name: str, make) -> DataFrame:
        if not self._there(name):
            make().write.mode("overwrite").parquet(self._path(name))
        return self.spark.read.parquet(self._path(name))

    def _checkpoint(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.at}/work/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    # what there is
    def inventory(self, folder: str) -> DataFrame:
        """Every file with its kind, size, time, and whether it can be read."""
        return delimited.listing(self.spark, folder, TABLES)

    def cells(self, folder: str) -> DataFrame:
        """(path, part, row, cells, problem) of every readable file."""
        text = delimited.read_delimited(self.spark, folder).select("path", F.lit("").alias("part"), "row", "cells", "problem")
        return text.unionByName(packaged.read_packaged(self.spark, folder).select("path", "part", F.col("row").cast("long").alias("row"), "cells", "problem"))

    # structure
    def headers(self, cells: DataFrame) -> DataFrame:
        """(path, part, header_row, header) of every block that has a header."""
        block, rows = ["path", "part"], cells.where("problem is null")
        found = S.header_rows(rows, block, self.settings.spelling, self.settings.header_within)
        return found.join(rows.withColumnRenamed("row", "header_row").withColumnRenamed("cells", "header"), [*block, "header_row"]).select(*block, "header_row", "header")

    def inspect(self, cells: DataFrame) -> DataFrame:
        """How the columns of every block are read: (path, part, idx, header, field, confidence, method, used); nothing is written."""
        block = ["path", "part"]
        heads = self.headers(cells)
        columns = S.unique_headers(heads.select(*block, F.posexplode("header").alias("idx", "header")), block)
        data, _ = S.data_rows(cells.where("problem is null").select(*block, "row", "cells"), heads, block)
        # a bounded sample of each block's first rows; the rank is cut before the shuffle
        first = data.withColumn("_n", F.row_number().over(Window.partitionBy(*block).orderBy("row"))).where(F.col("_n") <= self.settings.sample)
        sample = first.select(*block, "row", F.posexplode("cells").alias("idx", "value")).groupBy(*block, "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("sample"))
        joined = columns.join(sample, [*block, "idx"], "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
        return S.map_columns(joined, block, self.settings.spelling, F.regexp_extract("path", "[^/]*$", 0))

    def records(self, cells: DataFrame) -> DataFrame:
        """Raw records of all blocks, with ids that follow from their place."""
        block = ["path", "part"]
        data, _ = S.data_rows(cells.where("problem is null").select(*block, "row", "cells"), self.headers(cells), block)
        return S.records(data.select(*block, "row", "cells"), self.inspect(cells), block)

    # decisions
    def clean(self, records: DataFrame) -> DataFrame:
        return K.clean(records, self.settings.gazetteer)

    def resolve(self, records: DataFrame, verified: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
        """(record_id, seq, entity_id, score, status, how, candidate): records in the order of files and rows."""
        order = F.concat_ws("\u0001", "path", "part", F.lpad(F.col("row").cast("string"), 12, "0"))
        named = O.numbered(records.withColumn("_order", order), "_order", "", self._checkpoint).withColumn("seq", F.col("no").cast("long"))
        rows = named.select("seq", "record_id", *[F.col(f"original_{c}").alias(c) for c in ("name", *L.DETAILS)])
        words = N.Words(places=self.settings.gazetteer.places())
        got = L.resolve(rows, self._checkpoint, rules=self.settings.rules, words=words, verified=verified, rejected=rejected)
        return rows.select("seq", "record_id").join(got.withColumnRenamed("id", "seq"), "seq").withColumnRenamed("entity", "entity_id")

    # verbs
    def run(self, folder: str) -> dict[str, DataFrame]:
        """Read, map, clean and resolve all files; steps that are there already are not made again."""
        cells = self._step("cells", lambda: self.cells(folder))
        records = self._step("records", lambda: self.records(cells))
        cleaned = self._step("cleaned", lambda: self.clean(records))
        resolutions = self._step("resolutions", lambda: self.resolve(records))
        return {"cells": cells, "records": records, "cleaned": cleaned, "resolutions": resolutions}

    def dry_run(self, folder: str, rows: int = 50) -> DataFrame:
        """What a run would decide about the first rows of each file, ``rows`` in all or three of each; no step is written."""
        cells = self.cells(folder)
        files = max(1, cells.select("path").distinct().count())
        each = max(3, -(-rows // files))
        records = self._checkpoint(self.records(cells), "dry")
        some = records.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("part", "row"))).where(F.col("_n") <= each).drop("_n")
        return self.resolve(self._checkpoint(some, "sample")).join(some.select("record_id", "path", "row", "original_name"), "record_id")

    def reset(self, since: str = "cells") -> None:
        """Forget a step and those after it, so that the next run makes them again."""
        for name in STEPS[STEPS.index(since):]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def entities(self, made: dict[str, DataFrame]) -> DataFrame:
        """One row per entity: its standard name, modes, aliases, addresses and counts."""
        rows = made["resolutions"].where("entity_id is not null").join(made["cleaned"], "record_id").join(made["records"].select("record_id", "original_name", "original_address"), "record_id")
        columns = ["city_norm", "state_norm", "district_norm", "pincode", "phone_norm", "email_norm", "registration_id_norm"]
        out = L.profile(rows, "entity_id", "seq", "original_name", "original_address", columns, "evidence_strength", "score")
        return out.join(L.standard_name(rows, "entity_id", "name_display", "name_core", F.lit(0), "seq"), "entity_id", "left")

    def export(self, made: dict[str, DataFrame], folder: str, kind: str = "csv") -> list[str]:
        """Write entities, name mapping and issues below ``folder``; the names written."""
        entities = self.entities(made)
        flat = entities.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in entities.dtypes])
        mapping = made["records"].select("record_id", "path", "row", "original_name").join(made["resolutions"], "record_id").join(entities.select("entity_id", "standard_name"), "entity_id", "left")
        frames = {"master_data": flat, "name_mapping": mapping, "data_quality_issues": K.issues(made["cleaned"])}
        for name, df in frames.items():
            X.write_frame(df, f"{folder.rstrip('/')}/{name}", kind)
        return list(frames)
