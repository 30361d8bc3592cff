"""Companies and their documents: aliases, merges, folders, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import validate as V


def alias_matches(names: DataFrame, name: str, known: DataFrame, known_name: str) -> DataFrame:
    """(name, company, matches): the known company of each distinct name, null if none or several fit.

    The same key settles it.  Else names fit that share their first core words:
    two of them, or one where either side has no more.
    """
    n = names.select(F.col(name).alias("name")).distinct().withColumn("key", V.company_key(F.col("name"))).withColumn("core", V.company_core(F.col("name")))
    k = known.select(F.col(known_name).alias("company")).distinct().withColumn("k_key", V.company_key(F.col("company"))).where("k_key <> ''").withColumn("k_core", V.company_core(F.col("company")))
    exact = n.join(k.groupBy("k_key").agg(F.min("company").alias("company")), n["key"] == F.col("k_key")).select("name", "company")
    rest = n.join(exact.select("name"), "name", "left_anti").where(F.size("core") > 0)
    # one equality on the first word, or on the first two, instead of a comparison of all with all
    first = lambda c: F.get(F.col(c), F.lit(0))
    two = lambda c: F.concat_ws(" ", F.slice(F.col(c), 1, 2))
    one_word = rest.where(F.size("core") == 1).join(k.where(F.size("k_core") > 0), first("core") == first("k_core"))
    short_known = rest.where(F.size("core") > 1).join(k.where(F.size("k_core") == 1), first("core") == first("k_core"))
    both = rest.where(F.size("core") > 1).join(k.where(F.size("k_core") > 1), two("core") == two("k_core"))
    loose = one_word.select("name", "company").unionByName(short_known.select("name", "company")).unionByName(both.select("name", "company"))
    found = exact.unionByName(loose).groupBy("name").agg(F.count_distinct("company").alias("matches"), F.min("company").alias("company"))
    return n.select("name").join(found, "name", "left").select("name", F.when(F.col("matches") == 1, F.col("company")).alias("company"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


def company_in_name(files: DataFrame, file: str, known: DataFrame, known_name: str, longest: int = 6) -> DataFrame:
    """(file, company): the known company whose key stands in a file's name as whole words.

    The longest key counts if it holds all others that stand there; else there is none.
    """
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace("file", r"\\", "/"), "[^/]*$", 0), r"\.[^.]*$", "")
    f = files.select(F.col(file).alias("file")).distinct().withColumn("words", F.filter(F.split(V.company_key(stem), " "), lambda w: w != ""))
    k = known.select(F.col(known_name).alias("company"), V.company_key(F.col(known_name)).alias("key")).where(F.length("key") >= 3).groupBy("key").agg(F.min("company").alias("company"))
    # every run of words of a name is looked up: an equality, whatever the number of companies
    starts = F.sequence(F.lit(1), F.size("words"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.least(F.size("words"), i + longest - 1)), lambda j: F.array_join(F.slice("words", i, j - i + 1), " "))))
    hits = f.where(F.size("words") > 0).select("file", F.explode(F.array_distinct(runs)).alias("key")).join(k, "key")
    best = hits.groupBy("file").agg(F.max_by(F.struct("key", "company"), F.struct(F.length("key"), "key")).alias("b"), F.collect_set("key").alias("keys"))
    alone = ~F.exists("keys", lambda x: ~F.contains(F.col("b.key"), x))
    return f.select("file").join(best, "file", "left").select("file", F.when(alone, F.col("b.company")).alias("company"))


def merge_companies(vendors: DataFrame, documents: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vendors (company_key, company_name, created_at) and documents (id, company_key, file_hash, types, reviewed) after merging.

    Vendors whose names have one normal key become the oldest of them; with
    ``aliases`` (alias_key, into_key), which a person confirmed, those become
    the named one instead.  Of a company's documents with one content the first
    stays, with the types of all, reviewed if one was.  Third: (old_key,
    new_key, alias) of what was merged.
    """
    v = vendors.withColumn("_norm", V.company_key(F.col("company_name")))
    if aliases is None:
        oldest = v.where("_norm <> ''").groupBy("_norm").agg(F.min(F.struct("created_at", "company_name", "company_key")).alias("o")).select("_norm", F.col("o.company_key").alias("new_key"))
        to = v.join(oldest, "_norm", "left").select("company_key", "company_name", "created_at", F.coalesce("new_key", "company_key").alias("new_key"))
    else:
        a = aliases.join(vendors.select(F.col("company_key").alias("into_key")), "into_key", "left_semi").where("alias_key <> into_key").dropDuplicates(["alias_key"])
        to = vendors.join(a, vendors["company_key"] == a["alias_key"], "left").select("company_key", "company_name", "created_at", F.coalesce("into_key", "company_key").alias("new_key"))
    merged = to.where("company_key <> new_key").select(F.col("company_key").alias("old_key"), "new_key", F.col("company_name").alias("alias"))
    kept = to.where("company_key = new_key").drop("new_key")
    moved = documents.join(merged.select("old_key", "new_key"), documents["company_key"] == F.col("old_key"), "left").withColumn("company_key", F.coalesce("new_key", "company_key")).drop("old_key", "new_key")
    docs = moved.groupBy("company_key", "file_hash").agg(F.min("id").alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.max("reviewed").alias("reviewed"))
    return kept, docs, merged


def folder_plan(files: DataFrame, company: str, path: str, digest: str) -> DataFrame:
    """(path, folder, dest): where each file of each company goes.

    Equal content of a company is copied once, from its first path; different
    files of one name get a number, in the order of their paths, without regard
    to case.
    """
    name = F.regexp_extract(F.col(path), "[^/]*$", 0)
    one = files.groupBy(F.col(company).alias("company"), F.col(digest).alias("digest")).agg(F.min(path).alias("path"))
    placed = one.withColumn("folder", T.safe_name(F.col("company"))).withColumn("_name", T.safe_name(F.regexp_extract("path", "[^/]*$", 0), 200))
    n = F.row_number().over(Window.partitionBy("folder", F.lower("_name")).orderBy("path", "digest"))
    stem, ext = F.regexp_replace("_name", r"\.[^.]*$", ""), F.regexp_extract("_name", r"(\.[^.]*)$", 1)
    return placed.withColumn("_n", n).select("path", "folder", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext)).alias("dest"))


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, bytes, sha256) of files, for a backup."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def verify(saved: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): what differs between a manifest and what a restore found: missing, changed or unexpected."""
    s, f = saved.select("path", "sha256"), found.select("path", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("sha256") != F.col("now"), "changed")
    return s.join(f, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def delete_documents(documents: DataFrame, products: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (id) and products (document_id) without those of the documents in ``gone`` (id)."""
    ids = gone.select("id").distinct()
    return documents.join(ids, "id", "left_anti"), products.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti")


def orphan_vendors(vendors: DataFrame, documents: DataFrame) -> DataFrame:
    """Vendors without a document."""
    return vendors.join(documents.select("company_key").distinct(), "company_key", "left_anti")


def correct_documents(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with what a person set (id, company_key, types): a null leaves the old value; corrected ones are reviewed."""
    c = corrections.select(F.col("id").alias("_id"), F.col("company_key").alias("_company"), F.col("types").alias("_types")).dropDuplicates(["_id"])
    return documents.join(c, documents["id"] == c["_id"], "left").withColumns({
        "company_key": F.coalesce("_company", "company_key"), "types": F.coalesce("_types", "types"), "reviewed": F.when(F.col("_id").isNotNull(), 1).otherwise(F.col("reviewed"))}).drop("_id", "_company", "_types")


def vendor_master(rows: DataFrame, names: list[str]) -> DataFrame:
    """(company_name, company_key): distinct companies of a master file whose name stands under one of several headers; the first spelling of each key."""
    name = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names if c in rows.columns])
    return rows.select(name.alias("company_name")).withColumn("company_key", V.company_key(F.col("company_name"))).where("company_key <> ''").groupBy("company_key").agg(F.min("company_name").alias("company_name"))
