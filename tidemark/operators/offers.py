"""Products and offers: ranking, conflicts, unique rows, matching of staged rows and report figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def ranked_offers(offers: DataFrame, item: list[str], price: str, tie: list[str], top: int | None = None) -> DataFrame:
    """Offers with their rank by price inside the item and their distance to its lowest and mean price.

    With ``top`` the best few are kept by a rank that Spark filters before the
    shuffle; figures of the item come from an aggregate joined back.
    """
    g = offers.groupBy(*item).agg(F.min(price).alias("lowest"), F.avg(price).alias("mean"), F.count("*").alias("offers"))
    w = Window.partitionBy(*item).orderBy(price, *tie)
    ranked = offers.withColumn("rank", F.row_number().over(w))
    if top:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(g, item).withColumn("over_lowest", F.col(price) - F.col("lowest")).withColumn("over_mean", F.round(F.col(price) - F.col("mean"), 4)).drop("lowest", "mean")


def price_conflicts(products: DataFrame, key: list[str], amounts: list[str]) -> DataFrame:
    """Keys that several rows share: ``conflict`` if an amount has several values, else ``possible duplicate``."""
    g = products.groupBy(*key).agg(F.count("*").alias("rows"), *[F.count_distinct(a).alias(f"{a}_values") for a in amounts])
    several = F.greatest(*[F.col(f"{a}_values") for a in amounts], F.lit(0)) > 1
    return g.where("rows > 1").withColumn("issue", F.when(several, "conflict").otherwise("possible duplicate"))


def unique_rows(rows: DataFrame, id_col: str, fields: list[str], apart: Column | None = None) -> DataFrame:
    """The row with the smallest id of each set of equal rows, with the number of copies; rows ``apart`` stay alone.  Nulls are equal."""
    own = F.when(apart, F.col(id_col)) if apart is not None else F.lit(None).cast("long")
    return rows.withColumn("_own", own).groupBy("_own", *fields).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies")).drop("_own")


def staged_outcome(staged: DataFrame, current: DataFrame, scope: list[str]) -> DataFrame:
    """What approving each staged row would do: insert, duplicate, price_change, update or ambiguous.

    Both sides have id, sku, name, pack, unit, price and ``scope`` columns.
    Rows match inside the scope with equal pack and unit: by SKU if both have
    one, else by name.  Null texts are empty.
    """
    key = lambda c: T.natural_key(F.trim(c))
    made = lambda d: d.select("id", *scope, "price", *[key(F.col(c)).alias(f"{c}_k") for c in ("sku", "name", "pack", "unit")])
    new, old = made(staged), made(current)
    names = [*scope, "pack_k", "unit_k"]
    o = old.select(*names, F.col("id").alias("old_id"), F.col("price").alias("old_price"), F.col("sku_k").alias("old_sku"), F.col("name_k").alias("old_name"))
    # two equi-joins instead of one with an OR: each has a full key
    by_sku = new.where("sku_k <> ''").join(o.where("old_sku <> ''"), names).where("sku_k = old_sku")
    by_name = new.where("name_k <> ''").join(o, names).where("name_k = old_name and (sku_k = '' or old_sku = '')")
    hits = by_sku.select("id", "old_id", "old_price", "old_name").unionByName(by_name.select("id", "old_id", "old_price", "old_name"))
    found = hits.groupBy("id").agg(F.count_distinct("old_id").alias("matches"), F.min(F.struct("old_id", "old_price", "old_name")).alias("m"))
    j = new.join(found, "id", "left")
    outcome = (
        F.when(F.col("matches").isNull(), "insert").when(F.col("matches") > 1, "ambiguous").when(~F.col("price").eqNullSafe(F.col("m.old_price")), "price_change")
        .when(F.col("name_k") != F.col("m.old_name"), "update").otherwise("duplicate")
    )
    return j.select("id", outcome.alias("outcome"), F.when(F.col("matches") == 1, F.col("m.old_id")).alias("product"), F.when(outcome == "price_change", F.col("m.old_price")).alias("old_price"))


def price_variants(rows: DataFrame, price: str) -> DataFrame:
    """One row for each price of a comma-separated list; numbers as double, anything else as null."""
    return rows.withColumn(price, F.explode(F.split(F.coalesce(price, F.lit("")), r"\s*,\s*"))).withColumn(price, F.trim(price).try_cast("double"))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n): how often each of ``values`` occurs, zeros included, in one pass."""
    one = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias(column), F.col(f"`{v}`").alias("n")) for v in values])))


def messages(issues: DataFrame, key: str, message: str) -> DataFrame:
    """(key, messages): distinct messages of a key, sorted and joined."""
    return issues.where(F.col(message).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(message)), " | ").alias("messages"))


def combine_documents(documents: DataFrame, identity: list[str], rank: Column, types: str) -> DataFrame:
    """One row for each document identity: the row of the highest ``rank`` with the types of all of them."""
    others = [c for c in documents.columns if c not in (*identity, types)]
    g = documents.withColumn("_r", rank).groupBy(*identity).agg(F.max_by(F.struct(*others), "_r").alias("_b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(types)))).alias(types), F.count("*").alias("copies"))
    return g.select(*identity, "_b.*", types, "copies")


def numbered(rows: DataFrame, key: str, prefix: str, checkpoint, width: int = 6, start: int = 0) -> DataFrame:
    """Distinct ``key`` values numbered in order from ``start`` + 1, as ``prefix`` and digits, without one task that sorts all.

    Rows are dealt to ranges of the key and written; what lies before a range
    is summed over the ranges, of which there are as many as shuffle partitions.
    """
    dealt = checkpoint(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    no = F.lit(start) + F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(key))
    out = dealt.join(F.broadcast(before), "_part").withColumn("_no", no.cast("string"))
    out = out.withColumn("no", F.when(F.length("_no") < width, F.lpad("_no", width, "0")).otherwise(F.col("_no")))
    return out.withColumn("entity_id", F.concat(F.lit(prefix), "no")).drop("_part", "_before", "_no")


def severity_order(c: Column) -> Column:
    """Sort key of severities: error, warning, info, others."""
    return F.when(c == "error", 0).when(c == "warning", 1).when(c == "info", 2).otherwise(3)


def page(rows: DataFrame, order: list[Column], offset: int, size: int, most: int = 500) -> DataFrame:
    """One page of rows in order; the size lies between 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(size, most)))
