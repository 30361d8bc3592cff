"""Record-level operators: blocking, linkage, duplicates, checklists, prices and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def block(records: DataFrame, id_col: str, keys: dict[str, Column], weak: tuple[str, ...] = (), max_block: int = 300) -> DataFrame:
    """(id, kind, key): blocking keys, without those of weak kinds that too many records share."""
    made = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()])
    rows = records.select(F.col(id_col).alias("id"), F.inline(made)).where("key is not null and key <> ''").distinct()
    if not weak:
        return rows
    # counted by aggregate and joined back: a hot key is one counted row, not one window
    crowded = rows.where(F.col("kind").isin(*weak)).groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_block).select("kind", "key")
    return rows.join(crowded, ["kind", "key"], "left_anti")


def candidates(left: DataFrame, right: DataFrame, weights: dict[str, float], top: int = 40) -> DataFrame:
    """(l, r, weight): pairs that share blocking keys, the ``top`` heaviest of each left record."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    a, b = left.select(F.col("id").alias("l"), "kind", "key"), right.select(F.col("id").alias("r"), "kind", "key")
    scored = a.join(b, ["kind", "key"]).where("l <> r").groupBy("l", "r").agg(F.sum(w[F.col("kind")]).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("weight"), "r"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def duplicate_groups(records: DataFrame, keys: list[str], best: Column, id_col: str) -> DataFrame:
    """Rows that share all ``keys`` with another, with the group's size and its primary (largest ``best``).

    Groups are aggregates joined back, so a group of any size is never one
    task's window.  ``best`` must differ between rows, so it ends with the id.
    """
    g = records.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max_by(id_col, best).alias("_first")).where("group_size > 1")
    r, s = records.alias("r"), g.alias("s")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = r.join(s, same)
    return joined.select("r.*", "s.group_size", F.col(f"r.{id_col}").eqNullSafe(F.col("s._first")).alias("is_primary"))


def checklist(entities: DataFrame, documents: DataFrame, key: str, kind: str, kinds: list[str], available: Column) -> DataFrame:
    """One row per entity: Yes or No for each kind of document, with totals; entities without documents stay."""
    seen = documents.where(available).groupBy(key).agg(*[F.max((F.col(kind) == k).cast("int")).alias(k) for k in kinds], F.count("*").alias("files"))
    out = entities.join(seen, key, "left")
    have = sum((F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in kinds[1:]), F.coalesce(F.col(f"`{kinds[0]}`"), F.lit(0)))
    return out.select(
        *entities.columns, *[F.when(F.col(f"`{k}`") == 1, "Yes").otherwise("No").alias(k) for k in kinds],
        have.cast("long").alias("available"), (F.lit(len(kinds)) - have).cast("long").alias("missing"),
        F.round(100.0 * have / len(kinds), 1).alias("completion"), F.coalesce("files", F.lit(0)).cast("long").alias("files"),
    )


def price_changes(offers: DataFrame, item: list[str], at: list[str], price: str, span: Column | None = None) -> DataFrame:
    """Each change of an item's price: old and new value in order of ``at``.

    With ``span``, a value that never falls along ``at`` (a month, say), a busy
    item is taken span by span: the first row of a span follows the last price
    of the item's span before, which an aggregate gives.
    """
    if span is None:
        w = Window.partitionBy(*item).orderBy(*at)
        return offers.withColumn("old_price", F.lag(price).over(w)).where(F.col("old_price") != F.col(price)).withColumnRenamed(price, "new_price")
    rows = offers.withColumn("_span", span)
    ends = rows.groupBy(*item, "_span").agg(F.max_by(price, F.struct(*at)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*item).orderBy("_span"))).drop("_end")
    w = Window.partitionBy(*item, "_span").orderBy(*at)
    inside = rows.withColumn("_n", F.row_number().over(w)).withColumn("_lag", F.lag(price).over(w))
    old = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))
    joined = inside.join(before, [*item, "_span"]).withColumn("old_price", old)
    return joined.where(F.col("old_price") != F.col(price)).withColumnRenamed(price, "new_price").drop("_span", "_before", "_n", "_lag")


def price_statistics(offers: DataFrame, item: list[str], vendor: str, price: str) -> DataFrame:
    """Best, worst, mean and median price per item, the best vendor, and what the best saves against the worst and the mean.

    Offers are first summed up by (item, price) and by (item, vendor), so a hot
    item shrinks on the map side; the median is read off running counts of its
    distinct prices.
    """
    by_price = offers.where(F.col(price).isNotNull()).groupBy(*item, price).agg(F.count("*").alias("_n"), F.min(vendor).alias("_v"))
    w = Window.partitionBy(*item).orderBy(price)
    run = by_price.withColumn("_to", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*item)))
    # 0-based places (n - 1) / 2 and n / 2 of the ordered offers
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    at = lambda place: (F.col("_to") - F.col("_n") <= place) & (place < F.col("_to"))
    g = run.groupBy(*item).agg(
        F.min(price).alias("min_price"), F.max(price).alias("max_price"), F.round(F.sum(F.col(price) * F.col("_n")) / F.sum("_n"), 4).alias("avg_price"),
        F.round((F.max(F.when(at(low), F.col(price))) + F.max(F.when(at(high), F.col(price)))) / 2, 7).alias("median_price"),
        F.min_by("_v", price).alias("best_vendor"),
    )
    vendors = offers.where(F.col(price).isNotNull()).groupBy(*item, vendor).agg(F.lit(1).alias("_one")).groupBy(*item).agg(F.count(vendor).alias("vendors"))
    k, v = g.alias("g"), vendors.alias("v")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"v.{c}")) for c in item]
    return k.join(v, same).select("g.*", "v.vendors").withColumn("saving", F.col("max_price") - F.col("min_price")).withColumn("saving_on_mean", F.round(F.col("avg_price") - F.col("min_price"), 4))


def offer_blocks(offers: DataFrame, item: str, vendor: str, price: str, category: str, order: str) -> DataFrame:
    """One row per item: best and highest price, its vendors' sorted names, how many offers, and the category of the cheapest offer (of equals the first by ``order``)."""
    good = offers.where(F.col(price) > 0)
    return good.groupBy(item).agg(
        F.min(price).alias("best_price"), F.max(price).alias("max_price"), F.count("*").alias("vendor_count"),
        F.min_by(category, F.struct(price, order)).alias("category"), F.array_sort(F.collect_set(vendor)).alias("vendors"))


def search(rows: DataFrame, columns: list[str], query: str, least_share: float = 0.5) -> DataFrame:
    """Rows that hold at least ``ceil(share * tokens)`` of the query's words as whole words, with the hits."""
    words = list(dict.fromkeys(w for w in query.lower().split() if w))
    where = F.concat(F.lit(" "), F.concat_ws(" ", *[T.normal(F.col(c)) for c in columns]), F.lit(" "))
    hits = sum((where.contains(f" {w} ").cast("int") for w in words), F.lit(0))
    return rows.withColumn("hits", hits).where(F.col("hits") >= max(1, -(-int(len(words) * least_share * 1000) // 1000)))


def _without(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key ``other`` does not have; null keys are equal."""
    r, o = rows.alias("r"), other.select(*key).alias("o")
    return r.join(o, [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or replace: rows of ``new``, and those of ``old`` whose key it does not have."""
    return new.unionByName(_without(old, new, key))


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """On conflict do nothing: ``old``, and those rows of ``new`` whose key it does not have, one of each key."""
    return old.unionByName(_without(new.dropDuplicates(key), old, key))


def update_on_conflict(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """On conflict update: rows of both keep ``old`` but for ``columns``, which ``new`` gives; rows of ``new`` alone are added."""
    fresh = new.dropDuplicates(key)
    n = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = old.join(n, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    kept = joined.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return kept.unionByName(_without(fresh, old, key).select(*old.columns))


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Delete and insert: every row of ``old`` in a scope that ``new`` has goes, all of ``new`` comes."""
    return new.unionByName(_without(old, new.select(*scope).distinct(), scope))


def update_from(rows: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Update from a join: empty ``columns`` of rows take the value that ``source`` (one row per key) has; others stay."""
    s = source.dropDuplicates(key).select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = rows.join(s, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return joined.select(*[F.when(empty(c), F.coalesce(f"_s_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def not_in(rows: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """SQL's NOT IN: rows whose value is none of ``others``; no row at all if ``others`` holds a null, and none with a null value unless ``others`` is empty."""
    o = others.select(F.col(other).alias("_o"))
    seen = o.agg(F.count("*").alias("n"), F.count_if(F.col("_o").isNull()).alias("nulls"))
    kept = rows.join(o.where("_o is not null").distinct(), F.col(column) == F.col("_o"), "left_anti")
    # one row of two counts
    return kept.join(F.broadcast(seen), (F.col("n") == 0) | ((F.col("nulls") == 0) & F.col(column).isNotNull())).select(*rows.columns)


def band(score: Column) -> Column:
    """Confidence band of a match score."""
    return F.when(score >= 95, "Very High").when(score >= 85, "High").when(score >= 70, "Possible Match").when(score >= 50, "Manual Review").otherwise("Probably Different")
