"""Ranked answers from the catalogue: offers of a product, researched products, index entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import asking as A


def query_tokens(query: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", query.lower())


def _whole(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens stand in a text as whole words."""
    return sum((text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){t}(?![\p{{L}}\p{{N}}_])").cast("int") for t in tokens), F.lit(0))


def vendor_offers(offers: DataFrame, query: str, most_products: int = 3, most_offers: int = 10) -> DataFrame:
    """(product_name, place, rank, vendor_name, price): the cheapest offers of the products that fit a query best.

    A row's fit is the similarity of its name, one more if its text holds the
    query, and the share of the query's words that it holds; over 0.2 counts.
    Names are scored once each, so a product of many offers costs one.
    """
    q = query.strip().lower()
    if not q:
        return offers.sparkSession.createDataFrame([], "product_name string, place int, rank int, vendor_name string, price double")
    tokens = q.split()
    text = F.lower("search_text")
    best = offers.groupBy("product_name").agg(F.max(F.when(text.contains(q), 1.0).otherwise(0.0) + sum((text.contains(t).cast("int") for t in tokens), F.lit(0)) / len(tokens)).alias("_text"), F.min("offer_id").alias("_first"))
    scored = best.withColumn("score", A.matching_blocks(F.lit(q), F.lower("product_name")) + F.col("_text")).where("score > 0.2")
    top = scored.orderBy(F.desc("score"), "_first").limit(most_products)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "_first"))  # most_products rows
    named = top.withColumn("place", place).select("product_name", "place")
    rank = F.row_number().over(Window.partitionBy("product_name").orderBy("price", "vendor_name", "offer_id"))
    return offers.where("price > 0").join(F.broadcast(named), "product_name").withColumn("rank", rank).where(F.col("rank") <= most_offers).select("product_name", "place", "rank", "vendor_name", "price")


def research(offers: DataFrame, query: str, near: DataFrame | None = None, strict: bool = False, most_products: int = 8, candidates: int = 250) -> DataFrame:
    """(product_name, score, best_price, max_price, vendor_count): products that answer a query, best first.

    A row's signal is its name's similarity, 3 if ``near`` (product_name), a
    vector search, found it, 1.5 if its text holds the query, and the shares of
    the query's telling words in its text (1) and its name (1.2).  Rows without
    any telling word go, as do those without one in the name and a signal
    below 3.2.  The ``candidates`` best rows give the products, which are
    ranked by similarity, vector hit and number of offers.
    """
    q = query.strip().lower()
    tokens = query_tokens(q)
    key = [t for t in tokens if t not in A.ASKING]
    signal = key or tokens
    name, text = F.lower("product_name"), F.lower("search_text")
    rows = offers.where(F.trim("product_name") != "")
    # a name is compared once, however many offers it has
    names = rows.select(name.alias("_name")).distinct().withColumn("_alike", A.matching_blocks(F.lit(q), F.col("_name")))
    rows = rows.withColumn("_name", name).join(names, "_name")
    found = F.lit(False)
    if near is not None:
        rows = rows.join(F.broadcast(near.select(F.lower("product_name").alias("_near")).distinct()), F.col("_name") == F.col("_near"), "left")
        found = F.col("_near").isNotNull()
    n = max(len(signal), 1)
    rows = rows.withColumn("_t", _whole(text, signal)).withColumn("_n", _whole(F.col("_name"), signal)).withColumn("_v", found)
    rows = rows.withColumn("_score", F.col("_alike") + F.when(F.col("_v"), 3.0).otherwise(0.0) + F.when(text.contains(q), 1.5).otherwise(0.0) + F.col("_t") / n + 1.2 * F.col("_n") / n)
    if key:
        rows = rows.where((F.col("_t") + F.col("_n") > 0) & ((F.col("_n") > 0) | (F.col("_score") >= 3.2)))
        rows = rows.where(F.col("_n") > 0) if strict else rows
    some = rows.where("_score > 0.35").orderBy(F.desc("_score"), "offer_id").limit(candidates)
    ranked = some.groupBy("product_name").agg((F.max("_alike") + F.max(F.when(F.col("_v"), 1.5).otherwise(0.0)) + F.least(F.count("*"), F.lit(10)) * 0.05).alias("score"))
    chosen = ranked.orderBy(F.desc("score"), "product_name").limit(most_products)
    prices = offers.where("price > 0").groupBy("product_name").agg(F.min("price").alias("best_price"), F.max("price").alias("max_price"), F.count("*").alias("vendor_count"))
    return prices.join(F.broadcast(chosen), "product_name").select("product_name", "score", "best_price", "max_price", "vendor_count")


def rank_index(index: DataFrame, terms: list[str], question: str, most: int = 6) -> DataFrame:
    """Index entries (title, text, priority, score_hint, vendor, product, sku, source_file) by score, the best of equal entries, ``most`` of them.

    4 for each term that an entry holds, 8 for one of several words; 24 for the
    whole question, 30 for a title that is the question, 12 for one of its
    first three words, 5 a priority, and the entry's hint.
    """
    hay = F.lower(F.concat_ws(" ", "title", "text"))
    score = sum((F.when(hay.contains(t), 8 if " " in t else 4).otherwise(0) for t in terms), F.lit(0))
    head = F.lit(False)
    for t in query_tokens(question)[:3]:
        head = head | hay.contains(t)
    score = score + F.when(hay.contains(question), 24).otherwise(0) * int(bool(question)) + F.when(F.lower("title") == question, 30).otherwise(0) + F.when(head, 12).otherwise(0) + F.col("priority") * 5 + F.col("score_hint")
    scored = index.withColumn("score", score).where("score > 0")
    same = ["vendor", "product", "sku", "source_file"]
    order = F.struct(F.col("score").alias("s"), (-F.col("priority")).alias("p"))
    best = scored.groupBy(*same).agg(F.max(order).alias("_o"))
    first = scored.join(best, same).where((F.col("score") == F.col("_o.s")) & (F.col("priority") == -F.col("_o.p"))).groupBy(*same, "score", "priority").agg(F.min(F.lower("title")).alias("_t"))
    return first.orderBy(F.desc("score"), "priority", "_t", *same).limit(most).withColumnRenamed("_t", "title")


def offer_rows(products: DataFrame) -> DataFrame:
    """Product records as offers; totals are in rupees, so a price in another currency counts as none."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    offer = F.concat(F.lit("vendor:"), F.col("id").cast("string"))
    currency = F.upper(F.trim(text("currency")))
    return products.where(F.trim(text("product_name")) != "").select(
        offer.alias("offer_id"), F.coalesce(F.nullif(text("sku"), F.lit("")), offer).alias("product_id"), F.col("company_key").alias("vendor_id"), "product_name", F.col("company_name").alias("vendor_name"),
        F.when(currency.isin("", "INR", "RS", "RS.", "₹"), A.recorded_price(F.col("price"))).otherwise(0.0).alias("price"), currency.alias("currency"))


def coverage(question_tokens: list[str], names: DataFrame, name: str, least: float) -> DataFrame:
    """(name, share): names of which the question holds at least the share ``least`` of the words."""
    asked = F.array(*map(F.lit, question_tokens)) if question_tokens else F.array().cast("array<string>")
    plain = F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", " ")
    rows = names.select(F.col(name).alias("name"), F.array_distinct(F.filter(F.split(plain, " "), lambda w: w != "")).alias("_w")).dropDuplicates(["name"])
    return rows.where(F.size("_w") > 0).withColumn("share", F.size(F.array_intersect("_w", asked)) / F.size("_w")).where(F.col("share") >= least).drop("_w")
