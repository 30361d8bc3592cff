"""Retrieval: nearest names by n-gram weights, vectors by distance, passages by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T


def grams(c: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of each word with a blank on both sides; short words give themselves."""
    padded = F.transform(T.tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w, n: F.when(F.length(w) <= n, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[cut(w, n) for n in sizes])))


def tfidf(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, gram, df, w): weights (1 + ln tf)(ln((1 + n)/(1 + df)) + 1), each row of length one."""
    tf = rows.select(F.col(id_col).alias("id"), F.explode(grams(text)).alias("gram")).groupBy("id", "gram").agg((1 + F.log(F.count("*"))).alias("tf"))
    n = rows.agg(F.count("*").alias("n"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    raw = tf.join(df, "gram").crossJoin(F.broadcast(n)).withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", "df", (F.col("raw") / F.col("norm")).alias("w"))


def nearest_names(rows: DataFrame, id_col: str, text: Column, checkpoint, k: int = 5, least: float = 0.5) -> DataFrame:
    """(l, r, cosine): for each row its ``k`` nearest others with cosine ``least`` or more; ties by id.

    Candidates come from prefixes: with grams in order of rarity, two rows that
    are ``least`` alike share a gram before either's remaining weight falls
    below ``least``.  Common grams lie behind that point and are never joined.
    Rows with equal weights are not collapsed: give distinct texts.
    """
    w = checkpoint(tfidf(rows, id_col, text), "weights")
    tail = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = w.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(tail))).where(F.col("rest") >= least - 1e-9).select("id", "gram")
    pairs = prefix.select("gram", F.col("id").alias("l")).join(prefix.select("gram", F.col("id").alias("r")), "gram").where("l < r").select("l", "r").distinct()
    bag = w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))
    both = pairs.join(bag.select(F.col("id").alias("l"), F.col("v").alias("x")), "l").join(bag.select(F.col("id").alias("r"), F.col("v").alias("y")), "r")
    dot = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col("y"), e["key"]), F.lit(0.0)))
    close = both.select("l", "r", F.round(dot, 9).alias("cosine")).where(F.col("cosine") >= least)
    ways = close.unionByName(close.select(F.col("r").alias("l"), F.col("l").alias("r"), "cosine"))
    return ways.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("cosine"), "r"))).where(F.col("n") <= k).drop("n")


def nearest_vectors(rows: DataFrame, id_col: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """The ``k`` vectors with the smallest squared distance to one query vector: a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.where(F.size(vector) == len(query)).select(id_col, d.alias("distance")).orderBy("distance", id_col).limit(k)


def passage_hits(documents: DataFrame, id_col: str, text: str, query: str, per_document: int = 3, step: int = 1000, size: int = 1200) -> DataFrame:
    """(id, passage_no, hits, score): best passages of each document for a query's words.

    A passage counts with two of the words (one for a query of one word), or
    with a word of six letters; score = 4 hits + lengths of the hits / 4.
    """
    words = list(dict.fromkeys(query.lower().split()))
    p = documents.select(id_col, F.posexplode(T.passages(F.col(text), step, size)).alias("passage_no", "passage"))
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(T.tokens(F.col("passage")), w))
    hits = p.select(id_col, "passage_no", found.alias("found")).withColumn("hits", F.size("found"))
    score = 4.0 * F.col("hits") + F.aggregate("found", F.lit(0.0), lambda acc, w: acc + F.length(w) / 4.0)
    good = hits.where((F.col("hits") >= min(2, len(words))) | F.exists("found", lambda w: F.length(w) >= 6)).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "passage_no"))
    return good.withColumn("rank", rank).where(F.col("rank") <= per_document).select(id_col, "passage_no", "hits", "score", "rank")


def coverage(name: Column, query: str) -> Column:
    """Share of a name's words that the query has."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    t = F.array_distinct(T.tokens(name))
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, words)) / F.size(t)).otherwise(0.0)
