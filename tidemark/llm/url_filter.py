"""URL filters as a cascade of Bloom filters.

Level 1 encodes the listed keys.  Level 2 encodes the unlisted keys of the
corpus that level 1 lets through, level 3 the listed keys that level 2 lets
through, and so on until nothing is wrong: over the corpus's complete key
universe membership is exact, and looking a key up needs no join.  Everything
is DataFrame and SQL functions.

Edge cases: a null url, or one without ``://``, has an empty host and path and
no rule; repeated urls are judged alike; an empty table gives an empty result;
an empty list lists nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, ascii_lower

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions in one binary value, ``hashes`` probes per key."""

    seed: int
    bits: int
    hashes: int
    data: bytes

    def holds(self, key: Column) -> Column:
        whole, out = F.lit(self.data), None
        for at in _positions(key, self.seed, self.bits, self.hashes):
            # one byte of the value, as a number; its bits count from the lowest
            byte = F.ascii(F.decode(F.substring(whole, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            bit = byte.bitwiseAND(_one_at(at, 8).cast("int")) != 0
            out = bit if out is None else out & bit
        return out


def _one_at(at: Column, width: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(width)).cast("int"))


def _positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(64 * seed + i)), F.lit(bits)) for i in range(hashes)]


def bits_for(n: int, rate: float) -> int:
    return max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))


def _bloom(keys: DataFrame, seed: int, n: int, rate: float) -> Level:
    """A Bloom filter of ``keys`` (column ``key``), or-ed word by word in the cluster; the driver gets only the filled words."""
    bits = bits_for(n, rate)
    hashes = max(1, round(bits / n * math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, bits, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(_one_at(F.col("at"), 64)).alias("v"))
    data = bytearray(bits // 8)
    for row in words.toLocalIterator():
        data[8 * row["w"] : 8 * row["w"] + 8] = row["v"].to_bytes(8, "little", signed=True)
    return Level(seed, bits, hashes, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """True exactly for listed keys, for any key of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.holds(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def first_rate(listed: int, other: int, rate: float) -> float:
    """The share of unlisted keys that level 1 may let through: so few that level 2 is no larger than the list."""
    return min(rate, math.sqrt(0.5) * listed / max(1, other))


def build_cascade(universe: DataFrame, listed: DataFrame, *, rate: float = 0.02, max_bits: int = 1 << 28, max_levels: int = 64) -> Cascade | None:
    """Both inputs have one string column ``key``; ``universe`` holds every key that will be looked up.

    ``max_bits`` proves the size of what each task carries for a level (32 MiB,
    some 5 to 30 million listed keys); None if a level needs more.  Levels shrink
    by ``rate`` each, so a handful ends the cascade.
    """
    spark = universe.sparkSession
    scratch = Scratch(spark, "cascade")
    listed = scratch.write(listed.select("key").where(F.col("key").isNotNull()).distinct(), "listed")
    other = scratch.write(
        universe.select("key").where(F.col("key").isNotNull()).distinct().join(listed, "key", "left_anti"), "other"
    )
    levels: list[Level] = []
    inside, outside = listed, other  # the next level encodes ``inside`` and is tested against ``outside``
    while True:
        n = inside.count()
        if not n:
            break
        if len(levels) == max_levels:
            raise ValueError("the cascade does not end; lower rate")
        share = 0.5 * rate if levels else first_rate(n, other.count(), rate)
        if bits_for(n, share) > max_bits:
            return None
        level = _bloom(inside, len(levels) + 1, n, share)
        levels.append(level)
        wrong = scratch.write(outside.where(level.holds(F.col("key"))), f"wrong{len(levels)}")
        inside, outside = wrong, inside
    return Cascade(tuple(levels))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key (host suffix + path prefix) a rule could have to fit, longest first.

    Path prefixes take the given lengths only: no rule has another.
    """
    labels = F.split(host, "\\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.array_sort(F.array_distinct(keys), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _rule_rows(spark, rules, default: str):
    """The rules as a table (key, verdict): of equal keys the first verdict in order counts."""
    rows = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(v, h, p) for v, h, p in rules] or [], "verdict string, host string, path string")
    keyed = rows.where("verdict is not null").select(F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"), "verdict", F.length(F.coalesce("path", F.lit(""))).alias("n"))
    return keyed.groupBy("key").agg(F.min("verdict").alias("verdict"), F.collect_set("n").alias("n"))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = "allow",
                rate: float = 0.02, max_bits: int = 1 << 28) -> DataFrame:
    """Judge every url: id, host, path, rule (longest that fits, else null) and verdict.

    ``rules``: (verdict, host, path) tuples, or a DataFrame of these columns
    for long lists.  A rule fits its host and all subdomains if the url's path
    starts with the rule's.  Unlisted urls get ``default``.  One cascade per
    verdict is built over the corpus's distinct rule keys; a list that needs
    more than ``max_bits`` in a level is looked up by an equality join instead.
    Of rules of equal length the first in key order wins, of equal rules the
    first verdict in order.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    table = Scratch(spark, "rules").write(_rule_rows(spark, rules, default), "rules")
    told = table.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("n")))).alias("n"), F.array_sort(F.collect_set("verdict")).alias("v")).first()
    lengths, verdicts = sorted(told["n"] or [], reverse=True), told["v"] or []
    if not verdicts:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keys = rule_keys(F.col("host"), F.col("path"), lengths)
    universe = rows.select(F.explode(keys).alias("key"))
    cascades = {v: build_cascade(universe, table.where(F.col("verdict") == v).select("key"), rate=rate, max_bits=max_bits) for v in verdicts}
    if None in cascades.values():
        return _by_join(rows, keys, table, default)

    def verdict_of(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for v in verdicts:
            out = F.when(cascades[v].member(key), F.lit(v)).otherwise(out)
        return out

    hits = F.filter(F.transform(keys, lambda k: F.struct(k.alias("rule"), verdict_of(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
    return rows.withColumn("_hit", F.get(hits, F.lit(0))).select(
        "page_id", "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), F.lit(default)).alias("verdict")
    )


def _by_join(rows: DataFrame, keys: Column, table: DataFrame, default: str) -> DataFrame:
    """The same verdicts for lists beyond any cascade's bound: each distinct place is judged by joins on its keys."""
    places = rows.select("host", "path").distinct()
    asked = places.select("host", "path", F.posexplode(keys).alias("at", "key")).join(table.select("key", "verdict"), "key")
    best = asked.groupBy("host", "path").agg(F.min(F.struct("at", "key", "verdict")).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.key").alias("rule"), F.coalesce(F.col("b.verdict"), F.lit(default)).alias("verdict"))
