"""Sharding by a k-d tree over metadata.

A node is split at a distributed weighted median along the dimension in which
its documents spread widest, until each leaf holds its share of the bytes.
Medians come from histograms that are summed in the cluster; the driver sees at
most ``nodes * BINS`` rows of them, whatever the corpus holds.

Rows with equal texts have equal coordinates and share a shard.  A text that
weighs more than ``tolerance`` of a leaf goes down the tree as one weighted
point, and the other rows' cut makes up for its weight.  Only a text that
weighs more than a whole leaf is spread by the row's id.

Edge cases: a null text has no bytes and the coordinates of an empty one; when
all documents are alike the split falls back to the hash order; repeated rows
stay together like other copies; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions_for, table

BITS = 12
BINS = 1 << BITS
_LOW = 48


def text_dimensions(text: Column) -> dict[str, Column]:
    """Metadata that follow from the text alone."""
    size = F.octet_length(text).cast("double")
    return {
        "log_bytes": F.log2(size + 1),
        "bytes_per_char": size / F.greatest(F.length(text), F.lit(1)),
        "line_share": (F.length(text) - F.length(F.translate(text, "\n", "")) + 1) / F.greatest(F.length(text), F.lit(1)),
    }


class _Node:
    def __init__(self, leaves: int):
        self.leaves, self.dim, self.cut, self.left, self.right, self.number = leaves, 0, 0, None, None, 0
        self.heavy: list = []

    def label(self, keys: list[str], of) -> Column:
        if self.left is None:
            return F.lit(of(self))
        below = F.col(keys[self.dim]) < F.lit(self.cut)
        return F.when(below, self.left.label(keys, of)).otherwise(self.right.label(keys, of))

    def tips(self) -> list[_Node]:
        return [self] if self.left is None else self.left.tips() + self.right.tips()


def _cut_bins(rows: list, goal: dict[int, float], before: dict[int, float]) -> dict[int, tuple[int, float]]:
    """Per node the bin in which the running weight passes its goal, and the weight before that bin."""
    out, run = {}, dict(before)
    for node, b, w in sorted((r["node"], r["bin"], r["w"]) for r in rows):
        if node in out or node not in goal:
            continue
        if run[node] + w >= goal[node]:
            out[node] = (b, run[node])
        else:
            run[node] += w
    return out


def _deal(heavy: list, key: str, cut: int, leaves: tuple[int, int], room: list[float]) -> tuple[list, list]:
    """Heavy texts to the two sides of a cut (a bin of ``key``) by place, where they fit; ``room`` is the weight each side may take."""
    half, free, out = sum(room) / sum(leaves) / 2, list(leaves), ([], [])

    def fits(r, side: int) -> bool:
        # two texts above half a leaf cannot share one
        return room[side] >= r["w"] and (r["w"] <= half or free[side] > 0)

    for r in sorted(heavy, key=lambda r: (-r["w"], r["h"])):
        b, wide = r[key] >> _LOW, 0 if room[0] >= room[1] else 1
        side = 0 if b < cut else 1 if b > cut else wide
        if not fits(r, side):
            side = 1 - side if fits(r, 1 - side) else wide
        room[side] -= r["w"]
        free[side] -= r["w"] > half
        out[side].append(r)
    return out


def kd_tree(points: DataFrame, keys: list[str], leaves: int, heavy: list = ()) -> tuple[Column, dict[int, int]]:
    """The leaf of each row as an expression over ``keys``, and the leaf of each heavy text; ``points`` also has ``size``.

    Keys are non-negative longs: ``BITS`` bits of the dimension over 48 hashed
    bits.  ``heavy``: rows of h, w and the keys, not among ``points``.
    """
    root = _Node(leaves)
    root.heavy = list(heavy)
    while True:
        tips = [t for t in root.tips() if t.leaves > 1]
        if not tips:
            break
        for k, t in enumerate(root.tips()):
            t.number = k
        number = root.label(keys, lambda t: t.number if t.leaves > 1 else -1)
        at = points.select("size", *keys, number.alias("node")).where("node >= 0")
        spread = at.groupBy("node").agg(
            F.sum("size").alias("w"),
            *[F.min(F.shiftright(k, _LOW)).alias(f"lo_{k}") for k in keys], *[F.max(F.shiftright(k, _LOW)).alias(f"hi_{k}") for k in keys],
        ).collect()
        light = {r["node"]: r for r in spread}
        by = {t.number: t for t in tips if t.number in light or t.heavy}
        total = {n: (light[n]["w"] if n in light else 0) + sum(r["w"] for r in t.heavy) for n, t in by.items()}
        for n, t in by.items():
            ends = [[r[k] >> _LOW for r in t.heavy] + ([light[n][f"lo_{k}"], light[n][f"hi_{k}"]] if n in light else []) for k in keys]
            widths = [max(e) - min(e) for e in ends]
            t.dim = widths.index(max(widths))
        goal = {n: total[n] * (by[n].leaves // 2) / by[n].leaves for n in total}
        key = F.lit(None).cast("long")
        for d, name in enumerate(keys):
            mine = [n for n in total if by[n].dim == d]
            key = F.when(F.col("node").isin(mine), F.col(name)).otherwise(key) if mine else key
        at = at.select("size", "node", key.alias("key"))
        low, base, before, sides = {n: 0 for n in total}, 60, {n: 0.0 for n in total}, {}
        for step in range(3):
            base -= BITS
            here = F.lit(False)
            for n in total:
                here = here | ((F.col("node") == n) & (F.shiftright("key", base + BITS) == F.lit(low[n] >> (base + BITS))))
            rows = at.where(here).groupBy("node", F.shiftright("key", base).alias("bin")).agg(F.sum("size").alias("w")).collect()
            if not step:
                # heavy texts are dealt about the cut of all weights; the others' cut then fills each side up to its goal
                weighed = [{"node": n, "bin": r[keys[t.dim]] >> base, "w": r["w"]} for n, t in by.items() for r in t.heavy]
                first = _cut_bins([*rows, *weighed], goal, before)
                for n, t in by.items():
                    sides[n] = _deal(t.heavy, keys[t.dim], first[n][0] if n in first else BINS, (t.leaves // 2, t.leaves - t.leaves // 2), [goal[n], total[n] - goal[n]])
                    goal[n] -= sum(r["w"] for r in sides[n][0])
            found = _cut_bins(rows, {n: g for n, g in goal.items() if g > 0}, before)
            for n, (b, w) in found.items():
                low[n], before[n] = b << base, w
        for t in tips:
            # a node without rows, or without room on the left, keeps cut 0: everything to come goes right
            filled = t.number in light and goal[t.number] > 0
            t.cut = low[t.number] + (1 << base) if filled else 0
            t.left, t.right = _Node(t.leaves // 2), _Node(t.leaves - t.leaves // 2)
            t.left.heavy, t.right.heavy = sides.get(t.number, ([], []))
    for k, t in enumerate(root.tips()):
        t.number = k
    return root.label(keys, lambda t: t.number), {r["h"]: t.number for t in root.tips() for r in t.heavy}


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, overhead: int = 16,
          tolerance: float = 0.02, dimensions=text_dimensions, slot_rows: int = 20_000) -> DataFrame:
    """Shard and slot of every document: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dims = dimensions(F.col("_t"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", (F.octet_length("_t") + overhead).cast("long").alias("size"), F.crc32("_t").alias("text_crc32"), F.xxhash64("_t").alias("h"),
        *[c.cast("double").alias(f"d_{n}") for n, c in dims.items()],
    )
    rows = scratch.write(rows, "rows")
    names = list(dims)
    ends = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[F.min(f"d_{n}").alias(f"lo_{n}") for n in names], *[F.max(f"d_{n}").alias(f"hi_{n}") for n in names]).first()
    if not ends["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    def key(n: str, order: Column) -> Column:
        lo, hi = ends[f"lo_{n}"], ends[f"hi_{n}"]
        level = F.floor((F.col(f"d_{n}") - lo) / (hi - lo) * (BINS - 1)) if hi > lo else F.lit(0)
        return F.shiftleft(level.cast("long"), _LOW).bitwiseOR(order.bitwiseAND(F.lit((1 << _LOW) - 1))).alias(f"k_{n}")

    keys = [f"k_{n}" for n in names]
    # at most shards / tolerance texts can be this heavy, so bringing and broadcasting them is bounded
    heavy = rows.groupBy("h").agg(F.sum("size").alias("w"), *[F.min(f"d_{n}").alias(f"d_{n}") for n in names]).where(F.col("w") > tolerance * ends["bytes"] / shards)
    heavy = heavy.select("h", "w", *[key(n, F.col("h")) for n in names]).collect()
    whole = [r for r in heavy if r["w"] <= ends["bytes"] / shards]
    kinds = spark.createDataFrame([(r["h"], r["w"] <= ends["bytes"] / shards) for r in heavy], "hot long, whole boolean")
    placed = rows.join(F.broadcast(kinds), rows["h"] == kinds["hot"], "left")
    order = F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64("doc_id", "h"))
    points = scratch.write(placed.select("doc_id", "size", "text_crc32", F.when(F.col("whole"), F.col("hot")).alias("group"), *[key(n, order) for n in names]), "points")
    leaf, tops = kd_tree(points.where("group is null"), keys, shards, whole)
    tops = spark.createDataFrame(list(tops.items()), "group long, top int")
    points = points.join(F.broadcast(tops), "group", "left")
    leaf = F.coalesce("top", leaf)
    # slots: rows are numbered in bounded runs, whose offsets are added
    runs = partitions_for(ends["n"], shards * slot_rows)
    put = points.select("doc_id", "size", "text_crc32", leaf.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).alias("run"))
    counts = put.groupBy("shard", "run").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "run", (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")) - 1
    return put.withColumn("i", inside).join(offsets, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
