"""Connected components and pointer chains of tables of links, without bringing them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rounds of ``components`` that go by number before hashes take turns.
BY_NUMBER = 3


def components(edges: DataFrame, checkpoint, name: str = "cc", max_rounds: int = 100) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (longs a, b); component is its smallest vertex.

    Each round every vertex takes the first label among itself and its
    neighbours, labels are followed one step further, and edges are rewritten
    to labels; edges inside a component vanish, so the table shrinks every
    round.  The first rounds go by the smallest number, which ends stars at
    once; from then on every other round goes by a hash, which shrinks chains
    by a constant share whatever their numbering.  ``checkpoint(frame, name)``
    writes a frame and reads it back, so that a lost executor costs a re-read.
    Loops and repeated edges change nothing; no edges give no rows.
    """
    live = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-e0")
    labels, hashed = None, False
    for k in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if k >= BY_NUMBER and k % 2 == BY_NUMBER % 2:
            hashed = True
            first = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
            near = both.groupBy(F.col("a").alias("v")).agg(F.min(first("b")).alias("m")).select("v", F.least(first("v"), "m")["v"].alias("m"))
        else:
            near = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        # follow the label's own label once
        hop = near.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        step = checkpoint(near.join(hop, "m").select("v", F.col("mm").alias("to")), f"{name}-s{k}")
        if labels is None:
            labels = step.select("v", F.col("to").alias("component"))
        else:
            moved = labels.join(step.select(F.col("v").alias("component"), "to"), "component", "left")
            labels = checkpoint(moved.select("v", F.coalesce("to", "component").alias("component")), f"{name}-l{k}")
        a, b = step.select(F.col("v").alias("a"), F.col("to").alias("ta")), step.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        moved = live.join(a, "a").join(b, "b").where("ta <> tb")
        live = checkpoint(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"{name}-e{k + 1}")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("component")).limit(0)
    if not hashed:
        # labels of vertices that later rounds moved are rewritten above, so each is its component's smallest vertex
        return labels
    least = labels.groupBy("component").agg(F.min("v").alias("least"))
    return checkpoint(labels.join(least, "component").select("v", F.col("least").alias("component")), f"{name}-least")


def chain_ends(pointers: DataFrame, checkpoint, name: str = "chain") -> DataFrame:
    """(id, target): where chains of ``pointers`` (id, target; one per id) end.  An id whose chain runs into a cycle has a null target.

    Pointers double each round until none has anything to follow, however long
    the chains; a chain of n rows needs about log2(n) rounds.
    """
    now = checkpoint(pointers.select("id", "target").where("target is not null and id <> target").dropDuplicates(["id"]), f"{name}0")
    limit = now.count().bit_length() + 1
    for k in range(1, limit + 1):
        nxt = now.select(F.col("id").alias("target"), F.col("target").alias("next"))
        got = checkpoint(now.join(nxt, "target", "left").select("id", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")), f"{name}{k}")
        now = got.drop("moved")
        if got.where("moved").isEmpty():
            return now
    # whatever can still be followed after as many doublings as there are rows goes round in a cycle
    more = now.select(F.col("id").alias("target"), F.lit(True).alias("again"))
    return now.join(more, "target", "left").select("id", F.when(F.col("again").isNull(), F.col("target")).alias("target"))
