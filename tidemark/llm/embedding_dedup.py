"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation for binary codes is learned on a bounded sample; every vector gets
a code by hyperplanes through the origin.  Codes are cut into tables; a vector probes, in each table,
the buckets within ``errors`` bits of its own chunk.  A pair is judged in the
first table in which it meets, so each is counted once; a first pass over codes
alone finds who takes part in which bucket, a second brings the original
vectors there and computes cosines in double precision.

Pairs never leave a bucket: what leaves is each vector's number of links and
the links of a spanning forest of the bucket.  Buckets beyond ``block`` rows
are dealt out as pairs of blocks.

Edge cases: vectors that are null, empty, zero, or with null or non-finite
components link with nothing; vectors of different lengths do not link with
each other; equal vectors are one class with a multiplicity; repeated rows are
copies; of equal smallest ids, and where a null id stands among others, the
number that is there counts; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import components


@dataclass(frozen=True)
class Config:
    """``sample`` bounds the rows that the rotation is learned from.

    A pair at cosine 0.9 differs in 9.2 of 64 bits with a deviation of 2.8;
    ``radius`` lies four deviations above, so it loses almost no link.
    """

    cosine: float = 0.9
    sample: int = 5000
    iterations: int = 30
    bits: int = 64
    tables: int = 5
    errors: int = 1
    radius: int = 20
    block: int = 2048
    seed: int = 3

    def chunks(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each table."""
        cuts = [self.bits * t // self.tables for t in range(self.tables + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Codebook:
    project: np.ndarray  # dimensions x bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """64-bit codes of unit vectors."""
        bits = (x @ self.project > 0).astype(np.uint64)
        return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def planted(x: np.ndarray, cosine: float, towards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and partners at exactly ``cosine``, turned in the directions ``towards``."""
    side = towards - (towards * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((side * side).sum(axis=1))
    ok = size > 1e-9
    x, side = x[ok], side[ok] / size[ok, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * side


def recall(book: Codebook, x: np.ndarray, cfg: Config) -> float:
    """Share of pairs at the threshold that are judged; the worse of partners in any direction and towards other vectors."""
    rng = np.random.default_rng(cfg.seed)
    out = []
    for towards in (rng.normal(size=x.shape), x[rng.permutation(len(x))] - x):
        a, b = (book.codes(v) for v in planted(x, cfg.cosine, towards))
        met = np.zeros(len(a), bool)
        for first, n in cfg.chunks():
            met |= np.bitwise_count(((a ^ b) >> np.uint64(first)) & np.uint64((1 << n) - 1)) <= cfg.errors
        if len(a):
            out.append(float((met & (np.bitwise_count(a ^ b) <= cfg.radius)).mean()))
    return min(out, default=0.0)


def learn(x: np.ndarray, cfg: Config) -> Codebook:
    """The rotation that brings the centred sample closest to its own signs, or its random start where that finds more.

    Only the rotation is learned from centred vectors.  Codes take hyperplanes
    through the origin: there the bits in which a pair differs follow its own
    angle, whatever direction all vectors share.
    """
    rng = np.random.default_rng(cfg.seed)
    dim, bits = x.shape[1], min(cfg.bits, 64)
    start = np.linalg.qr(rng.normal(size=(max(dim, bits), max(dim, bits))))[0][:dim, :bits]
    if not len(x):
        return Codebook(start)
    v = (x - x.mean(axis=0)) @ start
    r, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(cfg.iterations):
        b = np.where(v @ r > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return max(Codebook(start @ r), Codebook(start), key=lambda book: recall(book, x, cfg))


def vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length the usable vectors as doubles, and which rows these are."""
    rows = column.to_pylist()
    by: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        if v and all(c is not None for c in v):
            by.setdefault(len(v), []).append(i)
    out = []
    for good in by.values():
        x = np.array([rows[i] for i in good], dtype=np.float64)
        ok = np.isfinite(x).all(axis=1) & (np.abs(x) > 0).any(axis=1)
        out.append((x[ok], np.array(good, np.int64)[ok]))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(handle, cfg: Config):
    """(id, v, mark) to (id, code, vec, d, mark); a length that the sample lacks gets the random start."""

    def run(batches):
        books = dict(handle.value)
        for batch in batches:
            for x, rows in vectors(batch.column(1)):
                if not len(rows):
                    continue
                dim = x.shape[1]
                if dim not in books:
                    books[dim] = learn(np.zeros((0, dim)), cfg)
                codes = books[dim].codes(unit(x)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(codes), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(x), dim, np.int64)), batch.column(2).take(pa.array(rows))], names=["id", "code", "vec", "d", "mark"])

    return run


def _probes(cfg: Config):
    """(id, code, d) to one row per table and probed chunk value: key, id, code, own (the value is its own)."""

    def run(batches):
        flips = []
        for t, (first, n) in enumerate(cfg.chunks()):
            for e in range(cfg.errors + 1):
                for at in itertools.combinations(range(n), e):
                    flips.append((t, first, n, sum(1 << i for i in at)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                code, size = part.column(1).to_numpy().view(np.uint64), part.column(2).to_numpy()
                for t, first, n, flip in flips:
                    chunk = (code >> np.uint64(first)) & np.uint64((1 << n) - 1)
                    # table, length of the vector, chunk: vectors of different lengths never meet
                    key = (np.int64(t) << 58) | (size << 32) | (chunk ^ np.uint64(flip)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), part.column(1), pa.array(np.full(len(code), flip == 0))], names=["key", "id", "code", "own"])

    return run


def _first_here(p: np.ndarray, m: np.ndarray, table: int, cfg: Config) -> np.ndarray:
    """Which pairs (probers x members) meet in no earlier table and lie within the radius."""
    x = p[:, None] ^ m[None, :]
    ok = np.bitwise_count(x) <= cfg.radius
    for first, n in cfg.chunks()[:table]:
        ok &= np.bitwise_count((x >> np.uint64(first)) & np.uint64((1 << n) - 1)) > cfg.errors
    return ok


def _groups(batches, extra: list[str]):
    """Runs of equal bucket in a bucket-sorted stream."""
    held, last = [], None
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in itertools.pairwise(cuts.tolist()):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _take_part(cfg: Config):
    """Bucket blocks over codes to (bucket, key, id, prober, member) of those with a pair to judge."""

    def run(batches):
        for t in _groups(batches, []):
            if t.num_rows < 2:
                continue
            code = t.column("code").to_numpy().view(np.uint64)
            ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
            key = int(t.column("key")[0].as_py())
            p, m = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            if not len(p) or not len(m):
                continue
            asks, gives = np.zeros(len(code), bool), np.zeros(len(code), bool)
            for lo in range(0, len(p), 1024):
                ok = _first_here(code[p[lo : lo + 1024]], code[m], key >> 58, cfg) & (ids[p[lo : lo + 1024]][:, None] != ids[m][None, :])
                asks[p[lo : lo + 1024]] |= ok.any(axis=1)
                gives[m] |= ok.any(axis=0)
            hit = np.flatnonzero(asks | gives)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [t.column("bucket").combine_chunks().take(pa.array(hit)), pa.array(np.full(len(hit), key)), pa.array(ids[hit]), pa.array((asks[hit] + 2 * gives[hit]).astype(np.int32))],
                    names=["bucket", "key", "id", "side"])

    return run


def _judge(cfg: Config):
    """Bucket blocks with vectors to link counts (other = null) and forest links (n = 0)."""

    def run(batches):
        for t in _groups(batches, []):
            code = t.column("code").to_numpy().view(np.uint64)
            ids, side, weight = t.column("id").to_numpy(), t.column("side").to_numpy(), t.column("weight").to_numpy()
            x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
            u = unit(x)
            key = int(t.column("key")[0].as_py())
            p, m = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            if not len(p) or not len(m):
                continue
            count = np.zeros(len(ids), np.int64)
            # label = smallest row of the component; a vector may stand twice in a block, its rows start joined
            _, label = np.unique(ids, return_inverse=True)
            firsts = np.full(label.max() + 1, len(ids))
            np.minimum.at(firsts, label, np.arange(len(ids)))
            label = firsts[label]
            for lo in range(0, len(p), 1024):
                rows = p[lo : lo + 1024]
                ok = _first_here(code[rows], code[m], key >> 58, cfg) & (ids[rows][:, None] != ids[m][None, :])
                ok &= u[rows] @ u[m].T >= cfg.cosine
                count[rows] += ok @ weight[m]
                for i in np.flatnonzero(ok.any(axis=1)):
                    near = np.append(label[m[ok[i]]], label[rows[i]])
                    if near.min() != near.max():
                        label[np.isin(label, near)] = near.min()
            tops = ids[label]
            hit, far = np.flatnonzero(count), np.flatnonzero(tops != ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[hit], ids[far]])), pa.array(np.concatenate([count[hit], np.zeros(len(far), np.int64)])), pa.array(np.concatenate([np.full(len(hit), -1), tops[far]]))],
                names=["id", "n", "other"])

    return run


def dedup(table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cfg: Config = Config()) -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable) and kept, one row per vector."""
    spark = table.sparkSession
    scratch = Scratch(spark, "embeddings")
    src = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("mark", F.xxhash64("v"))
    usable = src.where("v is not null and size(v) > 0 and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    # a row is addressed by its id and its vector: ids may repeat or be null
    ids = src.select("vec_id", "mark")
    fit = usable.select("v", F.xxhash64("vec_id", F.lit(cfg.seed)).alias("h")).orderBy("h").limit(cfg.sample).collect()
    if not fit:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    by: dict[int, list] = {}
    for r in fit:
        by.setdefault(len(r["v"]), []).append(r["v"])
    books = {dim: learn(unit(np.array(x, dtype=np.float64)), cfg) for dim, x in by.items()}
    handle = spark.sparkContext.broadcast(books)
    coded = scratch.write(usable.select("vec_id", "v", "mark").mapInArrow(_encode(handle, cfg), "id long, code long, vec binary, d long, mark long"), "coded")
    classes = coded.groupBy("vec").agg(F.min("id").alias("least"), F.min("code").alias("code"), F.min("d").alias("d"), F.count("*").alias("weight"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("id"), "least", "code", "d", "weight", "vec"), "classes")
    probes = classes.select("id", "code", "d").mapInArrow(_probes(cfg), "key long, id long, code long, own boolean")
    probes = scratch.write(probes, "probes")
    # buckets that someone owns and someone else probes; large ones are dealt as pairs of blocks
    sizes = probes.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("m")).where("m > 0 and n > 1")
    n_p, n_m = F.ceil(F.col("n") / cfg.block).cast("int"), F.ceil(F.col("m") / cfg.block).cast("int")
    rows = probes.join(sizes, "key")
    i, j = F.pmod(F.xxhash64("id"), n_p).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), n_m).cast("int")
    asks = F.transform(F.sequence(F.lit(0), n_m - 1), lambda b: F.struct(i.alias("i"), b.alias("j"), F.lit(1).alias("s")))
    gives = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), n_p - 1), lambda a: F.struct(a.alias("i"), j.alias("j"), F.lit(2).alias("s")))).otherwise(F.array().cast("array<struct<i:int,j:int,s:int>>"))
    dealt = rows.select("key", "id", "code", F.inline(F.concat(asks, gives))).groupBy("key", "i", "j", "id", "code").agg(F.sum("s").cast("int").alias("side"))
    dealt = dealt.select(F.xxhash64("key", "i", "j").alias("bucket"), "key", "id", "code", "side")
    part = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_take_part(cfg), "bucket long, key long, id long, side int")
    part = scratch.write(part, "part")
    scratch.drop("probes")
    full = part.join(classes.select("id", "code", "weight", "vec"), "id").select("bucket", "key", "id", "side", "code", "weight", "vec")
    judged = scratch.write(full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge(cfg), "id long, n long, other long"), "judged")
    counts = judged.where("other = -1").groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(judged.where("other >= 0").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    group = classes.select("id", "least", "weight", "vec").join(counts, "id", "left").join(labels, classes["id"] == labels["v"], "left")
    group = group.select("id", "least", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("top"))
    group = scratch.write(group, "group")
    least = group.groupBy("top").agg(F.min("least").alias("component_id"))
    placed = group.join(least, "top").select("vec", "n_links", "component_id")
    found = coded.select(F.col("id").alias("f_id"), F.col("mark").alias("f_mark"), "vec").join(placed, "vec").select("f_id", "f_mark", "n_links", "component_id").dropDuplicates(["f_id", "f_mark"])
    component = F.coalesce("component_id", "vec_id")
    return ids.join(found, ids["vec_id"].eqNullSafe(found["f_id"]) & (ids["mark"] == found["f_mark"]), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
