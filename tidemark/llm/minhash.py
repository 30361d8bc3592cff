"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has ``chunks * width`` values of 16 bits, one per hash function.
It is split into chunks; two signatures that differ in at most
``chunks * (errors + 1) - 1`` values differ in at most ``errors`` values of some
chunk (pigeonhole), so enumerating the allowed errors of each chunk finds all
such pairs by equality of keys.  Found pairs are confirmed on the full shingle
sets.

Texts with equal shingle sets are one class from the start.  Within a bucket
members are first compared with its smallest member; only buckets that still
hold several components are searched further, in blocks of bounded size: a pass
over signatures finds who takes part in which block, a second brings their sets
there and confirms pairs across components, each in the first bucket that the
pair shares.  What leaves a block is a spanning forest of its links, so no
group of copies is expanded into pairs.

Edge cases: a null, empty or blank text has no shingle and links with nothing;
fewer words than a shingle make one shingle; repeated rows are copies; an empty
table gives an empty result; a null id sorts first and is its own smallest; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import wordmath as wm
from tidemark.llm.common import Scratch, tidy
from tidemark.llm.components import components


@dataclass(frozen=True)
class Config:
    """``chunks`` of ``width`` values with ``errors`` allowed in a chunk; links at ``similarity`` percent or more."""

    words: int = 5
    similarity: int = 75
    chunks: int = 9
    width: int = 5
    errors: int = 1
    seed: int = 11
    block: int = 512
    #: Pairs that agree in fewer values are not confirmed: six standard deviations below what a link shows.
    least_equal: int = 16

    @property
    def size(self) -> int:
        return self.chunks * self.width


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = wm.string_buffers(column)
    out = []
    for lo, hi in wm.slices(offsets):
        h, at = wm.word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        g = wm.grams(h, words)
        for a, b in itertools.pairwise(at.tolist()):
            n = b - a
            if n >= words:
                out.append(np.unique(g[a : b - words + 1]))
            elif n:
                # the whole sequence; its length keeps it apart from longer shingles
                out.append(wm.grams(h[a:b], n) ^ np.uint64(n))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray], cfg: Config) -> np.ndarray:
    """16-bit minima of each set (rows) under each hash function (columns); empty sets get zeros."""
    rng = np.random.default_rng(cfg.seed)
    mul = rng.integers(1, 1 << 63, cfg.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sig = np.zeros((len(sets), cfg.size), dtype=np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    for lo in range(0, len(full), 256):
        ids = full[lo : lo + 256]
        flat = np.concatenate([sets[i] for i in ids])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in ids])[:-1]])
        for k in range(cfg.size):
            with np.errstate(over="ignore"):
                v = flat * mul[k]
                v ^= v >> np.uint64(32)
                v *= mul[k - 1]
            low = np.minimum.reduceat(v, starts)
            sig[ids, k] = (wm.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return sig


def _sign(cfg: Config):
    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), []
            for lo in range(0, batch.num_rows, 1024):
                sets = shingle_sets(batch.column(1).slice(lo, 1024), cfg.words)
                with np.errstate(over="ignore"):
                    marks = [(int(s.sum().astype(np.int64)), int(np.bitwise_xor.reduce(wm.mix(s + np.uint64(1))).astype(np.int64))) if len(s) else (0, 0) for s in sets]
                sig = _signatures(sets, cfg)
                parts.append((np.array([len(s) for s in sets], np.int64), np.array(marks, np.int64).reshape(-1, 2), sig))
            if not parts:
                continue
            n, m, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
            data = pa.array([x.tobytes() for x in s.astype("<u2")], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(m[:, 0]), pa.array(m[:, 1]), data], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return run


def _kept(cfg: Config) -> list[list[int]]:
    """The signature positions of each key."""
    return [[c * cfg.width + i for i in kept] for c in range(cfg.chunks) for kept in itertools.combinations(range(cfg.width), cfg.width - cfg.errors)]


def keys(sig: np.ndarray, cfg: Config) -> np.ndarray:
    """Bucket keys of signatures: for each chunk, each way to leave ``errors`` values out."""
    s, out = sig.astype(np.uint64), []
    for k, kept in enumerate(_kept(cfg)):
        with np.errstate(over="ignore"):
            h = np.full(len(s), k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for i in kept:
                h = wm.mix(h ^ s[:, i]) + np.uint64(0x632BE59BD9B4E019)
        out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def _read(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, size)


def _key_rows(cfg: Config, carry: int):
    """(id, ..., sig) to one row per key: key, its number and the first ``carry`` columns."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                k = keys(_read(part.column(part.num_columns - 1), cfg.size), cfg)
                rep = pa.array(np.repeat(np.arange(part.num_rows), k.shape[1]))
                slot = np.tile(np.arange(k.shape[1], dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(slot)] + [part.column(i).take(rep) for i in range(carry)], names=["key", "slot"] + [part.schema.names[i] for i in range(carry)])

    return run


def _runs(batches, key_at: int = 0):
    """Runs of equal keys in a key-sorted stream; a run is held, nothing else."""
    held, key = [], None
    for batch in batches:
        k = batch.column(key_at).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in itertools.pairwise(cuts.tolist()):
            if held and k[a] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(t: pa.Table, cfg: Config):
    """Pairs of rows of a block that may be links across components, in the first bucket they share; best first."""
    ids, comp, size = (t.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
    side, slot = t.column("side").to_numpy(), int(t.column("slot")[0].as_py())  # side 1: left, 2: right, 3: both
    sig, kept = _read(t.column("sig").combine_chunks(), cfg.size), _kept(cfg)
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    out = []
    step = max(1, 200_000 // max(1, len(right)))
    for lo in range(0, len(left), step):
        rows = left[lo : lo + step]
        ok = comp[rows][:, None] != comp[right][None, :]
        # inside a block with itself each pair shows up twice
        ok &= (ids[rows][:, None] < ids[right][None, :]) | ((side[rows] != 3)[:, None] | (side[right] != 3)[None, :])
        ok &= 100 * np.minimum(size[rows][:, None], size[right][None, :]) >= cfg.similarity * np.maximum(size[rows][:, None], size[right][None, :])
        x, y = np.nonzero(ok)
        xs, ys = rows[x], right[y]
        same = sig[xs] == sig[ys]
        agree = same.sum(axis=1)
        good = agree >= cfg.least_equal
        for earlier in kept[:slot]:
            good[good] &= ~same[good][:, earlier].all(axis=1)
        out.append(np.stack([xs[good], ys[good], agree[good]], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pairs[np.argsort(-pairs[:, 2], kind="stable")]


def _take_part(cfg: Config):
    """Bucket blocks to the rows of them that have a pair to confirm."""

    def run(batches):
        for t in _runs(batches):
            if t.num_rows < 2:
                continue
            pairs = _candidates(t, cfg)
            if len(pairs):
                hit = pa.array(np.unique(pairs[:, :2]))
                yield from t.select(["bucket", "slot", "id", "component", "side"]).take(hit).combine_chunks().to_batches()

    return run


def _judge(cfg: Config):
    """Bucket blocks with full sets to a spanning forest of their links across components."""

    def run(batches):
        for t in _runs(batches):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy()
            top: dict[int, int] = {}

            def root(c: int) -> int:
                while top.get(c, c) != c:
                    c = top[c]
                return c

            a, b = [], []
            for x, y, _ in _candidates(t, cfg).tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q and _linked(sets[x], sets[y], cfg):
                    top[max(p, q)] = min(p, q)
                    a.append(min(ids[x], ids[y])), b.append(max(ids[x], ids[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(p: np.ndarray, q: np.ndarray, cfg: Config) -> bool:
    """Whether two sorted sets are similar enough."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= cfg.similarity * (len(both) - common)


def _set_rows(cfg: Config):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column(1), cfg.words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def _confirm(cfg: Config):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                if _linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), cfg):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


class _Join:
    """The state of one run: classes with signatures, and the texts they stand for."""

    def __init__(self, docs: DataFrame, scratch: Scratch, cfg: Config):
        self.docs, self.scratch, self.cfg = docs, scratch, cfg

    def sets(self, wanted: DataFrame, name: str) -> DataFrame:
        """(id, shingles) of the classes in ``wanted``."""
        reps = self.reps.join(wanted, "id").select("id", "r_id", "r_key")
        texts = reps.hint("shuffle_hash").join(self.docs, reps["r_id"].eqNullSafe(self.docs["doc_id"]) & (reps["r_key"] == self.docs["t_key"])).select("id", "text")
        return self.scratch.write(texts.mapInArrow(tidy(_set_rows(self.cfg)), "id long, shingles binary").dropDuplicates(["id"]), name)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (class numbers a < b) whose full sets are similar enough."""
        pairs = self.scratch.write(pairs, "pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "sets")
        a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
        out = self.scratch.write(both.mapInArrow(tidy(_confirm(self.cfg)), "a long, b long"), "links")
        self.scratch.drop("sets")
        return out


def classes_and_links(docs: DataFrame, scratch: Scratch, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Signed rows with their class number, and confirmed links between classes that connect every component."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("t_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    schema = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, t_key binary"

    def sign(batches):
        inner = _sign(cfg)
        for batch in batches:
            for out in inner([batch.select(["doc_id", "text"])]):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column("t_key")], names=[*out.schema.names, "t_key"])

    signed = scratch.write(src.mapInArrow(tidy(sign), schema), "signed")
    # one class per distinct set; the class number is given once and written down
    classes = (
        signed.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2")
        .agg(F.min(F.struct("doc_id", "t_key", "sig")).alias("m"))
        .select("n_shingles", "s1", "s2", F.col("m.doc_id").alias("r_id"), F.col("m.t_key").alias("r_key"), F.col("m.sig").alias("sig"), F.monotonically_increasing_id().alias("id"))
    )
    classes = scratch.write(classes, "classes")
    join = _Join(src, scratch, cfg)
    join.reps = classes.select("id", "r_id", "r_key")
    sig = classes.select("id", "n_shingles", "sig")
    # buckets with two classes or more
    key_rows = scratch.write(sig.select("id", "sig").mapInArrow(tidy(_key_rows(cfg, 1)), "key long, slot int, id long"), "keys")
    shared = scratch.write(key_rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), "shared")
    crowded = scratch.write(key_rows.join(shared, "key"), "crowded")
    scratch.drop("keys")
    stars = crowded.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    a, b = sig.select(F.col("id").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("na")), sig.select(F.col("id").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("nb"))
    near = stars.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= cfg.similarity * F.greatest("na", "nb")).mapInArrow(tidy(_near(cfg)), "a long, b long")
    links = join.links(near)
    labels = components(links, scratch, "stars")
    marked = crowded.join(labels, crowded["id"] == labels["v"], "left").select("key", "slot", "id", F.coalesce("component", "id").alias("component"))
    # exactly: every pair across components that shares a bucket, in blocks of bounded size
    mixed = marked.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 <> c1").select("key", "n")
    rows = marked.join(mixed, "key").join(sig, "id")
    count = F.ceil(F.col("n") / cfg.block).cast("int")
    mine = F.pmod(F.xxhash64("id"), count).cast("int")
    # a row of block m is left in (m, j > m), right in (i < m, m), and both in (m, m)
    meets = F.transform(F.sequence(F.lit(0), count - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"), F.when(o == mine, 3).when(o > mine, 1).otherwise(2).alias("side")))
    dealt = rows.select("key", "slot", "id", "component", "n_shingles", "sig", F.inline(meets))
    dealt = dealt.select(F.xxhash64("key", "i", "j").alias("bucket"), "slot", "id", "component", "n_shingles", "sig", "side")
    part = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_take_part(cfg)), "bucket long, slot int, id long, component long, side int")
    part = scratch.write(part, "part")
    sets = join.sets(part.select("id").distinct(), "part-sets").join(sig, "id")
    full = part.join(sets, "id").select("bucket", "slot", "id", "component", "n_shingles", "sig", "side", "shingles")
    found = scratch.write(full.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_judge(cfg)), "a long, b long"), "forest")
    scratch.drop("part-sets")
    links = links.unionByName(found)
    return signed.drop("sig").join(classes.select("n_shingles", "s1", "s2", "id"), ["n_shingles", "s1", "s2"], "left"), links


def _near(cfg: Config):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _read(batch.column(batch.schema.get_field_index("x")), cfg.size), _read(batch.column(batch.schema.get_field_index("y")), cfg.size)
            good = pa.array((x == y).sum(axis=1) >= cfg.least_equal)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(good) for c in ("a", "b")], names=["a", "b"])

    return run


def _placed(docs: DataFrame, scratch: Scratch, cfg: Config) -> DataFrame:
    """doc_id, t_key, n_shingles and the row's group ``cls`` (null without shingles), one row per row of ``docs`` (doc_id, text)."""
    rows, links = classes_and_links(docs, scratch, cfg)
    labels = components(links, scratch, "final")
    out = scratch.write(rows.join(labels, rows["id"] == labels["v"], "left").select("doc_id", "t_key", "n_shingles", F.coalesce("component", "id").alias("cls")), "placed")
    scratch.drop("signed", "classes", "shared", "crowded", "pairs", "links", "part", "forest")
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cfg: Config = Config()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, one row per document."""
    scratch = Scratch(docs.sparkSession, "minhash")
    placed = _placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scratch, cfg)
    least = placed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "cls", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, *, cfg: Config = Config()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without all but one of each group.

    The smallest (id, hash of the text) stays; of rows with equal ids and texts
    the one whose other columns hash lowest.  Rows without words are no copies
    of anything, so all of them stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    names = docs.columns
    placed = _placed(docs.select("doc_id", "text"), scratch, cfg).where("cls is not null")
    address = lambda: F.concat_ws("/", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.hex("t_key"))
    one = placed.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t_key")).alias("m")).select("m.doc_id", "m.t_key")
    one = one.select(address().alias("_stays"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wordy = text.rlike("[^\\x20\\x09-\\x0D]")
    plain = [f.name for f in docs.schema if f.dataType.typeName() in ("string", "long", "integer", "double", "float", "boolean", "date", "timestamp", "short", "byte", "decimal", "binary")]
    row = docs.where(wordy).select(F.struct(*names).alias("row"), F.xxhash64(*plain).alias("h"), "doc_id", F.unhex(F.md5(text)).alias("t_key"))
    # repeated rows shrink to one on the map side, so no address is hot after the shuffle
    rows = row.select("row", "h", address().alias("at")).groupBy("at").agg(F.min_by("row", "h").alias("row"))
    kept = rows.join(one, rows["at"] == one["_stays"], "left_semi").select("row.*")
    return kept.unionByName(docs.where(~wordy))
