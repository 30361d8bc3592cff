"""Substring dedup with repeated-phrase automata.

A window of ``window`` words recurs if its word sequence starts anywhere else.

1. Every text is fingerprinted by the smallest hash among the short grams of
   each window (winnowing); windows that recur share such an anchor, so only
   windows whose anchor recurs are looked at.
2. Hashes of these windows are counted in the cluster; recurring ones are
   joined back to their places and merged into passages, each with the place
   of its first occurrence, which supplies the phrase's words.
3. Phrases are compiled into Aho-Corasick automata, one per bounded shard of
   documents and of the phrases that concern them, and every document is
   streamed through its shard's automaton, which locates each occurrence of
   each phrase word for word.  Words inside an occurrence are removed.

Documents without a recurring anchor cannot hold a phrase; they pass through
with their counts.  Equal texts are searched once.

Edge cases: a null, empty or blank text has no words; texts shorter than a
window lose nothing; repeated rows are copies of each other; overlapping
occurrences are removed once, and which of equal windows came first changes
nothing, for all go; a null id is an id of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import wordmath as wm
from tidemark.llm.common import WORD_GAP, Scratch, tidy

_GAPS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


@dataclass(frozen=True)
class Config:
    """``gram``: words of an anchor; ``shard_chars``: phrase characters that one automaton takes."""

    window: int = 35
    gram: int = 12
    shard_chars: int = 2_000_000

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


def words_of(text: str | None) -> list[str]:
    return [w for w in text.translate(_GAPS).split(" ") if w] if text else []


def _rows_of(column: pa.Array):
    """Word hashes of each row, worked out in slices of bounded size."""
    raw, offsets = wm.string_buffers(column)
    for lo, hi in wm.slices(offsets):
        h, at = wm.word_hashes(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, h, at


def _anchors(cfg: Config):
    """(key, text) to (key, n_words, anchors, counts): distinct anchors of a text and how often each is picked."""

    def run(batches):
        for batch in batches:
            n_words, values, counts = [], [], []
            for _, h, at in _rows_of(batch.column(1)):
                g = wm.grams(h, cfg.gram)
                for a, b in itertools.pairwise(at.tolist()):
                    n_words.append(b - a)
                    if b - a < cfg.window:
                        values.append(np.zeros(0, np.int64)), counts.append(np.zeros(0, np.int32))
                        continue
                    mine = g[a : b - cfg.gram + 1]
                    low = wm.sliding(mine, cfg.span)
                    # picked: smallest in some window that holds it
                    padded = np.concatenate([np.zeros(cfg.span - 1, np.uint64), low, np.zeros(cfg.span - 1, np.uint64)])
                    picked = mine[wm.sliding(padded, cfg.span, np.maximum) == mine]
                    v, c = np.unique(picked, return_counts=True)
                    values.append(v.view(np.int64)), counts.append(c.astype(np.int32))
            cuts = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = (np.concatenate(values), np.concatenate(counts)) if values else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), *lists], names=["doc_id", "t_key", "n_words", "anchors", "counts"])

    return run


def _windows(cfg: Config, bits: int):
    """(uid, text, anchors) to one row per window whose anchor is among the recurring ones; a place is the uid over ``bits`` of the position."""

    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            out = [[], []]
            for lo, h, at in _rows_of(batch.column(1)):
                g, w = wm.grams(h, cfg.gram), wm.grams(h, cfg.window, second=True)
                for r, (a, b) in enumerate(itertools.pairwise(at.tolist())):
                    if b - a < cfg.window:
                        continue
                    known = np.array(batch.column(2)[lo + r].as_py(), dtype=np.int64).view(np.uint64)
                    low = wm.sliding(g[a : b - cfg.gram + 1], cfg.span)
                    pos = np.flatnonzero(np.isin(low, known))
                    out[0].append((uid[lo + r] << bits) | pos), out[1].append(w[a + pos].view(np.int64))
                if sum(map(len, out[1])) > 50_000:
                    yield _window_batch(out)
                    out = [[], []]
            if out[0]:
                yield _window_batch(out)

    return run


def _window_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["place", "w"])


def _phrases(batches):
    """(uid, text, wants: array of (start, words)) to the phrases' words."""
    for batch in batches:
        for uid, text, wants in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = words_of(text)
            got = [" ".join(words[x["start"] : x["start"] + x["words"]]) for x in wants]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uid] * len(got), pa.int64()), pa.array([x["start"] for x in wants], pa.int32()), pa.array([x["words"] for x in wants], pa.int32()), pa.array(got, pa.string())],
                names=["src", "start", "words", "phrase"])


def locate(texts: list[list[str]], phrases: list[set[str]], shard_chars: int):
    """Which words of each text lie in an occurrence of a phrase; one automaton per shard of texts."""
    import ahocorasick

    lo = 0
    while lo < len(texts):
        shard: set[str] = set()
        hi, size = lo, 0
        while hi < len(texts):
            fresh = phrases[hi] - shard
            more = sum(map(len, fresh))
            if hi > lo and size + more > shard_chars:
                break
            shard |= fresh
            size += more
            hi += 1
        auto = ahocorasick.Automaton()
        for p in shard:
            auto.add_word(f" {p} ", (len(p) + 2, p.count(" ") + 1))
        if shard:
            auto.make_automaton()
        for words in texts[lo:hi]:
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            if shard and words:
                ends = np.cumsum([len(w) + 1 for w in words])  # index of the space after each word in the joined text
                for end, (length, n) in auto.iter(f" {' '.join(words)} "):
                    last = int(np.searchsorted(ends, end))
                    gone[last - n + 1] += 1
                    gone[last + 1] -= 1
            yield np.cumsum(gone[:-1]) > 0
        lo = hi


def _remove(cfg: Config):
    """(uid, text, phrases) to (uid, n_removed, kept_sha256)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                known = [set(p or ()) for p in part.column(2).to_pylist()]
                n, sha = [], []
                for words, gone in zip(texts, locate(texts, known, cfg.shard_chars)):
                    n.append(int(gone.sum()))
                    sha.append(hashlib.sha256(" ".join([w for w, g in zip(words, gone) if not g]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["uid", "n_removed", "kept_sha256"])

    return run


def joined(text: Column) -> Column:
    """The words of a text joined by one space."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_GAP}|{WORD_GAP}$", ""), WORD_GAP, " ")


def _numbered(classes: DataFrame) -> DataFrame:
    """``uid`` of a written table made gapless, from the row counts of its partitions."""
    part = F.shiftright("uid", 33)
    counts = sorted((r["p"], r["n"]) for r in classes.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for p, n in counts:
        base += [F.lit(p), F.lit(total)]
        total += n
    if not base:
        return classes
    at = F.create_map(*base)
    return classes.withColumn("uid", F.element_at(at, part).cast("long") + F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cfg: Config = Config()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("t_key", F.unhex(F.md5("text")))
    # 1. anchors; a text whose anchors show up in another text, or twice in itself, is looked at
    marked = src.select("doc_id", "text", "t_key").mapInArrow(tidy(_anchors(cfg)), "doc_id long, t_key binary, n_words long, anchors array<long>, counts array<int>")
    marked = scratch.write(marked, "marked")
    classes = marked.groupBy("t_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max("n_words").alias("words"))
    classes = _numbered(scratch.write(classes.select(F.monotonically_increasing_id().alias("uid"), "*"), "classes"))
    # a place takes 63 bits: as many for positions as the longest text needs, the rest for texts
    most = classes.agg(F.max("words").alias("words"), F.max("uid").alias("uid")).first()
    bits = int(most["words"] or 0).bit_length()
    if bits + int(most["uid"] or 0).bit_length() > 63:
        raise ValueError("more distinct texts than 63 bits can number beside the longest one's words")
    picks = marked.select("doc_id", "t_key", F.inline(F.arrays_zip(F.col("anchors").alias("h"), F.col("counts").alias("c")))).toDF("doc_id", "t_key", "h", "c")
    text_mark = F.xxhash64("t_key")
    seen = picks.groupBy("h").agg(F.min(text_mark).alias("k0"), F.max(text_mark).alias("k1"), F.max("c").alias("c"))
    recurring = scratch.write(seen.where("k0 <> k1 or c > 1").select("h"), "recurring")
    reps = classes.where(F.col("words") >= cfg.window).select("uid", "rep", "t_key")
    own = picks.join(recurring, "h", "left_semi").groupBy("t_key", "doc_id").agg(F.collect_set("h").alias("anchors"))
    looked = own.join(reps, own["doc_id"].eqNullSafe(reps["rep"]) & (own["t_key"] == reps["t_key"])).select("uid", own["t_key"].alias("a_key"), "rep", "anchors")
    # the one shuffle of whole texts; what follows reads this smaller table
    texts = scratch.write(
        looked.hint("shuffle_hash").join(src, looked["rep"].eqNullSafe(src["doc_id"]) & (looked["a_key"] == src["t_key"])).select("uid", "text", "anchors"),
        "texts",
    )
    # 2. recurring windows and passages
    windows = scratch.write(texts.mapInArrow(tidy(_windows(cfg, bits)), "place long, w long"), "windows")
    counted = windows.groupBy("w").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
    counted = scratch.write(counted.select("w", "first"), "counted")
    mask = F.lit((1 << bits) - 1)
    hits = windows.join(counted, "w").select(
        F.shiftright("place", bits).alias("uid"), F.col("place").bitwiseAND(mask).alias("pos"),
        F.shiftright("first", bits).alias("src"), F.col("first").bitwiseAND(mask).alias("at"))
    # consecutive places that continue in one source are one passage
    line = Window.partitionBy("uid", "src", F.col("at") - F.col("pos")).orderBy("pos")
    chained = hits.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("uid", "src", (F.col("at") - F.col("pos")).alias("shift"), "run").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    passages = scratch.write(chained.select("uid", "src", F.col("start").cast("int").alias("start"), (F.col("n") + cfg.window - 1).cast("int").alias("words")), "passages")
    scratch.drop("windows", "counted")
    wants = passages.select("src", "start", "words").distinct().groupBy("src").agg(F.collect_list(F.struct("start", "words")).alias("wants"))
    bare = texts.select("uid", "text")
    phrases = scratch.write(bare.join(wants, bare["uid"] == wants["src"]).select("uid", "text", "wants").mapInArrow(tidy(_phrases), "src long, start int, words int, phrase string").dropDuplicates(["src", "start", "words"]), "phrases")
    # 3. automata over the documents and their phrases
    mine = passages.join(phrases, ["src", "start", "words"]).groupBy("uid").agg(F.collect_set("phrase").alias("phrases"))
    found = scratch.write(bare.join(mine, "uid").select("uid", "text", "phrases").mapInArrow(tidy(_remove(cfg)), "uid long, n_removed long, kept_sha256 string").dropDuplicates(["uid"]), "found")
    judged = classes.join(found, "uid", "left")
    whole = (F.col("copies") > 1) & (F.col("words") >= cfg.window)
    judged = judged.select(
        "t_key", "words",
        F.when(whole, F.col("words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("found_sha"),
    )
    rows = src.select("doc_id", "t_key", F.sha2(joined(F.col("text")), 256).alias("all_sha"))
    return rows.join(judged, "t_key").select(
        "doc_id", F.col("words").alias("n_words"), "n_removed", F.coalesce("found_sha", "all_sha").alias("kept_sha256"))
