"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits.  It is split into k + 1
pieces: at least one of them then occurs unchanged.  One Aho-Corasick automaton
finds all piece hits in one pass over a text, and Myers' bit-parallel distance
verifies the text around each hit.

Texts are compared lower-cased and with white space collapsed.

Edge cases: null or blank items and documents match nothing; an item too short
for an edit budget must occur exactly; repeated items and rows are reported
once each; of equally good places the first counts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, item_id long, distance int, budget int, end_at long"


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of ``length`` characters."""
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 contiguous pieces of nearly equal length, with their starts."""
    n = k + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item ready for Myers' algorithm on integers as wide as the item."""

    def __init__(self, item: str):
        self.n, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def best(self, text: str, k: int) -> tuple[int, int] | None:
        """Least distance of the item to a substring of ``text`` and that substring's end, if at most k."""
        n, masks = self.n, self.masks
        full, top = (1 << n) - 1, 1 << (n - 1)
        vp, vn, d, found = full, 0, n, None
        for j, c in enumerate(text):
            eq = masks.get(c, 0)
            x = eq | vn
            d0 = ((((x & vp) + vp) ^ vp) | x) & full
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp
            if hp & top:
                d += 1
            elif hn & top:
                d -= 1
            hp, hn = (hp << 1) & full, (hn << 1) & full  # the text may start anywhere: no carry into row 0
            vp = (hn | ~(d0 | hp)) & full
            vn = d0 & hp
            if d <= k and (found is None or d < found[0]):
                found = (d, j + 1)
                if not d:
                    break
        return found


class Matcher:
    """All items of one block and their automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.auto, self.items, by_piece = ahocorasick.Automaton(), [], {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text), rate)
            self.items.append((item_id, Pattern(text), k, len(text)))
            for at, piece in pieces(text, k):
                by_piece.setdefault(piece, []).append((len(self.items) - 1, at))
        for piece, owners in by_piece.items():
            self.auto.add_word(piece, (len(piece), owners))
        if by_piece:
            self.auto.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, budget, end) of every item within its budget."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (length, owners) in self.auto.iter(text):
            for i, at in owners:
                _, _, k, n = self.items[i]
                lo = end - length + 1 - at
                spans.setdefault(i, []).append([max(0, lo - k), min(len(text), lo + n + k)])
        out = []
        for i, found in spans.items():
            item_id, pattern, k, _ = self.items[i]
            # overlapping windows are verified as one
            found.sort()
            best, run = None, found[0]
            for a, b in [*found[1:], [len(text) + 1, len(text) + 1]]:
                if a <= run[1]:
                    run[1] = max(run[1], b)
                    continue
                got = pattern.best(text[run[0] : run[1]], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], run[0] + got[1])
                run = [a, b]
            if best:
                out.append((item_id, best[0], k, best[1]))
        return out


#: Compiled blocks of this worker process by pass and block, latest last; their number is bounded.
_MATCHERS: dict[tuple[str, int], Matcher] = {}
HELD = 2


def _matcher(handle, name: str, k: int, rate: float) -> Matcher:
    got = _MATCHERS.pop((name, k), None) or Matcher(handle.value[k], rate)
    while len(_MATCHERS) >= HELD:
        del _MATCHERS[next(iter(_MATCHERS))]
    _MATCHERS[name, k] = got
    return got


def _finder(handle, name: str, n_blocks: int, rate: float):
    def run(batches):
        for batch in batches:
            for k in range(n_blocks):
                matcher = _matcher(handle, name, k, rate)
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    rows = [(doc, *hit) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for hit in matcher.find(normalise(text))]
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())],
                            names=["doc_id", "item_id", "distance", "budget", "end_at"],
                        )

    return run


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int):
    """Items in blocks of at most ``block_chars`` characters (one item more at the end), streamed to the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        text = normalise(row[1])
        block.append((row[0], text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
         item_text_col: str = "text", rate: float = 0.08, block_chars: int = 1_000_000, pass_blocks: int = 32) -> DataFrame:
    """One row per document and item that occurs in it within ``rate`` edits per character.

    The benchmark is the stated query set: it is taken in blocks of bounded
    size, each an automaton that a worker process compiles and keeps.  One pass
    over the documents takes ``pass_blocks`` blocks, which bounds what is
    broadcast; only a larger benchmark costs another pass.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out, held = None, []

    def scan(some: list) -> None:
        nonlocal out
        handle = spark.sparkContext.broadcast(some)
        part = src.mapInArrow(_finder(handle, uuid.uuid4().hex, len(some), rate), SCHEMA)
        out = part if out is None else out.unionByName(part)

    for block in blocks(benchmark, item_id_col, item_text_col, block_chars):
        held.append(block)
        if len(held) == pass_blocks:
            scan(held)
            held = []
    if held:
        scan(held)
    return out if out is not None else spark.createDataFrame([], SCHEMA)
