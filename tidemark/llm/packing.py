"""Bounded-space online packing of token sequences.

Each input partition keeps ``open_windows`` windows of ``capacity`` tokens.  A
piece goes to the window that it fills best; when none holds it, the fullest
window is topped up (if at least ``min_cut`` tokens are free) and emitted.
The windows still open at a partition's end are then merged across partitions,
in rounds of bounded groups, by the same best-fit rule.

Edge cases: a null or empty text is one piece holding only the end token;
repeated rows are packed once each; a document longer than ``capacity`` yields
full windows and one remainder; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, memos

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_ASCII_GAP = "\n\t\r\x0b\x0c"


class WordTokenizer:
    """Ids of whole texts, word by word with a bounded memo.

    The vocabulary's pre-tokenizer drops white space and never looks across it,
    so the ids of a text are those of its white-space separated words in order.
    It also splits letters from what is neither letter, number nor space: a
    word that only adds a full stop or comma to letters is put together.  New
    words are encoded in one call, parted at tokens that end a word or by
    ``|``, whose id no word without that character gives.
    """

    def __init__(self, path: str, end_id: int, memo: int = 600_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end, self.memo, self.known, self.old = np.array([end_id], "<u4").tobytes(), memo, {}, {}
        self.known[""] = b""
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.closing = {c: self._ids(c) for c in ".,"}
        self.bar = int(np.frombuffer(self._ids("|"), "<u4")[0])

    def _ids(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        known = self.known
        closed = [w for w in words if w[-1] in ".," and w[:-1].isalpha()]
        letters = [w for w in words if w.isalpha()]
        have = set(letters)
        letters += [h for h in {w[:-1] for w in closed} if h not in have and h not in known]
        if letters:
            # a run of letters is one pre-token, whose last token is marked as a word's end
            ids = np.array(self.tok.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(letters):
                raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
                known.update(zip(letters, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        rest = [w for w in [*letters, *words] if w not in known]
        heads = {w[:-1] for w in closed if w[:-1] in known}
        rest = list(dict.fromkeys(w for w in rest if not (w[-1] in ".," and w[:-1] in heads)))
        plain = [w for w in rest if "|" not in w]
        known.update((w, self._ids(w)) for w in rest if "|" in w)
        if plain:
            ids = np.array(self.tok.encode(" | ".join(plain), add_special_tokens=False).ids, "<u4")
            raw, cuts, at = ids.tobytes(), np.flatnonzero(ids == self.bar).tolist(), 0
            for w, cut in zip(plain, [*cuts, len(ids)], strict=True):
                known[w] = raw[at * 4 : cut * 4]
                at = cut + 1
        closing = self.closing
        known.update((w, known[w[:-1]] + closing[w[-1]]) for w in closed)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, end token included."""
        split = []
        for t in texts:
            for c in _ASCII_GAP:
                if t and c in t:
                    t = t.replace(c, " ")
            split.append(t.split(" ") if t else [])
        known = self.known
        missing = [w for w in set().union(*split) if w not in known]
        if missing and len(known) + len(missing) > self.memo:
            # the memo has two generations: words still in use come back from the old one
            self.old, self.known = known, (known := {"": b""})
            missing = [w for w in set().union(*split) if w not in known]
        if missing:
            old = self.old
            known.update((w, old[w]) for w in missing if w in old)
            self._learn([w for w in missing if w not in known])
        for words in split:
            yield b"".join(map(known.__getitem__, words)) + self.end


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}
memos.append(_TOKENIZERS)


def tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One per worker process, so that the memo outlives a task; the next operator's task lets it go."""
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = WordTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


class Windows:
    """A fixed number of open windows with best-fit placement.

    ``pieces`` are tuples (length, payload, cut) where ``cut(payload, at)``
    splits a payload; a payload that must stay whole passes ``cut=None``.
    """

    def __init__(self, capacity: int, limit: int, min_cut: int):
        self.capacity, self.limit, self.min_cut = capacity, limit, min_cut
        self.free: list[tuple[int, int]] = []  # sorted (free tokens, window number)
        self.held: dict[int, list] = {}
        self.number = 0

    def place(self, length: int, payload, cut=None) -> Iterator[list]:
        """Yields the windows that this piece completes."""
        while length > 0:
            if length >= self.capacity and cut:
                head, payload = cut(payload, self.capacity)
                length -= self.capacity
                yield [head]
                continue
            k = bisect.bisect_left(self.free, (length, -1))
            if k < len(self.free):
                room, w = self.free.pop(k)
                self.held[w].append(payload)
                if room == length:
                    yield self.held.pop(w)
                else:
                    bisect.insort(self.free, (room - length, w))
                return
            if len(self.free) >= self.limit:
                room, w = self.free.pop(0)
                if cut and room >= self.min_cut:
                    head, payload = cut(payload, room)
                    length -= room
                    self.held[w].append(head)
                yield self.held.pop(w)
                continue
            self.number += 1
            self.held[self.number] = [payload]
            bisect.insort(self.free, (self.capacity - length, self.number))
            return

    def rest(self) -> list[list]:
        return [self.held[w] for _, w in self.free]


def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[: at * 4], total), (doc, start + at, ids[at * 4 :], total)


def _rows(out: dict, window: list, sequence: int, is_open: bool) -> None:
    offset = 0
    for doc, start, ids, total in window:
        n = len(ids) // 4
        for name, v in zip(_NAMES, (doc, start, n, zlib.crc32(ids), total, sequence, offset)):
            out[name].append(v)
        out["ids"].append(ids if is_open else None)
        out["is_open"].append(is_open)
        offset += n


_ARROW = pa.schema([(n, pa.int64()) for n in _NAMES] + [("ids", pa.binary()), ("is_open", pa.bool_())])


def _batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(out, schema=_ARROW)


def _fresh() -> dict:
    return {n: [] for n in _ARROW.names}


def _packer(path: str, end_id: int, capacity: int, limit: int, min_cut: int):
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        tok, windows, done, out = tokenizer(path, end_id), Windows(capacity, limit, min_cut), 0, _fresh()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist())):
                    n = len(ids) // 4
                    for window in windows.place(n, (doc, 0, ids, n), _cut):
                        _rows(out, window, base + done, False)
                        done += 1
                if len(out["doc_id"]) >= 4096:
                    yield _batch(out)
                    out = _fresh()
        for window in windows.rest():
            _rows(out, window, base + done, True)
            done += 1
        yield _batch(out)

    return run


def _split_sizes(n: int, least: int) -> list[int]:
    """Powers of two that add up to ``n`` but for a last part below ``least``."""
    out = []
    while n >= least:
        p = 1 << (n.bit_length() - 1)
        out.append(p)
        n -= p
    return out + [n] * (n > 0)


def _merger(capacity: int, base: int, last: bool, least: int, min_cut: int):
    """Merges the open windows of one group; at most one window of a group stays open.

    Whole windows are placed best-fit first; then the emptiest windows are cut
    to fill the fullest, which leaves a single tail.  The last round cuts that
    tail to powers of two, which need no padding.
    """

    def run(key, pdf):
        import pandas as pd

        group = int(key[0])
        number = (1 << 62) + (base << 54) + (group << 30)
        windows, done, out = Windows(capacity, 1 << 30, min_cut), 0, _fresh()
        held = [
            (int(g["length"].sum()), [(r.doc_id, int(r.start), bytes(r.ids), int(r.doc_tokens)) for r in g.sort_values("offset").itertuples()])
            for _, g in pdf.groupby("sequence_id", sort=True)
        ]
        held.sort(key=lambda x: -x[0])
        for n, pieces in held:
            for window in windows.place(n, pieces):
                _rows(out, [p for x in window for p in x], number + done, False)
                done += 1
        rest = [[p for x in w for p in x] for w in windows.rest()]
        rest.sort(key=lambda w: -sum(len(p[2]) for p in w))
        tail, i = rest.pop() if rest else [], 0
        while i < len(rest):
            w = rest[i]
            room = capacity - sum(len(p[2]) // 4 for p in w)
            while room:
                if not tail:
                    if len(rest) == i + 1:
                        break
                    tail = rest.pop()
                p = tail.pop()
                n = len(p[2]) // 4
                if n > room:
                    head, p = _cut(p, room)
                    tail.append(p)
                    p, n = head, room
                w.append(p)
                room -= n
            i += 1
            if room:
                tail = w
                break
            _rows(out, w, number + done, False)
            done += 1
        if tail and last:
            sizes = _split_sizes(sum(len(p[2]) // 4 for p in tail), least)
            for size in sizes:
                w, room = [], size
                while room and tail:
                    p = tail.pop(0)
                    n = len(p[2]) // 4
                    if n > room:
                        head, p = _cut(p, room)
                        tail.insert(0, p)
                        p, n = head, room
                    w.append(p)
                    room -= n
                _rows(out, w, number + done, False)
                done += 1
        elif tail:
            _rows(out, tail, number + done, True)
        return pd.DataFrame(out)

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str, end_id: int = 2,
         capacity: int = 4096, open_windows: int = 128, min_cut: int = 16, least: int = 1, fan_in: int = 16) -> DataFrame:
    """Pack every document of ``docs``; one row per piece (see ``PIECE``).

    ``least``: the last leftovers are cut to powers of two no shorter than this.
    ``fan_in``: partitions whose leftovers one merge task takes; rounds repeat
    until one group is left, so no task sees more than
    ``fan_in * open_windows`` windows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{PIECE}, ids binary, is_open boolean"
    packed = scratch.write(source.mapInArrow(_packer(tokenizer_path, end_id, capacity, open_windows, min_cut), schema), "packed")
    parts = [packed.where("not is_open").select(_NAMES)]
    left = packed.where("is_open").withColumn("grp", F.shiftright("sequence_id", 40))
    groups = left.agg(F.max("grp")).first()[0]
    base = 0
    while groups is not None:
        groups //= fan_in
        left = left.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long"))
        merge = _merger(capacity, base, groups == 0, least, min_cut)
        done = scratch.write(left.groupBy("grp").applyInPandas(merge, schema), f"merged{base}")
        parts.append(done.where("not is_open").select(_NAMES))
        left = done.where("is_open").withColumn("grp", F.shiftright(F.col("sequence_id") - F.lit((1 << 62) + (base << 54)), 30))
        base += 1
        if groups == 0:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
