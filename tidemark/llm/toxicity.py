"""A convolutional text classifier for toxicity, trained in numpy.

Words are hashed into embedding rows (the word itself and its prefixes, so rare
inflections share strength), filters of several widths slide over them, each
filter is max-pooled over the whole text, and a logistic unit scores the
result.  Thresholds are calibrated by language on rows held back from training.

Inference needs no matrix product per word: each filter's share of a word is
computed once per distinct word and gathered.

Edge cases: a null, empty or blank text has no words and all pooled features
zero; unlabelled rows are scored like others; a language without enough
calibration rows uses the threshold of all rows; an empty table gives an empty
result; repeated rows are scored once each and train once; of equal cuts the one
in the widest gap is taken; other columns are carried through.
"""

from __future__ import annotations

import pickle
import string
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import settle, tidy

_STRIP = string.punctuation + "«»„“”‘’¿¡…–—"
#: Words that are worked on at once.
WORDS = 50_000
_GAPS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


@dataclass(frozen=True)
class Config:
    """Bounds and sizes of the model; ``rows``, ``size`` (bytes of text) and ``words`` bound the training sample."""

    rows: int = 6000
    size: int = 32_000_000
    words: int = 2_500_000
    buckets: int = 1 << 16
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    prefixes: tuple[int, ...] = (4, 5, 6)
    epochs: int = 8
    steps: int = 1200
    batch: int = 32
    rate: float = 0.05
    init: float = 0.005
    seed: int = 7
    calibration: float = 0.2


def word_rows(word: str, cfg: Config) -> tuple[int, ...]:
    """Embedding rows of one word: hashed, lower-cased, without edge punctuation."""
    w = word.lower().strip(_STRIP) or word
    keys = [w] + [w[:n] + "*" for n in cfg.prefixes]
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % cfg.buckets for k in keys)


def words_of(text: str | None) -> list[str]:
    return [w for w in text.translate(_GAPS).split(" ") if w] if text else []


@dataclass
class Model:
    cfg: Config
    emb: np.ndarray  # buckets x dim
    conv: list[np.ndarray]  # per width: width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """Words (as embedding rows) to their share in every filter position."""
        e = self.emb[rows].sum(axis=1)
        return np.concatenate([np.einsum("nd,df->nf", e, w[j]) for w in self.conv for j in range(w.shape[0])], axis=1).astype(np.float32)

    def pooled(self, shares: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Max over each text of every filter's activation (at least 0)."""
        cfg, n, out, col = self.cfg, len(offsets) - 1, [], 0
        lengths = np.diff(offsets)
        for k, width in enumerate(cfg.widths):
            f = cfg.filters
            parts = [shares[:, col + j * f : col + (j + 1) * f] for j in range(width)]
            col += width * f
            best = np.zeros((n, f), dtype=np.float32)
            size = len(shares) - width + 1
            some = np.flatnonzero(lengths >= width)
            if size > 0 and len(some):
                act = parts[0][:size].copy()
                for j in range(1, width):
                    act += parts[j][j : j + size]
                # reduceat runs from each start to the next, so ends are given as starts of ignored runs
                at = np.empty(2 * len(some), dtype=np.int64)
                at[0::2], at[1::2] = offsets[some], offsets[some + 1] - width + 1
                trail = at[-1] >= size
                best[some] = np.maximum.reduceat(act, at[:-1] if trail else at, axis=0)[0::2]
                best = np.maximum(best + self.bias[k].astype(np.float32), 0)
                best[lengths < width] = 0
            out.append(best)
        return np.concatenate(out, axis=1)

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.astype(np.float64) @ self.out + self.out_bias

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(pooled) + self.shift, -60, 60)))


def _numbers(text: list[str], vocab: dict[str, int]) -> np.ndarray:
    """The words' numbers in ``vocab``, to which new ones are added."""
    return np.fromiter((vocab.setdefault(w, len(vocab)) for w in text), dtype=np.int32, count=len(text))


def _rows(vocab: dict[str, int], cfg: Config) -> np.ndarray:
    return np.array([word_rows(w, cfg) for w in vocab], dtype=np.int64).reshape(-1, 1 + len(cfg.prefixes))


def _steps(order: np.ndarray, seqs: list[np.ndarray], cfg: Config):
    """``order`` in steps of ``cfg.batch`` texts, or fewer where these have over ``WORDS`` words."""
    held, size = [], 0
    for i in order:
        if held and (len(held) == cfg.batch or size + len(seqs[i]) > WORDS):
            yield np.array(held)
            held, size = [], 0
        held.append(i)
        size += len(seqs[i])
    if held:
        yield np.array(held)


def _fit(seqs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, cfg: Config) -> Model:
    """The model of texts given as word numbers; ``rows`` has each word's embedding rows."""
    rng = np.random.default_rng(cfg.seed)
    emb = rng.normal(0, cfg.init, (cfg.buckets, cfg.dim))
    conv = [rng.normal(0, 0.5 / np.sqrt(cfg.dim * w), (w, cfg.dim, cfg.filters)) for w in cfg.widths]
    bias = [np.zeros(cfg.filters) for _ in cfg.widths]
    n_out = cfg.filters * len(cfg.widths)
    m = Model(cfg, emb, conv, bias, rng.normal(0, 0.3, n_out), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))))
    g_emb = np.full(cfg.buckets, 1e-8)
    acc = [np.full(w.shape, 1e-8) for w in conv] + [np.full(b.shape, 1e-8) for b in bias] + [np.full(n_out, 1e-8), np.full(1, 1e-8)]
    order = np.arange(len(seqs))
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)) ** 0.5

    def step(p: np.ndarray, g: np.ndarray, a: np.ndarray) -> None:
        a += g * g
        p -= cfg.rate * g / np.sqrt(a)

    # a small sample gets more passes, up to the same number of steps
    for _ in range(cfg.epochs and max(cfg.epochs, min(60, cfg.steps * cfg.batch // max(1, len(order))))):
        rng.shuffle(order)
        for ids in _steps(order, seqs, cfg):
            flat = np.concatenate([seqs[i] for i in ids] or [np.zeros(0, np.int32)])
            lengths = np.array([len(seqs[i]) for i in ids])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            own, inv = np.unique(flat, return_inverse=True)
            e_own = m.emb[rows[own]].sum(axis=1)
            e = e_own[inv]
            pooled, picks = np.zeros((len(ids), n_out)), np.full((len(ids), n_out), -1, dtype=np.int64)
            for k, width in enumerate(cfg.widths):
                size = len(flat) - width + 1
                if size <= 0:
                    continue
                act = np.zeros((size, cfg.filters))
                for j in range(width):
                    act += (e_own @ m.conv[k][j])[inv][j : j + size]
                act += m.bias[k]
                c = slice(k * cfg.filters, (k + 1) * cfg.filters)
                for r in range(len(ids)):
                    a, b = offsets[r], offsets[r + 1] - width + 1
                    if b > a:
                        at = act[a:b].argmax(axis=0)
                        v = act[a + at, np.arange(cfg.filters)]
                        pooled[r, c], picks[r, c] = np.maximum(v, 0), np.where(v > 0, a + at, -1)
            y = labels[ids]
            p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.out_bias, -60, 60)))
            d = (p - y) * weight[ids] / len(ids)
            d_pool = d[:, None] * m.out[None, :]
            step(m.out, pooled.T @ d + 1e-5 * m.out, acc[-2])
            ob = np.array([m.out_bias])
            step(ob, np.array([d.sum()]), acc[-1])
            m.out_bias = float(ob[0])
            g_word: list[tuple[np.ndarray, np.ndarray]] = []
            for k, width in enumerate(cfg.widths):
                c = slice(k * cfg.filters, (k + 1) * cfg.filters)
                r, f = np.nonzero(picks[:, c] >= 0)
                if not len(r):
                    continue
                at, g = picks[:, c][r, f], d_pool[:, c][r, f]
                g_conv = np.zeros_like(m.conv[k])
                for j in range(width):
                    np.add.at(g_conv[j].T, f, e[at + j] * g[:, None])
                    g_word.append((flat[at + j], m.conv[k][j][:, f].T * g[:, None]))
                step(m.conv[k], g_conv, acc[k])
                step(m.bias[k], np.bincount(f, g, cfg.filters), acc[len(cfg.widths) + k])
            if g_word:
                w_ids, w_g = np.concatenate([x for x, _ in g_word]), np.concatenate([x for _, x in g_word])
                hit, inv2 = np.unique(rows[w_ids].ravel(), return_inverse=True)
                g_hit = np.zeros((len(hit), cfg.dim))
                np.add.at(g_hit, inv2, np.repeat(w_g, rows.shape[1], axis=0))
                g_emb[hit] += (g_hit * g_hit).mean(axis=1)
                m.emb[hit] -= cfg.rate * g_hit / np.sqrt(g_emb[hit])[:, None]
    return m


def _features(m: Model, seqs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Pooled features of texts given as word numbers."""
    out = []
    for lo in range(0, len(seqs), 256):
        part = seqs[lo : lo + 256]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        own, at = np.unique(np.concatenate(part), return_inverse=True)
        out.append(m.pooled(m.shares(rows[own])[at], offsets))
    return np.concatenate(out) if out else np.zeros((0, m.cfg.filters * len(m.cfg.widths)))


def _best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; between neighbours of equal F1 the middle of the widest gap."""
    order = np.argsort(-raw)
    s, t = raw[order], y[order]
    tp = np.cumsum(t)
    f1 = 2 * tp / (np.arange(1, len(s) + 1) + max(t.sum(), 1))
    gap = np.append(s[:-1] - s[1:], 0.0)
    ok = gap > 0
    if not ok.any():
        return float(s[0]) if len(s) else 0.0
    best = f1[ok].max()
    k = max(np.flatnonzero(ok & (f1 >= best - 1e-12)), key=lambda i: gap[i])
    return float((s[k] + s[k + 1]) / 2)


def _prior(y: np.ndarray, cfg: Config) -> Model:
    """One class only, or no row: the prior is all there is to learn."""
    m = _fit([], np.zeros((0, 1 + len(cfg.prefixes)), np.int64), np.array([0.0, 1.0]), replace(cfg, epochs=0))
    m.out[:] = 0
    m.shift, m.thresholds = (4.0 if len(y) and y.max() == 1 else -4.0), {}
    return m


def fit(texts: Iterable[tuple[str | None, int, str | None]], cfg: Config = Config(), cut: float = 0.3) -> Model:
    """The calibrated model of (text, label, lang) in the given order; texts beyond ``cfg.words`` words in all are left out."""
    vocab: dict[str, int] = {}
    seqs, labels, langs, total = [], [], [], 0
    for text, label, lang in texts:
        w = words_of(text)
        if total + len(w) > cfg.words:
            continue
        total += len(w)
        seqs.append(_numbers(w, vocab)), labels.append(label), langs.append(lang)
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return _prior(y, cfg)
    rows = _rows(vocab, cfg)
    del vocab
    n_cal = int(len(y) * cfg.calibration) if len(y) >= 50 else 0
    m = _fit(seqs[n_cal:], rows, y[n_cal:], cfg)
    cal = slice(0, n_cal) if n_cal else slice(None)
    raw, yc = m.raw(_features(m, seqs[cal], rows)), y[cal]
    at = _best_cut(raw, yc)
    spread = float(np.std(raw)) or 1.0
    m.scale = min(4.0, 3.0 / spread)
    m.shift = float(np.log(cut / (1 - cut))) - m.scale * at
    score = 1 / (1 + np.exp(-np.clip(m.scale * raw + m.shift, -60, 60)))
    m.thresholds, by = {}, np.array([x or "" for x in langs][cal], dtype=object)
    for lang in sorted(set(by)):
        mine = by == lang
        if lang and yc[mine].sum() >= 10 and (1 - yc[mine]).sum() >= 10:
            t = _best_cut(score[mine], yc[mine])
            m.thresholds[lang] = t
    return m


def sample(labelled: DataFrame, cfg: Config) -> DataFrame:
    """h, t, text, label and lang of the training rows: at most ``cfg.rows`` distinct ones and ``cfg.size`` bytes of text.

    Rows come in the order of their key's hash.  A text above a 256th of
    ``cfg.size`` is left out, so that one text cannot fill the sample or a step.
    """
    rows = labelled.where("label is not null").select(
        F.xxhash64(F.col("key").cast("string"), F.lit(cfg.seed)).alias("h"), F.xxhash64("text").alias("t"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "text", F.col("label").cast("int").alias("label"), "lang")
    order = ("h", "t", "label", "lang")
    # hashes first, so that texts of other rows never move
    short = rows.where(F.col("n") <= cfg.size // 256).select(*order, "n").distinct().orderBy(*order).limit(cfg.rows)
    run = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # cfg.rows rows at most
    picked = short.withColumn("run", run).where(F.col("run") <= cfg.size).select(*order)
    return rows.join(F.broadcast(picked), ["h", "t"], "left_semi").groupBy(*order).agg(F.min("text").alias("text"))


def _trainer(cfg: Config, cut: float):
    def run(batches):
        texts = [(r["h"], r["t"], r["label"], r["lang"] or "", r) for b in batches for r in b.to_pylist()]
        texts.sort(key=lambda x: x[:4])
        m = fit([(r["text"], r["label"], r["lang"]) for *_, r in texts], cfg, cut)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], names=["model"])

    return run


def train(labelled: DataFrame, cfg: Config = Config(), cut: float = 0.3) -> Model:
    """Fit on a bounded sample of ``labelled`` (key, text, label, lang) and calibrate.

    One task of the cluster trains; the driver gets the model, whose size the
    configuration fixes.  A share ``cfg.calibration`` of the sample is held
    back: on it the score is shifted so that ``cut`` is the best threshold over
    all rows, and thresholds by language are set.  Equal rows count once.
    """
    settle(labelled.sparkSession)
    made = sample(labelled, cfg).repartition(1).mapInArrow(tidy(_trainer(cfg, cut)), "model binary").collect()
    settle(labelled.sparkSession)
    return pickle.loads(made[0]["model"]) if made else _prior(np.zeros(0), cfg)


def _pieces(lengths: list[int], lap: int) -> list[list[tuple[int, int, int]]]:
    """(text, from, to) in groups of at most ``WORDS`` words; a longer text is cut, its pieces lapping by ``lap`` words."""
    out, held, size = [], [], 0
    for i, n in enumerate(lengths):
        for a in range(0, max(n, 1), WORDS):
            b = min(n, a + WORDS + lap)
            if held and size + b - a > WORDS + lap:
                out.append(held)
                held, size = [], 0
            held.append((i, a, b))
            size += b - a
    return out + ([held] if held else [])


def _scorer(handle):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = handle.value
        known: dict[str, int] = {}
        table = np.zeros((0, sum(m.cfg.widths) * m.cfg.filters), dtype=np.float32)
        for column in columns:
            scores = []
            for lo in range(0, len(column), 128):
                texts = [words_of(t) for t in column.slice(lo, 128).to_pylist()]
                pooled = np.zeros((len(texts), m.cfg.filters * len(m.cfg.widths)), np.float32)
                for group in _pieces([len(t) for t in texts], max(m.cfg.widths) - 1):
                    parts = [texts[i][a:b] for i, a, b in group]
                    new = [w for w in {w for t in parts for w in t} if w not in known]
                    if len(known) + len(new) > 300_000:
                        known, table = {}, table[:0]
                        new = list({w for t in parts for w in t})
                    if new:
                        rows = np.array([word_rows(w, m.cfg) for w in new], dtype=np.int64)
                        base = len(known)
                        for i, w in enumerate(new):
                            known[w] = base + i
                        need = base + len(new)
                        if need > len(table):
                            grown = np.zeros((max(need, 2 * len(table)), table.shape[1]), dtype=np.float32)
                            grown[:base] = table[:base]
                            table = grown
                        table[base:need] = m.shares(rows)
                    offsets = np.concatenate([[0], np.cumsum([len(t) for t in parts])])
                    flat = np.fromiter((known[w] for t in parts for w in t), dtype=np.int64, count=int(offsets[-1]))
                    # pooling is a maximum of at least 0, so pieces of a text are put together by one
                    np.maximum.at(pooled, [i for i, _, _ in group], m.pooled(table[flat], offsets))
                scores.append(m.score(pooled))
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return run


def score(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score_col``, which none of them may be called; whole texts, in pieces of bounded size.

    Only the text goes to the worker and only the score comes back.
    """
    if score_col in keep:
        raise ValueError(f"{score_col} is among the kept columns")
    handle = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the configuration
    run = tidy(_scorer(handle))
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # declared so that no filter or projection above makes a second run of it
    scored = F.arrow_udf(run, T.DoubleType()).asNondeterministic()
    return docs.select(*keep, scored(F.col(text_col).cast("string")).alias(score_col))
