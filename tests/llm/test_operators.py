"""Each operator against a brute-force version, over small tables with awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontam, embedding_dedup, licenses, minhash, packing, queries, secrets, sharding, substring, toxicity, url_filter

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in GAP.split(text or "") if w]


def made_docs(seed=1, n=120):
    """Copies, near copies, shared passages, secrets, nulls, blanks and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvzéü") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [line(50) for _ in range(3)]
    texts = [None, "", "  \n\t ", "one", "a b c", "Wort " * 90, line(34), line(35)]
    base = line(200)
    for k in range(12):
        w = base.split(" ")
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(n):
        t = line(rng.randint(5, 160))
        if rng.random() < 0.3:
            t += "\n" + rng.choice(shared) + " \t" + line(rng.randint(0, 9))
        if rng.random() < 0.15:
            t += " token = 'abcdEFGH12345678' é AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 2
        texts.append(t)
    texts += [texts[20], texts[20], base]
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), DOCS).repartition(5).withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("key", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def components_of(ids, links):
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# 6
def brute_substring(rows, k=35):
    where = defaultdict(int)
    split = [words(t) for _, t in rows]
    for w in split:
        for i in range(len(w) - k + 1):
            where[tuple(w[i : i + k])] += 1
    out = []
    for (doc, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if where[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring(docs):
    want = brute_substring([(r[0], r[1]) for r in made_docs()])
    assert Counter(map(tuple, substring.dedup(docs).collect())) == want


def test_substring_small_shards(docs):
    want = brute_substring([(r[0], r[1]) for r in made_docs()])
    assert Counter(map(tuple, substring.dedup(docs, cfg=substring.Config(shard_chars=500)).collect())) == want


def test_substring_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op6_substring_dedup(spark, SF).collect())) == brute_substring(rows)


# 9
def brute_minhash(rows):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 75 * len(sets[i] | sets[j]):
            links.append((i, j))
    comp = components_of(range(len(rows)), links)
    least = defaultdict(lambda: math.inf)
    for i, c in comp.items():
        least[c] = min(least[c], rows[i][0])
    return Counter((r[0], len(sets[i]), least[comp[i]], least[comp[i]] == r[0]) for i, r in enumerate(rows))


def test_minhash(docs):
    assert Counter(map(tuple, minhash.dedup(docs).collect())) == brute_minhash([(r[0], r[1]) for r in made_docs()])


def test_minhash_small_blocks(docs):
    assert Counter(map(tuple, minhash.dedup(docs, cfg=minhash.Config(block=3)).collect())) == brute_minhash([(r[0], r[1]) for r in made_docs()])


def test_minhash_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op9_minhash_dedup(spark, SF).collect())) == brute_minhash(rows)


def test_minhash_null_ids(spark):
    """A null id stands for a group only where no row has an id."""
    rows = [(5, "a b c d e f g"), (None, "a b c d e f g"), (None, "h i j k l m n"), (None, "h i j k l m n"), (None, None), (7, ""), (9, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, minhash.dedup(df).collect()))
    assert got == Counter({(5, 3, 5, True): 1, (None, 3, 5, False): 1, (None, 3, None, True): 2, (None, 0, None, True): 1, (7, 0, 7, True): 1, (9, 1, 9, True): 1})


def test_keep_one(spark):
    """Rows with equal or null ids and different texts are no copies."""
    line = "a b c d e f g"
    rows = [(3, "one text of its own here", "x"), (3, "another text that stands alone", "y"), (None, "third text with no id at all", None), (None, "fourth text with no id either", None),
            (5, line, "p"), (None, line, "q"), (6, line, "r"), (5, line, "p"), (5, line, "o"), (None, "only copies without an id live", "z"), (None, "only copies without an id live", "z"),
            (None, None, "n"), (None, None, "n"), (8, " \n", None), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string").repartition(4)
    got = Counter((r["doc_id"], r["text"]) for r in minhash.keep_one(df).collect())
    want = Counter({(i, t): 1 for i, t, _ in rows if not (i in (None, 6) and t == line)})
    want[None, None] = 2
    assert got == want and minhash.keep_one(df).columns == df.columns and minhash.keep_one(df.limit(0)).isEmpty()


# 4
def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 7] + rng.normal(size=16) * 0.15], 1) for i in range(80)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, [], 0), (305, [float("inf")] * 16, 1)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, [2 * x for x in rows[1][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    good = {i: np.array(v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(sorted(good), 2) if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    n = Counter(x for p in links for x in p)
    for cfg in (embedding_dedup.Config(), embedding_dedup.Config(block=5)):
        got = {r[0]: tuple(r) for r in embedding_dedup.dedup(df, cfg=cfg).collect()}
        assert len(got) == len(rows)
        assert all(got[i][1] <= n[i] for i in got)
        assert sum(r[1] for r in got.values()) >= 0.97 * sum(n.values())
        if sum(r[1] for r in got.values()) == sum(n.values()):
            comp = components_of([r[0] for r in rows], links)
            assert all(got[i][2] == comp[i] and got[i][3] == (comp[i] == i) for i in got)


@pytest.mark.parametrize("dim", [64, 384])
def test_embeddings_recall(spark, dim):
    """Partners planted at 0.90 to 0.99 in each step; recall at every step against brute force."""
    rng = np.random.default_rng(dim)
    base = embedding_dedup.unit(rng.normal(size=(600, dim)))
    side = rng.normal(size=base.shape)
    side = embedding_dedup.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    cos = np.repeat([0.9001, 0.92, 0.94, 0.96, 0.98, 0.99], 100)[:, None]
    u = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.dedup(df).collect()}
    want = ((u @ u.T) >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(len(u))) and want.sum() >= 1200
    for k in range(6):
        at = [i for i in range(100 * k, 100 * k + 100)]
        share = sum(got[i] for i in at) / want[at].sum()
        print("recall", dim, float(cos[100 * k, 0]), share)
        assert share >= 0.95


@pytest.mark.parametrize("mean", [0.0, 0.8, 0.85])
def test_embeddings_common_mean(spark, mean):
    """Planted links from 0.9 to 0.97, also where all vectors share a direction; against brute force."""
    rng = np.random.default_rng(7)
    axis = embedding_dedup.unit(rng.normal(size=(1, 64)))
    base = np.sqrt(mean) * axis + np.sqrt(1 - mean) * embedding_dedup.unit(rng.normal(size=(400, 64)))
    base = embedding_dedup.unit(base)
    side = rng.normal(size=base.shape)
    side = embedding_dedup.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    cos = rng.uniform(0.901, 0.97, size=(len(base), 1))
    u = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * side])
    want = ((u @ u.T) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = np.array([r["n_links"] for r in embedding_dedup.dedup(df).orderBy("vec_id").collect()])
    print("recall", mean, got.sum() / want.sum())
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_embeddings_lengths(spark):
    """Vectors of each length link among themselves, in one of the sample's lengths or not."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(20)]
    for k, dim in enumerate((1, 8, 100)):
        v = rng.normal(size=dim)
        rows += [(100 * (k + 1) + j, [float(x) for x in v * (1 + j)]) for j in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cfg in (embedding_dedup.Config(), embedding_dedup.Config(sample=1)):
        got = {r[0]: tuple(r[1:]) for r in embedding_dedup.dedup(df, cfg=cfg).collect()}
        assert all(got[100 * k + j] == (2, 100 * k, j == 0) for k in (1, 2, 3) for j in range(3))


# 5
def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, p, n) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))):
        out += [(m.start(), k + 1, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= n]
    return ",".join(x for _, _, x in sorted(out))


HARD = [None, "", "token=secret:abcdefghijklmnop", "api_key: 'x' apikey=\"ABCDEFGHIJKLMNOP\" 𝔘 secret = 0123456789abcdef0123", "é AKIAAKIA" + "B" * 20, "AKIA" * 9,
        "passwdpassword:aaaaaaaaaaaa", "TOKEN=" + "a" * 40, "Token: abcdef0123456789 tail", "hex " + "f" * 15 + "g" + "f" * 16]


def test_secrets(spark, docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    want = Counter((i, brute_spans(t)) for i, t in [*rows, *[(r[0] + 1000, r[1]) for r in made_docs()]])
    spans = secrets.span_text(F.col("_spans"))
    got = secrets.ledger_scan(df).select("doc_id", spans)
    assert Counter(map(tuple, got.collect())) == want
    # the ledger: the second call scans nothing that the first has seen
    at = str(tmp_path / "ledger")
    assert Counter(map(tuple, secrets.ledger_scan(df.where("doc_id < 5"), ledger=at).select("doc_id", spans).collect())) == Counter({k: v for k, v in want.items() if k[0] < 5})
    before = spark.read.parquet(at).count()
    assert Counter(map(tuple, secrets.ledger_scan(df, ledger=at).select("doc_id", spans).collect())) == want
    ledger = spark.read.option("recursiveFileLookup", "true").parquet(at)
    assert ledger.groupBy("blob", "rule", "version").count().where("count > 1").isEmpty() and ledger.count() > before


def test_ledger_scans_missing_pairs(spark, tmp_path):
    """A new version of one rule runs that rule alone, and only unseen blobs are scanned with the others."""
    at, df = str(tmp_path / "ledger"), spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    secrets.ledger_scan(df.where("doc_id < 6"), ledger=at)
    old = {(bytes(r["blob"]), r["rule"], r["version"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(at).collect()}
    # a rule that would match now, under a version that the ledger knows: it must not run on old blobs
    blind = (secrets.Rule("assign", "[a-z]{3,}", 1), secrets.Rule("access", "B{4,}", 4, version=2), secrets.HEX)
    got = {r["doc_id"]: secrets_of(r["_spans"]) for r in secrets.ledger_scan(df, ledger=at, rules=blind).collect()}
    new = [(bytes(r["blob"]), r["rule"], r["version"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(at).collect()]
    assert len(new) == len(set(new)) and old < set(new)
    seen = {b for b, _, _ in old}
    assert {(r, v) for b, r, v in set(new) - old if b in seen} == {("access", 2)}
    assert all(got[k] == [s for s in brute_spans(HARD[k]).split(",") if s and not s.startswith("access")] for k in (0, 1, 2, 3, 5)) and "access:10:30" in got[4]
    assert any(s.startswith("assign") for s in got[9])
    # nothing is left to scan
    secrets.ledger_scan(df, ledger=at, rules=blind)
    assert spark.read.option("recursiveFileLookup", "true").parquet(at).count() == len(new)


def secrets_of(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]


def test_secrets_long_text_and_clashes(spark):
    """Thousands of findings in one text, across the runs in which they are placed; columns named like the operator's own."""
    text = "".join(f"é line {i} token={'ab' * 8}{i:06d}\n" for i in range(3000)) + "x" * 300_000
    rows = [(1, text, 1, "s", 2, 3), (2, "token = " + "q" * 128, 1, None, 2, 3)] + [(k, "AKIA" + "Z" * 20 + ("\n" + "f" * 16) * (k - 100), 0, "", 0, 0) for k in (227, 228, 229)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _blob int, _spans string, _hit int, blob int")
    found = secrets.ledger_scan(df)
    assert found.columns == [*df.columns, "_blob_", "_spans_"]
    got = {r["doc_id"]: ",".join(secrets_of(r["_spans_"])) for r in found.collect()}
    assert got == {r[0]: brute_spans(r[1]) for r in rows}


def test_redaction(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for r in secrets.ledger_scan(df).select("text", secrets.redact(F.coalesce("text", F.lit("")), F.col("_spans")).alias("out"), "_spans").collect():
        t, last, want = r["text"] or "", 0, ""
        for s in r["_spans"]:
            if s["start"] >= last:
                want += t[last : s["start"]] + "[secret]"
            last = max(last, s["end"])
        assert r["out"] == want + t[last:]


# 3
def edits(item, text):
    """Least edit distance of the item to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    text = lambda k: "".join(rng.choice("abcde  ") for _ in range(k))
    items = [(i, text(rng.randint(20, 70))) for i in range(6)] + [(6, None), (7, " "), (8, "short")]
    rows = [(0, None), (1, ""), (2, "SHORT  things")]
    for i in range(40):
        t = list(text(60) + items[i % 6][1] + text(30))
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x"])
        rows.append((3 + i, "".join(t)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find(df, bench, rate=0.1).collect()}
    want = {}
    for (d, t), (i, q) in itertools.product(rows, items):
        t, q = decontam.normalise(t), decontam.normalise(q)
        if t and q and (e := edits(q, t)) <= decontam.budget(len(q), 0.1):
            want[d, i] = e
    assert got == want and len(want) > 10
    # blocks in one pass, and in several
    for cfg in ({"block_chars": 60}, {"block_chars": 60, "pass_blocks": 2}):
        parts = decontam.find(df.withColumn("item_id", F.lit(5)).withColumn("distance", F.lit("clash")), bench.withColumn("doc_id", F.lit(1)), rate=0.1, **cfg)
        rows_of = parts.collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in rows_of} == want and len(rows_of) == len(want)


def test_decontamination_query(spark):
    """The query on its whole tables, by the plain table of edits on the places that share a long enough piece."""
    docs = [(r["doc_id"], decontam.normalise(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], decontam.normalise(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op3_decontamination(spark, SF).collect()}
    rows = {d: t for d, t in docs}
    for (d, i), e in got.items():
        q, t = dict(items)[i], rows[d]
        assert e == least_edits(q, t) <= decontam.budget(len(q), 0.08)
    exact = {(d, i) for d, t in docs for i, q in items if q and q in t}
    assert exact <= set(got) and all(got[x] == 0 for x in exact)
    # every other pair lies beyond the budget: a sample of pairs by brute force, and all pairs that share a quarter of the item
    rng = random.Random(3)
    pairs = {(d, i) for d, t in docs for i, q in items if q and any(q[a : a + len(q) // 8] in t for a in range(0, len(q) - len(q) // 8, len(q) // 8))}
    pairs |= {(rng.choice(docs)[0], rng.choice(items)[0]) for _ in range(50)}
    for d, i in pairs - set(got):
        q = dict(items)[i]
        assert not q or not rows[d] or least_edits(q, rows[d]) > decontam.budget(len(q), 0.08)


def least_edits(item, text):
    """``edits`` with numpy rows."""
    t, row = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, a in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (t != ord(a)))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


# 7
def test_toxicity(spark):
    docs = queries.labelled(spark, "/root/testdata/sf0.1")
    model = toxicity.train(docs)
    got = queries.op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert right >= 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x " * 50_000), (4, "a\x00b")], "doc_id long, text string")
    scores = toxicity.score(odd, model, keep=["doc_id"]).collect()
    assert len(scores) == 5 and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.train(spark.createDataFrame([], "key long, text string, label int, lang string")).thresholds == {}


def plain_score(m, text):
    """The score by its definition: embeddings summed, every filter at every position, the largest at least 0, a logistic unit."""
    words, cfg, feats = toxicity.words_of(text), m.cfg, []
    e = [m.emb[list(toxicity.word_rows(w, cfg))].sum(axis=0) for w in words]
    for k, width in enumerate(cfg.widths):
        for f in range(cfg.filters):
            acts = [sum(e[i + j] @ m.conv[k][j][:, f] for j in range(width)) + m.bias[k][f] for i in range(len(words) - width + 1)]
            feats.append(max([0, *acts]))
    raw = float(np.array(feats) @ m.out + m.out_bias)
    return 1 / (1 + math.exp(-min(60, max(-60, m.scale * raw + m.shift))))


def test_toxicity_query_is_plain(spark):
    """Every row's score, held_out and predicted against their definitions."""
    m = toxicity.train(queries.labelled(spark, SF))
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_toxicity(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(rows.keys())
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
        assert abs(r["score"] - plain_score(m, rows[r["doc_id"]])) < 2e-3
    assert queries.labelled(spark, SF).where(F.crc32(F.col("key").cast("string")) % 4 == 2).isEmpty()


def test_toxicity_sample_is_bounded(spark):
    """Long texts and an id repeated often leave rows and bytes within their bounds."""
    cfg = toxicity.Config(rows=40, size=200_000, epochs=1)
    long = spark.range(100).select(F.col("id").alias("key"), F.repeat(F.concat(F.lit("w"), "id", F.lit(" ")), 2000).alias("text"), (F.col("id") % 2).cast("int").alias("label"), F.lit("en").alias("lang"))
    same = spark.range(5000).select(F.lit(7).cast("long").alias("key"), F.lit("again").alias("text"), F.lit(1).alias("label"), F.lit(None).cast("string").alias("lang"))
    huge = spark.range(3).select(F.col("id").alias("key"), F.repeat(F.lit("x "), 100_000).alias("text"), F.lit(0).alias("label"), F.lit("en").alias("lang"))
    got = toxicity.sample(long.unionByName(same).unionByName(huge), cfg).collect()
    assert 0 < len(got) <= 40 and sum(len(r["text"]) for r in got) <= 200_000 and max(len(r["text"]) for r in got) <= 12_500
    assert 0 <= toxicity.train(long.unionByName(same), cfg).emb.size == cfg.buckets * cfg.dim


def test_toxicity_awkward(spark, none):
    m = toxicity.train(spark.createDataFrame([(1, "a", 1, "en"), (2, "b", 0, None)], "key long, text string, label int, lang string"))
    df = spark.createDataFrame([(1, None, "s", "t"), (1, None, "s", "t"), (None, "a b", None, None)], "doc_id long, text string, score string, _text string")
    got = toxicity.score(df, m, keep=df.columns, score_col="p").collect()
    assert len(got) == 3 and got[0]["score"] in ("s", None)
    with pytest.raises(ValueError):
        toxicity.score(df, m, keep=df.columns)
    assert toxicity.score(none, m, keep=["doc_id"]).isEmpty()


def test_pooling():
    """Pooled features equal the plain maximum over every position."""
    rng = np.random.default_rng(0)
    cfg = toxicity.Config(buckets=256, epochs=1)
    m = toxicity.fit([("a b c", 0, None), ("d", 1, None)] * 4, cfg)
    texts = [[], ["a"], ["b", "a"], ["c", "d", "a", "zz"], [], [str(x) for x in rng.integers(0, 50, 40)]]
    vocab = {}
    seqs = [toxicity._numbers(t, vocab) for t in texts]
    got = toxicity._features(m, seqs, toxicity._rows(vocab, cfg))
    for r, t in enumerate(texts):
        e = [m.emb[list(toxicity.word_rows(w, cfg))].sum(axis=0) for w in t]
        for k, width in enumerate(cfg.widths):
            for f in range(cfg.filters):
                acts = [sum(e[i + j] @ m.conv[k][j][:, f] for j in range(width)) + m.bias[k][f] for i in range(len(t) - width + 1)]
                assert abs(got[r, k * cfg.filters + f] - max([0, *acts])) < 1e-4


# 8
def brute_url(url, rules=url_filter.RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in rules if m and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [None, "", "no scheme", "http://", "http://COM/en/x", "https://a.example.com/en/7198#top", "x://example.com/en/71", "://net/de/", "http://example.net/de/8?x=1", "http://wexample.net/de/81",
        "http://m.org/es/", "http://org/es", "http://É.com/en/\nz", "http://a.com?/en/", "http://a.com/EN/", "http://u@b.com:80/en/", "http://a..com/en/q://w", "http://com./en/"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, html string")
    got = {r[0]: tuple(r)[1:] for r in url_filter.filter_urls(df).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate([*URLS, URLS[5]])}


def test_urls_long_list(spark):
    """Half a million listed rules as a table, through the cascade and through the join beyond its bound; clashing columns."""
    rules = spark.range(500_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/a/").alias("path"))
    rules = rules.unionByName(spark.createDataFrame([("allow", "www.h7.com", "/a/b"), ("block", "www.h7.com", "/a/b"), (None, "x.com", "/")], "verdict string, host string, path string"))
    urls = [f"http://{'www.' * (i % 2)}h{i * 100}.com/{'a/b' if i % 3 else 'b/'}" for i in range(9000)] + ["http://www.h7.com/a/bc", "http://x.com/", None]
    df = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")

    def want(i, u):
        if u == "http://www.h7.com/a/bc":
            return "allow", "www.h7.com/a/b"
        listed = u and i < 9000 and i % 3 and i * 100 < 500_000
        return ("block", f"h{i * 100}.com/a/") if listed else ("allow", None)

    for bits in (1 << 28, 1 << 10):
        got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.filter_urls(df, rules=rules, max_bits=bits).collect()}
        assert got == {i: want(i, u) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    listed = spark.range(0, 900).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(0, 9000).select(F.concat(F.lit("k"), "id").alias("key"))
    c = url_filter.build_cascade(universe, listed, rate=0.2)
    assert len(c.levels) > 2
    wrong = universe.withColumn("got", c.member(F.col("key"))).join(listed.withColumn("want", F.lit(True)), "key", "left").where("got <> coalesce(want, false)")
    assert wrong.isEmpty()
    assert universe.where(url_filter.build_cascade(universe, listed.limit(0)).member(F.col("key"))).isEmpty()


# 10
def check_packing(rows, docs, capacity=4096):
    want, seen = {}, defaultdict(list)
    plain = Tokenizer.from_file(queries.tokenizer_path())
    ids = {}
    for d, t in docs:
        ids[d] = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    for r in rows:
        seen[r["doc_id"]].append(r)
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d, _ in docs:
        at, copies = sorted((r["start"], r["length"]) for r in seen[d]), sum(1 for x, _ in docs if x == d)
        if copies == 1:
            end = 0
            for s, n in at:
                assert s == end
                end += n
            assert end == len(ids[d])
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    pad = total = 0
    for x in by.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= capacity
        total += end
        if end & (end - 1):
            pad += capacity - end
    assert total == sum(len(ids[d]) for d, _ in docs)
    return pad / (pad + total)


def test_packing(spark, docs):
    more = [(900, "long words " * 9000), (901, "a <|endoftext|> b"), (902, "x<|startoftext|>y\n<|endoftext|>")]
    made = [(r[0], r[1]) for r in made_docs()] + more
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    check_packing(packing.pack(df, tokenizer_path=queries.tokenizer_path()).collect(), made)
    check_packing(packing.pack(df, tokenizer_path=queries.tokenizer_path(), open_windows=2, fan_in=2).collect(), made)


def test_packing_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(queries.op10_packing(spark, SF).collect(), rows) < 0.02


def test_tokenizer_memo():
    tok, plain = packing.WordTokenizer(queries.tokenizer_path(), 2, memo=50), Tokenizer.from_file(queries.tokenizer_path())
    special = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>", "<|startoftext|>\n<|endoftext|>, <|endoftext|>.", "<|ENDOFTEXT|>", "<| endoftext |>", "é<|endoftext|>é."]
    texts = [*special, "It's  FINE\u00a0here\x1cand\x85there", "e\u0301 \u0301x ΟΔΟΣ ΟΣ. 12345's", "<|endoftext|> a", "", None, "\u2000\u3000 wide", "İstanbul ſ K"] + [r[1] for r in made_docs()]
    for t, got in zip(texts, tok.encode(texts)):
        assert got == np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


# 2
def test_sharding(spark, docs):
    for df, n in ((docs, len(made_docs())), (spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), 10_000)):
        got = sharding.shard(df, slot_rows=20).collect()
        assert len(got) == n
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    size, where, weight = Counter(), defaultdict(set), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
        weight[r["text_crc32"], r["size"]] += r["size"]
    assert max(size.values()) <= 1.05 * sum(size.values()) / 40 and min(size.values()) >= 0.95 * sum(size.values()) / 40
    assert all(len(s) == 1 for k, s in where.items() if weight[k] < 0.02 * sum(size.values()) / 40)


def plain_kd_tree(rows, shards):
    """(id, text) to (id, size, crc, shard) by a plain k-d tree: sort, cut where the running weight passes its goal, recurse."""
    import xxhash

    def dims(t):
        n, size = len(t), len(t.encode())
        return math.log2(size + 1), size / max(n, 1), (t.count("\n") + 1) / max(n, 1)

    points = [(i, t, len(t.encode()) + 16, dims(t), xxhash.xxh64(t.encode(), seed=42).intdigest()) for i, t in rows]
    lo, hi = ([f(p[3][d] for p in points) for d in range(3)] for f in (min, max))
    level = lambda x, d: math.floor((x - lo[d]) / (hi[d] - lo[d]) * 4095) if hi[d] > lo[d] else 0
    keyed = [(i, zlib.crc32(t.encode()), size, [(level(x[d], d) << 48) | (h & ((1 << 48) - 1)) for d in range(3)]) for i, t, size, x, h in points]
    out, leaf = [], itertools.count()

    def split(some, n):
        if n == 1:
            shard = next(leaf)
            out.extend((i, size, crc, shard) for i, crc, size, _ in some)
            return
        spread = [max(k[d] >> 48 for *_, k in some) - min(k[d] >> 48 for *_, k in some) for d in range(3)]
        d = spread.index(max(spread))
        goal, run, cut = sum(s for _, _, s, _ in some) * (n // 2) / n, 0, None
        for key, group in itertools.groupby(sorted(some, key=lambda r: r[3][d] >> 24), key=lambda r: r[3][d] >> 24):
            run += sum(r[2] for r in group)
            if run >= goal:
                cut = (key + 1) << 24
                break
        split([r for r in some if r[3][d] < cut], n // 2), split([r for r in some if r[3][d] >= cut], n - n // 2)

    split(keyed, shards)
    return Counter(out)


def test_sharding_plain_tree(spark):
    """Every shard, size and checksum against the plain tree, where no text is heavy."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdé \n" if i % 3 else "xyz") for _ in range(rng.randint(0, 300))) + str(i) for i in range(1500)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)).repartition(4)
    got = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in sharding.shard(df, shards=11, tolerance=1.0).collect())
    assert got == plain_kd_tree([(i, t or "") for i, t in enumerate(texts)], 11)


def test_sharding_hot_text(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    size = Counter()
    for r in sharding.shard(df).collect():
        size[r["shard"]] += r["size"]
    assert len(size) == 40 and max(size.values()) <= 1.3 * sum(size.values()) / 40


def test_sharding_keeps_copies(spark):
    """Copies stay together up to nearly a whole shard, in small tables as well, and shards stay even."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdef \n") for _ in range(n))
    texts = [word(rng.randint(20, 400)) for _ in range(4000)]
    for n, copies in ((2000, 2), (300, 5), (900, 10), (2500, 3), (450, 30), (12000, 1)):
        texts += [word(n)] * copies
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard(df).collect()
    assert len(got) == len(texts)
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(size.values()) / 40
    weight = Counter()
    for x in texts:
        weight[x] += len(x) + 16
    assert max(weight.values()) > 0.5 * mean and all(len(where[x]) == 1 for x in weight if weight[x] <= mean)
    assert len(size) == 40 and max(size.values()) <= 1.05 * mean and min(size.values()) >= 0.95 * mean


# 1
def pieces(text, is_file):
    """(unit, first line, text) of every line, sentence and block, and of a whole licence file."""
    lines, out = text.split("\n"), []
    for n, line in enumerate(lines):
        out.append((0, n, line))
        parts = re.split("(?<=[.!?])[ \t]+", line)
        out += [(1, n, p) for p in parts if re.search("[.!?][ \t]+[^ \t]", line)]
    block, start = [], 0
    for n, line in enumerate([*lines, None]):
        # only an inner line can part two blocks
        if line is None or 0 < n < len(lines) - 1 and not line.strip(" \t\r#/*;%-"):
            if len(block) > 1:
                out.append((2, start, "\n".join(block)))
            block = []
        else:
            start = start if block else n
            block.append(line)
    return out + ([(3, 0, text)] if is_file else [])


def brute_licenses(rows, threshold=0.7):
    """(id, path, text, is_file) to (id, path, license, origin, from)."""
    counts, idf = licenses.weights()
    lost = licenses.unknown_idf()
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in tc.items())) for tc in counts]

    def best(line):
        c = {t: 1 + math.log(n) for t, n in Counter(re.findall(licenses.TOKEN, line.lower())).items()}
        norm = math.sqrt(sum((n * idf.get(t, lost)) ** 2 for t, n in c.items()))
        out = (0, 0, None)
        for k, tc in enumerate(counts):
            dot = sum(n * idf.get(t, lost) * tc.get(t, 0) * idf.get(t, lost) for t, n in c.items())
            s = round(dot / norm / norms[k], 6) if norm else 0
            if s >= threshold:
                out = max(out, (s, -k, licenses.TEMPLATES[k][0]))
        return out

    own, held = {}, {}
    for i, path, text, is_file in rows:
        found = max(((b[0], -n, -u, b[2]) for u, n, piece in pieces(text or "", is_file) if (b := best(piece))[2]), default=None)
        own[i, path] = found and (found[0], found[3], licenses.UNITS[-found[2]], -found[1])
        if found and is_file and path is not None:
            d = re.sub("/[^/]*$", "", path)
            held[d] = min(held.get(d, (1, "", "")), (-found[0], path, found[3]))
    out = []
    for i, path, _, is_file in rows:
        if own[i, path]:
            out.append((i, path, own[i, path][1], "file" if is_file else "header", None, *own[i, path][2:]))
            continue
        parts = path.split("/")[:-1] if path is not None else []
        up = next((d for n in range(len(parts), 0, -1) if (d := "/".join(parts[:n])) in held), None)
        out.append((i, path, *((held[up][2], "inherited", held[up][1]) if up is not None else (None, "none", None)), None, None))
    return Counter(out)


def wrapped(text, width=9, mark="# "):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses(spark):
    mit, texts, headers = "Released under the MIT License.", dict(licenses.license_texts.TEXTS), dict(licenses.license_texts.HEADERS)
    rows = [
        (1, "/a/LICENSE", mit), (2, "/a/b/c/x.py", "code"), (3, "/a/b/LICENSE.txt", "x\nLicensed under CC BY-NC 4.0."), (4, "/a/b/y.py", "# Licensed under the Apache License, Version 2.0."),
        (5, "/z/q.py", None), (6, None, mit), (7, "/a/b/c/d/e.py", ""), (8, "/ab/x", "All rights reserved"), (9, "plain", "permission to do things"), (2, "/a/b/c/x.py", "code"), (10, "/a/COPYING", "All rights reserved."), (11, "/a/z.py", "text"),
        # a licence file wrapped over lines and paragraphs, as projects have it
        (12, "/m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(texts["MIT"].split("(c) ")[1], 12, "")), (13, "/m/src/deep/a.c", "int main"),
        (14, "/b/LICENSE", "Copyright (c) 2001, The People\n" + wrapped(texts["BSD-3-Clause"], 11, "")), (15, "/b/x", "nothing"),
        # headings of long licences, wrapped headers in comments, notices by sentence
        (16, "/g/COPYING", "   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Everyone is permitted to copy it.\n\nPreamble of many words"), (17, "/g/x/y/z.py", ""),
        (18, "/c/x.py", "#!/bin/sh\n#\n" + wrapped(headers["Apache-2.0"]) + "\n#\nimport os\n"), (19, "/c/y.c", "/*\n" + wrapped(headers["GPL-3.0"], 8, " * ") + "\n */\nint x;"),
        (20, "/c/z.c", "\n\n\n" + wrapped(headers["MPL-2.0"], 10, "// ") + "\n\n"), (21, "/c/n.md", "We like it here. Released under the MIT License. Come and see us."),
        (22, "/c/LICENSE", "\n" * 2000 + mit + "\n" * 3), (23, "/c/deep/er", "x " * 20_000), (24, "/e/LICENSE", "no licence here"), (25, "/e/f", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("dir", F.lit(1)).withColumn("unit", F.lit("x"))
    got = Counter((r["doc_id"], r["path"], r["license"], r["origin"], r["from_path"], r["unit"], r["line_no"]) for r in licenses.scan(df).collect())
    want = brute_licenses([(i, p, t, bool(p and re.search("(?i)(^|/)(licen[sc]e|copying|notice)(\\.[a-z]+)?$", p))) for i, p, t in rows])
    assert got == want
    say = {k[0]: k[2:] for k in got}
    assert say[12][:2] == ("MIT", "file") and say[13] == ("MIT", "inherited", "/m/LICENSE", None, None) and say[14][0] == say[15][0] == "BSD-3-Clause"
    assert say[16][:2] == ("GPL-3.0", "file") and say[17][0] == "GPL-3.0" and say[18][0] == "Apache-2.0" and say[19][0] == "GPL-3.0" and say[20][0] == "MPL-2.0"
    assert say[21] == ("MIT", "header", None, "sentence", 0) and say[23][0] == "MIT" and say[25][0] is None


def test_licenses_table(spark):
    got = queries.op1_license_scan(spark, SF)
    found = Counter((r["doc_id"], r["path"], r["license"], r["origin"], r["from_path"], r["unit"], r["line_no"]) for r in got.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    path = {r["doc_id"]: r["path"] for r in got.collect()}
    rows = [(r["doc_id"], path[r["doc_id"]], r["text"], bool(re.search("(?i)licensed under|released under", (r["text"] or "").split("\n")[0]))) for r in docs]
    assert found == brute_licenses(rows)


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns named like the operators' own."""
    long = " ".join(f"w{i % 9973}x{i % 31}" for i in range(120_000))
    rows = [(1, None), (1, None), (None, None), (None, "null id words of some length here"), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "a" * 300_000), (7, "same words again and again"), (7, "same words again and again"), (8, "same words again and again"), (9, "\x00 \U0001F600 é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["score", "id", "key", "label", "html", "uid", "v", "a", "b", "cls", "t_key", "component_id", "kept", "size", "shard", "slot", "h", "blob", "_text", "text_crc32", "n_words", "sequence_id", "start", "path", "dir", "item_id", "least", "place", "group"]
    return df.withColumns({n: F.lit("clash") for n in names}).repartition(3), rows


def test_odd_documents(spark):
    """Every operator on documents keeps to its definition on them."""
    df, rows = odd_docs(spark)
    plain = [(i, t) for i, t in rows]
    assert Counter(map(tuple, substring.dedup(df).collect())) == brute_substring(plain)
    got = Counter((r["doc_id"], r["n_shingles"]) for r in minhash.dedup(df).collect())
    assert sum(got.values()) == len(rows) and {i: n for i, n in got}[6] == 1
    same = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.dedup(df).collect() if r["doc_id"] in (4, 5, 7, 8)}
    assert same == {4: (4, True), 5: (4, False), 7: (7, True), 8: (7, False)}
    found = secrets.ledger_scan(df)
    assert found.count() == len(rows) and all(secrets_of(r["_spans"]) == [x for x in brute_spans(r["text"]).split(",") if x] for r in found.select("text", "_spans").collect())
    check_packing(packing.pack(df.where("doc_id is not null"), tokenizer_path=queries.tokenizer_path()).collect(), [(i, t) for i, t in plain if i is not None])
    shards = sharding.shard(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in shards) == Counter((i, len((t or "").encode()) + 16) for i, t in plain)
    bench = spark.createDataFrame([(1, "same words again and again"), (1, "same words again and again"), (None, None), (2, "")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert Counter((r["doc_id"], r["distance"]) for r in decontam.find(df, bench).collect()) == Counter({(7, 0): 4, (8, 0): 2})
    files = df.withColumn("path", F.concat(F.lit("/a/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))))
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files).where("license is not null").isEmpty()
    m = toxicity.train(spark.createDataFrame([(1, "a", 1, "en"), (2, "b", 0, None)], "key long, text string, label int, lang string"))
    scored = toxicity.score(df, m, keep=["doc_id", "score"], score_col="p").collect()
    assert len(scored) == len(rows) and all(0 <= r["p"] <= 1 for r in scored)


def test_odd_vectors_and_pages(spark):
    """Repeated ids and rows, nulls in every column, clashing names."""
    v = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (None, None), (3, [0.0, 1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({n: F.lit(1) for n in ("label", "id", "code", "vec", "key", "n_links", "d", "v")})
    got = Counter((r["vec_id"], r["n_links"]) for r in embedding_dedup.dedup(df).collect())
    assert got == Counter({(1, 2): 2, (None, 2): 1, (2, 0): 1, (None, 0): 1, (3, 0): 1})
    p = spark.createDataFrame([(None, "http://com/en/x"), (1, None), (1, None), (2, "http://" + "a." * 300 + "com/en/" + "y" * 100_000)], "page_id long, url string").withColumns({n: F.lit("c") for n in ("html", "host", "path", "rule", "verdict", "key")})
    out = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(p).collect())
    assert out == Counter({(None, "com/en/", "block"): 1, (1, None, "allow"): 2, (2, "com/en/", "block"): 1})


def test_empty_tables(spark, none):
    assert substring.dedup(none).isEmpty() and minhash.dedup(none).isEmpty() and secrets.ledger_scan(none).isEmpty()
    assert packing.pack(none, tokenizer_path=queries.tokenizer_path()).isEmpty() and sharding.shard(none).isEmpty()
    assert decontam.find(none, spark.createDataFrame([], "item_id long, text string")).isEmpty()
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).isEmpty()
    assert licenses.scan(none.withColumn("path", F.lit("a/b"))).isEmpty()
