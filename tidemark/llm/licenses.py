"""Licence scans: sparse TF-IDF cosine to templates, then directory inheritance.

Every line, sentence and block (lines without a blank one between them, so a
header wrapped over many lines is one) of every file, and every licence file as
a whole, is compared with notices, headings, headers and texts of licences by
TF-IDF cosine.  Term frequencies count logarithmically; weights come from the
templates.  A file without a notice of its own inherits from the nearest
ancestor directory that holds a licence, found by joins on directory paths.
Everything is DataFrame and SQL functions.

Pieces without any anchor term are not scored: by the Cauchy-Schwarz inequality
they cannot reach the threshold (see ``anchors``); nor can pieces with too much
else in them (see ``possible``).

Edge cases: a null or empty text has no notice; a null path has no directory
and inherits nothing; ties go to the first template, then the first line, then
line before sentence before block before file, then the smallest path; repeated
rows are reported once each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import license_texts
from tidemark.llm.common import Scratch

TEMPLATES = license_texts.TEMPLATES

TOKEN = "[a-z0-9]+(?:\\.[0-9]+)*"
#: Words and syllables that run through prose; they only decide in what order anchors are chosen.
COMMON = frozenset(
    "a all also an and any are as at be been but by can do either except for from further had has have here how if in is it its later may more no not of "
    "on or other our out over sa should so some such than that the their them then there these they this to under up use was we were what when which while "
    "who will with without would you your nc nd".split())
#: A directory with more than one in so many of all rows is hot.
HOT = 200
#: File names that hold a licence for their directory.
LICENSE_FILE = "(?i)^(licen[sc]e|copying|notice)(\\.[a-z]+)?$"


def weights(templates=TEMPLATES) -> tuple[list[dict[str, float]], dict[str, float]]:
    """Term weights of each template by frequency, and the inverse document frequency of each term."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    n = len(templates)
    df = Counter(t for c in counts for t in c)
    counts = [{t: 1 + math.log(k) for t, k in c.items()} for c in counts]
    return counts, {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}


def unknown_idf(templates=TEMPLATES) -> float:
    """Weight of a term that no template has."""
    return math.log(1 + len(templates)) + 1


def anchors(templates=TEMPLATES, threshold: float = 0.7) -> list[str]:
    """Terms of which every line at the threshold or above has one.

    Of each template heavy, long terms are taken until the rest of its vector
    is shorter than ``threshold`` times the whole: a piece that shares only that
    rest has a smaller cosine.  Words of running prose come last, so that few
    texts pass.
    """
    counts, idf = weights(templates)
    out: set[str] = set()
    for c in counts:
        heavy = sorted(c, key=lambda t: (t in COMMON, -c[t] * idf[t] * len(t) ** 2, t))  # long terms are rarer in prose
        norm = sum((c[t] * idf[t]) ** 2 for t in c)
        rest = sum((c[t] * idf[t]) ** 2 for t in c if t not in out)
        for t in heavy:
            if rest < (threshold - 1e-6) ** 2 * norm:
                break
            if t not in out:
                out.add(t)
                rest -= (c[t] * idf[t]) ** 2
    return sorted(out)


def template_rows(templates=TEMPLATES) -> list[tuple[int, str, str, float]]:
    """(template, licence, term, weight divided by the template's norm)."""
    counts, idf = weights(templates)
    out = []
    for k, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        out += [(k, templates[k][0], t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return out


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def possible(tokens: Column, templates, threshold: float) -> Column:
    """Whether a piece could reach the threshold for any template.

    A cosine of t needs at least t squared of the piece's squared weight in
    template terms; every other distinct term weighs ``unknown_idf`` or more.
    """
    _, idf = weights(templates)
    terms = F.create_map(*[x for t, w in sorted(idf.items()) for x in (F.lit(t), F.lit(w))])
    known = F.filter(tokens, lambda t: t.isin(sorted(idf)))
    own = F.array_distinct(known)
    weight = lambda t: F.pow(F.element_at(terms, t) * (1 + F.log(F.size(F.filter(known, lambda x: x == t)).cast("double"))), F.lit(2))
    shared = F.aggregate(own, F.lit(0.0), lambda acc, t: acc + weight(t))
    others = F.size(F.array_distinct(tokens)) - F.size(own)
    return shared >= (threshold**2 - 1e-6) * (shared + others * unknown_idf(templates) ** 2)


def _best(pieces: DataFrame, key: str, templates, threshold: float) -> DataFrame:
    """The best template of each piece (``key`` names it; ``text`` holds it), at the threshold or above."""
    spark = pieces.sparkSession
    counts, idf = weights(templates)
    vector = spark.createDataFrame(template_rows(templates), "template int, licence string, term string, tw double")
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    terms = (
        pieces.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))).alias("term"))
        .groupBy(key, "term").agg(F.count("*").alias("tf"))
        .join(F.broadcast(known), "term", "left")  # both sides of fixed size: the templates' terms
        .withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.coalesce("idf", F.lit(unknown_idf(templates))))
    )
    norms = terms.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = terms.join(F.broadcast(vector), "term").groupBy(key, "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("licence", "score"), F.struct("score", (-F.col("template")).alias("t")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.licence", "b.score")


#: What separates blocks: a line of blanks and comment marks only.
BLANK = "\n[ \t\r#/*;%-]*(?=\n)"
#: Kinds of pieces in the order in which ties are settled.
UNITS = ("line", "sentence", "block", "file")


def pieces_of(text: Column, is_file: Column, worth) -> Column:
    """array<struct<unit, line_no, text>>: the lines, sentences and blocks of a text, and the whole of a licence file, that are ``worth`` a look.

    Sentences and blocks that are no more than a line of their own are left
    out; what is not worth a look as a whole holds no part that is.
    """
    piece = lambda unit, at, x: F.struct(F.lit(UNITS.index(unit)).alias("unit"), at.cast("int").alias("line_no"), x.alias("text"))
    none = F.array().cast(PIECES)
    by_line = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: piece("line", i, x)), lambda p: worth(p["text"]))
    sentences = lambda p: F.transform(F.split(p["text"], "(?<=[.!?])[ \t]+", -1), lambda y: piece("sentence", p["line_no"], y))
    split = lambda p: F.when(p["text"].rlike("[.!?][ \t]+[^ \t]"), sentences(p)).otherwise(none)
    # block k starts after the line breaks of what stands before it
    parts = F.split(text, BLANK, -1)
    gaps = F.regexp_extract_all(text, F.lit(BLANK), F.lit(0))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lead = F.when(x["p"].startswith("\n"), 1).otherwise(0)
        out = F.when((breaks(x["p"]) > lead) & worth(x["p"]), F.concat(acc["out"], F.array(piece("block", acc["at"] + lead, x["p"])))).otherwise(acc["out"])
        return F.struct((acc["at"] + breaks(x["p"]) + F.coalesce(breaks(x["g"]), F.lit(0))).cast("int").alias("at"), out.alias("out"))

    by_block = F.aggregate(F.arrays_zip(parts.alias("p"), gaps.alias("g")), start, step, lambda acc: acc["out"])
    whole = F.when(is_file, F.array(piece("file", F.lit(0), text))).otherwise(none)
    return F.element_at(F.transform(F.array(by_line), lambda l: F.concat(l, F.flatten(F.transform(l, split)), by_block, whole)), 1)


PIECES = "array<struct<unit:int,line_no:int,text:string>>"


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.7,
         license_file: Column | None = None, templates=TEMPLATES) -> DataFrame:
    """Licence of every file: id, path, own_license, own_score, line_no, unit, license, origin, from_path.

    ``origin`` is header, file (the file is a licence file), inherited or none;
    ``unit`` says which kind of piece decided, from ``line_no`` on.
    ``license_file``: which rows are licence files (default: by file name).
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    words = F.array(*[F.lit(t) for t in anchors(templates, threshold)])
    worth = lambda x: F.arrays_overlap(tokens_of(x), words)
    base = F.regexp_extract(F.coalesce(F.col(path_col).cast("string"), F.lit("")), "[^/]*$", 0)
    is_file = F.coalesce(license_file if license_file is not None else base.rlike(LICENSE_FILE), F.lit(False))
    rows = files.select(
        F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), is_file.alias("is_file"))
    rows = rows.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    # one piece per distinct wording is scored: notices repeat across a corpus
    noted = scratch.write(
        rows.where(worth(F.col("text"))).select("id", "path", F.inline(pieces_of(F.col("text"), F.col("is_file"), worth)))
        .where(possible(tokens_of(F.col("text")), templates, threshold))
        .withColumn("piece", F.unhex(F.md5("text"))),
        "pieces",
    )
    wordings = noted.select("piece", "text").dropDuplicates(["piece"])
    scored = _best(wordings, "piece", templates, threshold)
    own = (
        noted.drop("text").join(scored, "piece")
        .groupBy("id", "path")
        .agg(F.max_by(F.struct("licence", "score", "line_no", "unit"), F.struct("score", (-F.col("line_no")).alias("l"), (-F.col("unit")).alias("u"))).alias("b"))
        .select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("b.licence").alias("own_license"), F.col("b.score").alias("own_score"), "b.line_no", "b.unit")
    )
    meta = rows.select("id", "path", "dir", "is_file")
    judged = scratch.write(
        meta.join(own, meta["id"].eqNullSafe(own["o_id"]) & meta["path"].eqNullSafe(own["o_path"]), "left").drop("o_id", "o_path"), "judged"
    )
    # ties on the score: the smallest path
    holders = (
        judged.where("is_file and own_license is not null and dir is not null")
        .groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("b"))
        .select(F.col("dir").alias("h_dir"), F.col("b.path").alias("from_path"), F.col("b.own_license").alias("h_license"))
    )
    # distinct directories only: a hot directory is one row here
    dirs = scratch.write(judged.where("dir is not null").groupBy("dir").agg(F.count_if(F.col("own_license").isNull()).alias("heirs"), F.count("*").alias("n")), "dirs")
    parts = F.split("dir", "/", -1)
    above = dirs.where("heirs > 0").select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up"))
    nearest = scratch.write(
        above.join(holders, above["up"] == holders["h_dir"])
        .groupBy("dir").agg(F.max_by(F.struct("h_license", "from_path"), F.length("up")).alias("b"))
        .select("dir", F.col("b.h_license").alias("in_license"), F.col("b.from_path").alias("from_path")), "nearest"
    )
    # a directory with over a HOT-th of all rows: fewer than HOT of them exist, so what they inherit is broadcast
    total = dirs.agg(F.sum("n")).first()[0] or 0
    hot = nearest.join(dirs.where(F.col("n") > total / HOT).select("dir"), "dir", "left_semi")
    crowded = F.broadcast(hot.select(F.col("dir").alias("c_dir"), F.col("in_license").alias("c_license"), F.col("from_path").alias("c_from")))
    first = judged.join(crowded, judged["dir"] == F.col("c_dir"), "left")
    # rows that a hot directory has served ask for no other: they carry keys of their own and spread
    asks = F.when(F.col("own_license").isNull() & F.col("c_dir").isNull() & F.col("dir").isNotNull(), F.col("dir"))
    asked = first.withColumn("asks", F.coalesce(asks, F.concat(F.lit("\n"), F.xxhash64("id", "path").cast("string"))))
    given = nearest.join(F.broadcast(hot.select("dir")), "dir", "left_anti").withColumnRenamed("dir", "n_dir")
    own_origin = F.when(F.col("is_file"), "file").otherwise("header")
    heir, licence = F.col("own_license").isNull(), F.coalesce("c_license", "in_license")
    return asked.join(given, asked["asks"] == given["n_dir"], "left").select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "own_score", F.col("line_no").cast("long").alias("line_no"),
        F.coalesce(*[F.when(F.col("unit") == k, name) for k, name in enumerate(UNITS)]).alias("unit"),
        F.when(heir, licence).otherwise(F.col("own_license")).alias("license"),
        F.when(~heir, own_origin).when(licence.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(heir, F.coalesce("c_from", "from_path")).alias("from_path"),
    )
