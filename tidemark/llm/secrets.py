"""Secret scans over an incremental ledger of content-addressed blobs.

Every row is one historical version of a path, addressed by the SHA-256 of its
content.  The ledger holds the findings of each (blob, rule, version) that was
ever scanned; only pairs that it lacks are scanned, so a new version of one
rule runs that rule alone.  Findings are appended to the ledger and joined back
to all paths that hold the blob.  Everything is DataFrame and SQL functions.

Edge cases: a null text counts as empty and has no findings; equal texts are
scanned once and reported for each row; repeated rows are reported once each;
spans that start together keep the rules' order; an empty table gives an empty
result; other columns are carried through unchanged, and the operator's own two
are renamed where one of theirs has that name.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh


@dataclass(frozen=True)
class Rule:
    """A pattern scanned leftmost and non-overlapping; ``group`` of a match needs ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


#: The base kinds, in their listed order.
ASSIGN = Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2)
ACCESS = Rule("access", "AKIA[A-Z0-9]{14,}", 18)
HEX = Rule("hex", "[0-9a-f]{16,}", 16)
RULES = (ASSIGN, ACCESS, HEX)

FINDING = "array<struct<start:int,end:int,kind:string,ord:int>>"


#: Matches are placed in runs of this many, so that the work on n of them is n * (RUN + n / RUN) copies and not n * n.
RUN = 128


def _found(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule, in code points, end exclusive.

    Splitting at the pattern gives what lies between matches, so running sums
    of both lengths place every match: within runs first, then run after run.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    # a match by itself matches alike: the patterns look at nothing around it
    judged = F.transform(whole, lambda x: F.struct(F.length(x).alias("w"), (F.length(F.regexp_extract(x, rule.pattern, rule.group)) >= rule.least).alias("ok")))
    steps = F.arrays_zip(between.alias("b"), judged.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FINDING).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["b"]
        span = F.struct(at.alias("start"), (at + x["m"]["w"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(order).alias("ord"))
        out = F.when(x["m"]["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((at + F.coalesce(x["m"]["w"], F.lit(0))).alias("at"), out.alias("out"))

    def join(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["ord"].alias("ord")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def spans(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(x, k * RUN + 1, F.lit(RUN)), start, step))
        return F.aggregate(runs, start, join, lambda acc: acc["out"])

    # the steps are bound once by the outer transform
    placed = F.element_at(F.transform(F.array(steps), spans), 1)
    return F.when(text.rlike(rule.pattern), placed).otherwise(F.array().cast(FINDING))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, need) to (blob, rule, version, findings), one row per blob and rule in ``need`` (rule numbers); other rules do not run."""
    made = F.array(*[
        F.when(F.array_contains("need", k), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _found(F.col("text"), r, k).alias("findings")))
        for k, r in enumerate(rules)
    ])
    return blobs.select("blob", F.inline(F.filter(made, lambda x: x.isNotNull())))


def ledger_scan(docs: DataFrame, *, path_col: str = "doc_id", text_col: str = "text", ledger: str | None = None,
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every row: all columns of ``docs``, then ``_blob`` and ``_spans`` (with more underscores if ``docs`` has such).

    ``ledger``: folder of the ledger (blob, rule, version, findings).  Scanning
    appends one batch to it; a later call with the same folder scans only the
    (blob, rule, version) that no batch holds.  None keeps a ledger for this
    call alone.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{Scratch(spark, 'ledger').root}/ledger"
    schema = f"blob binary, rule string, version int, findings {FINDING}"
    blob_name, spans_name, hit_name, all_name = fresh(docs.columns, "_blob", "_spans", "_hit", "_all")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select("*", F.unhex(F.sha2(text, 256)).alias(blob_name))
    # one path per blob holds the text to scan; paths are spread evenly, so no blob is hot here
    first = rows.groupBy(F.col(blob_name).alias("blob")).agg(F.min(path_col).alias("_path"))
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(ledger)
    old = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    read = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger)
    wanted = spark.createDataFrame([(k, r.kind, r.version) for k, r in enumerate(rules)], "k int, rule string, version int")
    every = F.array(*[F.lit(k) for k in range(len(rules))])
    if old:
        seen = read().join(F.broadcast(wanted), ["rule", "version"]).groupBy("blob").agg(F.collect_set("k").alias("seen"))
        first = first.join(seen, "blob", "left").withColumn("need", F.array_except(every, F.coalesce("seen", F.array().cast("array<int>"))))
        first = first.where(F.size("need") > 0).select("blob", "_path", "need")
    else:
        first = first.withColumn("need", every)
    texts = rows.select(F.col(blob_name).alias("t_blob"), F.col(path_col).alias("t_path"), text.alias("text"))
    todo = first.hint("shuffle_hash").join(texts, F.col("_path").eqNullSafe(F.col("t_path")) & (F.col("blob") == F.col("t_blob")), "inner").select("blob", "text", "need")
    # pairs without findings record that they were seen; a repeated row gives its blob twice
    batch = f"{ledger}/batch={uuid.uuid4().hex}"
    scan_blobs(todo, rules).dropDuplicates(["blob", "rule"]).write.mode("overwrite").parquet(batch)
    hits = (
        read().join(F.broadcast(wanted), ["rule", "version"], "left_semi").where(F.size("findings") > 0)
        .groupBy(F.col("blob").alias(hit_name)).agg(F.flatten(F.collect_set("findings")).alias(all_name))
    )
    spans = F.array_sort(F.coalesce(F.array_distinct(F.col(all_name)), F.array().cast(FINDING)),
                         lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["ord"] != b["ord"], a["ord"] - b["ord"]).otherwise(a["end"] - b["end"]))
    return rows.join(hits, rows[blob_name] == hits[hit_name], "left").withColumn(spans_name, spans).drop(hit_name, all_name)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the spans' order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["at"]
        piece = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
        return F.struct(piece.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    )
