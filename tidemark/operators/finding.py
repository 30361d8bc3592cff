"""Searches with optional filters, pages and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(columns: list[str], query: str, wildcard: bool = False) -> Column:
    """Whether one of the columns holds the query, whatever its case; with ``wildcard`` its ``_`` stands for a blank and ``%`` goes."""
    q = query.strip().lower()
    if wildcard:
        q = q.replace("%", "").replace("_", " ")
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q)
    return out


def search(rows: DataFrame, columns: list[str], query: str = "", equal: dict[str, str] | None = None, wildcard: bool = False) -> DataFrame:
    """Rows that hold ``query`` in one of ``columns`` and equal every filter that is given; filters compare without case, empty ones say nothing."""
    out = rows.where(contains_any(columns, query, wildcard)) if query.strip() else rows
    for c, v in (equal or {}).items():
        if v not in ("", None):
            out = out.where(F.lower(F.col(c).cast("string")) == str(v).lower())
    return out


def sorted_page(rows: DataFrame, sort: str, allowed: list[str], key: str, descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in the order of an allowed column (else the first), then of the key; 1 to 500 rows."""
    c = sort if sort in allowed else allowed[0]
    return rows.orderBy(F.desc(c) if descending else F.asc(c), key).offset(max(0, offset)).limit(max(1, min(limit, 500)))


def after(rows: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The next ``limit`` rows behind ``last`` in the order of a unique key; ``last`` null starts anew."""
    some = rows if last is None else rows.where(F.col(key) > F.lit(last))
    return some.orderBy(key).limit(limit)


def without_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates (alias, city, entity) but those that were rejected for their city, or for any (an empty one)."""
    here = rejected.where("city <> ''").select("alias", "city", "entity").distinct()
    anywhere = rejected.where("city = ''").select("alias", "entity").distinct()
    return candidates.join(here, ["alias", "city", "entity"], "left_anti").join(anywhere, ["alias", "entity"], "left_anti")


def by_status(rows: DataFrame, status: str, column: str = "catalogue_status") -> DataFrame:
    """``approved``, ``review`` or ``all``."""
    if status not in ("approved", "review", "all"):
        raise ValueError(status)
    return rows if status == "all" else rows.where(F.col(column) == status)


def checklist_rows(rows: DataFrame, name: str, query: str = "", show: str = "all", missing: str = "missing", review: str = "needs_review") -> DataFrame:
    """Checklist rows whose name holds the query and that are ``missing`` documents, ``complete``, in ``review``, or ``all``."""
    out = rows.where(contains_any([name], query)) if query.strip() else rows
    tests = {"missing": F.col(missing) > 0, "complete": F.col(missing) == 0, "review": F.col(review) > 0}
    return out.where(tests[show]) if show in tests else out


def of_category(rows: DataFrame, types: str, category: str) -> DataFrame:
    """Rows whose list of types holds the category; ``none`` finds those without types, an empty category all."""
    if not category:
        return rows
    empty = F.coalesce(F.size(types), F.lit(0)) <= 0
    return rows.where(empty if category == "none" else F.array_contains(types, category))


def drive_search(records: DataFrame, entries: DataFrame, query: str, kind: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Records (record_key, identity, entry_key, kind, search_text) of live entries that hold the query: the first of each identity, with its copies."""
    live = records.join(entries.where("status = 'deleted'").select("entry_key"), "entry_key", "left_anti")
    hit = live.where(F.col("search_text").contains(query.lower()[:200]))
    hit = hit.where(F.col("kind") == kind) if kind else hit
    g = hit.groupBy("identity").agg(F.min("record_key").alias("record_key"), F.count("*").alias("copies"))
    return g.orderBy("record_key").offset(max(0, offset)).limit(min(100, limit))


def work_queue(entries: DataFrame) -> DataFrame:
    """Entries to work on (status, member_path, drive_id, size_bytes, entry_key) with their ``place`` in the queue's order: failures last, containers last, small ones first."""
    order = [F.when(F.col("status") == "failed", 1).otherwise(0), F.when(F.col("member_path") == "", 1).otherwise(0), "drive_id", "size_bytes", "entry_key"]
    return entries.where(F.col("status").isin("pending", "failed", "reading")).orderBy(*order)
