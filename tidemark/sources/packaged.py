"""Workbooks, word-processor files, JSON and archives, each read where its bytes lie.

Files arrive as binary rows.  A file that cannot be read gives one row with its
``problem`` and no cells; other files are not touched by it.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.delimited import contents

ROW = "path string, part string, row long, cells array<string>, problem string"
MEMBER = "path string, member string, content binary, problem string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def workbook(content: bytes):
    """(sheet, row, cells) of every sheet, hidden ones too; merged cells take the value of their first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
            target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            grid: dict[int, dict[int, str]] = {}
            for n, row in enumerate((e for e in root.iter() if _tag(e) == "row"), 1):
                at = int(row.get("r") or n)
                for m, c in enumerate(row, 1):
                    v = next((x.text or "" for x in c if _tag(x) == "v"), "")
                    kind = c.get("t")
                    value = shared[int(v)] if kind == "s" and v else _text(c) if kind == "inlineStr" else v[:-2] if v.endswith(".0") else v
                    grid.setdefault(at, {})[_column(c.get("r") or "") or m] = value
            for merge in (e.get("ref") for e in root.iter() if _tag(e) == "mergeCell"):
                a, b = (merge.split(":") + [merge])[:2]
                first = grid.get(int(re.search(r"\d+", a)[0]), {}).get(_column(a), "")
                for at in range(int(re.search(r"\d+", a)[0]), int(re.search(r"\d+", b)[0]) + 1):
                    for col in range(_column(a), _column(b) + 1):
                        grid.setdefault(at, {})[col] = first
            for at in sorted(grid):
                yield s.get("name"), at, [grid[at].get(i, "") for i in range(1, max(grid[at]) + 1)]


def word_file(content: bytes):
    """(part, row, cells): paragraphs as one cell, tables row by row, in the order of the file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    table = 0
    for n, e in enumerate(body, 1):
        if _tag(e) == "p" and _text(e).strip():
            yield "text", n, [_text(e).strip()]
        elif _tag(e) == "tbl":
            table += 1
            for m, r in enumerate(e.iter(f"{_W}tr"), 1):
                yield f"table {table}", m, [_text(c).strip() for c in r.iter(f"{_W}tc")]


def flatten(value, at: str = "") -> dict[str, str]:
    """Nested keys joined by dots; lists of plain values joined by ``; ``; null is empty."""
    if isinstance(value, dict):
        return {k: v for name, inner in value.items() for k, v in flatten(inner, f"{at}.{name}" if at else name).items()}
    if isinstance(value, list):
        value = "; ".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in value)
    return {at or "value": "" if value is None else str(value)}


def json_file(content: bytes):
    """(part, row, cells): header cells first, then one row per object; a bad line of JSON lines raises only for itself."""
    text = content.decode("utf-8-sig")
    try:
        whole = json.loads(text)
        if isinstance(whole, dict):
            whole = next((v for v in whole.values() if isinstance(v, list) and v and isinstance(v[0], dict)), [whole])
        rows = [(n, flatten(r)) for n, r in enumerate(whole if isinstance(whole, list) else [whole], 1)]
    except json.JSONDecodeError:
        rows = []
        for n, line in enumerate(text.splitlines(), 1):
            try:
                if line.strip():
                    rows.append((n, flatten(json.loads(line))))
            except json.JSONDecodeError:
                yield "bad line", n, [line]
    header = list(dict.fromkeys(k for _, r in rows for k in r))
    if header:
        yield "objects", 0, header
    for n, r in rows:
        yield "objects", n, [r.get(k, "") for k in header]


READERS = {"xlsx": workbook, "docx": word_file, "json": json_file, "jsonl": json_file}


def _frames(frames):
    names = [c.split()[0] for c in ROW.split(", ")]
    for frame in frames:
        for path, kind, content in zip(frame["path"], frame["kind"], frame["content"]):
            out = []
            try:
                for part, row, cells in READERS[kind](bytes(content)):
                    out.append((path, part, row, cells, None))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            except Exception as e:  # one broken file is a row of the result, not the end of the job
                out.append((path, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            if out:
                yield pd.DataFrame(out, columns=names).astype({"row": "Int64"})


def read_packaged(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line with cells of every workbook, word-processor and JSON file below a folder."""
    return contents(spark, folder, tuple(READERS)).mapInPandas(_frames, ROW)


def members(content: bytes, depth: int = 2, most: int = 5000, total: int = 5 << 30, single: int = 128 << 20, ratio: int = 1000, at: str = ""):
    """(member, content, problem) of an archive and those inside it: what is unsafe or over a limit is named, never read."""
    count = size = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i in z.infolist():
            if i.is_dir():
                continue
            count, size, name = count + 1, size + i.file_size, f"{at}{i.filename}"
            parts = i.filename.replace("\\", "/").split("/")
            problem = (
                "too many entries" if count > most else "unsafe path" if i.filename.startswith("/") or ".." in parts or ":" in i.filename else "link" if (i.external_attr >> 28) == 0xA
                else "encrypted" if i.flag_bits & 1 else "too large" if i.file_size > single or size > total else "suspicious ratio" if i.file_size > ratio * max(1, i.compress_size) else None
            )
            if problem:
                yield name, None, problem
            elif i.filename.lower().endswith(".zip"):
                if depth <= 0:
                    yield name, None, "nested too deeply"
                    continue
                try:
                    yield from members(z.read(i), depth - 1, most, total, single, ratio, f"{name}/")
                except (zipfile.BadZipFile, RuntimeError, OSError) as e:
                    yield name, None, f"unreadable: {e}"[:500]
            else:
                try:
                    yield name, z.read(i), None
                except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError) as e:
                    yield name, None, f"unreadable: {e}"[:500]


def _members(frames):
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            try:
                for name, data, problem in members(bytes(content)):
                    yield pd.DataFrame([(path, name, data, problem)], columns=["path", "member", "content", "problem"])
            except zipfile.BadZipFile as e:
                yield pd.DataFrame([(path, None, None, f"unreadable: {e}")], columns=["path", "member", "content", "problem"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per member of every ZIP below a folder: its bytes, or the reason why it was skipped."""
    return contents(spark, folder, ("zip",)).select("path", "content").mapInPandas(_members, MEMBER)
