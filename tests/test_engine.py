"""From files to exports, and what the writers write."""

import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Catalogue
from tidemark.functions import asking as A
from tidemark.functions import text as T
from tidemark.operators import assistant as S
from tidemark.operators import exports as X
from tidemark.operators import retrieval as R
from tidemark.sources import packaged


def test_run(spark, tmp_path):
    """Two files with different headers give the same entity; a second run makes nothing again."""
    src, at = tmp_path / "in", tmp_path / "cat"
    src.mkdir()
    (src / "a.csv").write_text("Report\nHospital Name,Town,Mobile No\nLotus Clinic,Kota,9876500011\nStar Hospital,Jaipur,\nHospital Name,Town,Mobile No\n,,\n")
    (src / "b.csv").write_text("City;Phone;Field\nKota;9876500011;Lotus Clinic Kota\nAmbala;;Moon Care\nKota;;Sun Eye Care\nKota;;Total\n")
    (src / "c.bin").write_bytes(b"\x00")
    c = Catalogue(spark, str(at))
    assert [r["supported"] for r in c.inventory(str(src)).collect()] == [True, True, False]
    made = c.run(str(src))
    rows = {(r["path"].rsplit("/", 1)[-1], r["row"]): r for r in made["records"].collect()}
    assert rows["a.csv", 3]["original_name"] == "Lotus Clinic" and rows["a.csv", 3]["original_phone"] == "9876500011" and len(rows) == 6
    assert rows["b.csv", 2]["original_name"] == "Lotus Clinic Kota" and rows["b.csv", 2]["original_city"] == "Kota"
    got = {r["record_id"]: r for r in made["resolutions"].collect()}
    lotus = [got[rows[k]["record_id"]] for k in (("a.csv", 3), ("b.csv", 2))]
    assert lotus[0]["entity_id"] == lotus[1]["entity_id"] and lotus[1]["status"] == "auto_matched"
    assert got[rows["b.csv", 5]["record_id"]]["status"] == "unresolvable"
    before = (at / "cells" / "_SUCCESS").stat().st_mtime_ns
    c.run(str(src))
    assert (at / "cells" / "_SUCCESS").stat().st_mtime_ns == before
    names = {r["entity_id"]: r["standard_name"] for r in c.entities(made).collect()}
    assert names[lotus[0]["entity_id"]].startswith("Lotus Clinic") and len(names) == 4
    assert c.export(made, str(tmp_path / "out")) == ["master_data", "name_mapping", "data_quality_issues"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "name_mapping")).count() == 6
    assert c.dry_run(str(src), 4).groupBy("path").count().agg(F.max("count")).first()[0] == 3
    c.reset("resolutions")
    assert not (at / "resolutions").exists() and (at / "cleaned").exists()


def test_workbook(spark, tmp_path):
    """What the writer writes, the reader reads; large frames take several sheets."""
    df = spark.createDataFrame([(i, f"=name {i}" if i % 2 else None, i / 4) for i in range(7)], "k int, name string, v double").coalesce(1)
    at = str(tmp_path / "x.xlsx")
    assert X.write_workbook({"Data": df, "Empty": df.limit(0)}, at, sheet_rows=3) == [("Data", 3), ("Data 2", 3), ("Data 3", 1), ("Empty", 0)]
    assert zipfile.is_zipfile(at)
    got = [(r["part"], r["row"], r["cells"]) for r in packaged.read_packaged(spark, str(tmp_path)).collect()]
    assert ("Data", 1, ["k", "name", "v"]) in got and ("Data", 3, ["1", "'=name 1", "0.25"]) in got and sum(p == "Data 3" for p, *_ in got) == 2


def test_overflow_and_groups(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).cast("string").alias("g"), F.lit("@x").alias("t"))
    assert X.write_overflowing(df, str(tmp_path / "a"), "a", most=100).endswith(".xlsx")
    assert X.write_overflowing(df, str(tmp_path / "b"), "b", most=10).endswith(".csv")
    assert "more than 10 rows" in spark.read.text(str(tmp_path / "b.note")).first()[0]
    assert not X.write_groups(df, ["g"], str(tmp_path / "no"), most=2) and X.write_groups(df, ["g"], str(tmp_path / "yes"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "yes"))
    assert back.count() == 20 and back.select("t").distinct().first()[0] == "'@x" and back.select("g_folder").distinct().count() == 3


def test_matching_blocks(spark):
    pairs = [("red ring", "red rings"), ("", "a"), ("", ""), (None, "x"), ("kitten", "sitting")]
    got = spark.createDataFrame(pairs, "a string, b string").select(A.matching_blocks("a", "b")).collect()
    assert [r[0] for r in got] == pytest.approx([SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs])


def plain_research(rows, query, near, most=8, candidates=250):
    tokens = S.query_tokens(query)
    key = [t for t in tokens if t not in A.ASKING]
    signal, scored = key or tokens, []
    import re

    has = lambda text, t: re.search(rf"\b{t}\b", text) is not None
    for offer, name, text, price in rows:
        n = name.lower()
        t, m = sum(has(text, x) for x in signal), sum(has(n, x) for x in signal)
        s = SequenceMatcher(None, query, n).ratio() + 3 * (n in near) + 1.5 * (query in text) + t / max(1, len(signal)) + 1.2 * m / max(1, len(signal))
        if key and ((t == 0 and m == 0) or (m == 0 and s < 3.2)):
            continue
        if s > 0.35:
            scored.append((-s, offer, name))
    best = {}
    for _, _, name in sorted(scored)[:candidates]:
        best.setdefault(name, []).append(name)
    rank = sorted(((-(SequenceMatcher(None, query, n.lower()).ratio() + 1.5 * (n.lower() in near) + 0.05 * min(10, len(x))), n) for n, x in best.items()))[:most]
    prices = {}
    for _, name, _, price in rows:
        if price > 0:
            prices.setdefault(name, []).append(price)
    return {n: (round(-s, 6), min(prices[n]), max(prices[n]), len(prices[n])) for s, n in rank if n in prices}


def test_research(spark):
    names = ["Red Ring", "Blue Ring", "Red Bolt", "Steel Bed", "Bed Lamp", "Ring Main Unit"]
    rows = [(f"o{i:03d}", names[i % 6], f"{names[i % 6].lower()} economy {'ring' if i % 4 == 0 else 'x'}", float(i % 7) * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "offer_id string, product_name string, search_text string, price double").repartition(3)
    near = spark.createDataFrame([("Bed Lamp",)], "product_name string")
    for query, known, cfg in (("red ring", {"bed lamp"}, {}), ("show details", set(), {}), ("bed", set(), {"candidates": 7}), ("ring", set(), {"most_products": 2})):
        got = S.research(df, query, near if known else None, **cfg)
        have = {r["product_name"]: (round(r["score"], 6), r["best_price"], r["max_price"], r["vendor_count"]) for r in got.collect()}
        assert have == plain_research(rows, query, known, cfg.get("most_products", 8), cfg.get("candidates", 250)), query


def test_nearest_names_cut(spark):
    from tidemark.scratch import checkpointer

    names = [f"lotus clinic {w}" for w in ("kota", "jaipur", "ambala", "agra", "pune", "delhi", "surat", "goa")] + ["star"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    whole = R.nearest_names(df, "n", F.col("n"), checkpointer(spark, "t"), k=1000, least=0.1).collect()
    cut = R.nearest_names(df, "n", F.col("n"), checkpointer(spark, "t"), k=3, least=0.1).collect()
    want = {n: [r["r"] for r in sorted((x for x in whole if x["l"] == n), key=lambda x: (-x["cosine"], x["r"]))[:3]] for n in names}
    got = {n: [r["r"] for r in sorted((x for x in cut if x["l"] == n), key=lambda x: (-x["cosine"], x["r"]))] for n in names}
    assert got == want and len(got[names[0]]) == 3 and len(whole) > len(cut)


def test_unicode(spark):
    rows = [("ＡＢＣ　Ｈosp", "abc hosp"), ("a​b", "ab"), ("Café x", "café x"), ("n.a", ""), ("#REF!", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.normal(F.col("a")), "b", T.compose(F.lit("é"))).collect()
    assert all(r[0] == r[1] and r[2] == "é" for r in got)
