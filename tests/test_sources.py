from tidemark.sources import delimited
from tidemark.streaming import arrivals

ALIASES = {"name": ["hospital name", "company name"], "city": ["city", "town"], "phone": ["phone", "contact no"]}


def test_detection():
    assert delimiter_of("a;b;c\n1;2;3\nx,y;z;w\n") == ";" and delimiter_of("one line") == ","
    assert delimited.decode("é".encode("cp1252"))[1] == "cp1252" and delimited.decode(b"\xef\xbb\xbfa")[0] == "a"


def delimiter_of(text):
    return delimited.delimiter(text)


def test_ragged_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_bytes("Title\n\nHospital Name;City;Phone;Extra\nÄrzte;Kota;1;x\nShort;Jaipur\nHospital Name;City;Phone;Extra\n".encode("cp1252"))
    (tmp_path / "sub" / "b.tsv").write_text("Company Name\tTown\nAcme\tAmbala\textra\n")
    (tmp_path / "~$lock.csv").write_text("x,y\n")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    files = {r["path"].rsplit("/", 1)[-1]: r["supported"] for r in delimited.listing(spark, str(tmp_path)).collect()}
    assert files == {"a.csv": True, "b.tsv": True, "c.bin": False}
    rows = delimited.read_delimited(spark, str(tmp_path))
    got = {(r["path"].rsplit("/", 1)[-1], r["row"]): dict(r["values"]) for r in delimited.records(rows, ALIASES).collect()}
    assert got["a.csv", 4] == {"name": "Ärzte", "city": "Kota", "phone": "1"} and got["a.csv", 5] == {"name": "Short", "city": "Jaipur"}
    assert got["b.tsv", 2] == {"name": "Acme", "city": "Ambala"}


def test_odd_files(spark, tmp_path):
    """Hidden folders stay out, a row that cannot be read is named, undefined bytes are Latin-1, plain text comes in chunks."""
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.csv").write_text("a,b\n")
    (tmp_path / "a.csv").write_bytes(b"name,city\nA\x81,B\n" + b'"' + b"x" * 140_000 + b'",y\nC,D\n')
    (tmp_path / "n.txt").write_text("\n".join(f"line {i} of a note" for i in range(2001)))
    (tmp_path / "t.txt").write_text("a|b\n1|2\n3|4\n")
    assert [r["path"].rsplit("/", 1)[-1] for r in delimited.listing(spark, str(tmp_path)).collect()] == ["a.csv", "n.txt", "t.txt"]
    rows = {(r["path"].rsplit("/", 1)[-1], r["row"]): r for r in delimited.read_delimited(spark, str(tmp_path)).collect()}
    assert rows["a.csv", 2]["encoding"] == "latin-1" and rows["a.csv", 3]["problem"] and rows["a.csv", 4]["cells"] == ["C", "D"] and rows["t.txt", 2]["cells"] == ["1", "2"]
    lines = delimited.read_lines(spark, str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[-1] for r in lines} == {"n.txt"} and {r["chunk"] for r in lines} == {0, 1} and len(lines) == 2001


def test_arrivals(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    put = lambda rows: spark.createDataFrame(rows, "k int, v string").write.mode("append").parquet(at("in"))
    go = lambda: arrivals.follow(spark, at("in"), "k int, v string", at("out"), ["k"], at("ck"), buckets=8)
    put([(i, "a") for i in range(40)])
    go()
    put([(2, "c"), (90, "d")])
    go()
    go()
    got = dict(map(tuple, arrivals.current(spark, at("out"), "k int, v string", 1).collect()))
    assert got == {**{i: "a" for i in range(40)}, 2: "c", 90: "d"}
    assert dict(map(tuple, arrivals.current(spark, at("out"), "k int, v string", 0).collect()))[2] == "a"
    versions = [r["version"] for r in arrivals.manifest(spark, at("out"), 1).collect()]
    assert sorted(set(versions)) == [0, 1] and versions.count(1) <= 2
