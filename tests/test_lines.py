"""Numbers in lines that are part of a name or in front of one."""

from pyspark.sql import functions as F

from tidemark.functions import lines as N


def test_numbers_of_names(spark):
    rows = [("12345) Lotus12345 Clinic, Kota, 302001", "Lotus12345 Clinic", "302001", ""), ("302004) Lotus302004 Clinic | Kota", "Lotus302004 Clinic", "", ""),
            ("12345678. Lotus12345678 Clinic; Ph: 9876500011", "Lotus12345678 Clinic", "", "9876500011"), ("Star Clinic, pin302001, Ph9876500011", "Star Clinic", "302001", "9876500011"),
            ("Star Clinic, (0141) 2345678", "Star Clinic", "", "(0141) 2345678")]
    frame = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, text string")
    got = frame.select("k", N.parse(F.col("text")).alias("p")).orderBy("k").collect()
    assert [(g["p"]["name"], g["p"]["pincode"], g["p"]["phone"]) for g in got] == [r[1:] for r in rows]
