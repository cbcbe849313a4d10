"""Readers and writers."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.sources.tables import jdbc_options, load_jdbc, load_parquet, read_code_list, read_rows, write_csv


def test_load_parquet_is_lazy(spark, sf):
    t = load_parquet(spark, sf, ["orders.parquet", "gone.parquet"])
    assert set(t) == {"orders", "gone"} and len(t) == 2 and "x" not in t
    assert t["orders"].count() == 1500
    assert "orders" not in t.without("orders")


def test_load_jdbc_opens_nothing_until_asked(spark):
    t = load_jdbc(
        spark, "jdbc:none:nothing", ["ovst", "opitemrece"], {"user": "u"}, split={"opitemrece": ("vstdate", "2020-01-01", "2020-12-31", 12)}
    )
    assert sorted(t) == ["opitemrece", "ovst"]


def test_jdbc_slices_types_and_refusal(spark):
    typed = T.StructType([T.StructField("vn", T.StringType()), T.StructField("uc_money", T.DecimalType(12, 2))])
    split = {"opitemrece": ("vstdate", "2020-01-01", "2020-12-31", 12)}
    assert jdbc_options("opitemrece", split) == {
        "partitionColumn": "vstdate", "lowerBound": "2020-01-01", "upperBound": "2020-12-31", "numPartitions": "12",
    }
    assert jdbc_options("vn_stat", split, ["vn_stat"], {"vn_stat": typed}) == {"customSchema": "`vn` string, `uc_money` decimal(12,2)"}
    with pytest.raises(ValueError, match="vn_stat has no split"):
        load_jdbc(spark, "jdbc:none:nothing", ["vn_stat"], {}, split)["vn_stat"]


def test_declared_types_are_checked(spark, sf):
    def declared(kind):
        return {"orders": T.StructType([T.StructField("o_orderkey", kind), T.StructField("o_clerk", T.StringType())])}

    kind = spark.read.parquet(f"{sf}/orders.parquet").schema["o_orderkey"].dataType
    schema = {"orders": T.StructType([T.StructField("O_ORDERKEY", kind)])}
    assert load_parquet(spark, sf, ["orders.parquet"], schema)["orders"].count() == 1500
    t = load_parquet(spark, sf, ["orders.parquet"], declared(T.DateType()))
    with pytest.raises(TypeError, match="orders: o_orderkey: .*, not date; o_clerk: absent, not string"):
        t["orders"]


def test_csv_keeps_a_stated_order(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.range(5000).selectExpr(
        "CASE WHEN id % 100 = 7 THEN NULL ELSE cast(id * 7919 % 5000 AS string) END AS k", "cast(id AS string) AS v"
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv(df, path, order=["k", "v"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(glob.glob(path + "/part-*")) > 1
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    got = [(r.k, r.v) for r in read_rows(spark, path, schema).orderBy("_pos").collect()]
    assert got == sorted(((r.k, r.v) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))


def test_csv_quotes_and_blanks(spark, make, tmp_path):
    path = str(tmp_path / "out")
    write_csv(make("a string, b string", ('say "hi"', None), ("ไทย, x", "")).coalesce(1), path)
    text = open(glob.glob(path + "/part-*")[0], encoding="utf-8", newline="").read()
    assert text == '"a","b"\r\n"say ""hi""",""\r\n"ไทย, x",""\r\n'
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    back = spark.read.schema(schema).option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)
    assert {r.a for r in back.collect()} == {'say "hi"', "ไทย, x"}


def test_imported_lists(spark, tmp_path):
    codes = tmp_path / "codes.json"
    codes.write_text('{"code": "A1"}\n{"code": "B2"}\n', encoding="utf-8")
    assert sorted(r.code for r in read_code_list(spark, str(codes)).collect()) == ["A1", "B2"]
    rows = tmp_path / "rows.csv"
    rows.write_text('icode,name\n1,"a ""b"""\n2,c\n', encoding="utf-8")
    schema = T.StructType([T.StructField("icode", T.StringType()), T.StructField("name", T.StringType())])
    got = read_rows(spark, str(rows), schema).orderBy("_pos").collect()
    assert [(r.icode, r.name) for r in got] == [("1", 'a "b"'), ("2", "c")]


def test_imported_position_follows_files_and_rows(spark, tmp_path):
    """The last row of the last file wins, whichever file is read first or is larger."""
    folder = tmp_path / "rows"
    folder.mkdir()
    (folder / "a.json").write_text("".join('{"icode": "1", "name": "a%05d"}\n' % k for k in range(20_000)), encoding="utf-8")
    (folder / "b.json").write_text('{"icode": "1", "name": "b0"}\n{"icode": "1", "name": "b1"}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("icode", T.StringType()), T.StructField("name", T.StringType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [r.name for r in read_rows(spark, str(folder), schema).orderBy("_pos").collect()]
            assert got == sorted(got) and len(got) == 20_002
            winner = read_rows(spark, str(folder), schema).groupBy("icode").agg(F.max_by("name", "_pos").alias("name"))
            assert winner.first().name == "b1"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
