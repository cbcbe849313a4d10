"""Presence rules against NULL, empty, blank, sentinel and value."""

import pytest
from pyspark.sql import functions as F

from claimlens.functions.flags import day_case_prefix, flag_present, is_missing, person_name
from claimlens.operators.scope import fund_groups


@pytest.mark.parametrize(
    ("rule", "sentinels", "expected"),
    [
        ("known", (), "NYYYY"),
        ("filled", (), "NNYYY"),
        ("nonempty", (), "NNYYY"),
        ("filled_except", ("N",), "NNYNY"),
    ],
)
def test_presence_rules(make, rule, sentinels, expected):
    df = make("i int, x string", (0, None), (1, ""), (2, " "), (3, "N"), (4, "v"))
    rows = df.select("i", flag_present("x", rule, *sentinels).alias("f")).orderBy("i").collect()
    assert "".join(r.f for r in rows) == expected


def test_sentinels_need_their_rule():
    with pytest.raises(ValueError):
        flag_present("x", "known", "N")


def test_is_missing_compares_text(make):
    df = make("i int, x decimal(12,2)", (0, None), (1, 0), (2, 5))
    rows = df.select("i", is_missing("x", ("0", "0.00")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [True, True, False]


def test_name_skips_missing_parts(make):
    p = make("pname string, fname string, lname string", ("นาย", "สมชาย", "ใจดี"), (None, "A", None), (None, None, None)).alias("p")
    assert [r[0] for r in p.select(person_name("p")).collect()] == ["นายสมชาย ใจดี", "A ", " "]


def test_day_case_prefix(make):
    df = make("t string, an string", ("5", "A1"), ("1", "A2"), (None, "A3"))
    assert [r[0] for r in df.select(day_case_prefix("t", "an")).collect()] == ["ODSA1", "A2", "A3"]


def test_fund_groups():
    assert fund_groups("FDH") == ("UCS", "WEL")
    assert "" in fund_groups("ECLAIM") and len(fund_groups("ECLAIM")) == 6
    assert fund_groups("SSS") == ("SSS",)


def test_unknown_flag_is_no(make):
    df = make("x string", (None,))
    assert df.select(flag_present("x", "nonempty")).first()[0] == "N"
    assert df.select(F.coalesce(F.col("x"), F.lit("z"))).first()[0] == "z"
