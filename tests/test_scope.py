"""Payer scope, windows, joins with children, and the seeded tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlens.operators import fdh, inpatient, outpatient, rules
from claimlens.operators.scope import payer_scope, with_children
from claimlens.params import Params
from claimlens.sources import dates
from claimlens.sources.binding import bind
from claimlens.sources.tables import Tables

DAY = dt.date(2026, 3, 23)


def test_params():
    p = Params("2026-03-01", "2026-03-31", include_opd=False, include_ipd=False)
    assert p.branches == (True, True) and p.but(include_ipd=True).branches == (False, True)
    with pytest.raises(ValueError):
        Params("2026-03-02", "2026-03-01")


@pytest.fixture
def schemes(spark, make):
    rows = [("10", "UCS", "Y"), ("11", "WEL", "N"), ("12", "OFC", "Y"), ("13", "", "Y"), ("14", None, "Y")]
    return Tables(spark, {"pttype": make("pttype string, hipdata_code string, isuse string", *rows)})


@pytest.mark.parametrize(
    ("mode", "fund", "payers", "groups", "expected"),
    [
        ("override", "FDH", None, None, {"10"}),
        ("override", "FDH", ("12", "11"), None, {"11", "12"}),
        ("intersect", "FDH", ("10", "12"), None, {"10"}),
        ("intersect", "ECLAIM", None, None, {"10", "12", "13"}),
        ("groups", "FDH", None, ("OFC", "WEL"), {"12"}),
        ("groups", "FDH", ("10",), ("OFC",), set()),
    ],
)
def test_payer_scope(make, schemes, mode, fund, payers, groups, expected):
    visits = make("pttype string", *[(x,) for x in ("10", "11", "12", "13", "14", "15", None)])
    p = Params(DAY, DAY, payers=payers, groups=groups)
    assert {r.pttype for r in payer_scope(visits, "pttype", schemes, p, mode, fund).collect()} == expected


def test_payer_scope_mode_is_checked(make, schemes):
    with pytest.raises(ValueError):
        payer_scope(make("pttype string"), "pttype", schemes, Params(DAY, DAY), "other", "FDH")


def test_with_children_is_a_left_join(make):
    parent = make("k string, a int", ("x", 1), ("y", 2), (None, 3))
    child = make("k string, b int", ("x", 7), ("x", 8), (None, 9), ("z", 1))
    rows = with_children(parent, child, "k").collect()
    assert sorted((str(r.k), r.a, r.b) for r in rows if r.b) == [("x", 1, 7), ("x", 1, 8)]
    assert sorted((str(r.k), r.a) for r in rows if r.b is None) == [("None", 3), ("y", 2)]


def test_diagnosis_types_join_as_in_the_sql(make, spark):
    """Rows of fdh_odx equal its chain of plain left joins, with repeated, null and unlisted types, codes and visits."""
    t = Tables(
        spark,
        {
            "ovst": make(
                "vn string, hn string, vstdate date, pttype string, spclty string",
                ("1", "a", DAY, "10", "01"), ("2", "a", DAY, "10", None), ("3", "b", DAY, "10", "02"), (None, "c", DAY, "10", "01"),
            ),
            "ovstdiag": make(
                "vn string, hn string, vstdate date, icd10 string, diagtype string, doctor string",
                ("1", "a", DAY, "J10", "1", "d"), ("1", "a", DAY, "J10", "1", "d"), ("1", "a", DAY, "J11", "2", None),
                ("2", "a", DAY, None, None, "d"), ("2", "a", DAY, "J12", "9", "e"), (None, "c", DAY, "J13", "1", "d"),
            ),
            "diagtype": make("diagtype string, name string", ("1", "main"), ("1", "main again"), ("2", "other"), (None, "none")),
            "pttype": make("pttype string, hipdata_code string, isuse string", ("10", "UCS", "Y")),
            "spclty": make("spclty string, provis_code string", ("01", "x"), ("02", None)),
            "doctor": make("code string, licenseno string", ("d", "L1"), ("e", "")),
            "patient": make("hn string, cid string", ("a", "C1"), ("b", None)),
        },
    )
    found = fdh.fdh_odx(t, Params(DAY, DAY))
    for name in ("ovst", "ovstdiag", "diagtype", "doctor", "patient"):
        t[name].createOrReplaceTempView(f"odx_{name}")
    plain = spark.sql(
        "SELECT v.hn, g.icd10, g.diagtype, m.licenseno, p.cid, v.vn FROM odx_ovst v LEFT JOIN odx_ovstdiag g ON g.vn = v.vn "
        "LEFT JOIN odx_diagtype t ON t.diagtype = g.diagtype LEFT JOIN odx_doctor m ON m.code = g.doctor LEFT JOIN odx_patient p ON p.hn = v.hn"
    )
    rows = sorted(map(str, map(tuple, found.select("hn", "diag", "dxtype", "licenseno", "cid", "vn").collect())))
    assert rows == sorted(map(str, map(tuple, plain.collect()))) and len(rows) == 9


def _narrow(df, days, column):
    lo, mid, hi = days
    return df(Params(lo, mid)).unionByName(df(Params(mid + dt.timedelta(days=1), hi))), df(Params(lo, hi))


@pytest.mark.parametrize("name", ["fdh_opd", "fdh_idx", "fdh_cha", "fdh_phdb"])
def test_two_windows_make_one(spark, sf, name):
    t = bind(spark, sf)
    days = (dt.date(1995, 1, 1), dt.date(1997, 6, 30), dt.date(2002, 1, 1))
    parts, whole = _narrow(lambda p: getattr(fdh, name)(t, p), days, "vstdate")
    assert parts.exceptAll(whole).count() == 0 and whole.exceptAll(parts).count() == 0


FILES = [
    outpatient.billtran_funnel, outpatient.billitems, outpatient.opservice, outpatient.dispensing, outpatient.opdx,
    fdh.fdh_orf, fdh.fdh_odx, fdh.fdh_dru, fdh.fdh_phdb, rules.cancer_missing_z,
]


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    """The hospital's tables as files, charge lines and diagnoses with a date rule; some lines are days off or undated."""
    root, bound = tmp_path_factory.mktemp("hospital"), bind(spark, sf)
    moved = F.when(F.col("qty") % 7 == 0, F.date_add("vstdate", 3)).when(F.col("qty") % 11 == 0, None).otherwise(F.col("vstdate"))
    for name in bound:
        rows = bound[name]
        if name == "opitemrece":
            rows = rows.withColumn("vstdate", moved)
        rows.write.parquet(f"{root}/{name}")
    t = Tables(spark, {p.name: spark.read.parquet(str(p)) for p in root.iterdir()})
    dates.write_rules(t, f"{root}-rules", {"opitemrece": "ovst", "ovstdiag": "ovst"})
    return t, dates.with_rules(t, f"{root}-rules"), f"{root}-rules"


@pytest.mark.parametrize("operator", FILES)
def test_date_rules_change_the_scan_and_not_the_rows(stored, operator):
    whole, ruled, _ = stored
    p = Params("1996-03-01", "1996-09-30")
    plain, pruned = operator(whole, p), operator(ruled, p)
    assert plain.exceptAll(pruned).count() == 0 and pruned.exceptAll(plain).count() == 0


def test_date_rules_are_checked(stored, spark):
    whole, ruled, path = stored
    rule = ruled.dates["opitemrece"]
    assert rule.undated and {hi for _, hi in rule.months.values()} == {3} and not whole.dates
    assert not ruled.dates["ovstdiag"].undated
    changed = dates.with_rules(whole.with_tables(opitemrece=whole["opitemrece"].where("qty > 1"), ovst=whole["ovst"]), path)
    assert set(changed.dates) == {"opitemrece", "ovstdiag"}  # the same files
    other = spark.createDataFrame([("1", None)], "vn string, vstdate date")
    assert set(dates.with_rules(whole.with_tables(opitemrece=other), path).dates) == {"ovstdiag"}
    assert set(ruled.with_tables(opitemrece=other).dates) == {"ovstdiag"}
    assert not ruled.with_tables(ovst=other).dates
    empty = Params("1970-01-01", "1970-01-31")
    assert whole["opitemrece"].where(rule.condition(empty)).where("vstdate IS NOT NULL").count() == 0


def test_intersect_is_within_override(spark, sf):
    t = bind(spark, sf)
    p = Params("1995-01-01", "2002-01-01", payers=("10", "12"))
    narrow = inpatient.cipn_ipadt(t, p).select("an").distinct()
    wide = inpatient.ipn_ipadt(t, p).select("an").distinct()
    assert narrow.exceptAll(wide).count() == 0 and 0 < narrow.count() < wide.count()


def test_branches_of_the_entitlement_file(spark, sf):
    t = bind(spark, sf)
    p = Params("1995-01-01", "2002-01-01")
    both = fdh.fdh_pat(t, p).count()
    assert both == fdh.fdh_pat(t, p.but(include_ipd=False)).count() + fdh.fdh_pat(t, p.but(include_opd=False)).count()
    ins = fdh.fdh_ins(t, p.but(groups=("OFC",), payers=("12",), include_opd=False))
    assert {r.subtype for r in ins.select("subtype").distinct().collect()} == {"12"}


@pytest.fixture
def seed(spark, make):
    """Seeded hospital: five patients, five visits, four admissions."""
    people = [
        ("HN001", "นาย", "สมชาย", "ใจดี"), ("HN002", "นาง", "สมหญิง", "รักสุข"), ("HN003", "นาย", "สมศักดิ์", "มั่นคง"),
        ("HN101", "นาย", "วิชัย", "สุขสันต์"), ("HN102", "นาง", "สุภา", "ดีงาม"),
    ]
    visits = [
        ("VN001", "HN001", dt.date(2026, 3, 23), "CSOP", 1500, "wait"), ("VN002", "HN002", dt.date(2026, 3, 23), "CSOP", 2300, "ok"),
        ("VN003", "HN003", dt.date(2026, 3, 22), "CSOP", 1800, "wait"), ("VN004", "HN001", dt.date(2026, 3, 20), "SSOP", 800, "ok"),
        ("VN005", "HN002", dt.date(2026, 3, 21), "SSOP", 950, "wait"),
    ]
    schemes = [("CSOP", "OFC", "Y"), ("SSOP", "SSS", "Y")]
    return Tables(
        spark,
        {
            "patient": make("hn string, pname string, fname string, lname string", *people),
            "ovst": make("vn string, hn string, vstdate date, pttype string, income int, status string", *visits),
            "pttype": make("pttype string, hipdata_code string, isuse string", *schemes),
        },
    )


def test_seeded_visits(seed):
    rows = outpatient.visit_list(seed, Params("2026-03-21", "2026-03-22")).collect()
    assert {(r.hn, r.patient_name, r.amount) for r in rows} == {
        ("HN003", "นายสมศักดิ์ มั่นคง", 1800), ("HN002", "นางสมหญิง รักสุข", 950),
    }


def test_seeded_statistics(seed):
    whole = Params("2026-03-01", "2026-03-31")
    assert outpatient.visit_statistics(seed, whole).first().asDict() == {"total": 2, "passed": 0, "needfix": 0}
    assert outpatient.visit_statistics(seed, whole.but(fund="OFC")).first().total == 3
    assert outpatient.visit_statistics(seed, whole.but(payers=("CSOP", "SSOP"))).first().total == 5
