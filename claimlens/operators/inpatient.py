"""Inpatient claim files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.flags import (
    checks,
    constants,
    filled,
    join_text,
    known,
    money,
    person_name,
    picks,
    product,
    yn,
)
from claimlens.functions.numbering import dense_ids, number_within
from claimlens.operators.fdh import (
    ADMISSION_COLUMNS,
    OPERATION_COLUMNS,
    admission_checks,
    admission_rows,
    diagnosis_rows,
    operation_checks,
    operation_rows,
    scoped_admissions,
    with_charge_group,
    with_payer_charges,
)
from claimlens.operators.scope import active_schemes, date_window, keep_schemes, link, with_children
from claimlens.params import Params
from claimlens.sources.tables import Tables

FUND = "OFC"
# Admission source by admission type; anything else is O.
ADMISSION_SOURCE = {"1": "O", "3": "B", "2": "E"}
NEWBORN_DAYS = 28


def ipn_ipadt(t: Tables, p: Params) -> DataFrame:
    """Admissions with nine checks and the patient's name."""
    rows = link(admission_rows(scoped_admissions(t, p, fund=FUND), t), t["patient"], "pt", "pt.hn = i.hn")
    return rows.select(*picks(ADMISSION_COLUMNS + ", pt.pname, pt.fname, pt.lname, pt.cid"), *admission_checks())


def _moment(day: str, time: str) -> Column:
    return F.expr(f"try_cast(concat(cast({day} AS STRING), ' ', {time}) AS TIMESTAMP_NTZ)")


def cipn_ipadt(t: Tables, p: Params) -> DataFrame:
    """Admissions with source, admit and discharge moments, leave days and weight.

    Leave days are leave minus return (negative when the patient came back
    later), and the weight is in kilograms: three decimals under 28 days of
    age, whole numbers otherwise.
    """
    rows = link(scoped_admissions(t, p, "intersect", FUND).alias("i"), t["an_stat"], "st", "st.an = i.an")
    rows = link(rows, t["ipt_home_leave"], "h", "h.an = i.an")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn", "inner")
    rows = link(rows, t["ptcardno"], "pc", "pc.hn = p.hn")
    rows = link(rows, t["spclty"], "sp", "sp.spclty = i.spclty")
    source = F.lit("O")
    for admit_type, letter in ADMISSION_SOURCE.items():
        source = F.when(F.col("i.ipt_type") == admit_type, letter).otherwise(source)
    newborn = (F.col("st.age_y") == 0) & (F.col("st.age_m") == 0) & (F.col("st.age_d") < NEWBORN_DAYS)
    kilograms = F.col("i.bw").cast("decimal(12,3)") * F.lit("0.001").cast("decimal(4,3)")
    weight = F.when(newborn, F.round(kilograms, 3)).otherwise(F.round(kilograms, 0))
    return rows.select(
        *picks(
            "i.an, i.hn, pc.cardtype AS idtype, p.cid AS pidpat, p.pname AS title, p.birthday AS dob, p.sex, "
            "p.marrystatus AS marriage, p.chwpart AS changwat, p.amppart AS amphur, p.nationality AS nation, "
            "i.ipt_type AS admtype, i.dchstts AS dischstat, i.dchtype AS dischtype, i.ward AS dischwward, sp.nhso_code AS dept"
        ),
        person_name("p", title=False).alias("namepat"),
        source.alias("admsource"),
        _moment("i.regdate", "i.regtime").alias("dtadm"),
        _moment("i.dchdate", "i.dchtime").alias("dtdisch"),
        F.datediff("h.dch_date", "h.reg_date").cast("bigint").alias("leaveday"),
        weight.cast("decimal(12,3)").alias("admwt"),
    )


def cipn_ipdx(t: Tables, p: Params) -> DataFrame:
    """Diagnoses numbered within each admission."""
    admissions = scoped_admissions(t, p, "intersect", FUND).select("an", "hn", "dchdate")
    diagnoses = t["iptdiag"].select("an", "ipt_diag_id", "diagtype", "icd10", "doctor", "entry_datetime")
    rows = number_within(with_children(admissions, diagnoses, "an"), ["an"], ["ipt_diag_id"])
    rows = link(rows.alias("i"), t["icd101"], "n", "n.code = i.icd10")
    rows = link(rows, t["doctor"], "d", "d.code = i.doctor")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn", "inner")
    return rows.select(
        *picks(
            "i.dchdate, i.an, i.hn, i.sequence, i.diagtype AS dxtype, i.icd10 AS code, n.name AS diagterm, d.licenseno AS dr"
        ),
        person_name("p").alias("ptname"),
        F.to_date("i.entry_datetime").alias("datediag"),
        *constants(codesys="ICD10"),
    )


def cipn_ipop(t: Tables, p: Params) -> DataFrame:
    """Procedures numbered within each admission, with the ward as location."""
    rows = link(
        scoped_admissions(t, p, "intersect", FUND).alias("i"), t["iptoprt"], "o", "o.an = i.an", "inner"
    ).select(*picks("i.an, i.hn, i.dchdate, i.ward, o.iptoprt_id, o.icd9, o.doctor, o.opdate, o.enddate"))
    rows = number_within(rows, ["an"], ["iptoprt_id"]).alias("i")
    rows = link(rows, t["icd9cm1"], "n", "n.code = i.icd9")
    rows = link(rows, t["doctor"], "d", "d.code = i.doctor")
    rows = link(rows, t["ward"], "w", "w.ward = i.ward")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn")
    return rows.select(
        *picks(
            "i.dchdate, i.an, i.hn, i.sequence, i.icd9 AS code, n.name AS procterm, d.licenseno AS dr, "
            "i.opdate AS datein, i.enddate AS dateout"
        ),
        person_name("p").alias("ptname"),
        join_text(F.lit("xxxx:"), F.col("w.name")).alias("location"),
        *constants(codesys="ICD9CM"),
    )


def _admission_charges(admissions: DataFrame, t: Tables) -> DataFrame:
    """Per admission: number of charge lines, net sums inside and outside the group payment."""
    categories = t["nondrugitems_sks_bc"].groupBy("icode").agg(
        *[F.sum((F.col("claim_cat") == c).cast("int")).alias(f"n_{c}") for c in ("D", "T")]
    )
    lines = t["opitemrece"].join(admissions.select("an"), "an", "left_semi").select("an", "icode", "sum_price", "discount")
    rows = link(lines.alias("op"), categories, "nb", "nb.icode = op.icode")
    net = F.col("op.sum_price") - F.col("op.discount")

    def net_sum(category: str) -> Column:
        times = F.col(f"nb.n_{category}")
        return money(F.sum(F.when(times > 0, net * times)))

    return rows.groupBy(F.col("op.an").alias("an")).agg(
        F.count("op.icode").alias("n_lines"), net_sum("D").alias("drgcharge"), net_sum("T").alias("xdrgclaim")
    )


def cipn_invoices(t: Tables, p: Params) -> DataFrame:
    """Invoices with line count and the two net sums, from one aggregate per admission."""
    debts = t["rcpt_debt"].where("total_amount > 0").join(t["pttype"].select("pttype"), "pttype", "left_semi")
    admissions = scoped_admissions(t, p, "intersect", FUND)
    rows = link(admissions.alias("i"), debts, "rd", "rd.vn = i.an", "inner")
    rows = link(rows, _admission_charges(admissions, t), "c", "c.an = i.an")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn", "inner")
    return rows.select(
        *picks(
            "i.dchdate, i.an, i.hn, rd.total_amount AS invoice, rd.debt_id AS invnumber, rd.debt_date AS invdt, "
            "rd.discount_amount AS invadddiscount, c.drgcharge, c.xdrgclaim"
        ),
        person_name("p", title=False).alias("ptname"),
        F.coalesce(F.col("c.n_lines"), F.lit(0)).cast("bigint").alias("bllitem"),
    )


def cipn_billitems(t: Tables, p: Params) -> DataFrame:
    """Charge lines of admissions under one running number.

    Only the columns of the line travel through the numbering; catalogues are
    joined to the numbered rows.  ``discount`` holds the net amount and several
    columns the literal text Null, as the file layout has them.
    """
    lines = t["opitemrece"].where("an IS NOT NULL")
    lines = lines.join(t["s_drugitems"].select("icode"), "icode", "left_semi")
    rows = link(scoped_admissions(t, p, "intersect", FUND).alias("i"), lines, "op", "op.an = i.an", "inner")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn", "inner").select(
        *picks("i.dchdate, i.an, i.hn, op.rxdate, op.income, op.icode, op.qty, op.unitprice, op.sum_price, op.discount, op.hos_guid"),
        person_name("p", title=False).alias("ptname"),
    )
    order = ["an", "hos_guid", "icode", "rxdate", "qty", "unitprice", "sum_price", "discount"]
    rows = dense_ids(rows, order, "sequence").alias("op")
    rows = link(rows, t["nondrugitems"], "nd", "nd.icode = op.icode")
    rows = link(rows, t["drugitems"], "d", "d.icode = op.icode")
    rows = link(rows, t["nondrugitems_sks_bc"], "ns", "ns.icode = nd.icode")
    icode = F.col("op.icode")
    return rows.select(
        *picks(
            "op.dchdate, op.ptname, op.an, op.hn, op.sequence, op.rxdate AS servdate, op.income AS billgr, op.icode AS lccode, "
            "op.qty, op.unitprice, ns.income AS billgrcs, ns.claim_cat AS claimcat, ns.rev_date AS daterev"
        ),
        join_text(F.col("nd.name"), F.lit(" ("), F.col("nd.unit"), F.lit(")")).alias("descript"),
        product("op.qty", "op.unitprice").alias("chargeamt"),
        money(F.col("op.sum_price") - F.col("op.discount")).alias("discount"),
        F.when(icode.startswith("1"), F.col("d.sks_drug_code"))
        .when(icode.startswith("3"), F.col("nd.billcode"))
        .otherwise("")
        .alias("cscode"),
        *constants(
            procedureseq="Null", diagnosisseq="Null", claimsys="CS", codesys="Null", stdcode="Null", claimup="Null", claimamt="Null"
        ),
    )


def ipn_ipdx(t: Tables, p: Params) -> DataFrame:
    """Diagnoses with three checks."""
    return diagnosis_rows(t, p, FUND).select(
        *picks("i.hn, i.an, i.icd10 AS diag, i.diagtype AS dxtype, d.licenseno"),
        *checks(diag=known("i.icd10"), diagtype=filled("i.diagtype"), licenseno=filled("d.licenseno")),
    )


def ipn_ipop(t: Tables, p: Params) -> DataFrame:
    """Procedures with six checks."""
    return operation_rows(t, p, FUND).select(*picks("i.hn, op.an, " + OPERATION_COLUMNS), *operation_checks())


def ipn_invoices(t: Tables, p: Params) -> DataFrame:
    """Admission totals with the payer's standard code."""
    rows = link(scoped_admissions(t, p, fund=FUND).alias("i"), t["an_stat"], "st", "st.an = i.an")
    rows = link(rows, t["ipt_pttype"].where("pttype_number = '1'"), "ip", "ip.an = i.an")
    rows = link(rows, t["pttype"], "s", "s.pttype = ip.pttype")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn", "inner")
    return rows.select(
        *picks(
            "i.hn, i.an, i.regdate, i.dchdate, p.cid, st.income AS total, st.paid_money AS paid, s.pcode AS pttype_code, i.an AS seq"
        ),
        person_name("p").alias("ptname"),
        *checks(total=known("st.income")),
    )


def ipn_billitems(t: Tables, p: Params) -> DataFrame:
    """Payer charge per admission and charge group, checked to be positive."""
    rows = with_payer_charges(scoped_admissions(t, p, fund=FUND), t, "incith", "an")
    rows = with_charge_group(rows, t, "c.income")
    rows = link(rows, t["pttype"], "s", "s.pttype = v.pttype")
    rows = link(rows, t["patient"], "pt", "pt.hn = v.hn")
    return rows.select(
        *picks("v.an, v.hn, v.dchdate, s.pcode AS pttype_code, g.chrgitem_code1, c.income AS chrgitem, c.amount"),
        person_name("pt").alias("ptname"),
        *checks(chrgitem=known("c.income"), amount=F.col("c.amount") > 0),
    )


def cipn_group46(t: Tables, p: Params) -> DataFrame:
    """Approval code per admission: given, and not one that starts with PP.

    Without ticked payers every civil-servant scheme counts, in use or not.
    """
    payers = t["ipt_pttype"]
    if p.payers:
        payers = payers.where(F.col("pttype").isin(*p.payers))
    else:
        payers = keep_schemes(payers, "pttype", active_schemes(t, (FUND,), only_in_use=False))
    rows = link(t["ipt"].where(date_window("dchdate", p)).alias("i"), payers, "ip", "ip.an = i.an", "inner")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn")
    return rows.select(
        *picks("p.hn, i.an, i.regdate AS date_admit, i.regtime AS time_admit, ip.auth_code, i.dchdate, i.dchtime"),
        person_name("p", between="  ").alias("ptname"),
        yn(filled("ip.auth_code") & ~F.col("ip.auth_code").startswith("PP")).alias("auth_code_check"),
    )
