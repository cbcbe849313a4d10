"""The sixteen-file universal-coverage set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.flags import (
    checks,
    constants,
    day_case_prefix,
    filled,
    filled_except,
    join_text,
    known,
    money,
    nonempty,
    person_name,
    picks,
)
from claimlens.operators.scope import (
    children_of,
    PATIENT_PAYS,
    PAYER_PAYS,
    date_window,
    hospital_code,
    link,
    of_dates,
    payer_scope,
    union_branches,
    with_children,
)
from claimlens.params import Params
from claimlens.sources.tables import Tables

FUND = "FDH"
MIDNIGHT = "00:00:00"
# Scheme code for a paying patient, and the two payment labels.
SELF_PAY_CODE = "10"
SELF_PAY_LABEL = "ชำระเงิน"
SCHEME_LABEL = "ใช้สิทธิ"


def scoped_visits(t: Tables, p: Params, mode: str = "override", fund: str = FUND) -> DataFrame:
    return payer_scope(t["ovst"].where(date_window("vstdate", p)), "pttype", t, p, mode, fund)


def scoped_admissions(t: Tables, p: Params, mode: str = "override", fund: str = FUND) -> DataFrame:
    return payer_scope(t["ipt"].where(date_window("dchdate", p)), "pttype", t, p, mode, fund)


# -- entitlement and patients ------------------------------------------------


def _entitled(t: Tables, p: Params) -> tuple[DataFrame, DataFrame]:
    """Visits and admissions with payer rows (``vp``), schemes (``s``), patients (``pt``)."""
    visits = payer_scope(
        t["ovst"].where(date_window("vstdate", p)), "pttype", t, p.but(payers=None), "groups", FUND
    )
    payers = t["visit_pttype"]
    if p.payers:
        opd = link(visits.alias("v"), payers.where(F.col("pttype").isin(*p.payers)), "vp", "vp.vn = v.vn", "inner")
    else:
        opd = link(visits.alias("v"), payers, "vp", "vp.vn = v.vn")
    admissions = t["ipt"].where(date_window("dchdate", p))
    ipd_payers = payer_scope(t["ipt_pttype"], "pttype", t, p, "groups", FUND)
    ipd = link(admissions.alias("v"), ipd_payers, "vp", "vp.an = v.an", "inner")

    def complete(rows: DataFrame) -> DataFrame:
        rows = link(rows, t["pttype"], "s", "s.pttype = vp.pttype")
        return link(rows, t["patient"], "pt", "pt.hn = v.hn")

    return complete(opd), complete(ipd)


def fdh_ins(t: Tables, p: Params) -> DataFrame:
    """Entitlement rows with five checks; ``an`` is blank when outpatients stand alone."""
    opd, ipd = _entitled(t, p)
    both = all(p.branches)

    def layout(rows: DataFrame, day: str, an: Column, seq: str) -> DataFrame:
        return rows.select(
            F.col(day).alias("visit_date"),
            person_name("pt").alias("ptname"),
            *picks(
                "s.name AS pttype_name, pt.hn, s.hipdata_code AS inscl, vp.pttype AS subtype, pt.cid, "
                "vp.expire_date AS dateexp, vp.hospmain, vp.hospsub, vp.auth_code AS permitno, s.nhso_code AS subinscl"
            ),
            *checks(
                inscl=known("s.hipdata_code"),
                cid=known("pt.cid"),
                hospmain=filled("vp.hospmain"),
                hospsub=filled("vp.hospsub"),
                permitno=known("vp.auth_code"),
            ),
            an.alias("an"),
            F.col(seq).alias("seq"),
            *constants(govcode="", govname="", docno="", ownrpid="", ownname="", relinscl="", htype="1"),
        )

    rows = union_branches(
        p,
        layout(opd, "v.vstdate", F.col("vp.vn") if both else F.lit(""), "vp.vn"),
        layout(ipd, "v.dchdate", F.col("vp.an"), "v.vn"),
    )
    return rows.withColumn("hcode", hospital_code(t))


def fdh_ins_43(t: Tables, p: Params) -> DataFrame:
    """The older entitlement layout with nine checks."""
    opd, ipd = _entitled(t, p)
    nothing = F.lit(None).cast("string")

    def layout(rows: DataFrame, day: str, key: str, main: Column, ipt_type: Column, admit: Column) -> DataFrame:
        return rows.select(
            *picks(
                f"pt.pname, pt.fname, pt.lname, {day} AS visit_date, pt.hn, s.hipdata_code, vp.pttype, pt.cid, "
                f"vp.expire_date, vp.hospmain, vp.hospsub, vp.auth_code, {key} AS vn, s.hipdata_code AS htype, "
                "vp.claim_code, s.hipdata_pttype"
            ),
            *checks(
                hipdata_code=known("s.hipdata_code"),
                pttype=known("vp.pttype"),
                cid=known("pt.cid"),
                expire_date=known("vp.expire_date"),
                hospmain=main,
                hospsub=known("vp.hospsub"),
                auth_code=known("vp.auth_code"),
                hipdata_code_dup=known("s.hipdata_code"),
                claim_code=known("vp.claim_code"),
            ),
            ipt_type.alias("ipt_type"),
            admit.alias("ipt_admit_type_id"),
        )

    return union_branches(
        p,
        layout(opd, "v.vstdate", "vp.vn", known("vp.hospmain"), nothing, nothing),
        layout(
            ipd,
            "v.dchdate",
            "vp.an",
            F.col("vp.hospmain").between("00000", "99999"),
            F.col("v.ipt_type"),
            F.col("v.ipt_admit_type_id"),
        ),
    )


_PATIENT_CHECKS = "chwpart amppart sex marrystatus occupation nationality cid pname fname lname".split()


def fdh_pat(t: Tables, p: Params) -> DataFrame:
    """Patient columns with twelve checks, one row per visit or admission."""

    def layout(stays: DataFrame) -> DataFrame:
        rows = link(stays.select("hn").alias("o"), t["patient"], "p", "p.hn = o.hn", "inner")
        full_name = person_name("p", title=False)
        return rows.select(
            *picks("p.hn, p.birthday"),
            *[F.col(f"p.{c}") for c in _PATIENT_CHECKS],
            full_name.alias("ptname"),
            *checks(
                birthday=known("p.birthday"),
                ptname=F.trim(full_name) != "",
                **{c: filled(f"p.{c}") for c in _PATIENT_CHECKS},
            ),
            F.lit(1).alias("idtype"),
        )

    rows = union_branches(
        p, layout(scoped_visits(t, p, "intersect")), layout(scoped_admissions(t, p, "intersect"))
    )
    return rows.withColumn("hcode", hospital_code(t))


# -- outpatient files --------------------------------------------------------


def fdh_opd(t: Tables, p: Params) -> DataFrame:
    """Visits with clinic, vital signs and claim request; fourteen checks."""
    rows = link(scoped_visits(t, p).alias("v"), t["visit_pttype"], "vp", "vp.vn = v.vn")
    rows = link(rows, t["opdscreen"], "sc", "sc.vn = v.vn")
    rows = link(rows, t["ovst_seq"], "sq", "sq.vn = v.vn")
    rows = link(rows, t["er_regist"], "er", "er.vn = v.vn")
    rows = link(rows, t["spclty"], "sp", "sp.spclty = v.spclty")
    return rows.select(
        *picks(
            "v.hn, sp.provis_code, v.vstdate, v.vsttime, v.vn, vp.request_funds, sc.cc, sc.temperature, sc.bps, sc.bpd, "
            "sc.pulse, sc.rr, sq.nhso_fee_schedule_list_text, v.ovstist, er.er_leave_status_id"
        ),
        *checks(
            clinic=filled("sp.provis_code"),
            dateopd=known("v.vstdate"),
            timeopd=known("v.vsttime"),
            seq=known("v.vn"),
            uuc=filled_except("vp.request_funds", "N"),
            detail=filled("sc.cc"),
            btemp=known("sc.temperature"),
            sbp=known("sc.bps"),
            dbp=known("sc.bpd"),
            pr=known("sc.pulse"),
            rr=known("sc.rr"),
            optype=known("sq.nhso_fee_schedule_list_text"),
            typein=known("v.ovstist"),
            typeout=known("er.er_leave_status_id"),
        ),
    )


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says, in two steps so that no array gets long."""
    step = 4096
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr(f"({times} - 1) DIV {step}"))))
    size = F.least(F.lit(step), F.col(times) - F.col("_block") * step)
    return blocks.withColumn("_i", F.explode(F.sequence(F.lit(1), size))).drop("_block", "_i", times)


def _diagnoses(visits: DataFrame, t: Tables, p: Params, match: str) -> DataFrame:
    """Of the visits in the window their own diagnoses, or all of their patients."""
    if match not in ("hn", "vn"):
        raise ValueError(f"unknown match: {match}")
    rows = of_dates(t, "ovstdiag", p) if match == "vn" else t["ovstdiag"]
    return rows.join(visits.select(match), match, "left_semi")


def fdh_orf(t: Tables, p: Params, match: str = "vn") -> DataFrame:
    """Visits referred in or out.

    The file is joined to the visit's diagnoses (``match='vn'``) or, on request, the
    patient's (``'hn'``) without showing any of their columns, so the diagnoses
    only decide how often a row is repeated and are counted, not joined.
    """
    visits = scoped_visits(t, p)
    rows = link(visits.alias("v"), t["referout"], "ro", "ro.vn = v.vn")
    rows = link(rows, t["referin"], "rn", "rn.vn = v.vn").where("ro.vn IS NOT NULL OR rn.vn IS NOT NULL")
    rows = link(rows, t["spclty"], "sp", "sp.spclty = v.spclty")
    diagnoses = _diagnoses(visits, t, p, match).groupBy(match).agg(F.count(F.lit(1)).alias("n"))
    rows = link(rows, diagnoses, "dx", f"dx.{match} = v.{match}")
    rows = rows.select(
        *picks(
            "v.hn, v.vstdate AS dateopd, ro.refer_hospcode, ro.refer_type, ro.referout_type_id, sp.name AS clinic, "
            "rn.vn AS referin, ro.vn AS referout"
        ),
        # an empty clinic code passes: the rule is "not NULL or empty"
        *checks(
            referout_type=known("ro.referout_type_id"),
            clinic=known("sp.provis_code"),
            vn=known("rn.vn") | known("ro.vn"),
        ),
        F.coalesce(F.col("dx.n"), F.lit(1)).alias("_times"),
    )
    return _repeated(rows, "_times")


def fdh_odx(t: Tables, p: Params, match: str = "vn") -> DataFrame:
    """Outpatient diagnoses with four checks.

    A visit is listed with its own diagnoses, which is linear in the data; on request
    (``match='hn'``) with all diagnoses of its patient, visits times diagnoses.
    """
    visits = scoped_visits(t, p).select("vn", "hn", "vstdate", "spclty")
    diagnoses = _diagnoses(visits, t, p, match).select(match, "icd10", "diagtype", "doctor")
    rows = link(with_children(visits, diagnoses, match).alias("v"), t["spclty"], "sp", "sp.spclty = v.spclty")
    if "diagtype" in t:  # shows no column; a type that is listed twice repeats its diagnoses
        rows = link(rows, t["diagtype"].select("diagtype"), "dx", "dx.diagtype = v.diagtype")
    rows = link(rows, t["doctor"], "d", "d.code = v.doctor")
    rows = link(rows, t["patient"], "p", "p.hn = v.hn")
    return rows.select(
        *picks("v.hn, v.vstdate, v.icd10 AS diag, v.spclty, v.diagtype AS dxtype, d.licenseno, p.cid, v.vn"),
        *checks(
            diag=known("v.icd10"),
            clinic=known("sp.provis_code"),
            diagtype=nonempty("v.diagtype"),
            drdx=nonempty("d.licenseno"),
        ),
    )


def fdh_oop(t: Tables, p: Params) -> DataFrame:
    """Outpatient procedures with three checks."""
    rows = link(scoped_visits(t, p).alias("o"), t["doctor_operation"], "r", "r.vn = o.vn", "inner")
    rows = link(rows, t["vn_stat"].select("vn", "hn"), "v", "v.vn = r.vn")
    rows = link(rows, t["spclty"], "sp", "sp.spclty = o.spclty")
    rows = link(rows, t["doctor"], "d", "d.code = r.doctor")
    rows = link(rows, t["patient"], "pt", "pt.hn = o.hn")
    return rows.select(
        *picks(
            "v.hn, o.vstdate AS dateopd, sp.provis_code AS clinic, r.icd9 AS oper, d.licenseno AS dropid, "
            "pt.cid AS person_id, r.vn AS seq"
        ),
        *checks(clinic=known("sp.provis_code"), oper=nonempty("r.icd9"), dropid=nonempty("d.licenseno")),
    )


# -- inpatient files ---------------------------------------------------------


def fdh_irf(t: Tables, p: Params) -> DataFrame:
    """Admissions referred out; the referral tables carry the admission number."""
    rows = link(scoped_admissions(t, p).alias("i"), t["referout"].where("length(vn) > 0"), "r", "r.vn = i.an", "inner")
    rows = link(rows, t["referin"], "rn", "rn.vn = i.an")
    return rows.select(
        *picks("i.an, r.refer_hospcode AS refer, rn.vn AS referin, r.vn AS referout"),
        *checks(refer=nonempty("r.refer_hospcode"), refertype=known("rn.vn") | known("r.vn")),
    )


def admission_rows(admissions: DataFrame, t: Tables) -> DataFrame:
    """Admissions ``i`` with discharge, ward and department names."""
    rows = link(admissions.alias("i"), t["dchstts"], "ds", "ds.dchstts = i.dchstts")
    rows = link(rows, t["dchtype"], "dt", "dt.dchtype = i.dchtype")
    rows = link(rows, t["ward"], "w", "w.ward = i.first_ward")
    return link(rows, t["spclty"], "sp", "sp.spclty = i.spclty")


ADMISSION_COLUMNS = (
    "i.hn, i.an, i.regdate, i.regtime, i.dchdate, i.dchtime, ds.name AS dchstts, dt.name AS dchtype, "
    "w.name AS first_ward, sp.name AS spclty, i.bw"
)


def admission_checks() -> list[Column]:
    return checks(
        dateadm=known("i.regdate"),
        timeadm=known("i.regtime"),
        datedsc=known("i.dchdate"),
        timedsc=known("i.dchtime"),
        dischs=known("i.dchstts"),
        discht=known("i.dchtype"),
        warddsc=known("i.first_ward"),
        dept=known("i.spclty"),
        adm_w=known("i.bw"),
    )


def fdh_ipd(t: Tables, p: Params) -> DataFrame:
    """Admissions with eleven checks."""
    rows = admission_rows(scoped_admissions(t, p), t)
    rows = link(rows, t["ovst"].where("an IS NOT NULL").select("vn", "an"), "v", "v.an = i.an")
    rows = link(rows, t["visit_pttype"], "vp", "vp.vn = v.vn")
    rows = link(rows, t["ipt_type"], "it", "it.ipt_type = i.ipt_type")
    return rows.select(
        *picks(ADMISSION_COLUMNS + ", vp.request_funds, it.ipt_type_name"),
        *admission_checks(),
        *checks(uuc=filled_except("vp.request_funds", "N"), svctype=known("i.ipt_type")),
    )


def operation_rows(t: Tables, p: Params, fund: str) -> DataFrame:
    """Procedures ``op`` of the admissions ``i`` in scope with doctor and type."""
    rows = link(scoped_admissions(t, p, fund=fund).alias("i"), t["iptoprt"], "op", "op.an = i.an", "inner")
    rows = link(rows, t["doctor"], "d", "d.code = op.doctor")
    return link(rows, t["oper_type"], "ot", "ot.oper_type = op.oper_type")


OPERATION_COLUMNS = (
    "ot.name AS oper_type, op.icd9 AS oper, op.opdate AS datein, op.optime AS timein, op.enddate AS dateout, "
    "op.endtime AS timeout, d.licenseno"
)


def operation_checks() -> list[Column]:
    def timed(x: str) -> Column:
        return known(x) & (F.col(x) != MIDNIGHT)

    return checks(
        icd9=filled("op.icd9"),
        datein=known("op.opdate"),
        timein=timed("op.optime"),
        dateout=known("op.enddate"),
        timeout=timed("op.endtime"),
        licenseno=filled("d.licenseno"),
    )


def fdh_iop(t: Tables, p: Params) -> DataFrame:
    """Inpatient procedures with six checks; midnight counts as no time."""
    return operation_rows(t, p, FUND).select(
        day_case_prefix("i.ipt_admit_type_id", "op.an").alias("an"), *picks(OPERATION_COLUMNS), *operation_checks()
    )


def diagnosis_rows(t: Tables, p: Params, fund: str) -> DataFrame:
    """Admissions ``i`` with their diagnoses and doctors; none is a row too."""
    admissions = scoped_admissions(t, p, fund=fund).select("an", "hn", "ipt_admit_type_id")
    diagnoses = t["iptdiag"].select("an", "icd10", "diagtype", "doctor")
    return link(with_children(admissions, diagnoses, "an").alias("i"), t["doctor"], "d", "d.code = i.doctor")


def fdh_idx(t: Tables, p: Params) -> DataFrame:
    """Inpatient diagnoses with three checks."""
    return diagnosis_rows(t, p, FUND).select(
        day_case_prefix("i.ipt_admit_type_id", "i.an").alias("an"),
        *picks("i.icd10 AS diag, i.diagtype AS dxtype, d.licenseno"),
        *checks(diag=known("i.icd10"), diagtype=nonempty("i.diagtype"), licenceno=nonempty("d.licenseno")),
    )


def fdh_lvd(t: Tables, p: Params) -> DataFrame:
    """Home leave per admission; days away as text, 'N' unless positive."""
    rows = link(scoped_admissions(t, p).alias("i"), t["ipt_home_leave"], "h", "h.an = i.an", "inner")
    rows = link(rows, t["patient"], "p", "p.hn = i.hn")
    away = F.datediff("h.reg_date", "h.dch_date")
    return rows.select(
        *picks("h.ipt_home_leave_id AS seglvd, h.dch_date, h.dch_time, h.reg_date, h.reg_time, h.an, p.hn, i.regdate"),
        person_name("p").alias("pt_name"),
        *checks(
            seglvd=known("h.ipt_home_leave_id"),
            dch_date=known("h.dch_date"),
            dch_time=known("h.dch_time"),
            reg_date=known("h.reg_date"),
            reg_time=known("h.reg_time"),
            qty_day=away > 0,
        ),
        F.when(away > 0, away.cast("string")).otherwise("N").alias("qty_day"),
    )


# -- charges -----------------------------------------------------------------


def fdh_cht(t: Tables, p: Params) -> DataFrame:
    """Charge totals of visits and admissions; a paying patient gets code 10."""

    def layout(rows: DataFrame, day: str, an: Column) -> DataFrame:
        self_pay = F.col("s.paidst").isin(*PATIENT_PAYS)
        return rows.select(
            *picks(f"v.hn, {day} AS vstdate, st.income AS total, st.income, st.paid_money AS paid, pt.cid AS person_id"),
            an.alias("an"),
            F.when(self_pay, SELF_PAY_CODE).otherwise(F.col("s.pcode")).alias("pttype"),
            F.when(self_pay, SELF_PAY_LABEL).otherwise(SCHEME_LABEL).alias("check_pttype"),
            *checks(total=known("st.income")),
            F.when(nonempty("v.an"), F.col("v.an")).otherwise(F.col("v.vn")).alias("seq"),
            *constants(opd_memo="", invoice_no="", invoice_lt=""),
        )

    def complete(rows: DataFrame, stat: DataFrame, payers: DataFrame, key: str) -> DataFrame:
        rows = link(rows.alias("v"), stat, "st", f"st.{key} = v.{key}", "inner")
        rows = link(rows, payers.where("pttype_number = '1'"), "vp", f"vp.{key} = v.{key}")
        rows = link(rows, t["pttype"], "s", "s.pttype = vp.pttype")
        return link(rows, t["patient"], "pt", "pt.hn = v.hn", "inner")

    opd = complete(scoped_visits(t, p), t["vn_stat"], t["visit_pttype"], "vn")
    ipd = complete(scoped_admissions(t, p), t["an_stat"], t["ipt_pttype"], "an")
    return union_branches(
        p,
        layout(opd, "v.vstdate", F.lit("")),
        layout(ipd, "v.regdate", day_case_prefix("v.ipt_admit_type_id", "v.an")),
    )


def with_charge_group(rows: DataFrame, t: Tables, income: str) -> DataFrame:
    """Rows with the charge group ``g`` of their income category.

    Two joins rather than one to the two lists joined: the size of a stored
    list is known when the plan is made, that of a join is only guessed.
    """
    rows = link(rows, t["income"], "ic", f"ic.income = {income}")
    return link(rows, t["drg_chrgitem"], "g", "g.drg_chrgitem_id = ic.drg_chrgitem_id")


def with_payer_charges(stays: DataFrame, t: Tables, table: str, key: str) -> DataFrame:
    """Stays ``v`` with what the payer is charged per income category, ``c``.

    Receipts of other stays are dropped first.  That join partitions the rest
    by stay, which serves the sum and the join back as well, and the sum leaves
    a handful of rows per stay however many receipts it has.
    """
    receipts = t[table].where(F.col("paidst") == PAYER_PAYS).select(key, "income", "rcptamt")
    receipts = receipts.join(stays.select(key), key, "left_semi")
    sums = receipts.groupBy(key, "income").agg(money(F.sum("rcptamt")).alias("amount"))
    return link(stays.alias("v"), sums, "c", f"c.{key} = v.{key}")


def fdh_cha(t: Tables, p: Params) -> DataFrame:
    """Payer charge per visit or admission and charge group."""

    def layout(rows: DataFrame, key: str, day: str, ipt_type: Column, admit: Column) -> DataFrame:
        rows = with_charge_group(rows, t, "c.income")
        rows = link(rows, t["pttype"], "s", "s.pttype = v.pttype")
        rows = link(rows, t["patient"], "pt", "pt.hn = v.hn")
        return rows.select(
            *picks(
                f"v.{key} AS vnan, v.hn, pt.pname, pt.fname, pt.lname, v.{day} AS dchdate, pt.cid, s.pcode, "
                "g.chrgitem_code1, c.income AS chrgitem, c.amount"
            ),
            ipt_type.alias("ipt_type"),
            admit.alias("ipt_admit_type_id"),
        )

    nothing = F.lit(None).cast("string")
    opd = with_payer_charges(scoped_visits(t, p), t, "incoth", "vn")
    ipd = with_payer_charges(scoped_admissions(t, p), t, "incith", "an")
    return union_branches(
        p,
        layout(opd, "vn", "vstdate", nothing, nothing),
        layout(ipd, "an", "dchdate", F.col("v.ipt_type"), F.col("v.ipt_admit_type_id")),
    )


def fdh_dru(t: Tables, p: Params) -> DataFrame:
    """Drug lines with eight checks and the patient's and payer's share.

    Lines outside the scope go first; the rest are counted where equal before the
    catalogues are joined.  What a visit adds meets the visits and what an item adds
    meets the lines, so the wide rows are brought together by visit once and grouped
    there.  Visits without any priced line keep one empty row; they share no group
    with the others, since the visit is part of it.
    """
    visits = scoped_visits(t, p).select("vn", "hn", "spclty", "vstdate", F.col("an").alias("visit_an"))
    keys = ["icode", "qty", "unitprice", "cost", "paidst", "doctor"]
    lines = of_dates(t, "opitemrece", p).where((F.col("qty") > 0) & (F.col("sum_price") > 0) & F.col("paidst").isin("01", "02", "03"))
    lines = lines.select("vn", *keys).join(visits.select("vn"), "vn", "left_semi")
    lines = lines.groupBy("vn", *keys).agg(F.count(F.lit(1)).alias("n"))
    # visits without an admission would all meet in one task
    admitted = link(visits.where("visit_an IS NOT NULL").alias("v"), t["ipt"].select("an"), "ip", "ip.an = v.visit_an")
    stays = admitted.select("v.*", "ip.an").unionByName(visits.where("visit_an IS NULL").withColumn("an", F.col("visit_an")))
    stays = link(stays.alias("v"), t["vn_stat"].select("vn", "cid"), "st", "st.vn = v.vn")
    stays = stays.select(*picks("v.vn, v.hn, v.spclty, v.vstdate, v.an, st.cid"))
    rows = link(lines.alias("op"), t["ovst_presc_ned"], "ned", "ned.vn = op.vn AND ned.icode = op.icode AND ned.doctor = op.doctor")
    rows = link(rows, t["drugitems"], "di", "di.icode = op.icode")
    item = ["did", "name", "strength", "units", "tmt_tp_code", "packqty"]
    rows = rows.select(
        *picks("op.vn, op.n, op.qty, op.unitprice, op.cost, op.paidst, op.doctor, ned.presc_reason, ned.nhso_authorize_code"),
        *[F.col(f"di.{c}") for c in item],
    )
    blank = F.lit(" ")
    value = F.col("n") * F.col("qty") * F.col("unitprice")

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("decimal(18,4)")

    # group by what the file shows of a line; the item code is not part of it
    shown = ["hn", "an", "vn", "spclty", "cid", "vstdate", *item, "qty", "unitprice", "cost", "presc_reason", "nhso_authorize_code", "paidst", "doctor"]
    totals = share(F.col("paidst").isin(*PATIENT_PAYS)).alias("totcopay"), share(F.col("paidst") == PAYER_PAYS).alias("total")
    priced = stays.join(rows, "vn").groupBy(*shown).agg(*totals)
    empty = stays.join(lines.select("vn"), "vn", "left_anti")
    empty = empty.unionByName(rows.where(F.lit(False)), allowMissingColumns=True).groupBy(*shown).agg(*totals)
    grouped = priced.unionByName(empty)
    return grouped.select(
        *picks(
            "hn, an, vn, spclty AS clinic, cid AS person_id, vstdate AS date_serv, did, qty AS amount, unitprice AS drugprice, "
            "cost AS drugcost, tmt_tp_code AS didstd, units AS unit, vn AS seq, presc_reason AS drugremark, "
            "nhso_authorize_code AS pa_no, paidst AS use_status, totcopay, total, doctor AS provider"
        ),
        F.trim(join_text(F.col("name"), blank, F.col("strength"), blank, F.col("units"))).alias("didname"),
        join_text(F.col("packqty").cast("string"), F.lit("x"), F.col("units")).alias("unit_pack"),
        *checks(
            did=known("did"),
            amount=known("qty"),
            drugprice=known("unitprice"),
            drugcost=known("cost"),
            didstd=known("tmt_tp_code"),
            unit=known("units"),
            drugremark=known("presc_reason"),
            use_status=known("paidst"),
        ),
    ).withColumn("hcode", hospital_code(t))


def fdh_labfu(t: Tables, p: Params) -> DataFrame:
    """Lab results with five checks; a visit without a test is a row too."""
    visits = scoped_visits(t, p).select("vn", "hn", "vstdate")
    heads = children_of(visits, t, "lab_head", p)
    tests = link(heads.alias("h"), t["lab_order"], "lo", "lo.lab_order_number = h.lab_order_number").select(
        *picks("h.vn, lo.lab_items_code, lo.lab_order_result")
    )
    rows = link(with_children(visits, tests, "vn").alias("v"), t["lab_items"], "li", "li.lab_items_code = v.lab_items_code")
    rows = link(rows, t["sys_lab_link"], "k", "k.lab_items_code = li.lab_items_code")
    rows = link(rows, t["patient"], "p", "p.hn = v.hn", "inner")
    return rows.select(
        *picks("p.hn, p.cid, v.vstdate, v.vn, k.sys_lab_code_id, v.lab_order_result"),
        *checks(
            person_id=filled("p.cid"),
            dateopd=known("v.vstdate"),
            seq=known("v.vn"),
            labtest=known("k.sys_lab_code_id"),
            labresult=known("v.lab_order_result"),
        ),
    ).withColumn("hcode", hospital_code(t))


def fdh_phdb(t: Tables, p: Params) -> DataFrame:
    """Public-health items of visits and admissions with four checks."""
    def layout(stays: DataFrame, charges: DataFrame, key: str, source: str) -> DataFrame:
        lines = charges.join(stays.select(key), key, "left_semi").where((F.col("qty") > 0) & (F.col("sum_price") > 0)).select(
            key, "icode", "qty", "unitprice", F.col("pttype").alias("line_pttype")
        )
        rows = link(with_children(stays, lines, key).alias("v"), t["nondrugitems"], "di", "di.icode = v.icode")
        rows = link(rows, t["pttype"], "s", "s.pttype = v.line_pttype")
        rows = link(rows, t["patient"], "pt", "pt.hn = v.hn")
        return rows.select(
            *picks(
                "v.service_date, v.regdate, v.dchdate, v.hn, v.an, v.vn, di.income_phdb_code, v.qty, v.unitprice, s.hipdata_code"
            ),
            person_name("pt").alias("pt_name"),
            *checks(
                income_phdb_code=known("di.income_phdb_code"),
                qty=F.col("v.qty") > 0,
                unitprice=F.col("v.unitprice") > 0,
                hipdata_code=known("s.hipdata_code"),
            ),
            F.lit(source).alias("source_type"),
        )

    no_date = F.lit(None).cast("date")
    visits = scoped_visits(t, p).select(
        "vn", "hn", F.lit(None).cast("string").alias("an"), F.col("vstdate").alias("service_date"),
        no_date.alias("regdate"), no_date.alias("dchdate"),
    )
    admissions = scoped_admissions(t, p).select("an", "vn", "hn", no_date.alias("service_date"), "regdate", "dchdate")
    return union_branches(
        p,
        layout(visits, of_dates(t, "opitemrece", p), "vn", "OPD"),
        layout(admissions, t["opitemrece"], "an", "IPD"),
    )
