"""Outpatient claim files: billing, items, services, dispensing, diagnoses."""

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
from claimlens.functions.numbering import durable
from claimlens.operators.fdh import with_charge_group
from claimlens.operators.scope import (
    PAYER_PAYS,
    children_of,
    date_window,
    fund_filter,
    hospital_code,
    keep_billed,
    link,
    of_dates,
    payer_scope,
    with_children,
)
from claimlens.params import Params
from claimlens.sources.tables import Tables

# Service class by income category; any other category is ZZ.
SERVICE_CLASS = {"11": "OP", "12": "EC", "07": "LB", "08": "XR", "09": "IV"}
MAIN_DIAGNOSIS = "1"


def visit_list(t: Tables, p: Params) -> DataFrame:
    """Patient name, date, amount and status of the visits in the window."""
    rows = link(t["ovst"].where(date_window("vstdate", p)).alias("ov"), t["patient"], "p", "p.hn = ov.hn")
    rows = rows.select(
        *picks("ov.hn, ov.vn, ov.vstdate AS visit_date, ov.income AS amount, ov.status"),
        person_name("p").alias("patient_name"),
    )
    return rows


def _visits(t: Tables, p: Params, fund: str, *columns: str) -> DataFrame:
    """Visits in the window and payer scope that have a line billed to the payer, with ``vn`` and the columns named.

    Kept on disk: several tables are cut to them, and each would otherwise find the billed
    visits again, side by side in the same task.
    """
    visits = t["ovst"].where(date_window("vstdate", p))
    return durable(keep_billed(payer_scope(visits, "pttype", t, p, "override", fund), "vn", t, p).select("vn", *columns))


# -- billing transactions ----------------------------------------------------


def _billed_payers(t: Tables, p: Params) -> DataFrame:
    visits = keep_billed(t["ovst"].where(date_window("vstdate", p)), "vn", t, p).select("vn", "hn", "vstdate")
    payers = payer_scope(t["visit_pttype"], "pttype", t, p, "intersect", "SSS")
    return visits.join(payers.select("vn", "pttype", "pttypeno", "auth_code", "hospmain"), "vn")


def billtran(t: Tables, p: Params, ssop: bool = False) -> DataFrame:
    """One row per visit, payer row, receipt and debt.

    The civil-servant layout verifies by approval code; the social-security one
    by citizen number, and also checks the main hospital.  A fund code stands
    for its scheme groups here as everywhere else.
    """
    debts = t["rcpt_debt"].where("total_amount > 0")
    debts = debts.select("vn", "debt_id", "debt_date_time", "amount", "total_amount", "sss_approval_code")
    rows = with_children(_billed_payers(t, p), debts, "vn").alias("v")
    rows = link(rows, t["rcpt_print"], "rc", "rc.vn = v.vn")
    rows = link(rows, t["pttype"].where(fund_filter(p.fund or "SSS")), "s", "s.pttype = v.pttype")
    rows = link(rows, t["pttype_upp_type"], "plan", "plan.pttype_upp_type_id = s.pttype_upp_type_id")
    rows = link(rows, t["patient"], "p", "p.hn = v.hn")
    vercode = "p.cid" if ssop else "v.sss_approval_code"
    flags = {"invno": known("v.debt_id"), "vercode": filled(vercode)}
    if ssop:
        flags["hmain"] = filled("v.hospmain")
    out = rows.select(
        *picks(
            "v.debt_id, v.vstdate, v.vn, v.auth_code AS authcode, v.debt_date_time AS dttran, "
            "v.debt_id AS invno, rc.rcpno AS billno, p.hn, p.cid AS memberno, v.amount, rc.bill_amount AS paid, "
            "p.cid AS pid, v.hospmain AS hmain, plan.pttype_upp_type_code AS payplan, v.total_amount AS claimamt"
        ),
        F.col(vercode).alias("vercode"),
        person_name("p").alias("name"),
        *checks(**flags),
        *constants(tflag="A", otherpayplan=None, otherpay=None),
        # tell rows apart although the file does not show them
        *picks("v.pttypeno AS _payer_no, v.sss_approval_code AS _approval"),
    )
    out = out.dropDuplicates().drop("_payer_no", "_approval")
    return out.withColumn("hcode", hospital_code(t))


def billtran_ssop(t: Tables, p: Params) -> DataFrame:
    return billtran(t, p, ssop=True)


def billtran_funnel(t: Tables, p: Params) -> DataFrame:
    """Row counts after each condition of the billing file, in one row.

    Debts are counted per visit before they meet the payer rows, so the last
    count needs no row per debt.
    """
    visits = t["ovst"].where(date_window("vstdate", p))
    lines = t["opitemrece"].where(date_window("vstdate", p) & (F.col("paidst") == PAYER_PAYS))
    payers = payer_scope(t["visit_pttype"], "pttype", t, p, "intersect", "SSS")
    debts = children_of(visits, t, "rcpt_debt", p).where("total_amount > 0").groupBy("vn").agg(F.count(F.lit(1)).alias("n"))
    billed = lines.select("vn").distinct()
    rows = link(visits.alias("ov"), payers, "vp", "vp.vn = ov.vn", "inner")
    rows = link(rows, billed, "b", "b.vn = ov.vn")
    rows = link(rows, debts, "d", "d.vn = ov.vn")
    is_billed = known("b.vn")

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("bigint")

    counts = rows.agg(
        F.count(F.lit(1)).alias("ovst_pttype_count"),
        total(is_billed.cast("int")).alias("after_paidst_filter"),
        total(F.when(is_billed, F.coalesce(F.col("d.n"), F.lit(0))).otherwise(0)).alias("after_total_amount_filter"),
    )
    count = F.count(F.lit(1))
    return counts.withColumns(
        {"ovst_count": visits.agg(count).scalar(), "opitemrece_paid_count": lines.agg(count).scalar()}
    )


# -- charge lines ------------------------------------------------------------


def billitems(t: Tables, p: Params) -> DataFrame:
    """One row per visit, distinct charge line and debt detail, with eight checks.

    Every visit in scope has a charge line, so the join to the lines is inner
    and a visit with very many lines can be split.  Duplicate lines are removed
    while the rows are still partitioned by visit and narrow.
    """
    line_columns = ["icode", "income", "qty", "unitprice", "sum_price", "paidst"]
    visits = _visits(t, p, "SSS", "hn", "vstdate")
    lines = link(visits.alias("ov"), of_dates(t, "opitemrece", p), "op", "op.vn = ov.vn", "inner").select(*picks("ov.vn, ov.hn, ov.vstdate"), *[F.col(f"op.{c}") for c in line_columns])
    lines = lines.dropDuplicates()
    debts = children_of(visits, t, "rcpt_debt", p).select("vn", "debt_id")
    debts = link(debts.alias("rd"), t["rcpt_debt_detail"], "x", "x.debt_id = rd.debt_id")
    debts = debts.select(*picks("rd.vn, rd.debt_id, x.total_amount")).dropDuplicates()
    rows = link(lines.alias("op"), debts, "rd", "rd.vn = op.vn")
    rows = link(rows, t["nondrugitems"], "n", "n.icode = op.icode")
    rows = link(rows, t["drugitems"], "dr", "dr.icode = op.icode")
    rows = link(rows, t["drugitems_sks"], "ds", "ds.icode = dr.icode")
    rows = with_charge_group(rows, t, "op.income")
    rows = link(rows, t["patient"], "p", "p.hn = op.hn")

    is_drug = F.col("op.income") == "03"
    covered, drug_price = F.col("n.sks_coverage_price"), F.col("dr.sks_price")
    switch, listed = F.col("n.enable_sks_opd"), known("ds.icode")
    switched_off = switch.isNull() | switch.isin("N", "")
    # Any price without its switch fails; with the switch a price below 1 fails.
    wrong_claim = (
        (covered.isNotNull() & switched_off)
        | (drug_price.isNotNull() & ~listed)
        | ((covered < 1) & switch.isNotNull())
        | ((drug_price < 1) & listed)
    )
    blank = F.lit(" ")
    out = rows.select(
        *picks(
            "op.hn, op.vn, rd.debt_id AS invno, op.vstdate, op.icode, op.qty, op.unitprice AS up, "
            "op.sum_price AS chargeamt, ds.icode AS ds_icode, op.vn AS svrefid"
        ),
        person_name("p").alias("ptname"),
        F.substring("g.chrgitem_code1", 1, 1).alias("billmuad"),
        F.when(is_drug, F.col("dr.sks_drug_code")).otherwise(F.col("n.billcode")).alias("stdcode"),
        F.when(is_drug, join_text(F.col("dr.name"), blank, F.col("dr.strength"), blank, F.col("dr.units")))
        .otherwise(F.col("n.name"))
        .alias("desc"),
        F.when(F.col("op.income").isin("03", "17"), drug_price).otherwise(covered).alias("claimup"),
        product("op.qty", "op.unitprice").alias("claimamount"),
        *checks(
            debt_id=known("rd.debt_id"),
            billmuad=known("g.chrgitem_code1"),
            stdcode=known("dr.sks_drug_code") | known("n.billcode"),
            qty=known("op.qty"),
            up=known("op.unitprice"),
            chargeamt=known("op.sum_price"),
            claimup=known(drug_price) | known(covered),
        ),
        F.when(wrong_claim, "N").otherwise("Y").alias("check_claimamount"),
        yn(listed | (switch == "Y")).alias("enable_sks_opd"),
        *constants(claimcat="OP1"),
    )
    return out


def visit_expenses(t: Tables, p: Params) -> DataFrame:
    """Charge lines with item name and unit, for all visits in the window."""
    lines = t["opitemrece"].where(date_window("vstdate", p))
    rows = link(lines.alias("op"), t["s_drugitems"], "s", "s.icode = op.icode")
    rows = link(rows, t["nondrugitems"].where("icode LIKE '3%'"), "n", "n.icode = op.icode")
    return rows.select(
        *picks("op.vn, op.icode, op.qty, op.sum_price"),
        join_text(F.col("s.name"), F.lit(" "), F.col("s.strength")).alias("items"),
        F.coalesce("n.unit", "s.units").alias("unit"),
    )


# -- services ----------------------------------------------------------------


def _main_diagnosis(visits: DataFrame, t: Tables, p: Params) -> DataFrame:
    """Per visit: how many main diagnoses, the largest licence, any code given."""
    main = children_of(visits, t, "ovstdiag", p).where(F.col("diagtype") == MAIN_DIAGNOSIS)
    rows = link(main.alias("di"), t["doctor"], "d", "d.code = di.doctor")
    return rows.groupBy(F.col("di.vn").alias("vn")).agg(
        F.count(F.lit(1)).alias("n_diag"),
        F.max("d.licenseno").alias("licenseno"),
        F.max(F.when(filled("di.icd10"), "TT").otherwise("")).alias("codeset"),
    )


def opservice(t: Tables, p: Params) -> DataFrame:
    """One row per visit and bill code: service class, licence, appointment, six checks.

    All measures are maxima, so charge lines, diagnoses and debts are each
    reduced per visit first instead of being multiplied with one another.
    """
    visits = _visits(t, p, "SSS", "hn", "vstdate", "vsttime", "ovstist", "ovstost", "spclty")
    lines = of_dates(t, "opitemrece", p).select("vn", "icode")
    lines = link(visits.select("vn").alias("ov"), lines, "oi", "oi.vn = ov.vn", "inner")
    lines = link(lines, t["nondrugitems"], "n", "n.icode = oi.icode")
    service = F.lit("ZZ")
    for income, name in SERVICE_CLASS.items():
        service = F.when(F.col("n.income") == income, name).otherwise(service)
    services = lines.groupBy(F.col("ov.vn").alias("vn"), F.col("n.billcode").alias("billcode")).agg(
        F.max(service).alias("class")
    )
    debts = children_of(visits, t, "rcpt_debt", p).groupBy("vn").agg(F.max("debt_id").alias("debt_id"))
    appointments = children_of(visits, t, "oapp", p).select("vn", "nextdate").dropDuplicates()

    rows = link(visits.alias("ov"), services, "sv", "sv.vn = ov.vn", "inner")
    rows = link(rows, debts, "rc", "rc.vn = ov.vn")
    rows = link(rows, _main_diagnosis(visits, t, p), "di", "di.vn = ov.vn")
    rows = link(rows, appointments, "oa", "oa.vn = ov.vn")
    rows = link(rows, t["ovstist"], "ti", "ti.ovstist = ov.ovstist")
    rows = link(rows, t["ovstost"], "to", "to.ovstost = ov.ovstost")
    rows = link(rows, t["spclty"], "s", "s.spclty = ov.spclty")
    rows = link(rows, t["patient"], "pa", "pa.hn = ov.hn")
    codeset = F.coalesce(F.col("di.codeset"), F.lit(""))
    return rows.select(
        *picks(
            "ov.vstdate, ov.vn, rc.debt_id AS invno, ov.vn AS svid, sv.class, pa.hn, pa.cid AS pid, "
            "ti.export_code AS typein, to.export_code AS typeout, oa.nextdate AS dtappoint, "
            "di.licenseno AS svpid, s.nhso_code AS clinic, sv.billcode AS lccode, sv.billcode AS stdcode"
        ),
        person_name("pa").alias("name"),
        join_text(F.col("ov.vstdate").cast("string"), F.lit(" "), F.col("ov.vsttime")).alias("begdt"),
        codeset.alias("codeset"),
        *checks(
            invno=known("rc.debt_id"),
            typein=known("ti.export_code"),
            typeout=known("to.export_code"),
            svpid=known("di.licenseno"),
            codeset=codeset == "TT",
            stdcode=known("sv.billcode"),
        ),
        yn(known("oa.nextdate")).alias("completion"),
        *constants(careaccount="1", typeserv=None, enddt=None, svcharge=None, svtxcode=None, claimcat="OPD1"),
    ).withColumn("hcode", hospital_code(t))


# -- dispensing --------------------------------------------------------------

_DISPENSE = ["dose", "unit_name", "frequency_code", "usage_unit_code"]


def _dispensed_lines(t: Tables, p: Params, fund: str, dispense_columns: list[str]) -> DataFrame:
    """Distinct charge lines of the visits in scope with their number ``n``.

    Everything the catalogues add depends on item and usage code, so equal
    lines are counted before any catalogue is joined.
    """
    lines = t["opitemrece"].where(date_window("vstdate", p))
    visits = payer_scope(t["ovst"], "pttype", t, p, "override", fund)
    visits = keep_billed(visits, "vn", t, p).select("vn")
    rows = link(lines.alias("op"), visits, "ov", "ov.vn = op.vn", "inner")
    rows = link(rows, t["opi_dispense"], "od", "od.hos_guid = op.hos_guid")
    keys = picks("op.vn, op.icode, op.qty, op.drugusage, op.vstdate, op.sum_price, op.unitprice")
    return rows.groupBy(*keys, *[F.col(f"od.{c}") for c in dispense_columns]).agg(F.count(F.lit(1)).alias("n"))


def _with_item_catalogues(lines: DataFrame, t: Tables) -> DataFrame:
    rows = link(lines.alias("op"), t["nondrugitems"], "no", "no.icode = op.icode")
    rows = link(rows, t["drugitems"], "di", "di.icode = op.icode")
    return link(rows, t["drugusage"], "ds", "ds.drugusage = op.drugusage")


def _reimbursed() -> Column:
    return (F.col("op.n") * F.col("op.qty") * F.col("di.sks_reimb_price")).cast("decimal(18,4)")


def dispenseditem(t: Tables, p: Params) -> DataFrame:
    """Dispensed items with twelve presence checks and the reimbursable amount."""
    lines = _dispensed_lines(t, p, "SSS", ["opi_dispense_id", *_DISPENSE])
    out = _with_item_catalogues(lines, t).select(
        *picks(
            "op.opi_dispense_id, op.vn, op.icode, op.qty, op.drugusage, op.vstdate, op.sum_price, "
            "no.sks_product_category_id, di.icode AS icode1, di.sks_drug_code, di.units, ds.shortlist, "
            "ds.drugusage AS drugusage1, op.unitprice AS unitprice1, di.sks_reimb_price"
        ),
        *checks(
            opi_dispense_id=known("op.opi_dispense_id"),
            icode=known("op.icode"),
            qty=known("op.qty"),
            drugusaged=filled("op.drugusage"),
            sum_price=known("op.sum_price"),
            icode1=known("di.icode"),
            sks_drug_code=known("di.sks_drug_code"),
            units=known("di.units"),
            shortlist=known("ds.shortlist"),
            drugusage=known("ds.drugusage"),
            unitprice=known("op.unitprice"),
            sks_reimb_price=known("di.sks_reimb_price"),
        ),
        _reimbursed().alias("reimbamt"),
        *constants(
            prdsecode="prdSeCode", claimcout="claimcout", claimcat="claimcat", multidisp="multiDisp", supplyfor="supplyfor"
        ),
    )
    return out


def dispenseditem_csop(t: Tables, p: Params, fund: str = "OFC") -> DataFrame:
    """Dispensed items in the civil-servant layout: codes and prices by item prefix."""
    rows = _with_item_catalogues(_dispensed_lines(t, p, fund, _DISPENSE), t)
    is_drug, is_other = F.col("op.icode").startswith("1"), F.col("op.icode").startswith("3")
    no_usage = ~filled("op.drugusage")

    def by_prefix(drug: str, other: str) -> Column:
        return F.when(is_drug, F.col(drug)).when(is_other, F.col(other))

    out = rows.select(
        *picks(
            "op.vstdate, op.vn AS dispid, op.icode AS hospdrgid, di.sks_dfs_code AS dfscode, di.sks_dfs_text AS dfstext, "
            "di.packqty AS packsize, op.drugusage AS sigcode, ds.shortlist AS sigtext, op.qty AS quantity, op.unitprice, "
            "op.sum_price AS chargeamt"
        ),
        by_prefix("di.sks_product_category_id", "no.sks_product_category_id").alias("prdcat"),
        by_prefix("di.sks_drug_code", "no.billcode").alias("drgid"),
        by_prefix("di.sks_reimb_price", "no.sks_coverage_price").alias("reimbprice"),
        *checks(
            prdcat=known("di.sks_product_category_id") | known("no.sks_product_category_id"),
            drgid=known("di.sks_drug_code") | known("no.billcode"),
            quantity=known("op.qty"),
            unitprice=known("op.unitprice"),
            chargeamt=known("op.sum_price"),
            reimbprice=(is_drug & known("di.sks_reimb_price")) | (is_other & known("no.sks_coverage_price")),
        ),
        F.when(is_drug & no_usage, "N").otherwise("Y").alias("check_sigcode"),
        F.when(F.col("ds.shortlist").startswith("1") & no_usage, "N").otherwise("Y").alias("check_sigtext"),
        _reimbursed().alias("reimbamt"),
        *constants(prdsecode="0", claimcont="OD", claimcat="OP1", multidisp=None, supplyfor=None),
    )
    return out


def dispenseditem_ssop(t: Tables, p: Params) -> DataFrame:
    return dispenseditem_csop(t, p, fund="SSS")


def dispensing(t: Tables, p: Params, plan: str = "CS", fanout: str = "reference") -> DataFrame:
    """Per visit and paid state: item count, sum of unit prices, prescriber, invoice.

    ``fanout='reference'`` counts a line once per main diagnosis and per debt,
    as joining the three tables would.  The three factors are computed apart
    and multiplied, so no such product is ever built.  ``'per_visit'`` counts
    each line once.
    """
    if fanout not in ("reference", "per_visit"):
        raise ValueError(f"unknown fanout: {fanout}")
    visits = _visits(t, p, "SSS", "hn", "vstdate")
    lines = children_of(visits, t, "opitemrece", p).groupBy("vn").agg(
        F.count("icode").alias("n_items"), F.sum("unitprice").alias("unit_prices")
    )
    debts = children_of(visits, t, "rcpt_debt", p).groupBy("vn", "paid").agg(
        F.count(F.lit(1)).alias("n_debt"), F.max("debt_id").alias("debt_id")
    )
    rows = link(visits.alias("ov"), lines, "oi", "oi.vn = ov.vn", "inner")
    rows = link(rows, debts, "rc", "rc.vn = ov.vn")
    rows = link(rows, _main_diagnosis(visits, t, p), "di", "di.vn = ov.vn")
    rows = link(rows, t["patient"], "pa", "pa.hn = ov.hn")
    times = F.lit(1)
    if fanout == "reference":
        one = F.lit(1)
        times = F.coalesce(F.col("rc.n_debt"), one) * F.coalesce(F.col("di.n_diag"), one)
    return rows.select(
        *picks("ov.vstdate, ov.vn AS dispid, rc.debt_id AS invno, pa.hn, pa.cid AS pid, di.licenseno AS prescb, rc.paid, ov.vn AS svid"),
        person_name("pa").alias("name"),
        (F.col("oi.n_items") * times).cast("bigint").alias("itemcnt"),
        money(F.col("oi.unit_prices") * times).alias("chargeamt"),
        *checks(invno=known("rc.debt_id")),
        *constants(
            dispdt=None, claimamt=None, otherpay=None, reimburser="HP", benefitplan=plan, dispestat="1", daycover=None
        ),
    ).withColumn("providerid", hospital_code(t))


def dispensing_ssop(t: Tables, p: Params, fanout: str = "reference") -> DataFrame:
    return dispensing(t, p, plan="SS", fanout=fanout)


# -- diagnoses ---------------------------------------------------------------


def _visits_with_operation(visits: DataFrame, t: Tables, p: Params) -> DataFrame:
    return children_of(visits, t, "doctor_operation", p).where(filled("icd9")).select("vn").distinct()


def _visits_with_lab_code(visits: DataFrame, t: Tables, p: Params) -> DataFrame:
    """Visits charged for a service that is a lab item with a national test code."""
    services = t["lab_items"].where(filled("tmlt_code")).select("icode").distinct()
    services = services.join(t["nondrugitems"].select("icode"), "icode", "left_semi")
    return children_of(visits, t, "opitemrece", p).join(services, "icode", "left_semi").select("vn").distinct()


def opdx(t: Tables, p: Params) -> DataFrame:
    """Diagnoses per visit: class, rank, and code set by priority IN, LC, TT."""
    visits = _visits(t, p, "SSS", "hn", "vstdate")
    diagnoses = children_of(visits, t, "ovstdiag", p).select("vn", F.lit(True).alias("has_diagnosis"), "icd10", "diagtype")
    rows = with_children(visits, diagnoses, "vn").alias("di")
    rows = link(rows, _visits_with_operation(visits, t, p), "o", "o.vn = di.vn AND di.has_diagnosis")
    rows = link(rows, _visits_with_lab_code(visits, t, p), "l", "l.vn = di.vn")
    rows = link(rows, t["icd101"], "i", "i.code = di.icd10")
    rows = link(rows, t["patient"], "pt", "pt.hn = di.hn")
    operated, tested, coded = known("o.vn"), known("l.vn"), filled("di.icd10")
    rank = F.col("di.diagtype")
    return rows.select(
        *picks("di.hn, di.vn, di.vstdate AS vsdate, di.vn AS svid, di.icd10 AS code, i.name AS desc"),
        person_name("pt").alias("name"),
        F.when(F.col("di.icd10").between("0", "99999"), "OP").otherwise("EC").alias("class"),
        F.when(rank.isin("1", "2", "3", "4"), rank).otherwise("N").alias("sl"),
        F.when(operated, "IN").when(tested, "LC").when(coded, "TT").otherwise("").alias("codeset"),
        F.when(operated | tested | coded, "Y").otherwise("").alias("check_codeset"),
        *checks(**{"class": known("di.icd10")}, sl=known("di.diagtype"), code=known("di.icd10")),
    )


def visit_statistics(t: Tables, p: Params) -> DataFrame:
    """Number of visits in the window and payer scope; the other two counts are fixed."""
    visits = payer_scope(t["ovst"].where(date_window("vstdate", p)), "pttype", t, p, "override", "SSS")
    zero = F.lit(0).cast("bigint")
    return visits.agg(F.count("vn").alias("total")).withColumns({"passed": zero, "needfix": zero})
