"""SQL for the outpatient files, joined first and grouped afterwards."""

from claimlens.plans.sqltext import BILLED, FROM_TO, HOSPITAL, codes, flags, has, name_of, nothing, scope, text, yn
from claimlens.operators.scope import fund_groups


def _billtran(fund: str, ssop: bool) -> str:
    ver = "p.cid" if ssop else "d.sss_approval_code"
    main = f", {flags(hmain=text('v.hospmain'))}" if ssop else ""
    return f"""
WITH base AS (
  SELECT o.vn, o.hn, o.vstdate, v.auth_code, v.hospmain, v.pttype, v.pttypeno
  FROM ovst o JOIN visit_pttype v ON v.vn = o.vn
  WHERE o.vstdate {FROM_TO} AND v.pttype IN {scope(fund)} AND o.vn IN {BILLED}),
plans AS (
  SELECT s.pttype, u.pttype_upp_type_code AS payplan FROM pttype s
  LEFT JOIN pttype_upp_type u ON u.pttype_upp_type_id = s.pttype_upp_type_id
  WHERE s.hipdata_code IN {codes(fund_groups(fund))})
SELECT * EXCLUDE (pttypeno, sss_approval_code) FROM (
SELECT DISTINCT d.debt_id, v.vstdate, v.vn, v.auth_code AS authcode, d.debt_date_time AS dttran,
  {HOSPITAL} AS hcode, d.debt_id AS invno, r.rcpno AS billno, p.hn, p.cid AS memberno, d.amount,
  r.bill_amount AS paid, {ver} AS vercode, 'A' AS tflag, p.cid AS pid, {name_of('p')} AS name,
  v.hospmain AS hmain, plans.payplan, d.total_amount AS claimamt, {nothing('otherpayplan', 'otherpay')},
  {flags(invno=has('d.debt_id'), vercode=text(ver))}{main}, v.pttypeno, d.sss_approval_code
FROM base v
LEFT JOIN patient p ON p.hn = v.hn
LEFT JOIN rcpt_print r ON r.vn = v.vn
LEFT JOIN (SELECT * FROM rcpt_debt WHERE total_amount > 0) d ON d.vn = v.vn
LEFT JOIN plans ON plans.pttype = v.pttype)"""


def _in_scope(fund: str) -> str:
    return f"SELECT * FROM ovst WHERE vstdate {FROM_TO} AND pttype IN {scope(fund)} AND vn IN {BILLED}"


def _dispensing(fund: str, plan: str) -> str:
    return f"""
WITH v AS ({_in_scope(fund)})
SELECT v.vstdate, v.vn AS dispid, v.vn AS svid, {name_of('p')} AS name, {HOSPITAL} AS providerid,
  max(d.debt_id) AS invno, {yn('max(d.debt_id) IS NOT NULL')} AS check_invno, p.hn, p.cid AS pid,
  max(m.licenseno) AS prescb, count(l.icode) AS itemcnt, CAST(sum(l.unitprice) AS DECIMAL(18,2)) AS chargeamt,
  d.paid, 'HP' AS reimburser, '{plan}' AS benefitplan, '1' AS dispestat,
  {nothing('dispdt', 'claimamt', 'otherpay', 'daycover')}
FROM v LEFT JOIN patient p ON p.hn = v.hn
LEFT JOIN rcpt_debt d ON d.vn = v.vn
LEFT JOIN opitemrece l ON l.vn = v.vn
LEFT JOIN ovstdiag g ON g.vn = v.vn AND g.diagtype = '1'
LEFT JOIN doctor m ON m.code = g.doctor
GROUP BY v.vn, v.vstdate, p.pname, p.fname, p.lname, p.hn, p.cid, d.paid"""


def _csop_items(fund: str) -> str:
    drug, other = "l.icode LIKE '1%'", "l.icode LIKE '3%'"
    unused = "(l.drugusage IS NULL OR l.drugusage = '')"

    def either(a: str, b: str) -> str:
        return f"CASE WHEN {drug} THEN {a} WHEN {other} THEN {b} END"

    return f"""
WITH l AS (
  SELECT x.*, od.dose, od.unit_name, od.frequency_code, od.usage_unit_code
  FROM opitemrece x JOIN ovst v ON v.vn = x.vn LEFT JOIN opi_dispense od ON od.hos_guid = x.hos_guid
  WHERE x.vstdate {FROM_TO} AND v.pttype IN {scope(fund)} AND v.vn IN {BILLED})
SELECT * EXCLUDE (dose, unit_name, frequency_code, usage_unit_code, drug_icode, sks_drug_code, units, known_usage,
  other_cat, billcode, sks_coverage_price, sks_reimb_price)
FROM (
SELECT l.vstdate, l.vn AS dispid, {either('g.sks_product_category_id', 'n.sks_product_category_id')} AS prdcat,
  l.icode AS hospdrgid, {either('g.sks_drug_code', 'n.billcode')} AS drgid, g.sks_dfs_code AS dfscode,
  g.sks_dfs_text AS dfstext, g.packqty AS packsize, l.drugusage AS sigcode, u.shortlist AS sigtext,
  l.qty AS quantity, l.unitprice, l.sum_price AS chargeamt,
  {either('g.sks_reimb_price', 'n.sks_coverage_price')} AS reimbprice,
  {flags(prdcat='coalesce(g.sks_product_category_id, n.sks_product_category_id) IS NOT NULL',
         drgid='coalesce(g.sks_drug_code, n.billcode) IS NOT NULL',
         quantity=has('l.qty'), unitprice=has('l.unitprice'), chargeamt=has('l.sum_price'),
         reimbprice=f"({drug} AND g.sks_reimb_price IS NOT NULL) OR ({other} AND n.sks_coverage_price IS NOT NULL)")},
  CASE WHEN {drug} AND {unused} THEN 'N' ELSE 'Y' END AS check_sigcode,
  CASE WHEN u.shortlist LIKE '1%' AND {unused} THEN 'N' ELSE 'Y' END AS check_sigtext,
  CAST(sum(l.qty * g.sks_reimb_price) AS DECIMAL(18,4)) AS reimbamt,
  '0' AS prdsecode, 'OD' AS claimcont, 'OP1' AS claimcat, {nothing('multidisp', 'supplyfor')}, l.dose, l.unit_name, l.frequency_code, l.usage_unit_code,
  g.icode AS drug_icode, g.sks_drug_code, g.units, u.drugusage AS known_usage, n.sks_product_category_id AS other_cat,
  n.billcode, n.sks_coverage_price, g.sks_reimb_price
FROM l LEFT JOIN nondrugitems n ON n.icode = l.icode LEFT JOIN drugitems g ON g.icode = l.icode
LEFT JOIN drugusage u ON u.drugusage = l.drugusage
GROUP BY ALL)"""



SQL = {
    "visit_list": f"""
SELECT o.hn, o.vn, o.vstdate AS visit_date, o.income AS amount, o.status, {name_of('p')} AS patient_name
FROM ovst o LEFT JOIN patient p ON p.hn = o.hn WHERE o.vstdate {FROM_TO}""",
    "billtran": _billtran("SSS", False),
    "billtran_csop": _billtran("OFC", False),
    "billtran_ssop": _billtran("SSS", True),
    "billtran_funnel": f"""
WITH paid AS (SELECT o.vn FROM ovst o JOIN visit_pttype v ON v.vn = o.vn
  WHERE o.vstdate {FROM_TO} AND v.pttype IN {scope('SSS')})
SELECT (SELECT count(*) FROM ovst WHERE vstdate {FROM_TO}) AS ovst_count,
  (SELECT count(*) FROM opitemrece WHERE vstdate {FROM_TO} AND paidst = '02') AS opitemrece_paid_count,
  (SELECT count(*) FROM paid) AS ovst_pttype_count,
  (SELECT count(*) FROM paid WHERE vn IN {BILLED}) AS after_paidst_filter,
  (SELECT count(*) FROM paid JOIN rcpt_debt d ON d.vn = paid.vn
   WHERE paid.vn IN {BILLED} AND d.total_amount > 0) AS after_total_amount_filter""",
    "billitems": f"""
WITH v AS ({_in_scope('SSS')}),
joined AS (
  SELECT DISTINCT v.hn, v.vn, v.vstdate, d.debt_id, dd.total_amount, c.chrgitem_code1, l.icode, l.income, l.qty,
    l.unitprice, l.sum_price, l.paidst, g.sks_drug_code, g.sks_price, g.name AS drug_name, g.strength, g.units,
    n.billcode, n.name AS other_name, n.sks_coverage_price AS cover, n.enable_sks_opd AS switch, k.icode AS ds_icode
  FROM v LEFT JOIN opitemrece l ON l.vn = v.vn
  LEFT JOIN rcpt_debt d ON d.vn = v.vn LEFT JOIN rcpt_debt_detail dd ON dd.debt_id = d.debt_id
  LEFT JOIN nondrugitems n ON n.icode = l.icode LEFT JOIN drugitems g ON g.icode = l.icode
  LEFT JOIN drugitems_sks k ON k.icode = g.icode
  LEFT JOIN income i ON i.income = l.income LEFT JOIN drg_chrgitem c ON c.drg_chrgitem_id = i.drg_chrgitem_id)
SELECT j.hn, {name_of('p')} AS ptname, j.vn, j.debt_id AS invno, j.vstdate, left(j.chrgitem_code1, 1) AS billmuad, j.icode,
  CASE WHEN j.income = '03' THEN j.sks_drug_code ELSE j.billcode END AS stdcode,
  CASE WHEN j.income = '03' THEN concat(j.drug_name, ' ', j.strength, ' ', j.units) ELSE j.other_name END AS "desc",
  j.qty, j.unitprice AS up, j.sum_price AS chargeamt,
  CASE WHEN j.income IN ('03', '17') THEN j.sks_price ELSE j.cover END AS claimup,
  CAST(j.qty * j.unitprice AS DECIMAL(18,4)) AS claimamount, j.ds_icode, j.vn AS svrefid, 'OP1' AS claimcat,
  {flags(debt_id=has('j.debt_id'), billmuad=has('j.chrgitem_code1'),
         stdcode='j.sks_drug_code IS NOT NULL OR j.billcode IS NOT NULL', qty=has('j.qty'), up=has('j.unitprice'),
         chargeamt=has('j.sum_price'), claimup='j.sks_price IS NOT NULL OR j.cover IS NOT NULL')},
  CASE WHEN (j.cover > 0 AND (j.switch IN ('N', '') OR j.switch IS NULL)) OR (j.sks_price > 0 AND j.ds_icode IS NULL) THEN 'N'
       WHEN (j.cover < 1 AND (j.switch IN ('N', '') OR j.switch IS NULL)) OR (j.sks_price < 1 AND j.ds_icode IS NULL) THEN 'N'
       WHEN (j.cover < 1 AND j.switch IS NOT NULL) OR (j.sks_price < 1 AND j.ds_icode IS NOT NULL) THEN 'N'
       ELSE 'Y' END AS check_claimamount,
  {yn("j.ds_icode IS NOT NULL OR j.switch = 'Y'")} AS enable_sks_opd
FROM joined j LEFT JOIN patient p ON p.hn = j.hn""",
    "visit_expenses": f"""
SELECT l.vn, l.icode, l.qty, l.sum_price, concat(s.name, ' ', s.strength) AS items,
  CASE WHEN n.unit IS NULL THEN s.units ELSE n.unit END AS unit
FROM opitemrece l LEFT JOIN s_drugitems s ON s.icode = l.icode
LEFT JOIN nondrugitems n ON n.icode = l.icode AND l.icode LIKE '3%'
WHERE l.vstdate {FROM_TO}""",
    "opservice": f"""
WITH v AS ({_in_scope('SSS')})
SELECT v.vstdate, v.vn, {name_of('p')} AS name, max(d.debt_id) AS invno, v.vn AS svid,
  max(CASE n.income WHEN '11' THEN 'OP' WHEN '12' THEN 'EC' WHEN '07' THEN 'LB' WHEN '08' THEN 'XR' WHEN '09' THEN 'IV'
      ELSE 'ZZ' END) AS class,
  {HOSPITAL} AS hcode, p.hn, p.cid AS pid, '1' AS careaccount, ti.export_code AS typein, tu.export_code AS typeout,
  a.nextdate AS dtappoint, max(m.licenseno) AS svpid, s.nhso_code AS clinic,
  concat(CAST(v.vstdate AS VARCHAR), ' ', v.vsttime) AS begdt, n.billcode AS lccode, max(n.billcode) AS stdcode,
  max(CASE WHEN {text('g.icd10')} THEN 'TT' ELSE '' END) AS codeset,
  max({yn(has('d.debt_id'))}) AS check_invno, {flags(typein=has('ti.export_code'), typeout=has('tu.export_code'))},
  max({yn(has('m.licenseno'))}) AS check_svpid, max({yn(text('g.icd10'))}) AS check_codeset,
  max({yn(has('n.billcode'))}) AS check_stdcode, {yn(has('a.nextdate'))} AS completion,
  {nothing('typeserv', 'enddt', 'svcharge', 'svtxcode')}, 'OPD1' AS claimcat
FROM v LEFT JOIN patient p ON p.hn = v.hn LEFT JOIN rcpt_debt d ON d.vn = v.vn
LEFT JOIN ovstist ti ON ti.ovstist = v.ovstist LEFT JOIN ovstost tu ON tu.ovstost = v.ovstost
LEFT JOIN opitemrece l ON l.vn = v.vn LEFT JOIN nondrugitems n ON n.icode = l.icode
LEFT JOIN ovstdiag g ON g.vn = v.vn AND g.diagtype = '1' LEFT JOIN doctor m ON m.code = g.doctor
LEFT JOIN oapp a ON a.vn = v.vn LEFT JOIN spclty s ON s.spclty = v.spclty
GROUP BY v.vn, v.vstdate, v.vsttime, a.nextdate, p.pname, p.fname, p.lname, p.hn, p.cid, v.ovstist, v.ovstost,
  s.nhso_code, n.billcode, ti.export_code, tu.export_code""",
    "dispenseditem": f"""
WITH l AS (
  SELECT x.*, od.opi_dispense_id, od.dose, od.unit_name, od.frequency_code, od.usage_unit_code
  FROM opitemrece x JOIN ovst v ON v.vn = x.vn LEFT JOIN opi_dispense od ON od.hos_guid = x.hos_guid
  WHERE x.vstdate {FROM_TO} AND v.pttype IN {scope('SSS')} AND v.vn IN {BILLED})
SELECT l.opi_dispense_id, l.vn, l.icode, l.qty, l.drugusage, l.vstdate, l.sum_price, n.sks_product_category_id,
  g.icode AS icode1, g.sks_drug_code, g.units, u.shortlist, u.drugusage AS drugusage1, l.unitprice AS unitprice1,
  g.sks_reimb_price, CAST(sum(l.qty * g.sks_reimb_price) AS DECIMAL(18,4)) AS reimbamt,
  'prdSeCode' AS prdsecode, 'claimcout' AS claimcout, 'claimcat' AS claimcat, 'multiDisp' AS multidisp,
  'supplyfor' AS supplyfor,
  {flags(opi_dispense_id=has('l.opi_dispense_id'), icode=has('l.icode'), qty=has('l.qty'), drugusaged=text('l.drugusage'),
         sum_price=has('l.sum_price'), icode1=has('g.icode'), sks_drug_code=has('g.sks_drug_code'), units=has('g.units'),
         shortlist=has('u.shortlist'), drugusage=has('u.drugusage'), unitprice=has('l.unitprice'),
         sks_reimb_price=has('g.sks_reimb_price'))}
FROM l LEFT JOIN nondrugitems n ON n.icode = l.icode LEFT JOIN drugitems g ON g.icode = l.icode
LEFT JOIN drugusage u ON u.drugusage = l.drugusage
GROUP BY l.vn, l.opi_dispense_id, l.icode, l.qty, l.drugusage, l.vstdate, l.sum_price, n.sks_product_category_id, g.icode,
  g.sks_drug_code, l.dose, l.unit_name, l.frequency_code, l.usage_unit_code, g.units, u.shortlist, u.drugusage,
  l.unitprice, g.sks_reimb_price""",
    "dispenseditem_csop": _csop_items("OFC"),
    "dispenseditem_ssop": _csop_items("SSS"),
    "dispensing": _dispensing("SSS", "CS"),
    "dispensing_ssop": _dispensing("SSS", "SS"),
    "dispensing_per_visit": f"""
WITH v AS ({_in_scope('SSS')})
SELECT v.vstdate, v.vn AS dispid, v.vn AS svid, {name_of('p')} AS name, {HOSPITAL} AS providerid,
  b.debt_id AS invno, {yn(has('b.debt_id'))} AS check_invno, p.hn, p.cid AS pid,
  (SELECT max(m.licenseno) FROM ovstdiag g JOIN doctor m ON m.code = g.doctor WHERE g.vn = v.vn AND g.diagtype = '1') AS prescb,
  (SELECT count(l.icode) FROM opitemrece l WHERE l.vn = v.vn) AS itemcnt,
  (SELECT CAST(sum(l.unitprice) AS DECIMAL(18,2)) FROM opitemrece l WHERE l.vn = v.vn) AS chargeamt,
  b.paid, 'HP' AS reimburser, 'CS' AS benefitplan, '1' AS dispestat,
  {nothing('dispdt', 'claimamt', 'otherpay', 'daycover')}
FROM v LEFT JOIN patient p ON p.hn = v.hn
LEFT JOIN (SELECT vn, paid, max(debt_id) AS debt_id FROM rcpt_debt GROUP BY vn, paid) b ON b.vn = v.vn""",
    "opdx": f"""
WITH v AS ({_in_scope('SSS')}),
d AS (
  SELECT v.hn, v.vn, v.vstdate, g.icd10, g.diagtype,
    EXISTS (SELECT 1 FROM doctor_operation q WHERE q.vn = g.vn AND {text('q.icd9')}) AS operated,
    EXISTS (SELECT 1 FROM opitemrece l JOIN nondrugitems n ON n.icode = l.icode JOIN lab_items b ON b.icode = n.icode
            WHERE l.vn = v.vn AND {text('b.tmlt_code')}) AS tested
  FROM v LEFT JOIN ovstdiag g ON g.vn = v.vn)
SELECT d.hn, d.vn, d.vstdate AS vsdate, {name_of('p')} AS name, d.vn AS svid,
  CASE WHEN d.icd10 BETWEEN '0' AND '99999' THEN 'OP' ELSE 'EC' END AS class,
  CASE WHEN d.diagtype IN ('1', '2', '3', '4') THEN d.diagtype ELSE 'N' END AS sl,
  CASE WHEN operated THEN 'IN' WHEN tested THEN 'LC' WHEN {text('d.icd10')} THEN 'TT' ELSE '' END AS codeset,
  CASE WHEN operated OR tested OR {text('d.icd10')} THEN 'Y' ELSE '' END AS check_codeset,
  {flags(sl=has('d.diagtype'), code=has('d.icd10'))}, {yn(has('d.icd10'))} AS check_class, d.icd10 AS code, i.name AS "desc"
FROM d LEFT JOIN patient p ON p.hn = d.hn LEFT JOIN icd101 i ON i.code = d.icd10""",
    "visit_statistics": f"""
SELECT count(vn) AS total, CAST(0 AS BIGINT) AS passed, CAST(0 AS BIGINT) AS needfix
FROM ovst WHERE vstdate {FROM_TO} AND pttype IN {scope('SSS')}""",
}
