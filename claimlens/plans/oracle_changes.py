"""SQL for the batch corrections and the invoice builder."""

from __future__ import annotations

from claimlens.operators.corrections import DIAGNOSIS_SLOTS
from claimlens.plans.oracle_rules import SQL as RULES
from claimlens.plans.sqltext import FROM_TO, nothing

# -- corrections ---------------------------------------------------------------

_FIELDS = {
    "pttype_name": "name", "drg_group": "grouper_version", "print_presc_ned": "print_presc_ned",
    "finance_round_money": "finance_round_money", "sks_benefit_plan_type_id": "sks_benefit_plan_type_id", "inscl": "nhso_code",
}
_EDITS = """
e AS (
  SELECT pttype, field, _pos, CASE WHEN field IN ('print_presc_ned', 'finance_round_money') AND length(trim(value)) > 1
    THEN upper(left(trim(value), 1)) ELSE coalesce(trim(value), '') END AS clean FROM scheme_edits),
judged AS (
  SELECT e.*, CASE WHEN field = 'secret' THEN 'unknown_field'
    WHEN field = 'sks_benefit_plan_type_id' AND clean IS NOT NULL AND TRY_CAST(clean AS BIGINT) IS NULL THEN 'bad_value'
    WHEN pttype NOT IN (SELECT pttype FROM pttype) THEN 'unknown_key' ELSE 'accepted' END AS verdict FROM e),
latest AS (
  SELECT pttype, field, clean FROM judged WHERE verdict = 'accepted'
  QUALIFY row_number() OVER (PARTITION BY pttype, field ORDER BY _pos DESC) = 1)"""


def _edited(field: str, column: str) -> str:
    new = f"(SELECT clean FROM latest l WHERE l.pttype = s.pttype AND l.field = '{field}')"
    value = f"CAST({new} AS BIGINT)" if column == "sks_benefit_plan_type_id" else new
    found = f"EXISTS (SELECT 1 FROM latest l WHERE l.pttype = s.pttype AND l.field = '{field}')"
    return f"CASE WHEN {found} THEN {value} ELSE s.{column} END AS {column}"


_LAST_UPDATE = """
u AS (
  SELECT vn, pttype, nullif(hospmain, '') AS hospmain, nullif(hospsub, '') AS hospsub FROM hospital_updates
  QUALIFY row_number() OVER (PARTITION BY vn, pttype ORDER BY _pos DESC) = 1)"""

_LAST_DRUG = """
r AS (
  SELECT icode, nullif(name, '') AS name, nullif(strength, '') AS strength, units FROM cancer_drug_rows
  QUALIFY row_number() OVER (PARTITION BY icode ORDER BY _pos DESC) = 1)"""


def _taken(value: str, **fields: str) -> str:
    """Columns of ``t`` that take the value of an edit ``e`` of their field."""
    value = value.replace("value", "e.value")
    return ", ".join(f"if(e.field = '{f}', {value}, t.{c}) AS {c}" for f, c in fields.items())


def _without(rule: str, code: str) -> str:
    return f"""
WITH hit AS ({RULES[rule]})
SELECT o.* FROM opitemrece o WHERE NOT (o.vn IN (SELECT "VN" FROM hit)
  AND o.icode IN (SELECT icode FROM nondrugitems WHERE nhso_adp_code = '{code}'))"""


def _slot_update() -> str:
    empties = [f"(CASE WHEN trim(coalesce(s.{d}, '')) = '' THEN 1 ELSE 0 END)" for d in DIAGNOSIS_SLOTS]
    parts = []
    for i, d in enumerate(DIAGNOSIS_SLOTS):
        upto = " + ".join(empties[: i + 1])
        code = f"(SELECT icd10_add FROM ranked r WHERE r.vn = s.vn AND r.n = {upto})"
        parts.append(f"CASE WHEN {empties[i]} = 1 THEN coalesce({code}, s.{d}) ELSE s.{d} END AS {d}")
    return ", ".join(parts)


_CORRECTIONS = {
    "field_edits": f"""
WITH {_EDITS}
SELECT s.* EXCLUDE ({', '.join(_FIELDS.values())}), {', '.join(_edited(f, c) for f, c in _FIELDS.items())} FROM pttype s""",
    "field_edits_report": f"""
WITH {_EDITS}
SELECT {', '.join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ('accepted', 'unknown_field', 'bad_value', 'unknown_key'))}
FROM judged""",
    "keyed_updates": f"""
WITH {_LAST_UPDATE}
SELECT v.* REPLACE (CASE WHEN u.vn IS NULL THEN v.hospmain ELSE u.hospmain END AS hospmain,
                    CASE WHEN u.vn IS NULL THEN v.hospsub ELSE u.hospsub END AS hospsub)
FROM visit_pttype v LEFT JOIN u ON u.vn = v.vn AND u.pttype = v.pttype""",
    "keyed_updates_report": f"""
WITH {_LAST_UPDATE}
SELECT count(*) FILTER (WHERE (vn, pttype) IN (SELECT (vn, pttype) FROM visit_pttype)) AS matched,
  count(*) FILTER (WHERE (vn, pttype) NOT IN (SELECT (vn, pttype) FROM visit_pttype)) AS unmatched FROM u""",
    "debt_approval": """
SELECT d.* REPLACE (CASE WHEN u.debt_id IS NULL THEN d.sss_approval_code ELSE coalesce(u.sss_approval_code, '') END AS sss_approval_code)
FROM rcpt_debt d LEFT JOIN approval_updates u ON u.debt_id = d.debt_id""",
    "admission_approval": """
SELECT y.* REPLACE (CASE WHEN u.an IS NULL THEN y.auth_code ELSE trim(coalesce(u.auth_code, '')) END AS auth_code)
FROM ipt_pttype y LEFT JOIN approval_updates u ON u.an = y.an""",
    "lab_opt_out": """
SELECT l.* REPLACE (CASE WHEN u.icode IS NULL THEN l.no_lab_catalog WHEN u.no_lab_catalog = 'Y' THEN 'Y' END AS no_lab_catalog)
FROM lab_items l LEFT JOIN lab_switches u ON u.icode = l.icode""",
    "lab_profile_opt_out": """
WITH u AS (FROM profile_switches QUALIFY row_number() OVER (PARTITION BY group_icode ORDER BY _pos DESC) = 1)
SELECT s.* REPLACE (CASE WHEN u.group_icode IS NULL THEN s.no_lab_catalog WHEN u.no_lab_catalog = 'Y' THEN 'Y' END AS no_lab_catalog)
FROM lab_items_sub_group s LEFT JOIN u USING (group_icode)""",
    "main_hospital": """
WITH u AS (FROM hospital_updates QUALIFY row_number() OVER (PARTITION BY vn ORDER BY _pos DESC) = 1)
SELECT v.* REPLACE (if(u.vn IS NULL, v.hospmain, nullif(u.hospmain, '')) AS hospmain) FROM visit_pttype v LEFT JOIN u ON u.vn = v.vn""",
    "morphine_row": """
SELECT m.drug_morphine_id, coalesce(u.icode, m.icode) AS icode, if(u.icode IS NULL, m.name, nullif(u.name, '')) AS name,
  if(u.icode IS NULL, m.strength, nullif(u.strength, '')) AS strength, if(u.icode IS NULL, m.units, nullif(u.units, '')) AS units
FROM drug_morphine m LEFT JOIN morphine_rows u ON u.drug_morphine_id = m.drug_morphine_id""",
    "doctor_field_edits": f"""
SELECT t.* REPLACE ({_taken('value', licenseno='licenseno', d_name='name', pname='pname', cid='cid')})
FROM doctor t LEFT JOIN doctor_edits e ON e.code = t.code""",
    "income_field_edits": f"""
SELECT t.* REPLACE ({_taken("nullif(value, '')", income_name='name', group2='group2', std_group='std_group', drg_group='drg_group')})
FROM income t LEFT JOIN income_edits e ON e.income = t.income""",
    "xray_field_edits": f"""
WITH e AS (FROM xray_edits WHERE field = 'xray_name' OR value IS NULL OR TRY_CAST(value AS DECIMAL(12,2)) IS NOT NULL)
SELECT t.* REPLACE ({_taken('value', xray_name='xray_items_name')},
  if(e.field = 'exposure_qty', CAST(e.value AS BIGINT), t.exposure_qty) AS exposure_qty,
  if(e.field = 'price', CAST(e.value AS DECIMAL(12,2)), t.service_price) AS service_price)
FROM xray_items t LEFT JOIN e ON e.xray_items_code = t.xray_items_code""",
    "service_field_edits": f"""
WITH e AS (SELECT icode, field, nullif(value, '') AS value FROM service_edits
  WHERE field <> 'price' OR value IS NULL OR value = '' OR TRY_CAST(value AS DECIMAL(12,2)) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY icode, field ORDER BY _pos DESC) = 1),
one AS (SELECT icode, {', '.join(f"max(value) FILTER (field = '{f}') AS {f}, bool_or(field = '{f}') AS has_{f}"
                                  for f in ('name', 'unit', 'billcode', 'income', 'price'))} FROM e GROUP BY icode)
SELECT t.* REPLACE ({', '.join(f"if(one.has_{f}, one.{f}, t.{f}) AS {f}" for f in ('name', 'unit', 'billcode', 'income'))},
  if(one.has_price, CAST(one.price AS DECIMAL(12,2)), t.price) AS price)
FROM nondrugitems t LEFT JOIN one ON one.icode = t.icode""",
    "drug_field_edits": """
WITH e AS (
  SELECT icode, field, trim(value) AS clean FROM drug_edits WHERE field <> 'name'
    AND NOT (field = 'sks_price' AND value IS NOT NULL AND TRY_CAST(trim(value) AS DECIMAL(12,2)) IS NULL))
SELECT d.* REPLACE (
  CASE WHEN e.field = 'sks_price' THEN CAST(e.clean AS DECIMAL(12,2)) ELSE d.sks_price END AS sks_price,
  CASE WHEN e.field = 'sks_drug_code' THEN e.clean ELSE d.sks_drug_code END AS sks_drug_code,
  CASE WHEN e.field = 'sks_product_category_id' THEN e.clean ELSE d.sks_product_category_id END AS sks_product_category_id,
  CASE WHEN e.field = 'sks_clain_control_type_id' THEN e.clean ELSE d.sks_clain_control_type_id END AS sks_clain_control_type_id)
FROM drugitems d LEFT JOIN e ON e.icode = d.icode""",
    "insert_missing": """
SELECT code FROM sks_icd10tm_check
UNION ALL SELECT DISTINCT code FROM ovst_sks_icd10tm
WHERE code IS NOT NULL AND code NOT IN (SELECT code FROM sks_icd10tm_check)""",
    "upsert_rows": f"""
WITH {_LAST_DRUG}
SELECT icode, name, strength, units FROM r
UNION ALL SELECT d.icode, d.name, d.strength, d.units FROM drugitems_cancer d WHERE d.icode NOT IN (SELECT icode FROM r)""",
    "upsert_report": """
WITH n AS (SELECT count(DISTINCT icode) AS inserted FROM cancer_drug_rows
           WHERE icode NOT IN (SELECT icode FROM drugitems_cancer))
SELECT inserted, (SELECT count(*) FROM cancer_drug_rows) - inserted AS updated FROM n""",
    "append_numbered": """
SELECT drug_morphine_id, icode, name, strength, units FROM drug_morphine
UNION ALL
SELECT (SELECT max(drug_morphine_id) FROM drug_morphine) + row_number() OVER (ORDER BY icode), icode, nullif(name, ''),
  nullif(strength, ''), nullif(units, '')
FROM drugitems WHERE istatus = 'Y' AND icode NOT IN (SELECT icode FROM drug_morphine)""",
    "delete_by_key": """
SELECT * FROM drugitems_cancer WHERE icode NOT IN (SELECT icode FROM cancer_drug_rows)""",
    "delete_walkin_lines": _without("walkin_with_cancer", "WALKIN"),
    "delete_adp_lines": _without("adp_with_morphine", "ADP30001"),
    "add_diagnosis_rows": f"""
SELECT vn, ovst_diag_id, icd10, diagtype, doctor, diag_no, hn, vstdate, vsttime, {nothing('hos_guid', 'staff')} FROM ovstdiag
UNION ALL BY NAME
SELECT vn, (SELECT max(ovst_diag_id) FROM ovstdiag) + row_number() OVER (ORDER BY _pos) AS ovst_diag_id, icd10_add AS icd10,
  CASE WHEN diagtype <> '' THEN diagtype ELSE '4' END AS diagtype, doctor_code AS doctor, CAST(NULL AS INTEGER) AS diag_no, hn,
  vstdate, vsttime, 'app' AS hos_guid, 'clerk' AS staff FROM new_diagnoses""",
    "fill_diagnosis_slots": f"""
WITH ranked AS (
  SELECT vn, icd10_add, row_number() OVER (PARTITION BY vn ORDER BY _pos) AS n FROM new_diagnoses WHERE icd10_add <> '')
SELECT s.* EXCLUDE ({', '.join(DIAGNOSIS_SLOTS)}), {_slot_update()} FROM vn_stat s""",
}

# -- invoices ------------------------------------------------------------------

_READY = f"""
ready AS (
  SELECT o.vn, o.vstdate, o.vsttime, o.staff, z.uc_money FROM ovst o JOIN vn_stat z ON z.vn = o.vn
  WHERE o.vstdate {FROM_TO} AND o.vn IN (SELECT vn FROM visit_pttype) AND o.vn IN (SELECT vn FROM opitemrece)),
l AS (SELECT * FROM opitemrece WHERE vn IN (SELECT vn FROM ready))"""
_TRANSFERS = "tr AS (SELECT vn, row_number() OVER (ORDER BY vn) AS opd_opi_fn_tr_list_id FROM ready)"
_CREDITS = """
cr AS (
  SELECT r.*, y.pttype, row_number() OVER (ORDER BY r.vn, y.pttype_number, y.pttype) AS n
  FROM ready r JOIN visit_pttype y ON y.vn = r.vn),
lastcr AS (SELECT vn, max(n) AS n FROM cr GROUP BY vn)"""
_DEBT_ID = "(SELECT max(debt_id) FROM rcpt_debt)"
_DEBTS = f"""
db AS (
  SELECT vn, hn, vstdate, vsttime, staff, pttype, sum(CASE WHEN paidst = '02' THEN sum_price ELSE 0 END) AS s02,
    sum(discount) AS discount, {_DEBT_ID} + row_number() OVER (ORDER BY vn, pttype, staff, hn, vstdate, vsttime) AS debt_id,
    row_number() OVER (PARTITION BY vn ORDER BY pttype, staff, hn, vstdate, vsttime) AS rank
  FROM l GROUP BY vn, hn, vstdate, vsttime, staff, pttype)"""


def _sum(state: str) -> str:
    return f"CAST(sum(CASE WHEN l.paidst = '{state}' THEN l.sum_price ELSE 0 END) AS DECIMAL(18,2))"


_TOTAL = "CAST(sum(l.sum_price) AS DECIMAL(18,2))"
_DISCOUNT = "CAST(sum(l.discount) AS DECIMAL(18,2))"


def _text(**values: str) -> str:
    return ", ".join(f"'{v}' AS {n}" for n, v in values.items())


_INVOICE = {
    "invoice_transfer_list": f"""
WITH {_READY}, {_TRANSFERS}
SELECT tr.opd_opi_fn_tr_list_id, r.vstdate AS opd_opi_fn_tr_date, r.vsttime AS opd_opi_fn_tr_time, r.vn,
  r.uc_money AS transfer_amount, r.staff AS opd_opi_fn_tr_staff FROM ready r JOIN tr ON tr.vn = r.vn""",
    "invoice_transfer_links": f"""
WITH {_READY}, {_TRANSFERS}
SELECT CAST(NULL AS VARCHAR) AS opi_guid, hos_guid, vn, opd_opi_fn_tr_list_id FROM old_transfers
WHERE hos_guid NOT IN (SELECT hos_guid FROM l)
UNION ALL SELECT l.hos_guid, l.hos_guid, l.vn, tr.opd_opi_fn_tr_list_id FROM l JOIN tr ON tr.vn = l.vn""",
    "invoice_transfer_detail": f"""
WITH {_READY}, {_TRANSFERS}, {_CREDITS}
SELECT row_number() OVER (ORDER BY l.vn, l.income, l.pttype) AS opd_opi_fn_tr_detail_id, tr.opd_opi_fn_tr_list_id,
  c.n AS opd_opi_fn_cr_list_id, l.income, l.pttype, {_sum('01')} AS amount_paidst_01, {_sum('02')} AS amount_paidst_02,
  {_sum('03')} AS amount_paidst_03, {_TOTAL} AS total_amount,
  {_text(amount_paidst_04='0', process_order='1000', amount_paidst_04a='0', amount_paidst_04b='0')}
FROM l JOIN tr ON tr.vn = l.vn JOIN lastcr c ON c.vn = l.vn
GROUP BY l.vn, l.income, l.pttype, tr.opd_opi_fn_tr_list_id, c.n""",
    "invoice_finance_summary": f"""
WITH {_READY}
SELECT row_number() OVER (ORDER BY l.vn, l.income, l.pttype) AS opd_opi_finance_summary_id, l.vn, l.income, l.pttype,
  {', '.join(f'{_sum(s)} AS total_paidst_{s}, {_sum(s)} AS total_balance_{s}' for s in ('01', '02', '03'))},
  {_TOTAL} AS total_amount, {_TOTAL} AS balance_amount, {_sum('02')} AS total_balance_04a, {_sum('02')} AS total_amount_a,
  {_text(total_paidst_04='0', clear_amount='0', total_balance_04='0', status_ok='N', total_paidst_04a='0', total_paidst_04b='0')}
FROM l GROUP BY l.vn, l.income, l.pttype""",
    "invoice_credit_list": f"""
WITH {_READY}, {_CREDITS}
SELECT n AS opd_opi_fn_cr_list_id, vn, pttype, vstdate AS opd_opi_fn_cr_date, vsttime AS opd_opi_fn_cr_time,
  staff AS opd_opi_fn_cr_staff, uc_money AS clear_amount, n + 500 AS finance_number, 'Y' AS status_ok FROM cr""",
    "invoice_credit_detail": f"""
WITH {_READY}, {_CREDITS}
SELECT row_number() OVER (ORDER BY l.vn, l.income) AS opd_opi_fn_cr_detail_id, c.n AS opd_opi_fn_cr_list_id, l.income,
  {_sum('02')} AS amount_paidst_02, {_sum('02')} AS total_amount, {_sum('02')} AS original_total_amount,
  '0' AS amount_paidst_04
FROM l JOIN lastcr c ON c.vn = l.vn GROUP BY l.vn, l.income, c.n""",
    "invoice_debt": f"""
WITH {_READY}, {_CREDITS}, {_DEBTS}
SELECT d.debt_id, d.vn, d.hn, d.vstdate AS debt_date, d.staff, CAST(d.s02 AS DECIMAL(18,2)) AS amount,
  CAST(d.s02 AS DECIMAL(18,2)) AS total_amount, CAST(d.discount AS DECIMAL(18,2)) AS discount_amount,
  c.n + 500 AS finance_number, d.pttype, d.vstdate + CAST(d.vsttime AS TIME) AS debt_date_time,
  d.pttype || '/' || CAST(d.rank AS VARCHAR) AS debt_doc_id, coalesce('X' || d.vn, '') AS sss_approval_code,
  {_text(debt_time='12:00:00', pt_type='OPD', computer='App precheck export', department='OPD',
         special_discount_amount='0', ofc_paid_amount='0')}
FROM db d JOIN lastcr c ON c.vn = d.vn""",
    "invoice_debt_detail": f"""
WITH {_READY}, {_DEBTS},
lastdb AS (SELECT vn, max(debt_id) AS debt_id FROM db GROUP BY vn)
SELECT d.debt_id, l.income, {_sum('02')} AS amount, {_DISCOUNT} AS discount, {_sum('02')} AS total_amount,
  '0' AS special_discount FROM l JOIN lastdb d ON d.vn = l.vn GROUP BY l.vn, l.income, d.debt_id""",
    "invoice_stamp_lines": f"""
WITH {_READY}, {_CREDITS}
SELECT o.*, c.n + 500 AS finance_number FROM opitemrece o LEFT JOIN lastcr c ON c.vn = o.vn""",
    "invoice_rejected": f"""
WITH {_READY}
SELECT vn, 'X' || vn AS vercode FROM ovst WHERE vstdate {FROM_TO} AND vn NOT IN (SELECT vn FROM ready)""",
}

SQL = {**_CORRECTIONS, **_INVOICE}
