"""SQL for the sixteen-file set."""

from claimlens.plans.sqltext import FROM_TO, HOSPITAL, flags, has, name_of, scope, text

FDH = scope("FDH")
VISITS = f"SELECT * FROM ovst WHERE vstdate {FROM_TO} AND pttype IN {FDH}"
STAYS = f"SELECT * FROM ipt WHERE dchdate {FROM_TO} AND pttype IN {FDH}"


def ods(admit: str, an: str) -> str:
    return f"CASE WHEN {admit} = '5' THEN 'ODS' || {an} ELSE {an} END"


def _ins(day: str, an: str, seq: str, source: str) -> str:
    return f"""
SELECT {day} AS visit_date, {name_of('p')} AS ptname, s.name AS pttype_name, p.hn, s.hipdata_code AS inscl,
  y.pttype AS subtype, p.cid, {HOSPITAL} AS hcode, y.expire_date AS dateexp, y.hospmain, y.hospsub,
  '' AS govcode, '' AS govname, y.auth_code AS permitno, '' AS docno, '' AS ownrpid, '' AS ownname, {an} AS an,
  {seq} AS seq, s.nhso_code AS subinscl, '' AS relinscl, '1' AS htype,
  {flags(inscl=has('s.hipdata_code'), cid=has('p.cid'), hospmain=text('y.hospmain'), hospsub=text('y.hospsub'),
         permitno=has('y.auth_code'))}
FROM {source} LEFT JOIN pttype s ON s.pttype = y.pttype LEFT JOIN patient p ON p.hn = v.hn"""


_OPD_PAYERS = f"({VISITS}) v LEFT JOIN visit_pttype y ON y.vn = v.vn"
_IPD_PAYERS = (
    f"(SELECT * FROM ipt WHERE dchdate {FROM_TO}) v JOIN (SELECT * FROM ipt_pttype WHERE pttype IN {FDH}) y ON y.an = v.an"
)


def _ins43(day: str, key: str, main: str, ipt: str, admit: str, source: str) -> str:
    return f"""
SELECT p.pname, p.fname, p.lname, {day} AS visit_date, p.hn, s.hipdata_code, y.pttype, p.cid, y.expire_date, y.hospmain,
  y.hospsub, y.auth_code, {key} AS vn, s.hipdata_code AS htype, y.claim_code, s.hipdata_pttype,
  {ipt} AS ipt_type, {admit} AS ipt_admit_type_id,
  {flags(hipdata_code=has('s.hipdata_code'), pttype=has('y.pttype'), cid=has('p.cid'), expire_date=has('y.expire_date'),
         hospmain=main, hospsub=has('y.hospsub'), auth_code=has('y.auth_code'),
         hipdata_code_dup=has('s.hipdata_code'), claim_code=has('y.claim_code'))}
FROM {source} LEFT JOIN pttype s ON s.pttype = y.pttype LEFT JOIN patient p ON p.hn = v.hn"""


_PAT = "chwpart amppart sex marrystatus occupation nationality cid pname fname lname".split()
_PAT_ROW = f"""p.hn, p.birthday, {', '.join('p.' + c for c in _PAT)}, concat(p.fname, ' ', p.lname) AS ptname, 1 AS idtype,
  {HOSPITAL} AS hcode, {flags(birthday=has('p.birthday'), ptname="trim(concat(p.fname, ' ', p.lname)) <> ''",
                              **{c: text('p.' + c) for c in _PAT})}"""

ADMISSION = """i.hn, i.an, i.regdate, i.regtime, i.dchdate, i.dchtime, a.name AS dchstts, b.name AS dchtype,
  w.name AS first_ward, c.name AS spclty, i.bw, """ + flags(
    dateadm=has("i.regdate"), timeadm=has("i.regtime"), datedsc=has("i.dchdate"), timedsc=has("i.dchtime"),
    dischs=has("i.dchstts"), discht=has("i.dchtype"), warddsc=has("i.first_ward"), dept=has("i.spclty"), adm_w=has("i.bw"),
)
ADMISSION_NAMES = """LEFT JOIN dchstts a ON a.dchstts = i.dchstts LEFT JOIN dchtype b ON b.dchtype = i.dchtype
LEFT JOIN ward w ON w.ward = i.first_ward LEFT JOIN spclty c ON c.spclty = i.spclty"""
OPERATION = """k.name AS oper_type, q.icd9 AS oper, q.opdate AS datein, q.optime AS timein, q.enddate AS dateout,
  q.endtime AS timeout, m.licenseno, """ + flags(
    icd9=text("q.icd9"), datein=has("q.opdate"), timein="q.optime IS NOT NULL AND q.optime <> '00:00:00'",
    dateout=has("q.enddate"), timeout="q.endtime IS NOT NULL AND q.endtime <> '00:00:00'", licenseno=text("m.licenseno"),
)
OPERATION_NAMES = """JOIN iptoprt q ON q.an = i.an LEFT JOIN doctor m ON m.code = q.doctor
LEFT JOIN oper_type k ON k.oper_type = q.oper_type"""


def _orf(match: str) -> str:
    return f"""
SELECT v.hn, v.vstdate AS dateopd, x.refer_hospcode, x.refer_type, x.referout_type_id, c.name AS clinic, n.vn AS referin,
  x.vn AS referout, {flags(referout_type=has('x.referout_type_id'), clinic="c.provis_code IS NOT NULL OR c.provis_code = ''",
                           vn='n.vn IS NOT NULL OR x.vn IS NOT NULL')}
FROM ({VISITS}) v LEFT JOIN ovstdiag g ON g.{match} = v.{match} LEFT JOIN spclty c ON c.spclty = v.spclty
LEFT JOIN referout x ON x.vn = v.vn LEFT JOIN referin n ON n.vn = v.vn
WHERE x.vn = v.vn OR n.vn = v.vn"""


def _odx(match: str) -> str:
    return f"""
SELECT v.hn, v.vstdate, g.icd10 AS diag, v.spclty, g.diagtype AS dxtype, m.licenseno, p.cid, v.vn,
  {flags(diag=has('g.icd10'), clinic="c.provis_code IS NOT NULL OR c.provis_code = ''", diagtype="g.diagtype <> ''",
         drdx="m.licenseno <> ''")}
FROM ({VISITS}) v LEFT JOIN ovstdiag g ON g.{match} = v.{match} LEFT JOIN spclty c ON c.spclty = v.spclty
LEFT JOIN diagtype t ON t.diagtype = g.diagtype LEFT JOIN doctor m ON m.code = g.doctor LEFT JOIN patient p ON p.hn = v.hn"""


def _cht(key: str, an: str, day: str, rows: str, stat: str, payers: str) -> str:
    return f"""
SELECT v.hn, {an} AS an, {day} AS vstdate, z.income AS total, z.income, z.paid_money AS paid, p.cid AS person_id,
  CASE WHEN s.paidst IN ('01', '03') THEN '10' ELSE s.pcode END AS pttype,
  CASE WHEN s.paidst IN ('01', '03') THEN 'ชำระเงิน' ELSE 'ใช้สิทธิ' END AS check_pttype, {flags(total=has('z.income'))},
  CASE WHEN v.an <> '' THEN v.an ELSE v.vn END AS seq, '' AS opd_memo, '' AS invoice_no, '' AS invoice_lt
FROM ({rows}) v JOIN patient p ON p.hn = v.hn JOIN {stat} z ON z.{key} = v.{key}
LEFT JOIN {payers} y ON y.{key} = v.{key} AND y.pttype_number = '1' LEFT JOIN pttype s ON s.pttype = y.pttype"""


def _cha(key: str, day: str, rows: str, sums: str, ipt: str, admit: str) -> str:
    return f"""
SELECT v.{key} AS vnan, v.hn, p.pname, p.fname, p.lname, v.{day} AS dchdate, {ipt} AS ipt_type, p.cid, s.pcode,
  d.chrgitem_code1, r.income AS chrgitem, {admit} AS ipt_admit_type_id, CAST(sum(r.rcptamt) AS DECIMAL(18,2)) AS amount
FROM ({rows}) v LEFT JOIN {sums} r ON r.{key} = v.{key} AND r.paidst = '02' LEFT JOIN income i ON i.income = r.income
LEFT JOIN drg_chrgitem d ON d.drg_chrgitem_id = i.drg_chrgitem_id LEFT JOIN pttype s ON s.pttype = v.pttype
LEFT JOIN patient p ON p.hn = v.hn GROUP BY ALL"""


def _phdb(key: str, rows: str, dates: str, source: str) -> str:
    return f"""
SELECT {dates}, {name_of('p')} AS pt_name, v.hn, v.vn, n.income_phdb_code, l.qty, l.unitprice, s.hipdata_code,
  {flags(income_phdb_code=has('n.income_phdb_code'), qty='l.qty > 0', unitprice='l.unitprice > 0',
         hipdata_code=has('s.hipdata_code'))}, '{source}' AS source_type
FROM ({rows}) v LEFT JOIN opitemrece l ON l.{key} = v.{key} AND l.qty > 0 AND l.sum_price > 0
LEFT JOIN nondrugitems n ON n.icode = l.icode LEFT JOIN pttype s ON s.pttype = l.pttype LEFT JOIN patient p ON p.hn = v.hn"""


_INS_OPD = _ins("v.vstdate", "y.vn", "y.vn", _OPD_PAYERS)
_INS_IPD = _ins("v.dchdate", "y.an", "v.vn", _IPD_PAYERS)
_NULL = "CAST(NULL AS VARCHAR)"

SQL = {
    "fdh_ins": f"{_INS_OPD}\nUNION ALL{_INS_IPD}",
    "fdh_ins_opd_only": _ins("v.vstdate", "''", "y.vn", _OPD_PAYERS),
    "fdh_ins_43": _ins43("v.vstdate", "y.vn", has("y.hospmain"), _NULL, _NULL, _OPD_PAYERS)
    + "\nUNION ALL"
    + _ins43("v.dchdate", "y.an", "y.hospmain >= '00000' AND y.hospmain <= '99999'", "v.ipt_type", "v.ipt_admit_type_id", _IPD_PAYERS),
    "fdh_pat": f"""
SELECT {_PAT_ROW} FROM patient p JOIN ({VISITS}) v ON v.hn = p.hn
UNION ALL
SELECT {_PAT_ROW} FROM patient p JOIN ({STAYS}) v ON v.hn = p.hn""",
    "fdh_opd": f"""
SELECT v.hn, c.provis_code, v.vstdate, v.vsttime, v.vn, y.request_funds, x.cc, x.temperature, x.bps, x.bpd, x.pulse, x.rr,
  f.nhso_fee_schedule_list_text, v.ovstist, e.er_leave_status_id,
  {flags(clinic=text('c.provis_code'), dateopd=has('v.vstdate'), timeopd=has('v.vsttime'), seq=has('v.vn'),
         uuc="y.request_funds IS NOT NULL AND y.request_funds NOT IN ('', 'N')", detail=text('x.cc'),
         btemp=has('x.temperature'), sbp=has('x.bps'), dbp=has('x.bpd'), pr=has('x.pulse'), rr=has('x.rr'),
         optype=has('f.nhso_fee_schedule_list_text'), typein=has('v.ovstist'), typeout=has('e.er_leave_status_id'))}
FROM ({VISITS}) v LEFT JOIN spclty c ON c.spclty = v.spclty LEFT JOIN visit_pttype y ON y.vn = v.vn
LEFT JOIN opdscreen x ON x.vn = v.vn LEFT JOIN ovst_seq f ON f.vn = v.vn LEFT JOIN er_regist e ON e.vn = v.vn""",
    "fdh_orf": _orf("vn"),
    "fdh_orf_by_patient": _orf("hn"),
    "fdh_orf_by_visit": _orf("vn"),
    "fdh_odx": _odx("vn"),
    "fdh_odx_by_patient": _odx("hn"),
    "fdh_odx_by_visit": _odx("vn"),
    "fdh_oop": f"""
SELECT z.hn, v.vstdate AS dateopd, c.provis_code AS clinic, q.icd9 AS oper, m.licenseno AS dropid, p.cid AS person_id,
  q.vn AS seq, {flags(clinic=has('c.provis_code'), oper="q.icd9 <> ''", dropid="m.licenseno <> ''")}
FROM doctor_operation q JOIN ({VISITS}) v ON v.vn = q.vn LEFT JOIN vn_stat z ON z.vn = q.vn
LEFT JOIN spclty c ON c.spclty = v.spclty LEFT JOIN patient p ON p.hn = v.hn LEFT JOIN doctor m ON m.code = q.doctor""",
    "fdh_irf": f"""
SELECT i.an, x.refer_hospcode AS refer, n.vn AS referin, x.vn AS referout,
  {flags(refer="x.refer_hospcode <> ''", refertype='n.vn IS NOT NULL OR x.vn IS NOT NULL')}
FROM ({STAYS}) i LEFT JOIN referout x ON x.vn = i.an LEFT JOIN referin n ON n.vn = i.an WHERE length(x.vn) > 0""",
    "fdh_ipd": f"""
SELECT {ADMISSION}, y.request_funds, k.ipt_type_name,
  {flags(uuc="y.request_funds IS NOT NULL AND y.request_funds NOT IN ('', 'N')", svctype=has('i.ipt_type'))}
FROM ({STAYS}) i LEFT JOIN ovst v ON v.an = i.an LEFT JOIN visit_pttype y ON y.vn = v.vn {ADMISSION_NAMES}
LEFT JOIN ipt_type k ON k.ipt_type = i.ipt_type""",
    "fdh_iop": f"SELECT {ods('i.ipt_admit_type_id', 'q.an')} AS an, {OPERATION} FROM ({STAYS}) i {OPERATION_NAMES}",
    "fdh_cht": _cht("vn", "''", "v.vstdate", VISITS, "vn_stat", "visit_pttype")
    + "\nUNION ALL"
    + _cht("an", ods("v.ipt_admit_type_id", "v.an"), "v.regdate", STAYS, "an_stat", "ipt_pttype"),
    "fdh_cha": _cha("vn", "vstdate", VISITS, "incoth", _NULL, _NULL)
    + "\nUNION ALL"
    + _cha("an", "dchdate", STAYS, "incith", "v.ipt_type", "v.ipt_admit_type_id"),
    "fdh_idx": f"""
SELECT {ods('i.ipt_admit_type_id', 'i.an')} AS an, g.icd10 AS diag, g.diagtype AS dxtype, m.licenseno,
  {flags(diag=has('g.icd10'), diagtype="g.diagtype <> ''", licenceno="m.licenseno <> ''")}
FROM ({STAYS}) i LEFT JOIN iptdiag g ON g.an = i.an LEFT JOIN diagtype t ON t.diagtype = g.diagtype
LEFT JOIN doctor m ON m.code = g.doctor""",
    "fdh_lvd": f"""
SELECT h.ipt_home_leave_id AS seglvd, h.dch_date, h.dch_time, h.reg_date, h.reg_time, h.an, p.hn, {name_of('p')} AS pt_name,
  i.regdate, {flags(seglvd=has('h.ipt_home_leave_id'), dch_date=has('h.dch_date'), dch_time=has('h.dch_time'),
                    reg_date=has('h.reg_date'), reg_time=has('h.reg_time'), qty_day='h.reg_date - h.dch_date > 0')},
  CASE WHEN h.reg_date - h.dch_date > 0 THEN CAST(h.reg_date - h.dch_date AS VARCHAR) ELSE 'N' END AS qty_day
FROM ({STAYS}) i JOIN ipt_home_leave h ON h.an = i.an LEFT JOIN patient p ON p.hn = i.hn""",
    "fdh_dru": f"""
SELECT {HOSPITAL} AS hcode, v.hn, ip.an, v.vn, v.spclty AS clinic, z.cid AS person_id, v.vstdate AS date_serv, g.did,
  trim(concat(g.name, ' ', g.strength, ' ', g.units)) AS didname, l.qty AS amount, l.unitprice AS drugprice,
  l.cost AS drugcost, g.tmt_tp_code AS didstd, g.units AS unit, concat(CAST(g.packqty AS VARCHAR), 'x', g.units) AS unit_pack,
  v.vn AS seq, e.presc_reason AS drugremark, e.nhso_authorize_code AS pa_no, l.paidst AS use_status,
  {flags(did=has('g.did'), amount=has('l.qty'), drugprice=has('l.unitprice'), drugcost=has('l.cost'),
         didstd=has('g.tmt_tp_code'), unit=has('g.units'), drugremark=has('e.presc_reason'), use_status=has('l.paidst'))},
  CAST(sum(CASE WHEN l.paidst IN ('01', '03') THEN l.qty * l.unitprice ELSE 0 END) AS DECIMAL(18,4)) AS totcopay,
  CAST(sum(CASE WHEN l.paidst = '02' THEN l.qty * l.unitprice ELSE 0 END) AS DECIMAL(18,4)) AS total, l.doctor AS provider
FROM ({VISITS}) v
LEFT JOIN opitemrece l ON l.vn = v.vn AND l.qty > 0 AND l.sum_price > 0 AND l.paidst IN ('01', '02', '03')
LEFT JOIN drugitems g ON g.icode = l.icode LEFT JOIN vn_stat z ON z.vn = v.vn
LEFT JOIN ovst_presc_ned e ON e.vn = l.vn AND e.icode = l.icode AND e.doctor = l.doctor
LEFT JOIN drugitems_ned_reason_list b ON b.claim_control = e.presc_reason LEFT JOIN ipt ip ON ip.an = v.an
GROUP BY v.hn, ip.an, v.vn, v.spclty, z.cid, v.vstdate, g.did, g.name, g.strength, g.units, l.qty, l.unitprice, l.cost,
  g.tmt_tp_code, g.packqty, e.presc_reason, e.nhso_authorize_code, l.paidst, l.doctor""",
    "fdh_labfu": f"""
SELECT {HOSPITAL} AS hcode, p.hn, p.cid, v.vstdate, v.vn, k.sys_lab_code_id, r.lab_order_result,
  {flags(person_id=text('p.cid'), dateopd=has('v.vstdate'), seq=has('v.vn'), labtest=has('k.sys_lab_code_id'),
         labresult=has('r.lab_order_result'))}
FROM patient p JOIN ({VISITS}) v ON v.hn = p.hn LEFT JOIN lab_head h ON h.vn = v.vn
LEFT JOIN lab_order r ON r.lab_order_number = h.lab_order_number LEFT JOIN lab_items b ON b.lab_items_code = r.lab_items_code
LEFT JOIN sys_lab_link k ON k.lab_items_code = b.lab_items_code""",
    "fdh_phdb": _phdb("vn", VISITS, f"v.vstdate AS service_date, CAST(NULL AS DATE) AS regdate, CAST(NULL AS DATE) AS dchdate, {_NULL} AS an", "OPD")
    + "\nUNION ALL BY NAME"
    + _phdb("an", STAYS, "CAST(NULL AS DATE) AS service_date, v.regdate, v.dchdate, v.an", "IPD"),
}
