"""SQL for the catalogue checks."""

from claimlens.operators.catalogue import ADP_TYPE_BY_CHARGE_ITEM, PLAIN_LISTS
from claimlens.plans.sqltext import flags, has, text, yn


def ck(**conditions: str) -> str:
    return flags("", "_check", **conditions)


def _off(alias: str, *names: str) -> str:
    return ", ".join(f"CASE {alias}.{n} WHEN 'Y' THEN 'N' ELSE 'Y' END AS {n}_check" for n in names)


_ROUND = ("finance_round_money", "inc_round_money", "round_money")


def _like(column: str, *starts: str) -> str:
    return "(" + " OR ".join(f"{column} LIKE '{s}%'" for s in starts) + ")"


def _scheme(group: str, prefix: str, plans: str, types: str) -> str:
    return f"""
SELECT s.pttype, s.name AS pttype_name, s.pcode, s.hipdata_code, s.nhso_code AS inscl, s.grouper_version AS drg_group,
  s.print_presc_ned, s.sks_benefit_plan_type_id, b.sks_benefit_plan_type_name, b.sks_code, s.pttype_upp_type_id,
  u.pttype_upp_type_name, s.finance_round_money, s.inc_round_money, s.round_money,
  {ck(drg_group="s.grouper_version = '6'", print_presc_ned="s.print_presc_ned = 'Y'",
      sks_benefit_plan_type_id=f"CAST(s.sks_benefit_plan_type_id AS VARCHAR) IN ({plans})",
      pttype_upp_type_id=f"CAST(s.pttype_upp_type_id AS VARCHAR) IN ({types})")}, {_off('s', *_ROUND)}
FROM pttype s LEFT JOIN sks_benefit_plan_type b ON b.sks_benefit_plan_type_id = s.sks_benefit_plan_type_id
LEFT JOIN pttype_upp_type u ON u.pttype_upp_type_id = s.pttype_upp_type_id
WHERE s.isuse = 'Y' AND s.hipdata_code = '{group}' AND s.paidst = '02' AND s.nhso_code ILIKE '{prefix}%'"""


_CLEAN = """CASE WHEN regexp_matches(n.name, '[\\r\\n<>"''&]') THEN 'N' ELSE 'Y' END AS name_check"""
_ITEMS = """FROM nondrugitems n LEFT JOIN income i ON i.income = n.income
LEFT JOIN nhso_adp_type a ON a.nhso_adp_type_id = n.nhso_adp_type_id"""


def _state(own: str, theirs: str, out: str, otherwise: str) -> str:
    return f"""CASE WHEN {text(own)} AND {text(theirs)} AND {out} IS NULL THEN 'Y'
    WHEN {own} IS NULL AND {theirs} IS NULL AND {out} = 'Y' THEN 'Y'
    WHEN {text(own)} AND ({theirs} IS NULL OR {theirs} = '') AND {out} IS NULL THEN 'N' ELSE '{otherwise}' END"""


def _lab(table: str, code: str, name: str, icode: str, price: str, group: str, active: str, kind: str) -> str:
    other = "" if kind == "Profile" else "Y"

    def shown(x: str) -> str:
        return x if kind == "Profile" else f"CASE WHEN {text(x)} THEN {x} ELSE 'ไม่ผูกค่าใช้จ่าย' END"

    return f"""
SELECT g.in_group AS lab_items_group_name, g.{code} AS lab_code, {shown('g.' + icode)} AS lab_icode,
  c.lab_catalog_lc_code AS lab_catalog_icode, g.no_lab_catalog, g.{name} AS lab_name, g.{price} AS price,
  {shown('g.tmlt_code')} AS lab_tmlt, c.lab_catalog_tmlt, c.lab_catalog_name, n.name AS nondrug_name, '{kind}' AS lab_type,
  n.sks_coverage_price, n.special AS pttype_price,
  {_state('g.' + icode, 'c.lab_catalog_lc_code', 'g.no_lab_catalog', other)} AS lab_catalog_icode_check,
  {_state('g.tmlt_code', 'c.lab_catalog_tmlt', 'g.no_lab_catalog', other)} AS lab_catalog_tmlt_check,
  coalesce(CASE n.sks_coverage_price = n.special WHEN true THEN 'Y' WHEN false THEN 'N' END, '') AS sks_price_check
FROM (
  SELECT {code}, {name}, {icode}, {price}, tmlt_code, no_lab_catalog,
    (SELECT max(w.lab_items_group_name) FROM lab_items_group w WHERE w.lab_items_group_code = own.{group}) AS in_group
  FROM {table} own WHERE {active}) g
LEFT JOIN (
  SELECT item.*, (SELECT max(s.price) FROM pttype_items_price s WHERE s.pttype = '*1' AND s.items_table_code = item.icode) AS special
  FROM nondrugitems item) n ON n.icode = g.{icode}
LEFT JOIN (SELECT DISTINCT lab_catalog_lc_code, lab_catalog_tmlt, lab_catalog_name FROM lab_catalog_import_detail) c
  ON c.lab_catalog_lc_code = g.{icode}"""


def _name(table: str, key: str, shown: str, own: str) -> str:
    """The name that a code of ``x`` has in a list."""
    return f"(SELECT max(w.{shown}) FROM {table} w WHERE w.{key} = x.{own})"


def _drug(price: str, extra: str = "") -> str:
    checked = ck(sks_price=has("d.sks_price"), sks_product_category_name=text("d.sks_product_category_name"),
                 sks_claim_control_type_name=text("d.sks_claim_control_type_name"), sks_drug_code=text("d.sks_drug_code"))
    shown = "icode drugname strength units unitprice dosageform generic_name trade_name income_name sks_price " \
        "sks_product_category_name sks_claim_control_type_name sks_drug_code"
    columns = ", ".join(f"d.{c}" for c in (*shown.split(), *extra.split()))
    return f"""
SELECT {columns}, {checked}
FROM (
  SELECT x.* REPLACE (x.{price} AS sks_price), x.name AS drugname,
    {_name('income', 'income', 'name', 'income')} AS income_name,
    {_name('sks_product_category', 'sks_product_category_id', 'sks_product_category_name', 'sks_product_category_id')}
      AS sks_product_category_name,
    {_name('sks_claim_control_type', 'sks_claim_control_type_id', 'sks_claim_control_type_name', 'sks_clain_control_type_id')}
      AS sks_claim_control_type_name,
    {_name('nhso_adp_type', 'nhso_adp_type_id', 'nhso_adp_type_name', 'nhso_adp_type_id')} AS nhso_adp_type_name
  FROM drugitems x WHERE x.istatus = 'Y') d"""


def _matched(table: str, columns: str, own: str, other: str, key: str, flag: str) -> str:
    return f"SELECT {columns}, {yn(f'x.{own} = v.{key}')} AS {flag}_check FROM {table} x LEFT JOIN {other} v ON v.{key} = x.{own}"


def _procedure(table: str, columns: str, icd9: str, flag: str, where: str, more: str = "") -> str:
    return f"""
SELECT {columns}, n.name AS nonname, {yn("x.icode <> '' AND x.icode = n.icode")} AS price_check,
  {yn(f'x.{icd9} = m.code')} AS {flag}_check{more}
FROM {table} x LEFT JOIN nondrugitems n ON n.icode = x.icode LEFT JOIN icd9cm1 m ON m.code = x.{icd9}
WHERE x.active_status = 'Y'{where}"""


_OPERATION = " AND n.income = '11'"


def _switch(column: str, flag: str) -> str:
    return f", x.{column}, {yn(f'''x.{column} = 'Y' ''')} AS {flag}_check"


def _plain(name: str, all_columns: dict[str, list[str]]) -> str:
    table, names, condition, _ = PLAIN_LISTS[name]
    shown = sorted(all_columns[table]) if names == "*" else names.split()
    row = ", ".join(f"CAST({c} AS VARCHAR)" for c in shown)
    return f"SELECT '{name}' AS list, concat_ws('|', {row}) AS row FROM {table}" + (f" WHERE {condition}" if condition else "")


_ALL_COLUMNS = {
    "drugcat": ["drugcat_id", "drugcat_name", "drug_usage_type_id"],
    "lab_catalog": ["lab_catalog_lc_code", "lab_catalog_lc_name", "lab_catalog_group_code"],
    "ipt_accident_type": ["accident_type_id", "accident_type_name"],
    "ipt_accident_ae_type": ["accident_ae_type_id", "accident_ae_type_name"],
    "ipt_accident_emtype": ["accident_emtype_id", "accident_emtype_name"],
}

_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in ADP_TYPE_BY_CHARGE_ITEM.items())

SQL = {
    "check_doctor": f"""
WITH s AS (
  SELECT d.*, q.name AS p_name, d.position_id IN (SELECT position_id FROM position_check) AS listed,
    d.licenseno LIKE '-99999%' AS exempt
  FROM doctor d LEFT JOIN doctor_position q ON q.id = d.position_id
  WHERE d.active = 'Y' AND d.name NOT LIKE '%BMS%' AND d.name NOT LIKE '%bms%'),
f AS (
  SELECT s.*, CASE WHEN NOT listed THEN 'Y' WHEN {_like('licenseno', 'พ', 'ว', 'ภ', 'ท', '-')} THEN 'Y' ELSE 'N' END AS one,
    CASE WHEN listed AND {_like('licenseno', 'พ.', 'ว.', 'ภ.', 'ท.', 'ก', 'พป', 'พทน')} THEN 'N' ELSE 'Y' END AS two FROM s)
SELECT position_id, p_name, licenseno, code, name AS d_name, cid, pname, fname, lname,
  {yn("(one = 'Y' OR exempt) AND two = 'Y'")} AS licenseno_check, {yn("two = 'Y' OR exempt")} AS licenseno_check2,
  CASE WHEN cid = '' OR cid IS NULL OR length(cid) <> 13 THEN 'N' ELSE 'Y' END AS cid_check,
  CASE WHEN pname = '' OR pname IS NULL OR pname NOT IN (SELECT name FROM pname) THEN 'N' ELSE 'Y' END AS pname_check
FROM f""",
    "check_pttype_csop": _scheme("OFC", "O", "'2'", "'1'"),
    "check_pttype_ssop": _scheme("SSS", "S", "'4', '8'", "'7', '8', '9', '10'"),
    "check_pttype_fdh": f"""
SELECT s.pttype, s.name, s.pcode, s.hipdata_code, s.nhso_code, s.grouper_version, s.print_presc_ned, s.export_eclaim,
  s.default_request_funds, s.finance_round_money, s.inc_round_money, s.round_money,
  {ck(drg_group="s.grouper_version = '6'", print_presc_ned="s.print_presc_ned = 'Y'", export_eclaim="s.export_eclaim = 'Y'",
      default_request_funds="s.default_request_funds = 'Y'")}, {_off('s', *_ROUND)}
FROM pttype s WHERE s.isuse = 'Y' AND s.hipdata_code IN ('UCS', 'WEL') AND s.paidst = '02'""",
    "check_income": f"""
SELECT i.income, i.name AS income_name, i.group2, a.group_name AS income_group2, {yn(has('i.group2'))} AS income_group2_check,
  i.drg_group, b.drg_group_name, i.income_sss_group_code, c.name AS sss_name, i.std_group, d.name AS sks_opd,
  i.income_csmbs_code, e.income_csmbs_name AS sks_ipd, i.nk2_group AS nk2_group_code, f.name AS nk2_group,
  i.drg_chrgitem_id, g.drg_chrgitem_name AS eclaim, i.rvsp_group, h.rvsp_name
FROM income i LEFT JOIN income_report2 a ON a.group_id = i.group2 LEFT JOIN drg_group b ON b.drg_group = i.drg_group
LEFT JOIN income_report_sss c ON c.code = i.income_sss_group_code LEFT JOIN income_std_group d ON d.std_group = i.std_group
LEFT JOIN income_csmbs e ON e.income_csmbs_code = i.income_csmbs_code LEFT JOIN income_nk2 f ON f.nk2_group = i.nk2_group
LEFT JOIN drg_chrgitem g ON g.drg_chrgitem_id = i.drg_chrgitem_id LEFT JOIN income_rvsp_group h ON h.rvsp_group = i.rvsp_group""",
    "check_nondrug": f"""
SELECT n.icode, n.name, {_CLEAN}, n.unit, n.price, n.billcode, n.income, i.name AS income_name, n.nhso_adp_type_id,
  a.nhso_adp_type_name, b.nhso_adp_code, n.sks_product_category_id, c.sks_product_category_name,
  {ck(sks_product_category="n.sks_product_category_id IN ('6', '7')")}, n.sks_coverage_price, n.enable_sks_opd
{_ITEMS} LEFT JOIN nhso_adp_code b ON b.nhso_adp_code = n.nhso_adp_code
LEFT JOIN sks_product_category c ON c.sks_product_category_id = n.sks_product_category_id WHERE n.istatus = 'Y'""",
    "check_nondrug_fdh": f"""
SELECT n.icode, n.name, {_CLEAN}, n.unit, n.price, n.billcode, n.income, i.name AS income_name, a.nhso_adp_type_name,
  {yn(f"(i.drg_chrgitem_id, n.nhso_adp_type_id) IN ({_PAIRS})")} AS check_adp_type, n.nhso_adp_type_id, n.nhso_adp_code,
  n.sks_coverage_price, n.enable_sks_opd, n.income_phdb_code, {yn("n.income_phdb_code <> ''")} AS check_phdb
{_ITEMS} WHERE n.istatus = 'Y'""",
    "check_lab": _lab(
        "lab_items_sub_group", "lab_items_sub_group_code", "lab_items_sub_group_name", "group_icode", "group_price",
        "lab_items_group_code", "coalesce(own.active_status, '') IN ('Y', '')", "Profile",
    )
    + "\nUNION ALL"
    + _lab(
        "lab_items", "lab_items_code", "lab_items_name", "icode", "service_price", "lab_items_group", "own.active_status = 'Y'", "Item"
    ),
    "check_bloodbank": f"""
SELECT x.blb_bloodbank_items_id AS bloodbank_id, x.blb_bloodbank_items_name AS bloodbank_name, x.icode AS bloodbank_icode,
  x.blb_bloodbank_items_unit AS bloodbank_unit, x.tmlt_code AS bloodbank_tmlt, entry.lab_catalog_lc_code AS lab_catalog_icode,
  entry.lab_catalog_tmlt, entry.lab_catalog_name, {_name('nondrugitems', 'icode', 'name', 'icode')} AS nondrug_name,
  test.no_lab_catalog, {ck(bloodbank_tmlt=text('x.tmlt_code'), lab_catalog_icode=text('entry.lab_catalog_lc_code'),
                           lab_catalog_tmlt=text('entry.lab_catalog_tmlt'))}
FROM (SELECT DISTINCT * FROM blb_bloodbank_items WHERE active = 'Y') x
LEFT JOIN (SELECT DISTINCT icode, no_lab_catalog FROM lab_items) test USING (icode)
LEFT JOIN (SELECT DISTINCT * FROM lab_catalog_import_detail) entry ON entry.lab_catalog_lc_code = x.icode""",
    "check_xray": f"""
SELECT x.xray_items_code AS xray_code, x.xray_items_name AS xray_name, x.exposure_qty, x.service_price AS price,
  x.icode AS xray_icode, n.icode AS n_icode, {ck(n_icode=has('n.icode'))}, n.name AS n_name, n.billcode
FROM xray_items x LEFT JOIN nondrugitems n ON n.icode = x.icode WHERE x.active_status = 'Y'""",
    "check_drug": _drug("sks_price"),
    "check_drug_reimb": _drug("sks_reimb_price"),
    "check_drug_fdh": _drug("sks_price", "csmbs_claim_cat nhso_adp_type_name nhso_adp_code ttmt_code"),
    "check_icd10tm": f"""
SELECT o.code, c.code AS icd10_sks, {yn(text('c.code'))} AS cut_check, {yn(text('o.code'))} AS import_check
FROM ovst_sks_icd10tm o LEFT JOIN sks_icd10tm_check c ON c.code = o.code""",
    "check_opd_procedure": f"SELECT er_oper_code, name, {flags(er_oper_code=text('er_oper_code'), name=text('name'))} FROM er_oper",
    "check_or_operation": f"SELECT oper_code, name, {flags(oper_code=text('oper_code'), name=text('name'))} FROM operation_item",
    "check_pname": _matched("pname", "x.name, v.provis_pname_long_name, x.sex, x.provis_code", "provis_code", "provis_pname", "provis_pname_code", "pname"),
    "check_nationality": f"""
SELECT x.nationality, x.name, x.nhso_code, {yn('x.nhso_code = v.code AND x.name = v.name')} AS nationality_check
FROM nationality x LEFT JOIN provis_nation v ON v.code = x.nhso_code""",
    "check_marrystatus": _matched("marrystatus", "x.code, x.name, x.nhso_marriage_code", "nhso_marriage_code", "provis_mstatus", "code", "marry"),
    "check_occupation": _matched("occupation", "x.name, x.occupation, x.nhso_code", "nhso_code", "provis_occupa", "code", "occupa"),
    "check_religion": _matched("religion", "x.religion, x.name, v.code AS provis_code, v.name AS provis_name, x.nhso_code", "nhso_code", "provis_religion", "code", "religion"),
    "check_spclty": f"""
SELECT spclty, name, provis_code, nhso_code, {yn("provis_code <> '' OR length(provis_code) = 5")} AS provis_check,
  {yn("nhso_code <> ''")} AS nhso_check FROM spclty""",
    "check_dchtype": f"""SELECT dchtype, name, nhso_dchtype, {yn("nhso_dchtype <> ''")} AS dchtype_check FROM dchtype""",
    "check_dchstts": f"""SELECT dchstts, name, nhso_dchstts, {yn("nhso_dchstts <> ''")} AS dchstts_check FROM dchstts""",
    "check_diagtype": _matched("diagtype", "x.diagtype, x.nhso_code, x.name", "nhso_code", "provis_diagtype", "code", "diagtype"),
    "check_er_oper": _procedure("er_oper_code", "x.er_oper_code, x.name, n.price, x.icd9cm", "icd9cm", "icd9cm", _OPERATION, _switch("export_proced", "export_proced")),
    "check_ipt_oper": _procedure("ipt_oper_code", "x.ipt_oper_code, x.name, n.price, x.icd9cm", "icd9cm", "icd9cm", _OPERATION),
    "check_operation_item": _procedure("operation_item", "x.operation_item_id, x.name, n.price, x.icd9", "icd9", "icd9cm", _OPERATION),
    "check_physic": _procedure(
        "physic_items", "x.physic_items_id, x.name, x.price, x.icd9, x.f43_rehab_code", "icd9", "icd9", "",
        f""", {yn("x.f43_rehab_code <> ''")} AS export43_check""" + _switch("icd9_ipd_active_status", "ipd_active"),
    ),
    "check_health_med": f"""
SELECT x.health_med_operation_item_id, x.health_med_operation_item_name, x.price,
  {_name('nondrugitems', 'icode', 'name', 'icode')} AS nonname, x.icd10tm, x.organ_id,
  {ck(price="x.icode <> '' AND x.icode IN (SELECT icode FROM nondrugitems)", icd10tm=has('x.icd10tm'), organ=has('x.organ_id'))}
FROM (SELECT *, CASE WHEN health_med_operation_item_id IN (SELECT health_med_operation_item_id FROM health_med_operation_item_organ)
    THEN health_med_operation_item_id END AS organ_id FROM health_med_operation_item) x
WHERE x.health_med_operation_type_id IS NOT NULL""",
    "check_dental": _procedure("dttm", "x.code, x.name, x.opd_price1, x.icd9cm", "icd9cm", "icd9cm", "", _switch("export_eclaim_icd10tm", "export_proced")),
    "check_thai_doctor": f"""
SELECT h.health_med_doctor_id, h.health_med_doctor_name, h.license_number, c.health_med_curriculum_name,
  l.health_med_license_type_name, {ck(licenseno="d.licenseno <> ''", doctor="h.doctor_code <> ''")}
FROM health_med_doctor h LEFT JOIN doctor d ON d.code = h.doctor_code
LEFT JOIN health_med_curriculum c ON c.health_med_curriculum_id = h.health_med_curriculum_id
LEFT JOIN health_med_license_type l ON l.health_med_license_type_id = h.health_med_license_type_id
WHERE d.provider_type_code IN ('081', '082', '084', '085') AND h.active_status = 'Y'""",
    "morphine_candidates": """
SELECT icode, name, strength, units, concat(name, ' ', strength, ' ', units) AS drugname FROM drugitems
WHERE istatus = 'Y' AND icode NOT IN (SELECT icode FROM drug_morphine)""",
    "morphine_list": """
SELECT m.drug_morphine_id, m.icode, m.name, m.strength, m.units, d.ttmt_code
FROM drug_morphine m LEFT JOIN drugitems d ON d.icode = m.icode""",
    "lookup_lists": "\nUNION ALL\n".join(_plain(name, _ALL_COLUMNS) for name in PLAIN_LISTS),
    "hipdata_groups": "SELECT hipdata_code FROM pttype WHERE isuse = 'Y' GROUP BY hipdata_code",
}
