"""Completeness rules, as text.

One line is ``section | table | condition | columns``.  In a condition,
``name=Y`` looks the column up under its aliases; any other term is SQL that
starts with its column.  ``column!0!0.00`` names values that count as missing
besides NULL and the empty text, and ``~column`` is shown but not scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# The short rule set.
BASIC_RULES = """
doctor   | doctor          | active=Y         | name pname fname lname licenseno cid position_id
officer  | officer         | officer_active=Y | officer_login_name officer_name officer_group_list_text officer_cid
pttype   | pttype          | isuse=Y          | name pcode paidst hipdata_code nhso_code grouper_release
clinic   | clinic          | active_status=Y  | name clinic_type_id chronic no_export
ward     | ward            | ward_active=Y    | name spclty
ward     | roomno          | active=Y         | name roomtype ward
drug     | drugitems       | istatus=Y        | name strength_name dosage_id units price1!0!0.00
lab      | lab_items       | isuse=Y          | lab_items_name lab_items_group lab_items_unit specimen_code
xray     | xray_items      | isuse=Y          | xray_items_name xray_items_group service_price!0!0.00
er_oper  | er_oper_code    | isuse=Y          | name icd9cm price!0!0.00
ipt_oper | ipt_oper_code   | isuse=Y          | name icd9cm price!0!0.00
blood    | blb_blood_items | isuse=Y          | blb_blood_items_name blb_blood_items_code blb_blood_items_price!0
"""

# The full rule set without the charge categories, which are generated.
FULL_RULES = """
doctor | doctor | active=Y | name pname fname lname
doctor | doctor | active=Y & position_id IN (1, 2, 11) | ename
doctor | doctor | active=Y | licenseno provider_type_code position_id cid active birth_date!0000-00-00
login | officer | officer_active=Y | officer_login_name officer_name officer_group_list_text officer_doctor_code
login | officer | officer_active=Y | officer_active officer_cid
login | officer_hospital_department | | officer_id
login | officer_department | | officer_id
ugroup | officer_group | | officer_group_name
pttype | pttype | isuse=Y | name pcode paidst isuse pttype_price_policy_type_id pttype_price_group_id
pttype | pttype | isuse=Y | hipdata_code nhso_code grouper_release
pttype | pttype | isuse=Y & hipdata_code IN ('OFC','SSS') | sks_benefit_plan_type_id
pttype | pttype | isuse=Y & noexpire='N' | noexpire
pttype | pttype | isuse=Y & hipdata_code IN ('OFC','SSS') & name NOT ILIKE '%ตรวจสุขภาพ%' | print_presc_ned!N
pttype | pttype | isuse=Y & hipdata_code IN ('OFC','SSS') | finance_round_money!Y
pttype | pttype_service_charge | | pttype
clinic | kskdepartment | depcode_active=Y | department hospital_department_id spclty depcode_active
clinic | clinic | active_status=Y | name clinic_type_id chronic app_limit_qty no_export active_status
clinic | spclty | active_status=Y | name no_export_43 no_service_charge active_status
ward | ward | ward_active=Y | name spclty ward_active
ward | roomno | active=Y | name roomtype
ward | roomno | active=Y & roomtype <> 6 | ward
ward | bedno | | roomno bed_status_type_id
ward | bedno | bed_status_type_id <> 3 | bedtype
ward | bedno | bed_status_type_id = 1 & roomno NOT IN roomno.roomno WHERE roomtype = 5 | room_charge_icode
mode2 | drugusage | status=Y | code status doctor_use shortlist common_name dosageform name1 ename1 opi_usage_code use_opi_mode2
mode3 | druguse | isuse=Y | druguse_name drugunit frequency drugtime dose
lab | lab_items | isuse=Y | lab_items_name lab_items_group lab_items_unit lab_items_normal_value lab_items_default_value
lab | lab_items | isuse=Y | critical_range_min_male critical_range_max_male critical_range_min_female critical_range_max_female
lab | lab_items | isuse=Y | critical_range_min_male2 critical_range_max_male2 critical_range_min_female2 critical_range_max_female2
lab | lab_items | isuse=Y | specimen_code display_order ecode result_type protect_result_by_user protect_result_by_group
xray | xray_items | isuse=Y | xray_items_name xray_items_group service_price!0!0.00 service_price_ipd!0!0.00
xray_form | xray_form_head | | name xray_group
blb | blb_blood_items | isuse=Y | blb_blood_items_name blb_blood_items_code blb_blood_items_icode blb_blood_recieve_icode
blb | blb_blood_items | isuse=Y | blb_blood_crossmatch_icode blb_blood_items_price!0!0.00
er_opd | er_oper_code | isuse=Y | name icd9cm icd10tm price!0!0.00 duration_minute search_keyword
er_er | er_oper_code | isuse=Y | name icd9cm icd10tm price!0!0.00 duration_minute search_keyword
ipt_ipd | ipt_oper_code | isuse=Y | name icd9cm price!0!0.00 use_opi_price ~is_investigation ~duration_minute ~search_keyword
proc_or | operation_item | isuse=Y | operation_group_id name icode icd9 keyword price!0!0.00 price_ipd!0!0.00
proc_anes | operation_anes_oper | isuse=Y | operation_anes_oper_name icode icd9
proc_dt | dttm | active_status=Y | name unit dttm_group_id icd10 icd9cm icode opd_price1!0!0.00 ipd_price1!0!0.00 treatment
proc_dt | dttm | active_status=Y | dt_treatment_type_id dttm_dw_report_group_id icd10tm_operation_code search_keyword active_status
proc_pt | physic_items | active_status=Y | name active_status icode physic_group_id physic_group_treatment_id physic_items_minute
proc_pt | physic_items | active_status=Y | price!0!0.00 icd9 f43_rehab_code
proc_tm | health_med_operation_item | active_status=Y | health_med_operation_item_name icode icd10tm health_med_operation_type_id
proc_tm | health_med_operation_item | active_status=Y | price!0!0.00 active_status search_keyword
checkup | checkup_group | | checkup_group_name company_id
vaccine | vaccine_item | | vaccine_name
vaccine | vaccine_lot | | lot_no
food | nutrition_food_type | | nutrition_food_type_name
food | nutrition_food_sub_type | | nutrition_food_sub_type_name nutrition_food_type_id
food | nutrition_food | | nutrition_food_name nutrition_food_sub_type_id active
food | nutrition_food_supply | | nutrition_food_supply_name
food | nutrition_food_sub_day | | nutrition_food_sub_day_name
food | nutrition_food_day | | nutrition_food_day_name nutrition_food_sub_day_id
food | nutrition_food_disease | | nutrition_food_disease_name
food | nutrition_food_special | | nutrition_food_special_name
nutri_consult | nutri_consult_screen_title | nutri_cs_screen_title_active=Y | nutri_cs_screen_title_name
nutri_consult | nutri_consult_report_title | nutri_cs_report_title_active=Y | nutri_cs_report_title_name
nutri_consult | nutri_consult_sub_type | | nutri_consult_sub_type_name nutri_consult_type_id
keyword | cc_text | | cc_name
keyword | hpi_text | | hpi_name
keyword | pe_text | | pe_name
"""

# Other names a column goes by, for the columns the rules name.
# A name that starts with * stands for any column with that ending.
COLUMN_ALIASES = {
    name: tuple(others.split())
    for name, others in {
        "fname": "officer_fname first_name name",
        "lname": "officer_lname last_name",
        "pname": "officer_pname prefix",
        "name": "officer_name full_name",
        "ename": "doctor_name_en name_en fullname_en doctor_ename",
        "birth_date": "birthday birthdate dob date_of_birth",
        "active": "is_active status use_status enabled istatus isuse officer_active ward_active depcode_active "
        "active_status lab_items_use xray_items_use",
        "officer_active": "active is_active status enabled isuse",
        "ward_active": "active is_active status enabled isuse",
        "depcode_active": "active is_active status enabled isuse",
        "active_status": "active is_active status enabled isuse",
        "isuse": "active is_active status use_status enabled active_status",
        "istatus": "use_status active is_active drug_status status enabled",
        "position_id": "position pos_id doctor_position_id",
        "cid": "citizen_id national_id id_card",
        "licenseno": "license_no license_number",
        "provider_type_code": "provider_type prov_type_code",
        "strength_name": "strength drug_strength",
        "dosage_id": "drug_dosage_id dosage_form_id",
        "lab_items_name": "lab_name item_name",
        "chronic": "is_chronic chronic_flag",
        "checkup_group_name": "name group_name",
        "company_id": "org_id organization_id",
        "vaccine_name": "name vaccine_item_name",
        "lot_no": "lot_number batch_no",
        "cc_name": "name chief_complaint",
        "hpi_name": "name hpi_text",
        "pe_name": "name pe_text",
        "druguse_name": "name druguse2_name",
        "drugunit": "unit drug_unit",
        "frequency": "freq drug_frequency",
        "drugtime": "time drug_time",
        "dose": "drug_dose dosage",
        "officer_group_name": "name group_name",
        "clinic_type_id": "*_clinic_type_id",
    }.items()
}

# Charge-category rules.
SURPLUS = "ส่วนเกิน"
SKIPPED_CATEGORIES = ("04", "20")
COPAY_CATEGORY = "18"
DRUG_CATEGORIES = ("03", "17")
COST_CATEGORIES = ("03", "04", "17", "20")
LINKED_CATEGORIES = ("01", "02")
ITEM_COLUMNS = (
    "income name ename price!0!0.00 unitcost!0!0.00 billcode nhso_adp_type_id nhso_adp_code enable_sks_opd enable_sks_ipd "
    "istatus unit no_remed"
)
COPAY_COLUMNS = ("income", "name", "ename", "price")
LINKED_COLUMNS = "income bill_code claim_amount!0!0.00 rev_date!0000-00-00"
DRUG_COLUMNS = (
    "name trade_name strength units dosageform generic_name name_print drugaccount drug_control_type_id tmt_gp_code "
    "tmt_tp_code ttmt_code thai_name sks_product_category_id sks_clain_control_type_id sks_drug_code"
)
THAI_MEDICINE_CATEGORY = "แผนไทย"

# Columns that say a row is in use, and columns to sort a table by.
STATUS_COLUMNS = "officer_active isuse istatus use_status active is_active status enabled".split()
CODE_COLUMNS = {
    table: tuple(names.split())
    for table, names in {
        "doctor": "doctor_code code",
        "officer": "officer_login_name officer_id",
        "pttype": "pttype pcode",
        "kskdepartment": "depcode department_id id",
        "clinic": "clinic code",
        "spclty": "spclty code",
        "ward": "ward code",
        "roomno": "roomno code",
        "bedno": "bedno bed_id id",
        "drugitems": "icode code",
        "nondrugitems": "icode code",
        "lab_items": "lab_items_code lab_items_id id",
        "xray_items": "xray_items_code code",
        "blb_blood_items": "blb_blood_items_code code id",
        "er_oper_code": "er_oper_code_id code id",
        "ipt_oper_code": "ipt_oper_code_id code id",
        "operation_item": "operation_item_id code id",
        "dttm": "dttm_id code id",
        "physic_items": "physic_items_id code id",
        "drugusage": "code drugusage_id id",
        "officer_group": "officer_group_id id",
        "health_med_operation_item": "health_med_operation_item_id id",
    }.items()
}


@dataclass(frozen=True)
class Rule:
    """One column of one table, checked over the rows that meet the terms."""

    section: str
    table: str
    column: str
    terms: tuple[str, ...] = ()
    sentinels: tuple[str, ...] = ()
    info: bool = False

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}"


def column_spec(spec: str) -> tuple[str, tuple[str, ...], bool]:
    """``~price!0!0.00`` -> name, sentinels, shown only."""
    name, *sentinels = spec.lstrip("~").split("!")
    return name, tuple(sentinels), spec.startswith("~")


def parse_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.strip().splitlines():
        section, table, condition, columns = (part.strip() for part in line.split("|"))
        terms = tuple(t.strip() for t in condition.split("&") if t.strip())
        for spec in columns.split():
            column, sentinels, info = column_spec(spec)
            rules.append(Rule(section, table, column, terms, sentinels, info))
    return rules


LOOKUP_TERM = re.compile(r"^\w+=\w+$")
MEMBER_TERM = re.compile(r"^(?P<column>\w+) (?P<word>NOT IN|IN) (?P<table>\w+)\.(?P<key>\w+) WHERE (?P<where>.+)$")
