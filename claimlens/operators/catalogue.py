"""Catalogue checks: each item with what its reference lists say about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.flags import checks, filled, join_text, known, nonempty, picks, yn
from claimlens.operators.rules import not_in, with_membership
from claimlens.operators.scope import link
from claimlens.params import Params
from claimlens.sources.tables import Tables

# Characters a claim file cannot carry in an item name.
FORBIDDEN_IN_NAME = "[\\r\\n<>\"'&]"
# Licence texts by position rule (Thai profession letters).
LICENCE_STARTS = ("พ", "ว", "ภ", "ท", "-")
LICENCE_WRONG_STARTS = ("พ.", "ว.", "ภ.", "ท.", "ก", "พป", "พทน")
LICENCE_EXEMPT = "-99999"
# National item type that belongs to each charge item.
ADP_TYPE_BY_CHARGE_ITEM = {
    "1": "10", "2": "2", "5": "11", "6": "14", "7": "15", "8": "16", "9": "9", "10": "18", "11": "19",
    "12": "17", "13": "12", "14": "20", "15": "13", "16": "19", "17": "3", "18": "4", "19": "3",
}
NOT_LINKED = "ไม่ผูกค่าใช้จ่าย"
OPERATION_INCOME = "11"
THAI_MEDICINE_PROVIDERS = ("081", "082", "084", "085")


def _starts(column: str, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | F.col(column).startswith(prefix)
    return found


def suffixed(**conditions: Column) -> list[Column]:
    return checks(prefix="", suffix="_check", **conditions)


def _inverted(name: str) -> Column:
    """A switch that has to be off: 'N' only where it is 'Y'."""
    return F.when(F.col(name) == "Y", "N").otherwise("Y")


# -- staff and schemes ---------------------------------------------------------


def check_doctor(t: Tables, p: Params | None = None) -> DataFrame:
    """Licence number by position, citizen number and title of active staff."""
    staff = t["doctor"].where("active = 'Y' AND name NOT LIKE '%BMS%' AND name NOT LIKE '%bms%'")
    staff = with_membership(staff, "position_id", t["position_check"], "position_id", "needs_licence")
    staff = with_membership(staff, "pname", t["pname"], "name", "known_title")
    rows = link(staff.alias("d"), t["doctor_position"], "dp", "dp.id = d.position_id")
    needs = F.col("d.needs_licence")
    form_ok = F.coalesce(~needs, F.lit(False)) | F.coalesce(_starts("d.licenseno", LICENCE_STARTS), F.lit(False))
    not_wrong = ~F.coalesce(needs & _starts("d.licenseno", LICENCE_WRONG_STARTS), F.lit(False))
    exempt = F.coalesce(F.col("d.licenseno").startswith(LICENCE_EXEMPT), F.lit(False))
    return rows.select(
        *picks("d.position_id, dp.name AS p_name, d.licenseno, d.code, d.name AS d_name, d.cid, d.pname, d.fname, d.lname"),
        *suffixed(licenseno=(form_ok | exempt) & not_wrong, cid=filled("d.cid") & (F.length("d.cid") == 13)),
        yn(not_wrong | exempt).alias("licenseno_check2"),
        yn(filled("d.pname") & F.coalesce(F.col("d.known_title"), F.lit(True))).alias("pname_check"),
    )


_ROUNDING = ("finance_round_money", "inc_round_money", "round_money")


def _check_scheme(t: Tables, group: str, code_prefix: str, plans: Sequence[str], types: Sequence[str]) -> DataFrame:
    schemes = t["pttype"].where("isuse = 'Y' AND paidst = '02'")
    schemes = schemes.where((F.col("hipdata_code") == group) & F.col("nhso_code").ilike(f"{code_prefix}%"))
    rows = link(schemes.alias("s"), t["sks_benefit_plan_type"], "b", "b.sks_benefit_plan_type_id = s.sks_benefit_plan_type_id")
    rows = link(rows, t["pttype_upp_type"], "u", "u.pttype_upp_type_id = s.pttype_upp_type_id")
    return rows.select(
        *picks(
            "s.pttype, s.name AS pttype_name, s.pcode, s.hipdata_code, s.nhso_code AS inscl, s.grouper_version AS drg_group, "
            "s.print_presc_ned, s.sks_benefit_plan_type_id, b.sks_benefit_plan_type_name, b.sks_code, s.pttype_upp_type_id, "
            "u.pttype_upp_type_name, s.finance_round_money, s.inc_round_money, s.round_money"
        ),
        *suffixed(
            drg_group=F.col("s.grouper_version") == "6",
            print_presc_ned=F.col("s.print_presc_ned") == "Y",
            sks_benefit_plan_type_id=F.col("s.sks_benefit_plan_type_id").cast("string").isin(*plans),
            pttype_upp_type_id=F.col("s.pttype_upp_type_id").cast("string").isin(*types),
        ),
        *[_inverted(f"s.{c}").alias(f"{c}_check") for c in _ROUNDING],
    )


def check_pttype_csop(t: Tables, p: Params | None = None) -> DataFrame:
    """Civil-servant schemes: grouper, plan, type, and rounding switched off."""
    return _check_scheme(t, "OFC", "O", ("2",), ("1",))


def check_pttype_ssop(t: Tables, p: Params | None = None) -> DataFrame:
    """Social-security schemes under their own plans and types."""
    return _check_scheme(t, "SSS", "S", ("4", "8"), ("7", "8", "9", "10"))


def check_pttype_fdh(t: Tables, p: Params | None = None) -> DataFrame:
    """Universal-coverage schemes, with export and request switches."""
    schemes = t["pttype"].where("isuse = 'Y' AND hipdata_code IN ('UCS', 'WEL') AND paidst = '02'")
    return schemes.select(
        *picks(
            "pttype, name, pcode, hipdata_code, nhso_code, grouper_version, print_presc_ned, export_eclaim, "
            "default_request_funds, finance_round_money, inc_round_money, round_money"
        ),
        *suffixed(
            drg_group=F.col("grouper_version") == "6",
            **{c: F.col(c) == "Y" for c in ("print_presc_ned", "export_eclaim", "default_request_funds")},
        ),
        *[_inverted(c).alias(f"{c}_check") for c in _ROUNDING],
    )


# -- charge categories and items -----------------------------------------------

# mapping column of the income table, list, its key, its name, output column
_INCOME_LISTS = [
    ("group2", "income_report2", "group_id", "group_name", "income_group2"),
    ("drg_group", "drg_group", "drg_group", "drg_group_name", "drg_group_name"),
    ("income_sss_group_code", "income_report_sss", "code", "name", "sss_name"),
    ("std_group", "income_std_group", "std_group", "name", "sks_opd"),
    ("income_csmbs_code", "income_csmbs", "income_csmbs_code", "income_csmbs_name", "sks_ipd"),
    ("nk2_group", "income_nk2", "nk2_group", "name", "nk2_group"),
    ("drg_chrgitem_id", "drg_chrgitem", "drg_chrgitem_id", "drg_chrgitem_name", "eclaim"),
    ("rvsp_group", "income_rvsp_group", "rvsp_group", "rvsp_name", "rvsp_name"),
]


def check_income(t: Tables, p: Params | None = None) -> DataFrame:
    """Charge categories with the names of their eight mappings."""
    rows = t["income"].alias("i")
    names = []
    for n, (column, table, key, name, out) in enumerate(_INCOME_LISTS):
        rows = link(rows, t[table].select(key, name), f"m{n}", f"m{n}.{key} = i.{column}")
        names.append(F.col(f"m{n}.{name}").alias(out))
    return rows.select(
        *picks(
            "i.income, i.name AS income_name, i.group2, i.drg_group, i.income_sss_group_code, i.std_group, i.income_csmbs_code, "
            "i.nk2_group AS nk2_group_code, i.drg_chrgitem_id, i.rvsp_group"
        ),
        *names,
        *suffixed(income_group2=known("i.group2")),
    )


def _active_items(t: Tables) -> DataFrame:
    rows = link(t["nondrugitems"].where("istatus = 'Y'").alias("n"), t["income"], "i", "i.income = n.income")
    return link(rows, t["nhso_adp_type"], "ty", "ty.nhso_adp_type_id = n.nhso_adp_type_id")


def _clean_name(column: str) -> Column:
    return F.when(F.col(column).rlike(FORBIDDEN_IN_NAME), "N").otherwise("Y")


def check_nondrug(t: Tables, p: Params | None = None) -> DataFrame:
    """Service items: clean name, product category 6 or 7."""
    rows = link(_active_items(t), t["nhso_adp_code"], "ac", "ac.nhso_adp_code = n.nhso_adp_code")
    rows = link(rows, t["sks_product_category"], "c", "c.sks_product_category_id = n.sks_product_category_id")
    return rows.select(
        *picks(
            "n.icode, n.name, n.unit, n.price, n.billcode, n.income, i.name AS income_name, n.nhso_adp_type_id, "
            "ty.nhso_adp_type_name, ac.nhso_adp_code, n.sks_product_category_id, c.sks_product_category_name, "
            "n.sks_coverage_price, n.enable_sks_opd"
        ),
        _clean_name("n.name").alias("name_check"),
        *suffixed(sks_product_category=F.col("n.sks_product_category_id").cast("string").isin("6", "7")),
    )


def check_nondrug_fdh(t: Tables, p: Params | None = None) -> DataFrame:
    """Service items: clean name, item type that fits the charge item, public-health code."""
    pairs = F.create_map(*[F.lit(x) for pair in ADP_TYPE_BY_CHARGE_ITEM.items() for x in pair])
    fits = pairs[F.col("i.drg_chrgitem_id").cast("string")] == F.col("n.nhso_adp_type_id").cast("string")
    return _active_items(t).select(
        *picks(
            "n.icode, n.name, n.unit, n.price, n.billcode, n.income, i.name AS income_name, ty.nhso_adp_type_name, "
            "n.nhso_adp_type_id, n.nhso_adp_code, n.sks_coverage_price, n.enable_sks_opd, n.income_phdb_code"
        ),
        _clean_name("n.name").alias("name_check"),
        *checks(adp_type=fits, phdb=nonempty("n.income_phdb_code")),
    )


# -- laboratory, blood bank, imaging -------------------------------------------


def _catalogue_state(own: str, catalogue: str, opt_out: str, otherwise: str) -> Column:
    """Linked ('Y'), rightly not linked ('Y'), link missing ('N'), or undecided."""
    mine, theirs, out = F.col(own), F.col(catalogue), F.col(opt_out)
    linked = filled(mine) & filled(theirs) & out.isNull()
    opted_out = mine.isNull() & theirs.isNull() & (out == "Y")
    unlinked = filled(mine) & ~filled(theirs) & out.isNull()
    return F.when(linked | opted_out, "Y").when(unlinked, "N").otherwise(otherwise)


def check_lab(t: Tables, p: Params | None = None) -> DataFrame:
    """Test profiles and single tests against the national catalogue and the payer's price."""
    prices = t["pttype_items_price"].where("pttype = '*1'")

    def layout(tests: DataFrame, otherwise: str, kind: str) -> DataFrame:
        rows = link(tests.alias("g"), t["lab_items_group"], "lg", "lg.lab_items_group_code = g.grp")
        rows = link(rows, t["lab_catalog_import_detail"], "lc", "lc.lab_catalog_lc_code = g.icode")
        rows = link(rows, t["nondrugitems"], "n", "n.icode = g.icode")
        rows = link(rows, prices, "pr", "pr.items_table_code = n.icode")
        covered, price = F.col("n.sks_coverage_price"), F.col("pr.price")

        def shown(column: str) -> Column:
            value = F.col(column)
            return value if kind == "Profile" else F.when(filled(value), value).otherwise(NOT_LINKED)

        return rows.select(
            *picks(
                "lg.lab_items_group_name, g.code AS lab_code, lc.lab_catalog_lc_code AS lab_catalog_icode, g.no_lab_catalog, "
                "g.name AS lab_name, g.price, lc.lab_catalog_tmlt, lc.lab_catalog_name, n.name AS nondrug_name, "
                "n.sks_coverage_price, pr.price AS pttype_price"
            ),
            shown("g.icode").alias("lab_icode"),
            shown("g.tmlt_code").alias("lab_tmlt"),
            F.lit(kind).alias("lab_type"),
            _catalogue_state("g.icode", "lc.lab_catalog_lc_code", "g.no_lab_catalog", otherwise).alias("lab_catalog_icode_check"),
            _catalogue_state("g.tmlt_code", "lc.lab_catalog_tmlt", "g.no_lab_catalog", otherwise).alias("lab_catalog_tmlt_check"),
            F.when(covered.isNull() | price.isNull(), "").when(covered != price, "N").otherwise("Y").alias("sks_price_check"),
        )

    profiles = t["lab_items_sub_group"].where("active_status = 'Y' OR active_status IS NULL OR active_status = ''")
    profiles = profiles.select(
        *picks(
            "lab_items_sub_group_code AS code, lab_items_sub_group_name AS name, group_icode AS icode, group_price AS price, "
            "tmlt_code, no_lab_catalog, lab_items_group_code AS grp"
        )
    )
    items = t["lab_items"].where("active_status = 'Y'")
    items = items.select(
        *picks(
            "lab_items_code AS code, lab_items_name AS name, icode, service_price AS price, tmlt_code, no_lab_catalog, "
            "lab_items_group AS grp"
        )
    )
    return layout(profiles, "", "Profile").unionByName(layout(items, "Y", "Item"))


def check_bloodbank(t: Tables, p: Params | None = None) -> DataFrame:
    """Blood-bank items with test code and catalogue codes, without repeats."""
    rows = link(t["blb_bloodbank_items"].where("active = 'Y'").alias("b"), t["lab_catalog_import_detail"], "lc", "lc.lab_catalog_lc_code = b.icode")
    rows = link(rows, t["nondrugitems"], "n", "n.icode = b.icode")
    rows = link(rows, t["lab_items"], "li", "li.icode = b.icode")
    return rows.select(
        *picks(
            "b.blb_bloodbank_items_id AS bloodbank_id, b.blb_bloodbank_items_name AS bloodbank_name, b.icode AS bloodbank_icode, "
            "b.blb_bloodbank_items_unit AS bloodbank_unit, b.tmlt_code AS bloodbank_tmlt, "
            "lc.lab_catalog_lc_code AS lab_catalog_icode, lc.lab_catalog_tmlt, lc.lab_catalog_name, n.name AS nondrug_name, "
            "li.no_lab_catalog"
        ),
        *suffixed(
            bloodbank_tmlt=filled("b.tmlt_code"),
            lab_catalog_icode=filled("lc.lab_catalog_lc_code"),
            lab_catalog_tmlt=filled("lc.lab_catalog_tmlt"),
        ),
    ).dropDuplicates()


def check_xray(t: Tables, p: Params | None = None) -> DataFrame:
    """Imaging items whose charge item exists."""
    rows = link(t["xray_items"].where("active_status = 'Y'").alias("x"), t["nondrugitems"], "n", "n.icode = x.icode")
    return rows.select(
        *picks(
            "x.xray_items_code AS xray_code, x.xray_items_name AS xray_name, x.exposure_qty, x.service_price AS price, "
            "x.icode AS xray_icode, n.icode AS n_icode, n.name AS n_name, n.billcode"
        ),
        *suffixed(n_icode=known("n.icode")),
    )


# -- drugs ---------------------------------------------------------------------


def check_drug(t: Tables, p: Params | None = None, price: str = "sks_price", extra: str = "") -> DataFrame:
    """Active drugs: price, product category, claim control and drug code given."""
    rows = link(t["drugitems"].where("istatus = 'Y'").alias("d"), t["sks_product_category"], "c", "c.sks_product_category_id = d.sks_product_category_id")
    rows = link(rows, t["sks_claim_control_type"], "k", "k.sks_claim_control_type_id = d.sks_clain_control_type_id")
    rows = link(rows, t["income"], "i", "i.income = d.income")
    if extra:
        rows = link(rows, t["nhso_adp_type"], "ty", "ty.nhso_adp_type_id = d.nhso_adp_type_id")
    return rows.select(
        *picks(
            "d.icode, d.name AS drugname, d.strength, d.units, d.unitprice, d.dosageform, d.generic_name, d.trade_name, "
            f"i.name AS income_name, d.{price} AS sks_price, c.sks_product_category_name, k.sks_claim_control_type_name, "
            f"d.sks_drug_code{extra}"
        ),
        *suffixed(
            sks_price=known(f"d.{price}"),
            sks_product_category_name=filled("c.sks_product_category_name"),
            sks_claim_control_type_name=filled("k.sks_claim_control_type_name"),
            sks_drug_code=filled("d.sks_drug_code"),
        ),
    )


def check_drug_reimb(t: Tables, p: Params | None = None) -> DataFrame:
    return check_drug(t, p, price="sks_reimb_price")


def check_drug_fdh(t: Tables, p: Params | None = None) -> DataFrame:
    return check_drug(t, p, extra=", d.csmbs_claim_cat, ty.nhso_adp_type_name, d.nhso_adp_code, d.ttmt_code")


def morphine_candidates(t: Tables, p: Params | None = None) -> DataFrame:
    """Active drugs that are not in the morphine list yet."""
    drugs = t["drugitems"].where("istatus = 'Y'").select("icode", "name", "strength", "units")
    blank = F.lit(" ")
    label = join_text(F.col("name"), blank, F.col("strength"), blank, F.col("units"))
    return not_in(drugs, "icode", t["drug_morphine"], "icode").withColumn("drugname", label)


def morphine_list(t: Tables, p: Params | None = None) -> DataFrame:
    """The morphine list with traditional-medicine codes."""
    rows = link(t["drug_morphine"].alias("m"), t["drugitems"], "d", "d.icode = m.icode")
    return rows.select(*picks("m.drug_morphine_id, m.icode, m.name, m.strength, m.units, d.ttmt_code"))


# -- code lists ----------------------------------------------------------------


def check_icd10tm(t: Tables, p: Params | None = None) -> DataFrame:
    """Diagnosis codes: present, and already imported."""
    rows = link(t["ovst_sks_icd10tm"].alias("o"), t["sks_icd10tm_check"], "c", "c.code = o.code")
    return rows.select(
        *picks("o.code, c.code AS icd10_sks"), *suffixed(cut=filled("c.code"), **{"import": filled("o.code")})
    )


def _code_and_name(t: Tables, table: str, code: str) -> DataFrame:
    return t[table].select(code, "name", *checks(**{code: filled(code), "name": filled("name")}))


def check_opd_procedure(t: Tables, p: Params | None = None) -> DataFrame:
    """Outpatient procedures with code and name."""
    return _code_and_name(t, "er_oper", "er_oper_code")


def check_or_operation(t: Tables, p: Params | None = None) -> DataFrame:
    """Operations with code and name."""
    return _code_and_name(t, "operation_item", "oper_code")


def check_pname(t: Tables, p: Params | None = None) -> DataFrame:
    """Titles whose national code exists."""
    rows = link(t["pname"].alias("p"), t["provis_pname"], "v", "v.provis_pname_code = p.provis_code")
    return rows.select(
        *picks("p.name, v.provis_pname_long_name, p.sex, p.provis_code"), *suffixed(pname=known("v.provis_pname_code"))
    )


def check_nationality(t: Tables, p: Params | None = None) -> DataFrame:
    """Nationalities whose code and name match the national list."""
    rows = link(t["nationality"].alias("n"), t["provis_nation"], "v", "v.code = n.nhso_code")
    return rows.select(
        *picks("n.nationality, n.name, n.nhso_code"), *suffixed(nationality=F.col("n.name") == F.col("v.name"))
    )


def check_marrystatus(t: Tables, p: Params | None = None) -> DataFrame:
    """Marital states whose code matches."""
    rows = link(t["marrystatus"].alias("m"), t["provis_mstatus"], "v", "v.code = m.nhso_marriage_code")
    return rows.select(*picks("m.code, m.name, m.nhso_marriage_code"), *suffixed(marry=known("v.code")))


def check_occupation(t: Tables, p: Params | None = None) -> DataFrame:
    """Occupations whose code matches."""
    rows = link(t["occupation"].alias("o"), t["provis_occupa"], "v", "v.code = o.nhso_code")
    return rows.select(*picks("o.name, o.occupation, o.nhso_code"), *suffixed(occupa=known("v.code")))


def check_religion(t: Tables, p: Params | None = None) -> DataFrame:
    """Religions whose code matches."""
    rows = link(t["religion"].alias("r"), t["provis_religion"], "v", "v.code = r.nhso_code")
    return rows.select(
        *picks("r.religion, r.name, v.code AS provis_code, v.name AS provis_name, r.nhso_code"),
        *suffixed(religion=known("v.code")),
    )


def check_spclty(t: Tables, p: Params | None = None) -> DataFrame:
    """Departments with a standard code and a national code."""
    standard = F.col("provis_code")
    return t["spclty"].select(
        *picks("spclty, name, provis_code, nhso_code"),
        *suffixed(provis=(standard != "") | (F.length(standard) == 5), nhso=nonempty("nhso_code")),
    )


def check_dchtype(t: Tables, p: Params | None = None) -> DataFrame:
    """Ways of discharge with a national code."""
    return t["dchtype"].select(*picks("dchtype, name, nhso_dchtype"), *suffixed(dchtype=nonempty("nhso_dchtype")))


def check_dchstts(t: Tables, p: Params | None = None) -> DataFrame:
    """Discharge states with a national code."""
    return t["dchstts"].select(*picks("dchstts, name, nhso_dchstts"), *suffixed(dchstts=nonempty("nhso_dchstts")))


def check_diagtype(t: Tables, p: Params | None = None) -> DataFrame:
    """Diagnosis types whose code matches."""
    rows = link(t["diagtype"].alias("d"), t["provis_diagtype"], "v", "v.code = d.nhso_code")
    return rows.select(*picks("d.diagtype, d.nhso_code, d.name"), *suffixed(diagtype=known("v.code")))


# -- procedures ----------------------------------------------------------------


def _charged(procedures: DataFrame, t: Tables, icd9: str | None, how: str = "left") -> DataFrame:
    """Procedures ``e`` with charge item ``n`` and, by ``icd9``, the procedure list ``m``."""
    items = t["nondrugitems"]
    if how == "inner":
        items = items.where(F.col("income") == OPERATION_INCOME)
    rows = link(procedures.alias("e"), items, "n", "n.icode = e.icode", how)
    return link(rows, t["icd9cm1"], "m", f"m.code = e.{icd9}") if icd9 else rows


def _priced() -> Column:
    return nonempty("e.icode") & known("n.icode")


def check_er_oper(t: Tables, p: Params | None = None) -> DataFrame:
    """Emergency procedures charged as operations: price, procedure code, export switch."""
    rows = _charged(t["er_oper_code"].where("active_status = 'Y'"), t, "icd9cm", "inner")
    return rows.select(
        *picks("e.er_oper_code, e.name, n.price, n.name AS nonname, e.icd9cm, e.export_proced"),
        *suffixed(price=_priced(), icd9cm=known("m.code"), export_proced=F.col("e.export_proced") == "Y"),
    )


def check_ipt_oper(t: Tables, p: Params | None = None) -> DataFrame:
    """Ward procedures: price and procedure code."""
    rows = _charged(t["ipt_oper_code"].where("active_status = 'Y'"), t, "icd9cm", "inner")
    return rows.select(
        *picks("e.ipt_oper_code, e.name, n.price, n.name AS nonname, e.icd9cm"),
        *suffixed(price=_priced(), icd9cm=known("m.code")),
    )


def check_operation_item(t: Tables, p: Params | None = None) -> DataFrame:
    """Theatre operations: price and procedure code."""
    rows = _charged(t["operation_item"].where("active_status = 'Y'"), t, "icd9", "inner")
    return rows.select(
        *picks("e.operation_item_id, e.name, n.price, n.name AS nonname, e.icd9"),
        *suffixed(price=_priced(), icd9cm=known("m.code")),
    )


def check_physic(t: Tables, p: Params | None = None) -> DataFrame:
    """Physiotherapy items: price, procedure code, rehabilitation code, ward switch."""
    rows = _charged(t["physic_items"].where("active_status = 'Y'"), t, "icd9")
    return rows.select(
        *picks("e.physic_items_id, e.name, e.price, n.name AS nonname, e.icd9, e.f43_rehab_code, e.icd9_ipd_active_status"),
        *suffixed(
            price=_priced(),
            export43=nonempty("e.f43_rehab_code"),
            icd9=known("m.code"),
            ipd_active=F.col("e.icd9_ipd_active_status") == "Y",
        ),
    )


def check_health_med(t: Tables, p: Params | None = None) -> DataFrame:
    """Traditional-medicine operations: price, code, and a mapped organ."""
    operations = t["health_med_operation_item"].where("health_med_operation_type_id IS NOT NULL")
    organs = t["health_med_operation_item_organ"].select("health_med_operation_item_id").distinct()
    rows = _charged(operations, t, None)
    rows = link(rows, t["health_med_operation_code"], "hc", "hc.icd10tm = e.icd10tm")
    rows = link(rows, organs, "r", "r.health_med_operation_item_id = e.health_med_operation_item_id")
    return rows.select(
        *picks(
            "e.health_med_operation_item_id, e.health_med_operation_item_name, e.price, n.name AS nonname, e.icd10tm, "
            "r.health_med_operation_item_id AS organ_id"
        ),
        *suffixed(price=_priced(), icd10tm=known("e.icd10tm"), organ=known("r.health_med_operation_item_id")),
    )


def check_dental(t: Tables, p: Params | None = None) -> DataFrame:
    """Dental treatments: price, procedure code, export switch."""
    rows = _charged(t["dttm"].where("active_status = 'Y'"), t, "icd9cm")
    return rows.select(
        *picks("e.code, e.name, e.opd_price1, n.name AS nonname, e.icd9cm, e.export_eclaim_icd10tm"),
        *suffixed(price=_priced(), icd9cm=known("m.code"), export_proced=F.col("e.export_eclaim_icd10tm") == "Y"),
    )


def check_thai_doctor(t: Tables, p: Params | None = None) -> DataFrame:
    """Traditional-medicine staff of four provider types: licence and staff link."""
    doctors = t["doctor"].where(F.col("provider_type_code").isin(*THAI_MEDICINE_PROVIDERS))
    rows = link(t["health_med_doctor"].where("active_status = 'Y'").alias("h"), doctors, "d", "d.code = h.doctor_code", "inner")
    rows = link(rows, t["health_med_curriculum"], "c", "c.health_med_curriculum_id = h.health_med_curriculum_id")
    rows = link(rows, t["health_med_license_type"], "l", "l.health_med_license_type_id = h.health_med_license_type_id")
    return rows.select(
        *picks(
            "h.health_med_doctor_id, h.health_med_doctor_name, h.license_number, c.health_med_curriculum_name, "
            "l.health_med_license_type_name"
        ),
        *suffixed(licenseno=nonempty("d.licenseno"), doctor=nonempty("h.doctor_code")),
    )


# -- plain lists ---------------------------------------------------------------

_IN_USE = "isuse = 'Y'"
# list -> (table, columns, condition, order); "*" keeps all columns
PLAIN_LISTS: dict[str, tuple[str, str, str | None, str | None]] = {
    "schemes": ("pttype", "pttype name", _IN_USE, "pttype"),
    "fdh_schemes": ("pttype", "pttype name hipdata_code", _IN_USE, "pttype"),
    "eclaim_schemes": ("pttype", "pttype name", _IN_USE + " AND hipdata_code IN ('UCS', 'WEL', 'LGO', 'OFC', 'STP', '')", "pttype"),
    "cipn_schemes": ("pttype", "pttype name", _IN_USE + " AND hipdata_code = 'OFC'", "name"),
    "doctor_positions": ("doctor_position", "id name", None, "name"),
    "pcodes": ("pcode", "pcode name", None, "pcode"),
    "inscl_codes": ("nhso_inscl_code", "inscl_code inscl_name", None, "inscl_code"),
    "benefit_plans": ("sks_benefit_plan_type", "sks_benefit_plan_type_id sks_benefit_plan_type_name", None, "sks_benefit_plan_type_id"),
    "plan_types": ("pttype_upp_type", "pttype_upp_type_id pttype_upp_type_name", None, "pttype_upp_type_id"),
    "income_groups": ("income_report2", "group_id group_name", None, "group_id"),
    "drg_groups": ("drg_group", "drg_group drg_group_name", None, "drg_group"),
    "sss_groups": ("income_report_sss", "code name", None, "code"),
    "std_groups": ("income_std_group", "std_group name", None, "std_group"),
    "csmbs_groups": ("income_csmbs", "income_csmbs_code income_csmbs_name", None, "income_csmbs_code"),
    "nk2_groups": ("income_nk2", "nk2_group name", None, "nk2_group"),
    "charge_items": ("drg_chrgitem", "drg_chrgitem_id drg_chrgitem_name", None, "drg_chrgitem_id"),
    "rvsp_groups": ("income_rvsp_group", "rvsp_group rvsp_name", None, "rvsp_group"),
    "incomes": ("income", "income name", None, "income"),
    "adp_types": ("nhso_adp_type", "nhso_adp_type_id nhso_adp_type_name", None, "nhso_adp_type_id"),
    "adp_codes": ("nhso_adp_code", "nhso_adp_code nhso_adp_code_name", None, "nhso_adp_code"),
    "product_categories": ("sks_product_category", "sks_product_category_id sks_product_category_name", None, "sks_product_category_id"),
    "sexes": ("sex", "code name", None, None),
    "drug_categories": ("drugcat", "*", None, "drugcat_id"),
    "lab_catalogue": ("lab_catalog", "*", None, "lab_catalog_lc_code"),
    "accident_types": ("ipt_accident_type", "*", None, None),
    "accident_cases": ("ipt_accident_ae_type", "*", None, None),
    "emergency_kinds": ("ipt_accident_emtype", "*", None, None),
    "checked_positions": ("position_check", "position_check_id position_id position_name", None, "position_check_id"),
    "cancer_drugs": ("drugitems_cancer", "icode name strength units", None, "icode"),
}


def lookup_list(t: Tables, name: str, groups: Sequence[str] | None = None) -> DataFrame:
    """One of the plain lists, in its order; ``groups`` narrows scheme lists."""
    table, names, condition, order = PLAIN_LISTS[name]
    rows = t[table]
    if condition:
        rows = rows.where(condition)
    if groups is not None:
        rows = rows.where(F.col("hipdata_code").isin(*groups))
    if names != "*":
        rows = rows.select(*names.split())
    return rows.orderBy(F.col(order).asc_nulls_last()) if order else rows


def lookup_lists(t: Tables, p: Params | None = None) -> DataFrame:
    """All plain lists under one another, a row's known values joined by bars."""
    parts = None
    for name, (table, names, condition, _) in PLAIN_LISTS.items():
        rows = t[table].where(condition) if condition else t[table]
        shown = sorted(rows.columns) if names == "*" else names.split()
        row = F.concat_ws("|", *[F.col(c).cast("string") for c in shown])
        part = rows.select(F.lit(name).alias("list"), row.alias("row"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def hipdata_groups(t: Tables, p: Params | None = None) -> DataFrame:
    """Fund codes of the schemes in use."""
    return t["pttype"].where(_IN_USE).select("hipdata_code").distinct()
