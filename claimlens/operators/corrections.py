"""Batch corrections: a table of changes applied to a table.

Each function returns the changed table together with a small report, and
changes nothing in place; the caller writes the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.numbering import dense_ids, number_within
from claimlens.operators.rules import ADDED_DIAGNOSIS_TYPE, adp_items
from claimlens.sources.tables import Tables

POSITION = "_pos"
DIAGNOSIS_SLOTS = ["dx0", "dx1", "dx2", "dx3", "dx4", "dx5"]


@dataclass(frozen=True)
class Changed:
    """The table after the changes, and one row of counts."""

    table: DataFrame
    report: DataFrame


# -- single fields -------------------------------------------------------------


@dataclass(frozen=True)
class EditPolicy:
    """Which fields of a table may be edited, and how their values are cleaned.

    ``fields`` maps the name used in an edit to the column.  ``blank`` says what
    an empty value becomes.
    """

    key: str
    fields: Mapping[str, str]
    trim: bool = True
    blank: str = "keep"
    yn_fields: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if self.blank not in ("keep", "null", "empty"):
            raise ValueError(f"unknown treatment of blanks: {self.blank}")


def _same(names: str, **renamed: str) -> dict[str, str]:
    return {**{n: n for n in names.split()}, **renamed}


_SCHEME_SWITCHES = "print_presc_ned finance_round_money inc_round_money round_money"

# Editable fields by table, for the screens that have their own rules.
EDIT_POLICIES = {
    "doctor": EditPolicy("code", _same("position_id licenseno cid pname fname lname", d_name="name"), trim=False),
    "pttype": EditPolicy(
        "pttype",
        _same(
            f"pcode hipdata_code sks_benefit_plan_type_id pttype_upp_type_id {_SCHEME_SWITCHES}",
            pttype_name="name", inscl="nhso_code", drg_group="grouper_version",
        ),
        yn_fields=frozenset(_SCHEME_SWITCHES.split()),
        blank="empty",
    ),
    "income": EditPolicy(
        "income",
        _same(
            "group2 drg_group income_sss_group_code std_group income_csmbs_code nk2_group drg_chrgitem_id rvsp_group",
            income_name="name",
        ),
        trim=False,
        blank="null",
    ),
    "nondrugitems": EditPolicy(
        "icode",
        _same(
            "name unit price billcode sks_coverage_price enable_sks_opd income nhso_adp_type_id nhso_adp_code "
            "sks_product_category_id"
        ),
        trim=False,
        blank="null",
    ),
    "xray_items": EditPolicy(
        "xray_items_code", {"xray_name": "xray_items_name", "exposure_qty": "exposure_qty", "price": "service_price"}, trim=False
    ),
}

# The general editing screen, table -> key and fields.
GENERAL_FIELDS = {
    "pname": ("name", "sex provis_code"),
    "nationality": ("nationality", "name nhso_code"),
    "marrystatus": ("code", "name nhso_marriage_code"),
    "sex": ("code", "name"),
    "occupation": ("occupation", "name nhso_code"),
    "spclty": ("spclty", "name provis_code nhso_code"),
    "dchtype": ("dchtype", "name nhso_dchtype"),
    "dchstts": ("dchstts", "name nhso_dchstts"),
    "diagtype": ("diagtype", "name nhso_code"),
    "er_oper_code": ("er_oper_code", "name icd9cm export_proced"),
    "nondrugitems": (
        "icode",
        "name unit price billcode income income_phdb_code nhso_adp_type_id nhso_adp_code sks_coverage_price enable_sks_opd",
    ),
    "physic_items": ("physic_items_id", "name price icd9 f43_rehab_code icd9_ipd_active_status"),
    "operation_item": ("operation_item_id", "name icd9"),
    "health_med_operation_item": ("health_med_operation_item_id", "health_med_operation_item_name price icd10tm"),
    "dttm": ("code", "name opd_price1 icd9cm export_eclaim_icd10tm"),
    "pttype": (
        "pttype",
        "name pcode hipdata_code nhso_code grouper_version print_presc_ned export_eclaim default_request_funds "
        "finance_round_money inc_round_money round_money",
    ),
    "ipt_accident_type": ("accident_type_id", "accident_type_name"),
    "ipt_accident_ae_type": ("accident_ae_type_id", "accident_ae_type_name"),
    "ipt_accident_emtype": ("accident_emtype_id", "accident_emtype_name"),
    "ipt_oper_code": ("ipt_oper_code", "name icd9cm"),
    "health_med_doctor": ("health_med_doctor_id", "health_med_doctor_name license_number doctor_code"),
    "drugitems": ("icode", "sks_price sks_drug_code sks_product_category_id sks_clain_control_type_id"),
    "drugcat": ("drugcat_id", "drugcat_name drug_usage_type_id"),
    "lab_catalog": ("lab_catalog_lc_code", "lab_catalog_lc_name lab_catalog_group_code"),
    "religion": ("religion", "name nhso_code"),
}


def general_policy(table: str) -> EditPolicy:
    """The general screen's policy for a table; an unlisted table may not be edited."""
    if table not in GENERAL_FIELDS:
        raise ValueError(f"table may not be edited: {table}")
    key, names = GENERAL_FIELDS[table]
    return EditPolicy(key, _same(names))


def _ordered(changes: DataFrame) -> DataFrame:
    """Changes with a position, which says which of several wins (read_rows gives one).

    Without one their values decide, column by column, so the outcome and its report agree.
    """
    return changes if POSITION in changes.columns else changes.withColumn(POSITION, F.struct(*changes.columns))


def _typed(value: Column | str, kind: T.DataType) -> Column:
    text = F.col(value) if isinstance(value, str) else value
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def apply_field_edits(df: DataFrame, edits: DataFrame, policy: EditPolicy) -> Changed:
    """Set single fields by key from rows of (key, field, value).

    The last edit of a field wins.  Edits of a field that is not listed, or
    whose value does not fit the column, are rejected and counted, as are edits
    of keys the table does not have.
    """
    kinds = {c.name: c.dataType for c in df.schema.fields}
    fields = {n: c for n, c in policy.fields.items() if c in kinds}
    value = F.trim("value") if policy.trim else F.col("value")
    switch = F.col("field").isin(*policy.yn_fields) & (F.length(value) > 1)
    value = F.when(switch, F.upper(F.substring(value, 1, 1))).otherwise(value)
    if policy.blank == "null":
        value = F.when(value != "", value)
    elif policy.blank == "empty":
        value = F.coalesce(value, F.lit(""))
    fits = F.lit(True)
    for name, column in fields.items():
        kind = kinds[column]
        if not isinstance(kind, T.StringType):
            bad = (F.col("field") == name) & F.col("clean").isNotNull() & _typed("clean", kind).isNull()
            fits = fits & ~bad
    edits = _ordered(edits.withColumn("clean", value))
    listed = F.coalesce(F.col("field").isin(*fields), F.lit(False))
    edits = edits.withColumn("verdict", F.when(~listed, "unknown_field").when(~fits, "bad_value").otherwise("accepted"))
    keys = df.select(F.col(policy.key).alias("_known")).distinct()
    judged = edits.join(keys, F.col(policy.key) == F.col("_known"), "left")
    verdict = F.when((F.col("verdict") == "accepted") & F.col("_known").isNull(), "unknown_key").otherwise(F.col("verdict"))
    report = judged.agg(
        *[F.count(F.when(verdict == v, 1)).alias(v) for v in ("accepted", "unknown_field", "bad_value", "unknown_key")]
    )
    latest = [
        F.max_by(F.struct("clean"), F.when(F.col("field") == name, F.col(POSITION))).alias(f"_new_{column}")
        for name, column in fields.items()
    ]
    wide = edits.where("verdict = 'accepted'").groupBy(F.col(policy.key).alias("_key")).agg(*latest)
    rows = df.join(wide, F.col(policy.key) == F.col("_key"), "left")
    edited = set(fields.values())
    table = rows.select(
        *[
            F.when(F.col(f"_new_{c}").isNotNull(), _typed(F.col(f"_new_{c}.clean"), kinds[c])).otherwise(F.col(c)).alias(c)
            if c in edited
            else F.col(c)
            for c in df.columns
        ]
    )
    return Changed(table, report)


# -- fixed updates by key ------------------------------------------------------


@dataclass(frozen=True)
class KeyedUpdate:
    """A fixed update: the table, its keys, and how each set column is cleaned."""

    table: str
    on: tuple[str, ...]
    sets: Mapping[str, str]  # column -> null_if_blank | blank_if_null | trimmed | yes_or_null | as_is


# The updates the screens make.
KEYED_UPDATES = {
    "main_hospital": KeyedUpdate("visit_pttype", ("vn",), {"hospmain": "null_if_blank"}),
    "entitlement_hospitals": KeyedUpdate(
        "visit_pttype", ("vn", "pttype"), {"hospmain": "null_if_blank", "hospsub": "null_if_blank"}
    ),
    "debt_approval": KeyedUpdate("rcpt_debt", ("debt_id",), {"sss_approval_code": "blank_if_null"}),
    "admission_approval": KeyedUpdate("ipt_pttype", ("an",), {"auth_code": "trimmed"}),
    "lab_opt_out": KeyedUpdate("lab_items", ("icode",), {"no_lab_catalog": "yes_or_null"}),
    "lab_profile_opt_out": KeyedUpdate("lab_items_sub_group", ("group_icode",), {"no_lab_catalog": "yes_or_null"}),
    "morphine_row": KeyedUpdate(
        "drug_morphine",
        ("drug_morphine_id",),
        {"icode": "as_is", "name": "null_if_blank", "strength": "null_if_blank", "units": "null_if_blank"},
    ),
}


def _cleaned(column: str, how: str) -> Column:
    value = F.col(column)
    if how == "null_if_blank":
        return F.when(value != "", value)
    if how == "blank_if_null":
        return F.coalesce(value, F.lit(""))
    if how == "trimmed":
        return F.trim(F.coalesce(value, F.lit("")))
    if how == "yes_or_null":
        return F.when(value == "Y", F.lit("Y"))
    if how == "as_is":
        return value
    raise ValueError(f"unknown cleaning: {how}")


def apply_keyed_updates(df: DataFrame, updates: DataFrame, rule: KeyedUpdate) -> Changed:
    """Set the rule's columns on every row with the key; the last update of a key wins."""
    cleaned = F.struct(*[_cleaned(c, how).alias(c) for c, how in rule.sets.items()])
    keyed = [F.col(k).alias(f"_k_{k}") for k in rule.on]
    last = _ordered(updates).groupBy(*keyed).agg(F.max_by(cleaned, POSITION).alias("_new"))
    same = " AND ".join(f"{k} = _k_{k}" for k in rule.on)
    rows = df.join(last, F.expr(same), "left")
    table = rows.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in rule.sets else F.col(c)
            for c in df.columns
        ]
    )
    known = df.select(*[F.col(k).alias(f"_t_{k}") for k in rule.on]).distinct()
    matched = last.join(known, F.expr(" AND ".join(f"_t_{k} = _k_{k}" for k in rule.on)), "left")
    hit = F.col(f"_t_{rule.on[0]}").isNotNull()
    report = matched.agg(F.count(F.when(hit, 1)).alias("matched"), F.count(F.when(~hit, 1)).alias("unmatched"))
    return Changed(table, report)


# -- inserts, upserts, deletes -------------------------------------------------


def insert_missing(df: DataFrame, rows: DataFrame, key: str) -> Changed:
    """Add the rows whose key is given and not there yet, once per key."""
    columns = [c for c in df.columns if c in rows.columns]
    given = _ordered(rows.where(F.col(key).isNotNull())).groupBy(F.col(key).alias("_key"))
    rows = given.agg(F.min_by(F.struct(*columns), POSITION).alias("_row")).select("_row.*")
    new = rows.join(df.select(F.col(key).alias("_there")), F.col(key) == F.col("_there"), "left_anti")
    report = new.agg(F.count(F.lit(1)).alias("inserted"))
    return Changed(df.unionByName(new, allowMissingColumns=True), report)


def upsert_by_key(df: DataFrame, rows: DataFrame, key: str) -> Changed:
    """Insert new keys and overwrite known ones; the last row of a key wins.

    An empty text is stored as NULL.  The first row of a new key counts as
    inserted, every other row as updated.
    """
    names = [c for c in df.columns if c != key and c in rows.columns]
    clean = F.struct(*[_cleaned(c, "null_if_blank").alias(c) for c in names])
    keyed = _ordered(rows).withColumn("_key", F.trim(key)).where(F.col("_key") != "")
    last = keyed.groupBy("_key").agg(F.max_by(clean, POSITION).alias("_new"), F.count(F.lit(1)).alias("_times"))
    joined = df.join(last, F.col(key) == F.col("_key"), "full_outer")
    given = F.col("_key").isNotNull()
    table = joined.select(
        *[
            F.coalesce(F.col(key), F.col("_key")).alias(key)
            if c == key
            else F.when(given, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in names
            else F.col(c)
            for c in df.columns
        ]
    )
    inserted = F.count(F.when(given & F.col(key).isNull(), 1))
    total = F.coalesce(F.sum("_times"), F.lit(0))
    report = joined.agg(inserted.alias("inserted"), (total - inserted).alias("updated"))
    return Changed(table, report)


def append_numbered(df: DataFrame, rows: DataFrame, id_column: str, order: Sequence[str] = (POSITION,)) -> Changed:
    """Append rows with ids that continue from the largest one."""
    highest = F.coalesce(df.agg(F.max(id_column)).scalar(), F.lit(0))
    names = [c for c in df.columns if c != id_column]
    rows = rows.select(*[_cleaned(c, "null_if_blank").alias(c) for c in names if c in rows.columns], *[c for c in order if c not in names])
    new = dense_ids(rows, order, id_column, start=highest + 1)
    report = new.agg(F.count(F.lit(1)).alias("inserted"))
    new = new.select(id_column, *[c for c in names if c in new.columns])
    return Changed(df.unionByName(new, allowMissingColumns=True), report)


def delete_by_key(df: DataFrame, keys: DataFrame, key: str) -> Changed:
    """Remove the rows whose key is listed."""
    listed = keys.select(F.col(key).alias("_gone")).distinct()
    report = df.join(listed, F.col(key) == F.col("_gone"), "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return Changed(df.join(listed, F.col(key) == F.col("_gone"), "left_anti"), report)


def delete_charge_lines(t: Tables, visits: DataFrame, adp_code: str) -> Changed:
    """Remove the lines with an item code from the given visits.

    Lines of other items never meet the visit list, so only the few lines with
    the code are shuffled by visit.
    """
    lines, items = t["opitemrece"], adp_items(t, adp_code).distinct()
    listed = visits.select(F.col("vn").alias("_visit")).distinct()
    on_visit = F.col("vn") == F.col("_visit")
    coded = lines.join(items, "icode", "left_semi")
    others = lines.join(items, "icode", "left_anti")
    report = coded.join(listed, on_visit, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    kept = coded.join(listed, on_visit, "left_anti")
    return Changed(others.unionByName(kept), report)


# -- diagnoses -----------------------------------------------------------------


def add_diagnosis_rows(t: Tables, records: DataFrame, staff: str = "", now: Column | None = None) -> DataFrame:
    """The diagnosis table with the records appended under new ids."""
    highest = F.coalesce(t["ovstdiag"].agg(F.max("ovst_diag_id")).scalar(), F.lit(0))
    rows = _ordered(records).select(
        "vn",
        F.col("icd10_add").alias("icd10"),
        "hn",
        "vsttime",
        F.to_date("vstdate").alias("vstdate"),
        F.when(F.col("diagtype") != "", F.col("diagtype")).otherwise(ADDED_DIAGNOSIS_TYPE).alias("diagtype"),
        F.col("doctor_code").alias("doctor"),
        POSITION,
    )
    new = dense_ids(rows, [POSITION, "vn", "icd10"], "ovst_diag_id", start=highest + 1)
    new = new.drop(POSITION).withColumns({"hos_guid": F.lit("app"), "staff": F.lit(staff)})
    if now is not None:
        new = new.withColumn("update_datetime", now)
    return t["ovstdiag"].unionByName(new, allowMissingColumns=True)


def fill_diagnosis_slots(t: Tables, records: DataFrame) -> DataFrame:
    """The visit summary with each visit's new codes in its empty slots, first to last.

    A visit has six slots, so only its first six codes are gathered; codes that
    find no slot and visits without a summary change nothing.
    """
    slots = len(DIAGNOSIS_SLOTS)
    given = _ordered(records).where(F.trim("icd10_add") != "").select("vn", "icd10_add", POSITION)
    ranked = number_within(given, ["vn"], [POSITION, "icd10_add"], "_rank")
    first = ranked.where(F.col("_rank") <= slots)
    codes = first.groupBy(F.col("vn").alias("_vn")).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "icd10_add"))).alias("_codes")
    )
    rows = t["vn_stat"].join(codes, F.col("vn") == F.col("_vn"), "left")
    empty = {s: F.coalesce(F.trim(s) == "", F.lit(True)) for s in DIAGNOSIS_SLOTS}
    filled, seen = {}, F.lit(0)
    for slot in DIAGNOSIS_SLOTS:
        code = F.get(F.col("_codes"), seen)["icd10_add"]
        filled[slot] = F.when(empty[slot] & code.isNotNull(), code).otherwise(F.col(slot))
        seen = seen + empty[slot].cast("int")
    return rows.withColumns(filled).select(*t["vn_stat"].columns)


def add_diagnoses(t: Tables, records: DataFrame, staff: str = "", now: Column | None = None) -> dict[str, DataFrame]:
    """Both tables that a new diagnosis touches."""
    return {"ovstdiag": add_diagnosis_rows(t, records, staff, now), "vn_stat": fill_diagnosis_slots(t, records)}

