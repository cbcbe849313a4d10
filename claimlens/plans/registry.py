"""Every query by name: the operator, its parameters, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.numbering import dense_ids, number_within
from claimlens.operators import audit, catalogue, corrections, fdh, inpatient, outpatient, rules, scoreboard
from claimlens.operators.invoice import Invoices, next_debt_id
from claimlens.operators.scope import billed_visits, date_window, payer_scope
from claimlens.params import Params
from claimlens.plans import oracle_audit, oracle_blocks, oracle_catalogue, oracle_changes, oracle_fdh, oracle_inpatient, oracle_outpatient, oracle_rules
from claimlens.plans.audit_rules import Rule
from claimlens.plans.sqltext import dated
from claimlens.sources.binding import bind, with_clause
from claimlens.sources.tables import Tables

# Covers every visit and discharge of the driver tables.
WHOLE = Params("1990-01-01", "2029-12-31")

Operator = Callable[[Tables, Params], DataFrame]


@dataclass(frozen=True)
class Query:
    operator: Operator
    sql: str | None = None
    params: Params = WHOLE
    long_lists: bool = False
    by_visit: bool = False

    def run(self, spark: SparkSession, sf_dir: str, params: Params | None = None) -> DataFrame:
        tune(spark, sf_dir)
        return self.operator(bind(spark, sf_dir, self.long_lists, self.by_visit), params or self.params)

    def oracle(self, params: Params | None = None) -> str | None:
        if self.sql is None:
            return None
        p = params or self.params
        return with_clause(dated(self.sql, str(p.date_from), str(p.date_to)), self.long_lists)


# What a task should read of its shuffles, from where on a hot key is split, what a task should read
# of a file, and the input files for which one shuffle partition is cut.
TASK_BYTES = 8 << 20
SKEW_BYTES = 4 * TASK_BYTES
SCAN_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
HOSPITAL_SOURCES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Size of the files that the hospital tables are read from."""
    total = 0
    for name in HOSPITAL_SOURCES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        total += files.getContentSummary(path).getLength() if files.exists(path) else 0
    return total


def tune(spark: SparkSession, sf_dir: str) -> None:
    """Keep what one task holds the same when the input grows.

    Shuffles start with a partition for every ``SLICE_BYTES`` of input, which adaptive
    execution merges up to ``TASK_BYTES`` (a size the session sets itself stands); it may
    split skewed joins even when that costs a shuffle.  A grouping over rows that a join
    has already sorted by its keys needs no hash table, and its rows stay sorted.
    """
    for key in (
        "spark.sql.adaptive.enabled",
        "spark.sql.adaptive.skewJoin.enabled",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
        "spark.sql.execution.replaceHashWithSortAgg",
    ):
        spark.conf.set(key, "true")
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": SKEW_BYTES,
        "spark.sql.files.maxPartitionBytes": SCAN_BYTES,
    }
    for key, size in sizes.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(size))
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(spark, sf_dir) // SLICE_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(slices))


def _family(operators: dict[str, Operator], sql: dict[str, str], **options) -> dict[str, Query]:
    return {name: Query(op, sql.get(name), **options) for name, op in operators.items()}


def _of(module, *names: str) -> dict[str, Operator]:
    return {n: getattr(module, n) for n in names}


def _with(operator: Operator, **changes) -> Operator:
    return lambda t, p: operator(t, p.but(**changes))


OUTPATIENT = {
    **_of(
        outpatient,
        *"visit_list billtran billtran_ssop billtran_funnel billitems visit_expenses opservice".split(),
        *"dispensing dispensing_ssop opdx visit_statistics".split(),
    ),
    "billtran_csop": _with(outpatient.billtran, fund="OFC"),
    "dispensing_per_visit": partial(outpatient.dispensing, fanout="per_visit"),
}

DISPENSED = _of(outpatient, "dispenseditem", "dispenseditem_csop", "dispenseditem_ssop")

FDH = {
    **_of(
        fdh,
        *"fdh_ins fdh_ins_43 fdh_pat fdh_opd fdh_orf fdh_odx fdh_oop fdh_irf fdh_ipd fdh_iop".split(),
        *"fdh_cht fdh_cha fdh_idx fdh_lvd fdh_dru fdh_labfu fdh_phdb".split(),
    ),
    "fdh_ins_opd_only": _with(fdh.fdh_ins, include_ipd=False),
    "fdh_orf_by_visit": partial(fdh.fdh_orf, match="vn"),
    "fdh_odx_by_visit": partial(fdh.fdh_odx, match="vn"),
    "fdh_orf_by_patient": partial(fdh.fdh_orf, match="hn"),
    "fdh_odx_by_patient": partial(fdh.fdh_odx, match="hn"),
}

INPATIENT = _of(
    inpatient,
    *"ipn_ipadt cipn_ipadt cipn_ipdx cipn_ipop cipn_invoices cipn_billitems ipn_ipdx ipn_ipop".split(),
    *"ipn_invoices ipn_billitems cipn_group46".split(),
)

RULES = _of(
    rules, *"cancer_missing_z cancer_z_preview walkin_with_cancer adp_with_morphine controlled_drug_class".split()
)
LIST_RULES = _of(rules, "cancer_procedures", "payer_code_unknown")
CATALOGUE = _of(catalogue, *oracle_catalogue.SQL)



def _scored(score: Callable[[DataFrame], DataFrame]) -> Operator:
    return lambda t, p: score(audit.full_audit(t, p))


USER_GROUP_TABLES = ["officer_group", "officer_group_module_access", "officer_group_task_access"]
PRICE_RULE = Rule("bill", "nondrugitems", "price", ("istatus=Y",), ("0", "0.00"))

AUDIT: dict[str, Operator] = {
    "audit_basic": audit.basic_audit,
    "audit_full": audit.full_audit,
    "bill_sections": audit.bill_sections,
    "audit_driver_tables": lambda t, p: audit.audit_columns(t, oracle_audit.DRIVER_RULES),
    "audit_linked": lambda t, p: audit.audit_linked(t, "documents", "labels", "doc_id", ("quality!0", "toxic!0")),
    "audit_missing_rows": lambda t, p: audit.audit_missing_rows(t, PRICE_RULE),
    "audit_missing_linked_rows": lambda t, p: audit.audit_missing_linked_rows(t, "documents", "labels", "doc_id", ("quality!0", "toxic!0")),
    "table_counts": lambda t, p: audit.table_counts(t, USER_GROUP_TABLES),
    "table_contract": lambda t, p: audit.table_contract(t),
    "section_score": _scored(audit.section_score),
    "section_score_weighted": _scored(audit.section_score_weighted),
    "overall_score": _scored(audit.overall_score),
    "score_bands": _scored(audit.score_bands),
    "basic_scoreboard": scoreboard.basic_scoreboard,
}
SCOREBOARD: dict[str, Operator] = {
    "fund_scoreboard": scoreboard.fund_scoreboard,
    "errors_only": lambda t, p: scoreboard.errors_only(inpatient.cipn_group46(t, p)),
    "check_breakdown": lambda t, p: scoreboard.check_breakdown(fdh.fdh_opd(t, p)),
}



# -- shared blocks ---------------------------------------------------------------


def _scoped(mode: str, **choice) -> Operator:
    """Visits and schemes of the visit-payer rows that a payer scope keeps."""

    def run(t: Tables, p: Params) -> DataFrame:
        rows = t["visit_pttype"].select("vn", "pttype", "pttype_number")
        return payer_scope(rows, "pttype", t, p.but(**choice), mode, "FDH")

    return run


BLOCKS: dict[str, Operator] = {
    "payer_scope_override": _scoped("override", payers=("10", "14")),
    "payer_scope_intersect": _scoped("intersect", payers=("10", "14"), fund="ECLAIM"),
    "payer_scope_groups": _scoped("groups", groups=("OFC", "LGO"), payers=("12", "14", "18")),
    "billed_visits": billed_visits,
    "dense_ids": lambda t, p: dense_ids(t["orders"].select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], "id", 100),
    "number_within": lambda t, p: number_within(
        t["lineitem"].select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct(),
        ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    ),
}


# -- corrections and invoices ----------------------------------------------------


def _scheme_edits(t: Tables) -> corrections.Changed:
    return corrections.apply_field_edits(t["pttype"], t["scheme_edits"], corrections.EDIT_POLICIES["pttype"])


def _hospital_updates(t: Tables) -> corrections.Changed:
    rule = corrections.KEYED_UPDATES["entitlement_hospitals"]
    return corrections.apply_keyed_updates(t[rule.table], t["hospital_updates"], rule)


def _update(name: str, updates: str) -> Operator:
    rule = corrections.KEYED_UPDATES[name]
    return lambda t, p: corrections.apply_keyed_updates(t[rule.table], t[updates], rule).table


def _edits(table: str, edits: str) -> Operator:
    policy = corrections.EDIT_POLICIES[table]
    return lambda t, p: corrections.apply_field_edits(t[table], t[edits], policy).table


def _cancer_drugs(t: Tables) -> corrections.Changed:
    return corrections.upsert_by_key(t["drugitems_cancer"], t["cancer_drug_rows"], "icode")


def _more_morphine(t: Tables) -> DataFrame:
    rows = catalogue.morphine_candidates(t)
    return corrections.append_numbered(t["drug_morphine"], rows, "drug_morphine_id", ["icode"]).table


def _without_lines(rule: Operator, code: str) -> Operator:
    def run(t: Tables, p: Params) -> DataFrame:
        visits = rule(t, p).select(F.col("VN").alias("vn"))
        return corrections.delete_charge_lines(t, visits, code).table

    return run


CORRECTIONS: dict[str, Operator] = {
    "keyed_updates": lambda t, p: _hospital_updates(t).table,
    "keyed_updates_report": lambda t, p: _hospital_updates(t).report,
    "debt_approval": _update("debt_approval", "approval_updates"),
    "admission_approval": _update("admission_approval", "approval_updates"),
    "lab_opt_out": _update("lab_opt_out", "lab_switches"),
    "lab_profile_opt_out": _update("lab_profile_opt_out", "profile_switches"),
    "main_hospital": _update("main_hospital", "hospital_updates"),
    "morphine_row": _update("morphine_row", "morphine_rows"),
    "doctor_field_edits": _edits("doctor", "doctor_edits"),
    "income_field_edits": _edits("income", "income_edits"),
    "xray_field_edits": _edits("xray_items", "xray_edits"),
    "service_field_edits": _edits("nondrugitems", "service_edits"),
    "drug_field_edits": lambda t, p: corrections.apply_field_edits(
        t["drugitems"], t["drug_edits"], corrections.general_policy("drugitems")
    ).table,
    "insert_missing": lambda t, p: corrections.insert_missing(t["sks_icd10tm_check"], t["ovst_sks_icd10tm"], "code").table,
    "upsert_rows": lambda t, p: _cancer_drugs(t).table,
    "upsert_report": lambda t, p: _cancer_drugs(t).report,
    "append_numbered": lambda t, p: _more_morphine(t),
    "delete_by_key": lambda t, p: corrections.delete_by_key(t["drugitems_cancer"], t["cancer_drug_rows"], "icode").table,
    "delete_walkin_lines": _without_lines(rules.walkin_with_cancer, "WALKIN"),
    "delete_adp_lines": _without_lines(rules.adp_with_morphine, "ADP30001"),
    "add_diagnosis_rows": lambda t, p: corrections.add_diagnosis_rows(t, t["new_diagnoses"], staff="clerk"),
    "fill_diagnosis_slots": lambda t, p: corrections.fill_diagnosis_slots(t, t["new_diagnoses"]),
}
LIST_CORRECTIONS: dict[str, Operator] = {
    "field_edits": lambda t, p: _scheme_edits(t).table,
    "field_edits_report": lambda t, p: _scheme_edits(t).report,
}


def _invoices(build: Callable[[Invoices], DataFrame]) -> Operator:
    def run(t: Tables, p: Params) -> DataFrame:
        visits = t["ovst"].where(date_window("vstdate", p)).select("vn", F.concat(F.lit("X"), "vn").alias("vercode"))
        first = {"debt_id": next_debt_id(t), "finance_number": 501}
        return build(Invoices(t, visits, now="12:00:00", first_ids=first))

    return run


INVOICE: dict[str, Operator] = {
    "invoice_transfer_list": _invoices(Invoices.transfer_list),
    "invoice_transfer_links": _invoices(lambda i: i.transfer_links(i.t["old_transfers"])),
    "invoice_transfer_detail": _invoices(Invoices.transfer_detail),
    "invoice_finance_summary": _invoices(Invoices.finance_summary),
    "invoice_credit_list": _invoices(Invoices.credit_list),
    "invoice_credit_detail": _invoices(Invoices.credit_detail),
    "invoice_debt": _invoices(Invoices.debt),
    "invoice_debt_detail": _invoices(Invoices.debt_detail),
    "invoice_stamp_lines": _invoices(Invoices.stamped_lines),
    "invoice_rejected": _invoices(lambda i: i.rejected),
}

QUERIES: dict[str, Query] = {
    **_family(BLOCKS, oracle_blocks.SQL),
    **_family(FDH, oracle_fdh.SQL),
    **_family(INPATIENT, oracle_inpatient.SQL),
    **_family(RULES, oracle_rules.SQL),
    **_family(LIST_RULES, oracle_rules.SQL, long_lists=True),
    **_family(CATALOGUE, oracle_catalogue.SQL, long_lists=True),
    **_family(AUDIT, oracle_audit.SQL, long_lists=True),
    **_family(SCOREBOARD, oracle_audit.SQL),
    **_family(CORRECTIONS, oracle_changes.SQL),
    **_family(LIST_CORRECTIONS, oracle_changes.SQL, long_lists=True),
    **_family(INVOICE, oracle_changes.SQL),
    **_family(OUTPATIENT, oracle_outpatient.SQL),
    **_family(DISPENSED, oracle_outpatient.SQL, by_visit=True),
}
