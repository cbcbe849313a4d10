"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from claimlens.operators import fdh, inpatient, outpatient, rules
from claimlens.params import Params
from claimlens.plans.registry import QUERIES
from claimlens.sources import dates
from claimlens.sources.binding import bind, with_clause
from claimlens.sources.tables import Tables

# Lists and catalogues that are joined by their key and must have it once.
UNIQUE_KEYS = {
    "pttype": "pttype", "patient": "hn", "drugitems": "icode", "nondrugitems": "icode", "s_drugitems": "icode",
    "nondrugitems_sks_bc": "icode", "drugitems_sks": "icode", "doctor": "code", "spclty": "spclty", "ward": "ward",
    "dchstts": "dchstts", "dchtype": "dchtype", "diagtype": "diagtype", "income": "income", "drg_chrgitem": "drg_chrgitem_id",
    "icd101": "code", "icd9cm1": "code", "drugusage": "drugusage", "ovstist": "ovstist", "ovstost": "ovstost",
    "lab_items": "lab_items_code", "er_oper_code": "er_oper_code", "vn_stat": "vn", "an_stat": "an", "ovst": "vn", "ipt": "an",
    "opi_dispense": "hos_guid", "drugitems_ned_reason_list": "claim_control", "sks_drug_code": "sks_drug_code",
}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cipn_ipdx", "cipn_billitems", "invoice_debt", "fill_diagnosis_slots", "add_diagnosis_rows"])
def test_numbering_leaves_no_single_partition_over_rows(spark, sf, name):
    """Only the list of slices, one row per partition, may meet in one task."""
    plan = physical(QUERIES[name].run(spark, sf))
    for block in re.findall(r"Exchange SinglePartition.*\n.*\n.*", plan):
        assert "_slice" in block or "aggregate" in block.lower(), block


def test_catalogue_keys_are_unique(spark, con, sf):
    for table, key in UNIQUE_KEYS.items():
        rows, keys = con.execute(with_clause(f"SELECT count(*), count(DISTINCT {key}) FROM {table}")).fetchone()
        assert rows == keys > 0, table


def test_window_and_columns_reach_the_scan(spark, tmp_path, sf):
    bound = bind(spark, sf)
    for name in ("ovst", "visit_pttype", "opdscreen", "ovst_seq", "er_regist", "spclty", "pttype"):
        bound[name].write.parquet(str(tmp_path / name))
    t = Tables(spark, {p.name: spark.read.parquet(str(p)) for p in tmp_path.iterdir()})
    plan = physical(fdh.fdh_opd(t, Params("1996-01-01", "1996-12-31")))
    visits = next(line for line in plan.splitlines() if "FileScan" in line and "vstdate" in line)
    assert "GreaterThanOrEqual(vstdate,1996-01-01)" in visits and "LessThanOrEqual(vstdate,1996-12-31)" in visits
    assert "oqueue" not in visits and "staff" not in visits
    payers = next(line for line in plan.splitlines() if "FileScan" in line and "request_funds" in line)
    assert "hospmain" not in payers


def test_date_rules_prune_partitions(spark, tmp_path, sf):
    bound = bind(spark, sf)
    for name in ("ovst", "pttype", "ovstdiag", "spclty", "doctor", "patient"):
        writer = bound[name].write.partitionBy("vstdate") if name == "ovstdiag" else bound[name].write
        writer.parquet(str(tmp_path / "t" / name))
    t = Tables(spark, {p.name: spark.read.parquet(str(p)) for p in (tmp_path / "t").iterdir()})
    dates.write_rules(t, str(tmp_path / "rules"), {"ovstdiag": "ovst"})
    p = Params("1996-01-01", "1996-01-31")
    for tables in (t, dates.with_rules(t, str(tmp_path / "rules"))):
        plan = physical(fdh.fdh_odx(tables, p, match="vn"))
        scan = next(line for line in plan.splitlines() if "FileScan" in line and "icd10" in line)
        assert ("vstdate" in scan.split("PartitionFilters: ")[1].split("]")[0]) == bool(tables.dates)


GROUPED_FACTS = {
    outpatient.billtran_funnel: ("rcpt_debt",),
    outpatient.billitems: ("rcpt_debt",),
    outpatient.opservice: ("rcpt_debt", "oapp", "ovstdiag"),
    outpatient.dispensing: ("opitemrece", "rcpt_debt", "ovstdiag"),
    outpatient.opdx: ("ovstdiag", "doctor_operation"),
    fdh.fdh_orf: ("ovstdiag",),
    fdh.fdh_dru: ("opitemrece",),
    fdh.fdh_phdb: ("opitemrece",),
    inpatient.cipn_invoices: ("opitemrece",),
    rules.cancer_missing_z: ("ovst_doctor_diag",),
}


@pytest.mark.parametrize("operator", GROUPED_FACTS, ids=lambda f: f.__name__)
def test_facts_are_cut_to_the_window_before_they_are_grouped(spark, tmp_path, sf, operator):
    """Between a fact's scan and the first grouping above it stands the semi join with the stays in scope."""
    bound = bind(spark, sf)
    t = Tables(spark, {n: (lambda n=n: bound[n].limit(0).withColumn(f"mark_{n}", F.lit(1))) for n in bound})
    plan = operator(t, Params("1996-01-01", "1996-01-31"))._jdf.queryExecution().analyzed().toString().splitlines()

    def depth(line):
        return len(re.match(r"[\s:+\-|]*", line).group())

    for fact in GROUPED_FACTS[operator]:
        places = [k for k, line in enumerate(plan) if f"AS mark_{fact}#" in line]
        assert places, fact
        for k in places:
            level, above = depth(plan[k]), []
            for line in reversed(plan[:k]):
                if depth(line) < level:
                    level = depth(line)
                    above.append(line)
            names = [re.sub(r"^[\s:+\-|]*", "", line) for line in above]
            first = next((i for i, n in enumerate(names) if n.startswith(("Aggregate", "Deduplicate", "Distinct"))), len(names))
            narrowed = any(n.startswith(("Join LeftSemi", "Join Inner")) for n in names[:first])
            assert narrowed or any("vstdate" in n and ">=" in n for n in names[:first]), (fact, names[: first + 1])


def test_statistics_read_three_columns(spark, tmp_path, sf):
    bound = bind(spark, sf)
    for name in ("ovst", "pttype"):
        bound[name].write.parquet(str(tmp_path / name))
    t = Tables(spark, {p.name: spark.read.parquet(str(p)) for p in tmp_path.iterdir()})
    plan = physical(outpatient.visit_statistics(t, Params("1996-01-01", "1996-12-31")))
    visits = next(line for line in plan.splitlines() if "FileScan" in line and "vstdate" in line)
    assert re.search(r"ReadSchema: struct<vn:string,vstdate:date,pttype:string>", visits)
