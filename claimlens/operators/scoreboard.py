"""How many rows of a claim file need fixing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators import catalogue, outpatient
from claimlens.operators.audit import Tally
from claimlens.params import Params
from claimlens.sources.tables import Tables

ALL = "all"


def check_columns(df: DataFrame) -> list[str]:
    """The flag columns of a file."""
    return [c for c in df.columns if c.startswith("check_") or c.endswith("_check") or c.endswith("_check2")]


def _fails(columns: Sequence[str]) -> Column:
    """Some listed flag says 'N'."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == "N", F.lit(False)) for c in columns], F.lit(False))


def errors_only(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least one failed flag."""
    return df.where(_fails(columns if columns is not None else check_columns(df)))


def check_breakdown(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per flag: rows, and rows that fail it, in one pass."""
    tally = Tally(df)
    for name in columns if columns is not None else check_columns(df):
        tally.add((name,), "TRUE", f"`{name}` = 'N'")
    return tally.long(["check_name"]).select("check_name", F.col("tot").alias("total"), F.col("ok").alias("failed"))


@dataclass(frozen=True)
class File:
    """One file of a scoreboard: how to build it and which flags count."""

    build: Callable[[Tables, Params], DataFrame]
    checks: tuple[str, ...]


def claim_scoreboard(t: Tables, p: Params, files: Mapping[str, File]) -> DataFrame:
    """Rows, rows to fix and rows passed per file and in all.

    Listed flags that a file does not have cannot fail; they are named in
    ``ignored``.
    """
    counts = []
    for name, file in files.items():
        df = file.build(t, p)
        present = [c for c in file.checks if c in df.columns]
        ignored = ", ".join(c for c in file.checks if c not in df.columns)
        counts.append(
            df.agg(
                F.lit(name).alias("file"),
                F.count(F.lit(1)).alias("total"),
                F.count(F.when(_fails(present), 1)).alias("needfix"),
                F.lit(ignored).alias("ignored"),
            )
        )
    rows = reduce(DataFrame.unionByName, counts)
    # one pass over the files: the grand total comes from the few counted rows
    rows = rows.rollup("file").agg(
        F.sum("total").alias("total"), F.sum("needfix").alias("needfix"), F.max("ignored").alias("ignored"),
        F.grouping("file").alias("_all"),
    )
    is_all = F.col("_all") == 1
    return rows.select(
        F.when(is_all, ALL).otherwise(F.col("file")).alias("file"),
        "total",
        "needfix",
        (F.col("total") - F.col("needfix")).alias("passed"),
        F.when(is_all, "").otherwise(F.col("ignored")).alias("ignored"),
    )


# The flags each dashboard looks at.
_BILLING = ("check_hcode", "check_hmain", "check_authcode", "check_memberno", "check_invno", "check_billno")
_DIAGNOSES = ("check_class", "check_sl", "check_codeset", "check_code")
_ROUNDING = ("finance_round_money_check", "inc_round_money_check", "round_money_check")


def _for(fund: str, operator: Callable[[Tables, Params], DataFrame]) -> Callable[[Tables, Params], DataFrame]:
    return lambda t, p: operator(t, p.but(fund=fund))


FUND_FILES = {
    "billtran_SSS": File(_for("SSS", outpatient.billtran), _BILLING),
    "billtran_OFC": File(_for("OFC", outpatient.billtran), _BILLING),
    "opdx_SSS": File(_for("SSS", outpatient.opdx), _DIAGNOSES),
    "opdx_OFC": File(_for("OFC", outpatient.opdx), _DIAGNOSES),
}
BASIC_FILES = {
    "doctor": File(catalogue.check_doctor, ("licenseno_check", "licenseno_check2", "cid_check", "pname_check")),
    "pttype": File(
        catalogue.check_pttype_csop,
        ("drg_group_check", "print_presc_ned_check", "sks_benefit_plan_type_id_check", "pttype_upp_type_id_check", *_ROUNDING),
    ),
    "income": File(catalogue.check_income, ("income_group2_check",)),
    "nondrug": File(catalogue.check_nondrug, ("name_check", "sks_product_category_check")),
    "lab": File(catalogue.check_lab, ("lab_catalog_icode_check", "lab_catalog_tmlt_check", "sks_price_check")),
    "bloodbank": File(catalogue.check_bloodbank, ("bloodbank_tmlt_check", "lab_catalog_icode_check", "lab_catalog_tmlt_check")),
    "xray": File(catalogue.check_xray, ("n_icode_check",)),
    "drug": File(
        catalogue.check_drug,
        ("sks_price_check", "sks_product_category_name_check", "sks_claim_control_type_name_check", "sks_drug_code_check"),
    ),
}


def fund_scoreboard(t: Tables, p: Params) -> DataFrame:
    """Billing and diagnosis files of the two outpatient funds."""
    return claim_scoreboard(t, p, FUND_FILES)


def basic_scoreboard(t: Tables, p: Params) -> DataFrame:
    """The eight catalogue checks of the master-data dashboard."""
    return claim_scoreboard(t, p, BASIC_FILES)

