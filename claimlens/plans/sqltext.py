"""Small writers for the SQL each query is checked against."""

from __future__ import annotations

from claimlens.operators.scope import fund_groups

FROM_TO = "BETWEEN :d1 AND :d2"
BILLED = f"(SELECT vn FROM opitemrece WHERE vstdate {FROM_TO} AND paidst = '02')"


def yn(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'Y' ELSE 'N' END"


def flags(prefix: str = "check_", suffix: str = "", **conditions: str) -> str:
    return ", ".join(f"{yn(c)} AS {prefix}{n}{suffix}" for n, c in conditions.items())


def has(x: str) -> str:
    return f"{x} IS NOT NULL"


def text(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def name_of(alias: str) -> str:
    return f"concat({alias}.pname, {alias}.fname, ' ', {alias}.lname)"


def nothing(*names: str) -> str:
    return ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)


def codes(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def scope(fund: str, only_in_use: bool = True) -> str:
    used = "isuse = 'Y' AND " if only_in_use else ""
    return f"(SELECT pttype FROM pttype WHERE {used}hipdata_code IN {codes(fund_groups(fund))})"


HOSPITAL = "(SELECT min(hospitalcode) FROM opdconfig)"


def dated(sql: str, date_from: str, date_to: str) -> str:
    return sql.replace(":d1", f"DATE '{date_from}'").replace(":d2", f"DATE '{date_to}'")
