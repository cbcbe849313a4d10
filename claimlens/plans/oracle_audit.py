"""SQL for the completeness audit: one statement per rule, as many scans as rules."""

from __future__ import annotations

import re

from claimlens.operators.audit import REQUIRED
from claimlens.operators.scoreboard import BASIC_FILES, FUND_FILES
from claimlens.plans import oracle_catalogue, oracle_fdh, oracle_inpatient, oracle_outpatient
from claimlens.plans.audit_rules import (
    BASIC_RULES,
    COLUMN_ALIASES,
    DRUG_COLUMNS,
    FULL_RULES,
    ITEM_COLUMNS,
    LINKED_COLUMNS,
    LOOKUP_TERM,
    MEMBER_TERM,
    Rule,
    column_spec,
    parse_rules,
)
from claimlens.operators.rules import CONTROLLED_DRUGS, CONTROLLED_NAME_COLUMNS
from claimlens.plans.sqltext import scope
from claimlens.sources.binding import DRIVER_TABLES, definitions

_BOUND = {name: set(re.findall(r"\bAS ([a-z_][a-z_0-9]*)", text)) for name, text in definitions(True).items()}


def _find(table: str, column: str, aliases: dict) -> str | None:
    return next((c for c in (column, *aliases.get(column, ())) if c in _BOUND[table]), None)


def _missing(column: str, sentinels=()) -> str:
    values = ", ".join(f"'{v}'" for v in ("", *sentinels))
    return f"({column} IS NULL OR CAST({column} AS VARCHAR) IN ({values}))"


def _where(rule: Rule, aliases: dict, strict: bool) -> tuple[str, str]:
    parts = []
    for term in rule.terms:
        if LOOKUP_TERM.match(term):
            name, value = term.split("=")
            found = _find(rule.table, name, aliases)
            if found:
                parts.append(f"{found} = '{value}'")
            elif strict:
                return "", "skip"
        elif m := MEMBER_TERM.match(term):
            parts.append(f"{m['column']} {m['word']} (SELECT {m['key']} FROM {m['table']} WHERE {m['where']})")
        else:
            parts.append(term)
    return " AND ".join(parts) or "TRUE", "ok"


def _answer(rule: Rule, aliases: dict, strict: bool) -> str:
    info = "Y" if rule.info else "N"
    found = _find(rule.table, rule.column, aliases) if rule.table in _BOUND else None
    where, status = _where(rule, aliases, strict) if found else ("", "skip")
    head = f"SELECT '{rule.section}' AS section, '{rule.name}' AS rule, '{rule.table}' AS table_name, "
    if status != "ok":
        return head + f"'{found or rule.column}' AS column_name, 0::BIGINT AS tot, 0::BIGINT AS ok, '{status}' AS status, '{info}' AS info"
    ok = f"CAST(coalesce(sum(CASE WHEN {_missing(found, rule.sentinels)} THEN 0 ELSE 1 END), 0) AS BIGINT)"
    return head + f"'{found}' AS column_name, count(*) AS tot, {ok} AS ok, 'ok' AS status, '{info}' AS info FROM {rule.table} WHERE {where}"


def _audit(text: str, aliases: dict, strict: bool) -> str:
    return "\nUNION ALL ".join(_answer(r, aliases, strict) for r in parse_rules(text))


# -- charge categories ---------------------------------------------------------

_CATEGORIES = """
cats AS (
  SELECT DISTINCT code, CAST(coalesce(TRY_CAST(code AS BIGINT), 0) AS VARCHAR) AS plain FROM (
    SELECT CASE WHEN length(trim(income)) = 1 AND trim(income) BETWEEN '0' AND '9' THEN '0' || trim(income)
                ELSE trim(income) END AS code, name FROM income
    WHERE trim(income) NOT IN ('', '04', '20')) WHERE name IS NULL OR name NOT LIKE '%ส่วนเกิน%'),
items AS (SELECT * FROM nondrugitems WHERE istatus = 'Y' AND name NOT ILIKE '%ส่วนเกิน%'),
drugs AS (SELECT * FROM drugitems WHERE istatus = 'Y')"""


def _bill(rule: str, table: str, column: str, source: str, ok: str, only: str = "TRUE", meets: str = "TRUE") -> str:
    base = f"SELECT count(*) FROM {source} i WHERE i.income IN (c.code, c.plain) AND ({meets})"
    return f"""
SELECT 'bill' || c.code AS section, '{rule}' AS rule, '{table}' AS table_name, '{column}' AS column_name,
  ({base}) AS tot, ({base} AND ({ok})) AS ok, 'ok' AS status, 'N' AS info FROM cats c WHERE {only}"""


def _bill_skip(rule: str, table: str, column: str, only: str) -> str:
    return f"""
SELECT 'bill' || c.code AS section, '{rule}' AS rule, '{table}' AS table_name, '{column}' AS column_name,
  0::BIGINT AS tot, 0::BIGINT AS ok, 'skip' AS status, 'N' AS info FROM cats c WHERE {only}"""


def _bill_parts() -> list[str]:
    parts = []
    for spec in ITEM_COLUMNS.split():
        column, sentinels, _ = column_spec(spec)
        only = "TRUE" if column in ("income", "name", "ename", "price") else "c.code <> '18'"
        if column == "unitcost":
            only = "c.code IN ('03', '17')"
        parts.append(_bill(f"nondrugitems.{column}", "nondrugitems", column, "items", f"NOT {_missing('i.' + column, sentinels)}", only))
    linked = "c.code IN ('01', '02')"
    parts.append(_bill("nondrugitems_sks_bc", "nondrugitems", "icode", "items", "i.icode IN (SELECT icode FROM nondrugitems_sks_bc)", linked))
    for spec in LINKED_COLUMNS.split():
        column, sentinels, _ = column_spec(spec)
        ok = f"i.icode IN (SELECT icode FROM nondrugitems_sks_bc WHERE NOT {_missing(column, sentinels)})"
        parts.append(_bill(f"nondrugitems_sks_bc.{column}", "nondrugitems", "icode", "items", ok, linked))
    drug = "c.code IN ('03', '17')"
    thai = "i.sks_product_category_id IN (SELECT sks_product_category_id FROM sks_product_category WHERE name ILIKE '%แผนไทย%')"
    for column in DRUG_COLUMNS.split():
        if column not in _BOUND["drugitems"]:
            parts.append(_bill_skip(f"drugitems.{column}", "drugitems", column, drug))
            continue
        meets = thai if column == "ttmt_code" else "TRUE"
        parts.append(_bill(f"drugitems.{column}", "drugitems", column, "drugs", f"NOT {_missing('i.' + column)}", drug, meets))
    for label, names in CONTROLLED_DRUGS.items():
        likes = " OR ".join(f"i.{c} ILIKE '%{n}%'" for n in names.split() for c in CONTROLLED_NAME_COLUMNS)
        parts.append(_bill(label, "drugitems", "drug_control_type_id", "drugs", f"NOT {_missing('i.drug_control_type_id')}", drug, likes))
    return parts


_BASIC = _audit(BASIC_RULES, {}, True)
_BILL = "\nUNION ALL".join(_bill_parts())
_FULL = _audit(FULL_RULES, COLUMN_ALIASES, False) + "\nUNION ALL" + _BILL


def _scored(select: str) -> str:
    return f"""WITH {_CATEGORIES},
results AS ({_FULL}),
valid AS (SELECT *, ok::DOUBLE / tot AS share FROM results WHERE status = 'ok' AND info = 'N' AND tot > 0),
scores AS (
  SELECT r.section, coalesce(max(v.pct), 0) AS pct, coalesce(max(v.n_full), 0) AS n_full, coalesce(max(v.n_short), 0) AS n_short
  FROM (SELECT DISTINCT section FROM results) r LEFT JOIN (
    SELECT section, CAST(round(round(avg(share), 9) * 100) AS BIGINT) AS pct, count(*) FILTER (WHERE share >= 1) AS n_full,
      count(*) FILTER (WHERE share < 1) AS n_short FROM valid GROUP BY section) v ON v.section = r.section GROUP BY r.section),
sums AS (
  SELECT section, CAST(sum(CASE WHEN status = 'ok' THEN tot ELSE 0 END) AS BIGINT) AS tot,
    CAST(sum(CASE WHEN status = 'ok' THEN ok ELSE 0 END) AS BIGINT) AS ok,
    CAST(sum(CASE WHEN status = 'ok' AND tot > ok THEN tot - ok ELSE 0 END) AS BIGINT) AS missing FROM results GROUP BY section),
records AS (
  SELECT section, CASE WHEN tot > 0 THEN CAST(round(round(ok::DOUBLE / tot, 9) * 100) AS BIGINT) END AS pct, tot, ok, missing FROM sums)
{select}"""


# -- scoreboards ---------------------------------------------------------------


def _file_count(name: str, sql: str, checks, present) -> str:
    kept = [c for c in checks if c in present]
    ignored = ", ".join(c for c in checks if c not in present)
    fails = " OR ".join(f"{c} = 'N'" for c in kept) or "FALSE"
    return f"SELECT '{name}' AS file, count(*) AS total, count(*) FILTER (WHERE {fails}) AS needfix, '{ignored}' AS ignored FROM ({sql})"


def _scoreboard(parts: list[str]) -> str:
    files = "\nUNION ALL ".join(parts)
    return f"""
WITH files AS ({files})
SELECT file, total, needfix, total - needfix AS passed, ignored FROM files
UNION ALL SELECT 'all', CAST(sum(total) AS BIGINT), CAST(sum(needfix) AS BIGINT),
  CAST(sum(total) - sum(needfix) AS BIGINT), '' FROM files"""


_FUND_SQL = {
    "billtran_SSS": oracle_outpatient.SQL["billtran"],
    "billtran_OFC": oracle_outpatient.SQL["billtran_csop"],
    "opdx_SSS": oracle_outpatient.SQL["opdx"],
    "opdx_OFC": oracle_outpatient.SQL["opdx"].replace(scope("SSS"), scope("OFC")),
}
_FUND_PRESENT = {"check_invno", "check_vercode", "check_class", "check_sl", "check_codeset", "check_code"}
_BASIC_SQL = {
    "doctor": "check_doctor", "pttype": "check_pttype_csop", "income": "check_income", "nondrug": "check_nondrug",
    "lab": "check_lab", "bloodbank": "check_bloodbank", "xray": "check_xray", "drug": "check_drug",
}
_OPD_CHECKS = "clinic dateopd timeopd seq uuc detail btemp sbp dbp pr rr optype typein typeout".split()

_DOCUMENT = "SELECT doc_id FROM labels WHERE {0} IS NOT NULL AND CAST({0} AS VARCHAR) NOT IN ('', '0')"


def _document(rule: str, subquery: str) -> str:
    return (
        f"SELECT 'linked' AS section, '{rule}' AS rule, 'documents' AS table_name, 'doc_id' AS column_name, count(*) AS tot, "
        f"count(*) FILTER (WHERE doc_id IN ({subquery})) AS ok, 'ok' AS status, 'N' AS info FROM documents"
    )


def _driver(table: str, column: str, sentinels: tuple[str, ...], where: str) -> str:
    return (
        f"SELECT 'driver' AS section, '{table}.{column}' AS rule, '{table}' AS table_name, '{column}' AS column_name, "
        f"count(*) AS tot, CAST(coalesce(sum(CASE WHEN {_missing(column, sentinels)} THEN 0 ELSE 1 END), 0) AS BIGINT) AS ok, "
        f"'ok' AS status, 'N' AS info FROM {table} WHERE {where}"
    )


DRIVER_RULES = [
    Rule("driver", "customer", "c_mktsegment", (), ("BUILDING",)),
    Rule("driver", "customer", "c_acctbal", ("c_nationkey IN (1, 2, 3)",), ()),
    Rule("driver", "part", "p_size", (), ("1",)),
    Rule("driver", "events", "event_type", ("value > 5",), ("error",)),
    Rule("driver", "events", "props"),
    Rule("driver", "pages", "url"),
    Rule("driver", "lineitem", "l_returnflag", ("l_quantity > 10",), ("N",)),
]
assert all(r.table in DRIVER_TABLES for r in DRIVER_RULES)

SQL = {
    "audit_basic": _BASIC,
    "audit_full": f"WITH {_CATEGORIES}\n{_FULL}",
    "bill_sections": f"WITH {_CATEGORIES}\n{_BILL}",
    "audit_driver_tables": "\nUNION ALL ".join(
        _driver(r.table, r.column, r.sentinels, " AND ".join(r.terms) or "TRUE") for r in DRIVER_RULES
    ),
    "audit_linked": "\nUNION ALL ".join(
        [
            _document("labels", "SELECT doc_id FROM labels"),
            _document("labels.quality", _DOCUMENT.format("quality")),
            _document("labels.toxic", _DOCUMENT.format("toxic")),
        ]
    ),
    "audit_missing_linked_rows": """
SELECT 'labels' AS missing, * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'labels.quality', * FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND CAST(quality AS VARCHAR) NOT IN ('', '0'))
UNION ALL SELECT 'labels.toxic', * FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL AND CAST(toxic AS VARCHAR) NOT IN ('', '0'))""",
    "audit_missing_rows": """
SELECT * FROM nondrugitems WHERE istatus = 'Y' AND (price IS NULL OR CAST(price AS VARCHAR) IN ('', '0', '0.00'))
ORDER BY CASE WHEN istatus = 'Y' THEN 0 ELSE 1 END, icode""",
    "table_counts": """
SELECT 'officer_group' AS table_name, count(*) AS cnt FROM officer_group
UNION ALL SELECT 'officer_group_module_access', count(*) FROM officer_group_module_access
UNION ALL SELECT 'officer_group_task_access', -1""",
    "table_contract": "\nUNION ALL ".join(
        f"SELECT '{r}' AS required, 'Y' AS present, count(*) AS n_rows FROM {r.split('.')[0]}" for r in REQUIRED
    ),
    "section_score": _scored("SELECT section, pct, n_full, n_short FROM scores"),
    "section_score_weighted": _scored("SELECT section, pct, tot, ok, missing FROM records"),
    "overall_score": _scored("""
SELECT count(*) FILTER (WHERE pct = 100) AS complete, count(*) FILTER (WHERE pct <> 100) AS incomplete,
  (SELECT CAST(round(round(avg(share), 9) * 100) AS BIGINT) FROM valid) AS overall_pct FROM scores"""),
    "score_bands": _scored("""
SELECT s.section, s.pct AS rule_pct, r.pct AS record_pct,
  CASE WHEN s.pct >= 90 THEN 'green' WHEN s.pct >= 60 THEN 'amber' ELSE 'red' END AS rule_band,
  CASE WHEN r.pct IS NULL THEN 'skip-all' WHEN r.pct >= 100 THEN 'perfect' WHEN r.pct >= 90 THEN 'good'
       WHEN r.pct >= 70 THEN 'warning' ELSE 'danger' END AS record_band
FROM scores s JOIN records r ON r.section = s.section"""),
    "fund_scoreboard": _scoreboard(
        [_file_count(n, _FUND_SQL[n], f.checks, _FUND_PRESENT) for n, f in FUND_FILES.items()]
    ),
    "basic_scoreboard": _scoreboard(
        [_file_count(n, oracle_catalogue.SQL[_BASIC_SQL[n]], f.checks, f.checks) for n, f in BASIC_FILES.items()]
    ),
    "errors_only": f"SELECT * FROM ({oracle_inpatient.SQL['cipn_group46']}) WHERE auth_code_check = 'N'",
    "check_breakdown": "WITH f AS (" + oracle_fdh.SQL["fdh_opd"] + ")\n" + "\nUNION ALL ".join(
        f"SELECT 'check_{c}' AS check_name, count(*) AS total, count(*) FILTER (WHERE check_{c} = 'N') AS failed FROM f"
        for c in _OPD_CHECKS
    ),
}
