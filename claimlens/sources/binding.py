"""The hospital schema derived from the driver tables.

One SQL text per hospital table, in the subset that Spark and DuckDB read the
same way.  ``{name}`` stands for another table; small code lists take their key
``k`` from ``{keys}``, which is the nation table where visits look codes up and
the supplier table where the list itself is the thing being checked (so that a
catalogue check has as much to do as the data has to offer).
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from claimlens.sources.tables import Tables

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


# -- small SQL writers -------------------------------------------------------


def txt(x) -> str:
    return f"CAST({x} AS STRING)"


def pad(x, n: int) -> str:
    """At least ``n`` digits, never cut."""
    digits = f"CAST({x} AS STRING)"
    return f"CASE WHEN length({digits}) < {n} THEN lpad({digits}, {n}, '0') ELSE {digits} END"


def two(x) -> str:
    """At least two digits, never cut (lpad would cut a longer code)."""
    return f"CASE WHEN {x} < 10 THEN '0' || CAST({x} AS STRING) ELSE CAST({x} AS STRING) END"


def dec(x) -> str:
    return f"CAST({x} AS DECIMAL(12,2))"


def nul(k, n: int, x) -> str:
    return f"CASE WHEN {k} % {n} = 0 THEN NULL ELSE {x} END"


def emp(k, n: int, m: int, x) -> str:
    return f"CASE WHEN {k} % {n} = 0 THEN NULL WHEN {k} % {m} = 0 THEN '' ELSE {x} END"


def yn(k, n: int) -> str:
    return f"CASE WHEN {k} % {n} = 0 THEN 'N' ELSE 'Y' END"


def days(d, n) -> str:
    return f"{d} + CAST({n} AS INT)"


def item(k) -> str:
    """Item code: drugs start with 1 (even part key), everything else with 3."""
    return f"(CASE WHEN {k} % 2 = 0 THEN '1' ELSE '3' END) || {pad(k, 9)}"


def service_of(k) -> str:
    """The non-drug item a code-list row points at (an odd part key)."""
    return f"'3' || {pad(f'(2 * {k} + 1)', 9)}"


def icd10_of(k) -> str:
    return (
        f"CASE WHEN {k} % 23 = 0 THEN NULL WHEN {k} % 29 = 0 THEN '' "
        f"WHEN {k} % 50 = 3 THEN 'Z510' WHEN {k} % 50 = 4 THEN 'Z511' "
        f"WHEN {k} % 10 IN (0, 5) THEN 'C' || {pad(f'({k} % 100)', 2)} "
        f"WHEN {k} % 10 = 7 THEN 'c' || {pad(f'({k} % 100)', 2)} "
        f"WHEN {k} % 10 = 1 THEN {pad(f'({k} % 1000)', 4)} "
        f"ELSE 'J' || {pad(f'({k} % 100)', 2)} END"
    )


def icd9_of(k) -> str:
    return (
        f"CASE WHEN {k} % 20 = 0 THEN NULL WHEN {k} % 20 = 1 THEN '' "
        f"WHEN {k} % 20 IN (2, 3, 4) THEN '9224' WHEN {k} % 20 IN (5, 6, 7) THEN '9925' "
        f"ELSE {pad(f'(1000 + {k} % 40)', 4)} END"
    )


def clock(k) -> str:
    return f"{pad(f'(8 + {k} % 9)', 2)} || ':' || {pad(f'({k} % 60)', 2)} || ':00'"


VISIT_DAY = "CAST(o_orderdate AS DATE)"
SHIP_DAY = "CAST(l_shipdate AS DATE)"
PAYER = txt("(10 + o_orderkey % 25)")
AN = "'A' || CAST(o_orderkey AS STRING)"


def _payer_row(number: str, payer: str, auth_prefix: str) -> str:
    k = "o_orderkey"
    auth = f"CASE WHEN {k} % 4 = 1 THEN 'PP' ELSE '{auth_prefix}' END || CAST({k} AS STRING)"
    return f"""{payer} AS pttype, '{number}' AS pttype_number,
        {emp(k, 6, 8, auth)} AS auth_code,
        {emp(k, 5, 9, pad(f'({k} % 99999)', 5))} AS hospmain,
        {emp(k, 7, 11, pad(f'({k} % 77777)', 5))} AS hospsub,
        {nul(k, 4, days(VISIT_DAY, f'{k} % 365'))} AS expire_date,
        {nul(k, 3, f"'C' || CAST({k} AS STRING)")} AS claim_code"""


_REQUEST = (
    "CASE WHEN o_orderkey % 4 = 0 THEN 'Y' WHEN o_orderkey % 4 = 1 THEN 'N' "
    "WHEN o_orderkey % 4 = 2 THEN '' ELSE NULL END"
)
_SECOND = txt("(10 + (o_orderkey + 1) % 25)")

FACTS: dict[str, str] = {}

FACTS["ovst"] = f"""
SELECT {txt('o_orderkey')} AS vn, {txt('o_custkey')} AS hn, {VISIT_DAY} AS vstdate,
    {clock('o_orderkey')} AS vsttime, {PAYER} AS pttype,
    {pad('(1 + o_custkey % 14)', 2)} AS spclty,
    {nul('o_orderkey', 13, pad('(1 + o_orderkey % 5)', 2))} AS ovstist,
    {nul('o_orderkey', 11, pad('(1 + o_orderkey % 4)', 2))} AS ovstost,
    CASE WHEN o_orderstatus = 'P' THEN {AN} END AS an,
    o_orderkey % 500 AS oqueue, {txt('(o_orderkey % 40)')} AS staff,
    {dec('o_totalprice')} AS income, o_orderstatus AS status
FROM {{orders}}"""

FACTS["ipt"] = f"""
SELECT {AN} AS an, {txt('o_orderkey')} AS vn, {txt('o_custkey')} AS hn, {PAYER} AS pttype,
    {VISIT_DAY} AS regdate, {days(VISIT_DAY, 'o_orderkey % 9')} AS dchdate,
    {clock('o_orderkey')} AS regtime, {nul('o_orderkey', 19, clock('(o_orderkey + 5)'))} AS dchtime,
    {nul('o_orderkey', 7, txt('(1 + o_orderkey % 5)'))} AS dchstts,
    {nul('o_orderkey', 6, txt('(1 + o_orderkey % 4)'))} AS dchtype,
    {nul('o_orderkey', 17, pad('(1 + o_orderkey % 20)', 2))} AS first_ward,
    {nul('o_orderkey', 18, pad('(1 + o_orderkey % 22)', 2))} AS ward,
    {nul('o_orderkey', 31, pad('(1 + o_custkey % 14)', 2))} AS spclty,
    {nul('o_orderkey', 5, '2500 + o_orderkey % 1500')} AS bw,
    {nul('o_orderkey', 16, txt('(1 + o_orderkey % 4)'))} AS ipt_type,
    {txt('(1 + o_orderkey % 6)')} AS ipt_admit_type_id
FROM {{orders}} WHERE o_orderstatus = 'P'"""

FACTS["opitemrece"] = f"""
SELECT {txt('l_orderkey')} AS vn,
    CASE WHEN o_orderstatus = 'P' THEN {AN} END AS an, {txt('o_custkey')} AS hn, {PAYER} AS pttype,
    {item('l_partkey')} AS icode, {nul('l_partkey', 97, dec('l_quantity'))} AS qty,
    CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN {dec(0)}
         ELSE {dec('(900 + l_partkey % 1000)')} END AS unitprice,
    {nul('l_partkey', 37, dec('(800 + l_partkey % 900)'))} AS cost,
    CASE WHEN l_partkey % 89 = 0 THEN {dec(0)} ELSE {dec('l_extendedprice')} END AS sum_price,
    {dec('l_discount')} AS discount, {pad('(1 + l_partkey % 21)', 2)} AS income,
    CASE l_returnflag WHEN 'A' THEN '01' WHEN 'R' THEN '02' ELSE '03' END AS paidst,
    {VISIT_DAY} AS vstdate, {clock('o_orderkey')} AS vsttime, {SHIP_DAY} AS rxdate,
    {emp('l_suppkey', 6, 7, pad('(l_suppkey % 50)', 3))} AS drugusage,
    {txt('l_suppkey')} AS doctor, {txt('(l_suppkey % 5)')} AS staff,
    CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
        || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS hos_guid
FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey"""

FACTS["visit_pttype"] = f"""
SELECT {txt('o_orderkey')} AS vn, {_payer_row('1', PAYER, 'AU')}, {_REQUEST} AS request_funds,
    {txt('(o_orderkey % 1000)')} AS pttypeno
FROM {{orders}} WHERE o_orderkey % 33 <> 0
UNION ALL
SELECT {txt('o_orderkey')} AS vn, {_payer_row('2', _SECOND, 'AV')}, {_REQUEST} AS request_funds,
    {txt('(o_orderkey % 900)')} AS pttypeno
FROM {{orders}} WHERE o_orderkey % 10 = 0"""

FACTS["ipt_pttype"] = f"""
SELECT {AN} AS an, {_payer_row('1', PAYER, 'AU')}
FROM {{orders}} WHERE o_orderstatus = 'P' AND o_orderkey % 34 <> 0
UNION ALL
SELECT {AN} AS an, {_payer_row('2', _SECOND, 'AV')}
FROM {{orders}} WHERE o_orderstatus = 'P' AND o_orderkey % 10 = 0"""

_MONEY = f"""{nul('o_orderkey', 26, dec('o_totalprice'))} AS income,
    {dec('(o_orderkey % 700)')} AS paid_money, {nul('o_orderkey', 27, dec('(o_orderkey % 9000)'))} AS uc_money,
    {emp('o_custkey', 17, 19, pad('o_custkey', 13))} AS cid"""

FACTS["vn_stat"] = f"""
SELECT {txt('o_orderkey')} AS vn, {txt('o_custkey')} AS hn, {_MONEY},
    {emp('o_orderkey', 3, 4, "'J00'")} AS dx0, {emp('o_orderkey', 5, 6, "'J01'")} AS dx1,
    {emp('o_orderkey', 2, 7, "'J02'")} AS dx2, {emp('o_orderkey', 4, 9, "'J03'")} AS dx3,
    CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'J04' END AS dx4, 'J05' AS dx5
FROM {{orders}} WHERE o_orderkey % 37 <> 0"""

FACTS["an_stat"] = f"""
SELECT {AN} AS an, {txt('o_custkey')} AS hn, {_MONEY},
    {nul('o_orderkey', 21, 'o_orderkey % 3')} AS age_y, o_orderkey % 2 AS age_m, o_orderkey % 40 AS age_d
FROM {{orders}} WHERE o_orderstatus = 'P' AND o_orderkey % 29 <> 0"""


def _debt(seq: int, extra: str) -> str:
    return f"""
SELECT o_orderkey * 2 + {seq} AS debt_id,
    CASE WHEN o_orderstatus = 'P' THEN {AN} ELSE {txt('o_orderkey')} END AS vn,
    {txt('o_custkey')} AS hn, {PAYER} AS pttype, {dec('o_totalprice')} AS amount,
    CASE WHEN o_orderkey % 14 = 0 THEN {dec(0)} ELSE {dec('o_totalprice')} END AS total_amount,
    {VISIT_DAY} AS debt_date, o_orderdate AS debt_date_time,
    {emp('o_orderkey', 4, 9, f"'V' || CAST(o_orderkey * 2 + {seq} AS STRING)")} AS sss_approval_code,
    {dec('(o_orderkey % 30)')} AS discount_amount,
    {nul('o_orderkey', 12, yn('o_orderkey', 5))} AS paid, o_orderkey AS finance_number
FROM {{orders}} WHERE o_orderkey % 3 <> 0{extra}"""


FACTS["rcpt_debt"] = _debt(0, "") + "\nUNION ALL" + _debt(1, " AND o_orderkey % 8 = 1")

FACTS["rcpt_debt_detail"] = f"""
SELECT o_orderkey * 2 AS debt_id, '01' AS income, {dec('o_totalprice')} AS total_amount
FROM {{orders}} WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0
UNION ALL
SELECT o_orderkey * 2 AS debt_id, '03' AS income, {dec('(o_orderkey % 500)')} AS total_amount
FROM {{orders}} WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0"""

FACTS["rcpt_print"] = f"""
SELECT 'R' || CAST(o_orderkey AS STRING) AS rcpno, {txt('o_orderkey')} AS vn,
    {dec('(o_orderkey % 800)')} AS bill_amount
FROM {{orders}} WHERE o_orderkey % 4 = 0
UNION ALL
SELECT 'S' || CAST(o_orderkey AS STRING) AS rcpno, {txt('o_orderkey')} AS vn,
    {dec('(o_orderkey % 300)')} AS bill_amount
FROM {{orders}} WHERE o_orderkey % 20 = 0"""


def _income_sums(key: str) -> str:
    return f"""
SELECT {key}, {pad('(1 + l_partkey % 21)', 2)} AS income,
    CASE l_returnflag WHEN 'A' THEN '01' WHEN 'R' THEN '02' ELSE '03' END AS paidst,
    CAST(SUM({dec('l_extendedprice')}) AS DECIMAL(18,2)) AS rcptamt
FROM {{lineitem}}
GROUP BY l_orderkey, 1 + l_partkey % 21, l_returnflag"""


FACTS["incoth"] = _income_sums(f"{txt('l_orderkey')} AS vn")
FACTS["incith"] = _income_sums("'A' || CAST(l_orderkey AS STRING) AS an")


def _diagnosis(key: str, id_name: str, join: str, extra: str) -> str:
    return f"""
SELECT {key}, line_key AS {id_name}, {icd10_of('part_key')} AS icd10,
    CASE WHEN part_key % 31 = 0 THEN NULL WHEN part_key % 33 = 0 THEN ''
         ELSE {txt('(1 + line_no % 4)')} END AS diagtype,
    {nul('supp_key', 14, txt('supp_key'))} AS doctor, line_no AS diag_no{extra}
FROM (SELECT l_orderkey, l_linenumber AS line_no, l_orderkey * 8 + l_linenumber AS line_key,
        MIN(l_partkey) AS part_key, MIN(l_suppkey) AS supp_key, MIN(l_shipdate) AS ship
      FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) AS lines {join}"""


FACTS["ovstdiag"] = _diagnosis(
    txt("l_orderkey") + " AS vn, " + txt("o_custkey") + f" AS hn, {VISIT_DAY} AS vstdate",
    "ovst_diag_id",
    "JOIN {orders} ON o_orderkey = l_orderkey",
    f", {clock('o_orderkey')} AS vsttime",
)
FACTS["iptdiag"] = _diagnosis(
    "'A' || CAST(l_orderkey AS STRING) AS an", "ipt_diag_id", "", ", ship AS entry_datetime"
)


def _procedure(key: str, residue: int, extra: str) -> str:
    return f"""
SELECT {key}, line_key AS {{id_name}}, {icd9_of('part_key')} AS icd9,
    {nul('supp_key', 14, txt('supp_key'))} AS doctor, {txt('(supp_key % 60)')} AS er_oper_code{extra}
FROM (SELECT l_orderkey, l_linenumber AS line_no, l_orderkey * 8 + l_linenumber AS line_key,
        MIN(l_partkey) AS part_key, MIN(l_suppkey) AS supp_key, MIN(l_shipdate) AS ship
      FROM {{lineitem}} WHERE l_linenumber % 3 = {residue} GROUP BY l_orderkey, l_linenumber) AS lines"""


FACTS["doctor_operation"] = _procedure(f"{txt('l_orderkey')} AS vn", 0, "").replace(
    "{id_name}", "doctor_operation_id"
)
FACTS["iptoprt"] = _procedure(
    "'A' || CAST(l_orderkey AS STRING) AS an",
    1,
    f""", {nul('part_key', 9, 'CAST(ship AS DATE)')} AS opdate,
    CASE WHEN part_key % 8 = 0 THEN NULL WHEN part_key % 7 = 0 THEN '00:00:00' ELSE {clock('part_key')} END AS optime,
    {nul('part_key', 6, days('CAST(ship AS DATE)', 'part_key % 3'))} AS enddate,
    CASE WHEN part_key % 5 = 0 THEN NULL WHEN part_key % 11 = 0 THEN '00:00:00' ELSE {clock('supp_key')} END AS endtime,
    {txt('(1 + supp_key % 5)')} AS oper_type, line_no AS priority""",
).replace("{id_name}", "iptoprt_id")

FACTS["opdscreen"] = f"""
SELECT {txt('o_orderkey')} AS vn, {emp('o_orderkey', 7, 10, "'cc ' || CAST(o_orderkey % 9 AS STRING)")} AS cc,
    {nul('o_orderkey', 8, 'CAST(36 + o_orderkey % 4 AS DECIMAL(4,1))')} AS temperature,
    {nul('o_orderkey', 9, '100 + o_orderkey % 60')} AS bps, {nul('o_orderkey', 10, '60 + o_orderkey % 40')} AS bpd,
    {nul('o_orderkey', 11, '60 + o_orderkey % 50')} AS pulse, {nul('o_orderkey', 13, '12 + o_orderkey % 12')} AS rr
FROM {{orders}} WHERE o_orderkey % 6 <> 0"""
FACTS["ovst_seq"] = f"""
SELECT {txt('o_orderkey')} AS vn,
    {nul('o_orderkey', 7, "'fs' || CAST(o_orderkey % 5 AS STRING)")} AS nhso_fee_schedule_list_text
FROM {{orders}} WHERE o_orderkey % 5 <> 0"""
FACTS["er_regist"] = f"""
SELECT {txt('o_orderkey')} AS vn, {nul('o_orderkey', 18, txt('(1 + o_orderkey % 4)'))} AS er_leave_status_id
FROM {{orders}} WHERE o_orderkey % 9 = 0"""
FACTS["oapp"] = f"""
SELECT {txt('o_orderkey')} AS vn, {days(VISIT_DAY, '7 + o_orderkey % 30')} AS nextdate
FROM {{orders}} WHERE o_orderkey % 8 = 0
UNION ALL
SELECT {txt('o_orderkey')} AS vn, {days(VISIT_DAY, '60 + o_orderkey % 30')} AS nextdate
FROM {{orders}} WHERE o_orderkey % 40 = 0"""
_REFER_KEY = f"CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN {AN} ELSE {txt('o_orderkey')} END AS vn"
FACTS["referout"] = f"""
SELECT {_REFER_KEY}, {emp('o_orderkey', 16, 12, pad('(o_orderkey % 20000)', 5))} AS refer_hospcode,
    {txt('(1 + o_orderkey % 3)')} AS refer_type, {nul('o_orderkey', 24, txt('(1 + o_orderkey % 5)'))} AS referout_type_id
FROM {{orders}} WHERE o_orderkey % 4 = 0 OR o_orderkey % 25 = 1"""
FACTS["referin"] = f"""
SELECT {_REFER_KEY}, {pad('(o_orderkey % 20000)', 5)} AS refer_hospcode
FROM {{orders}} WHERE o_orderkey % 15 = 0 OR o_orderkey % 25 = 2"""
FACTS["ipt_home_leave"] = f"""
SELECT {AN} AS an, o_orderkey AS ipt_home_leave_id,
    {nul('o_orderkey', 10, days(VISIT_DAY, 'o_orderkey % 5'))} AS dch_date,
    {nul('o_orderkey', 14, clock('o_orderkey'))} AS dch_time,
    {nul('o_orderkey', 15, days(VISIT_DAY, 'o_orderkey % 5 + o_orderkey % 4 - 1'))} AS reg_date,
    {nul('o_orderkey', 22, clock('(o_orderkey + 3)'))} AS reg_time
FROM {{orders}} WHERE o_orderstatus = 'P' AND o_orderkey % 6 IN (0, 1)"""
FACTS["ovst_presc_ned"] = f"""
SELECT {txt('l_orderkey')} AS vn, {item('l_partkey')} AS icode, {txt('l_suppkey')} AS doctor,
    {nul('l_partkey', 7, "'E' || CAST(1 + l_partkey % 8 AS STRING)")} AS presc_reason,
    {nul('l_suppkey', 3, "'PA' || CAST(l_suppkey AS STRING)")} AS nhso_authorize_code
FROM {{lineitem}} GROUP BY l_orderkey, l_partkey, l_suppkey"""
FACTS["ovst_doctor_diag"] = f"""
SELECT {txt('l_orderkey')} AS vn,
    {nul('l_partkey', 13, "'dx ' || CAST(l_partkey % 50 AS STRING)")} AS diag_text
FROM {{lineitem}}"""
FACTS["opi_dispense"] = f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
        || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS hos_guid,
    'D' || CAST(l_orderkey * 8 + l_linenumber AS STRING) AS opi_dispense_id,
    {txt('(1 + l_partkey % 3)')} AS dose, 'tab' AS unit_name, 'od' AS frequency_code, 'u1' AS usage_unit_code
FROM {{lineitem}} WHERE l_partkey % 3 = 0
GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey"""
FACTS["lab_head"] = f"""
SELECT {txt('o_orderkey')} AS vn, o_orderkey AS lab_order_number FROM {{orders}} WHERE o_orderkey % 4 <> 1"""
FACTS["lab_order"] = f"""
SELECT l_orderkey AS lab_order_number, {txt('MIN(l_suppkey)')} AS lab_items_code,
    {nul('MIN(l_partkey)', 6, txt('(MIN(l_partkey) % 100)'))} AS lab_order_result
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber"""
FACTS["ptcardno"] = f"""
SELECT {txt('c_custkey')} AS hn, {txt('(1 + c_custkey % 3)')} AS cardtype FROM {{customer}} WHERE c_custkey % 3 <> 0
UNION ALL
SELECT {txt('c_custkey')} AS hn, '9' AS cardtype FROM {{customer}} WHERE c_custkey % 10 = 0"""

FACTS["patient"] = f"""
SELECT {txt('c_custkey')} AS hn,
    CASE c_custkey % 4 WHEN 0 THEN 'นาย' WHEN 1 THEN 'นาง' WHEN 2 THEN '' ELSE NULL END AS pname,
    {nul('c_custkey', 29, 'c_name')} AS fname, {emp('c_custkey', 29, 23, 'c_mktsegment')} AS lname,
    {emp('c_custkey', 17, 19, pad('c_custkey', 13))} AS cid,
    {nul('c_custkey', 31, days("DATE '1950-01-01'", 'c_custkey % 20000'))} AS birthday,
    {emp('c_custkey', 11, 13, txt('(1 + c_custkey % 2)'))} AS sex,
    {emp('c_custkey', 7, 9, txt('(1 + c_custkey % 6)'))} AS marrystatus,
    {emp('c_custkey', 5, 8, pad('(c_custkey % 900)', 3))} AS occupation,
    {emp('c_custkey', 12, 14, pad('(c_nationkey)', 3))} AS nationality,
    {emp('c_custkey', 15, 16, pad('(10 + c_custkey % 80)', 2))} AS chwpart,
    {emp('c_custkey', 18, 21, pad('(1 + c_custkey % 20)', 2))} AS amppart
FROM {{customer}}"""

_CONTROLLED = (
    "CASE p_partkey % 40 WHEN 0 THEN 'Morphine sulfate' WHEN 4 THEN 'fentanyl patch' WHEN 8 THEN 'DIAZEPAM tab' "
    "WHEN 12 THEN 'Ketamine inj' WHEN 16 THEN 'Phenobarbital' WHEN 20 THEN 'Midazolam' "
    "WHEN 24 THEN 'Mitragyna leaf' WHEN 28 THEN 'Ethylmorphine' WHEN 32 THEN 'Heroin' WHEN 36 THEN 'Codeine syrup' "
    "ELSE 'generic ' || p_type END"
)
FACTS["drugitems"] = f"""
SELECT {item('p_partkey')} AS icode, p_name AS name, {nul('p_partkey', 16, "CAST(p_size AS STRING) || ' mg'")} AS strength,
    {emp('p_partkey', 22, 26, 'p_type')} AS units, {dec('p_retailprice')} AS unitprice,
    {nul('p_partkey', 6, dec('(p_partkey % 7)'))} AS sks_price, {nul('p_partkey', 9, dec('p_retailprice'))} AS sks_reimb_price,
    {emp('p_partkey', 5, 8, "'SD' || CAST(p_partkey % 300 AS STRING)")} AS sks_drug_code,
    {nul('p_partkey', 14, txt('(1 + p_partkey % 9)'))} AS sks_product_category_id,
    {nul('p_partkey', 18, txt('(1 + p_partkey % 7)'))} AS sks_clain_control_type_id,
    {nul('p_partkey', 15, "'DID' || CAST(p_partkey AS STRING)")} AS did,
    {nul('p_partkey', 11, "'TP' || CAST(p_partkey AS STRING)")} AS tmt_tp_code,
    {emp('p_partkey', 12, 10, "'GP' || CAST(p_partkey AS STRING)")} AS tmt_gp_code,
    {nul('p_partkey', 21, '1 + p_partkey % 100')} AS packqty, {emp('p_partkey', 28, 34, 'p_brand')} AS dosageform,
    {_CONTROLLED} AS generic_name, {emp('p_partkey', 13, 17, 'p_brand')} AS trade_name,
    CASE WHEN p_partkey % 46 = 0 THEN 'กัญชา' WHEN p_partkey % 38 = 0 THEN 'ทราเมดอล' ELSE {emp('p_partkey', 3, 4, 'p_name')} END AS thai_name,
    {pad('(1 + p_partkey % 21)', 2)} AS income, {nul('p_partkey', 7, txt('(1 + p_partkey % 20)'))} AS nhso_adp_type_id,
    {nul('p_partkey', 19, "'ADP' || CAST(p_partkey % 100 AS STRING)")} AS nhso_adp_code,
    {emp('p_partkey', 24, 25, "'TT' || CAST(p_partkey AS STRING)")} AS ttmt_code,
    {emp('p_partkey', 3, 5, txt('(1 + p_partkey % 9)'))} AS drug_control_type_id,
    {nul('p_partkey', 23, "'CC' || CAST(p_partkey % 5 AS STRING)")} AS csmbs_claim_cat,
    {nul('p_partkey', 32, "'df' || CAST(p_partkey % 6 AS STRING)")} AS sks_dfs_code,
    {nul('p_partkey', 32, 'p_brand')} AS sks_dfs_text,
    CASE WHEN p_partkey % 20 = 0 THEN {dec(0)} ELSE {dec('p_retailprice')} END AS price1,
    {emp('p_partkey', 30, 36, txt('(1 + p_partkey % 4)'))} AS drugaccount,
    {yn('p_partkey', 10)} AS istatus
FROM {{part}} WHERE p_partkey % 2 = 0"""
FACTS["nondrugitems"] = f"""
SELECT {item('p_partkey')} AS icode,
    CASE WHEN p_partkey % 19 = 0 THEN p_name || ' & <set>' WHEN p_partkey % 27 = 0 THEN p_name || ' ''q'''
         WHEN p_partkey % 25 = 0 THEN p_name || ' ส่วนเกิน' ELSE p_name END AS name,
    {emp('p_partkey', 9, 15, "'EN ' || p_name")} AS ename, {emp('p_partkey', 21, 35, 'p_brand')} AS unit,
    CASE WHEN p_partkey % 33 = 0 THEN {dec(0)} ELSE {nul('p_partkey', 45, dec('p_retailprice'))} END AS price,
    CASE WHEN p_partkey % 31 = 0 THEN {dec(0)} ELSE {dec('(p_partkey % 500)')} END AS unitcost,
    {nul('p_partkey', 7, "'B' || CAST(p_partkey % 400 AS STRING)")} AS billcode,
    {pad('(1 + p_partkey % 21)', 2)} AS income, {nul('p_partkey', 39, txt('(1 + p_partkey % 20)'))} AS nhso_adp_type_id,
    CASE WHEN p_partkey % 17 = 1 THEN 'WALKIN' WHEN p_partkey % 13 = 2 THEN 'CANCER'
         WHEN p_partkey % 11 = 3 THEN 'ADP30001' ELSE {emp('p_partkey', 5, 23, "'ADP' || CAST(p_partkey % 100 AS STRING)")} END AS nhso_adp_code,
    {nul('p_partkey', 11, txt('(1 + p_partkey % 9)'))} AS sks_product_category_id,
    CASE p_partkey % 5 WHEN 0 THEN {dec(0)} WHEN 1 THEN {dec(0.5)} WHEN 2 THEN NULL ELSE {dec('(p_partkey % 90)')} END AS sks_coverage_price,
    CASE p_partkey % 4 WHEN 1 THEN 'Y' ELSE {emp('p_partkey', 3, 7, "'N'")} END AS enable_sks_opd,
    {emp('p_partkey', 3, 5, "'Y'")} AS enable_sks_ipd, {emp('p_partkey', 5, 7, "'N'")} AS no_remed,
    {emp('p_partkey', 4, 15, "'PH' || CAST(p_partkey % 60 AS STRING)")} AS income_phdb_code,
    {yn('p_partkey', 13)} AS istatus
FROM {{part}} WHERE p_partkey % 2 = 1"""
FACTS["s_drugitems"] = f"""
SELECT {item('p_partkey')} AS icode, p_name AS name,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) || ' mg' END AS strength,
    CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS units
FROM {{part}} WHERE p_partkey % 51 <> 0"""
FACTS["nondrugitems_sks_bc"] = f"""
SELECT {item('p_partkey')} AS icode,
    CASE p_partkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'T' ELSE NULL END AS claim_cat,
    {nul('p_partkey', 5, days("DATE '2020-01-01'", 'p_partkey % 1000'))} AS rev_date,
    {emp('p_partkey', 7, 9, pad('(1 + p_partkey % 16)', 2))} AS income,
    {emp('p_partkey', 11, 13, "'K' || CAST(p_partkey % 90 AS STRING)")} AS bill_code,
    {nul('p_partkey', 17, dec('(p_partkey % 4)'))} AS claim_amount
FROM {{part}} WHERE p_partkey % 4 = 1"""
FACTS["drugitems_sks"] = f"SELECT {item('p_partkey')} AS icode FROM {{part}} WHERE p_partkey % 6 = 0"
_NAMED = "p_name AS name, CAST(p_size AS STRING) || ' mg' AS strength, p_type AS units"
FACTS["drugitems_cancer"] = f"SELECT {item('p_partkey')} AS icode, {_NAMED} FROM {{part}} WHERE p_partkey % 8 = 0"
FACTS["drug_morphine"] = f"""
SELECT p_partkey AS drug_morphine_id, {item('p_partkey')} AS icode, {_NAMED} FROM {{part}} WHERE p_partkey % 10 = 0"""

FACTS["doctor"] = f"""
SELECT {txt('s_suppkey')} AS code,
    CASE WHEN s_suppkey % 30 = 7 THEN 'BMS admin' WHEN s_suppkey % 30 = 9 THEN 'x bms' ELSE s_name END AS name,
    CASE s_suppkey % 5 WHEN 0 THEN 'นพ.' WHEN 1 THEN 'พญ.' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'Dr' END AS pname,
    {emp('s_suppkey', 12, 10, 's_name')} AS fname, {emp('s_suppkey', 8, 9, "'Fam' || CAST(s_suppkey AS STRING)")} AS lname,
    {emp('s_suppkey', 6, 11, "'Dr ' || s_name")} AS ename,
    CASE s_suppkey % 4 WHEN 0 THEN {pad('s_suppkey', 13)} WHEN 1 THEN {pad('s_suppkey', 12)} WHEN 2 THEN '' ELSE NULL END AS cid,
    CASE s_suppkey % 11 WHEN 0 THEN 'ว.' || CAST(s_suppkey AS STRING) WHEN 1 THEN 'ว' || CAST(s_suppkey AS STRING)
        WHEN 2 THEN '-99999' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'พ' || CAST(s_suppkey AS STRING)
        WHEN 6 THEN 'พ.' || CAST(s_suppkey AS STRING) WHEN 7 THEN 'พป' || CAST(s_suppkey AS STRING)
        WHEN 8 THEN 'ก' || CAST(s_suppkey AS STRING) WHEN 9 THEN '-' ELSE 'X' || CAST(s_suppkey AS STRING) END AS licenseno,
    {nul('s_suppkey', 24, '1 + s_suppkey % 15')} AS position_id,
    {nul('s_suppkey', 21, "CASE WHEN s_suppkey % 6 = 1 THEN '081' WHEN s_suppkey % 6 = 2 THEN '082' WHEN s_suppkey % 6 = 3 THEN '084' ELSE '01' END")} AS provider_type_code,
    {nul('s_suppkey', 13, days("DATE '1960-01-01'", 's_suppkey % 9000'))} AS birth_date,
    {yn('s_suppkey', 9)} AS active
FROM {{supplier}}"""
FACTS["opdconfig"] = "SELECT '1000' || CAST(r_regionkey AS STRING) AS hospitalcode, r_name AS hospitalname FROM {region}"

# -- code lists: key k from {keys} -----------------------------------------

_HIP = "CASE k % 6 WHEN 0 THEN 'UCS' WHEN 1 THEN 'WEL' WHEN 2 THEN 'OFC' WHEN 3 THEN 'SSS' WHEN 4 THEN 'LGO' ELSE '' END"
_INSCL = "CASE k % 6 WHEN 2 THEN CASE WHEN k % 4 = 0 THEN 'o1' ELSE 'O' || CAST(k AS STRING) END WHEN 3 THEN 'S' || CAST(k AS STRING) ELSE 'U' || CAST(k AS STRING) END"


def _code_list(columns: str, where: str = "") -> str:
    return f"SELECT {columns} FROM {{keys}}{' WHERE ' + where if where else ''}"


def _pair(key: str, name: str, prefix: str, code: str | None = None, where: str = "") -> str:
    return _code_list(f"{code or txt('(1 + k)')} AS {key}, '{prefix} ' || CAST(k AS STRING) AS {name}", where)


LISTS: dict[str, str] = {
    "pttype": _code_list(
        f"""{txt('(10 + k)')} AS pttype, {nul('k', 25, "'scheme ' || CAST(k AS STRING)")} AS name,
        {nul('k', 11, "'P' || CAST(k AS STRING)")} AS pcode, {_HIP} AS hipdata_code, {yn('k', 11)} AS isuse,
        CASE WHEN k % 9 = 4 THEN '01' ELSE '02' END AS paidst, {nul('k', 10, _INSCL)} AS nhso_code,
        CASE WHEN k % 3 = 0 THEN '5' ELSE '6' END AS grouper_version, {emp('k', 7, 5, "'6.3'")} AS grouper_release,
        {emp('k', 8, 5, yn('k', 2))} AS print_presc_ned, {nul('k', 7, '1 + k % 9')} AS sks_benefit_plan_type_id,
        {nul('k', 9, '1 + k % 11')} AS pttype_upp_type_id, {yn('k', 3)} AS export_eclaim, {yn('k', 4)} AS default_request_funds,
        {nul('k', 12, yn('k', 2))} AS finance_round_money, {yn('k', 3)} AS inc_round_money, {yn('k', 5)} AS round_money,
        {nul('k', 6, txt('(k % 3)'))} AS hipdata_pttype, {yn('k', 2)} AS noexpire"""
    ),
    "pttype_upp_type": _code_list(
        "1 + k AS pttype_upp_type_id, 'upp ' || CAST(k AS STRING) AS pttype_upp_type_name, "
        "'C' || CAST(k AS STRING) AS pttype_upp_type_code",
        "k % 10 <> 4",
    ),
    "sks_benefit_plan_type": _code_list(
        "1 + k AS sks_benefit_plan_type_id, 'plan ' || CAST(k AS STRING) AS sks_benefit_plan_type_name, "
        "'B' || CAST(k AS STRING) AS sks_code",
        "k % 8 <> 5",
    ),
    "spclty": _code_list(
        f"""{two('(1 + k)')} AS spclty, 'dept ' || CAST(k AS STRING) AS name,
        {emp('k', 6, 4, pad('(k % 99999)', 5))} AS provis_code, {emp('k', 5, 7, pad('(k % 99)', 2))} AS nhso_code,
        {yn('k', 8)} AS active_status, {emp('k', 3, 4, "'N'")} AS no_export_43""",
        "k % 13 <> 9",
    ),
    "ovstist": _code_list(f"{two('(1 + k)')} AS ovstist, {nul('k', 3, txt('(1 + k % 4)'))} AS export_code"),
    "ovstost": _code_list(f"{two('(1 + k)')} AS ovstost, {nul('k', 4, txt('(1 + k % 5)'))} AS export_code"),
    "diagtype": _code_list(
        f"{txt('(1 + k)')} AS diagtype, 'type ' || CAST(k AS STRING) AS name, {nul('k', 4, txt('(1 + k)'))} AS nhso_code"
    ),
    "provis_diagtype": _pair("code", "name", "type", where="k % 3 <> 1"),
    "dchstts": _code_list(
        f"{txt('(1 + k)')} AS dchstts, 'status ' || CAST(k AS STRING) AS name, {emp('k', 4, 3, txt('(k % 9)'))} AS nhso_dchstts"
    ),
    "dchtype": _code_list(
        f"{txt('(1 + k)')} AS dchtype, 'way ' || CAST(k AS STRING) AS name, {emp('k', 3, 5, txt('(k % 9)'))} AS nhso_dchtype"
    ),
    "ward": _code_list(
        f"{two('(1 + k)')} AS ward, {emp('k', 9, 7, "'ward ' || CAST(k AS STRING)")} AS name, "
        f"{emp('k', 8, 5, two('(1 + k)'))} AS spclty, {yn('k', 6)} AS ward_active"
    ),
    "ipt_type": _pair("ipt_type", "ipt_type_name", "adm", where="k % 4 <> 3"),
    "oper_type": _pair("oper_type", "name", "op", where="k % 5 <> 2"),
    "income": _code_list(
        f"""{two('(1 + k)')} AS income, CASE WHEN k % 23 = 15 THEN 'ส่วนเกิน ' ELSE 'income ' END || CAST(k AS STRING) AS name,
        {nul('k', 6, txt('(1 + k % 12)'))} AS group2, {nul('k', 5, txt('(1 + k)'))} AS drg_group,
        {nul('k', 4, txt('(1 + k)'))} AS income_sss_group_code, {txt('(1 + k)')} AS std_group, {txt('(1 + k)')} AS income_csmbs_code,
        {nul('k', 7, txt('(1 + k)'))} AS nk2_group, {nul('k', 20, txt('(1 + k % 19)'))} AS drg_chrgitem_id, {txt('(1 + k)')} AS rvsp_group""",
        "k % 22 <> 18",
    ),
    "drg_chrgitem": _code_list(
        f"{txt('(1 + k)')} AS drg_chrgitem_id, 'chrg ' || CAST(k AS STRING) AS drg_chrgitem_name, "
        f"{nul('k', 9, two('(1 + k)') + " || '1'")} AS chrgitem_code1",
        "k % 17 <> 11",
    ),
    "income_report2": _pair("group_id", "group_name", "grp", where="k % 7 <> 3"),
    "drg_group": _pair("drg_group", "drg_group_name", "drg", where="k % 5 <> 3"),
    "income_report_sss": _pair("code", "name", "sss", where="k % 6 <> 3"),
    "income_std_group": _pair("std_group", "name", "std", where="k % 8 <> 3"),
    "income_csmbs": _pair("income_csmbs_code", "income_csmbs_name", "csmbs", where="k % 9 <> 3"),
    "income_nk2": _pair("nk2_group", "name", "nk2", where="k % 4 <> 3"),
    "income_rvsp_group": _pair("rvsp_group", "rvsp_name", "rvsp", where="k % 10 <> 3"),
    "nhso_adp_type": _pair("nhso_adp_type_id", "nhso_adp_type_name", "adp", where="k % 11 <> 5"),
    "nhso_adp_code": _code_list(
        "'ADP' || CAST(k AS STRING) AS nhso_adp_code, 'code ' || CAST(k AS STRING) AS nhso_adp_code_name", "k % 3 <> 0"
    ),
    "sks_product_category": _code_list(
        f"{txt('(1 + k)')} AS sks_product_category_id, {emp('k', 4, 5, "'cat ' || CAST(k AS STRING)")} AS sks_product_category_name, "
        "CASE WHEN k % 4 = 2 THEN 'ยาแผนไทย' ELSE 'modern' END AS name",
        "k % 9 <> 8",
    ),
    "sks_claim_control_type": _code_list(
        f"{txt('(1 + k)')} AS sks_claim_control_type_id, {emp('k', 3, 5, "'ctl ' || CAST(k AS STRING)")} AS sks_claim_control_type_name"
    ),
    "sks_drug_code": _code_list("'SD' || CAST(k AS STRING) AS sks_drug_code"),
    "drugusage": _code_list(
        f"""{pad('k', 3)} AS drugusage, {emp('k', 4, 7, "CASE WHEN k % 3 = 0 THEN '1x' ELSE '2x' END || CAST(k AS STRING)")} AS shortlist,
        {pad('k', 3)} AS code, {emp('k', 6, 5, "'use ' || CAST(k AS STRING)")} AS name1, {yn('k', 8)} AS status"""
    ),
    "drugitems_ned_reason_list": _code_list("'E' || CAST(1 + k AS STRING) AS claim_control"),
    "doctor_position": _code_list("1 + k AS id, 'pos ' || CAST(k AS STRING) AS name", "k % 6 <> 5"),
    "position_check": _code_list(
        "k AS position_check_id, 1 + k AS position_id, 'pos ' || CAST(k AS STRING) AS position_name", "k % 3 = 0"
    ),
    "pname": _code_list(
        f"""CASE k WHEN 0 THEN 'นพ.' WHEN 1 THEN 'พญ.' WHEN 2 THEN 'นาย' ELSE 'title ' || CAST(k AS STRING) END AS name,
        {txt('(1 + k % 2)')} AS sex, {nul('k', 6, emp('k', 4, 5, pad('(1 + k)', 3)))} AS provis_code"""
    ),
    "provis_pname": _code_list(
        f"{pad('(1 + k)', 3)} AS provis_pname_code, 'long ' || CAST(k AS STRING) AS provis_pname_long_name", "k % 5 <> 3"
    ),
    "nationality": _code_list(
        f"{two('k')} AS nationality, CASE WHEN k % 4 = 1 THEN 'Other' ELSE 'Nation ' || CAST(k AS STRING) END AS name, "
        f"{nul('k', 7, two('k'))} AS nhso_code"
    ),
    "provis_nation": _pair("code", "name", "Nation", two("k"), "k % 5 <> 2"),
    "marrystatus": _code_list(
        f"{txt('(1 + k)')} AS code, 'marry ' || CAST(k AS STRING) AS name, {nul('k', 5, txt('(1 + k)'))} AS nhso_marriage_code"
    ),
    "provis_mstatus": _pair("code", "name", "ms", where="k % 4 <> 1"),
    "occupation": _code_list(
        f"{two('k')} AS occupation, 'job ' || CAST(k AS STRING) AS name, {emp('k', 5, 6, two('k'))} AS nhso_code"
    ),
    "provis_occupa": _pair("code", "name", "job", two("k"), "k % 4 <> 1"),
    "religion": _code_list(
        f"{two('k')} AS religion, 'rel ' || CAST(k AS STRING) AS name, {nul('k', 6, two('k'))} AS nhso_code"
    ),
    "provis_religion": _pair("code", "name", "rel", two("k"), "k % 3 <> 1"),
    "provis_instype": _code_list("CASE WHEN k % 2 = 0 THEN 'U' || CAST(k AS STRING) ELSE 'S' || CAST(k AS STRING) END AS code"),
    "sex": _pair("code", "name", "sex"),
    "pcode": _pair("pcode", "name", "std", "'P' || CAST(k AS STRING)"),
    "nhso_inscl_code": _pair("inscl_code", "inscl_name", "inscl", "'O' || CAST(k AS STRING)"),
    "drugcat": _code_list(
        f"k AS drugcat_id, 'cat ' || CAST(k AS STRING) AS drugcat_name, {txt('(1 + k % 3)')} AS drug_usage_type_id"
    ),
    "lab_catalog": _code_list(
        f"{service_of('k')} AS lab_catalog_lc_code, 'lab ' || CAST(k AS STRING) AS lab_catalog_lc_name, "
        f"{txt('(k % 6)')} AS lab_catalog_group_code"
    ),
    "ipt_accident_type": _pair("accident_type_id", "accident_type_name", "acc"),
    "ipt_accident_ae_type": _pair("accident_ae_type_id", "accident_ae_type_name", "ae"),
    "ipt_accident_emtype": _pair("accident_emtype_id", "accident_emtype_name", "em"),
    "lab_items_group": _pair("lab_items_group_code", "lab_items_group_name", "labgrp"),
    "health_med_curriculum": _pair("health_med_curriculum_id", "health_med_curriculum_name", "cur"),
    "health_med_license_type": _pair("health_med_license_type_id", "health_med_license_type_name", "lic"),
}

# -- catalogues that are as long as the supplier table ----------------------

_SUP = "FROM (SELECT s_suppkey AS k FROM {supplier}) AS q"


def _catalogue(columns: str, where: str = "") -> str:
    return f"SELECT {columns} {_SUP}{' WHERE ' + where if where else ''}"


_ICODE = emp("k", 9, 7, service_of("k"))
_ICD9 = emp("k", 8, 6, icd9_of("(k + 2)"))

CATALOGUES: dict[str, str] = {
    "icd101": f"SELECT code, 'diagnosis ' || code AS name FROM (SELECT DISTINCT {icd10_of('p_partkey')} AS code FROM {{part}}) AS q WHERE code <> '' AND code <> 'J12'",
    "icd9cm1": f"SELECT code, 'procedure ' || code AS name FROM (SELECT DISTINCT {icd9_of('p_partkey')} AS code FROM {{part}}) AS q WHERE code <> '' AND code <> '1010'",
    "er_oper_code": _catalogue(
        f"""{txt('k')} AS er_oper_code, {emp('k', 25, 22, "'er ' || CAST(k AS STRING)")} AS name, {_ICODE} AS icode,
        {_ICD9} AS icd9cm, {nul('k', 3, yn('k', 4))} AS export_proced, {yn('k', 10)} AS active_status,
        CASE WHEN k % 7 = 0 THEN {dec(0)} ELSE {dec('(k % 600)')} END AS price, {emp('k', 4, 3, "'TM'")} AS icd10tm"""
    ),
    "er_oper": _catalogue(
        f"{nul('k', 15, txt('k'))} AS er_oper_code, {emp('k', 11, 12, "'er ' || CAST(k AS STRING)")} AS name"
    ),
    "ipt_oper_code": _catalogue(
        f"{txt('k')} AS ipt_oper_code, 'ipd ' || CAST(k AS STRING) AS name, {_ICODE} AS icode, {_ICD9} AS icd9cm, "
        f"{yn('k', 10)} AS active_status, {dec('(k % 5)')} AS price"
    ),
    "operation_item": _catalogue(
        f"""{txt('k')} AS operation_item_id, {emp('k', 14, 13, txt('k'))} AS oper_code,
        {emp('k', 11, 12, "'or ' || CAST(k AS STRING)")} AS name, {_ICODE} AS icode, {_ICD9} AS icd9,
        {yn('k', 10)} AS active_status, {dec('(k % 5)')} AS price"""
    ),
    "physic_items": _catalogue(
        f"""{txt('k')} AS physic_items_id, {emp('k', 21, 19, "'pt ' || CAST(k AS STRING)")} AS name, {dec('(k % 300)')} AS price,
        {_ICODE} AS icode, {_ICD9} AS icd9, {emp('k', 4, 5, "'RH' || CAST(k AS STRING)")} AS f43_rehab_code,
        {nul('k', 6, yn('k', 3))} AS icd9_ipd_active_status, {yn('k', 12)} AS active_status"""
    ),
    "dttm": _catalogue(
        f"""{txt('k')} AS code, {emp('k', 21, 19, "'dt ' || CAST(k AS STRING)")} AS name, {dec('(k % 400)')} AS opd_price1,
        {_ICODE} AS icode, {_ICD9} AS icd9cm, {nul('k', 5, yn('k', 4))} AS export_eclaim_icd10tm,
        {yn('k', 12)} AS active_status, {emp('k', 6, 4, "'ea'")} AS unit"""
    ),
    "health_med_operation_item": _catalogue(
        f"""{txt('k')} AS health_med_operation_item_id, 'tm ' || CAST(k AS STRING) AS health_med_operation_item_name,
        {dec('(k % 250)')} AS price, {_ICODE} AS icode, {nul('k', 6, "'U' || CAST(k % 40 AS STRING)")} AS icd10tm,
        {nul('k', 14, txt('(1 + k % 3)'))} AS health_med_operation_type_id, {yn('k', 12)} AS active_status"""
    ),
    "health_med_operation_code": _catalogue("'U' || CAST(k AS STRING) AS icd10tm, 'M' || CAST(k AS STRING) AS code", "k % 8 <> 7"),
    "health_med_operation_item_organ": _catalogue(
        f"{txt('(k % 60)')} AS health_med_operation_item_id, {txt('(k % 9)')} AS organ_id"
    ),
    "health_med_doctor": _catalogue(
        f"""{txt('k')} AS health_med_doctor_id, 'tmd ' || CAST(k AS STRING) AS health_med_doctor_name,
        {nul('k', 5, "'L' || CAST(k AS STRING)")} AS license_number, {nul('k', 17, txt('k'))} AS doctor_code,
        {txt('(1 + k % 8)')} AS health_med_curriculum_id, {nul('k', 4, txt('(1 + k % 30)'))} AS health_med_license_type_id,
        {yn('k', 10)} AS active_status"""
    ),
    "xray_items": _catalogue(
        f"""{txt('k')} AS xray_items_code, {emp('k', 13, 14, "'xr ' || CAST(k AS STRING)")} AS xray_items_name,
        1 + k % 4 AS exposure_qty, CASE WHEN k % 6 = 0 THEN {dec(0)} ELSE {dec('(k % 700)')} END AS service_price,
        {_ICODE} AS icode, {yn('k', 9)} AS active_status, {emp('k', 4, 5, "'g1'")} AS xray_items_group"""
    ),
    "lab_items": _catalogue(
        f"""{txt('k')} AS lab_items_code, 'lab ' || CAST(k AS STRING) AS lab_items_name, {emp('k', 11, 7, service_of('k'))} AS icode,
        {emp('k', 5, 4, "'TM' || CAST(k AS STRING)")} AS tmlt_code, {nul('k', 11, nul('k', 2, "'Y'"))} AS no_lab_catalog,
        {txt('(1 + k % 9)')} AS lab_items_group, {dec('(k % 350)')} AS service_price, {yn('k', 8)} AS active_status,
        {emp('k', 6, 7, "'mg'")} AS lab_items_unit, {emp('k', 3, 8, "'S'")} AS specimen_code"""
    ),
    "lab_items_sub_group": _catalogue(
        f"""'G' || CAST(k AS STRING) AS lab_items_sub_group_code, 'sub ' || CAST(k AS STRING) AS lab_items_sub_group_name,
        {emp('k', 4, 7, service_of('k'))} AS group_icode, {dec('(k % 350)')} AS group_price,
        {emp('k', 4, 5, "'TM' || CAST(k AS STRING)")} AS tmlt_code, {nul('k', 3, nul('k', 2, "'Y'"))} AS no_lab_catalog,
        {txt('(1 + k % 9)')} AS lab_items_group_code,
        CASE k % 9 WHEN 0 THEN 'N' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Y' END AS active_status"""
    ),
    "lab_catalog_import_detail": _catalogue(
        f"{service_of('k')} AS lab_catalog_lc_code, {emp('k', 6, 5, "'TM' || CAST(k AS STRING)")} AS lab_catalog_tmlt, "
        "'catalog ' || CAST(k AS STRING) AS lab_catalog_name",
        "k % 3 <> 1",
    ),
    "pttype_items_price": _catalogue(
        f"{service_of('k')} AS items_table_code, CASE WHEN k % 2 = 0 THEN '*1' ELSE '*2' END AS pttype, "
        f"CASE WHEN k % 3 = 0 THEN {dec('((2 * k + 1) % 90)')} ELSE {dec('(k % 90)')} END AS price"
    ),
    "sys_lab_link": _catalogue(f"{txt('k')} AS lab_items_code, 's' || CAST(k % 20 AS STRING) AS sys_lab_code_id", "k % 3 <> 0")
    + "\nUNION ALL\n"
    + _catalogue(f"{txt('k')} AS lab_items_code, 't' || CAST(k % 20 AS STRING) AS sys_lab_code_id", "k % 10 = 0"),
    "blb_bloodbank_items": _catalogue(
        f"""k AS blb_bloodbank_items_id, 'blood ' || CAST(k AS STRING) AS blb_bloodbank_items_name, {_ICODE} AS icode,
        'bag' AS blb_bloodbank_items_unit, {emp('k', 4, 5, "'TM' || CAST(k AS STRING)")} AS tmlt_code, {yn('k', 6)} AS active"""
    )
    + "\nUNION ALL\n"
    + _catalogue(
        f"""k AS blb_bloodbank_items_id, 'blood ' || CAST(k AS STRING) AS blb_bloodbank_items_name, {_ICODE} AS icode,
        'bag' AS blb_bloodbank_items_unit, {emp('k', 4, 5, "'TM' || CAST(k AS STRING)")} AS tmlt_code, 'Y' AS active""",
        "k % 8 = 0",
    ),
    "ovst_sks_icd10tm": f"SELECT {emp('p_partkey', 41, 43, "'T' || CAST(p_partkey AS STRING)")} AS code FROM {{part}}",
    "sks_icd10tm_check": "SELECT 'T' || CAST(p_partkey AS STRING) AS code FROM {part} WHERE p_partkey % 3 = 0",
    "officer": f"""
SELECT {txt('c_custkey')} AS officer_id, {emp('c_custkey', 9, 8, "'u' || CAST(c_custkey AS STRING)")} AS officer_login_name,
    c_name AS officer_name, {emp('c_custkey', 5, 6, "'g1,g2'")} AS officer_group_list_text,
    {emp('c_custkey', 4, 7, txt('(c_custkey % 100)'))} AS officer_doctor_code,
    {emp('c_custkey', 17, 19, pad('c_custkey', 13))} AS officer_cid, {yn('c_custkey', 10)} AS officer_active
FROM {{customer}}""",
    "officer_group": "SELECT n_nationkey AS officer_group_id, n_name AS officer_group_name FROM {nation}",
    "officer_group_module_access": _catalogue("k % 25 AS officer_group_id, k AS module_id"),
    "clinic": _catalogue(
        f"""{txt('k')} AS clinic, 'clinic ' || CAST(k AS STRING) AS name, {emp('k', 5, 4, "'1'")} AS clinic_type_id,
        {emp('k', 3, 7, yn('k', 2))} AS chronic, {nul('k', 4, "'N'")} AS no_export, {yn('k', 7)} AS active_status"""
    ),
    "roomno": _catalogue(
        f"{txt('k')} AS roomno, {emp('k', 8, 9, "'room ' || CAST(k AS STRING)")} AS name, {nul('k', 7, '1 + k % 6')} AS roomtype, "
        f"{emp('k', 5, 6, two('(1 + k)'))} AS ward, {yn('k', 6)} AS is_active"
    ),
    "bedno": _catalogue(
        f"{txt('k')} AS bedno, {nul('k', 9, txt('(k % 30)'))} AS roomno, {nul('k', 8, '1 + k % 3')} AS bed_status_type_id, "
        f"{emp('k', 5, 7, "'b1'")} AS bedtype, {emp('k', 4, 7, service_of('k'))} AS room_charge_icode"
    ),
}

# -- tables of changes ---------------------------------------------------------


def _edits(offset: int, where: str) -> str:
    k = f"(k + {offset})"
    return f"""
SELECT {txt('(10 + k * 3 % 130)')} AS pttype,
    CASE {k} % 7 WHEN 0 THEN 'pttype_name' WHEN 1 THEN 'drg_group' WHEN 2 THEN 'print_presc_ned'
        WHEN 3 THEN 'finance_round_money' WHEN 4 THEN 'sks_benefit_plan_type_id' WHEN 5 THEN 'inscl' ELSE 'secret' END AS field,
    CASE {k} % 5 WHEN 0 THEN '  name ' || CAST(k AS STRING) || ' ' WHEN 1 THEN ' yes' WHEN 2 THEN '' WHEN 3 THEN NULL
        ELSE '7 ' END AS value, k * 2 + {offset} % 2 AS _pos
{_SUP} WHERE {where}"""


def _new_rows(offset: int, where: str) -> str:
    return f"""
SELECT {item('p_partkey')} AS icode, {emp('p_partkey', 36, 60, f"'v{offset} ' || p_name")} AS name,
    {emp('p_partkey', 48, 72, "'9 mg'")} AS strength, p_type AS units, p_partkey * 2 + {offset} AS _pos
FROM {{part}} WHERE {where}"""


def _hospital_updates(offset: int, where: str) -> str:
    return f"""
SELECT {txt('o_orderkey')} AS vn, {PAYER} AS pttype,
    {emp('o_orderkey', 5, 7, pad(f'((o_orderkey + {offset}) % 99999)', 5))} AS hospmain,
    {emp('o_orderkey', 4, 9, pad(f'((o_orderkey + {offset}) % 88888)', 5))} AS hospsub, o_orderkey * 2 + {offset} AS _pos
FROM {{orders}} WHERE {where}"""


def _field_edits(key: str, name: str, fields: tuple[str, ...], values: tuple[str, ...]) -> str:
    """One edit per key: fields and values in turn."""
    field = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(fields))
    value = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"""
SELECT {key} AS {name}, CASE k % {len(fields)} {field} END AS field, CASE k % {len(values)} {value} END AS value, k AS _pos
{_SUP}"""


_WORDS = ("' x '", "''", "NULL", "'v' || CAST(k AS STRING)")
_NUMBERS = ("'x1'", "'7'", "NULL", "'12'", "CAST(k % 90 AS STRING)", "''", "'3'")
CHANGES: dict[str, str] = {
    "doctor_edits": _field_edits(txt("k"), "code", ("licenseno", "d_name", "pname", "cid", "nothere"), _WORDS),
    "income_edits": _field_edits(two("k"), "income", ("income_name", "group2", "std_group", "nothere", "drg_group"), _WORDS),
    "xray_edits": _field_edits(txt("k"), "xray_items_code", ("xray_name", "exposure_qty", "price"), _NUMBERS),
    "service_edits": _field_edits(service_of("k"), "icode", ("name", "unit", "billcode", "price", "income"), _NUMBERS),
    "morphine_rows": f"""
SELECT p_partkey AS drug_morphine_id, {item('p_partkey + 1')} AS icode, {emp('p_partkey', 3, 4, "'new ' || p_name")} AS name,
    {emp('p_partkey', 4, 5, "'5 mg'")} AS strength, p_type AS units, p_partkey AS _pos
FROM {{part}} WHERE p_partkey % 4 = 0""",
    "profile_switches": f"""
SELECT {service_of('k')} AS group_icode, CASE k % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE NULL END AS no_lab_catalog, k AS _pos
{_SUP} WHERE k % 4 <> 1""",
    "scheme_edits": _edits(0, "TRUE") + "\nUNION ALL" + _edits(7, "k % 4 = 0") + "\nUNION ALL" + _edits(1, "k % 3 = 0"),
    "hospital_updates": _hospital_updates(0, "o_orderkey % 3 = 0") + "\nUNION ALL" + _hospital_updates(1, "o_orderkey % 6 = 0"),
    "cancer_drug_rows": _new_rows(0, "p_partkey % 12 = 0") + "\nUNION ALL" + _new_rows(1, "p_partkey % 24 = 0"),
    "new_diagnoses": f"""
SELECT {txt('l_orderkey')} AS vn, CASE WHEN part_key % 9 = 0 THEN '' WHEN part_key % 2 = 0 THEN 'Z510' ELSE 'Z511' END AS icd10_add,
    {txt('o_custkey')} AS hn, {clock('o_orderkey')} AS vsttime, {VISIT_DAY} AS vstdate,
    {emp('part_key', 3, 4, "'2'")} AS diagtype, {txt('supp_key')} AS doctor_code, l_orderkey * 8 + line_no AS _pos
FROM (SELECT l_orderkey, l_linenumber AS line_no, MIN(l_partkey) AS part_key, MIN(l_suppkey) AS supp_key
      FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) AS q JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "approval_updates": f"""
SELECT o_orderkey * 2 AS debt_id, {AN} AS an, {emp('o_orderkey', 5, 6, "' N' || CAST(o_orderkey AS STRING) || ' '")} AS sss_approval_code,
    {emp('o_orderkey', 4, 7, "' N' || CAST(o_orderkey AS STRING) || ' '")} AS auth_code, o_orderkey AS _pos
FROM {{orders}} WHERE o_orderkey % 3 = 1""",
    "lab_switches": f"""
SELECT {service_of('k')} AS icode, CASE k % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE NULL END AS no_lab_catalog, k AS _pos
{_SUP} WHERE k % 4 <> 1""",
    "drug_edits": f"""
SELECT {item('p_partkey')} AS icode,
    CASE p_partkey % 5 WHEN 0 THEN 'sks_price' WHEN 1 THEN 'sks_drug_code' WHEN 2 THEN 'sks_product_category_id'
        WHEN 3 THEN 'sks_clain_control_type_id' ELSE 'name' END AS field,
    CASE p_partkey % 7 WHEN 0 THEN ' 12.50 ' WHEN 1 THEN 'x1' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE CAST(p_partkey % 90 AS STRING) END AS value,
    p_partkey AS _pos
FROM {{part}} WHERE p_partkey % 3 <> 1""",
    "old_transfers": f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-'
        || CAST(l_suppkey AS STRING) AS hos_guid, {txt('l_orderkey')} AS vn, l_orderkey AS opd_opi_fn_tr_list_id
FROM {{lineitem}} WHERE l_partkey % 17 = 0 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
}

SMALL_KEYS = "(SELECT CAST(n_nationkey AS BIGINT) AS k FROM {nation}) AS q"
LONG_KEYS = "(SELECT s_suppkey AS k FROM {supplier}) AS q"


def definitions(long_lists: bool = False) -> dict[str, str]:
    """Hospital table -> SQL text with ``{driver or hospital table}`` left open."""
    keys = LONG_KEYS if long_lists else SMALL_KEYS
    lists = {n: text.replace("{keys}", keys) for n, text in LISTS.items()}
    return {**FACTS, **CATALOGUES, **CHANGES, **lists}


_OPEN = re.compile(r"\{(\w+)\}")

# Spark brings rows of two tables together by the key of their join.  Met by the text that names the
# visit, charge lines lie where joins and groupings by visit look for them, and do not move again;
# more sorts then run in one task, so only queries that shuffle much ask for it.
_BY_VISIT = {"opitemrece": ("ON o_orderkey = l_orderkey", f"ON {txt('o_orderkey')} = {txt('l_orderkey')}")}


def bind(spark: SparkSession, sf_dir: str, long_lists: bool = False, by_visit: bool = False) -> Tables:
    """The hospital schema over the driver parquet files in ``sf_dir``; ``by_visit``: charge lines lie by visit."""
    views: dict[str, str] = {}

    def driver_view(name: str) -> str:
        if name not in views:
            view = "driver_" + name + re.sub(r"\W", "_", sf_dir)
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
            views[name] = view
        return views[name]

    def maker(text: str):
        return lambda: spark.sql(_OPEN.sub(lambda m: driver_view(m.group(1)), text))

    texts = definitions(long_lists)
    for n, (key, visit) in _BY_VISIT.items() if by_visit else ():
        texts[n] = texts[n].replace(key, visit)
    makers = {n: maker(text) for n, text in texts.items()}
    makers.update({n: (lambda n=n: spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in DRIVER_TABLES})
    return Tables(spark, makers)


def with_clause(query: str, long_lists: bool = False) -> str:
    """``query`` preceded by the hospital tables it names, for another SQL engine."""
    defs = definitions(long_lists)
    named = set(re.findall(r"\b\w+\b", query))
    wanted = [n for n in defs if n in named]
    ctes = ",\n".join(f"{n} AS ({_OPEN.sub(lambda m: m.group(1), defs[n]).strip()})" for n in wanted)
    head = query.lstrip()
    if not ctes:
        return head
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{head}"


def columns(spark: SparkSession, sf_dir: str, table: str) -> list[str]:
    return bind(spark, sf_dir)[table].columns
