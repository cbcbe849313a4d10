"""Completeness of master data: how many rows fill a column they should fill.

All rules of a table are answered by one aggregation over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.flags import is_missing
from claimlens.operators.rules import CONTROLLED_DRUGS, controlled_name, with_membership
from claimlens.params import Params
from claimlens.plans.audit_rules import (
    BASIC_RULES,
    CODE_COLUMNS,
    COLUMN_ALIASES,
    COPAY_CATEGORY,
    COPAY_COLUMNS,
    COST_CATEGORIES,
    DRUG_CATEGORIES,
    DRUG_COLUMNS,
    FULL_RULES,
    ITEM_COLUMNS,
    LINKED_CATEGORIES,
    LINKED_COLUMNS,
    LOOKUP_TERM,
    MEMBER_TERM,
    SKIPPED_CATEGORIES,
    STATUS_COLUMNS,
    SURPLUS,
    THAI_MEDICINE_CATEGORY,
    Rule,
    column_spec,
    parse_rules,
)
from claimlens.sources.tables import Tables

OK, SKIP, ERROR = "ok", "skip", "error"
RESULT = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("tot", T.LongType()),
        T.StructField("ok", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("info", T.StringType()),
    ]
)


def resolve_column(
    columns: Iterable[str], name: str, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES
) -> str | None:
    """The column that goes by ``name`` or, failing that, by one of its aliases."""
    present = {c.lower(): c for c in columns}
    for candidate in (name, *aliases.get(name, ())):
        if candidate.startswith("*"):
            found = next((c for c in sorted(present) if c.endswith(candidate[1:])), None)
            if found:
                return present[found]
        elif candidate.lower() in present:
            return present[candidate.lower()]
    return None


# -- tallies -------------------------------------------------------------------


class Tally:
    """Totals and filled counts of many rules over one DataFrame in one aggregate.

    Conditions are SQL text: a rule set has hundreds of them, and one parsed
    expression each is far cheaper to build than a tree of column objects.
    """

    def __init__(self, rows: DataFrame, by: Sequence[str] = (), groups: DataFrame | None = None):
        """``groups`` lists the values of ``by`` to report; those without rows get zeros."""
        self.rows, self.by, self.groups = rows, list(by), groups
        self.parts: list[tuple[tuple[str, ...], str, str]] = []

    def add(self, labels: tuple[str, ...], condition: str, filled: str) -> None:
        self.parts.append((labels, condition, filled))

    def long(self, names: Sequence[str]) -> DataFrame:
        """One row per rule (and group): the labels under ``names``, ``tot`` and ``ok``."""
        sums, lines = [], []
        for i, (labels, condition, filled) in enumerate(self.parts):
            sums.append(F.expr(f"count(CASE WHEN {condition} THEN 1 END) AS tot{i}"))
            sums.append(F.expr(f"count(CASE WHEN ({condition}) AND ({filled}) THEN 1 END) AS ok{i}"))
            shown = ", ".join(f"'{v}' AS {n}" for n, v in zip(names, labels))
            lines.append(f"struct({shown}, tot{i} AS tot, ok{i} AS ok)")
        wide = self.rows.groupBy(*self.by).agg(*sums)
        if self.groups is not None:
            wide = self.groups.join(wide, self.by, "left").na.fill(0)
        return wide.selectExpr(*self.by, f"inline(array({', '.join(lines)}))")


def missing_sql(column: str, sentinels: Sequence[str] = ()) -> str:
    """The SQL text of ``is_missing``."""
    values = ", ".join(f"'{v}'" for v in ("", *sentinels))
    return f"(`{column}` IS NULL OR CAST(`{column}` AS STRING) IN ({values}))"


def filled_sql(column: str, sentinels: Sequence[str] = ()) -> str:
    return f"NOT {missing_sql(column, sentinels)}"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _fixed_rows(t: Tables, rows: list[tuple]) -> DataFrame:
    return t.spark.createDataFrame(rows, RESULT)


def _condition(t: Tables, rows: DataFrame, terms: Sequence[str], aliases, strict: bool):
    """The rows with any membership columns added, the condition, and a status."""
    parts = []
    for term in terms:
        if LOOKUP_TERM.match(term):
            name, value = term.split("=")
            found = resolve_column(rows.columns, name, aliases)
            if found is None:
                if strict:
                    return rows, "", SKIP
                continue  # no such column: the rule covers all rows
            parts.append(f"`{found}` = '{value}'")
        elif member := MEMBER_TERM.match(term):
            column, table = member["column"], member["table"]
            if column not in rows.columns or table not in t:
                return rows, "", ERROR
            flag = f"_in_{len(rows.columns)}"
            rows = with_membership(rows, column, t[table].where(member["where"]), member["key"], flag)
            parts.append(f"NOT {flag}" if member["word"] == "NOT IN" else flag)
        else:
            if term.replace("=", " ").split()[0] not in rows.columns:
                return rows, "", ERROR
            parts.append(f"({term})")
    return rows, " AND ".join(parts) or "TRUE", OK


def audit_columns(
    t: Tables,
    rules: Sequence[Rule],
    aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES,
    strict: bool = False,
) -> DataFrame:
    """Per rule: rows it covers and rows that fill the column.

    A missing table or column is reported as skipped.  An unresolved condition
    column means "all rows", or skips the rule when ``strict``.
    """
    frames: list[DataFrame] = []
    unanswered: list[tuple] = []
    names = ["section", "rule", "table_name", "column_name", "status", "info"]
    by_table = sorted(rules, key=lambda r: r.table)
    for table, table_rules in groupby(by_table, key=lambda r: r.table):
        answered = []
        rows = t[table] if table in t else None
        conditions: dict[tuple[str, ...], tuple[str, str]] = {}
        for rule in table_rules:
            info = "Y" if rule.info else "N"
            column = None if rows is None else resolve_column(t[table].columns, rule.column, aliases)
            if column is None:
                unanswered.append((rule.section, rule.name, table, rule.column, 0, 0, SKIP, info))
                continue
            if rule.terms not in conditions:
                rows, condition, status = _condition(t, rows, rule.terms, aliases, strict)
                conditions[rule.terms] = (condition, status)
            condition, status = conditions[rule.terms]
            if status != OK:
                unanswered.append((rule.section, rule.name, table, column, 0, 0, status, info))
                continue
            labels = (rule.section, rule.name, table, column, OK, info)
            answered.append((labels, condition, filled_sql(column, rule.sentinels)))
        if answered:
            tally = Tally(rows)
            for part in answered:
                tally.add(*part)
            frames.append(tally.long(names))
    if unanswered:
        frames.append(_fixed_rows(t, unanswered))
    return _union(frames).select(*RESULT.names)


def basic_audit(t: Tables, p: Params | None = None) -> DataFrame:
    """The short rule set; columns go by their own names only, apart from a vendor's prefix."""
    own = {"clinic_type_id": COLUMN_ALIASES["clinic_type_id"]}
    return audit_columns(t, parse_rules(BASIC_RULES), aliases=own, strict=True)


def full_audit(t: Tables, p: Params | None = None) -> DataFrame:
    """The full rule set including the generated charge categories."""
    return audit_columns(t, parse_rules(FULL_RULES)).unionByName(bill_sections(t, p))


# -- rows that appear in a second table ----------------------------------------


def _link_flags(other: DataFrame, key: str, specs: Sequence[str]) -> DataFrame:
    """Per key of the second table: which of its columns are filled in some row."""
    flags = []
    for i, spec in enumerate(specs):
        column, sentinels, _ = column_spec(spec)
        flags.append(F.max(~is_missing(column, sentinels)).alias(f"_filled{i}"))
    keyed = other.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    return keyed.agg(F.lit(True).alias("_present"), *flags)


def _linked(main: DataFrame, other: DataFrame, key: str, specs: Sequence[str]) -> DataFrame:
    flags = _link_flags(other, key, specs)
    return main.join(flags, F.col(key) == F.col("_key"), "left")


def audit_linked(
    t: Tables, main: str, other: str, key: str, columns: Sequence[str] = (), where: str | None = None, section: str = "linked"
) -> DataFrame:
    """Rows of ``main`` whose key is in ``other``, and those for which a column there is filled."""
    rows = t[main].where(where) if where else t[main]
    tally = Tally(_linked(rows, t[other], key, columns))
    tally.add((section, other, main, key), "TRUE", "_present")
    for i, spec in enumerate(columns):
        tally.add((section, f"{other}.{column_spec(spec)[0]}", main, key), "TRUE", f"_filled{i}")
    rows = tally.long(["section", "rule", "table_name", "column_name"])
    return rows.withColumns({"status": F.lit(OK), "info": F.lit("N")}).select(*RESULT.names)


# -- charge categories ---------------------------------------------------------


def _categories(t: Tables, only: Sequence[str] | None = None) -> DataFrame:
    """Charge categories to audit, one row per way their code may be stored."""
    if "income" in t:
        listed = t["income"].select(F.trim(F.col("income").cast("string")).alias("code"), F.trim("name").alias("name"))
    else:
        distinct = t["nondrugitems"].where("income IS NOT NULL").select(F.col("income").cast("string").alias("code"))
        listed = distinct.distinct().withColumn("name", F.col("code"))
    kept = listed.where(
        (F.col("code") != "")
        & ~F.col("code").isin(*SKIPPED_CATEGORIES)
        & ~F.coalesce(F.col("name"), F.col("code")).contains(SURPLUS)
    )
    one_digit = F.col("code").rlike("^[0-9]$")
    kept = kept.select(F.when(one_digit, F.lpad("code", 2, "0")).otherwise(F.col("code")).alias("code"))
    number = F.coalesce(F.expr("try_cast(code AS BIGINT)"), F.lit(0)).cast("string")
    ways = F.array_distinct(F.array(F.col("code"), number))
    rows = kept.select("code", F.explode(ways).alias("stored")).distinct()
    return rows.where(F.col("code").isin(*only)) if only is not None else rows


def _codes(t: Tables, only: Sequence[str] | None = None) -> DataFrame:
    return _categories(t, only).select("code").distinct()


def _per_category(t: Tables, items: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Items with the code of their category.

    An inner join: the short category list can be broadcast, and a category
    with very many items is split and pre-aggregated where its items are.
    """
    categories = _categories(t, only)
    items = items.drop("code", "stored").withColumn("_income", F.col("income").cast("string"))
    return items.join(categories, F.col("stored") == F.col("_income")).drop("stored", "_income")


def bill_sections(t: Tables, p: Params | None = None) -> DataFrame:
    """Item, linked and drug rules for every charge category, one pass per table.

    Categories are read and matched as data; nothing is collected.  Rules that
    a category does not have are dropped after the aggregate.
    """
    names = ["rule", "table_name", "column_name"]
    section = F.concat(F.lit("bill"), F.col("code"))

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select(
            section.alias("section"), *names, "tot", "ok", F.lit(OK).alias("status"), F.lit("N").alias("info")
        )

    def active(table: str) -> DataFrame:
        status = resolve_column(t[table].columns, "istatus")
        return t[table].where(F.col(status) == "Y") if status else t[table]

    def split(table: str, specs: str) -> tuple[list[tuple[str, str, tuple[str, ...]]], list[str]]:
        found, absent = [], []
        for spec in specs.split():
            column, sentinels, _ = column_spec(spec)
            actual = resolve_column(t[table].columns, column)
            if actual is None:
                absent.append(column)
            else:
                found.append((column, actual, sentinels))
        return found, absent

    def skipped(table: str, columns: list[str], only: Sequence[str] | None) -> DataFrame:
        lines = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("rule"), F.lit(c).alias("column_name")) for c in columns])
        zero = F.lit(0).cast("bigint")
        rows = _codes(t, only).select("code", F.inline(lines))
        return rows.select(
            section.alias("section"), "rule", F.lit(table).alias("table_name"), "column_name", zero.alias("tot"),
            zero.alias("ok"), F.lit(SKIP).alias("status"), F.lit("N").alias("info"),
        )

    has_rule = (
        ((F.col("code") != COPAY_CATEGORY) | F.element_at(F.split("rule", "\\."), 2).isin(*COPAY_COLUMNS))
        & ((F.col("rule") != "nondrugitems.unitcost") | F.col("code").isin(*COST_CATEGORIES))
    )

    services = active("nondrugitems").where(~F.col("name").ilike(f"%{SURPLUS}%"))
    items = Tally(_per_category(t, services), ["code"], _codes(t))
    found, absent = split("nondrugitems", ITEM_COLUMNS)
    for column, actual, sentinels in found:
        items.add((f"nondrugitems.{column}", "nondrugitems", actual), "TRUE", filled_sql(actual, sentinels))
    frames = [finish(items.long(names).where(has_rule))]
    if absent:
        code = F.regexp_replace("section", "^bill", "")
        rows = skipped("nondrugitems", absent, None).withColumn("code", code).where(has_rule).drop("code")
        frames.append(rows)

    if "nondrugitems_sks_bc" in t:
        specs = LINKED_COLUMNS.split()
        flags = _link_flags(t["nondrugitems_sks_bc"], "icode", specs)
        linked = _per_category(t, services, LINKED_CATEGORIES).join(flags, F.col("icode") == F.col("_key"), "left")
        links = Tally(linked, ["code"], _codes(t, LINKED_CATEGORIES))
        links.add(("nondrugitems_sks_bc", "nondrugitems", "icode"), "TRUE", "_present")
        for i, spec in enumerate(specs):
            label = f"nondrugitems_sks_bc.{column_spec(spec)[0]}"
            links.add((label, "nondrugitems", "icode"), "TRUE", f"_filled{i}")
        frames.append(finish(links.long(names)))

    if "drugitems" in t:
        thai = t["sks_product_category"].where(F.col("name").ilike(f"%{THAI_MEDICINE_CATEGORY}%"))
        drugs = with_membership(
            _per_category(t, active("drugitems"), DRUG_CATEGORIES),
            "sks_product_category_id", thai, "sks_product_category_id", "_thai",
        )
        tally = Tally(drugs, ["code"], _codes(t, DRUG_CATEGORIES))
        found, absent = split("drugitems", DRUG_COLUMNS)
        for column, actual, sentinels in found:
            covered = "_thai" if column == "ttmt_code" else "TRUE"
            tally.add((f"drugitems.{column}", "drugitems", actual), covered, filled_sql(actual, sentinels))
        for label, words in CONTROLLED_DRUGS.items():
            tally.add((label, "drugitems", "drug_control_type_id"), controlled_name(words), filled_sql("drug_control_type_id"))
        frames.append(finish(tally.long(names)))
        if absent:
            frames.append(skipped("drugitems", absent, DRUG_CATEGORIES))
    return _union(frames)


# -- drill-down and counts -----------------------------------------------------


def audit_missing_rows(t: Tables, rule: Rule) -> DataFrame:
    """Rows that miss the column, those in use first, then by the table's code.

    Sentinels count as missing here too.  The remaining columns make the order
    total, so the rows shown are always the same.
    """
    source = t[rule.table]
    column = resolve_column(source.columns, rule.column)
    if column is None:
        raise ValueError(f"{rule.table} has no column {rule.column}")
    rows, condition, status = _condition(t, source, rule.terms, COLUMN_ALIASES, strict=False)
    if status != OK:
        raise ValueError(f"{rule.table}: a column of the condition is missing")
    rows = rows.where(missing_sql(column, rule.sentinels)).where(condition).select(*source.columns)
    order = []
    in_use = next((c for c in STATUS_COLUMNS if c in rows.columns), None)
    if in_use:
        order.append(F.when(F.col(in_use) == "Y", 0).otherwise(1))
    code = next((c for c in CODE_COLUMNS.get(rule.table, ("code", "id")) if c in rows.columns), None)
    code = code or next((c for c in rows.columns if c.endswith("_code") or c == "code"), None)
    if code:
        order.append(F.col(code).asc_nulls_last())
    order += [F.col(c).asc_nulls_last() for c in rows.columns if c != code]
    return rows.orderBy(*order)


def audit_missing_linked_rows(
    t: Tables, main: str, other: str, key: str, columns: Sequence[str] = (), where: str | None = None
) -> DataFrame:
    """The rows of ``main`` that fail a linked rule, once for each rule they fail, under ``missing``.

    The rules are those of ``audit_linked``: the key occurs in ``other``, and it occurs there
    in a row with the column filled.  As in a NOT IN, a row without a key fails only a rule
    that no row of ``other`` meets, and if a row that meets the rule has no key, nothing is
    known to fail it.  All rules share one pass over each table.
    """
    names = [other, *(f"{other}.{column_spec(spec)[0]}" for spec in columns)]
    filled = [F.lit(True), *(~is_missing(column, sentinels) for column, sentinels, _ in map(column_spec, columns))]
    marks = [F.coalesce(met, F.lit(False)).alias(f"_met{i}") for i, met in enumerate(filled)]
    keyed = t[other].select(F.col(key).alias("_key"), *marks).groupBy("_key")
    keyed = keyed.agg(*(F.max(f"_met{i}").alias(f"_met{i}") for i in range(len(names))))
    # the same grouping serves the join and the two facts a rule needs of the whole list
    facts = keyed.agg(
        F.struct(
            *(F.max(f"_met{i}").alias(f"any{i}") for i in range(len(names))),
            *(F.max(F.col("_key").isNull() & F.col(f"_met{i}")).alias(f"null{i}") for i in range(len(names))),
        ).alias("facts")
    ).scalar()
    source = t[main]
    rows = (source.where(where) if where else source).withColumn("_facts", facts)
    rows = rows.join(keyed.where("_key IS NOT NULL"), F.col(key) == F.col("_key"), "left")

    def fails(i: int) -> Column:
        any_met, null_met = (F.coalesce(F.col(f"_facts.{kind}{i}"), F.lit(False)) for kind in ("any", "null"))
        met = F.coalesce(F.col(f"_met{i}"), F.lit(False))
        return F.when(~any_met, True).otherwise(~null_met & F.col(key).isNotNull() & ~met)

    failed = F.filter(F.array(*(F.when(fails(i), F.lit(name)) for i, name in enumerate(names))), lambda x: x.isNotNull())
    return rows.select(F.explode(failed).alias("missing"), *source.columns)


def table_counts(t: Tables, names: Sequence[str]) -> DataFrame:
    """Row count per table, -1 where the table is absent."""
    frames = []
    for name in names:
        if name in t:
            frames.append(t[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("cnt")))
    absent = [(name, -1) for name in names if name not in t]
    if absent:
        frames.append(t.spark.createDataFrame(absent, "table_name string, cnt bigint"))
    return _union(frames)


# Tables and columns the checks cannot do without.
REQUIRED = (
    "position_check",
    "lab_items.no_lab_catalog",
    "lab_items_sub_group.no_lab_catalog",
    "sks_icd10tm_check",
    "drugitems_cancer",
    "drug_morphine",
)


def table_contract(t: Tables, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Per required table or ``table.column``: whether it exists, and its row count."""
    counts = table_counts(t, sorted({r.split(".")[0] for r in required}))
    rows = []
    for r in required:
        table, _, column = r.partition(".")
        exists = table in t and (not column or column in t[table].columns)
        rows.append((r, table, "Y" if exists else "N"))
    wanted = t.spark.createDataFrame(rows, "required string, table_name string, present string")
    return wanted.join(counts, "table_name", "left").select("required", "present", F.col("cnt").alias("n_rows"))


# -- scores --------------------------------------------------------------------


def _percent(share: Column) -> Column:
    return F.round(F.round(share, 9) * 100).cast("bigint")


def section_sums(results: DataFrame) -> DataFrame:
    """What all scores are made of, per section and in one pass over the results.

    A rule counts towards the shares if it was answered, is scored and covers
    at least one row; towards the record sums if it was answered.
    """
    answered = F.col("status") == OK
    scored = answered & (F.col("info") == "N") & (F.col("tot") > 0)
    share = F.when(scored, F.try_divide("ok", "tot"))

    def total(x: Column) -> Column:
        return F.sum(F.when(answered, x).otherwise(0)).cast("bigint")

    return results.groupBy("section").agg(
        F.coalesce(_percent(F.avg(share)), F.lit(0).cast("bigint")).alias("pct"),
        F.sum(share).alias("share_sum"),
        F.count(share).alias("n_scored"),
        F.count(F.when(share >= 1, 1)).alias("n_full"),
        F.count(F.when(share < 1, 1)).alias("n_short"),
        total(F.col("tot")).alias("tot"),
        total(F.col("ok")).alias("ok"),
        total(F.greatest(F.col("tot") - F.col("ok"), F.lit(0))).alias("missing"),
    )


def section_score(results: DataFrame) -> DataFrame:
    """Per section: mean share over its scored rules in percent, full and short columns.

    A section without a scored rule gets 0.
    """
    return section_sums(results).select("section", "pct", "n_full", "n_short")


def _record_percent() -> Column:
    return F.when(F.col("tot") > 0, _percent(F.try_divide("ok", "tot")))


def section_score_weighted(results: DataFrame) -> DataFrame:
    """Per section: filled rows over covered rows in percent, and the missing ones.

    The percentage is unknown where no rule covers any row.
    """
    return section_sums(results).select("section", _record_percent().alias("pct"), "tot", "ok", "missing")


def overall_score(results: DataFrame) -> DataFrame:
    """Mean share over all scored rules in percent; sections at 100 and the rest."""
    complete = F.col("pct") == 100
    mean = F.try_divide(F.sum("share_sum"), F.sum("n_scored"))
    return section_sums(results).agg(
        F.count(F.when(complete, 1)).alias("complete"),
        F.count(F.when(~complete, 1)).alias("incomplete"),
        F.coalesce(_percent(mean), F.lit(0).cast("bigint")).alias("overall_pct"),
    )


def score_band(pct: Column, style: str = "rules") -> Column:
    """Colour band of a percentage: by rules (90/60) or by records (100/90/70)."""
    if style == "rules":
        return F.when(pct >= 90, "green").when(pct >= 60, "amber").otherwise("red")
    if style == "records":
        return (
            F.when(pct.isNull(), "skip-all")
            .when(pct >= 100, "perfect")
            .when(pct >= 90, "good")
            .when(pct >= 70, "warning")
            .otherwise("danger")
        )
    raise ValueError(f"unknown style: {style}")


def score_bands(results: DataFrame) -> DataFrame:
    """Both scores of each section with their bands."""
    scores = section_sums(results).select(
        "section", F.col("pct").alias("rule_pct"), _record_percent().alias("record_pct")
    )
    return scores.withColumns(
        {
            "rule_band": score_band(F.col("rule_pct")),
            "record_band": score_band(F.col("record_pct"), "records"),
        }
    )
