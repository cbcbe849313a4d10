"""Presence rules, check columns and small column builders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def yn(condition: Column) -> Column:
    """'Y' where the condition holds, 'N' where it does not or is unknown."""
    return F.when(condition, F.lit("Y")).otherwise(F.lit("N"))


def known(x: Column | str) -> Column:
    """Not NULL; an empty text counts as given."""
    return col(x).isNotNull()


def filled(x: Column | str) -> Column:
    """Neither NULL nor empty."""
    return col(x).isNotNull() & (col(x) != "")


def nonempty(x: Column | str) -> Column:
    """Differs from the empty text; unknown for NULL, so a flag built on it says 'N'."""
    return col(x) != ""


def filled_except(x: Column | str, *sentinels: str) -> Column:
    """Filled, and not one of the values that stand for "nothing" in this column."""
    return filled(x) & ~col(x).isin(*sentinels)


def is_missing(x: Column | str, sentinels: Iterable[str] = ()) -> Column:
    """NULL, empty, or a sentinel, comparing the value's text."""
    text = col(x).cast("string")
    return text.isNull() | text.isin("", *sentinels)


PRESENCE = {"known": known, "filled": filled, "nonempty": nonempty, "filled_except": filled_except}


def flag_present(x: Column | str, rule: str = "filled", *sentinels: str) -> Column:
    """A 'Y'/'N' column under one of the four presence rules."""
    if sentinels and rule != "filled_except":
        raise ValueError("sentinels go with the rule 'filled_except'")
    return yn(PRESENCE[rule](x, *sentinels))


def checks(prefix: str = "check_", suffix: str = "", **conditions: Column) -> list[Column]:
    """One 'Y'/'N' column per named condition."""
    return [yn(c).alias(f"{prefix}{name}{suffix}") for name, c in conditions.items()]


def picks(names: str) -> list[Column]:
    """Columns from a comma list such as ``"ov.vn, vp.auth_code AS authcode"``."""
    return [F.expr(part.strip()) for part in names.split(",")]


def constants(**values: str | None) -> list[Column]:
    """Fixed text columns; None becomes a text NULL so that unions keep their types."""
    return [F.lit(v).cast("string").alias(n) for n, v in values.items()]


def join_text(*parts: Column) -> Column:
    """Concatenation that skips NULL parts."""
    return F.concat_ws("", *parts)


def person_name(alias: str, title: bool = True, between: str = " ") -> Column:
    """Title, first name, ``between``, last name; missing parts are skipped."""
    parts = [F.col(f"{alias}.fname"), F.lit(between), F.col(f"{alias}.lname")]
    return join_text(*([F.col(f"{alias}.pname")] if title else []), *parts)


def day_case_prefix(admit_type: Column | str, an: Column | str) -> Column:
    """Admission number, marked ODS for a day case (admission type 5)."""
    return F.when(col(admit_type) == "5", join_text(F.lit("ODS"), col(an))).otherwise(col(an))


def money(x: Column | str) -> Column:
    return col(x).cast("decimal(18,2)")


def product(a: Column | str, b: Column | str) -> Column:
    return (col(a) * col(b)).cast("decimal(18,4)")
