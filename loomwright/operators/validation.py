"""Validation rules as column expressions: each gives a message or null; a row is valid if no rule of level error fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_confidence(least: float = 0.3) -> Column:
    return F.when(F.col("confidence") < least, F.format_string("confidence below %.2f", F.lit(least)))


def missing(column: str) -> Column:
    return F.when(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""), F.lit(f"{column} is missing"))


def empty(column: str) -> Column:
    return F.when(F.coalesce(F.size(column), F.lit(0)) <= 0, F.lit(f"{column} is empty"))


def alias_is_name() -> Column:
    return F.when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)) == F.lower(F.trim("name"))), F.lit("an alias equals the name"))


def name_length(lo: int = 2, hi: int = 8) -> Column:
    return F.when(~F.coalesce(F.length(F.trim("name")), F.lit(0)).between(lo, hi), F.lit("the name's length is out of range"))


def odd_name(bad: str = "的了着过") -> Column:
    return F.when(F.col("name").rlike(f"[{bad}]|[0-9]"), F.lit("the name has a doubtful character"))


CHARACTER_ERRORS = (lambda: low_confidence(0.3), lambda: missing("description"), lambda: empty("chapter_appearances"))
CHARACTER_WARNINGS = (alias_is_name,)
ENTITY_ERRORS = (lambda: low_confidence(0.4), name_length)
ENTITY_WARNINGS = (odd_name,)


def validate(rows: DataFrame, errors=CHARACTER_ERRORS, warnings=CHARACTER_WARNINGS) -> DataFrame:
    """Adds ``errors, warnings`` (joined messages, empty if none) and ``valid``."""
    told = lambda rules: F.array_join(F.array_compact(F.array(*[r() for r in rules])), "; ")
    return rows.withColumns({"errors": told(errors), "warnings": told(warnings)}).withColumn("valid", F.col("errors") == "")


def split(rows: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    checked = validate(rows, **rules)
    return checked.filter("valid"), checked.filter("not valid")


def all_empty(*tables: DataFrame) -> bool:
    """The guard against an empty run: true if no table has a row."""
    return all(t.isEmpty() for t in tables)
