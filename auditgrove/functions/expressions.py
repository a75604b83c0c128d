"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")


def severity_rank(severity: Column) -> Column:
    """CRITICAL 0, HIGH 1, MEDIUM 2, anything else (null too) 3."""
    out = F.lit(len(SEVERITIES))
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def pick(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """The named columns in order, missing ones as null."""
    kinds = kinds or {}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns])


def canonical_json(text: Column) -> Column:
    """JSON text that does not depend on the order of keys; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def ordered(columns: list[str], by: str, sep: str = ", ") -> Column:
    """Aggregate: the values of a column joined in the order of another."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, *columns))), lambda s: s[columns[0]]), sep)
