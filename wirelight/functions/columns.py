"""Small helpers shared by the column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(conditions: list[Column]) -> Column:
    """OR of the conditions, balanced so that long lists stay shallow."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [p[0] | p[1] if len(p) == 2 else p[0] for p in pairs]
    return conditions[0]


def all_of(conditions: list[Column]) -> Column:
    if not conditions:
        return F.lit(True)
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def derive_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that later filters may test any number of times.

    A plain ``withColumn`` is inlined into every predicate that Catalyst pushes
    below it, so an address parse would run once per CIDR test.  A one-row
    ``inline`` keeps code generation and evaluates each expression once.
    Existing columns of the same name are replaced.
    """
    kept = [name for name in df.columns if name not in columns]
    record = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    # the projection shares common sub-expressions, the generator is the barrier
    return df.select(*kept, record.alias("_once")).select(*kept, F.inline(F.array("_once")))


def derive(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """The same columns as a plain projection, a copy of each row less.

    For steps that no filter is pushed below, such as those that feed a generator.
    """
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, *[expr.alias(name) for name, expr in columns.items()])


def settle(df: DataFrame) -> DataFrame:
    """Work out all columns here, once, whatever is filtered or derived later."""
    return derive_once(df, {name: F.col(name) for name in df.columns})
