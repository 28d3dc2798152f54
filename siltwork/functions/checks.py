"""Assertions that hold a query's input to its bounds: they fail the query, never drop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class BoundExceeded(ValueError):
    """The input has more rows or bytes than the operator allows."""


class InvalidRows(ValueError):
    """Rows break a rule of the data model."""


def at_most(df: DataFrame, n: int, what: str) -> DataFrame:
    """df, if it has at most n rows; reads n + 1 rows at most."""
    if df.limit(n + 1).count() > n:
        raise BoundExceeded(f"{what}: more than {n}")
    return df


def total_at_most(df: DataFrame, column: Column, n: int, what: str) -> DataFrame:
    if (df.agg(F.sum(column)).first()[0] or 0) > n:
        raise BoundExceeded(f"{what}: more than {n}")
    return df


def unique(df: DataFrame, *key: str, what: str = "key") -> DataFrame:
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise InvalidRows(f"duplicate {what}: {', '.join(key)}")
    return df


def holds(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """df with a check of each row as it passes: a row that breaks the condition fails the query."""
    message = F.when(~F.coalesce(condition, F.lit(False)), F.lit(what))
    return df.where(F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


class Limits:
    """Bounds that the job itself counts as its rows pass, in place of a job ahead of it. A bounded DataFrame is written or checkpointed once;
    :meth:`check` then fails if a bound was passed, before anything that depends on it is made visible."""

    def __init__(self) -> None:
        self.held: list[tuple[Observation, list[tuple[str, int]]]] = []

    def on(self, df: DataFrame, **most: tuple[Column, int]) -> DataFrame:
        """df; name=(what a row adds, the most in all)."""
        seen = Observation()
        self.held.append((seen, [(name, n) for name, (_, n) in most.items()]))
        return df.observe(seen, *[F.coalesce(F.sum(each.cast("long")), F.lit(0)).alias(name) for name, (each, _) in most.items()])

    def check(self) -> dict[str, int]:
        """What was counted; raises BoundExceeded."""
        found: dict[str, int] = {}
        for seen, most in self.held:
            found |= seen.get
            for name, n in most:
                if found[name] > n:
                    raise BoundExceeded(f"{name}: {found[name]}, at most {n}")
        return found
