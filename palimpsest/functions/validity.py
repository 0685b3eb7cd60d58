"""Bi-temporal validity: [t_valid, t_invalid), seconds since 1970; a live fact has no end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def live(prefix: str = "") -> Column:
    return F.col(prefix + "t_invalid").isNull()


def as_of(moment: int | Column, prefix: str = "") -> Column:
    m = moment if isinstance(moment, Column) else F.lit(moment)
    return (F.col(prefix + "t_valid") <= m) & (F.col(prefix + "t_invalid").isNull() | (F.col(prefix + "t_invalid") > m))
