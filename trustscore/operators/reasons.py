"""Reason arrays shared by the three signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustscore.constants import MESSAGES

REASON_TYPE = "array<struct<code:string,message:string>>"


def reason(code: str, condition: Column, message: Column | None = None) -> Column:
    """A (code, message) struct where the condition holds, else null."""
    text = F.lit(MESSAGES[code]) if message is None else message
    return F.when(condition, F.struct(F.lit(code).alias("code"), text.alias("message")))


def reasons(*items: Column) -> Column:
    """Ordered array of the reasons that apply."""
    return F.array_compact(F.array(*items)).cast(REASON_TYPE)


def no_reasons() -> Column:
    return F.array().cast(REASON_TYPE)


def codes(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.transform(column, lambda item: item["code"])
