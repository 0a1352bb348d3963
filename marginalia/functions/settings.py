"""Typed reads of user-written JSON settings: a wrong type falls back, a value out of range clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _schema_at(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def whole_number(doc: Column, path: str) -> Column:
    """The integer at ``path`` as decimal(38,0); NULL for booleans, text, fractions, missing keys.

    The type is asked of the variant itself, because a cast would turn ``true`` into 1.
    """
    kind = _schema_at(doc, path)
    is_int = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    return F.when(is_int, F.try_variant_get(doc, path, "decimal(38,0)"))


def number(doc: Column, path: str) -> Column:
    kind = _schema_at(doc, path)
    ok = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(ok, F.try_variant_get(doc, path, "double"))


def clamped_int(doc: Column, path: str, default: int, low: int, high: Column | int) -> Column:
    top = high if isinstance(high, Column) else F.lit(high)
    value = whole_number(doc, path)
    held = F.greatest(F.lit(low), F.least(top, value)).cast("int")
    return F.when(value.isNull(), F.lit(default)).otherwise(held)


def clamped_float(doc: Column, path: str, default: float, low: float, high: float) -> Column:
    value = number(doc, path)
    held = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNull(), F.lit(default)).otherwise(held)


def settings(text: Column) -> Column:
    return F.try_parse_json(text)
