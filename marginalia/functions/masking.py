"""Masking of nested records by key name, generated from the record's schema."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import REDACTED, SENSITIVE_KEY, is_sensitive_key, mask


def mask_record(value: Column, kind: T.DataType) -> Column:
    """The same record with sensitive keys redacted and every other text masked, at any depth."""
    if isinstance(kind, T.StringType):
        return mask(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: mask_record(item, kind.elementType))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(is_sensitive_key(k), REDACTED).otherwise(mask(v)))
        # values are not text: a sensitive key loses its value, the others are walked
        return F.transform_values(value, lambda k, v: F.when(~is_sensitive_key(k), mask_record(v, kind.valueType)))
    if isinstance(kind, T.StructType):
        fields = [
            F.lit(REDACTED).alias(f.name) if re.match(SENSITIVE_KEY, f.name)
            else mask_record(value.getField(f.name), f.dataType).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value
