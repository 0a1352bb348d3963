"""Settings kept as one line of text: ``name:value;name:value;``.

An entry that cannot be read is dropped alone; the rest of the line stays in force and the last of
two entries with one name wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrays import each
from marginalia.functions.text import strip

PRICE = "decimal(14,8)"


def _entries(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    split = each(lines, keys, F.split(F.col(text), ";", -1), "raw", "pos")
    return split.select(*keys, "pos", strip(F.col("raw")).alias("entry")).filter(F.col("entry") != "")


def _last_wins(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    picked = F.max_by(F.struct(*values), "pos").alias("kept")
    return df.groupBy(*keys).agg(picked).select(*keys, "kept.*")


def price_table(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``model:prompt/completion`` per entry, prices per million tokens; the last colon ends the model."""
    entry = _entries(lines, keys, text)
    shaped = entry.select(
        *keys, "pos",
        strip(F.regexp_extract("entry", r"(?s)^(.*):([^:]*)$", 1)).alias("model"),
        F.regexp_extract("entry", r"(?s)^(.*):([^:]*)$", 2).alias("price"),
    ).filter((F.col("model") != "") & F.col("price").contains("/"))
    priced = shaped.select(
        *keys, "pos", "model",
        strip(F.substring_index("price", "/", 1)).try_cast(PRICE).alias("prompt_price"),
        strip(F.expr("substr(price, instr(price, '/') + 1)")).try_cast(PRICE).alias("completion_price"),
    ).filter((F.col("prompt_price") >= 0) & (F.col("completion_price") >= 0))
    return _last_wins(priced, [*keys, "model"], ["prompt_price", "completion_price"])


def plan_limits(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``resource:limit`` per entry; the first colon ends the name, negatives are dropped."""
    entry = _entries(lines, keys, text)
    shaped = entry.select(
        *keys, "pos",
        strip(F.substring_index("entry", ":", 1)).alias("resource"),
        _whole("entry").alias("limit"),
    ).filter(F.col("limit") >= 0)
    return _last_wins(shaped, [*keys, "resource"], ["limit"])


def retention_months(lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``table:months`` per entry; zero, negative and unreadable months leave the table untouched."""
    entry = _entries(lines, keys, text)
    shaped = entry.select(
        *keys, "pos",
        F.substring_index("entry", ":", 1).alias("table_name"),
        _whole("entry").cast("int").alias("months"),
    ).filter((F.col("table_name") != "") & (F.col("months") > 0))
    return _last_wins(shaped, [*keys, "table_name"], ["months"])


def _whole(entry: str):
    """The integer after the first colon; NULL unless the rest of the entry is an integer."""
    value = strip(F.expr(f"if(instr({entry}, ':') > 0, substr({entry}, instr({entry}, ':') + 1), '')"))
    return F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("bigint"))
