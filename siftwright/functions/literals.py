"""Values out of dictionaries written as literals of a scripting language."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _value(text: str | None, key: str) -> str | None:
    if text is None:
        return None
    try:
        found = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    value = found.get(key) if isinstance(found, dict) else None
    return value if value is None or isinstance(value, str) else str(value)


def literal_value(text: Column, key: str) -> Column:
    """The value of ``key`` in a dictionary literal, read by a safe parser; null for what is none.

    A plain ``'key': 'value'`` without escapes is read on the JVM; only other texts go to Python.
    """

    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _value(x, key) if isinstance(x, str) else None).astype(object)

    simple = rf"^\{{(?:'[^'\\]*': (?:'[^'\\]*'|\d+|True|False|None)(?:, )?)*\}}$"
    native = F.regexp_extract(text, rf"[{{ ]'{key}': '([^'\\]*)'", 1)
    plain = text.rlike(simple) & text.rlike(rf"[{{ ]'{key}': '")
    return F.when(plain, native).otherwise(F.pandas_udf(parse, StringType())(F.when(~plain, text)))
