"""Text of names across encodings where Spark's own functions refuse lone surrogates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utf16_key(name: Column) -> Column:
    """UTF-16LE bytes of a valid name."""
    return F.encode(name, "UTF-16LE")


@F.pandas_udf(T.StringType())
def shown_utf16(raw: pd.Series) -> pd.Series:
    """Text of UTF-16LE bytes; lone surrogates, which no string column can hold, become U+FFFD. The bytes stay the key."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-16-le", "replace"))


@F.pandas_udf(T.BinaryType())
def utf8_of_utf16(raw: pd.Series) -> pd.Series:
    """UTF-8 bytes of UTF-16LE bytes; lone surrogates pass through as three bytes each, so that the way back is exact."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-16-le", "surrogatepass").encode("utf-8", "surrogatepass"))


@F.pandas_udf(T.BinaryType())
def utf16_of_utf8(raw: pd.Series) -> pd.Series:
    """The inverse of ``utf8_of_utf16``."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass"))
