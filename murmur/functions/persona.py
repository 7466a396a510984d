"""Names reduced to a key that accounts of one person share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def persona_key(names: pd.Series) -> pd.Series:
    """Before the first comma, decomposed (NFKD) without accents, lower case, words of a-z and 0-9; null if nothing is left.

    Spark has no built-in for the decomposition.
    """
    s = names.str.split(",", n=1).str[0].str.normalize("NFKD").str.replace("[̀-ͯ]", "", regex=True).str.lower()
    s = s.str.replace("[^a-z0-9]+", " ", regex=True).str.strip()
    return s.where(s.notna() & (s != ""), None)
