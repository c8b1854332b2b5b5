"""Normal forms, which the engine's own functions lack: Arrow-batched, and meant for distinct words or characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def folded(word: str) -> str:
    """Compatibility decomposition without its marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.category(c).startswith("M")).lower()


def search_fold(words: Column) -> Column:
    """folded() of a column."""

    def batch(found: pd.Series) -> pd.Series:
        return found.map(folded, na_action="ignore")

    return F.pandas_udf(batch, StringType())(words)


def nfd_length(characters: Column) -> Column:
    """How many characters the canonical decomposition has."""

    def batch(found: pd.Series) -> pd.Series:
        return found.map(lambda c: len(unicodedata.normalize("NFD", c)), na_action="ignore").astype("Int32")

    return F.pandas_udf(batch, IntegerType())(characters)
