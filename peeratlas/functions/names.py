"""Author names for search."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """Compatibility form without combining marks, lower case, words of letters and digits
    with single blanks between; null becomes empty."""

    def plain(name: str) -> str:
        bare = (c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() else " " for c in "".join(bare).lower()).split())

    return names.fillna("").map(plain)


def search_tokens(norm: Column) -> Column:
    """The tokens a name is found by: the first, and the last if it is another one of two
    characters or more."""
    words = F.split(norm, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    more = (F.size(words) > 1) & (first != last) & (F.length(last) >= 2)
    return F.when(more, F.array(first, last)).otherwise(F.array(first))
