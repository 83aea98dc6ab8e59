"""Changes to table values that make a check harder; the checking SQL reads the values as they were."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that NFKC turns into the letters on the left
DISGUISES = {"fi": "\ufb01", "st": "\ufb06", "ti": "\uff54\uff49", "1": "\u2460", "\u00e9": "e\u0301", "a": "\u00aa"}


def disguised(c: Column) -> Column:
    """The same text in other characters: ligatures, full width, circled digits, superscripts, marks apart from their letters."""
    for plain, other in DISGUISES.items():
        c = F.replace(c, F.lit(plain), F.lit(other))
    return c
